"""Queries on tables made for what the smallest sample tables don't hold, against their SQL."""

import duckdb
import pytest
from test_catalogue import DATA, rows

from cityweave.plans import registry


@pytest.fixture
def held(spark, tmp_path):
    """A function (query, table=SQL, ...): the query over the sample tables, some of them replaced, equals its SQL."""

    def run(name: str, **tables: str) -> list[tuple]:
        con = duckdb.connect()
        for t in "nation supplier customer part orders lineitem events".split():
            con.execute(f"COPY ({tables.get(t, f'SELECT * FROM base')}) TO '{tmp_path}/{t}.parquet'".replace("base", f"'{DATA}/{t}.parquet'"))
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        got = rows(registry.QUERIES[name](spark, str(tmp_path)).toPandas())
        assert got == rows(con.sql(registry.ORACLES[name]).df())
        return got[1]

    return run


def test_copies_of_nodes_keep_their_rows(held):
    got = held("design_upsert", supplier="SELECT * REPLACE (i AS s_suppkey) FROM range(1200) r(i), (SELECT * FROM base LIMIT 1)")
    assert len(got) == 1320


@pytest.mark.parametrize("name", ["crossing_candidates", "crossing_links"])
def test_lines_that_only_touch_a_road(held, name):
    some = "SELECT * REPLACE ({} + i AS {}) FROM range({}) r(i), (SELECT * FROM base LIMIT 1)".format
    assert held(name, customer=some(45250, "c_custkey", 400), supplier=some(2950, "s_suppkey", 150))


def test_half_seconds(held):
    at = "TIMESTAMP '2024-01-01 00:00:00.5' + INTERVAL 1 SECOND * i"
    got = held("decoded_positions", events=f"SELECT * REPLACE (i AS event_id, {at} AS ts) FROM range(1, 41) r(i), (SELECT * FROM base LIMIT 1)")
    assert len(got) == 37


def test_standing_through_a_long_silence(held):
    got = held("streamed_stuck_resets", events="SELECT * REPLACE (i * 6000 AS event_id, 7 AS user_id) FROM range(20) r(i), (SELECT * FROM base LIMIT 1)")
    assert len(got) == 19


def test_boxes_of_one_place_are_compared_once(spark, held):
    assert held("overlapping_boxes", supplier="SELECT * REPLACE (i % 40 + 2000 * (i // 40) AS s_suppkey) FROM range(200) r(i), (SELECT * FROM base LIMIT 1)")
    plan = registry.QUERIES["overlapping_boxes"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [a#" not in plan  # no pairs are gathered to be told apart
