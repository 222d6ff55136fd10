"""Every registered query with SQL against that SQL in another engine, over the small tables."""

import os

import duckdb
import pytest

from cityweave.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


#: Queries that SQL can't express; test_twins.py holds their operators against brute force, test_kernels.py the flood's balance.
BRUTE_FORCED = {"edge_betweenness", "pareto_routes", "flood_run_kernel"}


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(tuple, frame.astype(object).where(frame.notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, other, name):
    if name not in registry.ORACLES:
        assert name in BRUTE_FORCED and registry.QUERIES[name](spark, DATA).count() > 0
        return
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(other.sql(registry.ORACLES[name]).df())


def test_flagship_and_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
