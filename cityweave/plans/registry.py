"""Named queries over the sample tables, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cityweave.plans import bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Views:
    """The bindings of one folder of tables, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        bound = getattr(bindings, name, None) if name in bindings.SQL else None
        return bound(self.spark, self.sf_dir) if bound else bindings.read(self.spark, self.sf_dir, name)


def query(sql: str | None = None, uses: str = "") -> Callable:
    """Register a function of Views as a query; sql may use the bindings named in `uses` as tables."""

    def put(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            names = uses.split()
            head = "WITH " + ", ".join(f"{n} AS ({bindings.SQL[n]})" for n in names) + " " if names else ""
            if head and sql.lstrip().startswith("WITH RECURSIVE "):
                ORACLES[f.__name__] = head.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", " + sql.lstrip()[15:]
            elif head and sql.lstrip().startswith("WITH "):
                ORACLES[f.__name__] = head.rstrip() + ", " + sql.lstrip()[5:]
            else:
                ORACLES[f.__name__] = head + sql
        return f

    return put


FLAGSHIP = "scenario_comparison"

from cityweave.plans import catalogue, edits, footprints, kernels, records, reports, shapes, studies, terrain, trips  # noqa: E402, F401  they register the queries
