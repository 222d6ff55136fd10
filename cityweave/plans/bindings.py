"""Sample tables seen as the domain's relations, with integer arithmetic that any SQL engine repeats.

Each binding is a function (spark, sf_dir) -> DataFrame and a SQL text of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.functions.parse import lookup

NODES = 100
VCLASS = {"click": "passenger", "error": "bus", "purchase": "truck", "signup": "bicycle", "view": "tram"}
HIGHWAY = {"1-URGENT": "motorway", "2-HIGH": "primary", "3-MEDIUM": "secondary", "4-NOT SPECIFIED": "residential", "5-LOW": "footway"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case(column: str, table: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{other}' END"


def veh(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return e.select(
        i.alias("row_id"), F.col("user_id").alias("vehicle_id"), t.alias("t_s"), F.floor(t / 300).alias("tick"), (F.least("value", F.lit(120.0)) / 4).alias("speed_ms"),
        lookup(F.col("event_type"), VCLASS, "other").alias("vclass"), ((i * 37) % 1000).cast("double").alias("x"), ((i * 91) % 1000).cast("double").alias("y"),
        (i % 20).alias("path_id"), (i % 2).alias("run"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("s_suppkey").cast("long")
    return read(spark, sf_dir, "supplier").select(i.alias("node_id"), ((i * 53) % 2000).cast("double").alias("x"), ((i * 97) % 2000).cast("double").alias("y"), (i % 7 == 0).alias("signal"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    u, v = F.col("l_suppkey") % NODES, F.col("o_custkey") % NODES
    return j.where(u != v).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("seq"), u.cast("long").alias("u"), v.cast("long").alias("v"), F.col("l_linenumber").cast("long").alias("key"),
        (F.col("l_quantity") * 20).cast("double").alias("length"), ((30 + 10 * F.col("l_linenumber")) / 3.6).cast("double").alias("speed_ms"), lookup(F.col("o_orderpriority"), HIGHWAY, "other").alias("highway"),
        (F.col("l_linenumber") == 3).alias("oneway"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.when(F.col("l_returnflag") == "R", "A").otherwise("B").alias("run"), F.col("l_partkey").cast("long").alias("edge_id"), (F.col("l_extendedprice") / F.col("l_quantity") / 10).cast("double").alias("tt"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(
        F.floor(k / 50).cast("long").alias("row"), (k % 50).cast("long").alias("col"), ((F.col("p_partkey") * 7919) % 97 / 50.0).alias("depth"), ((F.col("p_partkey") * 104729) % 61 / 40.0).alias("speed"),
        (20 + (F.col("p_partkey") * 31) % 83 / 10.0).alias("dem"), (F.col("p_size") % 5 == 0).alias("building"), (F.col("p_size") % 9 == 0).alias("water"), (F.col("p_size") % 4).cast("long").alias("band"), (F.col("p_size") / 100.0).cast("double").alias("infil"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    sim = li.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("double")).alias("sim_s"))
    return o.join(sim, o.o_orderkey == sim.l_orderkey).select(F.col("o_orderkey").cast("long").alias("pair_id"), "sim_s", (F.col("o_orderkey") % 300 + 10).cast("double").alias("ref_s"), lookup(F.col("o_orderpriority"), HIGHWAY, "other").alias("class"))


#: Corners of the sample polygons, in units of their radius.
CORNERS = [(1.0, 0.125), (0.375, 0.9375), (-0.8125, 0.5625), (-0.75, -0.625), (0.3125, -0.875)]


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of one polygon per supplier, in cells: it grows with the table, polygons overlap."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(x).alias("ox"), F.lit(y).alias("oy")) for i, (x, y) in enumerate(CORNERS)))).alias("c")
    r = 2 + k % 5
    return s.select(k.cast("long").alias("poly"), F.col("s_nationkey").cast("long").alias("zone"), (k % 4).cast("long").alias("cls"), ((k * 37) % 200 + 10.25).cast("double").alias("cx"), ((k * 91) % 160 + 10.125).cast("double").alias("cy"), r.cast("double").alias("r"), corner).select(
        "poly", "zone", "cls", "cx", "cy", "r", "c.pos", (F.col("cx") + F.col("r") * F.col("c.ox")).alias("x"), (F.col("cy") + F.col("r") * F.col("c.oy")).alias("y")
    )


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A street network that grows with the customers: chains of `CHAIN` nodes, both directions, next to each other but apart."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    on = c.where(k % CHAIN != CHAIN - 1)
    forth = on.select(k.cast("long").alias("u"), (k + 1).cast("long").alias("v"), (10 + (k * 7) % 13).cast("double").alias("length"), F.lit(1).alias("dir"))
    back = on.select((k + 1).cast("long").alias("u"), k.cast("long").alias("v"), (12 + (k * 5) % 11).cast("double").alias("length"), F.lit(-1).alias("dir"))
    known = c.select(k.cast("long").alias("v"))
    return forth.join(known, "v", "left_semi").union(back.join(known.withColumnRenamed("v", "u"), "u", "left_semi").select("v", "u", "length", "dir")).select("u", "v", "length", "dir")


#: Nodes of a chain of `streets`.
CHAIN = 16

SQL = {
    "shapes": "SELECT CAST(s_suppkey AS BIGINT) AS poly, CAST(s_nationkey AS BIGINT) AS zone, CAST(s_suppkey % 4 AS BIGINT) AS cls, CAST((s_suppkey * 37) % 200 + 10.25 AS DOUBLE) AS cx, CAST((s_suppkey * 91) % 160 + 10.125 AS DOUBLE) AS cy, CAST(2 + s_suppkey % 5 AS DOUBLE) AS r, pos, CAST((s_suppkey * 37) % 200 + 10.25 AS DOUBLE) + CAST(2 + s_suppkey % 5 AS DOUBLE) * ox AS x, CAST((s_suppkey * 91) % 160 + 10.125 AS DOUBLE) + CAST(2 + s_suppkey % 5 AS DOUBLE) * oy AS y FROM supplier, (VALUES " + ", ".join(f"({i}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for i, (x, y) in enumerate(CORNERS)) + ") o(pos, ox, oy)",
    "streets": f"SELECT CAST(a.c_custkey AS BIGINT) AS u, CAST(b.c_custkey AS BIGINT) AS v, CAST(10 + (a.c_custkey * 7) % 13 AS DOUBLE) AS length, 1 AS dir FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey % {CHAIN} <> {CHAIN - 1} UNION ALL SELECT CAST(b.c_custkey AS BIGINT) AS u, CAST(a.c_custkey AS BIGINT) AS v, CAST(12 + (a.c_custkey * 5) % 11 AS DOUBLE) AS length, -1 AS dir FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey % {CHAIN} <> {CHAIN - 1}",
    "veh": f"SELECT event_id AS row_id, user_id AS vehicle_id, CAST(floor(epoch(ts)) AS BIGINT) AS t_s, CAST(floor(floor(epoch(ts)) / 300) AS BIGINT) AS tick, least(value, 120.0) / 4 AS speed_ms, {case('event_type', VCLASS, 'other')} AS vclass, CAST((event_id * 37) % 1000 AS DOUBLE) AS x, CAST((event_id * 91) % 1000 AS DOUBLE) AS y, event_id % 20 AS path_id, event_id % 2 AS run FROM events",
    "nodes": f"SELECT CAST(s_suppkey AS BIGINT) AS node_id, CAST((s_suppkey * 53) % 2000 AS DOUBLE) AS x, CAST((s_suppkey * 97) % 2000 AS DOUBLE) AS y, s_suppkey % 7 = 0 AS signal FROM supplier",
    "edges": f"SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS seq, CAST(l_suppkey % {NODES} AS BIGINT) AS u, CAST(o_custkey % {NODES} AS BIGINT) AS v, CAST(l_linenumber AS BIGINT) AS key, CAST(l_quantity * 20 AS DOUBLE) AS length, CAST((30 + 10 * l_linenumber) / 3.6 AS DOUBLE) AS speed_ms, {case('o_orderpriority', HIGHWAY, 'other')} AS highway, l_linenumber = 3 AS oneway FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey % {NODES} <> o_custkey % {NODES}",
    "runs": "SELECT CASE WHEN l_returnflag = 'R' THEN 'A' ELSE 'B' END AS run, CAST(l_partkey AS BIGINT) AS edge_id, CAST(l_extendedprice / l_quantity / 10 AS DOUBLE) AS tt FROM lineitem",
    "cells": "SELECT CAST(floor(p_partkey / 50.0) AS BIGINT) AS row, CAST(p_partkey % 50 AS BIGINT) AS col, (p_partkey * 7919) % 97 / 50.0 AS depth, (p_partkey * 104729) % 61 / 40.0 AS speed, 20 + (p_partkey * 31) % 83 / 10.0 AS dem, p_size % 5 = 0 AS building, p_size % 9 = 0 AS water, CAST(p_size % 4 AS BIGINT) AS band, CAST(p_size / 100.0 AS DOUBLE) AS infil FROM part",
    "pairs": f"SELECT CAST(o_orderkey AS BIGINT) AS pair_id, sim_s, CAST(o_orderkey % 300 + 10 AS DOUBLE) AS ref_s, {case('o_orderpriority', HIGHWAY, 'other')} AS class FROM orders JOIN (SELECT l_orderkey, sum(CAST(l_quantity AS DOUBLE)) AS sim_s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey",
}
