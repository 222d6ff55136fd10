"""Queries on whole grids and on greedy choices: smoothing, filling, regions, pits, and places that keep their distance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityweave.operators import grids, landcover, outlines, profiles, sharpness, spacing, spatial, survey, tiles
from cityweave.plans.catalogue import rounded
from cityweave.plans.registry import Views, query
from cityweave.session import checkpointed
from cityweave.sources import rasters

#: Small enough that the small tables, too, have many tiles.
_TILE = 16
_NEAR = "(VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) o(i, j)"
_FOUR = "(VALUES (-1, 0), (0, -1), (0, 1), (1, 0)) o(i, j)"


def _weights(sigma: float) -> str:
    k = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-k, k + 1)]
    return "(VALUES " + ", ".join(f"({i}, CAST({x / sum(w)!r} AS DOUBLE))" for i, x in zip(range(-k, k + 1), w)) + ")"


def _smooth(sigma: float, layer: str, source: str, mirrored: bool) -> str:
    """smooth(row, col, z): the Gaussian of a layer over the rectangle of all cells."""
    turned = lambda at, n: f"((({at}) % (2 * {n})) + 2 * {n}) % (2 * {n})"
    back = lambda at, n: f"CASE WHEN {turned(at, n)} < {n} THEN {turned(at, n)} ELSE 2 * {n} - 1 - {turned(at, n)} END" if mirrored else at
    return f"""ends AS (SELECT max("row") + 1 AS n, max(col) + 1 AS m FROM {source}), box AS (SELECT r."row", c.col FROM ends, (SELECT unnest(range((SELECT n FROM ends))) AS "row") r, (SELECT unnest(range((SELECT m FROM ends))) AS col) c),
raw AS (SELECT box."row", box.col, coalesce({layer}, 0) AS z FROM box LEFT JOIN {source} s ON s."row" = box."row" AND s.col = box.col),
half AS (SELECT t."row", t.col, sum(w * raw.z) AS z FROM (SELECT box.*, w, {back('"row" + i', 'n')} AS f FROM box, ends, {_weights(sigma)} k(i, w)) t JOIN raw ON raw."row" = t.f AND raw.col = t.col GROUP BY ALL),
smooth AS (SELECT t."row", t.col, sum(w * half.z) AS z FROM (SELECT box.*, w, {back('col + i', 'm')} AS f FROM box, ends, {_weights(sigma)} k(i, w)) t JOIN half ON half."row" = t."row" AND half.col = t.f GROUP BY ALL)"""


@query(f"""WITH {_smooth(1.0, 'depth', 'cells', True)} SELECT c."row", c.col, round(z, 6) AS z FROM cells c JOIN smooth s ON s."row" = c."row" AND s.col = c.col""", "cells")
def gaussian_mirrored(v: Views) -> DataFrame:
    return rounded(grids.gaussian(v.cells, "depth", 1.0).select("row", "col", F.col("depth_smooth").alias("z")))


@query(f"""WITH {_smooth(1.3, 'depth', 'cells', False)} SELECT c."row", c.col, round(z, 6) AS z FROM cells c JOIN smooth s ON s."row" = c."row" AND s.col = c.col""", "cells")
def gaussian_zero_padded(v: Views) -> DataFrame:
    return rounded(grids.gaussian(v.cells, "depth", 1.3, mirrored=False).select("row", "col", F.col("depth_smooth").alias("z")))


def _fill(name: str, source: str) -> str:
    return f"""{name} AS (SELECT a."row", a.col, a.ok, CASE WHEN a.z IS NULL AND a.ok THEN avg(b.z) ELSE a.z END AS z FROM {source} a LEFT JOIN (SELECT "row" + i AS "row", col + j AS col, z FROM {source}, {_NEAR}) b ON b."row" = a."row" AND b.col = a.col GROUP BY a."row", a.col, a.ok, a.z)"""


@query(f"""WITH f0 AS (SELECT "row", col, true AS ok, CASE WHEN NOT water AND NOT building THEN dem END AS z FROM cells), {', '.join(_fill(f'f{k + 1}', f'f{k}') for k in range(4))} SELECT "row", col, round(z, 6) AS z FROM f4""", "cells")
def gaps_filled(v: Views) -> DataFrame:
    c = v.cells.withColumn("z", F.when(~F.col("water") & ~F.col("building"), F.col("dem")))
    return rounded(grids.gaps_filled(c, "z", most_rounds=4).select("row", "col", "z"))


@query(f"""WITH f0 AS (SELECT "row", col, building AS ok, CASE WHEN NOT water AND NOT building THEN dem END AS z FROM cells), {', '.join(_fill(f'f{k + 1}', f'f{k}') for k in range(4))} SELECT "row", col, round(z, 6) AS z FROM f4""", "cells")
def gaps_filled_where_allowed(v: Views) -> DataFrame:
    c = v.cells.withColumn("z", F.when(~F.col("water") & ~F.col("building"), F.col("dem")))
    return rounded(grids.gaps_filled(c, "z", F.col("building"), 4).select("row", "col", "z"))


def _ways_out(dem: str, slope: str, most: str, where: str = "true") -> str:
    """w(row, col, z): heights at which water can leave; the least of a cell is its filled height."""
    return f"""d AS (SELECT "row", col, {dem} AS z FROM cells WHERE {where}), rim AS (SELECT d."row", d.col FROM d, {_NEAR} LEFT JOIN d n ON n."row" = d."row" + i AND n.col = d.col + j WHERE n."row" IS NULL GROUP BY ALL),
w("row", col, z) AS (SELECT d."row", d.col, d.z FROM d JOIN rim ON rim."row" = d."row" AND rim.col = d.col UNION SELECT d."row", d.col, greatest(d.z, x.z + {slope}) FROM (SELECT "row" + i AS "row", col + j AS col, z FROM w, {_NEAR} WHERE z <= {most}) x JOIN d ON d."row" = x."row" AND d.col = x.col)"""


@query(f"""WITH RECURSIVE {_ways_out('round(dem, 1)', '0', '99')} SELECT "row", col, min(z) AS z FROM w GROUP BY ALL""", "cells")
def filled_depressions(v: Views) -> DataFrame:
    """Every cell at least as high as the lowest way out of the grid, tile by tile."""
    return tiles.filled(v.cells.withColumn("dem", F.round("dem", 1)), size=_TILE).withColumnRenamed("dem", "z")


@query(f"""WITH RECURSIVE {_ways_out('round(dem, 1)', '0', '99', 'NOT water')} SELECT "row", col, min(z) AS z FROM w GROUP BY ALL UNION ALL SELECT "row", col, round(dem, 1) FROM cells WHERE water""", "cells")
def filled_to_outlets(v: Views) -> DataFrame:
    """Water cells take all that reaches them and keep their height."""
    return tiles.filled(v.cells.withColumn("dem", F.round("dem", 1)), drain=F.col("water"), size=_TILE).withColumnRenamed("dem", "z")


@query(f"""WITH RECURSIVE {_ways_out('floor(dem)', '0.25', '29')} SELECT "row", col, CAST(min(z) AS DOUBLE) AS z FROM w GROUP BY ALL""", "cells")
def filled_with_slope(v: Views) -> DataFrame:
    """Filled ground falls by a quarter a cell on the way out."""
    return tiles.filled_sloping(v.cells.withColumn("dem", F.floor("dem")), slope=0.25, size=_TILE).withColumnRenamed("dem", "z")


@query("""SELECT c."row", c.col, round(min(sqrt(pow(c."row" - s."row", 2) + pow(c.col - s.col, 2))), 6) AS distance, min(sqrt(pow(c."row" - s."row", 2) + pow(c.col - s.col, 2))) <= 2.0 AS buffered FROM cells c JOIN cells s ON s.water GROUP BY ALL""", "cells")
def distance_bands(v: Views) -> DataFrame:
    """Distance of every cell to the nearest water, and whether it lies in a buffer of two cells."""
    return survey.nearest_source(v.cells, F.lit(True), F.col("water")).select("row", "col", F.round(F.sqrt("d2"), 6).alias("distance"), (F.col("d2") <= 4).alias("buffered"))


def _regions(where: str, near: str, same: str = "true") -> str:
    """l(row, col, id): the least cell number that each cell reaches."""
    return f"""s AS (SELECT "row", col, "row" * 1000 + col AS id, depth, dem FROM cells WHERE {where}), reach("row", col, id) AS (SELECT "row", col, id FROM s UNION SELECT b."row", b.col, x.id FROM (SELECT w."row" + i AS "row", w.col + j AS col, w.id, a.depth FROM reach w JOIN s a ON a."row" = w."row" AND a.col = w.col, {near}) x JOIN s b ON b."row" = x."row" AND b.col = x.col AND {same}),
l AS (SELECT "row", col, min(id) AS id FROM reach GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {_regions('depth > 0.9', _FOUR)} SELECT id // 1000 AS region_row, id % 1000 AS region_col, CAST(count(*) AS BIGINT) AS size FROM l GROUP BY id""", "cells")
def wet_regions(v: Views) -> DataFrame:
    """Connected wet cells and their number; the first cell in reading order names a region."""
    return tiles.components(v.cells.where("depth > 0.9"), size=_TILE).groupBy("region_row", "region_col").agg(F.count("*").alias("size"))


@query(f"""WITH RECURSIVE {_regions('depth > 0.9', _FOUR)}, n AS (SELECT l.id, c.band, count(*) AS n FROM l JOIN cells c ON c."row" = l."row" AND c.col = l.col GROUP BY ALL), t AS (SELECT id, sum(n) AS n FROM n GROUP BY 1) SELECT CAST(max(n) AS BIGINT) AS largest, CAST(sum(n) AS BIGINT) AS built, round(max(n) / sum(n), 6) AS continuity FROM t""", "cells")
def largest_region(v: Views) -> DataFrame:
    """Size of the largest connected region and its share of all wet cells."""
    found = tiles.components(v.cells.where("depth > 0.9"), size=_TILE)
    whole = found.agg(F.count("*").alias("built"))
    return tiles.largest(found).crossJoin(F.broadcast(whole)).select("largest", "built", F.round(F.col("largest") / F.col("built"), 6).alias("continuity"))


@query(f"""WITH RECURSIVE {_regions('depth * 3 >= 2.5', _NEAR, 'floor(b.depth * 3) = floor(x.depth * 3)')} SELECT l.id // 1000 AS region_row, l.id % 1000 AS region_col, CAST(count(*) AS BIGINT) AS area, round(median(depth * 3), 6) AS height FROM l JOIN s ON s."row" = l."row" AND s.col = l.col GROUP BY l.id HAVING count(*) >= 3""", "cells")
def height_bands(v: Views) -> DataFrame:
    """Connected regions of one height band, of three cells at least and in eight directions: area and median height."""
    c = v.cells.where(F.col("depth") * 3 >= 2.5)
    found = tiles.components(c, F.floor(F.col("depth") * 3), _TILE, diagonal=True).join(c.select("row", "col", "depth"), ["row", "col"])
    return found.groupBy("region_row", "region_col").agg(F.count("*").alias("area"), F.round(F.median(F.col("depth") * 3), 6).alias("height")).where("area >= 3")


@query(f"""WITH RECURSIVE {_regions('dem < 22', _NEAR)}, sizes AS (SELECT id, row_number() OVER (ORDER BY count(*) DESC, id) AS k FROM l GROUP BY id), pit AS (SELECT l.* FROM l JOIN sizes USING (id) WHERE k > 1),
ring AS (SELECT pit.id, count(DISTINCT c."row" * 1000 + c.col) AS n FROM pit JOIN cells c ON abs(c."row" - pit."row") <= 2 AND abs(c.col - pit.col) <= 2 AND c.dem >= 22 GROUP BY 1),
rz AS (SELECT id, quantile_cont(dem, 0.25) AS ring FROM (SELECT DISTINCT pit.id, c."row", c.col, c.dem FROM pit JOIN cells c ON abs(c."row" - pit."row") <= 2 AND abs(c.col - pit.col) <= 2 AND c.dem >= 22) GROUP BY 1),
fz AS (SELECT pit.id, quantile_cont(c.dem, 0.5) AS floor FROM pit JOIN cells c ON c."row" = pit."row" AND c.col = pit.col GROUP BY 1),
deep AS (SELECT id, greatest(floor, ring - 3.0) AS z FROM ring JOIN rz USING (id) JOIN fz USING (id) WHERE n >= 6 AND ring - floor >= 2.0)
SELECT c."row", c.col, round(coalesce(z, c.dem), 6) AS dem, z IS NOT NULL AS pit FROM cells c LEFT JOIN pit ON pit."row" = c."row" AND pit.col = c.col LEFT JOIN deep ON deep.id = pit.id""", "cells")
def enclosed_pits(v: Views) -> DataFrame:
    """Enclosed ground below a level that is deep under its rim gets one floor; the largest such region is the sea."""
    return rounded(tiles.pits_capped(v.cells.select("row", "col", "dem"), level=22.0, reach=2, least_ring=6, depth=2.0, most_depth=3.0, size=_TILE))


def _greedy(points: str, gap2: float, most: int) -> str:
    """Sequential greedy choice from points(key, x, y, score): got(k, taken), the last row has all of them."""
    return f"""p AS (SELECT *, row_number() OVER (ORDER BY score DESC, key) AS rn FROM ({points})),
got(k, taken) AS (SELECT 0, CAST([] AS STRUCT(rn BIGINT, x DOUBLE, y DOUBLE)[]) UNION ALL SELECT g.k + 1, list_append(g.taken, struct_pack(rn := p.rn, x := p.x, y := p.y)) FROM (SELECT k, taken, min(rn) AS rn FROM got, p WHERE k < {most} AND len(list_filter(taken, lambda t: (t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y) < {gap2})) = 0 GROUP BY k, taken) g JOIN p ON p.rn = g.rn)"""


_TAKEN = "SELECT unnest(taken) AS t, generate_subscripts(taken, 1) AS rank FROM got WHERE k = (SELECT max(k) FROM got)"
_KEY = '"row" * 1000 + col'


def key() -> Column:
    return (F.col("row") * 1000 + F.col("col")).alias("key")


_COMMANDED = f"""SELECT {_KEY} AS key, CAST(c.col AS DOUBLE) AS x, CAST(c."row" AS DOUBLE) AS y, round(s.z, 9) AS score FROM cells c JOIN smooth s ON s."row" = c."row" AND s.col = c.col WHERE NOT building AND NOT water"""


@query(f"""WITH RECURSIVE {_smooth(1.5, 'CASE WHEN NOT building AND NOT water THEN depth END', 'cells', True)}, {_greedy(_COMMANDED.replace('c."row" * 1000', '"row" * 1000').replace(_KEY, 'c."row" * 1000 + c.col') + ' AND round(s.z, 9) >= 0.3', 25.0, 40)}
SELECT p.key, CAST(rank AS INT) AS rank, p.x, p.y, round(p.score, 6) AS score FROM ({_TAKEN}) q JOIN p ON p.rn = q.t.rn""", "cells")
def drain_sites(v: Views) -> DataFrame:
    """Up to 40 inlets, best first by the ponding around them, five cells apart at least."""
    street = ~F.col("building") & ~F.col("water")
    c = grids.gaussian(v.cells.withColumn("pond", F.when(street, F.col("depth"))), "pond", 1.5).where(street)
    c = c.select(key(), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), F.round("pond_smooth", 9).alias("score"))
    return rounded(spacing.spaced(c, "key", "score", 5.0, most=40, least=0.3))


_WET = "NOT building AND NOT water AND depth > 0.08 AND depth < 1.2"


@query(f"""WITH RECURSIVE wet AS (SELECT "row", col FROM cells WHERE {_WET}), score AS (SELECT c."row", c.col, CAST(count(*) * 4 AS DOUBLE) AS score FROM cells c JOIN wet ON abs(wet."row" - c."row") <= 2 AND abs(wet.col - c.col) <= 2 GROUP BY ALL),
{_greedy(f'SELECT {_KEY} AS key, CAST(col AS DOUBLE) AS x, CAST("row" AS DOUBLE) AS y, score FROM score WHERE score >= 20 ORDER BY score DESC, key LIMIT 20000', 36.0, 6)}
SELECT p.key, CAST(rank AS INT) AS rank, p.x, p.y, p.score FROM ({_TAKEN}) q JOIN p ON p.rn = q.t.rn""", "cells")
def flood_hotspots(v: Views) -> DataFrame:
    """The six places with most wet street around them, six cells apart; the best 20,000 are examined."""
    wet = v.cells.select("row", "col", F.when(F.expr(_WET), 1).otherwise(0).alias("wet"))
    c = grids.box_sum(wet, "wet", 2).select(key(), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), (F.col("wet_box") * 4.0).alias("score"))
    return spacing.spaced(c, "key", "score", 6.0, most=6, least=20.0, examined=20_000)


@query(f"""WITH RECURSIVE {_ways_out('floor(dem)', '0.25', '29')}, filled AS (SELECT "row", col, CAST(min(z) AS DOUBLE) AS z FROM w GROUP BY ALL),
n AS (SELECT a."row", a.col, b."row" AS tr, b.col AS tc, (a.z - b.z) / sqrt(power(a."row" - b."row", 2) + power(a.col - b.col, 2)) AS s FROM (SELECT f.*, "row" + i AS nr, col + j AS nc FROM filled f, {_NEAR}) a JOIN filled b ON b."row" = a.nr AND b.col = a.nc WHERE a.z > b.z),
flow AS (SELECT f."row", f.col, tr, tc FROM filled f LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY s DESC, tr, tc) AS k FROM n) b ON b."row" = f."row" AND b.col = f.col AND k = 1),
down("row", col, r, c) AS (SELECT "row", col, "row", col FROM flow UNION ALL SELECT d."row", d.col, tr, tc FROM down d JOIN flow f ON f."row" = d.r AND f.col = d.c WHERE tr IS NOT NULL), acc AS (SELECT r AS "row", c AS col, count(*) AS a FROM down GROUP BY ALL),
bounds AS (SELECT quantile_cont(dem, 0.2) AS lo, quantile_cont(dem, 0.85) AS hi FROM cells), inner_cells AS (SELECT c."row", c.col, c.dem FROM cells c JOIN cells o ON abs(o."row" - c."row") <= 2 AND abs(o.col - c.col) <= 2 GROUP BY ALL HAVING count(*) = 25),
{_greedy('SELECT i."row" * 1000 + i.col AS key, CAST(i.col AS DOUBLE) AS x, CAST(i."row" AS DOUBLE) AS y, CAST(a AS DOUBLE) AS score FROM inner_cells i JOIN acc ON acc."row" = i."row" AND acc.col = i.col, bounds WHERE dem BETWEEN lo AND hi', 36.0, 5)}
SELECT p.key, CAST(rank AS INT) AS rank, p.x, p.y, p.score FROM ({_TAKEN}) q JOIN p ON p.rn = q.t.rn""", "cells")
def gauge_sites(v: Views) -> DataFrame:
    """Five probes on the strongest drainage lines of the middle heights, off the rim and six cells apart."""
    ground = tiles.filled_sloping(v.cells.withColumn("dem", F.floor("dem")), slope=0.25, size=_TILE)
    acc = grids.flow_accumulation(grids.receivers(ground))
    ends = v.cells.agg(F.percentile("dem", 0.2).alias("lo"), F.percentile("dem", 0.85).alias("hi"))
    inner = grids.box_sum(v.cells.select("row", "col", F.lit(1).alias("one")), "one", 2).where("one_box = 25").select("row", "col")
    c = v.cells.join(F.broadcast(ends)).where(F.col("dem").between(F.col("lo"), F.col("hi"))).select("row", "col").join(inner, ["row", "col"]).join(acc, ["row", "col"])
    c = c.select(key(), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), F.col("accumulation").cast("double").alias("score"))
    return spacing.spaced(c, "key", "score", 6.0, most=5)


# lights: candidates from cells, density from the buildings within five cells
_DENSE = """n AS (SELECT c."row", c.col, count(b."row") AS n FROM cells c LEFT JOIN cells b ON b.building AND (b."row" - c."row") * (b."row" - c."row") + (b.col - c.col) * (b.col - c.col) <= 25 WHERE NOT c.building AND NOT c.water GROUP BY ALL),
q AS (SELECT "row" * 1000 + col AS key, CAST(col AS DOUBLE) AS x, CAST("row" AS DOUBLE) AS y, CAST(n AS DOUBLE) / greatest((SELECT max(n) FROM n), 1) AS d FROM n), mid AS (SELECT avg(col) AS mx, avg("row") AS my, greatest(max(col) - min(col), max("row") - min("row")) AS span FROM cells WHERE building),
far0 AS (SELECT q.*, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) AS f FROM q, mid), goal AS (SELECT greatest(12.0, span / (sqrt(12.0) * 1.6)) AS target FROM mid)"""


@query(f"""WITH RECURSIVE {_DENSE}, one AS (SELECT key, x, y FROM far0 ORDER BY 0.65 * d + 0.35 * (1.0 - f / (SELECT max(f) FROM far0)) DESC, key LIMIT 1),
got(k, taken) AS (SELECT 1, [struct_pack(key := key, x := x, y := y)] FROM one UNION ALL SELECT g.k + 1, list_append(g.taken, struct_pack(key := q.key, x := q.x, y := q.y)) FROM (SELECT k, taken, arg_max(key, struct_pack(s := s, m := -key)) AS best FROM (SELECT got.k, got.taken, q.key, 0.72 * least(list_min(list_transform(taken, lambda t: sqrt((q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y)))) / target, 1.0) + 0.28 * q.d AS s FROM got, q, goal WHERE k < 12 AND NOT list_contains(list_transform(taken, lambda t: t.key), q.key)) GROUP BY k, taken) g JOIN q ON q.key = g.best)
SELECT t.key, t.x, t.y, CAST(pick AS INT) AS pick FROM (SELECT unnest(taken) AS t, generate_subscripts(taken, 1) AS pick FROM got WHERE k = (SELECT max(k) FROM got))""", "cells")
def light_sites(v: Views) -> DataFrame:
    """Twelve lights, each far from the others and near buildings."""
    built, open_ = v.cells.where("building"), v.cells.where("NOT building AND NOT water")
    at = lambda d, x, y: d.select(key(), F.col("col").cast("double").alias(x), F.col("row").cast("double").alias(y))
    near = spatial.within(at(open_, "x", "y"), at(built, "px", "py").drop("key"), 5.0).groupBy("key").agg(F.count("*").alias("n"))
    c = at(open_, "x", "y").join(near, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ends = built.agg(F.avg("col").alias("x"), F.avg("row").alias("y"), F.greatest(F.max("col") - F.min("col"), F.max("row") - F.min("row")).alias("span")).first()
    top = c.agg(F.max("n")).first()[0]
    c = c.withColumn("density", F.col("n").cast("double") / max(top or 0, 1))
    return spacing.spread(c, "key", "density", 12, (ends.x or 0.0, ends.y or 0.0), float(ends.span or 0))


# footways from customers and roads from suppliers, spread so that their density stays as the tables grow
_WALK = "walk AS (SELECT CAST(c_custkey AS BIGINT) AS node, CAST(c_custkey % 97 * 10.5 + c_custkey * 7 % 10 AS DOUBLE) AS x, CAST(c_custkey // 97 * 11.25 + c_custkey * 3 % 9 AS DOUBLE) AS y FROM customer)"
_ROAD = "road AS (SELECT CAST(s_suppkey AS BIGINT) AS road, CAST(s_suppkey % 7 * 140 AS DOUBLE) + 0.5 AS ax, CAST(s_suppkey // 7 AS DOUBLE) * 12.125 + 4.25 AS ay, CAST(s_suppkey % 7 * 140 AS DOUBLE) + 128.25 AS bx, CAST(s_suppkey // 7 AS DOUBLE) * 12.125 + 6.5 + CAST(s_suppkey % 5 AS DOUBLE) AS b_y FROM supplier)"


def _cross(px: str, py: str, qx: str, qy: str, ax: str, ay: str, bx: str, by: str) -> str:
    s = lambda x1, y1, x2, y2, x, y: f"(({x2} - {x1}) * ({y} - {y1}) - ({y2} - {y1}) * ({x} - {x1}))"
    return f"{s(px, py, qx, qy, ax, ay)} * {s(px, py, qx, qy, bx, by)} < 0 AND {s(ax, ay, bx, by, px, py)} * {s(ax, ay, bx, by, qx, qy)} < 0"


@query(f"""WITH {_WALK}, {_ROAD}, pair AS (SELECT a.node AS a, b.node AS b, a.x, a.y, b.x AS px, b.y AS py, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS distance FROM walk a JOIN walk b ON a.node < b.node AND abs(a.x - b.x) <= 30 AND abs(a.y - b.y) <= 30),
ok AS (SELECT a, b, distance, row_number() OVER (ORDER BY distance, a, b) AS rn FROM pair WHERE distance >= 3 AND distance <= 30 AND NOT EXISTS (SELECT 1 FROM streets s WHERE s.u = a AND s.v = b OR s.u = b AND s.v = a) AND EXISTS (SELECT 1 FROM road r WHERE {_cross('pair.x', 'pair.y', 'pair.px', 'pair.py', 'r.ax', 'r.ay', 'r.bx', 'r.b_y')}))
SELECT a, b, round(distance, 6) AS distance FROM ok""", "streets")
def crossing_candidates(v: Views) -> DataFrame:
    """Pairs of footway nodes 3 to 30 m apart, not linked yet, whose line crosses a road."""
    return rounded(_crossings(v))


def _crossings(v: Views) -> DataFrame:
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    walk = v.customer.select(k.cast("long").alias("a"), (k % 97 * 10.5 + k * 7 % 10).cast("double").alias("x"), (F.floor(k / 97) * 11.25 + k * 3 % 9).cast("double").alias("y"))
    road = v.supplier.select(((s % 7) * 140 + 0.5).cast("double").alias("ax"), (F.floor(s / 7) * 12.125 + 4.25).cast("double").alias("ay"), ((s % 7) * 140 + 128.25).cast("double").alias("bx"), (F.floor(s / 7) * 12.125 + 6.5 + s % 5).cast("double").alias("by"))
    pairs = spatial.within(walk, walk.select(F.col("a").alias("b"), F.col("x").alias("px"), F.col("y").alias("py")), 30.0).where("a < b AND distance >= 3")
    both = v.streets.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    pairs = pairs.join(both, ["a", "b"], "left_anti")
    cells = lambda d, *c: d.withColumn("_c", F.explode(spatial.segment_cells(*(F.col(n) for n in c), 40.0)))
    hit = spatial.segments_cross(tuple(F.col(n) for n in ("x", "y", "px", "py")), tuple(F.col(n) for n in ("ax", "ay", "bx", "by")), touch=False)
    return cells(pairs, "x", "y", "px", "py").join(cells(road, "ax", "ay", "bx", "by").hint("merge"), "_c").where(hit).select("a", "b", "distance").distinct()


@query(f"""WITH RECURSIVE {_WALK}, {_ROAD}, pair AS (SELECT a.node AS a, b.node AS b, a.x, a.y, b.x AS px, b.y AS py, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS distance FROM walk a JOIN walk b ON a.node < b.node AND abs(a.x - b.x) <= 30 AND abs(a.y - b.y) <= 30),
ok AS (SELECT a, b, distance, row_number() OVER (ORDER BY distance, a, b) AS rn FROM pair WHERE distance >= 3 AND distance <= 30 AND NOT EXISTS (SELECT 1 FROM streets s WHERE s.u = a AND s.v = b OR s.u = b AND s.v = a) AND EXISTS (SELECT 1 FROM road r WHERE {_cross('pair.x', 'pair.y', 'pair.px', 'pair.py', 'r.ax', 'r.ay', 'r.bx', 'r.b_y')})),
got(rn, took, ends) AS (SELECT CAST(0 AS BIGINT), false, CAST([] AS BIGINT[]) UNION ALL SELECT rn, free, CASE WHEN free THEN ends || [a, b] ELSE ends END FROM (SELECT ok.rn, got.ends, ok.a, ok.b, len(list_filter(ends, lambda e: e = ok.a)) < 2 AND len(list_filter(ends, lambda e: e = ok.b)) < 2 AS free FROM got JOIN ok ON ok.rn = got.rn + 1))
SELECT a, b, round(distance, 6) AS distance FROM ok WHERE rn IN (SELECT rn FROM got WHERE took)""", "streets")
def crossing_links(v: Views) -> DataFrame:
    """The nearest such links first, two a node at most."""
    return rounded(spacing.linked(_crossings(v), 2))


# elevation rasters: each band of 64 rows of cells a file of its own, written and read again
_BAND = 64


def _raster_files(v: Views, sample: str, predictor: int) -> DataFrame:
    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((_BAND, 50), np.nan)
        grid[_BAND - 1 - (pdf["row"].to_numpy() - int(key[0]) * _BAND), pdf["col"].to_numpy()] = pdf["z"].to_numpy()
        data = rasters.encode(grid, 16, sample, True, predictor, (0.0, 2.0 * (int(key[0]) + 1) * _BAND), (2.0, 2.0), -9999)
        return pd.DataFrame({"path": [f"band-{int(key[0])}.tif"], "content": [data]})

    c = v.cells.select(F.floor(F.col("row") / _BAND).alias("band"), "row", "col", F.floor(F.col("dem") * 8).alias("z"))
    return c.groupBy("band").applyInPandas(one, "path string, content binary")


@query("""SELECT "row", col, floor(dem * 8) AS value FROM cells""", "cells")
def raster_cells(v: Views) -> DataFrame:
    """Rasters of whole numbers with horizontal differences, tile by tile, merged into one grid."""
    found = rasters.cells(rasters.tiles(_raster_files(v, "<i4", 2)))
    return rasters.merged(found.where("value IS NOT NULL"), 2.0, 2.0, least=-500.0)


@query("""WITH p AS (SELECT CAST(c_custkey AS BIGINT) AS point, CAST(c_custkey * 37 % 1600 AS DOUBLE) / 16 AS x, CAST(c_custkey * 91 % ((SELECT max("row") FROM cells) * 32) AS DOUBLE) / 16 AS y FROM customer), q AS (SELECT point, x / 2 - 0.5 AS u, y / 2 - 0.5 AS v FROM p),
n AS (SELECT point, floor(v) + i AS r, floor(u) + j AS c, abs(1 - i - (v - floor(v))) * abs(1 - j - (u - floor(u))) AS w FROM q, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
SELECT point, CASE WHEN count(g."row") = 4 THEN round(sum(w * floor(dem * 8)), 6) END AS z FROM n LEFT JOIN cells g ON g."row" = n.r AND g.col = n.c GROUP BY point""", "cells")
def raster_heights(v: Views) -> DataFrame:
    """Heights of points between the centres of a float raster's cells."""
    k, top = F.col("c_custkey"), v.cells.agg(F.max("row").alias("top"))
    points = v.customer.join(F.broadcast(top)).select(k.cast("long").alias("point"), ((k * 37 % 1600).cast("double") / 16).alias("x"), ((k * 91 % (F.col("top") * 32)).cast("double") / 16).alias("y"))
    grid = rasters.merged(rasters.cells(rasters.tiles(_raster_files(v, ">f4", 3))).where("value IS NOT NULL"), 2.0, 2.0)
    return rounded(rasters.heights(grid, points, 2.0, 2.0, "point"))


@query(f"""WITH RECURSIVE {_regions('depth > 0.9', _FOUR)}, rim AS (SELECT l.id, count(*) AS n FROM l, {_FOUR} LEFT JOIN l m ON m."row" = l."row" + i AND m.col = l.col + j WHERE m."row" IS NULL GROUP BY 1)
SELECT l.id // 1000 AS region_row, l.id % 1000 AS region_col, CAST(count(*) AS DOUBLE) AS area, CAST(any_value(n) AS BIGINT) AS corners, CAST(1 AS BIGINT) AS outer_rings FROM l JOIN rim ON rim.id = l.id GROUP BY l.id""", "cells")
def wet_outlines(v: Views) -> DataFrame:
    """Rings round connected wet cells: together as large as their cells, one outer ring each, as many corners as open sides."""
    wet = v.cells.where("depth > 0.9").select("row", "col")
    found = outlines.measured(outlines.rings(wet)).join(tiles.components(wet, size=_TILE), ["row", "col"])
    return found.groupBy("region_row", "region_col").agg(F.sum("area").alias("area"), F.sum("corners").alias("corners"), F.count_if(F.col("area") > 0).alias("outer_rings"))


# an aerial image: pixels of 1 m, some patches of one tone; its outline is cut obliquely
_PIXELS = """px AS (SELECT "row", col, CASE WHEN patch = 0 THEN 90 ELSE CAST(round(depth * 50) AS INT) * 2 END AS red, CASE WHEN patch = 0 THEN 91 ELSE CAST(round(speed * 40) AS INT) * 3 END AS green, CASE WHEN patch = 0 THEN 92 WHEN patch = 1 THEN 250 ELSE CAST(round(dem * 10) AS INT) - 200 END AS blue FROM (SELECT *, CAST((floor("row" / 12) + floor(col / 14)) AS INT) % 3 AS patch FROM cells) WHERE col + "row" % 30 >= 7 AND NOT (building AND water))"""


def _mirrored_window(name: str, source: str, size: int) -> str:
    """name(row, col, lap, n): sums of the source over size x size windows, mirrored at the rims of the grid `ends` (n, m)."""
    turned = lambda at, n: f"((({at}) % (2 * {n})) + 2 * {n}) % (2 * {n})"
    back = lambda at, n: f"least({turned(at, n)}, 2 * {n} - 1 - {turned(at, n)})"
    steps = f"(SELECT unnest(range({-(size // 2)}, {size - size // 2})) AS {{}})"
    return f"""{name} AS (SELECT b."row", b.col, sum(coalesce(s.lap, 0)) AS lap, sum(coalesce(s.n, 0)) AS n FROM (SELECT b."row", b.col, {back('b."row" + i', 'n')} AS r, {back('b.col + j', 'm')} AS c FROM box b, ends, {steps.format('i')}, {steps.format('j')}) b LEFT JOIN {source} s ON s."row" = b.r AND s.col = b.c GROUP BY 1, 2)"""


def _linked(name: str, source: str) -> str:
    """name(row, col, id): the least cell number that each cell of the source reaches in four directions."""
    return f"""{name}_reach("row", col, id) AS (SELECT "row", col, "row" * 1000 + col FROM {source} UNION SELECT b."row", b.col, w.id FROM (SELECT "row" + i AS "row", col + j AS col, id FROM {name}_reach, {_FOUR}) w JOIN {source} b ON b."row" = w."row" AND b.col = w.col),
{name} AS (SELECT "row", col, min(id) AS id FROM {name}_reach GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {_PIXELS}, nine AS (SELECT a, b FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b)),
whole AS (SELECT p."row", p.col FROM px p, nine JOIN px q ON q."row" = p."row" + a AND q.col = p.col + b GROUP BY 1, 2 HAVING count(*) = 9),
lap AS (SELECT w."row", w.col, abs(sum(q.red + q.green + q.blue) - 4 * any_value(p.red + p.green + p.blue)) AS lap FROM whole w JOIN px p ON p."row" = w."row" AND p.col = w.col, {_FOUR} JOIN px q ON q."row" = w."row" + i AND q.col = w.col + j GROUP BY 1, 2),
fine AS (SELECT "row" // 2 AS "row", col // 2 AS col, sum(lap) AS lap, count(*) AS n FROM lap GROUP BY 1, 2),
ends AS (SELECT max("row") // 2 + 1 AS n, max(col) // 2 + 1 AS m FROM px), box AS (SELECT "row", col FROM ends, (SELECT unnest(range((SELECT n FROM ends))) AS "row"), (SELECT unnest(range((SELECT m FROM ends))) AS col)),
{_mirrored_window('mean', 'fine', 4)},
blk AS (SELECT "row" // 2 AS "row", col // 2 AS col, count(*) AS n, sum(red) / 4 AS r, sum(green) / 4 AS g, sum(blue) / 4 AS b FROM px GROUP BY 1, 2),
wet AS (SELECT "row", col FROM blk WHERE b > r + 10 AND g > r AND (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b, 1) > 0.3),
core AS (SELECT w."row", w.col FROM wet w, nine JOIN wet x ON x."row" = w."row" + a AND x.col = w.col + b GROUP BY 1, 2 HAVING count(*) = 9), sea AS (SELECT DISTINCT "row" + a AS "row", col + b AS col FROM core, nine),
ins AS (SELECT blk."row", blk.col, CASE WHEN mean.n > 0.2 * 64 THEN mean.lap / (3 * mean.n) END AS q FROM blk JOIN mean ON mean."row" = blk."row" AND mean.col = blk.col WHERE blk.n > 2),
low AS (SELECT "row", col FROM ins WHERE coalesce(q, 0) < 0.35 * (SELECT median(q) FROM ins) AND NOT EXISTS (SELECT 1 FROM sea WHERE sea."row" = ins."row" AND sea.col = ins.col)),
outside AS (SELECT "row", col FROM box WHERE NOT EXISTS (SELECT 1 FROM ins WHERE ins."row" = box."row" AND ins.col = box.col)), margin AS (SELECT DISTINCT "row" + i AS "row", col + j AS col FROM outside, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j)),
{_linked('l', 'low')}, hit AS (SELECT DISTINCT id FROM l JOIN margin ON margin."row" = l."row" AND margin.col = l.col),
bad AS (SELECT DISTINCT ins."row", ins.col FROM l JOIN hit ON hit.id = l.id, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j) JOIN ins ON ins."row" = l."row" + i AND ins.col = l.col + j),
rest AS (SELECT "row", col FROM ins WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad."row" = ins."row" AND bad.col = ins.col)), {_linked('k', 'rest')},
gone AS (SELECT "row", col FROM bad UNION SELECT "row", col FROM k WHERE id IN (SELECT id FROM k GROUP BY id HAVING count(*) * 4 < 40) AND EXISTS (SELECT 1 FROM bad))
SELECT px."row", px.col, g."row" IS NOT NULL AS blurred FROM px LEFT JOIN gone g ON g."row" = px."row" // 2 AND g.col = px.col // 2""", "cells")
def blurred_margin(v: Views) -> DataFrame:
    """Pixels of an image, and whether they belong to its blurred margin."""
    patch = (F.floor(F.col("row") / 12) + F.floor(F.col("col") / 14)) % 3
    whole = lambda c, by: F.round(F.col(c) * by).cast("int")
    c = v.cells.where((F.col("col") + F.col("row") % 30 >= 7) & ~(F.col("building") & F.col("water")))
    red, green = (F.when(patch == 0, k).otherwise(whole(n, by) * m) for k, n, by, m in ((90, "depth", 50, 2), (91, "speed", 40, 3)))
    blue = F.when(patch == 0, 92).when(patch == 1, 250).otherwise(whole("dem", 10) - 200)
    px = c.select("row", "col", red.alias("red"), green.alias("green"), blue.alias("blue"))
    return sharpness.blurred(px, 1.0, 2, 8.0, 40.0, _TILE).select("row", "col", "blurred")


@query(f"""WITH RECURSIVE {_ways_out('floor(dem)', '0.25', '29')}, filled AS (SELECT "row", col, min(z) AS z FROM w GROUP BY ALL),
drop_ AS (SELECT a."row", a.col, b."row" AS tr, b.col AS tc, row_number() OVER (PARTITION BY a."row", a.col ORDER BY (a.z - b.z) / sqrt(abs(i) + abs(j)) DESC, b."row", b.col) AS k FROM filled a, {_NEAR} JOIN filled b ON b."row" = a."row" + i AND b.col = a.col + j WHERE a.z > b.z),
flow AS (SELECT "row", col, tr, tc FROM drop_ WHERE k = 1), t(r, c, ar, ac) AS (SELECT "row", col, "row", col FROM filled UNION ALL SELECT t.r, t.c, f.tr, f.tc FROM t JOIN flow f ON f."row" = t.ar AND f.col = t.ac),
acc AS (SELECT ar AS "row", ac AS col, count(*) AS n FROM t GROUP BY 1, 2), inner_ AS (SELECT a."row", a.col FROM filled a JOIN filled b ON abs(a."row" - b."row") <= 2 AND abs(a.col - b.col) <= 2 GROUP BY 1, 2 HAVING count(*) = 25),
outlet AS (SELECT acc.* FROM acc JOIN inner_ ON inner_."row" = acc."row" AND inner_.col = acc.col ORDER BY n DESC, acc."row", acc.col LIMIT 1),
up AS (SELECT tr, tc, "row", col FROM (SELECT f.*, row_number() OVER (PARTITION BY tr, tc ORDER BY n DESC, f."row", f.col) AS k FROM flow f JOIN acc ON acc."row" = f."row" AND acc.col = f.col WHERE n > 2 AND n > (SELECT n FROM outlet) * 0.005) WHERE k = 1),
stem("row", col, pos) AS (SELECT "row", col, CAST(0 AS BIGINT) FROM outlet UNION ALL SELECT up."row", up.col, pos + 1 FROM stem JOIN up ON up.tr = stem."row" AND up.tc = stem.col)
SELECT "row", col, pos FROM stem""", "cells")
def main_stem(v: Views) -> DataFrame:
    """The main channel of the whole grid: filled ground, receivers, accumulation, then up the largest tributary."""
    ground = tiles.filled_sloping(v.cells.withColumn("dem", F.floor("dem")), slope=0.25, size=_TILE)
    flow = checkpointed(grids.receivers(ground))
    inner = grids.box_sum(ground.select("row", "col", F.lit(1).alias("one")), "one", 2).where("one_box = 25")
    return grids.main_stem(flow, checkpointed(grids.flow_accumulation(flow)), least=2.0, outlets=inner)


@query("""WITH p AS (SELECT CAST(s_suppkey AS BIGINT) AS path_id, CAST(s_suppkey % 40 + 0.5 AS DOUBLE) AS x, CAST(s_suppkey % 45 * 0.5 + s_suppkey // 1000 * 200 + 0.25 AS DOUBLE) AS y, CAST(10 + s_suppkey % 3 * 2.5 AS DOUBLE) AS length FROM supplier), n AS (SELECT *, CAST(floor(length / 3) + 2 AS INT) AS n FROM p),
s AS (SELECT path_id, length, n, i, x + least(length * i / (n - 1), 10) * 0.8 AS x, y + least(length * i / (n - 1), 10) * 0.6 + greatest(length * i / (n - 1) - 10, 0) AS y FROM (SELECT *, unnest(range(n)) AS i FROM n)),
h AS (SELECT path_id, length, n, s.i, sum(coalesce(dem, 0) * abs(1 - a - (y - floor(y))) * abs(1 - b - (x - floor(x)))) AS z FROM s, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b) LEFT JOIN cells ON cells."row" = floor(y) + a AND cells.col = floor(x) + b GROUP BY ALL)
SELECT path_id, length, n AS count, pos AS i, round(coalesce(z, 0), 6) AS z FROM n, (SELECT unnest(range((SELECT max(n) FROM n))) AS pos) LEFT JOIN (SELECT path_id AS k, i, z FROM h) h ON h.k = path_id AND h.i = pos""", "cells")
def ground_profiles(v: Views) -> DataFrame:
    """Heights every few metres along paths of two pieces, between the cells' centres, padded to the longest path."""
    k = F.col("s_suppkey").cast("long")
    x, y = (k % 40 + 0.5).cast("double"), (k % 45 * 0.5 + F.floor(k / 1000) * 200 + 0.25).cast("double")
    spots = F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + 8).alias("x"), (y + 6).alias("y")), F.struct((x + 8).alias("x"), (y + 6 + k % 3 * 2.5).alias("y")))
    p = v.supplier.select(k.alias("path_id"), F.posexplode(spots).alias("pos", "p")).select("path_id", "pos", "p.*")
    found = profiles.heights_along(p, v.cells, "dem", 3.0, padded=True)
    return found.select("path_id", F.round("length", 6).alias("length"), "count", F.posexplode("profile").alias("i", "z")).withColumn("z", F.round("z", 6))


def _otsu(name: str, source: str, value: str, least: float, most: float) -> str:
    """name(v): the threshold of largest variance between two classes, over 256 bins, held within bounds."""
    return f"""{name}_b AS (SELECT min({value}) AS lo, max({value}) AS hi FROM {source}), {name}_h AS (SELECT CAST(least(floor(({value} - lo) / (hi - lo) * 256), 255) AS BIGINT) AS k, count(*) AS n FROM {source}, {name}_b GROUP BY 1),
{name}_c AS (SELECT k, CAST(sum(n) OVER (ORDER BY k) AS DOUBLE) AS w, CAST(sum(n * k) OVER (ORDER BY k) AS DOUBLE) AS m, CAST(sum(n) OVER () AS DOUBLE) AS t, CAST(sum(n * k) OVER () AS DOUBLE) AS q FROM {name}_h),
{name} AS (SELECT least(greatest(lo + (k + 0.5) * (hi - lo) / 256, {least}), {most}) AS v FROM {name}_c, {name}_b WHERE w < t ORDER BY power(m * t - q * w, 2) / (w * (t - w)) DESC, k LIMIT 1)"""


_BACK = "CASE WHEN {0} < 0 THEN -1 - ({0}) WHEN {0} >= {1} THEN 2 * {1} - 1 - ({0}) ELSE {0} END"


@query(f"""WITH p0 AS (SELECT "row", col, CAST(round(depth * 50) AS INT) AS a, CAST(round(speed * 40) AS INT) AS c, CAST(floor("row" / 8) AS INT) % 3 AS zone, round(dem * 10) / 64 AS ground, speed * 2 AS relief, building, water, NOT (building AND water) AS valid FROM cells),
p1 AS (SELECT *, CASE zone WHEN 0 THEN 60 + a % 30 WHEN 1 THEN 180 + c % 20 ELSE a * 2 END AS r, CASE zone WHEN 0 THEN 110 + c WHEN 1 THEN 130 ELSE a * 2 + c % 5 END AS g, CASE zone WHEN 0 THEN 60 + c % 30 WHEN 1 THEN 70 + a % 9 ELSE a * 2 END AS b FROM p0),
x AS (SELECT *, r + g + b > 30 AS lit, (2 * g - r - b) / (r + g + b + CAST(1e-6 AS DOUBLE)) AS exg, (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b, 1) > 0.12 AND r > g AND g > b AS earthy, (r + g + b) / 3 / 255 AS bright FROM p1),
{_otsu('green', '(SELECT exg FROM x WHERE valid AND lit)', 'exg', 0.03, 0.15)},
ends AS (SELECT max("row") + 1 AS n, max(col) + 1 AS m, (SELECT avg(ground) FROM x WHERE valid) AS mean FROM x), z AS (SELECT "row", col, CASE WHEN valid THEN ground ELSE mean END AS z FROM x, ends),
wide AS (SELECT x."row", x.col, {_BACK.format('x."row" + i', 'n')} AS r, {_BACK.format('x.col + j', 'm')} AS c FROM x, ends, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)),
rough AS (SELECT w."row", w.col, sqrt(greatest(0, sum(z * z) / count(*) - (sum(z) / count(*)) * (sum(z) / count(*)))) AS rough FROM wide w JOIN z ON z."row" = w.r AND z.col = w.c GROUP BY 1, 2),
halo AS (SELECT DISTINCT "row" + i AS "row", col + j AS col FROM x, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j) WHERE building AND abs(i) + abs(j) <= 2),
y AS (SELECT x.*, rough, valid AND halo."row" IS NULL AS far, valid AND exg > (SELECT v FROM green) AS veg FROM x JOIN rough ON rough."row" = x."row" AND rough.col = x.col LEFT JOIN halo ON halo."row" = x."row" AND halo.col = x.col),
t AS (SELECT *, valid AND NOT veg AND NOT building AND NOT water AS bare FROM y), {_otsu('light', '(SELECT bright FROM t WHERE bare AND NOT earthy AND lit)', 'bright', 0.25, 0.75)},
bumpy AS (SELECT least(greatest(quantile_cont(rough, 0.82), 0.02), 1.5) AS v FROM t WHERE far AND lit)
SELECT "row", col, CASE WHEN NOT valid THEN 'paved' WHEN building THEN 'building' WHEN water THEN 'water' WHEN veg AND relief > 2 THEN 'canopy' WHEN veg AND relief > 0.3 THEN 'shrub' WHEN veg THEN 'grass' WHEN far AND rough > (SELECT v FROM bumpy) THEN 'gravel' WHEN earthy THEN 'soil' WHEN bright > (SELECT v FROM light) THEN 'concrete' ELSE 'paved' END AS cover FROM t""", "cells")
def learned_land_cover(v: Views) -> DataFrame:
    """Land cover of the whole grid, by thresholds that the grid itself gives."""
    whole = lambda c, by: F.round(F.col(c) * by).cast("int")
    x = v.cells.select("*", whole("depth", 50).alias("a"), whole("speed", 40).alias("c"), (F.floor(F.col("row") / 8) % 3).alias("zone"))
    a, c, zone = F.col("a"), F.col("c"), F.col("zone")
    of = lambda green, soil, grey: F.when(zone == 0, green).when(zone == 1, soil).otherwise(grey)
    px = x.select(
        "row", "col", of(60 + a % 30, 180 + c % 20, a * 2).alias("red"), of(110 + c, F.lit(130), a * 2 + c % 5).alias("green"), of(60 + c % 30, 70 + a % 9, a * 2).alias("blue"),
        (whole("dem", 10) / 64).alias("ground"), (F.col("speed") * 2).alias("relief"), "building", "water", (~(F.col("building") & F.col("water"))).alias("valid"),
    )
    return landcover.classified(px)
