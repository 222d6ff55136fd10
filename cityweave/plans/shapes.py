"""Queries on polygons, lines and surveyed rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityweave.operators import rasterize, survey
from cityweave.plans.registry import Views, query

# sides of the polygons, written out once
_SIDES = """sides AS (SELECT poly, zone, cls, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM shapes WINDOW w AS (PARTITION BY poly ORDER BY pos)),
boxes AS (SELECT poly, floor(min(x)) - 8 AS c0, ceil(max(x)) + 8 AS c1, floor(min(y)) - 8 AS r0, ceil(max(y)) + 8 AS r1 FROM shapes GROUP BY poly),
grid AS (SELECT poly, "row", unnest(range(CAST(c0 AS BIGINT), CAST(c1 AS BIGINT))) AS col FROM (SELECT poly, c0, c1, unnest(range(CAST(r0 AS BIGINT), CAST(r1 AS BIGINT))) AS "row" FROM boxes))"""
_IN = "(y1 <= {y}) <> (y2 <= {y}) AND x1 + ({y} - y1) * (x2 - x1) / (y2 - y1) <= {x}"
_CENTRES = f"""centres AS (SELECT g.poly, g."row", g.col, count(*) % 2 = 1 AS inside FROM grid g JOIN sides s ON s.poly = g.poly AND {_IN.format(x='(g.col + 0.5)', y='(g."row" + 0.5)')} GROUP BY ALL)"""
# distance of a cell's centre to a side, squared
_T = "least(greatest(((g.col + 0.5 - x1) * (x2 - x1) + (g.\"row\" + 0.5 - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 1)"
_NEAR = f"SELECT DISTINCT s.poly, g.\"row\", g.col FROM grid g JOIN sides s ON s.poly = g.poly WHERE sqrt(pow(g.col + 0.5 - x1 - {_T} * (x2 - x1), 2) + pow(g.\"row\" + 0.5 - y1 - {_T} * (y2 - y1), 2)) <= 1.5"


def sides(v: Views) -> DataFrame:
    return rasterize.sides(v.shapes, ["poly", "zone", "cls"], "pos")


_SAMPLES = f"""samples AS (SELECT g.poly, g."row", g.col, a, b FROM grid g, (SELECT unnest([0, 1, 2, 3]) AS a), (SELECT unnest([0, 1, 2, 3]) AS b)),
hits AS (SELECT g.poly, g."row", g.col, a, b FROM samples g JOIN sides s ON s.poly = g.poly AND {_IN.format(x='(g.col + (a + 0.5) / 4)', y='(g."row" + (b + 0.5) / 4)')} GROUP BY ALL HAVING count(*) % 2 = 1),
part AS (SELECT poly, "row", col, count(*) / 16.0 AS fraction FROM hits GROUP BY ALL)"""


@query(f'WITH {_SIDES}, {_SAMPLES} SELECT poly, "row", col, round(fraction, 6) AS fraction FROM part', "shapes")
def polygon_fractions(v: Views) -> DataFrame:
    return rasterize.coverage(sides(v), "poly").select("poly", "row", "col", F.round("fraction", 6).alias("fraction"))


@query(f"""WITH {_SIDES}, {_SAMPLES}, c AS (SELECT DISTINCT poly, cls FROM shapes) SELECT cls, "row", col, round(least(sum(fraction), 1.0), 6) AS fraction FROM part JOIN c ON c.poly = part.poly GROUP BY cls, "row", col""", "shapes")
def painted_classes(v: Views) -> DataFrame:
    part = rasterize.coverage(sides(v), "poly").join(v.shapes.select("poly", "cls").distinct(), "poly")
    return rasterize.painted(part, "cls").withColumn("fraction", F.round("fraction", 6))


@query("""WITH o AS (SELECT DISTINCT poly, cx, cy, r / 4 + 1 AS r FROM shapes), moved AS (SELECT poly, 0 AS zone, 0 AS cls, k AS pos, cx + r * cos(k * 2 * 3.141592653589793 / 24) AS x, cy + r * sin(k * 2 * 3.141592653589793 / 24) AS y FROM o, (SELECT unnest(range(24)) AS k)),
""" + _SIDES.replace("shapes", "moved") + ", " + _SAMPLES + ' SELECT "row", col, CAST(count(*) AS BIGINT) AS trees, round(sum(fraction), 6) AS cover FROM part GROUP BY "row", col', "shapes")
def disc_fractions(v: Views) -> DataFrame:
    o = v.shapes.select("poly", F.col("cx").alias("x"), F.col("cy").alias("y"), (F.col("r") / 4 + 1).alias("r")).distinct()
    c = rasterize.coverage(rasterize.discs(o, "poly", F.col("r")), "poly")
    return c.groupBy("row", "col").agg(F.count("*").alias("trees"), F.round(F.sum("fraction"), 6).alias("cover"))


@query(f"""WITH {_SIDES}, {_CENTRES}, cut AS (SELECT g.poly, g."row", g.col, least((g.col - x1) / (x2 - x1), (g.col + 1 - x1) / (x2 - x1)) AS ta, greatest((g.col - x1) / (x2 - x1), (g.col + 1 - x1) / (x2 - x1)) AS tb, least((g."row" - y1) / (y2 - y1), (g."row" + 1 - y1) / (y2 - y1)) AS ua, greatest((g."row" - y1) / (y2 - y1), (g."row" + 1 - y1) / (y2 - y1)) AS ub FROM grid g JOIN sides s ON s.poly = g.poly)
SELECT poly, "row", col FROM centres WHERE inside UNION SELECT poly, "row", col FROM cut WHERE greatest(ta, ua, 0) < least(tb, ub, 1)""", "shapes")
def touched_cells(v: Views) -> DataFrame:
    return rasterize.touched(sides(v), "poly")


@query(f"WITH {_SIDES} {_NEAR}", "shapes")
def buffered_lines(v: Views) -> DataFrame:
    return rasterize.line_mask(sides(v), "poly", 1.5)


@query(f"""WITH {_SIDES}, {_CENTRES}, near AS ({_NEAR}) SELECT n.poly, n."row", n.col FROM near n LEFT JOIN centres c ON c.poly = n.poly AND c."row" = n."row" AND c.col = n.col WHERE NOT coalesce(inside, false)""", "shapes")
def building_rings(v: Views) -> DataFrame:
    return rasterize.rim(sides(v), "poly", 1.5)


@query(f"""WITH {_SIDES}, {_CENTRES}, z AS (SELECT DISTINCT poly, zone FROM shapes) SELECT zone, "row", col FROM centres JOIN z ON z.poly = centres.poly WHERE inside GROUP BY ALL HAVING count(*) % 2 = 1""", "shapes")
def zone_rings_xor(v: Views) -> DataFrame:
    return rasterize.inside_samples(sides(v), "zone").select("zone", F.col("j").alias("row"), F.col("i").alias("col"))


@query(f"""WITH {_SIDES}, {_CENTRES}, z AS (SELECT DISTINCT poly, zone FROM shapes) SELECT DISTINCT zone, "row", col FROM centres JOIN z ON z.poly = centres.poly WHERE inside""", "shapes")
def multipart_masks(v: Views) -> DataFrame:
    s = rasterize.inside_samples(sides(v), "poly").join(v.shapes.select("poly", "zone").distinct(), "poly")
    return s.select("zone", F.col("j").alias("row"), F.col("i").alias("col")).distinct()


@query(f"""WITH moved AS (SELECT poly, zone, cls, cx, cy, r, pos, x / 2.5 AS x, y / 2.5 AS y FROM shapes), {_SIDES.replace("shapes", "moved")}, {_CENTRES} SELECT poly, round((col + 0.5) * 2.5, 6) AS x, round(("row" + 0.5) * 2.5, 6) AS y FROM centres WHERE inside""", "shapes")
def candidate_points(v: Views) -> DataFrame:
    """Places of a 2.5 m grid inside polygons."""
    cells = sides(v).select("poly", *((F.col(c) / 2.5).alias(c) for c in ("x1", "y1", "x2", "y2")))
    return rasterize.inside_samples(cells, "poly").select("poly", F.round((F.col("i") + 0.5) * 2.5, 6).alias("x"), F.round((F.col("j") + 0.5) * 2.5, 6).alias("y"))


@query(f"""WITH b AS (SELECT poly, cls, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM shapes GROUP BY ALL), l AS (SELECT * FROM b WHERE cls = 1 AND x1 - x0 >= 6 AND y1 - y0 >= 6),
s AS (SELECT poly, x0, x1, y, unnest(range(CAST(ceil((x1 - x0 - 1.175) / 2.35) AS BIGINT))) AS i FROM (SELECT poly, x0, x1, y0 + 2.75 + 5.5 * unnest(range(CAST(ceil((y1 - y0 - 2.75) / 5.5) AS BIGINT))) AS y FROM l))
SELECT poly, round(x0 + 1.175 + 2.35 * i, 6) AS x, round(y, 6) AS y FROM s""", "shapes")
def parking_slots(v: Views) -> DataFrame:
    """Slots of 2.35 x 5.5 m over the boxes of parking lots (class 1) of 6 m at least."""
    from cityweave.operators.trips import lot_slots

    return lot_slots(v.shapes.where("cls = 1"), "poly").select("poly", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_GROUND = "ground AS (SELECT \"row\", col, dem, building, 0.02 + band * 0.01 AS manning, infil, 1 + depth AS rain FROM cells)"


def ground(v: Views) -> DataFrame:
    return v.cells.select("row", "col", "dem", "building", (F.lit(0.02) + F.col("band") * 0.01).alias("manning"), "infil", (1 + F.col("depth")).alias("rain"))


@query(f"""WITH {_GROUND}, b AS (SELECT "row" // 2 AS "row", col // 2 AS col, avg(CAST(building AS INT)) AS share, avg(dem) FILTER (NOT building) AS g, max(dem) FILTER (building) AS w, avg(manning) FILTER (NOT building) AS n, avg(infil) FILTER (NOT building) AS i, avg(rain) AS rain FROM ground GROUP BY 1, 2),
c AS (SELECT *, share >= 0.5 AND w IS NOT NULL AS blocked FROM b), m AS (SELECT t."row" AS tr, t.col AS tc, t.rain, arg_min({{'r': s."row", 'c': s.col}}, pow(t."row" - s."row", 2) + pow(t.col - s.col, 2) + s."row" / 1e6 + s.col / 1e10) AS s FROM c t, c s WHERE t.blocked AND NOT s.blocked GROUP BY ALL),
a AS (SELECT s.r AS "row", s.c AS col, sum(rain) AS more FROM m GROUP BY 1, 2)
SELECT c."row", c.col, blocked, round(CASE WHEN blocked THEN w ELSE coalesce(g, w) END, 6) AS dem, round(CASE WHEN blocked THEN 0.05 ELSE n END, 6) AS manning, round(CASE WHEN blocked THEN 0.0 ELSE i END, 6) AS infil, round(CASE WHEN blocked THEN 0.0 ELSE rain + coalesce(more, 0) END, 6) AS rain FROM c LEFT JOIN a ON a."row" = c."row" AND a.col = c.col""", "cells")
def coarse_building_terrain(v: Views) -> DataFrame:
    out = survey.coarse_terrain(ground(v), 2)
    return out.select("row", "col", "blocked", *(F.round(c, 6).alias(c) for c in ("dem", "manning", "infil", "rain")))


_LOT = "building AND band = 0"
_NEAREST = f"""near AS (SELECT t."row" AS tr, t.col AS tc, arg_min(s.dem, pow(t."row" - s."row", 2) + pow(t.col - s.col, 2) + s."row" / 1e6 + s.col / 1e10) AS z FROM cells t, cells s WHERE (t.{_LOT.replace(' AND ', ' AND t.')}) AND NOT s.building GROUP BY ALL),
flat AS (SELECT c."row", c.col, CASE WHEN z IS NULL THEN dem ELSE least(dem, z) END AS dem, {_LOT} AS lot, NOT building OR ({_LOT}) AS support FROM cells c LEFT JOIN near ON tr = c."row" AND tc = c.col)"""


@query(f'WITH {_NEAREST} SELECT "row", col, round(dem, 6) AS dem FROM flat', "cells")
def cleared_lots(v: Views) -> DataFrame:
    return survey.cleared(v.cells, F.expr(_LOT), F.expr("NOT building")).select("row", "col", F.round("dem", 6).alias("dem"))


def _smooth(name: str, source: str) -> str:
    return f"""{name} AS (SELECT a."row", a.col, a.lot, a.support, CASE WHEN a.lot AND count(b.dem) FILTER (b.support) > 0 THEN avg(b.dem) FILTER (b.support) ELSE a.dem END AS dem FROM {source} a JOIN {source} b ON b."row" BETWEEN a."row" - 2 AND a."row" + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY a."row", a.col, a.lot, a.support, a.dem)"""


@query(f'WITH {_NEAREST}, {_smooth("s1", "flat")}, {_smooth("s2", "s1")}, {_smooth("s3", "s2")} SELECT "row", col, round(dem + 0.0000033, 4) AS dem FROM s3', "cells")
def graded_lots(v: Views) -> DataFrame:
    flat = survey.cleared(v.cells, F.expr(_LOT), F.expr("NOT building"))
    return survey.graded(flat, F.expr(_LOT), F.expr(f"NOT building OR ({_LOT})"), 2, rounds=3).select("row", "col", F.round(F.col("dem") + 0.0000033, 4).alias("dem"))


def _window(name: str, source: str, how: str) -> str:
    return f"""{name} AS (SELECT a."row", a.col, {how}(b.z) AS z FROM {source} a JOIN {source} b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY ALL)"""


@query(f'WITH z AS (SELECT "row", col, dem AS z FROM cells), {_window("lo", "z", "min")}, {_window("hi", "lo", "max")} SELECT z."row", z.col, round(z.z - hi.z, 6) AS rise FROM z JOIN hi ON hi."row" = z."row" AND hi.col = z.col WHERE z.z - hi.z > 1.0', "cells")
def unmapped_structures(v: Views) -> DataFrame:
    return survey.top_hat(v.cells, "dem", 1).where("rise > 1.0").select("row", "col", F.round("rise", 6).alias("rise"))


_VOTE = """samples AS (SELECT "row" // 8 * 100 + col // 10 AS voter, "row", col FROM cells WHERE building), built AS (SELECT "row", col FROM cells WHERE depth > 0.9),
moves AS (SELECT i AS di, j AS dj FROM (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j)),
score AS (SELECT voter, di, dj, avg(CASE WHEN b."row" IS NULL THEN 0 ELSE 1 END) AS score FROM samples s CROSS JOIN moves LEFT JOIN built b ON b."row" = s."row" + di AND b.col = s.col + dj GROUP BY ALL)"""


def votes(v: Views) -> DataFrame:
    s = v.cells.where("building").select((F.floor(F.col("row") / 8) * 100 + F.floor(F.col("col") / 10)).alias("voter"), "row", "col")
    return survey.shift_scores(s, v.cells.where("depth > 0.9"), "voter", 2)


@query(f"WITH {_VOTE} SELECT voter, di, dj, round(score, 6) AS score FROM score", "cells")
def footprint_shift_scores(v: Views) -> DataFrame:
    return votes(v).select("voter", "di", "dj", F.round("score", 6).alias("score"))


@query(f"""WITH {_VOTE}, t AS (SELECT di, dj, sum(score) AS score FROM score GROUP BY ALL), k AS (SELECT * FROM t WHERE score >= (SELECT max(score) FROM t) - 1e-9) SELECT di, dj, round(score, 6) AS score FROM k ORDER BY di * di + dj * dj, di, dj LIMIT 1""", "cells")
def voted_shift(v: Views) -> DataFrame:
    t = votes(v).groupBy("di", "dj").agg(F.sum("score").alias("score"))
    return survey.best_shift(t, []).select("di", "dj", F.round("score", 6).alias("score"))


@query(f"""WITH {_VOTE}, n AS (SELECT a.voter, b.di, b.dj, avg(b.score) AS score FROM (SELECT DISTINCT voter FROM samples) a JOIN score b ON abs(a.voter // 100 - b.voter // 100) <= 1 AND abs(a.voter % 100 - b.voter % 100) <= 1 GROUP BY ALL),
k AS (SELECT n.*, row_number() OVER (PARTITION BY n.voter ORDER BY n.di * n.di + n.dj * n.dj, n.di, n.dj) AS o FROM n JOIN (SELECT voter, max(score) AS top FROM n GROUP BY 1) t ON t.voter = n.voter WHERE n.score >= t.top - 1e-9), z AS (SELECT voter, score AS still FROM n WHERE di = 0 AND dj = 0)
SELECT k.voter, CASE WHEN k.score >= 0.4 AND k.score - still >= 0.02 THEN di ELSE 0 END AS di, CASE WHEN k.score >= 0.4 AND k.score - still >= 0.02 THEN dj ELSE 0 END AS dj FROM k JOIN z ON z.voter = k.voter WHERE o = 1""", "cells")
def neighbourhood_shifts(v: Views) -> DataFrame:
    """Each footprint's best move by the votes of it and its neighbours; trusted where it is good and better than none."""
    s = votes(v)
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    sent = s.select("voter", "di", "dj", "score", near.alias("d")).select((F.floor(F.col("voter") / 100) + F.col("d.i")).alias("a"), (F.col("voter") % 100 + F.col("d.j")).alias("b"), "di", "dj", "score")
    own = s.select("voter").distinct().select("voter", F.floor(F.col("voter") / 100).alias("a"), (F.col("voter") % 100).alias("b"))
    n = sent.join(own, ["a", "b"]).groupBy("voter", "di", "dj").agg(F.avg("score").alias("score"))
    best = survey.best_shift(n, ["voter"]).join(n.where("di = 0 AND dj = 0").select("voter", F.col("score").alias("still")), "voter")
    good = (F.col("score") >= 0.4) & (F.col("score") - F.col("still") >= 0.02)
    return best.select("voter", F.when(good, F.col("di")).otherwise(0).alias("di"), F.when(good, F.col("dj")).otherwise(0).alias("dj"))


@query("""WITH s AS (SELECT "row" // 4 * 100 + col // 5 AS footprint, "row", col FROM cells WHERE building), h AS (SELECT "row", col, depth * 3 AS height FROM cells WHERE NOT water),
e AS (SELECT footprint, count(*) AS n, count(height) / count(*) AS valid_share, count(*) FILTER (height >= 2.5) / greatest(count(height), 1) AS occupied, quantile_cont(height, 0.9) FILTER (height >= 2.5) AS roof FROM s LEFT JOIN h ON h."row" = s."row" AND h.col = s.col GROUP BY 1),
t AS (SELECT *, CASE WHEN valid_share < 0.5 THEN 'no_survey' WHEN occupied < 0.2 THEN 'absent' WHEN occupied < 0.5 THEN 'uncertain' ELSE 'present' END AS status FROM e)
SELECT footprint, n, round(valid_share, 6) AS valid_share, round(occupied, 6) AS occupied, status, round(CASE status WHEN 'present' THEN least(greatest(roof, 2.5), 250.0) WHEN 'absent' THEN 0.0 END, 6) AS height FROM t""", "cells")
def building_evidence(v: Views) -> DataFrame:
    s = v.cells.where("building").select((F.floor(F.col("row") / 4) * 100 + F.floor(F.col("col") / 5)).alias("footprint"), "row", "col")
    e = survey.roof_evidence(s, v.cells.where("NOT water").select("row", "col", (F.col("depth") * 3).alias("height")), "footprint")
    return e.select("footprint", "n", F.round("valid_share", 6).alias("valid_share"), F.round("occupied", 6).alias("occupied"), "status", F.round("height", 6).alias("height"))


@query("""WITH RECURSIVE r AS (SELECT CAST(depth - 0.8 AS DOUBLE) AS rho FROM cells), b AS (SELECT CAST(sum(rho * 0 + 0.3) AS DOUBLE) AS budget, CAST(list(rho) AS DOUBLE[]) AS v FROM r),
s(k, lo, hi) AS (SELECT 0, CAST(-50 AS DOUBLE), CAST(50 AS DOUBLE) UNION ALL SELECT k + 1, CASE WHEN t < budget THEN (lo + hi) / 2 ELSE lo END, CASE WHEN t < budget THEN hi ELSE (lo + hi) / 2 END FROM (SELECT k, lo, hi, budget, list_sum(list_transform(v, lambda x: least(greatest(x + (lo + hi) / 2, 0), 1))) AS t FROM s, b WHERE k < 60))
SELECT round((lo + hi) / 2, 6) AS shift FROM s WHERE k = 60""", "cells")
def design_budget(v: Views) -> DataFrame:
    """The shift that makes a design's held values meet its budget of 0.3 cells per cell."""
    rho = v.cells.select((F.col("depth") - 0.8).alias("rho"))
    s = survey.budget_shift(rho, "rho", float(rho.agg(F.sum(F.col("rho") * 0 + 0.3)).first()[0] or 0.0))
    return v.spark.createDataFrame([(None if s is None else round(s, 6),)], "shift double")


@query("""SELECT "row" // 4 AS "row", col // 4 AS col, round(avg(CASE WHEN NOT water THEN dem END), 6) AS dem, CAST(round(avg(band * 60.0)) AS BIGINT) AS red, CAST(round(avg(infil * 200.0)) AS BIGINT) AS green FROM cells GROUP BY 1, 2""", "cells")
def downsampled_survey(v: Views) -> DataFrame:
    """Elevation (cells without data left out) and colours by blocks of 4 x 4."""
    return v.cells.groupBy(F.floor(F.col("row") / 4).alias("row"), F.floor(F.col("col") / 4).alias("col")).agg(
        F.round(F.avg(F.when(~F.col("water"), F.col("dem"))), 6).alias("dem"), F.round(F.avg(F.col("band") * 60.0)).cast("long").alias("red"), F.round(F.avg(F.col("infil") * 200.0)).cast("long").alias("green")
    )


@query("""SELECT round(max(depth) FILTER (pow("row" - 20, 2) + pow(col - 25, 2) <= 225), 6) AS native_max, round(max(depth), 6) AS top, round(quantile_cont(depth, 0.95), 6) AS p95 FROM cells""", "cells")
def depth_grid_meta(v: Views) -> DataFrame:
    """Deepest water within the scene's disc and over all, and the 95th percentile."""
    near = (F.col("row") - 20) * (F.col("row") - 20) + (F.col("col") - 25) * (F.col("col") - 25) <= 225
    return v.cells.agg(F.round(F.max(F.when(near, F.col("depth"))), 6).alias("native_max"), F.round(F.max("depth"), 6).alias("top"), F.round(F.percentile("depth", 0.95), 6).alias("p95"))


@query("""WITH g AS (SELECT c.*, EXISTS (SELECT 1 FROM cells s WHERE s.band = 3 AND s.building AND pow(s."row" - c."row", 2) + pow(s.col - c.col, 2) <= 9) AS near FROM cells c), o AS (SELECT * FROM g WHERE near AND NOT building AND NOT water)
SELECT CAST(count(*) AS BIGINT) AS cells, CAST(count(*) FILTER (depth > 0.9) AS BIGINT) AS before, CAST(count(*) FILTER (depth * 0.8 > 0.9) AS BIGINT) AS after, round(100.0 * (count(*) FILTER (depth * 0.8 > 0.9) - count(*) FILTER (depth > 0.9)) / greatest(count(*) FILTER (depth > 0.9), 1), 6) AS change_pct FROM o""", "cells")
def change_near_edits(v: Views) -> DataFrame:
    """Flooded open cells within three cells of an edit, before and after."""
    c = v.cells
    near = survey.nearest_source(c, F.lit(True), F.expr("building AND band = 3")).where("d2 <= 9").select("row", "col")
    o = c.join(near, ["row", "col"], "left_semi").where("NOT building AND NOT water")
    b, a = F.count_if(F.col("depth") > 0.9), F.count_if(F.col("depth") * 0.8 > 0.9)
    return o.agg(F.count("*").alias("cells"), b.alias("before"), a.alias("after"), F.round(100.0 * (a - b) / F.greatest(b, F.lit(1)), 6).alias("change_pct"))


@query("""SELECT "row", col, round(depth, 6) AS depth FROM cells WHERE NOT building AND NOT water AND depth > 0.08 AND depth < 1.2""", "cells")
def hotspot_cells(v: Views) -> DataFrame:
    return v.cells.where("NOT building AND NOT water AND depth > 0.08 AND depth < 1.2").select("row", "col", F.round("depth", 6).alias("depth"))


@query("""WITH RECURSIVE h AS (SELECT "row" * 1000 + col AS id, "row", col, CAST(floor(depth * 3) AS BIGINT) AS band, depth * 3 AS height FROM cells WHERE depth * 3 >= 2.5),
l AS (SELECT a.id AS u, b.id AS v FROM h a JOIN h b ON a.band = b.band AND abs(a."row" - b."row") + abs(a.col - b.col) = 1), reach(u, v) AS (SELECT id, id FROM h UNION SELECT reach.u, l.v FROM reach JOIN l ON l.u = reach.v), c AS (SELECT u, min(v) AS region FROM reach GROUP BY 1)
SELECT region, CAST(count(*) AS BIGINT) AS area, round(median(height), 6) AS height FROM c JOIN h ON h.id = c.u GROUP BY region HAVING count(*) >= 2""", "cells")
def height_regions(v: Views) -> DataFrame:
    """Connected regions of one height band, of two cells at least: area and median height."""
    from cityweave.operators.network import components

    h = v.cells.where(F.col("depth") * 3 >= 2.5).select((F.col("row") * 1000 + F.col("col")).alias("id"), "row", "col", F.floor(F.col("depth") * 3).alias("band"), (F.col("depth") * 3).alias("height"))
    step = F.explode(F.array(F.struct(F.lit(1).alias("r"), F.lit(0).alias("c")), F.struct(F.lit(0).alias("r"), F.lit(1).alias("c")))).alias("s")
    sent = h.select(F.col("id").alias("u"), "band", (F.col("row") + F.lit(0)).alias("r0"), "col", step).select("u", "band", (F.col("r0") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    links = sent.join(h.select(F.col("id").alias("v"), "band", "row", "col"), ["band", "row", "col"]).select("u", "v")
    of = components(links)
    return h.join(of, h.id == of.node_id).groupBy(F.col("component").alias("region")).agg(F.count("*").alias("area"), F.round(F.median("height"), 6).alias("height"))
