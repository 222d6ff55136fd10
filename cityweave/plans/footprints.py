"""Queries on geometries as well-known binary: written to GeoParquet from the tables, read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityweave.operators import records
from cityweave.plans.catalogue import rounded
from cityweave.plans.registry import Views, query
from cityweave.sources import geoparquet

# by the supplier's number: a polygon with a hole, two polygons, a point, a line; 200 suppliers cover a strip of 160
_RINGS = """base AS (SELECT poly, poly % 4 AS m, pos, cx, cy + poly // 200 * 160 AS cy, x, y + poly // 200 * 160 AS y FROM shapes),
rings AS (SELECT poly, m, 0 AS ring, 1 AS f, pos, x, y FROM base WHERE m <> 2 UNION ALL SELECT poly, m, 1, -1, pos, cx + (x - cx) / 4, cy + (y - cy) / 4 FROM base WHERE m = 0 UNION ALL SELECT poly, m, 2, 1, pos, x + 20, y FROM base WHERE m = 1),
ends AS (SELECT poly, m, f, pos, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS zx, first_value(y) OVER w AS zy FROM rings WINDOW w AS (PARTITION BY poly, ring ORDER BY pos)),
side AS (SELECT poly, m, f, x, y, coalesce(nx, zx) AS nx, coalesce(ny, zy) AS ny FROM ends WHERE m < 2 OR nx IS NOT NULL),
part AS (SELECT poly, m, sum(CASE WHEN m < 2 THEN f * (x * ny - nx * y) / 2 ELSE sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) END) AS w, sum(CASE WHEN m < 2 THEN f * (x * ny - nx * y) * (x + nx) / 6 ELSE sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) * (x + nx) / 2 END) AS sx, sum(CASE WHEN m < 2 THEN f * (x * ny - nx * y) * (y + ny) / 6 ELSE sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) * (y + ny) / 2 END) AS sy FROM side GROUP BY 1, 2),
feature AS (SELECT poly, CASE WHEN m < 2 THEN w ELSE 0 END AS area, sx / w AS x, sy / w AS y FROM part UNION ALL SELECT poly, 0, cx, cy FROM base WHERE m = 2 AND pos = 0)"""

# no building is equally far from two footprints
_DX, _DY = 0.50006103515625, 0.2500004768371582


def _written(v: Views) -> str:
    """The features as files: id, geometry, height, bbox; in order of their boxes, so that row groups can be passed over."""
    at = F.array_sort(F.collect_list(F.struct("pos", "x", "y")))
    s = v.shapes.withColumn("up", F.floor(F.col("poly") / 200) * 160).select("poly", "pos", "x", (F.col("y") + F.col("up")).alias("y"), "cx", (F.col("cy") + F.col("up")).alias("cy"))
    s = s.groupBy("poly", "cx", "cy").agg(at.alias("p"))
    m, cx, cy = F.col("poly") % 4, F.col("cx"), F.col("cy")

    def ring(part: int, number: int, scale: float = 1.0, move: float = 0.0, closed: bool = True):
        points = F.concat("p", F.slice("p", 1, 1)) if closed else F.col("p")
        along = lambda c, mid, by: F.transform(points, lambda e: mid + (e[c] - mid) * scale + by)
        return F.struct(F.lit(part).alias("part"), F.lit(number).alias("ring"), along("x", cx, move).alias("x"), along("y", cy, 0.0).alias("y"))

    point = F.struct(F.lit(0).alias("part"), F.lit(0).alias("ring"), F.array(cx).alias("x"), F.array(cy).alias("y"))
    rings = F.when(m == 0, F.array(ring(0, 0), ring(0, 1, 0.25))).when(m == 1, F.array(ring(0, 0), ring(1, 0, move=20.0))).when(m == 2, F.array(point)).otherwise(F.array(ring(0, 0, closed=False)))
    kind = F.when(m == 0, geoparquet.POLYGON).when(m == 1, geoparquet.POLYGONS).when(m == 2, geoparquet.POINT).otherwise(geoparquet.LINE)
    k = F.col("poly")
    height = F.when(k % 7 == 1, -1.0).when(k % 7 != 0, (k % 23 + 0.5).cast("double"))
    g = s.select(k.alias("id"), F.struct(kind.alias("kind"), rings.alias("rings")).cast(geoparquet.GEOMETRY).alias("g"), height.alias("height"))
    path = records.own_folder(v.spark, "footprints")
    g.select("id", geoparquet.encode(F.col("g")).alias("geometry"), "height", geoparquet.box(F.col("g")).alias("bbox")).repartitionByRange("bbox.ymin", "bbox.xmin").write.parquet(path)
    return path


@query(f"""WITH {_RINGS} SELECT poly AS id, round(area, 6) AS area, round(x, 6) AS x, round(y, 6) AS y FROM feature""", "shapes")
def footprint_measures(v: Views) -> DataFrame:
    """Area and centroid of polygons with holes, several polygons, lines and points, decoded from their bytes."""
    g = v.spark.read.parquet(_written(v)).select("id", geoparquet.measures(F.col("geometry")).alias("m"))
    return rounded(g.select("id", "m.area", "m.x", "m.y"))


@query(f"""WITH {_RINGS}, high AS (SELECT x, y, CAST(poly % 23 + 0.5 AS DOUBLE) AS height FROM feature WHERE poly % 7 > 1 AND x BETWEEN 20 AND 180 AND y BETWEEN 10 AND 1000000000),
b AS (SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_custkey * 37 % 200 AS DOUBLE) + {_DX} AS x, CAST(c_custkey * 91 % 160 + c_custkey // 1500 * 160 AS DOUBLE) + {_DY} AS y, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 40 + 3.0 END AS own FROM customer),
near AS (SELECT id, arg_min(height, d) AS height FROM (SELECT b.id, high.height, sqrt((b.x - high.x) * (b.x - high.x) + (b.y - high.y) * (b.y - high.y)) AS d FROM b JOIN high ON abs(b.x - high.x) < 30 AND abs(b.y - high.y) < 30) WHERE d < 30 GROUP BY id)
SELECT b.id, CAST(coalesce(own, near.height, 9.0) AS DOUBLE) AS height FROM b LEFT JOIN near ON near.id = b.id""", "shapes")
def borrowed_heights(v: Views) -> DataFrame:
    """Buildings without a height take that of the nearest footprint, read from files within a box."""
    k = F.col("c_custkey")
    up = F.floor(k / 1500) * 160
    b = v.customer.select(k.cast("long").alias("id"), ((k * 37 % 200).cast("double") + _DX).alias("x"), ((k * 91 % 160 + up).cast("double") + _DY).alias("y"), F.when(k % 3 == 0, (k % 40 + 3.0).cast("double")).alias("own"))
    others = geoparquet.heights(v.spark, [_written(v)], (20.0, 10.0, 180.0, 1e9)).withColumnsRenamed({"x": "px", "y": "py"})
    return records.borrowed_height(b, others, "id", F.col("own"), 9.0)


@query(f"""WITH {_RINGS} SELECT c_name AS name, lower(c_mktsegment) AS category, CAST(c_custkey % 100 / 100.0 AS DOUBLE) AS confidence, CAST(c_custkey * 37 % 200 AS DOUBLE) AS x, CAST(c_custkey * 91 % 160 AS DOUBLE) AS y FROM customer WHERE c_custkey % 100 >= 75
UNION ALL SELECT 'Residential Building', 'residential', 1.0, round(x, 6), round(y, 6) FROM feature""", "shapes")
def places_and_buildings(v: Views) -> DataFrame:
    """Places of enough confidence, and every footprint as one more."""
    k = F.col("c_custkey")
    places = v.customer.where(k % 100 >= 75).select(F.col("c_name").alias("name"), F.array(F.lower("c_mktsegment")).alias("categories"), (k % 100 / 100.0).alias("confidence"), (k * 37 % 200).cast("double").alias("x"), (k * 91 % 160).cast("double").alias("y"))
    centroids = v.spark.read.parquet(_written(v)).select(geoparquet.measures(F.col("geometry")).alias("m")).select("m.x", "m.y")
    all_ = records.with_buildings(places, centroids)
    return all_.select("name", F.get("categories", F.lit(0)).alias("category"), "confidence", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
