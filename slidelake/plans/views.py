"""The driver's tables seen as points, regions, pixels, features and a cell index; the SQL of the same views."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import GEOMETRY


def _ring(*xy: tuple[float, float]) -> list[list[float]]:
    return [[float(x), float(y)] for x, y in [*xy, xy[0]]]


def _box(x0: float, y0: float, x1: float, y1: float) -> list[list[float]]:
    return _ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


#: Shapes of regions: number, name, class, polygons: a box with a hole, a notched and an overlapping shape, a triangle, two parts, and a line without area.
REGIONS = [
    (0, "donut", "tumour", [[_box(100, 100, 400, 400), _box(200, 200, 300, 300)]]),
    (1, "ell", "stroma", [[_ring((300, 300), (700, 300), (700, 450), (450, 450), (450, 700), (300, 700))]]),
    (2, "triangle", "tumour", [[_ring((600, 50), (950, 60), (780, 280))]]),
    (3, "pair", "immune", [[_box(50, 600, 200, 750)], [_box(800, 500, 950, 780), _box(850, 600, 900, 700)]]),
    (4, "wide", None, [[_box(0, 400, 1000, 500)]]),
    (5, "line", "stroma", []),
]


#: Regions repeat the shapes, the first of each as it stands, later ones smaller by a power of 2 and elsewhere.
MOVED = {"x": "(k * 137) % 900", "y": "(k * 211) % 700"}
SCALE = "power(2.0D, -1 - k % 5)"


def rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """roi_index, roi_id, name, class, geometry: a region a supplier, of very unequal sizes."""
    rows = json.dumps([{"shape": i, "label": n, "class": c, "shapes": g} for i, n, c, g in REGIONS])
    kind = f"array<struct<shape:int,label:string,class:string,shapes:{GEOMETRY}>>"
    shapes = spark.range(1).select(F.inline(F.from_json(F.lit(rows), kind)))
    k = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("k"))
    first = F.col("k") < len(REGIONS)
    scale = F.when(first, F.lit(1.0)).otherwise(F.expr(SCALE))
    dx, dy = (F.when(first, F.lit(0.0)).otherwise(F.expr(MOVED[v]).cast("double")) for v in "xy")
    move = lambda p: F.array(p[0] * scale + dx, p[1] * scale + dy)
    met = k.join(F.broadcast(shapes), F.col("k") % len(REGIONS) == F.col("shape"))
    name = F.when(first, F.col("label")).otherwise(F.concat("label", "k"))
    geometry = F.transform("shapes", lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, move)))
    return met.select(F.col("k").alias("roi_index"), name.alias("roi_id"), name.alias("name"), "class", geometry.alias("geometry"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey, first (whether it is of the first lot), geometry: an order as a box of whole px."""
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    x0, y0 = (key * 37) % 900, (key * 91) % 700
    x1, y1 = x0 + 20 + key % 180, y0 + 20 + key % 150
    at = lambda *p: F.array(*[c.cast("double") for c in p])
    ring = F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1), at(x0, y0))
    return o.select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") == "O").alias("first"), F.array(F.array(ring)).alias("geometry"))


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slide_id, width, height, levels (downsamples 1, 4, 16): a slide a nation."""
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("slide_id"), (F.lit(4000.0) + F.col("n_nationkey") * 250).alias("width"), (F.lit(3000.0) + F.col("n_nationkey") * 130).alias("height"))
    level = lambda i, d: F.struct(F.lit(i).alias("level"), F.ceil(F.col("width") / d).alias("width"), F.ceil(F.col("height") / d).alias("height"), F.lit(float(d)).alias("downsample"))
    return n.withColumn("levels", F.array(*[level(i, d) for i, d in enumerate((1, 4, 16))]))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, x, y, cell_class, marker."""
    e = read(spark, sf_dir, "events")
    x = ((F.col("event_id") * 7919) % 1000).cast("double") + 0.5
    y = ((F.col("user_id") * 104729 + F.col("event_id") * 31) % 800).cast("double") + 0.5
    return e.select(F.col("event_id").alias("point_id"), x.alias("x"), y.alias("y"), F.col("event_type").alias("cell_class"), F.col("value").alias("marker"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile_id, row, col, r, g, b: a line is a pixel of its supplier's tile."""
    li = read(spark, sf_dir, "lineitem")
    clamp = lambda c: F.least(F.lit(1.0), c)
    return li.select(
        F.col("l_suppkey").alias("tile_id"), (F.col("l_orderkey") % 64).cast("int").alias("row"), (F.col("l_partkey") % 64).cast("int").alias("col"),
        clamp(F.col("l_quantity") / 50).alias("r"), clamp(F.col("l_discount") * 10).alias("g"), clamp(F.col("l_tax") * 12.5).alias("b"),
    )


def grid_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with one value at each place of a tile: the mean of those that fall on it."""
    return pixels(spark, sf_dir).groupBy("tile_id", "row", "col").agg(*[F.round(F.avg(c), 9).alias(c) for c in "rgb"])


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slide_id, level, row, col, r, g, b: the tiles laid side by side on two slides."""
    at = grid_pixels(spark, sf_dir)
    t = F.col("tile_id")
    placed = at.select(F.concat(F.lit("s"), (t % 2).cast("string")).alias("slide_id"), F.lit(0).alias("level"), (F.col("row") + 64 * (t % 7)).cast("int").alias("row"), (F.col("col") + 64 * (t % 11)).cast("int").alias("col"), *"rgb")
    return placed.groupBy("slide_id", "level", "row", "col").agg(*[F.round(F.avg(c), 9).alias(c) for c in "rgb"])


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    raw = F.to_json(F.struct("x", "y"))
    return p.select(F.col("point_id").alias("row_id"), F.concat(F.lit("c"), "point_id").alias("cell_id"), "x", "y", (F.col("x") - 0.5).alias("xmin"), (F.col("y") - 0.5).alias("ymin"), (F.col("x") + 0.5).alias("xmax"), (F.col("y") + 0.5).alias("ymax"), raw.alias("raw_json"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    off = F.col("point_id") % 17 == 0
    return p.select(F.col("point_id").alias("row_id"), F.lit("m1").alias("model_id"), F.when(off, F.lit("abstained")).otherwise(F.lit("predicted")).alias("status"), F.col("cell_class").alias("label"), F.when(~off, (F.col("point_id") % 101) / F.lit(100.0)).alias("probability"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tiles of a class: key, class."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tile_key"), F.col("c_mktsegment").alias("class"))


def _number(v: float) -> str:
    return f"{v:.1f}"


def regions_sql() -> str:
    rows = ", ".join(f"({i}, '{n}', {'NULL' if c is None else repr(c)})" for i, n, c, _ in REGIONS)
    n = len(REGIONS)
    return f"""shape_names(shape, label, class) AS (VALUES {rows}),
  regions AS (SELECT s_suppkey::INT AS ri, CASE WHEN s_suppkey < {n} THEN label ELSE label || s_suppkey END AS roi_id, class FROM supplier JOIN shape_names ON shape = s_suppkey % {n})"""


def edges_sql() -> str:
    rows = []
    for i, _, _, polygons in REGIONS:
        for p, polygon in enumerate(polygons):
            for r, ring in enumerate(polygon):
                rows += [f"({i},{p},{r},{k},{_number(a[0])}::DOUBLE,{_number(a[1])}::DOUBLE,{_number(b[0])}::DOUBLE,{_number(b[1])}::DOUBLE)" for k, (a, b) in enumerate(zip(ring, ring[1:], strict=False))]
    n = len(REGIONS)
    moved = lambda v, e: f"{v}{e} * f + CASE WHEN k < {n} THEN 0 ELSE {MOVED[v]} END AS {v}{e}"
    return f"""shape_edges(shape, part, ring, e, x1, y1, x2, y2) AS (VALUES {', '.join(rows)}),
  placed AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey < {n} THEN 1.0::DOUBLE ELSE {SCALE.replace('2.0D', '2.0::DOUBLE').replace('k %', 's_suppkey %')} END AS f FROM supplier),
  edges AS (SELECT k::INT AS ri, part, ring, e AS k, {moved('x', 1)}, {moved('y', 1)}, {moved('x', 2)}, {moved('y', 2)} FROM placed JOIN shape_edges ON shape = k % {n})"""


POINTS = """points AS (SELECT event_id AS point_id, ((event_id * 7919) % 1000)::DOUBLE + 0.5 AS x,
    ((user_id * 104729 + event_id * 31) % 800)::DOUBLE + 0.5 AS y, event_type AS cell_class, value AS marker FROM events)"""
PIXELS = """pixels AS (SELECT l_suppkey AS tile_id, (l_orderkey % 64)::INT AS "row", (l_partkey % 64)::INT AS col,
    least(1.0::DOUBLE, l_quantity / 50) AS r, least(1.0::DOUBLE, l_discount * 10) AS g, least(1.0::DOUBLE, l_tax * 12.5) AS b FROM lineitem)"""
GRID = PIXELS + """, grid AS (SELECT tile_id, "row", col, round(avg(r), 9) AS r, round(avg(g), 9) AS g, round(avg(b), 9) AS b FROM pixels GROUP BY ALL)"""
LEVELS = GRID + """, levels AS (SELECT 's' || (tile_id % 2) AS slide_id, 0 AS level, "row" + 64 * (tile_id % 7) AS "row", col + 64 * (tile_id % 11) AS col, round(avg(r), 9) AS r, round(avg(g), 9) AS g, round(avg(b), 9) AS b FROM grid GROUP BY ALL)"""
HITS = """crossed AS (SELECT p.point_id, e.ri, e.part, e.ring,
    sum(CASE WHEN (e.y2 > p.y) <> (e.y1 > p.y) AND p.x < (e.x1 - e.x2) * (p.y - e.y2) / (e.y1 - e.y2) + e.x2 THEN 1 ELSE 0 END) % 2 AS odd
    FROM points p JOIN (SELECT ri, min(x1) AS xa, max(x1) AS xb, min(y1) AS ya, max(y1) AS yb FROM edges GROUP BY ri) b ON p.x BETWEEN xa AND xb AND p.y BETWEEN ya AND yb JOIN edges e ON e.ri = b.ri GROUP BY ALL),
  parts AS (SELECT point_id, ri, part, bool_or(ring = 0 AND odd = 1) AND NOT bool_or(ring > 0 AND odd = 1) AS inside FROM crossed GROUP BY ALL),
  hits AS (SELECT point_id, ri FROM parts GROUP BY ALL HAVING bool_or(inside)),
  firsts AS (SELECT point_id, min(ri) AS ri FROM hits GROUP BY ALL)"""
AREAS = """ring_areas AS (SELECT ri, part, ring, abs(sum(x1 * y2 - x2 * y1)) / 2 AS a FROM edges GROUP BY ALL),
  part_areas AS (SELECT ri, part, greatest(0.0, sum(CASE WHEN ring = 0 THEN a ELSE -a END)) AS a FROM ring_areas GROUP BY ALL),
  areas AS (SELECT r.ri, r.roi_id, r.class, coalesce(sum(p.a), 0.0) AS area_px FROM regions r LEFT JOIN part_areas p USING (ri) GROUP BY ALL)"""
CELLS = POINTS + """, cells AS (SELECT point_id AS row_id, 'c' || point_id AS cell_id, x, y, x - 0.5 AS xmin, y - 0.5 AS ymin, x + 0.5 AS xmax, y + 0.5 AS ymax FROM points),
  predictions AS (SELECT point_id AS row_id, CASE WHEN point_id % 17 = 0 THEN 'abstained' ELSE 'predicted' END AS status, cell_class AS label,
    CASE WHEN point_id % 17 <> 0 THEN (point_id % 101) / 100.0::DOUBLE END AS probability FROM points)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n  ".join(parts) + "\n"
