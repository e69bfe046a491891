"""

Doubles are rounded to 6 places on both sides. Queries without SQL are tested against brute force in tests/.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalars as S
from ..operators import boxindex, candidates, cellindex, experiment, masks, models, overlay, proximity, regions, review, scope, slides, svm, tiles
from ..operators import pixels as P
from ..sources import rasters, tables
from ..sources.work import work_path
from ..streaming import patches
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
BOX = (100.0, 100.0, 600.0, 500.0)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, whole-number columns as long."""
    kinds = dict(df.dtypes)
    pick = lambda c: F.round(c, places) if kinds[c] in ("double", "float") else F.col(c).cast("long") if kinds[c] in ("int", "smallint", "tinyint") else F.col(c)
    return df.select(*[pick(c).alias(c) for c in df.columns])


# points and regions


@query(V.with_(V.POINTS, V.regions_sql(), V.edges_sql(), V.HITS) + """SELECT p.point_id, f.ri::BIGINT AS roi_index, r.roi_id, r.class FROM points p LEFT JOIN firsts f USING (point_id) LEFT JOIN regions r ON r.ri = f.ri""")
def e1_associate_annotations(spark, sf):
    return rounded(regions.associate(V.points(spark, sf).select("point_id", "x", "y"), V.rois(spark, sf)).drop("x", "y"))


@query(V.with_(V.POINTS, V.regions_sql(), V.edges_sql(), V.HITS) + """SELECT p.point_id, coalesce(r.class, r.roi_id, 'Unassigned') AS annotation FROM points p LEFT JOIN firsts f USING (point_id) LEFT JOIN regions r ON r.ri = f.ri""")
def e2_annotate_cells(spark, sf):
    return regions.annotate(V.points(spark, sf).select("point_id", "x", "y"), V.rois(spark, sf)).drop("x", "y")


@query(V.with_(V.POINTS, V.regions_sql(), V.edges_sql(), V.HITS) + "SELECT p.point_id, " + ", ".join(f"(coalesce(f.ri, -1) = {i})::BIGINT AS {n}" for i, n, _, _ in V.REGIONS) + " FROM points p LEFT JOIN firsts f USING (point_id)")
def e9_association_matrix(spark, sf):
    met = regions.associate(V.points(spark, sf).select("point_id", "x", "y"), V.rois(spark, sf))
    return rounded(regions.association_matrix(met, "point_id", [n for _, n, _, _ in V.REGIONS]))


@query(V.with_(V.POINTS, V.regions_sql(), V.edges_sql(), V.HITS, V.AREAS) + """SELECT a.ri::BIGINT AS roi_index, a.roi_id, coalesce(a.class, 'unclassified') AS class, round(area_px, 6) AS area_px,
  round(area_px * 0.25 / 1e6, 6) AS area_mm2, count(h.point_id) AS n, round(count(h.point_id) / area_px, 6) AS density_px, round(count(h.point_id) / (area_px * 0.25 / 1e6), 6) AS density_mm2
  FROM areas a LEFT JOIN hits h ON h.ri = a.ri WHERE area_px > 0 GROUP BY a.ri, a.roi_id, a.class, area_px""")
def f1_cell_density(spark, sf):
    return rounded(regions.cell_density(V.points(spark, sf), V.rois(spark, sf), 0.5))


@query(V.with_(V.POINTS, V.regions_sql(), V.edges_sql(), V.HITS, V.AREAS) + """, per AS (SELECT coalesce(a.class, 'unclassified') AS class, a.ri, area_px, count(h.point_id) AS n FROM areas a LEFT JOIN hits h ON h.ri = a.ri GROUP BY ALL)
  SELECT class, count(*) AS n_rois, round(sum(area_px), 6) AS area_px, round(sum(area_px * 0.25 / 1e6), 6) AS area_mm2, round(sum(area_px) * 100 / sum(sum(area_px)) OVER (), 6) AS area_percent,
  sum(CASE WHEN area_px > 0 THEN n ELSE 0 END)::BIGINT AS n_cells, round(sum(CASE WHEN area_px > 0 THEN n ELSE 0 END) / nullif(sum(area_px), 0), 6) AS density_px FROM per GROUP BY class""")
def f2_summarise_rois(spark, sf):
    return rounded(regions.summarise_rois(V.rois(spark, sf), V.points(spark, sf), 0.5))


@query(V.with_(V.regions_sql(), V.edges_sql(), V.AREAS) + """, shells AS (SELECT ri, part, sum(x1 * y2 - x2 * y1) AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS mx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS my FROM edges WHERE ring = 0 GROUP BY ALL),
  centres AS (SELECT ri, sum(mx * sign(a)) / (3 * sum(abs(a))) AS cx, sum(my * sign(a)) / (3 * sum(abs(a))) AS cy FROM shells GROUP BY ri),
  boxes AS (SELECT ri, min(x1) AS xmin, min(y1) AS ymin, max(x1) AS xmax, max(y1) AS ymax FROM edges GROUP BY ri)
  SELECT ri::BIGINT AS roi_index, roi_id, coalesce(class, 'unclassified') AS class, round(area_px, 6) AS area_px, round(area_px * 0.25, 6) AS area_um2, round(area_px * 0.25 / 1e6, 6) AS area_mm2,
  round(area_px * 100 / sum(area_px) OVER (), 6) AS area_percent, round(cx, 6) AS cx, round(cy, 6) AS cy, xmin, ymin, xmax, ymax FROM areas LEFT JOIN centres USING (ri) LEFT JOIN boxes USING (ri)""")
def n12_roi_measurements(spark, sf):
    return rounded(regions.roi_table(V.rois(spark, sf), 0.5))


_segment = """segs AS (SELECT p.point_id, e.ri, least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((p.x - e.x1) * (e.x2 - e.x1) + (p.y - e.y1) * (e.y2 - e.y1)) / nullif((e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1), 0))) AS t,
    p.x, p.y, e.x1, e.y1, e.x2, e.y2 FROM points p CROSS JOIN edges e),
  near AS (SELECT point_id, ri, min(sqrt((x - (x1 + t * (x2 - x1))) * (x - (x1 + t * (x2 - x1))) + (y - (y1 + t * (y2 - y1))) * (y - (y1 + t * (y2 - y1))))) AS d FROM segs GROUP BY ALL)"""


@query(V.with_(V.POINTS, V.regions_sql(), V.edges_sql(), V.HITS, _segment) + """, best AS (SELECT point_id, min(d) AS d FROM near GROUP BY point_id)
  SELECT b.point_id, r.ri::BIGINT AS roi_index, r.roi_id, h.ri IS NOT NULL AS inside, round(b.d, 6) AS distance_px, round(b.d * 0.5, 6) AS distance_um
  FROM best b JOIN (SELECT n.point_id, min(n.ri) AS ri FROM near n JOIN best b ON b.point_id = n.point_id AND n.d = b.d GROUP BY 1) f USING (point_id) JOIN regions r ON r.ri = f.ri LEFT JOIN hits h ON h.point_id = b.point_id AND h.ri = f.ri""")
def e4_cells_to_roi(spark, sf):
    return rounded(regions.cells_to_roi(V.points(spark, sf), V.rois(spark, sf), "point_id", 0.5))


@query(V.with_(V.regions_sql(), V.edges_sql()) + """, points AS (SELECT DISTINCT ri * 1000000 + part * 10000 + ring * 100 + k AS point_id, ri AS pri, x1 AS x, y1 AS y FROM edges),
  """ + _segment + """, pairs AS (SELECT least(p.pri, n.ri) AS i, greatest(p.pri, n.ri) AS j, min(d) AS d FROM near n JOIN points p USING (point_id) WHERE p.pri <> n.ri GROUP BY ALL)
  SELECT i::BIGINT AS i, j::BIGINT AS j, a.roi_id AS roi_a, b.roi_id AS roi_b, round(d, 6) AS distance_px FROM pairs JOIN regions a ON a.ri = i JOIN regions b ON b.ri = j""")
def e5_roi_distance(spark, sf):
    # a distance is rounded once for all regions that share it
    return regions.roi_distance(V.rois(spark, sf), places=6).select(*[F.col(k).cast("long").alias(k) for k in "ij"], "roi_a", "roi_b", "distance_px")


@query(V.with_(V.POINTS, V.regions_sql(), V.edges_sql(), V.HITS) + """, met AS (SELECT p.*, coalesce(r.class, 'unassigned') AS class FROM points p LEFT JOIN firsts f USING (point_id) LEFT JOIN regions r ON r.ri = f.ri),
  names AS (SELECT DISTINCT class FROM regions WHERE class IS NOT NULL UNION SELECT 'unassigned')
  SELECT n.class, count(m.point_id) AS n, round(avg(m.marker), 6) AS mean_marker FROM names n LEFT JOIN met m USING (class) GROUP BY n.class""")
def n11_class_counts(spark, sf):
    met = regions.associate(V.points(spark, sf), V.rois(spark, sf))
    return rounded(regions.class_counts(met, V.rois(spark, sf).filter("class IS NOT NULL")))


@query(V.with_(V.POINTS, V.regions_sql(), V.edges_sql(), V.HITS, V.AREAS) + """SELECT a.ri::BIGINT AS roi_index, a.roi_id, coalesce(a.class, 'unclassified') AS class, round(area_px, 6) AS area_px, round(area_px * 0.25, 6) AS area_um2,
  count(f.point_id) AS n_cells, round(count(f.point_id) / nullif(area_px, 0), 6) AS density_px FROM areas a LEFT JOIN firsts f ON f.ri = a.ri GROUP BY a.ri, a.roi_id, a.class, area_px""")
def f7_cell_counts(spark, sf):
    met = regions.associate(V.points(spark, sf), V.rois(spark, sf))
    return rounded(regions.roi_counts(met, V.rois(spark, sf), 0.5))


@query(V.with_(V.POINTS, V.regions_sql(), V.edges_sql(), V.HITS) + """SELECT r.roi_id, p.cell_class, count(*) AS n_cells, round(avg(marker), 10) AS marker_mean, round(quantile_cont(marker, 0.5), 10) AS marker_median,
  count(*) FILTER (marker >= 50) AS marker_positive, round(count(*) FILTER (marker >= 50) / count(marker), 10) AS marker_positive_fraction FROM points p LEFT JOIN firsts f USING (point_id) LEFT JOIN regions r ON r.ri = f.ri GROUP BY ALL""")
def n10_group_summary(spark, sf):
    met = regions.associate(V.points(spark, sf), V.rois(spark, sf))
    return rounded(regions.group_summary(met, ["roi_id", "cell_class"], ["marker"], 50.0), 10)


_inside = """CASE WHEN x < 320 AND y < 320 THEN 1 ELSE 0 END"""


@query("""WITH g AS (SELECT p_partkey, ((p_partkey * 25) % 500)::DOUBLE AS x, ((p_partkey * 45) % 495)::DOUBLE AS y FROM part)
  SELECT p_partkey, x, y, 20.0::DOUBLE AS width, 20.0::DOUBLE AS height, x >= 100 AND x + 20 <= 400 AND y >= 100 AND y + 20 <= 400 AND NOT (x < 300 AND x + 20 > 200 AND y < 300 AND y + 20 > 200) AS inside FROM g""")
def c10_footprints(spark, sf):
    key = F.col("p_partkey")
    grid = V.read(spark, sf, "part").select(key, ((key * 25) % 500).cast("double").alias("x"), ((key * 45) % 495).cast("double").alias("y"), F.lit(20.0).alias("width"), F.lit(20.0).alias("height"))
    both = grid.crossJoin(F.broadcast(V.rois(spark, sf).filter("roi_index = 0").select("geometry")))
    return regions.footprints_in_roi(both, F.col("geometry")).drop("geometry")


# transforms


@query(V.with_(V.regions_sql(), V.edges_sql()) + """, moved AS (SELECT ri, 1000 - y1 + 5 AS x, x1 + 7 AS y FROM edges)
  SELECT ri::BIGINT AS roi_index, round(min(x), 6) AS xmin, round(min(y), 6) AS ymin, round(max(x), 6) AS xmax, round(max(y), 6) AS ymax FROM moved GROUP BY ri""")
def d4_transform_rois(spark, sf):
    m = G.matmul(G.translation(5, 7), G.orientation(800, 1000, "none", 90))
    moved = V.rois(spark, sf).filter(F.size("geometry") > 0).withColumn("geometry", G.affine(F.col("geometry"), m))
    return rounded(regions.with_bbox(moved).select("roi_index", "xmin", "ymin", "xmax", "ymax"))


@query(V.with_(V.POINTS) + """SELECT cell_class, round(max(sqrt(((x - 500) * 0.5) * ((x - 500) * 0.5) + ((y - 400) * 0.25) * ((y - 400) * 0.25))), 6) AS farthest_um FROM points GROUP BY cell_class""")
def d12_measure_distance(spark, sf):
    return rounded(V.points(spark, sf).groupBy("cell_class").agg(F.max(G.distance_um(F.col("x") - 500, F.col("y") - 400, 0.5, 0.25)).alias("farthest_um")))


@query("""SELECT n_nationkey::BIGINT AS n_nationkey, 'tissue%201' || '::' || replace(n_name, ' ', '%20') || '::' || n_regionkey AS id FROM nation""")
def n66_namespace_ids(spark, sf):
    n = V.read(spark, sf, "nation")
    return rounded(n.select("n_nationkey", S.namespace_id(F.lit("tissue 1"), F.col("n_name"), F.col("n_regionkey").cast("string")).alias("id")))


# neighbours and proximity


@query(V.with_(V.POINTS) + """SELECT a.point_id, round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS distance_px,
  arg_min(b.point_id, struct_pack(d := (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), t := b.point_id)) AS nearest_id,
  round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) * 0.5, 6) AS distance_um FROM points a JOIN points b ON a.point_id <> b.point_id GROUP BY a.point_id""")
def e3_nearest_cells(spark, sf):
    return rounded(proximity.nearest_cells(V.points(spark, sf), "point_id", 0.5))


@query(V.with_(V.POINTS, V.regions_sql(), V.edges_sql(), V.HITS) + """, q AS (SELECT p.*, r.roi_id FROM points p JOIN firsts f USING (point_id) JOIN regions r ON r.ri = f.ri),
  h AS (SELECT p.point_id, min(h.ri) AS ri FROM points p JOIN hits h USING (point_id) WHERE h.ri IN (0) GROUP BY 1), t AS (SELECT p.point_id, min(h.ri) AS ri FROM points p JOIN hits h USING (point_id) WHERE h.ri IN (2, 3) GROUP BY 1),
  a AS (SELECT p.*, r.roi_id FROM points p JOIN h USING (point_id) JOIN regions r ON r.ri = h.ri), b AS (SELECT p.*, r.roi_id FROM points p JOIN t USING (point_id) JOIN regions r ON r.ri = t.ri),
  best AS (SELECT a.point_id, arg_min(b.point_id, struct_pack(d := sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), t := b.point_id)) AS nearest_id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM a CROSS JOIN b GROUP BY 1)
  SELECT a.point_id, a.roi_id AS query_roi, a.x, a.y, best.nearest_id, round(d, 6) AS distance_px, b.roi_id AS target_roi, round(d * 0.375, 6) AS distance_um FROM a JOIN best USING (point_id) JOIN b ON b.point_id = best.nearest_id""")
def n20_proximity(spark, sf):
    out = proximity.proximity(V.points(spark, sf).select("point_id", "x", "y"), V.rois(spark, sf), ["donut"], ["triangle", "pair"], "point_id", (0.5, 0.25))
    return rounded(out)


@query("""WITH r AS (SELECT event_id, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rk, count(*) OVER () AS n FROM events)
  SELECT event_id, round((rk - 1) / (n - 1), 6) AS position, greatest(1, least(101, floor(100 * ((rk - 1) / (n - 1)))::BIGINT + 1)) AS colour_index FROM r""")
def n21_quantile_position(spark, sf):
    return rounded(proximity.quantile_position(V.read(spark, sf, "events").select("event_id", "value"), "value").drop("value"))


@query("""WITH b AS (SELECT list_distinct(quantile_cont(o_totalprice, [k / 10.0 for k in range(0, 11)])) AS l FROM orders), s AS (SELECT list_sort(l) AS l FROM b),
  m AS (SELECT o.*, greatest(1, len(list_filter(l, lambda q: q < o_totalprice))) AS bin, l FROM orders o, s)
  SELECT bin::BIGINT AS bin, round((l[bin] + l[bin + 1]) / 2, 6) AS mid, count(*) AS n, round(avg(o_custkey), 6) AS o_custkey FROM m GROUP BY ALL""")
def n22_binned_profile(spark, sf):
    return rounded(proximity.binned(V.read(spark, sf, "orders").select("o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey")), "o_totalprice", ["o_custkey"], 0.1))


_features = """long AS (SELECT vec_id, 'f' || (i - 1) AS feature, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) t(i)), dist AS (SELECT vec_id, ((vec_id * 37) % 101) / 100.0::DOUBLE AS d FROM embeddings)"""


def _long(spark, sf):
    e = V.read(spark, sf, "embeddings")
    return proximity.long_features(e, "vec_id", "embedding"), e.select("vec_id", (((F.col("vec_id") * 37) % 101) / 100.0).alias("d"))


@query(f"WITH {_features} SELECT feature, count(*) AS n, round(corr(value, d), 6) AS r FROM long JOIN dist USING (vec_id) GROUP BY feature")
def n23_correlations(spark, sf):
    return rounded(proximity.correlations(*_long(spark, sf), "vec_id", "d").select("feature", "n", "r"))


@query(f"""WITH {_features}, ranked AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS v,
  rank() OVER (PARTITION BY feature ORDER BY d) + (count(*) OVER (PARTITION BY feature, d) - 1) / 2.0 AS d FROM long JOIN dist USING (vec_id)) SELECT feature, count(*) AS n, round(corr(v, d), 6) AS r FROM ranked GROUP BY feature""")
def n23_spearman(spark, sf):
    return rounded(proximity.correlations(*_long(spark, sf), "vec_id", "d", "spearman").select("feature", "n", "r"))


@query(f"WITH {_features}, c AS (SELECT feature, count(*) AS n, corr(value, d) AS r FROM long JOIN dist USING (vec_id) GROUP BY feature) SELECT feature, n, round(r, 6) AS r, row_number() OVER (ORDER BY abs(r) DESC, feature) AS rank FROM c")
def n26_trajectory(spark, sf):
    """p falls with the strength of r, as all features have the same number of rows; tests hold p itself."""
    long, d = _long(spark, sf)
    return rounded(proximity.trajectory(long, d.select("vec_id", F.col("d").alias("distance_fraction"), F.col("vec_id").alias("row")), "vec_id").select("feature", "n", "r", "rank"))


@query(f"WITH {_features} SELECT feature, count(*) AS n, round(var_samp(value), 6) AS variance FROM long GROUP BY feature ORDER BY var_samp(value) DESC, feature LIMIT 10")
def n24_top_variance(spark, sf):
    return rounded(proximity.top_variance(_long(spark, sf)[0], 10))


# tiles


_slides = "slides AS (SELECT 'n' || n_nationkey AS slide_id, 4000.0::DOUBLE + n_nationkey * 250 AS width, 3000.0::DOUBLE + n_nationkey * 130 AS height FROM nation)"


@query(V.with_(_slides) + """SELECT slide_id, printf('L1_R%05d_C%05d', r + 1, c + 1) AS tile_id, c * 1920 AS x, r * 1920 AS y, least(512, ceil(width / 4 - c * 480))::BIGINT AS width, least(512, ceil(height / 4 - r * 480))::BIGINT AS height, 1::BIGINT AS level, r + 1 AS row, c + 1 AS col, 4.0::DOUBLE AS downsample
  FROM slides, range(0, 10) a(r), range(0, 10) b(c) WHERE r * 480 < height / 4 AND c * 480 < width / 4""")
def g1_tile_grid(spark, sf):
    return rounded(tiles.tile_grid(V.slides(spark, sf), 512, 32, 1, True))


@query(V.with_(V.POINTS) + """, t AS (SELECT point_id, round_even(x - 32, 0) AS x, round_even(y - 32, 0) AS y FROM points)
  SELECT point_id, greatest(x, 0) AS x, greatest(y, 0) AS y, least(x + 64, 1000) - greatest(x, 0) AS width, least(y + 64, 800) - greatest(y, 0) AS height FROM t""")
def g2_grid_from_coords(spark, sf):
    return rounded(tiles.grid_from_coords(V.points(spark, sf).select("point_id", "x", "y"), 1000, 800, 64, "center", "trim"))


_order = "md5('7:' || c_custkey)"


@query(f"""WITH r AS (SELECT c_custkey AS tile_key, c_mktsegment AS class, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_order}, c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
  SELECT tile_key, class FROM r WHERE k <= (SELECT min(n) FROM r)""")
def n41_balance(spark, sf):
    return tiles.balance(V.tiles(spark, sf), "tile_key", seed=7)


@query(f"""WITH r AS (SELECT c_custkey AS tile_key, c_mktsegment AS class, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_order}, c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
  e AS (SELECT *, greatest(n - 3, 0) * (0.7::DOUBLE / 1.0) AS a, greatest(n - 3, 0) * (0.2::DOUBLE / 1.0) AS b, greatest(n - 3, 0) * (0.1::DOUBLE / 1.0) AS c FROM r),
  g AS (SELECT *, round(a - floor(a), 9) AS ra, round(b - floor(b), 9) AS rb, round(c - floor(c), 9) AS rc, n - 3 - floor(a) - floor(b) - floor(c) AS s FROM e),
  f AS (SELECT *, 1 + floor(a) + (s >= 1 + (rb > ra)::INT + (rc > ra)::INT)::INT AS na, 1 + floor(b) + (s >= 1 + (ra >= rb)::INT + (rc > rb)::INT)::INT AS nb FROM g)
  SELECT tile_key, class, CASE WHEN k <= na THEN 'train' WHEN k <= na + nb THEN 'val' ELSE 'test' END AS split FROM f""")
def n42_split(spark, sf):
    return tiles.split(V.tiles(spark, sf), "tile_key", {"train": 0.7, "val": 0.2, "test": 0.1}, seed=7)


@query("""WITH m AS (SELECT s_suppkey // 10 AS "row", s_suppkey % 10 AS col, s_acctbal > 4000 AS tissue FROM supplier), t AS (SELECT p_partkey AS tile_id, (p_partkey * 64) % 1000 AS x, (p_partkey * 23) % (SELECT 20 * count(*) FROM supplier) AS y FROM part)
  SELECT tile_id, round(avg(tissue::INT::DOUBLE), 6) AS tissue_fraction FROM t LEFT JOIN m ON m.col >= floor(x / 200.0) AND m.col <= ceil((x + 512) / 200.0) - 1 AND m."row" >= floor(y / 200.0) AND m."row" <= ceil((y + 512) / 200.0) - 1 GROUP BY tile_id""")
def n43_tissue_fraction(spark, sf):
    s = V.read(spark, sf, "supplier")
    k, part = F.col("s_suppkey"), F.col("p_partkey")
    mask = s.select(F.floor(k / 10).cast("int").alias("row"), (k % 10).cast("int").alias("col"), (F.col("s_acctbal") > 4000).alias("tissue"))
    grid = V.read(spark, sf, "part").select(part.alias("tile_id"), ((part * 64) % 1000).alias("x"), ((part * 23) % (20 * s.count())).alias("y"), F.lit(512).alias("width"), F.lit(512).alias("height"), F.lit(1.0).alias("downsample"))
    return rounded(tiles.tissue_fraction(grid, mask, 200.0).select("tile_id", "tissue_fraction"))


@query(V.with_(V.POINTS) + """, t AS (SELECT cell_class AS tissue_id, floor(x / 112) * 112 AS x, floor(y / 112) * 112 AS y, count(*) AS n FROM points GROUP BY ALL) SELECT tissue_id, x, y, 112.0::DOUBLE AS width, 112.0::DOUBLE AS height, n FROM t WHERE x + 112 <= 1000 AND y + 112 <= 800""")
def f8_review_plan(spark, sf):
    p = V.points(spark, sf).select(F.col("point_id").alias("id"), F.col("cell_class").alias("tissue_id"), "x", "y")
    images = p.select("tissue_id").distinct().select("tissue_id", F.lit(1000.0).alias("width"), F.lit(800.0).alias("height"), F.lit(0.5).alias("mpp_x"))
    return rounded(tiles.review_plan(p, images, 112.0, max_tiles=100_000).select("tissue_id", "x", "y", "width", "height", "n"))


@query(V.with_(_slides) + """, l AS (SELECT slide_id, k AS level, power(2.0::DOUBLE, m - k) AS d, ceil(width / power(2.0::DOUBLE, m - k)) AS lw, ceil(height / power(2.0::DOUBLE, m - k)) AS lh FROM (SELECT *, ceil(log2(greatest(width, height)))::INT AS m FROM slides), range(0, 20) t(k) WHERE k <= m)
  SELECT slide_id, level, count(*) AS n, round(sum(d), 6) AS d, max(tx) AS tx, max(ty) AS ty FROM l, range(0, 24) a(tx), range(0, 24) b(ty) WHERE tx < greatest(ceil(lw / 512), 1) AND ty < greatest(ceil(lh / 512), 1) GROUP BY slide_id, level""")
def n69_deep_zoom(spark, sf):
    return rounded(tiles.deep_zoom(V.slides(spark, sf)).groupBy("slide_id", "level").agg(F.count("*").alias("n"), F.sum("downsample").alias("d"), F.max("tx").alias("tx"), F.max("ty").alias("ty")))


# pixels

_hue = "(r + g + b) / 3 AS v, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END AS s"


@query(V.with_(V.PIXELS) + f""", h AS (SELECT *, {_hue} FROM pixels), a AS (SELECT tile_id, count(*) AS n, avg((v >= 0.86 AND s <= 0.12)::INT::DOUBLE) AS w, avg(v) AS v, avg(s) AS s FROM h GROUP BY tile_id)
  SELECT tile_id, n, round(w, 6) AS whitespace_fraction, round(v, 6) AS brightness_mean, round(s, 6) AS saturation_mean, (w >= 0.75 OR (v >= 0.90 AND s <= 0.10)) AS whitespace FROM a""")
def h3_whitespace(spark, sf):
    return rounded(P.whitespace(V.pixels(spark, sf)))


_grey = "(0.299 * r + 0.587 * g + 0.114 * b)::DOUBLE AS v"


@query(V.with_(V.GRID) + f""", h AS (SELECT *, {_grey}, {_hue.replace(" AS v", " AS w")}, list_sort([r, g, b]) AS o FROM grid),
  e AS (SELECT *, abs(lead(v) OVER (PARTITION BY tile_id, "row" ORDER BY col) - v) AS dx, abs(lead(v) OVER (PARTITION BY tile_id, col ORDER BY "row") - v) AS dy FROM h)
  SELECT tile_id, count(*) AS n, round(avg(w), 6) AS mean, round(coalesce(stddev_samp(w), 0), 6) AS sd, round(avg((w <= 0.18)::INT::DOUBLE), 6) AS dark_fraction, round(avg((w >= 0.92)::INT::DOUBLE), 6) AS bright_fraction,
  round(avg((o[3] >= 1.25::DOUBLE * o[2] AND s >= 0.45)::INT::DOUBLE), 6) AS pen_fraction, round(avg((w <= 0.28 AND s >= 0.25)::INT::DOUBLE), 6) AS fold_fraction, round(coalesce((coalesce(sum(dx), 0) + coalesce(sum(dy), 0)) / nullif(count(dx) + count(dy), 0), 0), 6) AS edge_strength FROM e GROUP BY tile_id""")
def h5_artifacts(spark, sf):
    return rounded(P.artifacts(V.grid_pixels(spark, sf)).select("tile_id", "n", "mean", "sd", "dark_fraction", "bright_fraction", "pen_fraction", "fold_fraction", "edge_strength"))


@query(V.with_(V.GRID) + f""", h AS (SELECT tile_id, "row" AS y, col AS x, {_grey} FROM grid),
  s AS (SELECT c.tile_id, c.y, c.x, c.v, count(*) AS k, sum(n.v * CASE WHEN n.x = c.x AND n.y = c.y THEN -4 WHEN n.x = c.x OR n.y = c.y THEN 1 ELSE 0 END) AS lap,
    sum(n.v * (n.x - c.x) * CASE WHEN n.y = c.y THEN 2 ELSE 1 END) AS gx, sum(n.v * (n.y - c.y) * CASE WHEN n.x = c.x THEN 2 ELSE 1 END) AS gy
    FROM h c JOIN h n ON n.tile_id = c.tile_id AND n.x BETWEEN c.x - 1 AND c.x + 1 AND n.y BETWEEN c.y - 1 AND c.y + 1 GROUP BY ALL),
  i AS (SELECT tile_id, v, CASE WHEN k = 9 THEN lap ELSE 0 END AS lap, CASE WHEN k = 9 THEN gx * gx + gy * gy ELSE 0 END AS g2 FROM s)
  SELECT tile_id, round(stddev_samp(v), 6) AS contrast, round(var_samp(lap), 6) AS laplacian_variance, round(avg(sqrt(g2)), 6) AS sobel_mean, round(avg(g2), 6) AS tenengrad, var_samp(lap) <= 0.001 AS blurry FROM i GROUP BY tile_id""")
def h7_blur(spark, sf):
    return rounded(P.focus(V.grid_pixels(spark, sf)))


def _stain_sql(m, names, body):
    import numpy as np

    inv = np.linalg.inv(m)
    od = [f"(-ln(greatest({c}, {P.EPSILON!r}::DOUBLE)))" for c in "rgb"]
    cols = ", ".join(f"greatest(0.0::DOUBLE, {' + '.join(f'{od[j]} * ({float(inv[i, j])!r}::DOUBLE)' for j in range(3))}) AS {n}" for i, n in enumerate(names))
    return V.with_(V.PIXELS, f"stains AS (SELECT tile_id, {cols} FROM pixels)") + body


_ihc = P.basis(P.HEMATOXYLIN_IHC, P.DAB)


@query(_stain_sql(_ihc, ("h", "d", "x"), "SELECT tile_id, count(*) AS n, round(avg(h), 6) AS h, round(avg(d), 6) AS d, round(avg(x), 6) AS x FROM stains GROUP BY tile_id"))
def h23_deconvolve(spark, sf):
    out = P.deconvolved(V.pixels(spark, sf), _ihc, ("h", "d", "x"), ("tile_id",))
    return rounded(out.groupBy("tile_id").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "hdx"]))


@query(_stain_sql(_ihc, ("h", "d", "x"), """SELECT tile_id, 'd' AS channel, count(*) AS n, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.5), 6) AS median, round(coalesce(stddev_samp(d), 0), 6) AS sd, round(min(d), 6) AS min, round(max(d), 6) AS max,
  round(quantile_cont(d, 0.1), 6) AS p10, round(quantile_cont(d, 0.9), 6) AS p90, round(avg((d >= 0.1)::INT::DOUBLE), 6) AS positive_fraction FROM stains GROUP BY tile_id"""))
def f3_stain_intensity(spark, sf):
    out = P.deconvolved(V.pixels(spark, sf), _ihc, ("h", "d", "x"), ("tile_id",)).select("tile_id", F.lit("d").alias("channel"), F.col("d").alias("value"))
    return rounded(P.stain_intensity(out, ["tile_id", "channel"], 0.1))


@query(_stain_sql(_ihc, ("h", "d", "x"), """, g AS (SELECT tile_id, tile_id % 3 AS class, count(*) AS n, avg(d) AS dm, quantile_cont(d, 0.5) AS dq, avg(h) AS hm, quantile_cont(h, 0.5) AS hq, count(*) FILTER (d >= 0.1) AS p FROM stains GROUP BY ALL)
  SELECT class, count(*) AS n_rois, sum(n)::BIGINT AS n, round(sum(dm * n) / sum(n), 6) AS dab_mean, round(sum(dq * n) / sum(n), 6) AS dab_median, round(sum(hm * n) / sum(n), 6) AS hematoxylin_mean, round(sum(hq * n) / sum(n), 6) AS hematoxylin_median,
  sum(p)::BIGINT AS positive, round(sum(p) / sum(n), 6) AS positive_fraction, round(CASE WHEN sum(hm * n) / sum(n) > 1e-12 THEN (sum(dm * n) / sum(n)) / (sum(hm * n) / sum(n)) END, 6) AS ratio FROM g GROUP BY class"""))
def f5_ihc_classes(spark, sf):
    out = P.deconvolved(V.pixels(spark, sf), _ihc, ("hematoxylin", "dab", "rest"), ("tile_id",)).withColumn("roi_id", F.col("tile_id")).withColumn("class", F.col("tile_id") % 3)
    return rounded(P.ihc_classes(P.ihc_intensity(out)))


@query()
def h22_macenko(spark, sf):
    m = P.estimated_basis(V.pixels(spark, sf))
    rows = ", ".join(f"({k}, {m[0, k]!r}D, {m[1, k]!r}D, {m[2, k]!r}D)".replace("np.float64(", "").replace(")D", "D") for k in range(3))
    return rounded(spark.sql(f"SELECT * FROM VALUES {rows} AS t(stain, r, g, b)"))


@query()
def h29_normalise(spark, sf):
    he = P.basis(P.HEMATOXYLIN, P.EOSIN)
    return rounded(P.normalised(V.grid_pixels(spark, sf), he, he, (1.5, 1.0)))


@query(V.with_(V.GRID) + f""", h AS (SELECT tile_id, {_hue.replace(" AS v", " AS w")}, greatest(r, g, b) AS t, -ln(greatest(r, {P.EPSILON!r}::DOUBLE)) - ln(greatest(g, {P.EPSILON!r}::DOUBLE)) - ln(greatest(b, {P.EPSILON!r}::DOUBLE)) AS o FROM grid)
  SELECT tile_id, round(avg((NOT (o > 2.2 OR t < 0.18) AND (s < 0.08 OR t > 0.88 OR o < 0.15))::INT::DOUBLE), 6) AS low_fraction, round(avg((o > 2.2 OR t < 0.18)::INT::DOUBLE), 6) AS over_fraction FROM h GROUP BY tile_id""")
def h16_stain_quality(spark, sf):
    return rounded(P.stain_quality(V.grid_pixels(spark, sf)).drop("quality"))


@query(V.with_(V.PIXELS) + """, hist AS (SELECT tile_id, least(255, greatest(0, floor(r * 256)::INT)) AS bin, count(*) AS n FROM pixels GROUP BY ALL),
  c AS (SELECT *, sum(n) OVER w AS w0, sum(n * ((bin + 0.5::DOUBLE) / 256)) OVER w AS s0, sum(n) OVER (PARTITION BY tile_id) AS w1, sum(n * ((bin + 0.5::DOUBLE) / 256)) OVER (PARTITION BY tile_id) AS s1 FROM hist WINDOW w AS (PARTITION BY tile_id ORDER BY bin)),
  v AS (SELECT tile_id, bin, coalesce(w0 * (w1 - w0) * (s0 / w0 - (s1 - s0) / nullif(w1 - w0, 0)) * (s0 / w0 - (s1 - s0) / nullif(w1 - w0, 0)), 0.0) AS between_ FROM c),
  m AS (SELECT tile_id, max(between_) AS top FROM v GROUP BY tile_id)
  SELECT tile_id, round((min(bin) + 1) / 256::DOUBLE, 6) AS threshold FROM v JOIN m USING (tile_id) WHERE between_ = top GROUP BY tile_id""")
def n44_otsu_threshold(spark, sf):
    return rounded(P.otsu(V.pixels(spark, sf), "r", ["tile_id"]))


@query(V.with_(V.GRID) + """SELECT tile_id, floor("row" / 2)::BIGINT AS "row", floor(col / 2)::BIGINT AS col, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM grid GROUP BY ALL""")
def b12_pyramid(spark, sf):
    return rounded(P.pyramid_step(V.grid_pixels(spark, sf)))


@query()
def h10_fold_candidates(spark, sf):
    return candidates.detect(V.grid_pixels(spark, sf), "fold", min_area=3)


@query()
def h12_bubble_candidates(spark, sf):
    return candidates.detect(V.grid_pixels(spark, sf), "bubble", saturation=0.6, min_area=2)


@query()
def h14_dust_candidates(spark, sf):
    return candidates.detect(V.grid_pixels(spark, sf), "dust")


@query()
def h9_pen_marks(spark, sf):
    return candidates.detect(V.grid_pixels(spark, sf), "pen")


@query()
def h17_understained(spark, sf):
    return candidates.detect(V.grid_pixels(spark, sf), "low_stain")


# masks


@query(V.with_(V.edges_sql(), """points AS (SELECT y * 100 + x AS point_id, (x + 0.5) * 10.0::DOUBLE AS x, (y + 0.5) * 10.0::DOUBLE AS y FROM range(0, 100) a(x), range(0, 80) b(y))""", V.HITS) + """SELECT (point_id // 100)::BIGINT AS "row", (point_id % 100)::BIGINT AS col, (max(ri) + 1)::BIGINT AS label FROM hits GROUP BY point_id""")
def h31_rois_to_mask(spark, sf):
    return rounded(masks.rois_to_mask(V.rois(spark, sf), 100, 80, 10.0))


@query()
def n45_tissue_components(spark, sf):
    return masks.mask_components(masks.tissue_mask(V.grid_pixels(spark, sf), 0.6, 0.2), 3)


@query()
def h32_mask_to_rois(spark, sf):
    mask = masks.rois_to_mask(V.rois(spark, sf), 100, 80, 10.0).withColumn("mask_id", F.lit("m"))
    out = masks.mask_to_rois(mask, 10.0)
    return out.select("mask_id", "label", "component", "area", G.area(F.col("geometry")).alias("area_px"), F.size("geometry").alias("parts"))


# cell index


@query(V.with_(V.CELLS) + "SELECT status, label, count(*) AS n FROM predictions GROUP BY ALL")
def n54_index_summary(spark, sf):
    return cellindex.summary(V.predictions(spark, sf), "m1")


@query(V.with_(V.CELLS) + """SELECT row_id, cell_id, status, label, probability FROM cells JOIN predictions USING (row_id) WHERE xmax >= 100 AND xmin <= 600 AND ymax >= 100 AND ymin <= 500 AND (status <> 'predicted' OR probability IS NULL OR probability < 0.3)""")
def n55_viewport(spark, sf):
    return cellindex.viewport(V.cells(spark, sf), V.predictions(spark, sf), "m1", BOX, "__review__", 0.3).select("row_id", "cell_id", "status", "label", "probability")


@query(V.with_(V.CELLS) + """SELECT row_id, cell_id, coalesce(probability, -1) AS score FROM cells JOIN predictions USING (row_id) WHERE label = 'click' ORDER BY score, row_id LIMIT 200""")
def n56_review_queue(spark, sf):
    return cellindex.queue(V.cells(spark, sf), V.predictions(spark, sf), "m1", "click", 0.5, 200).select("row_id", "cell_id", "score")


@query(V.with_(V.CELLS) + """SELECT row_id, coalesce(probability, -1) AS score FROM cells JOIN predictions USING (row_id) ORDER BY score, row_id LIMIT 50 OFFSET 50""")
def n58_second_page(spark, sf):
    ordered = cellindex.scoped(V.cells(spark, sf), V.predictions(spark, sf), "m1").withColumn("score", F.coalesce("probability", F.lit(-1.0)))
    scope = cellindex.scope_digest(model="m1")
    _, cursor = cellindex.page(ordered, scope, 50)
    return cellindex.page(ordered, scope, 50, cursor)[0].select("row_id", "score")


@query(V.with_(V.CELLS) + """SELECT least(31, greatest(0, trunc((x - 100) / (500 / 32.0::DOUBLE))::INT))::BIGINT AS bx, least(31, greatest(0, trunc((y - 100) / (400 / 32.0::DOUBLE))::INT))::BIGINT AS by, count(*) AS n FROM cells WHERE xmax >= 100 AND xmin <= 600 AND ymax >= 100 AND ymin <= 500 GROUP BY ALL""")
def n59_viewport_density(spark, sf):
    return rounded(cellindex.density(V.cells(spark, sf), BOX))


@query(V.with_(V.CELLS) + "SELECT row_id, 'other' AS missing FROM cells WHERE row_id % 1000 = 7")
def n61_index_integrity(spark, sf):
    return cellindex.mismatches(V.cells(spark, sf), V.predictions(spark, sf).filter("row_id % 1000 <> 7"))


@query(V.with_(V.CELLS) + """SELECT row_id, cell_id, x, y, CASE WHEN row_id % 5 > 0 THEN greatest((row_id % 10) / 10.0::DOUBLE, round(1 - (row_id % 10) / 10.0::DOUBLE, 6)) END AS top FROM cells WHERE row_id % 7 <> 3 OR row_id % 5 = 0""")
def n60_display_points(spark, sf):
    """Every seventh vector does not sum to 1 and its cell goes; every fifth cell has none."""
    i = F.col("row_id")
    p = F.when(i % 5 > 0, F.array((i % 10) / 10.0, F.round(1 - (i % 10) / 10.0, 6), F.when(i % 7 == 3, F.lit(0.2)).otherwise(F.lit(0.0))))
    return rounded(cellindex.display_points(V.cells(spark, sf).withColumn("raw_json", F.to_json(F.struct("x", "y", p.alias("probabilities"))))))


@query("SELECT vec_id AS row_id, 'c' || vec_id AS cell_id, label::BIGINT AS label, len(embedding)::BIGINT AS n FROM embeddings")
def n62_index_features(spark, sf):
    e = V.read(spark, sf, "embeddings")
    held = e.select(F.col("vec_id").alias("row_id"), F.to_json("embedding").alias("values_json"))
    cells = e.select(F.col("vec_id").alias("row_id"), F.concat(F.lit("c"), "vec_id").alias("cell_id"))
    return rounded(cellindex.features_of(cells, held).join(e.select(F.col("vec_id").alias("row_id"), "label"), "row_id").select("row_id", "cell_id", "label", F.size("features").alias("n")))


# review


@query("""SELECT d.doc_id, lang, quality::BIGINT AS quality FROM documents d JOIN labels USING (doc_id) WHERE lang IN ('en', 'fr')""")
def n35_match_ids(spark, sf):
    return rounded(review.matched(V.read(spark, sf, "documents").filter(F.col("lang").isin("en", "fr")).select("doc_id", "lang"), V.read(spark, sf, "labels").select("doc_id", "quality"), "doc_id"))


@query("""SELECT event_id AS id FROM events WHERE event_type IN ('click', 'view') AND user_id % 5 IN (1, 2)""")
def c9_review_select(spark, sf):
    e = V.read(spark, sf, "events").select(F.col("event_id").alias("id"), F.create_map(F.lit("type"), F.col("event_type")).alias("cluster_values"), (F.col("user_id") % 5).cast("string").alias("tissue_id"), F.lit("cell").alias("observation_unit"))
    return review.select(e, None, "type", ["click", "view"], ["1", "2"], "cell").select("id")


@query("""WITH t AS (SELECT event_id, user_id, (event_id * 13 + user_id) % 97 / 100.0::DOUBLE AS f FROM events) SELECT 'u' || user_id AS cell_id, min('r' || event_id) FILTER (f = m) AS region_id, round(max(f), 6) AS fraction, count(*) AS n_regions
  FROM (SELECT *, max(f) OVER (PARTITION BY user_id) AS m FROM t) GROUP BY user_id""")
def n83_tissue_context(spark, sf):
    e = V.read(spark, sf, "events")
    over = e.select(F.concat(F.lit("u"), "user_id").alias("cell_id"), F.concat(F.lit("r"), "event_id").alias("region_id"), ((F.col("event_id") * 13 + F.col("user_id")) % 97 / 100.0).alias("fraction"))
    return rounded(review.tissue_context(over.select("cell_id").distinct(), over).select("cell_id", "region_id", "fraction", "n_regions"))


@query("""SELECT user_id AS context_id, max(event_id) AS revision, arg_max(md5(event_id::VARCHAR), event_id) AS digest, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id""")
def n78_checkpoints(spark, sf):
    e = V.read(spark, sf, "events")
    return review.commit_checkpoints(e.select(F.col("user_id").alias("context_id"), F.col("event_id").alias("revision"), F.md5(F.col("event_id").cast("string")).alias("digest"), F.col("event_type").alias("state")))


@query("""SELECT event_id % 700 AS key, arg_max(value::VARCHAR, event_id)::DOUBLE AS payload, max(event_id) AS revision FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'""")
def n68_patch_state(spark, sf):
    e = V.read(spark, sf, "events")
    p = e.select(F.col("user_id").cast("string").alias("client"), F.col("event_id").alias("revision"), F.when(F.col("event_type") == "error", F.lit("remove")).otherwise(F.lit("upsert")).alias("op"), (F.col("event_id") % 700).cast("string").alias("key"), F.col("value").cast("string").alias("payload"))
    return patches.latest(p.unionByName(p)).select(F.col("key").cast("long").alias("key"), F.col("payload").cast("double").alias("payload"), "revision")


@query("""SELECT 'o_orderstatus' AS variable, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def n82_tile_report(spark, sf):
    return review.tile_report(V.read(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


_presets = """presets(class, color, export) AS (VALUES ('tumour', '#D73027', true), ('stroma', '#4575B4', true), ('necrosis', '#7F7F7F', true), ('normal', '#1A9850', true), ('artefact', '#984EA3', false), ('exclusion', '#000000', false), ('invasive front', '#F46D43', true))"""


@query(f"""WITH {_presets}, own AS (SELECT DISTINCT p_type AS class, '#' || printf('%06d', length(p_type) * 4711) AS color, length(p_type) % 2 = 0 AS export FROM part UNION ALL SELECT 'Tumour', '#112233', NULL)
  SELECT coalesce(o.class, d.class) AS class, coalesce(d.class, o.class) AS label, coalesce(o.color, d.color) AS color, coalesce(o.export, d.export, true) AS export FROM presets d FULL JOIN own o ON lower(o.class) = d.class""")
def c2_presets(spark, sf):
    size = F.length("p_type")
    own = V.read(spark, sf, "part").select("p_type").distinct().select(F.col("p_type").alias("class"), F.concat(F.lit("#"), F.format_string("%06d", size * 4711)).alias("color"), (size % 2 == 0).alias("export"))
    own = own.unionByName(spark.sql("SELECT 'Tumour' AS class, '#112233' AS color, CAST(NULL AS boolean) AS export")).withColumn("label", F.lit(None).cast("string"))
    return review.presets(review.default_presets(spark), own)


@query(V.with_(V.regions_sql(), _presets) + """SELECT roi_id, color FROM regions LEFT JOIN presets USING (class)""")
def c5_apply_presets(spark, sf):
    return review.apply_presets(V.rois(spark, sf).withColumn("color", F.lit(None).cast("string")), review.default_presets(spark)).select("roi_id", "color")


@query("""WITH c AS (SELECT DISTINCT c_mktsegment AS name FROM customer) SELECT name, ['#00BFC4', '#F8766D', '#7CAE00', '#C77CFF', '#E69F00', '#56B4E9', '#CC79A7'][list_sum([ord(lower(name)[i]) * i for i in range(1, length(name) + 1)])::BIGINT % 7 + 1] AS color FROM c""")
def n88_stable_colours(spark, sf):
    return V.read(spark, sf, "customer").select(F.col("c_mktsegment").alias("name")).distinct().select("name", S.stable_colour(F.col("name")).alias("color"))


@query("""SELECT path, reason FROM (SELECT *, sum(bytes) OVER (ORDER BY mtime DESC, path) AS run, sum(bytes) OVER () AS whole, 'size' AS reason FROM (SELECT 'p' || o_orderkey AS path, (o_custkey % 50 + 1) AS bytes, (o_orderkey % 40) * 86400.0::DOUBLE AS mtime FROM orders) WHERE 3456000.0 - mtime <= 2592000)
  WHERE whole > 1000 AND run > 900 UNION ALL SELECT 'p' || o_orderkey, 'age' FROM orders WHERE 3456000.0 - (o_orderkey % 40) * 86400.0 > 2592000""")
def k9_cache_prune(spark, sf):
    files = V.read(spark, sf, "orders").select(F.concat(F.lit("p"), "o_orderkey").alias("path"), (F.col("o_custkey") % 50 + 1).alias("bytes"), ((F.col("o_orderkey") % 40) * 86400.0).alias("mtime"))
    return review.cache_prune(files, 1000, 30, 3456000.0)


@query("""WITH k AS (SELECT s_suppkey AS slide_id, s_suppkey % 4 AS kind, (s_suppkey % 7 + 1) / 20.0::DOUBLE AS v FROM supplier)
  SELECT slide_id, round(CASE kind WHEN 0 THEN v WHEN 1 THEN 0.6 WHEN 2 THEN 10000 / (20000 + slide_id) ELSE v END, 6) AS mpp_x, round(CASE kind WHEN 0 THEN v WHEN 1 THEN 0.6 WHEN 2 THEN 10000 / (20000 + slide_id) ELSE v * 2 END, 6) AS mpp_y, CASE kind WHEN 0 THEN 40.0::DOUBLE WHEN 2 THEN 20.0 END AS objective_power FROM k""")
def a6_pixel_size(spark, sf):
    key = F.col("s_suppkey")
    v = ((key % 7 + 1) / 20.0).cast("string")
    given = lambda **named: F.create_map(*[x for n, c in named.items() for x in (F.lit(n.replace("__", ".").replace("_", "-") if n.startswith(("openslide", "mpp")) else n.replace("__", ".")), c)])
    properties = (
        F.when(key % 4 == 0, given(openslide__mpp_x=v, openslide__objective_power=F.lit("40")))
        .when(key % 4 == 1, given(openslide__mpp_x=F.lit("none"), mpp_y=F.lit("0.6")))
        .when(key % 4 == 2, given(tiff__XResolution=(key + 20000).cast("string"), tiff__ResolutionUnit=F.lit("centimeter"), aperio__AppMag=F.lit("20")))
        .otherwise(given(openslide__mpp_x=v, openslide__mpp_y=((key % 7 + 1) / 10.0).cast("string")))
    )
    return rounded(tables.pixel_size(V.read(spark, sf, "supplier").select(key.alias("slide_id"), properties.alias("properties"))))


# models


@query()
def i1_train_and_predict(spark, sf):
    e = V.read(spark, sf, "embeddings")
    model = models.train(e.filter("vec_id % 2 = 0"), "embedding", "label", components=8)
    return models.predict(model, e.filter("vec_id % 2 = 1"), "embedding").select("vec_id", "label", "predicted", F.round("probability", 6).alias("probability"))


@query()
def n31_refine_labels(spark, sf):
    """Cells of slides of unequal size, whose labels follow the place, one in eleven at random."""
    k = F.col("point_id")
    pure = F.when(F.sqrt((F.col("x") - 500) ** 2 + (F.col("y") - 400) ** 2) < 250, "tumour").when(F.col("x") < 500, "stroma").otherwise("immune")
    wrong = F.element_at(F.array(F.lit("tumour"), F.lit("stroma"), F.lit("immune")), (k % 3 + 1).cast("int"))
    slide = F.concat(F.lit("s"), F.least(k % 9, F.lit(5)))
    cells = V.points(spark, sf).select("point_id", "x", "y", slide.alias("slide_id"), F.when(k % 11 == 0, wrong).otherwise(pure).alias("label"))
    return svm.refine_labels(cells, by=["slide_id"]).select("point_id", "slide_id", "label", "refined")


@query("""WITH l AS (SELECT i - 1 AS place, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)), s AS (SELECT place, avg(v) AS m, stddev_samp(v) AS s FROM l GROUP BY place) SELECT place, round(m, 6) AS mean, round(s, 6) AS scale FROM s WHERE s > 0""")
def n29_preprocess_fit(spark, sf):
    r = models.fit_recipe(V.read(spark, sf, "embeddings"), "embedding")
    rows = ", ".join(f"({a}L, {m!r}D, {s!r}D)" for a, m, s in zip(r.at, r.mean, r.scale, strict=True))
    return rounded(spark.sql(f"SELECT * FROM VALUES {rows} AS t(place, mean, scale)"))


# further operators


@query("""WITH k AS (SELECT count(*) AS n, count(DISTINCT event_type) AS t, count(DISTINCT user_id) AS u, count(DISTINCT props) AS p FROM events), f AS (SELECT 'event_type' AS field, t AS kinds, n FROM k UNION ALL SELECT 'user_id', u, n FROM k UNION ALL SELECT 'props', p, n FROM k)
  SELECT field, kinds FROM f WHERE kinds >= 2 AND kinds <= greatest(50, least(200, n // 2))""")
def c16_cluster_fields(spark, sf):
    return review.cluster_fields(V.read(spark, sf, "events").select("event_id", "event_type", "user_id", "props", "value"), "event_id")


@query("""SELECT DISTINCT upper(p_brand) AS name, p_brand AS feature, (CASE WHEN upper(p_brand) = p_brand THEN 0 ELSE 1 END)::BIGINT AS rank FROM part""")
def n36_gene_match(spark, sf):
    p = V.read(spark, sf, "part").select(F.col("p_brand").alias("feature")).distinct()
    asked = p.select(F.upper("feature").alias("name"))
    aliases = p.select(F.lit("none").alias("alias"), "feature").limit(1)
    return rounded(review.gene_match(asked, p, aliases))


@query(V.with_(V.regions_sql(), V.edges_sql()) + """, e AS (SELECT roi_id, class, min(x1) AS xmin, min(y1) AS ymin, max(x1) AS xmax, max(y1) AS ymax FROM edges JOIN regions USING (ri) GROUP BY ALL)
  SELECT roi_id, class, (round_even(xmin, 0) + 60 * i)::BIGINT AS x, (round_even(ymin, 0) + 60 * j)::BIGINT AS y, 100::BIGINT AS width, 100::BIGINT AS height FROM e, range(0, 20) a(i), range(0, 20) b(j)
  WHERE xmax - xmin >= 100 AND ymax - ymin >= 100 AND round_even(xmin, 0) + 60 * i <= floor(xmax - 100) AND round_even(ymin, 0) + 60 * j <= floor(ymax - 100)""")
def g5_tile_rois(spark, sf):
    return rounded(tiles.tile_rois(V.rois(spark, sf).filter("size(geometry) > 0"), 100, 60))


@query(V.with_(V.regions_sql(), V.edges_sql(), V.AREAS) + """SELECT roi_id, class, ri * 3::BIGINT AS score, round(area_px, 6) AS area_px FROM areas JOIN (SELECT ri, roi_id AS own FROM regions) USING (ri)""")
def b1_geojson_round_trip(spark, sf):
    """Regions written as feature collections, with a property of their own, and read back line by line."""
    path = work_path(spark, "geojson")
    tables.write_geojson(V.rois(spark, sf).withColumn("properties", F.to_json(F.struct((F.col("roi_index") * 3).alias("score")))), path)
    back = tables.read_geojson_lines(spark, path)
    return rounded(back.select("roi_id", "class", F.get_json_object("properties", "$.score").cast("long").alias("score"), G.area("geometry").alias("area_px")))


@query("""WITH b AS (SELECT o_orderkey AS id, (o_orderkey * 37 % 900)::DOUBLE AS xmin, (o_orderkey * 91 % 700)::DOUBLE AS ymin, o_orderkey % 180 AS w, o_orderkey % 150 AS h, o_orderkey % 8 AS f FROM orders),
  s AS (SELECT id, xmin, ymin, xmin + (20 + w) / (2 ** f)::DOUBLE AS xmax, ymin + (20 + h) / (2 ** f)::DOUBLE AS ymax FROM b) SELECT id, xmin, ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax FROM s WHERE xmin <= 600 AND xmax >= 100 AND ymin <= 500 AND ymax >= 100""")
def n7_box_window(spark, sf):
    """Boxes of very unequal sizes, stored as an index and asked for a window."""
    k = F.col("o_orderkey")
    scale = F.pow(F.lit(2.0), k % 8)
    x, y = ((k * 37) % 900).cast("double"), ((k * 91) % 700).cast("double")
    boxes = V.read(spark, sf, "orders").select(k.alias("id"), x.alias("xmin"), y.alias("ymin"), (x + (20 + k % 180) / scale).alias("xmax"), (y + (20 + k % 150) / scale).alias("ymax"))
    path = work_path(spark, "boxes")
    boxindex.write_index(boxes, path)
    return rounded(boxindex.window(spark, path, BOX))


@query(V.with_(V.regions_sql()) + """SELECT roi_id FROM regions WHERE class IS NULL OR class <> 'stroma'""")
def c6_export_filter(spark, sf):
    table = review.presets(review.default_presets(spark), spark.sql("SELECT 'Stroma' AS class, NULL AS label, NULL AS color, false AS export"))
    return review.exported(V.rois(spark, sf), table).select("roi_id")


@query(V.with_(V.regions_sql()) + """SELECT roi_id, CASE WHEN roi_id IN ('ell', 'wide') THEN 'necrosis' ELSE class END AS class FROM regions""")
def c1_set_class(spark, sf):
    return review.set_class(V.rois(spark, sf), "necrosis", ["ell", "wide"]).select("roi_id", "class")


@query(V.with_(V.PIXELS) + f""", h AS (SELECT *, {_hue} FROM pixels), a AS (SELECT tile_id, avg((v >= 0.6 AND s <= 0.5)::INT::DOUBLE) AS w, avg(v) AS v, avg(s) AS s FROM h GROUP BY tile_id)
  SELECT s_suppkey AS tile_id FROM supplier LEFT JOIN a ON tile_id = s_suppkey WHERE NOT coalesce(w >= 0.16 OR (v >= 0.90 AND s <= 0.10), true)""")
def h4_drop_whitespace(spark, sf):
    t = V.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("tile_id"))
    return P.flag_whitespace(t, V.pixels(spark, sf), "drop", bright=0.6, pale=0.5, fraction=0.16).select("tile_id")


@query(V.with_(V.POINTS) + """SELECT point_id AS id, x * 0.5 + y * 0.1 - 20 AS x, y * 0.5 + 10 AS y FROM points WHERE x * 0.5 + y * 0.1 - 20 BETWEEN 0 AND 400 AND y * 0.5 + 10 BETWEEN 0 AND 400""")
def n64_native_points(spark, sf):
    p = V.points(spark, sf).select(F.col("point_id").alias("id"), "x", "y")
    return experiment.native_points(p, [[0.5, 0.1, -20.0], [0.0, 0.5, 10.0], [0.0, 0.0, 1.0]], 400, 400)


@query("""SELECT o_orderkey AS id, least(o_orderkey % 40 * 32.0 + 16, 1250)::DOUBLE AS x, least(o_custkey % 30 * 32.0 + 16, 950)::DOUBLE AS y, (o_orderkey % 40 * 32 + 32 > 1250 OR o_custkey % 30 * 32 + 32 > 950) AS padded FROM orders""")
def n85_feature_geometry(spark, sf):
    o = V.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 40).alias("col"), (F.col("o_custkey") % 30).alias("row"))
    return experiment.feature_geometry(o, 32.0, 1250, 950).select("id", "x", "y", "padded")


@query(V.with_(V.POINTS, """offsets AS (SELECT (i * 50)::DOUBLE AS d FROM range(-4, 5) t(i))""") + """, moved AS (SELECT a.d AS dx, b.d AS dy, x + a.d AS u, y + b.d AS v FROM points, offsets a, offsets b),
  s AS (SELECT dx, dy, coalesce(avg(CASE WHEN u >= 150 AND u < 850 AND v >= 100 AND v < 650 THEN 1.0 ELSE 0.0 END) FILTER (u >= 0 AND u < 1000 AND v >= 0 AND v < 800), 0) * avg((u >= 0 AND u < 1000 AND v >= 0 AND v < 800)::INT::DOUBLE) AS score FROM moved GROUP BY ALL)
  SELECT dx, dy, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, abs(dx) + abs(dy), dx, dy LIMIT 1""")
def d6_tissue_translation(spark, sf):
    mask = spark.range(14 * 11).select((F.floor(F.col("id") / 14) + 2).alias("row"), (F.col("id") % 14 + 3).alias("col"))
    return rounded(experiment.tissue_translation(mask, V.points(spark, sf), 50.0, 1000, 800, [50.0 * k for k in range(-4, 5)], sample=None))


@query(V.with_(V.POINTS, """disc AS (SELECT round_even(x / 10, 0)::INT AS px, round_even(y / 10, 0)::INT AS py FROM points WHERE (x - 500) ** 2 + (y - 400) ** 2 < 62500)""", """counts AS (SELECT px, py, count(*) AS n FROM disc GROUP BY ALL)""",
  """tissue AS (SELECT px + 7 AS c, py - 4 AS r FROM counts WHERE px + 7 BETWEEN 1 AND 100 AND py - 4 BETWEEN 1 AND 80)""", """coarse AS (SELECT -25 + 20 * i AS dx, -20 + 20 * j AS dy FROM range(3) a(i), range(3) b(j))""",
  """rough AS (SELECT dx, dy, coalesce(sum(n) FILTER (r IS NOT NULL), 0) AS hits FROM coarse CROSS JOIN counts LEFT JOIN tissue ON c = px + dx AND r = py + dy GROUP BY ALL)""", """first AS (SELECT * FROM rough ORDER BY hits DESC, dx, dy LIMIT 1)""",
  """fine AS (SELECT dx + i AS dx, dy + j AS dy FROM first, range(-25, 26) a(i), range(-25, 26) b(j))""", """near AS (SELECT dx, dy, sum(n)::BIGINT AS hits FROM fine CROSS JOIN counts JOIN tissue ON c = px + dx AND r = py + dy GROUP BY ALL)""",
  """every AS (SELECT dx, dy, hits, 0 AS later FROM first UNION ALL SELECT dx, dy, hits, 1 FROM near)""") + """SELECT dx * 10.0::DOUBLE AS dx, dy * 10.0::DOUBLE AS dy, round(hits / (SELECT sum(n) FROM counts), 6) AS score, dx::BIGINT AS thumbnail_dx, dy::BIGINT AS thumbnail_dy, (SELECT sum(n) FROM counts)::BIGINT AS points
  FROM every ORDER BY hits DESC, later, dx, dy LIMIT 1""")
def d6_coarse_and_fine(spark, sf):
    disc = V.points(spark, sf).filter("power(x - 500, 2) + power(y - 400, 2) < 62500")
    mask = disc.select((F.bround(F.col("y") / 10) - 4).alias("row"), (F.bround(F.col("x") / 10) + 7).alias("col")).distinct()
    return rounded(experiment.estimate_translation(mask, disc, (100, 80), (1000.0, 800.0)))


@query("""SELECT 2.0::DOUBLE AS xx, 0.5::DOUBLE AS xy, -3.0::DOUBLE AS x0, -0.5::DOUBLE AS yx, 2.0::DOUBLE AS yy, 4.0::DOUBLE AS y0""")
def d3_estimate_transform(spark, sf):
    p = V.points(spark, sf).select("x", "y", (F.col("x") * 2 + F.col("y") * 0.5 - 3).alias("u"), (F.col("x") * -0.5 + F.col("y") * 2 + 4).alias("v"))
    m = models.estimate_transform(p)
    values = ", ".join(f"CAST({m[i][j]!r} AS DOUBLE) AS {n}" for i, j, n in ((0, 0, "xx"), (0, 1, "xy"), (0, 2, "x0"), (1, 0, "yx"), (1, 1, "yy"), (1, 2, "y0")))
    return rounded(spark.sql(f"SELECT {values}"))


@query("""SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 <> 0""")
def n81_test_rows(spark, sf):
    e = V.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return models.test_rows(e, e.filter("id % 3 = 0"), "id")


@query("""SELECT c_custkey AS id, c_name AS name, NULL::BIGINT AS size FROM customer UNION ALL SELECT p_partkey, p_name, p_size::BIGINT FROM part""")
def n34_union_fill(spark, sf):
    c = V.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return rounded(models.stacked(c, V.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))))


@query("""SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT p_partkey, p_name FROM part""")
def n33_align_features(spark, sf):
    c = V.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_acctbal")
    return models.aligned(c, V.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_size"), "id")


@query(V.with_(V.POINTS) + """SELECT point_id, x, y FROM points WHERE x >= 100 AND x < 500 AND y >= 100 AND y < 400 ORDER BY point_id LIMIT 300""")
def a24_registered_viewport(spark, sf):
    p = V.points(spark, sf).select("point_id", "x", "y", F.col("point_id").alias("row"))
    return tables.registered_viewport(p, (100.0, 100.0, 500.0, 400.0), 300)[0].drop("row")


@query()
def j1_signature(spark, sf):
    return review.signature(V.read(spark, sf, "events"))


@query(V.with_(V.POINTS) + """, d AS (SELECT a.point_id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM points a JOIN points b ON a.point_id <> b.point_id GROUP BY a.point_id),
  q AS (SELECT quantile_cont(d, [0.25, 0.5, 0.75]) AS q FROM d WHERE d > 0) SELECT round(q[2], 6) AS spacing_px, round(CASE WHEN (q[3] - q[1]) / q[2] <= 0.25 THEN 100 / q[2] END, 6) AS mpp FROM q""")
def n39_spot_spacing(spark, sf):
    return rounded(proximity.spot_spacing(V.points(spark, sf), "point_id"))


@query(_stain_sql(_ihc, ("hematoxylin", "dab", "x"), "SELECT 1").replace("SELECT tile_id,", "SELECT tile_id, col * 12.0::DOUBLE + 6 AS px, \"row\" * 12.0::DOUBLE + 6 AS py,").removesuffix("SELECT 1").rstrip() + """, points AS (SELECT row_number() OVER () AS point_id, px AS x, py AS y, hematoxylin, dab FROM stains),
  """ + ",\n".join([V.regions_sql(), V.edges_sql(), V.HITS]) + """ SELECT r.roi_id, r.class, count(*) AS n, round(avg(dab), 6) AS dab_mean, round(avg(hematoxylin), 6) AS hematoxylin_mean, count(*) FILTER (dab >= 0.1) AS positive, round(quantile_cont(dab, 0.5), 6) AS dab_median, round(quantile_cont(hematoxylin, 0.5), 6) AS hematoxylin_median,
  round(count(*) FILTER (dab >= 0.1) / count(*), 6) AS positive_fraction, round(count(*) FILTER (dab >= 0.1) * 0.25::DOUBLE, 6) AS positive_um2, round(CASE WHEN avg(hematoxylin) > 1e-12 THEN avg(dab) / avg(hematoxylin) END, 6) AS ratio
  FROM hits JOIN points USING (point_id) JOIN regions r USING (ri) GROUP BY ALL""")
def f6_measurement_report(spark, sf):
    """One of the report's seven tables; the others are f1 to f5, e3, e4 and n12."""
    px = P.deconvolved(V.pixels(spark, sf), _ihc, ("hematoxylin", "dab", "rest")).withColumn("x", F.col("col") * 12.0 + 6).withColumn("y", F.col("row") * 12.0 + 6).select("x", "y", "hematoxylin", "dab")
    return rounded(experiment.measurement_report(V.rois(spark, sf), V.points(spark, sf), px, pixel_size=0.5, only={"ihc"})["ihc"])


# slides and tiles of pixels


_grid_sql = """tiles AS (SELECT 's' || s AS slide_id, printf('s%d_R%05d_C%05d', s, r + 1, c + 1) AS tile_id, c * 48 AS x, r * 48 AS y FROM range(0, 2) t(s), range(0, 9) a(r), range(0, 14) b(c) WHERE c * 48 + 64 <= 704 AND r * 48 + 64 <= 448)"""


def _grid(spark):
    out = None
    for s in ("s0", "s1"):
        one = tiles.tile_grid(tiles.slide(spark, 704, 448, (1,)), 64, 16).withColumn("slide_id", F.lit(s)).withColumn("tile_id", F.concat(F.lit(s), F.substring("tile_id", 3, 100)))
        out = one if out is None else out.unionByName(one)
    return out


@query(V.with_(V.LEVELS) + """SELECT slide_id, "row" - 50 AS "row", col - 100 AS col, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM levels WHERE "row" >= 50 AND "row" < 110 AND col >= 100 AND col < 180""")
def a11_read_region(spark, sf):
    return rounded(slides.read_region(V.levels(spark, sf), 100, 50, 80, 60).drop("level"))


@query(V.with_(V.LEVELS) + """SELECT slide_id, "row" // 8 AS "row", col // 8 AS col, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM levels GROUP BY ALL""")
def a10_thumbnail(spark, sf):
    return rounded(slides.thumbnail(V.levels(spark, sf), spark.sql("SELECT * FROM VALUES ('s0', 704), ('s1', 704) AS t(slide_id, level_width)"), 100))


@query(V.with_(V.LEVELS, _grid_sql) + """SELECT tile_id, count(*) AS n, round(avg(r), 6) AS r, min("row" - y)::BIGINT AS row0, max(col - x)::BIGINT AS col1 FROM tiles JOIN levels USING (slide_id) WHERE "row" >= y AND "row" < y + 64 AND col >= x AND col < x + 64 GROUP BY tile_id""")
def a12_read_grid(spark, sf):
    held = slides.read_grid(V.levels(spark, sf), _grid(spark))
    return rounded(held.groupBy("tile_id").agg(F.count("*").alias("n"), F.avg("r").alias("r"), F.min("row").alias("row0"), F.max("col").alias("col1")))


@query(V.with_(V.LEVELS, _grid_sql) + f""", h AS (SELECT tile_id, {_hue} FROM tiles JOIN levels USING (slide_id) WHERE "row" >= tiles.y AND "row" < tiles.y + 64 AND col >= x AND col < x + 64),
  a AS (SELECT tile_id, avg((v >= 0.5 AND s <= 0.5)::INT::DOUBLE) AS w, avg(v) AS v, avg(s) AS s FROM h GROUP BY tile_id) SELECT tile_id FROM a WHERE NOT (w >= 0.2 OR (v >= 0.90 AND s <= 0.10))""")
def g3_tiles_without_whitespace(spark, sf):
    grid = _grid(spark)
    return P.flag_whitespace(grid, slides.read_grid(V.levels(spark, sf), grid), "drop", bright=0.5, pale=0.5, fraction=0.2).select("tile_id")


@query(V.with_(V.GRID) + f""", h AS (SELECT *, {_grey}, {_hue.replace(" AS v", " AS w")}, list_sort([r, g, b]) AS o FROM grid),
  e AS (SELECT *, abs(lead(v) OVER (PARTITION BY tile_id, "row" ORDER BY col) - v) AS dx, abs(lead(v) OVER (PARTITION BY tile_id, col ORDER BY "row") - v) AS dy FROM h),
  m AS (SELECT tile_id, avg(w) AS mean, coalesce(stddev_samp(w), 0) AS sd, avg((w <= 0.18)::INT::DOUBLE) AS dark, avg((w >= 0.92)::INT::DOUBLE) AS bright, avg((o[3] >= 1.25::DOUBLE * o[2] AND s >= 0.45)::INT::DOUBLE) AS pen,
    avg((w <= 0.28 AND s >= 0.25)::INT::DOUBLE) AS fold, coalesce((coalesce(sum(dx), 0) + coalesce(sum(dy), 0)) / nullif(count(dx) + count(dy), 0), 0) AS edge FROM e GROUP BY tile_id),
  f AS (SELECT tile_id, ((mean <= 0.12 OR dark >= 0.8)::INT + (mean >= 0.92 OR bright >= 0.8)::INT + (edge <= 0.012)::INT + (edge <= 0.008 AND sd <= 0.025)::INT + (pen >= 0.01)::INT + (fold >= 0.08)::INT) / 7.0::DOUBLE AS score FROM m)
  SELECT s_suppkey AS tile_id, round(score, 6) AS artifact_score, coalesce(score > 0, false) AS artifact FROM supplier LEFT JOIN f ON tile_id = s_suppkey""")
def h6_flag_artifacts(spark, sf):
    return rounded(slides.flag_artifacts(V.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("tile_id")), V.grid_pixels(spark, sf)).select("tile_id", "artifact_score", "artifact"))


@query(V.with_(V.PIXELS) + f""", h AS (SELECT tile_id, {_hue} FROM pixels), a AS (SELECT tile_id, avg(s) AS s FROM h GROUP BY tile_id), n AS (SELECT max(s_suppkey // 10) + 1 AS rows FROM supplier)
  SELECT (i + 1)::BIGINT AS "row", (j + 1)::BIGINT AS col, round(a.s, 6) AS value FROM n, range(0, 10000) x(i), range(0, 10) y(j) LEFT JOIN a ON a.tile_id = i * 10 + j WHERE i < rows""")
def n51_matrix(spark, sf):
    grid = V.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("tile_id"), (F.floor(F.col("s_suppkey") / 10) + 1).cast("int").alias("row"), (F.col("s_suppkey") % 10 + 1).cast("int").alias("col"))
    held = grid.join(P.whitespace(V.pixels(spark, sf)), "tile_id", "left")
    return rounded(slides.matrix(held, "saturation_mean").select("row", F.posexplode("values").alias("i", "value")).select("row", (F.col("i") + 1).alias("col"), "value"))


@query(V.with_(V.LEVELS, "od AS (SELECT *, " + ", ".join(f"-ln(greatest({c}, {P.EPSILON!r}::DOUBLE)) AS o_{c}" for c in "rgb") + " FROM levels)") + "SELECT slide_id, count(*) AS n, " + ", ".join(
    f"round(avg(greatest(0.0::DOUBLE, {' + '.join(f'o_{c} * ({float(v)!r}::DOUBLE)' for c, v in zip('rgb', P.np.linalg.inv(_ihc)[i], strict=True))})), 6) AS {n}" for i, n in enumerate("hd")) + """ FROM od WHERE "row" >= 0 AND "row" < 200 AND col >= 64 AND col < 364 GROUP BY slide_id""")
def h26_deconvolved_region(spark, sf):
    out = slides.deconvolved_region(V.levels(spark, sf), (64, 0, 300, 200), _ihc, ("h", "d", "x"))
    return rounded(out.groupBy("slide_id").agg(F.count("*").alias("n"), F.avg("h").alias("h"), F.avg("d").alias("d")))


@query(V.with_(V.PIXELS) + f""", o AS (SELECT tile_id % 2 AS i, avg(-ln(greatest(r, {P.EPSILON!r}::DOUBLE))) AS a, avg(-ln(greatest(g, {P.EPSILON!r}::DOUBLE))) AS b, avg(-ln(greatest(b, {P.EPSILON!r}::DOUBLE))) AS d FROM pixels WHERE (tile_id % 2 = 0) = (r > g) GROUP BY 1)
  SELECT i::BIGINT AS channel_index, CASE i WHEN 0 THEN 'Hematoxylin' ELSE 'HRP/DAB' END AS name, CASE i WHEN 0 THEN '#4b3f99' ELSE '#8b5a2b' END AS colour, round(a / sqrt(a * a + b * b + d * d), 6) AS r, round(b / sqrt(a * a + b * b + d * d), 6) AS g, round(d / sqrt(a * a + b * b + d * d), 6) AS b FROM o""")
def h18_stain_channels(spark, sf):
    """Channels of the mean densities of two kinds of pixels."""
    density = [F.avg(-F.log(F.greatest(F.col(c), F.lit(P.EPSILON)))).alias(c) for c in "rgb"]
    kinds = V.pixels(spark, sf).filter((F.col("tile_id") % 2 == 0) == (F.col("r") > F.col("g"))).groupBy((F.col("tile_id") % 2).alias("i")).agg(*density).orderBy("i").collect()
    found = P.stain_channels(spark, vectors=tuple((k["r"], k["g"], k["b"]) for k in kinds))
    return rounded(found.select("channel_index", "name", "colour", *[F.col("vector")[i].alias(c) for i, c in enumerate("rgb")]))


@query(V.with_(V.POINTS, V.GRID, """plane AS (SELECT "row", col, avg(r) AS value FROM grid GROUP BY ALL)""") + """, placed AS (SELECT point_id, floor(x / 16)::BIGINT AS c0, floor(y / 16)::BIGINT AS r0 FROM points),
  m AS (SELECT point_id, avg(value) AS v FROM placed JOIN plane ON "row" BETWEEN r0 - 2 AND r0 + 2 AND col BETWEEN c0 - 2 AND c0 + 2 AND ("row" - r0) * ("row" - r0) + (col - c0) * (col - c0) <= 4 WHERE r0 < 40 AND c0 < 64 GROUP BY point_id)
  SELECT point_id, r0 < 40 AND c0 < 64 AS in_bounds, round(v, 6) AS value, coalesce(v >= 0.5, false) AS positive FROM placed LEFT JOIN m USING (point_id)""")
def n9_channel_values(spark, sf):
    plane = V.grid_pixels(spark, sf).groupBy("row", "col").agg(F.avg("r").alias("value")).withColumn("channel_id", F.lit("r"))
    return rounded(P.channel_values(V.points(spark, sf), plane, "point_id", 64, 40, downsample=16.0, radius=32.0, thresholds={"r": 0.5}).drop("channel_id"))


# scope


@query(V.with_(V.regions_sql()) + "SELECT roi_id FROM regions WHERE roi_id = 'line' OR ri IN (1, 99) OR class = 'tumour'")
def n15_selected_regions(spark, sf):
    return scope.selected(V.rois(spark, sf), ["roi:line", "roi_index:1", "class:TUMOUR", "__all__", "", "roi_index:99"]).select("roi_id")


@query(V.with_(V.POINTS, V.regions_sql(), V.edges_sql(), V.HITS) + """, ok AS (SELECT h.point_id, min(h.ri) AS ri FROM hits h JOIN points p USING (point_id) WHERE h.ri IN (0, 1, 4) AND (h.ri <> 0 OR p.cell_class = 'click') GROUP BY 1)
  SELECT p.point_id, ok.ri::BIGINT AS roi_index, r.roi_id, CASE WHEN ok.ri IS NOT NULL THEN coalesce(r.class, 'unclassified') END AS label FROM points p LEFT JOIN ok USING (point_id) LEFT JOIN regions r ON r.ri = ok.ri""")
def n16_assigned_points(spark, sf):
    rois = V.rois(spark, sf).withColumn("scope", F.when(F.col("roi_id") == "donut", F.create_map(F.lit("project_image"), F.lit("CLICK"))))
    p = V.points(spark, sf).select("point_id", "x", "y", F.col("cell_class").alias("image"))
    return rounded(scope.assign_points(p, rois, ["donut", "ell", "wide"]).drop("x", "y", "image"))


@query("SELECT event_id FROM events WHERE event_type = 'view' AND user_id % 3 = 1")
def n18_project_scope(spark, sf):
    e = V.read(spark, sf, "events").select("event_id", F.col("event_type").alias("project_key"), (F.col("user_id") % 3).alias("project_section_index"), F.lit("a").alias("project_image"))
    return scope.in_project(e, {"project_key": "view", "project_image": "b", "project_section_index": 1, "project_section": "q"}).select("event_id")


@query(V.with_(V.POINTS, V.regions_sql(), V.edges_sql(), V.HITS) + """SELECT p.point_id, 'tumour' AS label, x >= 110 AND x <= 390 AND y >= 110 AND y <= 390 AND NOT (x - 10 < 300 AND x + 10 > 200 AND y - 10 < 300 AND y + 10 > 200) AS accepted FROM points p JOIN hits h USING (point_id) WHERE h.ri = 0""")
def n32_roi_training(spark, sf):
    p = V.points(spark, sf).select("point_id", "x", "y", F.lit(20.0).alias("width"), F.lit(20.0).alias("height"))
    return scope.roi_training(p, V.rois(spark, sf), ["roi:donut"], "point_id")


@query("""SELECT 'c' || event_id AS cell_id, 's' || event_id AS source_id, CASE WHEN event_id % 3 < 2 AND event_id % 5 > 0 THEN 'available' ELSE 'unavailable' END AS status, CASE WHEN event_id % 3 < 2 THEN event_id % 2 = 0 END AS disagreement,
  CASE WHEN event_id % 3 < 2 THEN event_id % 2 = 0 OR event_id % 4 = 1 END AS review_required, CASE WHEN event_id % 3 < 2 THEN (event_id % 11) / 10.0::DOUBLE END AS iou, CASE WHEN event_id % 3 < 2 THEN 1.0::DOUBLE END AS coverage FROM events""")
def n84_segmentation_review(spark, sf):
    e, i = V.read(spark, sf, "events"), F.col("event_id")
    cells = e.select(F.concat(F.lit("c"), i).alias("cell_id"), F.concat(F.lit("s"), i).alias("source_id"))
    rows = e.filter(i % 3 < 2).select(F.concat(F.when(i % 3 == 0, F.lit("c")).otherwise(F.lit("s")), i).alias("cell_id"), F.when(i % 5 == 0, F.lit("unavailable")).alias("status"), (i % 2 == 0).alias("disagreement"), F.when(i % 4 == 1, F.lit("adjust_boundary")).otherwise(F.lit("retain_original")).alias("action"), ((i % 11) / 10.0).alias("iou"), F.lit(1.0).alias("coverage"))
    return rounded(scope.segmentation_review(cells, rows))


@query(V.with_(V.edges_sql()) + """, a AS (SELECT ri, part, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area, count(*) AS n FROM edges WHERE ring = 0 GROUP BY ALL) SELECT ri::BIGINT AS roi_index, part::BIGINT AS part, round(area + 1.23456789e-8::DOUBLE, 6) AS area, (CASE WHEN n * 4 <= 20 THEN n * 4 ELSE n * 2 END + 1)::BIGINT AS corners FROM a""")
def n47_smoothed(spark, sf):
    """Areas stay, each round doubles the corners up to the limit (checked round by round). The sum keeps areas off ties of rounding."""
    shells = V.rois(spark, sf).select("roi_index", F.posexplode("geometry").alias("part", "p")).select("roi_index", "part", G.chaikin(F.col("p")[0], 2, most=20).alias("r"))
    return rounded(shells.select("roi_index", "part", (G.ring_area(F.col("r")) + 1.23456789e-8).alias("area"), F.size("r").alias("corners")))


@query(V.with_(V.regions_sql(), V.edges_sql()) + """SELECT ri::BIGINT AS roi_index, (count(*) + count(DISTINCT part * 10 + ring))::BIGINT AS corners FROM edges GROUP BY ri HAVING max(x1) >= 750 AND min(x1) <= 900 AND max(y1) >= 450 AND min(y1) <= 600""")
def n67_geojson_viewport(spark, sf):
    return rounded(slides.geojson_viewport(V.rois(spark, sf), (750.0, 450.0, 900.0, 600.0)).select("roi_index", "corners"))


@query("""SELECT 'u' || d.doc_id AS id, lang, source FROM documents d WHERE doc_id % 2 = 0 UNION ALL SELECT 'u' || doc_id, NULL, NULL FROM documents WHERE doc_id % 2 = 1""")
def c17_spatial_clusters(spark, sf):
    d = V.read(spark, sf, "documents").withColumn("id", F.concat(F.lit("u"), "doc_id"))
    return review.spatial_clusters(d.select("id"), d.filter("doc_id % 2 = 0").select("id", "lang", "source", "n_chars"), ["lang", "source"])


@query(V.with_(V.POINTS) + """SELECT 't1::spatial::' || point_id AS id, point_id::VARCHAR AS original_id, 't1' AS tissue_id, round(x * 2 + 5, 6) AS x, round(y * 0.5 - 1, 6) AS y, cell_class AS cluster FROM points""")
def e6_attached_spatial(spark, sf):
    p = V.points(spark, sf).withColumn("id", F.col("point_id").cast("string"))
    none = spark.sql("SELECT '' AS id, '' AS original_id, '' AS dataset_id, '' AS tissue_id, '' AS observation_unit, 0D AS x, 0D AS y, CAST(NULL AS map<string,string>) AS cluster_values WHERE false")
    out = review.attach_spatial(none, p.select("id", "x", "y"), p.select("id", "cell_class"), [[2.0, 0.0, 5.0], [0.0, 0.5, -1.0], [0.0, 0.0, 1.0]], "t1", confirmed=True)
    return rounded(out.select("id", "original_id", "tissue_id", "x", "y", F.col("cluster_values")["cell_class"].alias("cluster")))


@query(V.with_(V.POINTS) + "SELECT point_id, x * 2 AS x, y * 4 AS y FROM points")
def n37_scaled_coordinates(spark, sf):
    """Points beyond 1.15 times the object's image are in full resolution."""
    p = V.points(spark, sf).select("point_id", "x", "y")
    return experiment.scaled(p, experiment.coordinate_scale(p, (2000, 3200), (1000, 800), image=(500, 400)))


@query("""SELECT 'rois' AS "table", count(*) AS n FROM supplier UNION ALL SELECT 'tiles', count(*) FROM orders""")
def b20_case_report(spark, sf):
    return review.case_report({"rois": V.rois(spark, sf), "tiles": V.read(spark, sf, "orders")}, ["o_orderstatus"])["summary"]


@query("""SELECT s_suppkey AS slide_id, CASE s_suppkey % 3 WHEN 0 THEN 'label,macro' WHEN 1 THEN 'n' || s_nationkey ELSE '' END AS images FROM supplier""")
def a8_associated_images(spark, sf):
    key = F.col("s_suppkey")
    name = lambda n, of: F.concat(F.lit("openslide.associated."), n, F.lit(f".{of}"))
    two = F.create_map(name(F.lit("macro"), "width"), F.lit("5"), name(F.lit("label"), "width"), F.lit("9"), name(F.lit("label"), "height"), F.lit("4"))
    one = F.create_map(name(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), "width"), F.lit("7"))
    properties = F.when(key % 3 == 0, two).when(key % 3 == 1, one).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    return slides.associated_images(V.read(spark, sf, "supplier").select(key.alias("slide_id"), properties.alias("properties"))).select("slide_id", F.concat_ws(",", "images").alias("images"))


@query("""WITH b AS (SELECT o_custkey AS k, o_orderstatus = 'O' AS a, (o_orderkey * 37) % 900 AS x0, (o_orderkey * 91) % 700 AS y0, 20 + o_orderkey % 180 AS w, 20 + o_orderkey % 150 AS h FROM orders),
  xs AS (SELECT k, x, lead(x) OVER (PARTITION BY k ORDER BY x) - x AS w FROM (SELECT k, x0 AS x FROM b UNION SELECT k, x0 + w FROM b)),
  ys AS (SELECT k, y, lead(y) OVER (PARTITION BY k ORDER BY y) - y AS h FROM (SELECT k, y0 AS y FROM b UNION SELECT k, y0 + h FROM b)),
  c AS (SELECT xs.k, x, y, any_value(xs.w * ys.h) AS area, bool_or(a) AS a, bool_or(NOT a) AS b FROM xs JOIN ys ON ys.k = xs.k JOIN b ON b.k = xs.k AND x >= x0 AND x < x0 + b.w AND y >= y0 AND y < y0 + b.h WHERE xs.w IS NOT NULL AND ys.h IS NOT NULL GROUP BY xs.k, x, y),
  o(operation, i) AS (VALUES ('union', 0), ('intersection', 1), ('difference', 2), ('xor', 3))
  SELECT k AS c_custkey, operation, round(coalesce(sum(area) FILTER (CASE operation WHEN 'union' THEN a OR b WHEN 'intersection' THEN a AND b WHEN 'difference' THEN a AND NOT b ELSE a <> b END), 0)::DOUBLE, 6) AS area_px FROM c, o GROUP BY k, operation""")
def n75_overlay(spark, sf):
    """Orders as boxes: a customer's open ones against the others."""
    boxes = V.boxes(spark, sf)
    found = overlay.overlays(boxes.filter("first"), boxes.filter("NOT first"), key="c_custkey")
    return rounded(found.select("c_custkey", "operation", G.area(F.col("geometry")).alias("area_px")))


def _levels_sql(n: int) -> str:
    """l0, l1, ...: levels of halved means, of the places of `levels`."""
    steps = ["l0 AS (SELECT slide_id, \"row\", col, r, g, b FROM levels)"]
    for k in range(1, n):
        steps.append(f"l{k} AS (SELECT slide_id, \"row\" // 2 AS \"row\", col // 2 AS col, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM l{k - 1} GROUP BY ALL)")
    return ", ".join(steps)


#: Means of means often end in a 5; added before rounding, so that the last bit of a sum decides nothing.
_OFF = 1.23456789e-8


@query(V.with_(V.LEVELS, _levels_sql(5)) + " UNION ALL ".join(f"""SELECT slide_id, {k}::BIGINT AS level, "row"::BIGINT AS "row", col::BIGINT AS col, round(r + {_OFF}::DOUBLE, 6) AS r, round(g + {_OFF}::DOUBLE, 6) AS g, round(b + {_OFF}::DOUBLE, 6) AS b FROM l{k}""" for k in range(5)))
def b12_tiff_pyramid(spark, sf):
    """Slides written as pyramids of tiled TIFF, whose levels end with one tile, and read back. Values are doubles, places without a pixel -1."""
    path = work_path(spark, "pyramids")
    rasters.write_pyramids(V.levels(spark, sf).drop("level"), path, tile=64, kind="<f8", top=1.0, empty=-1.0)
    # tiles without any pixel read as 0 in all bands and lie outside
    found = rasters.as_rgb(rasters.read_tiff(spark, path), 1.0).filter("r >= 0")
    kept = V.levels(spark, sf).select("slide_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("level"), "row", "col")
    kept = kept.select("slide_id", "level", *[F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("int").alias(c) for c in ("row", "col")]).distinct()
    found = found.join(kept, ["slide_id", "level", "row", "col"], "left_semi")
    return rounded(found.select("slide_id", "level", "row", "col", *[(F.col(c) + _OFF).alias(c) for c in "rgb"]))


@query(V.with_(V.LEVELS, _levels_sql(2)) + """SELECT slide_id, channel, "row"::BIGINT AS "row", col::BIGINT AS col, round(CASE channel WHEN 0 THEN r WHEN 1 THEN g ELSE b END, 6) AS value FROM l1, (VALUES (0::BIGINT), (1), (2)) AS c(channel) WHERE slide_id = 's1' AND "row" BETWEEN 40 AND 90 AND col >= 100 AND col < 200""")
def a20_zarr_window(spark, sf):
    """Slides written as OME-Zarr; a window of the second level of one, of which no other chunk is read."""
    path = work_path(spark, "zarr")
    rasters.write_zarr(V.levels(spark, sf).drop("level"), path, tile=64, kind="<f8", top=1.0, empty=-1.0)
    box = rasters.read_zarr(spark, path).filter("slide_id = 's1' AND level = 1 AND row >= 40 AND row <= 90 AND col >= 100 AND col < 200 AND value >= 0")
    return rounded(box.select("slide_id", "channel", "row", "col", "value"))


@query(V.with_(V.LEVELS) + """, s AS (SELECT slide_id, max(col) + 1 AS w, max("row") + 1 AS h FROM levels GROUP BY 1), n AS (SELECT *, ceil(log2(greatest(ceil(w / 64), ceil(h / 64))))::INT + 1 AS n FROM s)
  SELECT slide_id, k::BIGINT AS level, greatest(1, ceil(w / power(2, k)))::BIGINT AS width, greatest(1, ceil(h / power(2, k)))::BIGINT AS height, '40000.0' AS resolution FROM n, range(0, 20) t(k) WHERE k < n""")
def a3_tiff_levels(spark, sf):
    """Slides written as TIFF: sizes of levels and the resolution, from the directories of the files."""
    path = work_path(spark, "slides")
    rasters.write_pyramids(V.levels(spark, sf).drop("level"), path, tile=64, pixel_size=0.25)
    found = rasters.open_slides(spark, path).select("slide_id", F.col("properties")["tiff.XResolution"].alias("resolution"), F.inline("levels"))
    return rounded(found.select("slide_id", "level", "width", "height", "resolution"))


@query()
def h22_vahadane(spark, sf):
    """The basis of all tissue pixels by sparse non-negative factors."""
    m = P.estimated_basis(V.pixels(spark, sf), "vahadane", passes=20)
    return rounded(spark.createDataFrame([(k, *map(float, m[:, k])) for k in range(3)], "stain int, r double, g double, b double"), 4)


@query(V.with_(V.regions_sql(), V.edges_sql(), """points AS (SELECT y * 100 + x AS point_id, (x + 0.5) * 10.0::DOUBLE AS x, (y + 0.5) * 10.0::DOUBLE AS y FROM range(0, 100) a(x), range(0, 80) b(y))""", V.HITS) + """, k AS (SELECT ri, coalesce(class, 'unlabelled') AS key FROM regions), v AS (SELECT key, row_number() OVER (ORDER BY min(ri)) AS value FROM k GROUP BY key)
  SELECT (point_id // 100)::BIGINT AS "row", (point_id % 100)::BIGINT AS col, value::BIGINT AS label FROM (SELECT point_id, max(ri) AS ri FROM hits GROUP BY point_id) JOIN k USING (ri) JOIN v USING (key)""")
def n92_coded_mask(spark, sf):
    rois = V.rois(spark, sf)
    return rounded(masks.coded_mask(rois, masks.codebook(rois, "class"), 100, 80, 10.0))
