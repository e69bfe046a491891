"""The operators against hand-worked values and brute force."""

import json
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from slidelake.functions import geometry as G
from slidelake.functions import scalars as S
from slidelake.operators import candidates, cellindex, masks, models, proximity, regions, review, tiles
from slidelake.operators import pixels as P
from slidelake.plans import views as V
from slidelake.sources import tables
from slidelake.streaming import patches


def box(x0, y0, x1, y1):
    return V._box(x0, y0, x1, y1)


def frame(spark, rois):
    rows = json.dumps([{"roi_index": i, "roi_id": n, "name": n, "class": c, "geometry": g} for i, (n, c, g) in enumerate(rois)])
    kind = f"array<struct<roi_index:int,roi_id:string,name:string,class:string,geometry:{G.GEOMETRY}>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), kind)))


@pytest.fixture(scope="module")
def two(spark):
    return frame(spark, [("tumour-1", "tumour", [[box(0, 0, 10, 10)]]), ("stroma-1", "stroma", [[box(20, 0, 30, 10)]])])


def one(df):
    return df.first().asDict()


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# geometry


def test_areas_centroids_boxes(spark):
    rois = frame(spark, [("square", None, [[box(0, 0, 10, 10)]]), ("donut", None, [[box(0, 0, 5, 5), box(2, 2, 3, 3)]]), ("two", None, [[box(0, 0, 1, 1)], [box(10, 0, 12, 1)]]), ("none", None, [])])
    got = {r["roi_id"]: r for r in regions.roi_table(rois, 0.5).collect()}
    assert [got[k]["area_px"] for k in ("square", "donut", "two", "none")] == [100, 24, 3, 0]
    assert got["square"]["area_um2"] == 25 and got["square"]["cx"] == got["square"]["cy"] == 5
    assert (got["donut"]["cx"], got["donut"]["xmax"]) == (2.5, 5) and got["two"]["cx"] == pytest.approx((0.5 * 1 + 11 * 2) / 3)
    assert got["none"]["cx"] is None and got["none"]["area_percent"] == 0


def test_low_edges_are_inside_and_high_ones_outside(spark, two):
    p = spark.createDataFrame([("a", 0.0, 0.0), ("b", 5.0, 0.0), ("c", 10.0, 5.0), ("d", 5.0, 10.0), ("e", 25.0, 5.0), ("f", 15.0, 5.0)], "k string, x double, y double")
    got = {r["k"]: r["roi_id"] for r in regions.associate(p, two).collect()}
    assert got == {"a": "tumour-1", "b": "tumour-1", "c": None, "d": None, "e": "stroma-1", "f": None}
    assert no_python(regions.associate(p, two))


def test_first_region_wins_and_lines_are_left_out(spark):
    rois = frame(spark, [("line", "x", []), ("a", "x", [[box(0, 0, 10, 10)]]), ("b", "y", [[box(5, 5, 20, 20)]])])
    p = spark.createDataFrame([(1, 7.0, 7.0), (2, 12.0, 12.0), (3, None, 1.0)], "k int, x double, y double")
    assert {r["k"]: r["roi_id"] for r in regions.associate(p, rois).collect()} == {1: "a", 2: "b", 3: None}
    assert {r["k"]: r["roi_id"] for r in regions.associate(p, rois, only=["b"]).collect()}[1] == "a"
    assert {r["k"]: r["roi_id"] for r in regions.associate(p, rois, include_all=False, only=["b"]).collect()}[1] == "b"
    assert regions.all_regions(p, rois).count() == 3


def test_association_with_many_regions_against_brute_force(spark, monkeypatch):
    r = random.Random(11)
    boxes = [(r.uniform(0, 1e4), r.uniform(0, 8e3), r.uniform(2, 900), r.uniform(2, 700)) for _ in range(300)]
    rois = frame(spark, [(f"r{i}", "c", [[box(x, y, x + w, y + h)]]) for i, (x, y, w, h) in enumerate(boxes)])
    points = [(i, r.uniform(0, 1.1e4), r.uniform(0, 9e3)) for i in range(1000)]
    want = {i: next((f"r{k}" for k, (x, y, w, h) in enumerate(boxes) if x <= px < x + w and y <= py < y + h), None) for i, px, py in points}
    df = spark.createDataFrame(points, "k int, x double, y double")
    assert {x["k"]: x["roi_id"] for x in regions.associate(df, rois).collect()} == want
    for limit in (0, 20_000):
        monkeypatch.setattr(regions, "MAX_BROADCAST_BYTES", limit)
        assert {x["k"]: x["roi_id"] for x in regions.associate(df, rois).collect()} == want


def test_regions_are_listed_in_four_cells_at_most(spark):
    sides = [(0, 0.0), (1, 0.0), (2, 1e-7), (3, 1.0), (4, 4.0), (5, 4.000001), (6, 20_000.0), (7, 1e6), (8, 10.0), (9, 63.9)]
    boxes = spark.createDataFrame([(i, 0.3, 0.3, 0.3 + s, 0.3 + s / 2) for i, s in sides], "roi_index int, xmin double, ymin double, xmax double, ymax double")
    level = {x["roi_index"]: x["level"] for x in regions.box_level(boxes).collect()}
    for i, s in sides:
        side = 4.0 ** level[i]
        assert side >= s and (side / 4 < s or level[i] == -10)
        assert (math.floor((0.3 + s) / side) - math.floor(0.3 / side) + 1) <= 2


def test_transforms(spark, two):
    assert G.orientation(100, 50, "horizontal", 0)[0] == [-1, 0, 100]
    for flip in ("none", "horizontal", "vertical", "both"):
        for turn in (0, 90, 180, 270):
            m = np.array(G.orientation(100, 50, flip, turn))
            corners = np.array([[0, 0, 1], [100, 0, 1], [100, 50, 1], [0, 50, 1]]) @ m.T
            w, h = (100, 50) if turn in (0, 180) else (50, 100)
            assert corners[:, 0].min() == corners[:, 1].min() == 0 and corners[:, 0].max() == w and corners[:, 1].max() == h
    moved = one(two.filter("roi_index = 0").select(G.bbox(G.affine(F.col("geometry"), G.translation(5, 7))).alias("b")))["b"]
    assert (moved["xmin"], moved["ymin"], moved["xmax"], moved["ymax"]) == (5, 7, 15, 17)
    assert one(spark.range(1).select(G.distance_um(F.lit(3.0), F.lit(4.0), 0.5, 0.5).alias("d")))["d"] == 2.5
    assert one(spark.range(1).select(G.area(G.circle(F.lit(1.0), F.lit(2.0), 1.0)).alias("a")))["a"] == pytest.approx(12 * math.sin(2 * math.pi / 24))


def test_landmarks_give_the_transform(spark):
    df = spark.createDataFrame([(0.0, 0.0, 5.0, 7.0), (10.0, 0.0, 15.0, 7.0), (0.0, 10.0, 5.0, 17.0)], "x double, y double, u double, v double")
    assert np.allclose(models.estimate_transform(df), [[1, 0, 5], [0, 1, 7], [0, 0, 1]])


def test_boundary_distances(spark, two):
    p = spark.createDataFrame([(1, 5.0, 5.0), (2, 15.0, 5.0), (3, 40.0, 5.0)], "k int, x double, y double")
    got = {r["k"]: (r["roi_id"], r["distance_px"], r["inside"]) for r in regions.cells_to_roi(p, two, "k").collect()}
    assert got == {1: ("tumour-1", 5, True), 2: ("tumour-1", 5, False), 3: ("stroma-1", 10, False)}
    assert one(regions.roi_distance(two))["distance_px"] == 10


def test_densities_and_counts(spark, two):
    cells = spark.createDataFrame([(1, 2.0, 2.0, 1.0), (2, 5.0, 5.0, 2.0), (3, 25.0, 5.0, 3.0), (4, 50.0, 50.0, 4.0)], "k int, x double, y double, marker double")
    got = {r["roi_id"]: (r["n"], r["density_px"]) for r in regions.cell_density(cells, two, 0.5).collect()}
    assert got == {"tumour-1": (2, 0.02), "stroma-1": (1, 0.01)}
    met = regions.associate(cells, two)
    assert {r["class"]: r["n"] for r in regions.class_counts(met, two).collect()} == {"tumour": 2, "stroma": 1, "unassigned": 1}
    assert {r["class"]: r["n_cells"] for r in regions.summarise_rois(two, cells).collect()} == {"tumour": 2, "stroma": 1}
    assert {r["k"]: r["annotation"] for r in regions.annotate(cells.drop("marker"), two).collect()}[4] == "Unassigned"


def test_footprints(spark):
    geometry = json.dumps([[box(0, 0, 100, 100), box(20, 20, 24, 24)]])
    rects = spark.createDataFrame([(0.0, 0.0), (15.0, 15.0), (40.0, 40.0), (95.0, 0.0), (90.0, 90.0)], "x double, y double").withColumn("width", F.lit(10.0)).withColumn("height", F.lit(10.0))
    got = regions.footprints_in_roi(rects, F.from_json(F.lit(geometry), G.GEOMETRY)).orderBy("x", "y").collect()
    assert [r["inside"] for r in got] == [True, False, True, True, False]


# neighbours


def test_nearest_against_brute_force(spark):
    r = random.Random(5)
    target = [(i, r.choice([r.uniform(0, 100), r.uniform(9_000, 9_100)]), r.uniform(0, 50)) for i in range(200)]
    query = [(i, r.uniform(-500, 12_000), r.uniform(-500, 500)) for i in range(150)]
    q, t = (spark.createDataFrame(x, "k int, x double, y double") for x in (query, target))
    want = {i: min((math.sqrt((x - u) ** 2 + (y - v) ** 2), j) for j, u, v in target) for i, x, y in query}
    got = {x["k"]: (x["distance_px"], x["nearest_id"]) for x in proximity.nearest(q, t, "k", "k").collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(got[k][0] == pytest.approx(want[k][0]) for k in want)
    none = proximity.nearest(q, t.filter("false"), "k", "k")
    assert none.count() == 150 and none.filter("nearest_id IS NOT NULL").count() == 0


def test_proximity_of_regions(spark):
    rois = frame(spark, [("q", "a", [[box(0, 0, 4, 4)]]), ("t", "b", [[box(9, 0, 14, 4)]])])
    p = spark.createDataFrame([("q1", 1.0, 1.0), ("q2", 2.0, 2.0), ("t1", 10.0, 1.0), ("t2", 12.0, 1.0), ("o", 50.0, 50.0), ("n", float("nan"), 1.0)], "id string, x double, y double")
    got = {r["id"]: (r["nearest_id"], r["distance_px"], r["distance_um"]) for r in proximity.proximity(p, rois, ["q"], ["t"], "id", (0.5, 0.5)).collect()}
    assert got["q1"] == ("t1", 9, 4.5) and set(got) == {"q1", "q2"}


def test_quantile_positions(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (100.0,)], "v double")
    got = {r["v"]: (r["position"], r["colour_index"]) for r in proximity.quantile_position(df, "v").collect()}
    assert got == {0.0: (0, 1), 1.0: (pytest.approx(1 / 3), 34), 2.0: (pytest.approx(2 / 3), 67), 100.0: (1, 101)}
    same = proximity.quantile_position(spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double"), "v").collect()
    assert sorted(str(r["position"]) for r in same) == ["0.5", "0.5", "None"]


def test_correlations_and_adjustment(spark):
    long = spark.createDataFrame([(i, f, v) for i in range(5) for f, v in (("up", float(i + 1)), ("down", float(5 - i)), ("flat", 2.0), ("odd", [0.3, 0.1, 0.4, 0.1, 0.5][i]))], "k int, feature string, value double")
    profile = spark.createDataFrame([(i, i / 4, i) for i in range(5)] + [(0, 0.9, 99), (None, 0.5, 7)], "k int, distance_fraction double, row int")
    got = {r["feature"]: r for r in proximity.trajectory(long, profile, "k").collect()}
    assert got["up"]["r"] == pytest.approx(1) and got["down"]["r"] == pytest.approx(-1) and "flat" not in got
    assert got["up"]["p"] < 1e-12 and got["odd"]["p_adjusted"] == pytest.approx(got["odd"]["p"])
    assert proximity.t_probability(0.5, 10) == pytest.approx(0.1411, abs=1e-4) and proximity.t_probability(0.9, 30) < 1e-9
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "feature string, p double")
    assert {r["feature"]: round(r["p_adjusted"], 6) for r in proximity.adjusted(p).collect()} == {"a": 0.04, "c": 0.053333, "b": 0.053333, "d": 0.5}


def test_binned_means(spark):
    df = spark.createDataFrame([(float(i), float(10 * i)) for i in range(11)], "d double, f double")
    got = proximity.binned(df, "d", ["f"], 0.5).orderBy("bin").collect()
    assert [(r["mid"], r["n"], r["f"]) for r in got] == [(2.5, 6, 25.0), (7.5, 5, 80.0)]


# tiles


def test_grids(spark):
    s = tiles.slide(spark, 1024, 1024, (1, 4))
    got = tiles.tile_grid(s, 512).orderBy("row", "col").collect()
    assert [(r["x"], r["y"]) for r in got] == [(0, 0), (512, 0), (0, 512), (512, 512)] and got[1]["tile_id"] == "L0_R00001_C00002"
    s = tiles.slide(spark, 2048, 2048, (1, 4))
    assert [(r["x"], r["y"]) for r in tiles.tile_grid(s, 256, level=1).orderBy("row", "col").collect()] == [(0, 0), (1024, 0), (0, 1024), (1024, 1024)]
    c = spark.createDataFrame([(0.0, 0.0), (900.0, 100.0)], "x double, y double")
    assert {r["x"]: r["width"] for r in tiles.grid_from_coords(c, 1000, 800, 200, bounds="trim").collect()} == {0: 200, 900: 100}
    assert tiles.grid_from_coords(c, 1000, 800, 200, bounds="drop").count() == 1
    with pytest.raises(Exception, match="beyond"):
        tiles.grid_from_coords(c, 1000, 800, 200).collect()


def test_sampling_balancing_splitting(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0] if i < 97 else None) for i in range(100)], "k int, class string")
    got = tiles.balance(df, "k").groupBy("class").count().collect()
    assert {r["class"]: r["count"] for r in got} == {"a": 3, "b": 3, "unlabelled": 3}
    assert tiles.balance(df, "k", per_class=10).groupBy("class").count().filter("class = 'a'").first()["count"] == 10
    split = tiles.split(df, "k", {"train": 0.8, "test": 0.2})
    assert split.count() == 100 and {(r["class"], r["split"]): r["count"] for r in split.groupBy("class", "split").count().collect()}[None, "test"] == 1
    assert sorted(tiles.split(df.repartition(7), "k", {"train": 0.8, "test": 0.2}).collect()) == sorted(split.collect())
    assert tiles.sample_rows(df, 10, "k").count() == 10
    sizes = spark.createDataFrame([(1,), (2,), (3,), (10,)], "n long")
    got = {r["n"]: (r["n_a"], r["n_b"], r["n_c"]) for r in tiles.split_counts(sizes, {"a": 0.6, "b": 0.3, "c": 0.1}).collect()}
    assert got == {1: (1, 0, 0), 2: (1, 1, 0), 3: (1, 1, 1), 10: (5, 3, 2)}


def test_review_plan(spark):
    obs = spark.createDataFrame([(f"{t}{x}", t, float(x), 20.0) for t in "ab" for x in (10, 20, 130, 290)], "id string, tissue_id string, x double, y double")
    images = spark.createDataFrame([("a", 300.0, 240.0, 0.5), ("b", 300.0, 240.0, 0.5)], "tissue_id string, width double, height double, mpp_x double")
    plan = tiles.review_plan(obs, images, 112.0).collect()
    assert sorted((r["tissue_id"], r["x"], r["n"]) for r in plan) == [("a", 0, 2), ("a", 112, 1), ("b", 0, 2), ("b", 112, 1)]
    again = tiles.review_plan(obs.orderBy(F.desc("id")), images, 112.0).collect()
    assert {r["plan_id"] for r in plan} == {r["plan_id"] for r in again}
    assert tiles.review_plan(obs, images, 112.0, units="um", bounds="trim").filter("x = 224 AND tissue_id = 'a'").first()["width"] == 76
    with pytest.raises(ValueError):
        tiles.review_plan(obs, images, 112.0, max_tiles=1)


# pixels


def image(spark, arrays, tile="t"):
    r, g, b = arrays
    rows = [(tile, i, j, float(r[i, j]), float(g[i, j]), float(b[i, j])) for i in range(r.shape[0]) for j in range(r.shape[1])]
    return spark.createDataFrame(rows, "tile_id string, row int, col int, r double, g double, b double")


def test_whitespace_and_artifacts(spark):
    flat = lambda v: np.full((8, 8), v)
    white, tissue = image(spark, [flat(1.0)] * 3, "w"), image(spark, [flat(0.68), flat(0.34), flat(0.58)], "p")
    got = {r["tile_id"]: r["whitespace"] for r in P.whitespace(white.union(tissue)).collect()}
    assert got == {"w": True, "p": False}
    t = spark.createDataFrame([("w",), ("p",), ("gone",)], "tile_id string")
    assert [r["tile_id"] for r in P.flag_whitespace(t, white.union(tissue), "drop").collect()] == ["p"]
    a = {r["tile_id"]: r for r in P.artifacts(white.union(tissue)).collect()}
    assert a["w"]["too_bright"] and a["w"]["blur"] and a["w"]["out_of_focus"] and a["w"]["artifact_score"] == pytest.approx(3 / 7) and a["p"]["edge_strength"] == 0
    assert no_python(P.artifacts(white))


def test_focus_against_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.random((3, 9, 7))
    g = 0.299 * a[0] + 0.587 * a[1] + 0.114 * a[2]
    lap = np.zeros_like(g)
    lap[1:-1, 1:-1] = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    got = one(P.focus(image(spark, a)))
    assert got["laplacian_variance"] == pytest.approx(lap.var(ddof=1)) and got["contrast"] == pytest.approx(g.std(ddof=1))


def test_stains_come_back(spark):
    rng = np.random.default_rng(2)
    m = P.basis(P.HEMATOXYLIN, P.EOSIN)
    c = rng.uniform(0.05, 0.9, (2, 6, 6))
    rgb = np.exp(-np.einsum("jk,kab->jab", m[:, :2], c))
    df = image(spark, rgb)
    got = P.deconvolved_he(df).orderBy("row", "col").collect()
    assert np.allclose([r["hematoxylin"] for r in got], c[0].ravel()) and np.allclose([r["residual"] for r in got], 0, atol=1e-9)
    back = P.reconstructed(P.deconvolved(df, m, ("a", "b", "z"), ("tile_id", "row", "col")), m, ("a", "b", "z"), ("tile_id", "row", "col")).orderBy("row", "col").collect()
    assert np.allclose([r["r"] for r in back], rgb[0].ravel())
    est = P.estimated_basis(df, od_threshold=0.0)
    assert abs(est[:, 0] @ m[:, 0]) > 0.95 and abs(est[:, 1] @ m[:, 1]) > 0.9
    with pytest.raises(ValueError):
        P.basis(P.EOSIN, P.EOSIN)


def test_stain_intensity(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 10.0), ("a", float("nan")), ("b", 3.0)], "k string, value double")
    got = {r["k"]: r for r in P.stain_intensity(df, ["k"], 2.0).collect()}
    assert (got["a"]["n"], got["a"]["p10"], got["a"]["positive_fraction"]) == (4, pytest.approx(1.3), 0.75) and got["b"]["sd"] == 0


def test_class_median_is_a_weighted_mean(spark):
    df = spark.createDataFrame([("r1", "c", 1.0, 0.2)] * 3 + [("r2", "c", 0.0, 0.6)], "roi_id string, class string, hematoxylin double, dab double")
    got = one(P.ihc_classes(P.ihc_intensity(df)))
    assert got["dab_median"] == pytest.approx(0.3) and got["hematoxylin_mean"] == 0.75 and got["positive"] == 4


def test_otsu_and_pyramid(spark):
    df = spark.createDataFrame([("t", v) for v in [0.1] * 5 + [0.9] * 5], "tile_id string, v double")
    assert 0.1 < one(P.otsu(df, "v", ["tile_id"]))["threshold"] <= 0.9
    a = np.arange(16).reshape(4, 4) / 16
    got = P.pyramid_step(image(spark, [a, a, a])).orderBy("row", "col").collect()
    assert [round(r["r"] * 16, 6) for r in got] == [2.5, 4.5, 10.5, 12.5]
    assert one(P.pyramid_step(image(spark, [a, a, a]), "nearest").orderBy("row", "col"))["r"] == 0


# masks


def mask_of(spark, grid, name="m"):
    rows = [(name, int(r), int(c), int(grid[r, c])) for r, c in zip(*np.nonzero(grid))]
    return spark.createDataFrame(rows, "mask_id string, row int, col int, label int")


def test_components_and_contours(spark):
    g = np.zeros((6, 8), dtype=int)
    g[1:4, 2:5] = 1
    got = masks.mask_to_rois(mask_of(spark, g), 2.0, (10.0, 20.0)).select("area", G.bbox(F.col("geometry")).alias("b"), G.area(F.col("geometry")).alias("a")).collect()
    assert len(got) == 1 and got[0]["area"] == 9 and got[0]["a"] == 36 and tuple(got[0]["b"]) == (14, 22, 20, 28)
    g = np.array([[1, 0, 2, 2], [0, 1, 0, 0], [0, 0, 0, 1]])
    eight, four = (masks.mask_components(mask_of(spark, g), 1, e).collect() for e in (True, False))
    assert sorted((r["label"], r["area"]) for r in eight) == [(1, 2), (1, 1), (2, 2)] or sorted((r["label"], r["area"]) for r in eight) == [(1, 1), (1, 2), (2, 2)]
    assert len(four) == 4


def test_mask_round_trip_with_holes(spark):
    rois = V.rois(spark, "/root/testdata/sf0.01")
    mask = masks.rois_to_mask(rois, 100, 80, 10.0).withColumn("mask_id", F.lit("m"))
    back = masks.mask_to_rois(mask, 10.0).withColumnRenamed("label", "roi_index").withColumn("roi_id", F.col("roi_index").cast("string")).withColumn("class", F.lit(None).cast("string"))
    again = masks.rois_to_mask(back.select(F.col("roi_index") - 1, "roi_id", "class", "geometry").toDF("roi_index", "roi_id", "class", "geometry"), 100, 80, 10.0)
    assert sorted(again.collect()) == sorted(mask.select("row", "col", "label").collect())
    with pytest.raises(Exception, match="overlap"):
        masks.rois_to_mask(rois, 100, 80, 10.0, "error").collect()


def test_components_against_union_find():
    rng = np.random.default_rng(3)
    for eight in (True, False):
        g = rng.random((20, 15)) < 0.5
        n = masks.components(g, eight)
        assert ((n > 0) == g).all()
        for r, c in zip(*np.nonzero(g)):
            for i, j in ((0, 1), (1, 0), (1, 1), (1, -1)):
                if (eight or not (i and j)) and 0 <= r + i < 20 and 0 <= c + j < 15 and g[r + i, c + j]:
                    assert n[r, c] == n[r + i, c + j]
        firsts = [np.flatnonzero(n.T.ravel() == k)[0] for k in range(1, n.max() + 1)]
        assert firsts == sorted(firsts)


def test_candidates(spark):
    a = np.full((3, 30, 30), 0.5)
    yy, xx = np.mgrid[:30, :30]
    a[:, (yy - 10) ** 2 + (xx - 10) ** 2 <= 16] = 0.95
    a[:, 22:24, 22:24] = 0.1
    bubble, dust = one(candidates.detect(image(spark, a), "bubble")), one(candidates.detect(image(spark, a), "dust"))
    assert (bubble["objects"], bubble["candidate"]) == (1, True) and (dust["objects"], dust["n"]) == (1, 4)
    a[2, 5:8, 2:28], a[0, 5:8, 2:28], a[1, 5:8, 2:28] = 0.9, 0.1, 0.1
    assert one(candidates.detect(image(spark, a), "pen"))["n"] >= 3 * 26
    a[0], a[1], a[2] = 0.4, 0.05, 0.3
    a[:, :, 15:] = 0.8
    assert one(candidates.detect(image(spark, a), "fold"))["fraction"] == pytest.approx(0.5)


# cell index, review, streams


def index(spark, n=100):
    rows = [(i, f"c{i}", 2.0 * i, 10.0) for i in range(1, n + 1)]
    cells = spark.createDataFrame(rows, "row_id long, cell_id string, x double, y double").selectExpr("*", "x - 0.5 AS xmin", "y - 0.5 AS ymin", "x + 0.5 AS xmax", "y + 0.5 AS ymax", "to_json(struct(x, y)) AS raw_json")
    predictions = cells.selectExpr("row_id", "'m' AS model_id", "'predicted' AS status", "IF(row_id % 2 = 1, 'B', 'A') AS label", f"row_id / {n + 1} AS probability")
    return cells, predictions


def test_cell_index(spark):
    cells, predictions = index(spark)
    assert {r["label"]: r["n"] for r in cellindex.summary(predictions, "m").collect()} == {"A": 50, "B": 50}
    seen = cellindex.viewport(cells, predictions, "m", (0, 0, 20.2, 20), "__review__", 0.05).collect()
    assert sorted(r["row_id"] for r in seen) == [1, 2, 3, 4, 5]
    assert [r["row_id"] for r in cellindex.queue(cells, predictions, "m", "A", 0.5, 3).collect()] == [2, 4, 6]
    ordered, scope, got, cursor = cellindex.scoped(cells, predictions, "m").withColumn("score", F.coalesce("probability", F.lit(-1.0))), cellindex.scope_digest(a=1), [], None
    while True:
        rows, cursor = cellindex.page(ordered, scope, 30, cursor)
        got += [r["row_id"] for r in rows.collect()]
        if cursor is None:
            break
    assert got == list(range(1, 101))
    with pytest.raises(ValueError):
        cellindex.page(ordered, "other", 30, {"scope": scope, "score": 0, "row_id": 0})
    assert cellindex.density(cells, (0, 0, 64, 64)).agg(F.sum("n")).first()[0] == 32
    assert cellindex.mismatches(cells, predictions.filter("row_id <> 7")).collect() == [(7, "other")]
    assert cellindex.display_points(cells).count() == 100
    with pytest.raises(Exception, match="no cell"):
        cellindex.cells_by_id(cells, spark.createDataFrame([("c1",), ("zz",)], "cell_id string")).collect()


def test_review(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "id int, v string")
    a, b = one(review.signature(df)), one(review.signature(df.repartition(9).orderBy(F.desc("id"))))
    assert a == b and a["rows"] == 50 and one(review.signature(df.filter("id <> 3")))["signature"] != a["signature"] != one(review.signature(df.withColumn("v", F.lit("x"))))["signature"]
    ledger = spark.createDataFrame([("c", 1, "d1", "s1"), ("c", 3, "d3", "s3"), ("c", 3, "d3", "s3"), ("c", 2, "d2", "s2")], "context_id string, revision int, digest string, state string")
    assert one(review.commit_checkpoints(ledger))["state"] == "s3"
    with pytest.raises(Exception, match="two states"):
        review.commit_checkpoints(ledger.union(spark.createDataFrame([("c", 3, "zz", "s")], ledger.schema))).collect()
    with pytest.raises(ValueError):
        review.matched(ledger, ledger, "context_id")
    asked = spark.createDataFrame([("CD3E",), ("cd4",), ("HLA.A",), ("p53",), ("none",)], "name string")
    known = spark.createDataFrame([("CD3E",), ("CD4",), ("HLA-A",), ("TP53",)], "feature string")
    alias = spark.createDataFrame([("p53", "TP53")], "alias string, feature string")
    assert {r["name"]: (r["feature"], r["rank"]) for r in review.gene_match(asked, known, alias).collect()} == {"CD3E": ("CD3E", 0), "cd4": ("CD4", 1), "HLA.A": ("HLA-A", 2), "p53": ("TP53", 3), "none": (None, None)}
    rois = V.rois(spark, "/root/testdata/sf0.01").filter("roi_index < 6")
    assert {r["roi_id"] for r in review.exported(review.set_class(rois, "Artefact ", ["ell"]), review.default_presets(spark)).collect()} == {"donut", "triangle", "pair", "wide", "line"}
    with pytest.raises(ValueError):
        review.set_class(rois, "x", ["nobody"])
    assert {r["field"] for r in review.cluster_fields(spark.createDataFrame([(i, "ab"[i % 2], float(i)) for i in range(20)], "id int, kind string, v double"), "id").collect()} == {"kind"}
    assert one(spark.range(1).select(S.colour(F.lit("#abc")).alias("a"), S.colour(F.lit(0x112233)).alias("b"), S.colour(F.lit("zz")).alias("c"))) == {"a": "#AABBCC", "b": "#112233", "c": None}


def test_patches_as_a_stream(spark, tmp_path):
    rows = [("a", 1, "upsert", "k1", "x"), ("a", 2, "upsert", "k2", "y"), ("a", 3, "remove", "k1", None), ("a", 4, "upsert", "k2", "z"), ("b", 5, "upsert", "k3", "w")]
    source = str(tmp_path / "in")
    for k in (0, 3):
        spark.createDataFrame(rows[k : k + 3], patches.SCHEMA).coalesce(1).write.mode("append").parquet(source)
        patches.run(spark.readStream.schema(patches.SCHEMA).parquet(source), str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    want = {"k2": "z", "k3": "w"}
    assert {r["key"]: r["payload"] for r in patches.state(spark, str(tmp_path / "table"), 1).collect()} == want
    everything = spark.createDataFrame(rows * 3, patches.SCHEMA)
    assert {r["key"]: r["payload"] for r in patches.latest(everything).collect()} == want
    assert [r["client"] for r in patches.gaps(everything).collect()] == ["b"]


# models


def test_recipe_uses_training_rows_alone(spark):
    train = spark.createDataFrame([([1.0, 5.0, None],), ([1.0, 7.0, 3.0],), ([1.0, 9.0, 5.0],)], "v array<double>")
    r = models.fit_recipe(train, "v")
    assert r.at == [1, 2] and r.mean == [7.0, 4.0]
    got = models.apply_recipe(train, r, "v").collect()
    assert got[0]["x"] == [pytest.approx(-1.0), 0.0]


def test_classifier_separates_classes(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "abc"[i % 3], [float(x) for x in rng.normal(0, 1, 6) + 4 * np.eye(6)[i % 3]]) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, label string, v array<double>")
    model = models.train(df.filter("id < 90"), "v", "label", 2)
    got = models.predict(model, df.filter("id >= 90"), "v").collect()
    assert np.mean([r["predicted"] == r["label"] for r in got]) > 0.9 and all(0 <= r["probability"] <= 1 for r in got)
    with pytest.raises(ValueError):
        models.train(df.filter("label = 'a'"), "v", "label")


# sources


def test_geojson_round_trip(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": 'a"1', "properties": {"name": "n", "classification": {"name": "tumour", "color": [255, 0, 16]}, "isLocked": True}, "geometry": {"type": "Polygon", "coordinates": [box(0, 0, 5, 5), box(2, 2, 3, 3)]}},
        {"type": "Feature", "properties": {"class": "x"}, "geometry": {"type": "MultiPolygon", "coordinates": [[box(0, 0, 1, 1)], [box(4, 4, 5, 5)]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "Polygon", "coordinates": [box(0, 0, 2, 2)]}))
    got = tables.read_geojson(spark, str(tmp_path / "a.geojson")).orderBy("roi_index").collect()
    assert [r["roi_id"] for r in got] == ['a"1', "roi_2", "roi_3"] and got[0]["color"] == "#FF0010" and got[0]["is_locked"] and got[1]["class"] == "x" and got[2]["geometry"] == []
    assert len(tables.read_geojson(spark, str(tmp_path / "b.geojson")).collect()) == 1
    tables.write_geojson(tables.read_geojson(spark, str(tmp_path / "a.geojson")).filter("size(geometry) > 0").coalesce(1), str(tmp_path / "out"))
    back = tables.read_geojson(spark, str(tmp_path / "out")).orderBy("roi_index").collect()
    assert [r["geometry"] for r in back] == [r["geometry"] for r in got[:2]] and [r["roi_id"] for r in back] == ['a"1', "roi_2"] and back[0]["class"] == "tumour"


def test_point_tables(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Cell_ID,Centroid_X,Y,k\na,1,2,z\nb,NA,3,z\n")
    got = tables.read_points(spark, str(tmp_path / "p.csv")).collect()
    assert [(r["id"], r["x"], r["y"], r["k"]) for r in got] == [("a", 1.0, 2.0, "z")]
    for name, head in (("h.csv", "barcode,in_tissue,array_row,array_col,pxl_row_in_fullres,pxl_col_in_fullres\n"), ("n.csv", "")):
        (tmp_path / name).write_text(head + "AAA,1,0,2,30,40\n")
        assert [(r["id"], r["x"], r["y"]) for r in tables.read_tissue_positions(spark, str(tmp_path / name)).collect()] == [("AAA", 40, 30)]
    with pytest.raises(ValueError):
        tables.resolved(spark.range(1))


def test_images_projects_and_levels(spark, tmp_path):
    (tmp_path / "t.ppm").write_bytes(b"P6\n2 1\n255\n" + bytes([255, 0, 0, 0, 0, 51]))
    got = tables.read_pixels(spark, str(tmp_path)).orderBy("col").collect()
    assert [(r["r"], r["b"]) for r in got] == [(1, 0), (0, 0.2)]
    tables.save_project({"rois": V.rois(spark, "/root/testdata/sf0.01").filter("roi_index < 6"), "other": spark.range(3)}, str(tmp_path / "p"), {"a": 1})
    assert {k: v.count() for k, v in tables.read_project(spark, str(tmp_path / "p")).items()} == {"rois": 6, "other": 3}
    meta = {"multiscales": [{"axes": [{"name": "y", "type": "space"}, {"name": "x", "type": "space"}], "datasets": [{"path": str(k), "coordinateTransformations": [{"type": "scale", "scale": [0.5 * 2**k, 0.25 * 4**k]}]} for k in range(3)]}]}
    text = spark.createDataFrame([("z", json.dumps(meta))], "path string, value string")
    assert [r["downsample"] for r in tables.omezarr_levels(text).orderBy("level").collect()] == [1, 4, 16]


def test_entry_and_registered_queries(spark):
    import __spark_entry__ as e

    # a region a supplier; every sixth shape is a line without area
    suppliers = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").select("s_suppkey").collect()]
    got = {(r["roi_index"], r["n"]) for r in e.entry(spark).collect()}
    held = duckdb.connect()
    for name in ("supplier", "events"):
        held.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    want = held.execute(f"SELECT roi_index, n FROM ({e.oracle_sql()['f1_cell_density']})").fetchall()
    assert got == set(want) and len(got) == sum(k % 6 != 5 for k in suppliers)
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.oracle_sql()) > 50
