"""Operators whose results SQL does not hold: images, heatmaps, checkpoints, colours, files."""

import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidelake.operators import experiment, masks, models, review, scope, slides
from slidelake.operators import pixels as P
from slidelake.sources import tables


@pytest.fixture(scope="module")
def levels(spark):
    rows = [("s", 0, r, c, r / 255, c / 255, 1.0) for r in range(20) for c in range(30)]
    return spark.createDataFrame(rows, "slide_id string, level int, row int, col int, r double, g double, b double")


def test_tiles_leave_as_images_and_come_back(spark, levels, tmp_path):
    grid = spark.createDataFrame([("s", "a", 2.0, 3.0, 4, 5, 0, 1.0), ("s", "b", 28.0, 18.0, 4, 4, 0, 1.0)], "slide_id string, tile_id string, x double, y double, width int, height int, level int, downsample double")
    manifest = {r["tile_id"]: r for r in slides.export_tiles(levels, grid, str(tmp_path / "t")).collect()}
    want = b"P6 4 5 255\n" + bytes(v for r in range(3, 8) for c in range(2, 6) for v in (r, c, 255))
    assert (manifest["a"]["bytes"], manifest["a"]["sha256"]) == (len(want), hashlib.sha256(want).hexdigest())
    assert (manifest["b"]["width"], manifest["b"]["height"]) == (2, 2)
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.ppm").write_bytes(want)
    back = {(r["row"], r["col"]): (r["r"], r["g"]) for r in tables.read_pixels(spark, str(tmp_path / "p")).collect()}
    assert back[0, 0] == pytest.approx((3 / 255, 2 / 255)) and len(back) == 20
    with pytest.raises(ValueError):
        slides.read_region(levels, 0, 0, 0, 5)


def test_tissue_and_mask_files_become_regions(spark, levels, tmp_path):
    white = levels.select(F.col("slide_id").alias("tile_id"), "row", "col", *[F.when((F.col("row") < 5) & (F.col("col") < 6), 0.4 if c == "r" else 0.1).otherwise(1.0).alias(c) for c in "rgb"])
    for method in ("simple", "otsu"):
        (r,) = slides.tissue_regions(white, method, least_area=10, scale=2.0).collect()
        assert r["area"] == 30 and max(p[0] for p in r["geometry"][0][0]) == 12.0
    (tmp_path / "m.pgm").write_bytes(b"P5 3 2 255\n" + bytes([0, 7, 7, 0, 0, 9]))
    mask = tables.read_masks(spark, str(tmp_path))
    assert sorted((r["row"], r["col"], r["label"]) for r in mask.collect()) == [(0, 1, 7), (0, 2, 7), (1, 2, 9)]
    assert masks.mask_to_rois(mask).count() == 2


def test_candidate_heatmap_has_all_tiles(spark, levels):
    grid = spark.createDataFrame([("s", 1, 1), ("t", 1, 3)], "tile_id string, row int, col int")
    held = slides.candidate_heatmap(grid, levels.select(F.col("slide_id").alias("tile_id"), "row", "col", *"rgb"), "dust")
    assert held.count() == 2
    (row,) = slides.matrix(held, "fraction").collect()
    assert len(row["values"]) == 3 and row["values"][1] is None and row["values"][2] is None


def test_checkpoints_belong_to_their_context(spark, tmp_path):
    seen = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, x double")
    sig = review.signature(seen)
    records = spark.createDataFrame([("a", "confirmed", "T", "me", "2020", "set")], "id string, status string, label string, reviewer string, updated_at string, action string")
    review.write_checkpoint(review.checkpoint("c", sig, seen.filter("id = 'b'"), records, 3), str(tmp_path / "k"))
    (got,) = review.read_checkpoint(spark, str(tmp_path / "k"), "c", sig, seen).collect()
    assert got["selected_ids"] == ["b"] and got["revision"] == 3 and got["records"][0]["label"] == "T"
    for name, context, observations in (("d", sig, seen), ("c", review.signature(seen.limit(1)), seen), ("c", sig, seen.filter("id = 'b'"))):
        with pytest.raises(Exception, match="checkpoint"):
            review.read_checkpoint(spark, str(tmp_path / "k"), name, context, observations).collect()


def test_classifier_files(spark, tmp_path):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(v) for v in r.normal(i % 2 * 3, 1, 5)], i % 2) for i in range(40)], "id long, f array<double>, y int")
    model = models.train(df, "f", "y", components=2)
    models.write_classifier(spark, model, str(tmp_path / "m"))
    a, b = (models.predict(m, df, "f").orderBy("id").select("predicted", "probability").collect() for m in (model, models.read_classifier(spark, str(tmp_path / "m"))))
    assert a == b


def test_gradient_and_stains(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (float("nan"),), (None,)], "v double")
    assert [r["color"] for r in experiment.gradient(df, "v").collect()] == ["#2B6CB0", "#F8FAFC", "#B91C1C", "#999999", "#999999"]
    assert {r["color"] for r in experiment.gradient(df.filter("v = 5"), "v").collect()} == {"#2B6CB0"}
    names = [r["name"] for r in P.he_stain_channels(spark).orderBy("channel_index").collect()]
    assert names == ["Hematoxylin", "Eosin", "Residual"]
    with pytest.raises(ValueError):
        P.estimated_basis(df, "unheard of")


def test_feature_partitions_are_checked(spark):
    data = struct.pack("<6f", 1, 2, 3, 4, 5, 6)
    made = lambda digest, rows: spark.createDataFrame([("p", data, digest, rows)], "path string, content binary, sha256 string, rows array<int>")
    good = hashlib.sha256(data).hexdigest()
    assert [(r["row"], r["features"]) for r in experiment.partition_features(made(good, [2, 0]), 2).collect()] == [(2, [5.0, 6.0]), (0, [1.0, 2.0])]
    for digest, rows in (("00", [0]), (good, [3])):
        with pytest.raises(Exception, match="hash differs|has 3 rows"):
            experiment.partition_features(made(digest, rows), 2).collect()


def test_registrations_and_training_conflicts(spark):
    kind = "struct<sha256:string,width:int,height:int,mpp_x:double,mpp_y:double,coordinate_convention:string,frame_id:string>"
    image = lambda frame: ("h", 5, 5, 0.5, 0.5, "edge", frame)
    unit = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    pairs = lambda *rows: spark.createDataFrame(list(rows), f"source {kind}, target {kind}, registration struct<source_frame_id:string,target_frame_id:string,affine:array<array<double>>>")
    assert scope.checked_registration(pairs((image("a"), image("a"), None), (image("a"), image("b"), ("a", "b", unit)))).count() == 2
    with pytest.raises(Exception, match="identity"):
        scope.checked_registration(pairs((image("a"), image("b"), None))).collect()
    square = [[[[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0], [0.0, 0.0]]]]
    rois = spark.createDataFrame([(0, "a", "a", "T", square), (1, "b", "b", "S", square)], "roi_index int, roi_id string, name string, class string, geometry array<array<array<array<double>>>>")
    points = spark.createDataFrame([(1, 5.0, 5.0, 2.0, 2.0), (2, 8.5, 5.0, 2.0, 2.0), (3, 20.0, 5.0, 2.0, 2.0)], "id long, x double, y double, width double, height double")
    got = {r["id"]: (r["label"], r["accepted"]) for r in scope.roi_training(points, rois, ["roi:a"]).collect()}
    assert got == {1: ("T", True), 2: ("T", False)}
    with pytest.raises(Exception, match="two labels"):
        scope.roi_training(points, rois, ["roi:a", "roi:b"]).collect()
