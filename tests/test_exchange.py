"""Files that go out and come back: GeoJSON with its properties, experiments; and small rules of options, ledgers and matrices."""

import hashlib
import json

import pytest

from slidelake.operators import experiment, pixels, review, slides
from slidelake.sources import tables


def square(x):
    return [[x, 0.0], [x + 1, 0.0], [x + 1, 1.0], [x, 1.0], [x, 0.0]]


def test_geojson_keeps_properties_and_is_read_by_lines(spark, tmp_path):
    features = [
        {"type": "Feature", "id": "a", "properties": {"name": "é, \"q\"", "score": 1.5, "tags": ["x", None], "classification": {"name": "tumour", "colorRGB": -65536, "kept": 1}, "isLocked": True}, "geometry": {"type": "Polygon", "coordinates": [square(0.25)]}},
        {"type": "Feature", "id": "b", "properties": None, "geometry": {"type": "MultiPolygon", "coordinates": [[square(2.0)], [square(9.0)]]}},
        {"type": "Feature", "id": "c", "properties": {"class": "old"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]
    (tmp_path / "in.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = tables.read_geojson(spark, str(tmp_path / "in.geojson"))
    tables.write_geojson(got.repartition(2, "roi_id"), str(tmp_path / "out"))
    documents = [json.loads(f.read_text()) for f in (tmp_path / "out").glob("part-*") if f.stat().st_size]
    back = {f["id"]: f for d in documents for f in d["features"]}
    assert set(back) == {"a", "b", "c"} and {d["type"] for d in documents} == {"FeatureCollection"}
    first = back["a"]["properties"]
    assert first["score"] == 1.5 and first["tags"] == ["x", None] and first["isLocked"] is True and first["name"] == 'é, "q"'
    assert first["classification"] == {"kept": 1, "name": "tumour", "color": [255, 0, 0]}
    assert back["c"]["geometry"] is None and back["c"]["properties"]["class"] == "old"
    by_line = {r["roi_id"]: r for r in tables.read_geojson_lines(spark, str(tmp_path / "out")).collect()}
    assert {k: (r["name"], r["class"], r["geometry"]) for k, r in by_line.items()} == {r["roi_id"]: (r["name"], r["class"], r["geometry"]) for r in got.collect()}
    assert len({r["roi_index"] for r in by_line.values()}) == 3 and by_line["a"]["color"] == "#FF0000"
    changed = got.selectExpr("* EXCEPT (class)", "'new' AS class")
    tables.write_geojson(changed.coalesce(1), str(tmp_path / "changed"))
    assert {r["class"] for r in tables.read_geojson(spark, str(tmp_path / "changed")).collect()} == {"new"}


def test_lines_that_are_no_features(spark, tmp_path):
    (tmp_path / "s.geojsons").write_text("\x1e" + json.dumps({"type": "Feature", "id": "a", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [square(0)]}}) + "\n\n")
    assert [r["roi_id"] for r in tables.read_geojson_lines(spark, str(tmp_path / "s.geojsons")).collect()] == ["a"]
    (tmp_path / "broken.geojson").write_text('{"type":"Feature","id":\n')
    with pytest.raises(Exception, match="not a feature"):
        tables.read_geojson_lines(spark, str(tmp_path / "broken.geojson")).collect()
    tables.write_geojson(tables.read_geojson_lines(spark, str(tmp_path / "s.geojsons")).limit(0), str(tmp_path / "none"))
    assert tables.read_geojson_lines(spark, str(tmp_path / "none")).count() == 0


def made(tmp_path, files):
    tissues = []
    for tissue, text in files.items():
        (tmp_path / f"{tissue}.csv").write_text(text)
        digest = hashlib.sha256(text.encode()).hexdigest()
        image = {"sha256": "0", "width": 10, "height": 8, "mpp_x": 0.5, "mpp_y": 0.5, "frame_id": "f", "coordinate_convention": "xy"}
        tissues.append({"tissue_id": tissue, "image": image, "feature_sets": [{"id": "fs", "path": f"{tissue}.csv", "sha256": digest, "unit": "cell"}]})
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "experiment_id": "e1", "tissues": tissues}))
    return str(tmp_path / "m.json")


def test_features_of_all_tissues_at_once(spark, tmp_path):
    table = experiment.read_experiment(spark, made(tmp_path, {"t 1+": "id,f1,f.2\na,1,2\nb,x,4\n", "t2": "id,f1,f.2\na,5,6\n"}))
    got = {r["id"]: (r["tissue_id"], r["features"]) for r in experiment.experiment_features(spark, str(tmp_path), table, "fs").collect()}
    assert got == {"t%201%2B::a": ("t 1+", [1.0, 2.0]), "t%201%2B::b": ("t 1+", [None, 4.0]), "t2::a": ("t2", [5.0, 6.0])}
    assert experiment.experiment_features(spark, str(tmp_path), table, "other") is None
    tables.experiment_project(table, str(tmp_path / "project"))
    held = tables.read_project(spark, str(tmp_path / "project"))
    assert sorted(r["tissue_id"] for r in held["images"].collect()) == ["t 1+", "t2"] and held["feature_sets"].count() == 2


def test_features_whose_names_differ(spark, tmp_path):
    table = experiment.read_experiment(spark, made(tmp_path, {"t1": "id,f1,f2\na,1,2\n", "t2": "id,f2,f1\na,5,6\n"}))
    with pytest.raises(Exception, match="(?i)header"):
        experiment.experiment_features(spark, str(tmp_path), table, "fs").collect()


def test_options_are_checked():
    assert vars(pixels.WhitespaceOptions(bright=1))["bright"] == 1
    for make in (lambda: pixels.WhitespaceOptions(pale=1.1), lambda: pixels.WhitespaceOptions(fraction=-0.1), lambda: pixels.ArtifactOptions(blur=float("nan")), lambda: pixels.ArtifactOptions(dark="0.1")):
        with pytest.raises(ValueError):
            make()
    assert pixels.ArtifactOptions(pen_dominance=2.5).pen_dominance == 2.5


def test_options_reach_the_measures(spark):
    p = spark.createDataFrame([("a", 0, 0, 0.9, 0.9, 0.9), ("a", 0, 1, 0.9, 0.2, 0.2)], "tile_id string, row int, col int, r double, g double, b double")
    assert pixels.artifacts(p, **vars(pixels.ArtifactOptions())).first()["pen"] and not pixels.artifacts(p, **vars(pixels.ArtifactOptions(pen_fraction=0.6))).first()["pen"]
    assert pixels.whitespace(p, **vars(pixels.WhitespaceOptions(fraction=0.5))).first()["whitespace"] and not pixels.whitespace(p).first()["whitespace"]


def test_latest_label_with_ties(spark):
    rows = [("a", 1, "confirmed", "x"), ("a", 2, "confirmed", "y"), ("a", 2, "confirmed", "z"), ("b", 3, "confirmed", "x"), ("b", 4, "rejected", None), ("c", None, "confirmed", "q")]
    got = review.confirmed(spark.createDataFrame(rows, "id string, updated_at long, status string, label string")).collect()
    assert {(r["id"], r["label"]) for r in got} == {("a", "z"), ("c", "q")}


def test_matrix_with_gaps_and_repeated_places(spark):
    rows = [(1, 3, 0.5), (1, 1, None), (3, 2, 0.25), (3, 2, 0.75), (0, 1, 9.0), (None, None, 1.0)]
    got = slides.matrix(spark.createDataFrame(rows, "row int, col int, v double"), "v").orderBy("row").collect()
    assert [(r["row"], r["values"]) for r in got] == [(1, [None, None, 0.5]), (3, [None, 0.75, None])]
    assert slides.matrix(spark.createDataFrame([], "row int, col int, v double"), "v").collect() == []
