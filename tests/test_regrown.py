"""Steps whose work or memory grew faster than their input: report by region, focus, boundaries, index checks."""

import numpy as np
from pyspark.sql import functions as F

from slidelake.operators import cellindex, experiment, pixels, regions

ROIS = "roi_index int, roi_id string, name string, class string, geometry array<array<array<array<double>>>>"


def box(x0, y0, x1, y1):
    return [[[[float(a), float(b)] for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]]]


def test_report_by_region_without_a_row_a_pixel_and_region(spark, monkeypatch):
    """Copies of a geometry, and a name of two regions, whose pixels count for each."""
    shapes = [("a", "t", (0, 0, 50, 50)), ("b", None, (20, 20, 80, 90)), ("c", "t", (0, 0, 50, 50)), ("a", "t", (30, 30, 70, 70)), ("d", "t", (200, 200, 210, 210))]
    rois = spark.createDataFrame([(i, n, n, c, box(*b)) for i, (n, c, b) in enumerate(shapes)], ROIS)
    r = np.random.default_rng(3)
    rows = [(float(x) + 0.5, float(y) + 0.5, None if k % 17 == 0 else float(h), float(d)) for k, (x, y, h, d) in enumerate(zip(r.integers(0, 90, 900), r.integers(0, 90, 900), r.integers(0, 300, 900) / 7, r.random(900), strict=True))]
    px = spark.createDataFrame(rows, "x double, y double, hematoxylin double, dab double")
    want = {}
    for n, c, (x0, y0, x1, y1) in shapes:
        want.setdefault((n, c), []).extend(p for p in rows if x0 < p[0] < x1 and y0 < p[1] < y1)
    before = {(g["roi_id"], g["class"]): g.asDict() for g in pixels.ihc_intensity(regions.all_regions(px, rois), 0.5, 0.5).collect()}
    monkeypatch.setattr(regions, "all_regions", None)
    got = {(g["roi_id"], g["class"]): g.asDict() for g in experiment.measurement_report(rois, None, px, pixel_size=0.5, threshold=0.5, only={"ihc"})["ihc"].collect()}
    assert set(got) == set(before) == {k for k, v in want.items() if v}
    for k, g in got.items():
        assert g["n"] == len(want[k]) and abs(g["dab_median"] - np.median([p[3] for p in want[k]])) < 1e-12
        assert abs(g["hematoxylin_median"] - np.median([p[2] for p in want[k] if p[2] is not None])) < 1e-12
        assert g.keys() == before[k].keys() and all(abs(g[c] - before[k][c]) < 1e-9 for c in g if c not in ("roi_id", "class"))
    places, groups = regions.places_of_groups(px, rois, ["roi_id", "class"])
    q = {g["roi_id"]: g["q"] for g in groups.join(regions.set_percentiles(px, places, "dab", [0.0, 0.1, 1.0], digits=3), "__set").collect()}
    assert np.allclose(q["a"], np.percentile([p[3] for p in want["a", "t"]], [0, 10, 100]), atol=1e-12)


def test_focus_copies_no_pixel(spark):
    a = spark.range(30).select(F.lit(1).alias("tile_id"), (F.col("id") / 6).cast("int").alias("row"), (F.col("id") % 6).cast("int").alias("col"), *[((F.col("id") * 7 % 11) / 11).alias(c) for c in "rgb"]).filter("id <> 14")
    out = pixels.focus(a)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    v = np.array([[(6 * i + j) * 7 % 11 / 11 for j in range(6)] for i in range(5)])
    lap, g2 = [], []
    for i in range(5):
        for j in range(6):
            w = v[i - 1 : i + 2, j - 1 : j + 2] if 0 < i < 4 and 0 < j < 5 and not (abs(i - 2) < 2 and abs(j - 2) < 2) else np.zeros((3, 3))
            if (i, j) != (2, 2):
                lap.append(w[0, 1] + w[2, 1] + w[1, 0] + w[1, 2] - 4 * w[1, 1])
                g2.append((w[:, 2] @ [1, 2, 1] - w[:, 0] @ [1, 2, 1]) ** 2 + (w[2] @ [1, 2, 1] - w[0] @ [1, 2, 1]) ** 2)
    got = out.first()
    assert any(g2) and abs(got["tenengrad"] - np.mean(g2)) < 1e-9 and abs(got["laplacian_variance"] - np.var(lap, ddof=1)) < 1e-9


def test_boundaries_of_one_geometry_are_one(spark, monkeypatch):
    rois = spark.createDataFrame([(i, f"r{i}", None, None, box(0, 0, 8, 8) if i % 2 else box(20, 20, 28, 28)) for i in range(3, 43)], ROIS)
    sent = []
    monkeypatch.setattr(regions, "boundary_pieces", lambda r, of=regions.boundary_pieces: (sent.append(r.count()), of(r))[1])
    points = spark.createDataFrame([(1, 4.0, 1.0), (2, 30.0, 24.0), (3, None, 2.0)], "k int, x double, y double")
    got = {r["k"]: (r["roi_id"], r["distance_px"], r["inside"]) for r in regions.cells_to_roi(points, rois, "k").collect()}
    assert sent == [2] and got == {1: ("r3", 1.0, True), 2: ("r4", 2.0, False), 3: (None, None, None)}


def test_ids_of_two_tables_meet_in_one_shuffle(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "row_id long")
    b = spark.createDataFrame([(2,), (3,), (3,), (None,)], "row_id long")
    out = cellindex.mismatches(a, b)
    assert sorted((r["row_id"] or 0, r["missing"]) for r in out.collect()) == [(0, "cells"), (0, "other"), (1, "other"), (3, "cells")]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
