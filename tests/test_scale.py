"""Operators that spread one search, order or mask over many tasks, against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidelake.functions.geometry import GEOMETRY
from slidelake.operators import masks, models, pixels, proximity, ranges, regions


def table(spark, names, rows):
    kinds = {"k": "long", "x": "double", "y": "double", "g": "string", "v": "double", "n": "long"}
    return spark.createDataFrame(rows, ", ".join(f"{n} {kinds[n]}" for n in names))


def clouds(seed, n):
    """A dense spot, a wide cloud and copies."""
    r = np.random.default_rng(seed)
    xy = np.vstack([r.normal(5, 1e-3, (n, 2)), r.uniform(0, 1000, (n, 2)), np.full((n // 4, 2), 77.0)])
    return [(int(i), float(x), float(y)) for i, (x, y) in enumerate(xy)]


def distances(a, b):
    a, b = np.array([(x, y) for _, x, y in a]), np.array([(x, y) for _, x, y in b])
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))


@pytest.mark.parametrize("shift", [0.0, 50_000.0])
def test_nearest_of_dense_distant_and_broken_points(spark, shift):
    q, t = clouds(1, 120), [(k, x + shift, y) for k, x, y in clouds(2, 100)]
    odd = [(9001, math.nan, 1.0), (9002, None, 1.0), (9003, math.inf, 1.0)]
    got = {r["k"]: (r["nearest_id"], r["distance_px"]) for r in proximity.nearest(table(spark, "kxy", q + odd), table(spark, "kxy", t + odd), "k", "k").collect()}
    d = distances(q, t)
    assert len(got) == len(q) + 3 and all(got[k] == (None, None) for k in (9001, 9002, 9003))
    for i, (k, _, _) in enumerate(q):
        assert got[k][1] == pytest.approx(d[i].min(), abs=1e-9) and d[i, got[k][0]] == pytest.approx(d[i].min(), abs=1e-9)


def test_nearest_other_cell_with_copies_and_ties(spark):
    p = clouds(3, 60) + [(5000, -10.0, -10.0), (5001, -12.0, -10.0), (5002, -8.0, -10.0)]
    got = {r["k"]: (r["nearest_id"], r["distance_px"]) for r in proximity.nearest_cells(table(spark, "kxy", p), "k").collect()}
    d = distances(p, p)
    np.fill_diagonal(d, np.inf)
    for i, (k, _, _) in enumerate(p):
        assert got[k][1] == pytest.approx(d[i].min(), abs=1e-9)
        assert got[k][0] != k
    assert got[5000] == (5001, 2.0)
    assert proximity.nearest(table(spark, "kxy", p), table(spark, "kxy", []), "k", "k").filter("nearest_id IS NOT NULL").count() == 0
    assert [tuple(r) for r in proximity.nearest_cells(table(spark, "kxy", [(1, 2.0, 3.0)]), "k").collect()] == [(1, None, None, None)]


def test_boundary_search_with_many_regions(spark):
    """More regions than fit a list, and a long side whose parts are searched apart."""
    boxes = [(i, f"r{i}", [[[[x, y], [x + w, y], [x + w, y + 5.0], [x, y + 5.0], [x, y]]]]) for i, (x, y, w) in enumerate((float(i % 40 * 20), float(i // 40 * 20), 8.0) for i in range(800))]
    boxes.append((800, "long", [[[[0.0, 500.0], [5000.0, 500.0], [5000.0, 501.0], [0.0, 501.0], [0.0, 500.0]]]]))
    rois = spark.createDataFrame(boxes, f"roi_index int, roi_id string, geometry {GEOMETRY}")
    p = [(i, float(x), float(y)) for i, (x, y) in enumerate([(3, 3), (3, 2.4), (4000, 450), (4000, 500.4), (-50, -50), (399, 399), (790, 480)])]
    got = {r["k"]: (r["roi_index"], r["inside"], r["distance_px"]) for r in regions.cells_to_roi(table(spark, "kxy", p), rois, "k").collect()}
    for k, x, y in p:
        each = []
        for i, _, g in boxes:
            for (ax, ay), (bx, by) in zip(g[0][0], g[0][0][1:], strict=False):
                t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
                each.append((math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)), i))
        d, i = min(each)
        assert got[k][2] == pytest.approx(d) and got[k][0] == i
    assert got[0][1] and got[3][1] and not got[2][1]


def test_percentiles_and_ranks_by_ranges(spark):
    r = np.random.default_rng(4)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in r.choice([1.5, 2.0, 7.0, r.normal()], 301)] + [("c", 1.0), ("d", None)]
    df = table(spark, "gv", rows).repartition(5)
    got = {x["g"]: x["q"] for x in ranges.percentiles(df, "v", [0.0, 0.1, 0.5, 1.0], ("g",)).collect()}
    assert set(got) == {"a", "b", None, "c"}
    for g in got:
        assert got[g] == pytest.approx(np.percentile([v for h, v in rows if h == g], [0, 10, 50, 100]))
    ranks = ranges.average_ranks(df, "v", "rank", ("g",)).filter("g = 'a'").collect()
    own = [v for h, v in rows if h == "a"]
    assert all(x["rank"] == sum(v < x["v"] for v in own) + (sum(v == x["v"] for v in own) + 1) / 2 for x in ranks)


def test_running_sums_over_ties(spark):
    rows = [(k, 3, float(k % 2)) for k in range(200)]
    got = ranges.running(table(spark, "knv", rows).repartition(7), [F.col("v").desc(), F.col("k")], F.col("n")).collect()
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert {r["k"]: (r["upto"], r["total"]) for r in got} == {k: (3 * (i + 1), 600) for i, (k, _, _) in enumerate(order)}


@pytest.mark.parametrize("eight", [True, False])
def test_components_over_blocks(spark, monkeypatch, eight):
    g = np.random.default_rng(5).random((23, 29)) < 0.55
    rows = [("m", 1, int(r), int(c)) for r, c in zip(*np.nonzero(g), strict=True)]
    mask = spark.createDataFrame(rows, "mask_id string, label int, row int, col int")
    monkeypatch.setattr(masks, "BLOCK", 4)
    whole = masks.components(g, eight)
    got = {r["component"]: r["area"] for r in masks.mask_components(mask, 1, eight).collect()}
    assert got == {k: int((whole == k).sum()) for k in range(1, whole.max() + 1)}
    shapes = masks.mask_to_rois(mask, 1.0, eight=eight).collect()
    for s in shapes:
        assert sum(masks.ring_area([tuple(p) for p in poly[0]]) + sum(masks.ring_area([tuple(p) for p in h]) for h in poly[1:]) for poly in s["geometry"]) == s["area"]
    rois = spark.createDataFrame([(s["component"], str(s["component"]), None, s["geometry"]) for s in shapes], f"roi_index int, roi_id string, class string, geometry {GEOMETRY}")
    back = {(r["row"], r["col"]): r["label"] - 1 for r in masks.rois_to_mask(rois, 29, 23).collect()}
    assert back == {(int(r), int(c)): int(whole[r, c]) for r, c in zip(*np.nonzero(g), strict=True)}


def test_a_hole_goes_to_the_shell_around_it(spark):
    """Two shells that touch by a corner, their boxes overlap; the hole lies in the outer one."""
    g = np.ones((9, 9), dtype=bool)
    g[1:8, 1:8] = False
    g[1, 1] = False
    g[2:5, 2:5] = True
    g[3, 3] = False
    g[1, 1] = True
    mask = spark.createDataFrame([("m", 1, int(r), int(c)) for r, c in zip(*np.nonzero(g), strict=True)], "mask_id string, label int, row int, col int")
    (s,) = masks.mask_to_rois(mask, 1.0).collect()
    sizes = sorted((masks.ring_area([tuple(p) for p in poly[0]]), [masks.ring_area([tuple(p) for p in h]) for h in poly[1:]]) for poly in s["geometry"])
    assert sum(a + sum(h) for a, h in sizes) == g.sum()


def test_simpls_by_passes_needs_no_square_matrix(spark):
    r = np.random.default_rng(6)
    rows = [(i, [float(v) for v in r.normal(i % 3, 1, 40)], i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, f array<double>, y int")
    model = models.train(df, "f", "y", components=2)
    assert len(model.recipe.at) == 40
    hits = models.predict(model, df, "f").filter("predicted = y").count()
    assert hits >= 85


def test_thresholds_by_groups_use_exact_percentiles(spark):
    rows = [(g, float(v)) for g in ("a", "b") for v in range(11)]
    got = {x["g"]: (x["median"], x["p10"], x["p90"]) for x in pixels.stain_intensity(table(spark, "gv", rows).withColumnRenamed("v", "value"), ["g"]).collect()}
    assert got == {g: (5.0, 1.0, 9.0) for g in "ab"}


def test_points_of_many_regions_test_few(spark):
    """Oblique regions with holes and copies, points on sides and corners; squares keep only what may come before the first region that holds all of them."""
    r = np.random.default_rng(8)
    shapes = []
    for i in range(120):
        c, n = r.uniform(0, 100, 2), int(r.integers(3, 9))
        turn, reach = np.sort(r.uniform(0, 2 * np.pi, n)), r.uniform(3, 60)
        ring = [[float(c[0] + reach * math.cos(t)), float(c[1] + reach * math.sin(t))] for t in turn]
        hole = [[float(c[0] + (x - c[0]) / 3), float(c[1] + (y - c[1]) / 3)] for x, y in ring]
        shapes.append([[[*ring, ring[0]], [*hole, hole[0]]]])
    shapes += shapes[:40] + [[[[[0.0, 0.0], [64.0, 0.0], [64.0, 64.0], [0.0, 64.0], [0.0, 0.0]]]]] * 3 + [[]]
    rois = spark.createDataFrame([(i, f"r{i}", "c", g) for i, g in enumerate(shapes)], f"roi_index int, roi_id string, class string, geometry {GEOMETRY}")
    xy = [*map(tuple, r.uniform(-5, 105, (300, 2))), *[tuple(s[0][0][0]) for s in shapes if s], (0.0, 0.0), (64.0, 3.0), (3.0, 64.0), (0.0, 32.0)]
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(xy + xy[:50])] + [(9000, math.nan, 1.0), (9001, 1.0, None), (9002, math.inf, math.inf)]

    def odd(ring, x, y):
        return sum((b[1] > y) != (a[1] > y) and x < (a[0] - b[0]) * (y - b[1]) / (a[1] - b[1]) + b[0] for a, b in zip(ring, ring[1:], strict=False)) % 2 == 1

    fine = [p for p in points if p[0] < 9000]
    hits = [(k, i) for k, x, y in fine for i, g in enumerate(shapes) if any(odd(p[0], x, y) and not any(odd(h, x, y) for h in p[1:]) for p in g)]
    df = table(spark, "kxy", points)
    assert sorted((a["k"], a["roi_index"]) for a in regions.all_regions(df, rois).collect()) == sorted(hits)
    first = {k: min((i for j, i in hits if j == k), default=None) for k, _, _ in points}
    assert {a["k"]: a["roi_index"] for a in regions.associate(df, rois).collect()} == first
    want = {i: sum(j == i for _, j in hits) for i in range(len(shapes))}
    assert {a["roi_index"]: a["n"] for a in regions.point_counts(df, rois).collect()} == {i: n for i, n in want.items() if n}
    squares = regions.squares(rois)
    assert squares.select("first").distinct().count() == 121 and squares.filter("whole").count() > 121


def test_region_distances_by_blocks_with_copies(spark):
    """Pairs within and between blocks, and copies of one geometry, of which only one is searched."""
    box = lambda x, y, s: [[[[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]]]
    given = [(float(7 * i % 50), float(11 * i % 40), 2.0) for i in range(9)]
    given += [given[3], given[0], given[3]]
    rois = spark.createDataFrame([(i, f"r{i}", "c", box(*g)) for i, g in enumerate(given)], f"roi_index int, roi_id string, class string, geometry {GEOMETRY}")
    apart = lambda p, q, s: max(0.0, q - p - s, p - q - s)
    for block in (2, 64):
        got = {(r["i"], r["j"]): (r["roi_a"], r["roi_b"], r["distance_px"]) for r in regions.roi_distance(rois, block).collect()}
        assert len(got) == len(given) * (len(given) - 1) // 2
        for (i, j), (a, b, d) in got.items():
            (x, y, s), (u, v, _) = given[i], given[j]
            want = math.hypot(apart(x, u, s), apart(y, v, s))
            assert i < j and (a, b) == (f"r{i}", f"r{j}") and (want == 0 or d == pytest.approx(want)) and (given[i] != given[j] or d == 0)


def test_regions_that_share_distances_meet_without_another_shuffle(spark, monkeypatch):
    """Copies of few geometries are dealt into parts of bounded size and listed where the distances are; a distance is rounded once."""
    triangle = lambda x, y: [[[[x, y], [x + 3, y + 1], [x + 1, y + 4], [x, y]]]]
    given = [(float(k % 4 * 9), float(k % 3 * 7)) for k in range(40)]
    rois = spark.createDataFrame([(i, f"r{i}", "c", triangle(*g)) for i, g in enumerate(given)] + [(99, "line", "c", [])], f"roi_index int, roi_id string, class string, geometry {GEOMETRY}")
    found = regions.roi_distance(rois)
    above = found._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]
    assert "Join" not in above and "Exchange" not in above
    want = {(r["i"], r["j"]): r for r in found.collect()}
    assert sorted(want) == [(i, j) for i in range(40) for j in range(i + 1, 40)]
    for (i, j), r in want.items():
        same = want.get((i % 12, j % 12)) or want.get((j % 12, i % 12))
        assert (r["roi_a"], r["roi_b"]) == (f"r{i}", f"r{j}") and r["distance_px"] == (same["distance_px"] if same else 0)
    for part, row, block in ((3, 2, 64), (7, 32, 5), (4096, 1, 2)):
        monkeypatch.setattr(regions, "PART", part)
        monkeypatch.setattr(regions, "ROW", row)
        rows = regions.roi_distance(rois, block, places=2).collect()
        assert len(rows) == 780 and all(r["distance_px"] == round(want[r["i"], r["j"]]["distance_px"], 2) for r in rows)
