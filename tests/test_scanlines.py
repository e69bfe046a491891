"""Masks by scan lines against a test of each pixel, and codebooks."""

import math
import random

import pytest

from slidelake.functions import geometry as G
from slidelake.operators import masks as M

KIND = f"roi_index int, roi_id string, name string, class string, geometry {G.GEOMETRY}"


def held(ring, x, y):
    n = 0
    for a, b in zip(ring, ring[1:]):
        if (b[1] > y) != (a[1] > y) and x < (a[0] - b[0]) * (y - b[1]) / (a[1] - b[1]) + b[0]:
            n += 1
    return n % 2 == 1


def shape(r, n, size, centre):
    points = [[centre[0] + size * r.uniform(0.2, 1) * math.cos(2 * math.pi * k / n), centre[1] + size * r.uniform(0.2, 1) * math.sin(2 * math.pi * k / n)] for k in range(n)]
    return [*points, points[0]]


@pytest.mark.parametrize("scale", [1.0, 0.7, 4.0])
def test_masks_by_scan_lines(spark, scale):
    r = random.Random(3)
    whole = lambda: [[float(r.randint(-4, 40)), float(r.randint(-4, 40))] for _ in range(5)]
    rows = []
    for i in range(12):
        if i % 3 == 0:
            p = whole()
            geometry = [[[*p, p[0]]], [[*(q := whole()), q[0]]]]
        elif i % 3 == 1:
            geometry = [[shape(r, 20, 18, (20, 20)), shape(r, 9, 6, (20, 22))]]
        else:
            # corners and sides on pixel centres
            geometry = [[[[x * scale, y * scale] for x, y in ((2.5, 2.5), (9.5, 2.5), (9.5, 8.5), (5.5, 8.5), (2.5, 4.5), (2.5, 2.5))]]]
        rows.append((i, f"r{i}", f"n{i % 4}", None if i == 4 else "ab"[i % 2], geometry))
    rows.append((12, "none", None, " ", []))
    df = spark.createDataFrame(rows, KIND)
    for overlap, pick in (("last", max), ("first", min)):
        want = {}
        for row in range(30):
            for col in range(33):
                x, y = (col + 0.5) * scale, (row + 0.5) * scale
                inside = [i for i, _, _, _, g in rows if any(held(p[0], x, y) and not any(held(h, x, y) for h in p[1:]) for p in g)]
                if inside:
                    want[row, col] = pick(inside) + 1
        assert {(m.row, m.col): m.label for m in M.rois_to_mask(df, 33, 30, scale, overlap).collect()} == want


def test_codebooks(spark):
    rows = [(0, "a", "x", "tumour", []), (1, "b", None, None, []), (2, "c", "x", "stroma", []), (3, "d", " ", "tumour", [])]
    df = spark.createDataFrame(rows, KIND)
    got = lambda *how: [(b.roi_index, b.value, b.key) for b in M.codebook(df, *how).orderBy("roi_index").collect()]
    assert got("class") == [(0, 1, "tumour"), (1, 2, "unlabelled"), (2, 3, "stroma"), (3, 1, "tumour")]
    assert got("name") == [(0, 1, "x"), (1, 2, "unlabelled"), (2, 1, "x"), (3, 2, "unlabelled")]
    assert got("id") == [(0, 1, "a"), (1, 2, "b"), (2, 3, "c"), (3, 4, "d")]
    assert got("index") == [(0, 1, "a"), (1, 2, "b"), (2, 3, "c"), (3, 4, "d")] and {v for _, v, _ in got("constant")} == {1}
    assert got("class", {"tumour": 7, "stroma": 9, "unlabelled": 255}) == [(0, 7, "tumour"), (1, 255, "unlabelled"), (2, 9, "stroma"), (3, 7, "tumour")]
    with pytest.raises(Exception, match="no value for"):
        got("class", {"tumour": 7})
    with pytest.raises(ValueError):
        M.codebook(df, "colour")
