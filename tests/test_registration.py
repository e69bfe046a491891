"""The shift of points onto tissue against a plain search over every offset."""

import math

import numpy as np
import pytest

from slidelake.operators import experiment


def plain(mask, points, size, slide, max_shift, coarse, radius, fine):
    width, height = size
    tissue = np.zeros((height + 1, width + 1), dtype=bool)
    for r, c in mask:
        if 1 <= r <= height and 1 <= c <= width:
            tissue[r, c] = True
    px = np.array([(np.round(x * width / slide[0]), np.round(y * height / slide[1])) for x, y in points], dtype=float)

    def score(dx, dy):
        x, y = px[:, 0] + dx, px[:, 1] + dy
        ok = (x >= 1) & (x <= width) & (y >= 1) & (y <= height)
        return int(tissue[y[ok].astype(int), x[ok].astype(int)].sum())

    top = [math.ceil(v * max_shift if max_shift <= 1 else max_shift) for v in size]
    best = (-1, 0, 0)
    for dx in range(-top[0], top[0] + 1, coarse):
        for dy in range(-top[1], top[1] + 1, coarse):
            best = (score(dx, dy), dx, dy) if score(dx, dy) > best[0] else best
    _, x, y = best
    for dx in range(x - radius, x + radius + 1, fine) if radius else ():
        for dy in range(y - radius, y + radius + 1, fine):
            best = (score(dx, dy), dx, dy) if score(dx, dy) > best[0] else best
    return best


@pytest.mark.parametrize("seed, radius, fine", [(1, 6, 1), (2, 4, 2), (3, 0, 1)])
def test_shift_equals_the_plain_search(spark, seed, radius, fine):
    r = np.random.default_rng(seed)
    size, slide = (40, 30), (400.0, 330.0)
    mask = [(int(a), int(b)) for a, b in r.integers(-2, 34, (300, 2))] + [(a, b) for a in range(8, 20) for b in range(10, 25)]
    points = [(float(x), float(y)) for x, y in np.column_stack([r.normal(260, 60, 200), r.normal(100, 50, 200)])]
    broken = [(None, 1.0), (float("nan"), 2.0), (float("inf"), 3.0)]
    got = experiment.estimate_translation(spark.createDataFrame(mask, "row int, col int"), spark.createDataFrame(points + broken, "x double, y double"), size, slide, coarse_step=5, refine_radius=radius, refine_step=fine).first()
    hits, dx, dy = plain(mask, points, size, slide, 0.25, 5, radius, fine)
    assert (got["thumbnail_dx"], got["thumbnail_dy"], got["points"]) == (dx, dy, 203)
    assert got["score"] == pytest.approx(hits / 203) and got["dx"] == pytest.approx(dx * 10) and got["dy"] == pytest.approx(dy * 11)


def test_nothing_to_match(spark):
    none, one = spark.createDataFrame([], "row int, col int"), spark.createDataFrame([(5.0, 5.0)], "x double, y double")
    first = experiment.estimate_translation(none, one, (20, 20), (20.0, 20.0), coarse_step=5, refine_radius=2).first()
    assert (first["score"], first["thumbnail_dx"], first["thumbnail_dy"], first["points"]) == (0.0, -5, -5, 1)
    empty = experiment.estimate_translation(none, one.limit(0), (20, 20), (20.0, 20.0)).first()
    assert (empty["score"], empty["points"]) == (0.0, 0)
    with pytest.raises(ValueError):
        experiment.estimate_translation(none, one, (20, 20), (20.0, 20.0), coarse_step=0)
