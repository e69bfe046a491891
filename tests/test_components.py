"""Components by runs against a flood fill, and their measures against those of whole tiles."""

import time

import numpy as np
import pytest

from slidelake.operators import candidates as C
from slidelake.operators import masks as M


def flood(grid, eight):
    rows, cols = grid.shape
    out, n = np.zeros(grid.shape, dtype=np.int32), 0
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (eight or not (i and j))]
    for c, r in zip(*np.nonzero(grid.T), strict=True):
        if not out[r, c]:
            n += 1
            todo = [(r, c)]
            out[r, c] = n
            while todo:
                y, x = todo.pop()
                for i, j in steps:
                    p, q = y + i, x + j
                    if 0 <= p < rows and 0 <= q < cols and grid[p, q] and not out[p, q]:
                        out[p, q] = n
                        todo.append((p, q))
    return out


@pytest.mark.parametrize("eight", [True, False])
def test_components_by_runs(eight):
    r = np.random.default_rng(1)
    for k in range(150):
        grid = r.uniform(size=(r.integers(1, 30), r.integers(1, 30))) < r.choice([0.1, 0.4, 0.55, 0.7, 1.0])
        assert (M.components(grid, eight) == flood(grid, eight)).all()
    spiral = np.zeros((41, 41), dtype=bool)
    for k in range(0, 20, 2):
        spiral[k : 41 - k, k] = spiral[40 - k, k : 41 - k] = spiral[k : 41 - k, 40 - k] = True
        spiral[k, k + 2 : 41 - k] = True
    assert (M.components(spiral, eight) == flood(spiral, eight)).all()
    assert M.components(np.zeros((3, 0), dtype=bool)).shape == (3, 0)


def test_a_full_block_is_fast():
    grid = np.random.default_rng(2).uniform(size=(256, 256)) < 0.6
    began = time.process_time()
    slow = flood(grid, True)
    middle = time.process_time()
    fast = M.components(grid)
    assert (fast == slow).all() and time.process_time() - middle < (middle - began) / 10


class Flat:
    def __init__(self, shape, seed):
        r = np.random.default_rng(seed)
        self.edge, self.top = r.uniform(size=shape), r.uniform(size=shape)


@pytest.mark.parametrize("ring", [0, 2, 5])
def test_measures_in_windows_are_those_of_the_tile(ring):
    for seed in range(12):
        mask = np.random.default_rng(seed + 50).uniform(size=(24, 31)) < 0.3
        tile = Flat(mask.shape, seed)
        got = list(C.described(mask, tile, 3, ring, 0.5))
        numbers, at = flood(mask, True), 0
        for k in range(1, numbers.max() + 1):
            cells = numbers == k
            if cells.sum() < 3:
                continue
            window, own, m = got[at]
            at += 1
            whole = np.zeros_like(mask)
            whole[window] = own
            assert (whole == cells).all() and m["area"] == cells.sum()
            assert m["inner_edge"] == (tile.edge[cells] >= 0.5).mean() and m["level"] == pytest.approx(tile.top[cells].mean())
            assert m["circularity"] == pytest.approx(min(1, 4 * np.pi * cells.sum() / C.perimeter(cells) ** 2))
            if ring:
                around = C.disk(cells, ring)[ring:-ring, ring:-ring] & ~cells
                zone = C.boundary(cells) | around
                assert m["ring_level"] == pytest.approx(tile.top[around].mean()) and m["zone_edge"] == (tile.edge[zone] >= 0.5).mean()
        assert at == len(got)
