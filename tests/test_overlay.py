"""Polygon overlay against points, areas and exact small cases."""

import math
import random

import numpy as np
import pytest

from slidelake.functions import geometry as G
from slidelake.operators import overlay as O

KIND = f"roi_id string, geometry {G.GEOMETRY}, key string, operation int"


def ring(*xy):
    return [[float(x), float(y)] for x, y in [*xy, xy[0]]]


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def star(r, cx, cy, n, size):
    return ring(*[(cx + size * r.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), cy + size * r.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)])


def frame(spark, rows):
    return spark.createDataFrame([(k, g, "clash", 1) for k, g in rows], KIND)


def inside(geometry, x, y):
    """Whether the winding number is not 0, shells anticlockwise and holes clockwise."""
    w = 0
    for polygon in geometry:
        for hole, points in enumerate(polygon):
            pairs = list(zip(points, points[1:]))
            turn = (1 if sum(a[0] * b[1] - b[0] * a[1] for a, b in pairs) >= 0 else -1) * (-1 if hole else 1)
            for a, b in pairs:
                left = (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0])
                w += turn * ((a[1] <= y < b[1] and left > 0) - (b[1] <= y < a[1] and left < 0))
    return w != 0


def near_an_edge(geometry, x, y, least=0.001):
    """Edges move by less than a step of the lattice where they are split."""
    for points in (r for p in geometry for r in p):
        for a, b in zip(points, points[1:]):
            dx, dy = b[0] - a[0], b[1] - a[1]
            t = min(1, max(0, ((x - a[0]) * dx + (y - a[1]) * dy) / ((dx * dx + dy * dy) or 1)))
            if math.hypot(a[0] + t * dx - x, a[1] + t * dy - y) < least:
                return True
    return False


def area(geometry):
    return sum((-1 if hole else 1) * abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))) / 2 for p in geometry for hole, r in enumerate(p))


WANT = {"union": lambda s, c: s or c, "intersection": lambda s, c: s and c, "difference": lambda s, c: s and not c, "xor": lambda s, c: s != c}


@pytest.fixture(scope="module")
def cases():
    r = random.Random(5)
    subjects, clips = {}, {}
    for k in range(5):
        subjects[f"star{k}"] = [[star(r, 50, 50, r.randint(5, 60), 40)], [star(r, 60, 60, 20, 30)]]
        clips[f"star{k}"] = [[star(r, 60, 45, r.randint(5, 60), 40)]]
    whole = lambda: [[ring(*[(r.randint(0, 12), r.randint(0, 12)) for _ in range(7)])] for _ in range(3)]
    for k in range(5):
        # crossing rings, shared corners and edges, collinear overlaps
        subjects[f"knot{k}"], clips[f"knot{k}"] = whole(), whole()
    return subjects, clips


@pytest.fixture(scope="module")
def found(spark, cases):
    rows = O.overlays(frame(spark, cases[0].items()), frame(spark, cases[1].items())).collect()
    return {(x["roi_id"], x["operation"]): x["geometry"] for x in rows}


def test_points_of_random_regions(cases, found):
    r = random.Random(6)
    for k in cases[0]:
        for _ in range(300):
            x, y = (r.uniform(0, 100), r.uniform(0, 100)) if k.startswith("star") else (r.uniform(-1, 13), r.uniform(-1, 13))
            s, c = inside(cases[0][k], x, y), inside(cases[1][k], x, y)
            if near_an_edge([*cases[0][k], *cases[1][k]], x, y):
                continue
            for operation, want in WANT.items():
                assert inside(found[k, operation], x, y) == want(s, c), (k, operation, x, y)


def test_areas_add_up(cases, found):
    for k in cases[0]:
        a = {o: area(found[k, o]) for o in O.OPERATIONS}
        assert a["union"] == pytest.approx(a["intersection"] + a["xor"], abs=1e-6)
        assert a["union"] >= a["difference"] >= 0


def test_rings_are_simple_and_shells_hold_their_holes(cases, found):
    for geometry in found.values():
        for shell, *holes in geometry:
            assert shell[0] == shell[-1] and len(shell) >= 4
            assert sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(shell, shell[1:])) > 0
            for h in holes:
                assert sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(h, h[1:])) < 0
                assert inside([[shell]], (h[0][0] + h[1][0]) / 2, (h[0][1] + h[1][1]) / 2)


def test_exact_cases(spark):
    donut = [[box(0, 0, 30, 30), box(10, 10, 20, 20)]]
    rows = {
        "donut": (donut, [[box(15, 15, 40, 40)]], (1225, 200, 600, 1025), (1, 2)),
        "corner": ([[box(0, 0, 10, 10)]], [[box(10, 10, 20, 20)]], (200, 0, 100, 200), (2, 1)),
        "edge": ([[box(0, 0, 10, 10)]], [[box(10, 2, 20, 8)]], (160, 0, 100, 160), (1, 1)),
        "same": ([[box(0, 0, 10, 10)]], [[box(0, 0, 10, 10)]], (100, 100, 0, 0), (1, 1)),
        "filled": (donut, [[box(10, 10, 20, 20)]], (900, 0, 800, 900), (1, 1)),
        "turned": ([[box(0, 0, 10, 10)[::-1]]], [[box(5, 5, 15, 15)]], (175, 25, 75, 150), (1, 1)),
        "open": ([[box(0, 0, 10, 10)[:-1]]], [], (100, 0, 100, 100), (1, 1)),
        "flat": ([[ring((0, 0), (5, 5), (9, 9))]], [], (0, 0, 0, 0), (0, 0)),
    }
    subjects = [(k, v[0]) for k, v in rows.items()] + [(None, donut), ("null", None), ("empty", []), ("twice", [[box(0, 0, 4, 4)]]), ("twice", [[box(2, 0, 6, 4)]])]
    clips = [(k, v[1]) for k, v in rows.items() if v[1]] + [("clip", donut)]
    got = {(x["roi_id"], x["operation"]): x["geometry"] for x in O.overlays(frame(spark, subjects), frame(spark, clips)).collect()}
    assert {k for k, _ in got} == {*rows, "null", "empty", "twice", "clip"}
    for k, (_, _, areas, (shells, rings)) in rows.items():
        assert tuple(area(got[k, o]) for o in O.OPERATIONS) == areas, k
        if areas[0]:
            assert (len(got[k, "union"]), sum(map(len, got[k, "union"]))) == (shells, max(shells, rings)), k
    assert area(got["twice", "union"]) == 24 and got["null", "union"] == got["empty", "xor"] == [] and area(got["clip", "union"]) == 800 and got["clip", "difference"] == []


def test_no_rows(spark):
    none = frame(spark, [])
    assert O.overlay(none, none, "union").count() == 0
    with pytest.raises(ValueError):
        O.overlay(none, none, "cut")


def test_cells_do_not_matter(spark, monkeypatch, cases):
    """Many small cells, or one."""
    r = random.Random(9)
    a, b = frame(spark, [("k", [[star(r, 50, 50, 150, 40)]])]), frame(spark, [("k", [[star(r, 55, 50, 150, 40)]])])
    want = O.overlay(a, b, "intersection").collect()
    for side, lines in ((1, 1 << 20), (1e6, 1)):
        monkeypatch.setattr(O, "SIDE", side)
        monkeypatch.setattr(O, "LINES", lines)
        assert O.overlay(a, b, "intersection").collect() == want


def test_close_pairs_and_turns():
    r = np.random.default_rng(1)
    low = r.integers(0, 50, (80, 2))
    high = low + r.integers(0, 9, (80, 2))
    got = {tuple(sorted(p)) for i, j in O.close_pairs(low[:, 0], high[:, 0], low[:, 1], high[:, 1]) for p in zip(i.tolist(), j.tolist())}
    assert got == {(i, j) for i in range(80) for j in range(i + 1, 80) if (low[i] <= high[j]).all() and (low[j] <= high[i]).all()}
    big = 1 << 36
    a, b, p = np.array([[0, 0]] * 3), np.array([[big, big - 1]] * 3), np.array([[2 * big, 2 * big - 2], [2 * big, 2 * big - 1], [2 * big, 2 * big - 3]])
    assert O.turns(*a.T, *b.T, *p.T).tolist() == [0, 1, -1]


def test_turns_of_level_segments_need_no_whole_numbers(monkeypatch):
    """Doubles are exact below 2^53, so that zeros there are decided; above, whole numbers still are."""
    import numpy as np

    from slidelake.operators import overlay

    asked = []
    monkeypatch.setattr(overlay, "int", lambda v: asked.append(v) or int(v), raising=False)
    column = lambda *v: np.array(v, dtype=np.int64)
    got = overlay.turns(column(0, 0), column(0, 0), column(8_000_000, 8_000_000), column(0, 0), column(5, 5), column(0, 1))
    assert got.tolist() == [0, 1] and not asked
    far = 1 << 30
    assert overlay.turns(column(0), column(0), column(far), column(far + 1), column(far - 1), column(far)).tolist() == [1] and asked
    assert overlay.turns(column(0), column(0), column(far), column(far), column(far - 1), column(far - 1)).tolist() == [0]


def by_key(df):
    rows = df.collect()
    got = {(r["roi_id"], r["operation"]): r["geometry"] for r in rows}
    assert len(got) == len(rows)
    return got


def test_keys_of_few_corners_meet_no_grid(spark, monkeypatch, cases, found):
    """Many keys at once in arrays give the same corners, ring by ring, as a group a cell, wherever a key goes."""
    subjects, clips = (frame(spark, c.items()) for c in cases)
    few = O.overlays(subjects, clips)
    assert "FlatMapGroupsInPandas" not in few._jdf.queryExecution().toString()
    monkeypatch.setattr(O, "AT_ONCE", 30)
    assert by_key(O.overlays(subjects, clips)) == found
    monkeypatch.setattr(O, "FEW", 40)
    assert by_key(O.overlays(subjects, clips)) == found
    monkeypatch.setattr(O, "FEW", -1)
    assert by_key(O.overlays(subjects, clips)) == found


def test_many_keys_of_boxes(spark, monkeypatch):
    """Areas by counting whole pixels; holes, touching corners, shared edges and cancelled rings are among them."""
    r = random.Random(3)
    rows = [{f"k{k}": [] for k in range(300)} for _ in range(2)]
    for k in range(300):
        for _ in range(r.randint(1, 8)):
            x, y = r.randint(0, 12), r.randint(0, 12)
            rows[r.randint(0, 1)][f"k{k}"].append([box(x, y, x + r.randint(1, 8), y + r.randint(1, 8))])
    subjects, clips = (frame(spark, c.items()) for c in rows)
    got = by_key(O.overlays(subjects, clips))
    assert len(got) == 1200
    for k in rows[0]:
        s, c = ({(x, y) for p in t[k] for x in range(int(p[0][0][0]), int(p[0][2][0])) for y in range(int(p[0][0][1]), int(p[0][2][1]))} for t in rows)
        for operation, want in (("union", s | c), ("intersection", s & c), ("difference", s - c), ("xor", s ^ c)):
            assert area(got[k, operation]) == len(want), (k, operation)
    monkeypatch.setattr(O, "FEW", -1)
    some = {k: v for k, v in got.items() if len(k[0]) == 2}
    assert by_key(O.overlays(subjects.filter("length(roi_id) = 2"), clips.filter("length(roi_id) = 2"))) == some


def test_odd_and_large_keys_go_by_cells(spark, monkeypatch):
    """Corners far away or with a third coordinate, beside keys that need no grid."""
    far = 70000.0
    tall = [[[p + [9.0] for p in box(0, 0, 10, 10)]]]
    subjects = frame(spark, [("far", [[box(far, far, far + 10, far + 10)]]), ("tall", tall), ("near", [[box(0, 0, 10, 10)]]), ("null", None)])
    clips = frame(spark, [("far", [[box(far + 5, far, far + 15, far + 10)]]), ("tall", [[box(5, 0, 15, 10)]]), ("near", [[box(5, 0, 15, 10)]])])
    taken, cells = [], O.by_cells
    monkeypatch.setattr(O, "by_cells", lambda s, c, *more: taken.extend(r["key"] for r in s.collect()) or cells(s, c, *more))
    got = by_key(O.overlays(subjects, clips))
    assert sorted(taken) == ["far", "tall"] and len(got) == 16
    for k in ("far", "tall", "near"):
        assert [area(got[k, o]) for o in O.OPERATIONS] == pytest.approx([150, 50, 50, 100], abs=1e-4), k
    assert got["null", "union"] == []


def test_crossings_are_exact():
    r = np.random.default_rng(2)
    for reach in (40, 1 << 22, 1 << 29, 1 << 33):
        p, q = (r.integers(-reach, reach, (400, 4)) * 2 for _ in range(2))
        t = lambda a, b, e: O.turns(*a.T, b[:, e], b[:, e + 1])
        k = np.flatnonzero((t(p, q, 0) * t(p, q, 2) < 0) & (t(q, p, 0) * t(q, p, 2) < 0))
        assert len(k) > 20
        assert [tuple(v) for v in O.crossings(p[k], q[k]).tolist()] == [O.crossing(tuple(a), tuple(b)) for a, b in zip(p[k].tolist(), q[k].tolist())]
