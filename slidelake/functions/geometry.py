"""Geometry of polygons as column expressions.

A geometry is ARRAY<polygon>, a polygon ARRAY<ring> (shell, then holes), a ring ARRAY<point>, a point ARRAY<DOUBLE>
[x, y]; rings are closed. All coordinates are level-0 slide pixels. Everything here stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRY = "array<array<array<array<double>>>>"


def _steps(ring: Column) -> Column:
    """Indexes of the ring's segments; none for fewer than two points."""
    n = F.size(ring)
    return F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))


def _over(ring: Column, start: Column, step) -> Column:
    """Folds step(acc, a, b) over the ring's segments a-b."""
    return F.aggregate(_steps(ring), start, lambda acc, i: step(acc, F.get(ring, i - 1), F.get(ring, i)))


def ring_area(ring: Column) -> Column:
    """Absolute shoelace area."""
    return F.abs(_over(ring, F.lit(0.0), lambda s, a, b: s + (a[0] * b[1] - b[0] * a[1]))) / 2


def area(geometry: Column) -> Column:
    """Shells less their holes, no part below 0."""
    part = lambda p: F.greatest(F.lit(0.0), ring_area(p[0]) - F.aggregate(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.lit(0.0), lambda s, r: s + ring_area(r)))
    return F.aggregate(F.filter(geometry, lambda p: F.size(p) > 0), F.lit(0.0), lambda s, p: s + part(p))


def _moments(ring: Column) -> Column:
    """Signed twice-area and first moments of a ring."""
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(s: Column, p: Column, q: Column) -> Column:
        w = p[0] * q[1] - q[0] * p[1]
        return F.struct((s["a"] + w).alias("a"), (s["x"] + (p[0] + q[0]) * w).alias("x"), (s["y"] + (p[1] + q[1]) * w).alias("y"))

    return _over(ring, start, step)


def centroid(geometry: Column) -> Column:
    """STRUCT<x, y>, area-weighted over shells alone; the middle of the bounding box where shells have no area."""
    moments = F.transform(geometry, lambda p: _moments(p[0]))
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    sign = lambda m: F.when(m["a"] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    total = F.aggregate(moments, start, lambda s, m: F.struct((s["a"] + F.abs(m["a"])).alias("a"), (s["x"] + m["x"] * sign(m)).alias("x"), (s["y"] + m["y"] * sign(m)).alias("y")))
    box = bbox(geometry)
    flat = total["a"] == 0
    return F.struct(
        F.when(flat, (box["xmin"] + box["xmax"]) / 2).otherwise(F.try_divide(total["x"], 3 * total["a"])).alias("x"),
        F.when(flat, (box["ymin"] + box["ymax"]) / 2).otherwise(F.try_divide(total["y"], 3 * total["a"])).alias("y"),
    )


def points(geometry: Column) -> Column:
    """All vertices, in order."""
    return F.flatten(F.flatten(geometry))


def bbox(geometry: Column) -> Column:
    """STRUCT<xmin, ymin, xmax, ymax>."""
    xs, ys = F.transform(points(geometry), lambda p: p[0]), F.transform(points(geometry), lambda p: p[1])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd crossing rule; of an axis-parallel box the low edges are inside and the high ones outside."""

    def crosses(prev: Column, here: Column) -> Column:
        at = (prev[0] - here[0]) * (y - here[1]) / (prev[1] - here[1]) + here[0]
        return F.when((here[1] > y) != (prev[1] > y), (x < at).cast("int")).otherwise(F.lit(0))

    return _over(ring, F.lit(0), lambda n, a, b: n + crosses(a, b)) % 2 == 1


def contains(geometry: Column, x: Column, y: Column) -> Column:
    """In a shell and in none of its holes, for any part."""
    return F.exists(geometry, lambda p: in_ring(p[0], x, y) & ~F.exists(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda r: in_ring(r, x, y)))


def segment_distance(x: Column, y: Column, a: Column, b: Column) -> Column:
    """From a point to the segment a-b, by the projection held within it."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((x - a[0]) * dx + (y - a[1]) * dy, length))))
    px, py = x - (a[0] + t * dx), y - (a[1] + t * dy)
    return F.sqrt(px * px + py * py)


def boundary_distance(geometry: Column, x: Column, y: Column) -> Column:
    """To the nearest segment of any ring; no segment is added to rings that are not closed."""
    rings = F.flatten(geometry)
    each = F.transform(rings, lambda r: _over(r, F.lit(float("inf")), lambda d, a, b: F.least(d, segment_distance(x, y, a, b))))
    return F.array_min(each)


def affine(geometry: Column, m: list[list[float]]) -> Column:
    """Every vertex through the 3x3 matrix."""
    move = lambda p: F.array(p[0] * m[0][0] + p[1] * m[0][1] + F.lit(float(m[0][2])), p[0] * m[1][0] + p[1] * m[1][1] + F.lit(float(m[1][2])))
    return F.transform(geometry, lambda poly: F.transform(poly, lambda ring: F.transform(ring, move)))


def translation(dx: float = 0.0, dy: float = 0.0) -> list[list[float]]:
    """D1."""
    return [[1.0, 0.0, float(dx)], [0.0, 1.0, float(dy)], [0.0, 0.0, 1.0]]


def matmul(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    return [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]


def orientation(width: float, height: float, flip: str = "none", rotation: int = 0) -> list[list[float]]:
    """First the flip in the image's frame, then a quarter-turn rotation (clockwise on screen) that keeps coordinates at 0 or above."""
    if flip not in ("none", "horizontal", "vertical", "both") or rotation not in (0, 90, 180, 270):
        raise ValueError("unknown flip or rotation")
    sx, sy = (-1.0 if flip in ("horizontal", "both") else 1.0), (-1.0 if flip in ("vertical", "both") else 1.0)
    flipped = [[sx, 0.0, width if sx < 0 else 0.0], [0.0, sy, height if sy < 0 else 0.0], [0.0, 0.0, 1.0]]
    turned = {
        0: translation(), 90: [[0.0, -1.0, height], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]],
        180: [[-1.0, 0.0, width], [0.0, -1.0, height], [0.0, 0.0, 1.0]], 270: [[0.0, 1.0, 0.0], [-1.0, 0.0, width], [0.0, 0.0, 1.0]],
    }[rotation]
    return matmul(turned, flipped)


def distance_um(dx: Column, dy: Column, mpp_x: float, mpp_y: float) -> Column:
    """With its own scale on each axis."""
    return F.sqrt(F.pow(dx * mpp_x, F.lit(2)) + F.pow(dy * mpp_y, F.lit(2)))


def circle(x: Column, y: Column, radius: float, corners: int = 24) -> Column:
    """A closed polygon about a centre, as a geometry."""
    import math

    turn = [(math.cos(2 * math.pi * k / corners), math.sin(2 * math.pi * k / corners)) for k in [*range(corners), 0]]
    return F.array(F.array(F.array(*[F.array(x + radius * c, y + radius * s) for c, s in turn])))


def _bound(value: Column, use) -> Column:
    """use(value), with value worked out once: expressions that repeat what they are given would grow with each round."""
    return F.get(F.transform(F.array(value), use), 0)


def _corners_cut(ring: Column) -> Column:
    """The points at a quarter and three quarters of each side of an open ring."""

    def cut(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))
        return F.array(*[F.array(*[a[k] + (b[k] - a[k]) * t for k in (0, 1)]) for t in (0.25, 0.75)])

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(ring) - 1), cut))


def chaikin(ring: Column, rounds: int = 1, keep_area: bool = True, most: int = 2000) -> Column:
    """The ring with its corners cut off: each side gives the points at a quarter and three quarters. Rounds that would pass `most` corners are left out; the area is brought back about the mean corner if the factor lies within 1/4 to 4."""
    closed = F.element_at(ring, 1) == F.element_at(ring, -1)
    first = F.when(closed, F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))).otherwise(ring)
    loop = lambda r: F.concat(r, F.slice(r, 1, 1))
    out = first
    for k in range(1, rounds + 1):
        out = _bound(out, lambda r: F.when(F.size(first) * 2**k <= most, _corners_cut(r)).otherwise(r))  # noqa: B023

    def scaled(r: Column, factor: Column, middle: Column) -> Column:
        return F.transform(r, lambda p: F.array(*[(p[k] - middle[k]) * factor + middle[k] for k in (0, 1)]))

    def brought_back(r: Column) -> Column:
        factor = F.sqrt(F.try_divide(ring_area(loop(first)), ring_area(loop(r))))
        factor = F.when(factor.between(0.25, 4), factor).otherwise(F.lit(1.0))
        total = F.aggregate(r, F.array(F.lit(0.0), F.lit(0.0)), lambda s, p: F.array(s[0] + p[0], s[1] + p[1]))
        middle = F.transform(total, lambda v: v / F.size(r))
        return _bound(F.struct(factor.alias("f"), middle.alias("m")), lambda h: scaled(r, h["f"], h["m"]))

    out = _bound(out, brought_back) if keep_area else out
    return F.when(F.lit(rounds < 1) | (F.size(ring) < 4) | (F.size(first) < 3), ring).otherwise(_bound(out, loop))


def translate(geometry: Column, dx: float = 0.0, dy: float = 0.0) -> Column:
    """D5, N72."""
    return affine(geometry, translation(dx, dy))
