"""Union, intersection, difference and symmetric difference of regions by a planar overlay.

Coordinates are rounded to 1/4096 px and everything after is exact in whole numbers (twice the lattice, so that middles
of segments and lines between lattice points are whole too).

1. Every segment is listed by the grid cells that it may touch; within a cell, segments that cross, touch or overlap get
   split points. Split points are rounded to the lattice, so pieces may cross anew: rounds go on until none do.
2. Pieces at one place become one, with the sums of their directions for either side.
3. Winding numbers beside a piece: crossings of the line below its cell, added up along the row of cells, and those
   on the way from the cell's corner to the middle of the piece, which are pieces of the same cell. No task sees more
   than a cell or the cells of a row.
4. A piece stays where the operation differs on its two sides, with the inside to its left. At each corner, what comes
   in goes on along the next piece that bounds the same inside, and rings are read off. Only this step has a region's
   outline in one task, as the result has it in one row.

A point is inside where its winding number is not 0; shells and holes of the input may run either way.

The grid is chosen for each key from the lengths of its segments, at most LINES cells a side.

Keys of up to FEW corners need no grid: the same steps run on arrays of many keys at once, in the task that has the keys.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions.geometry import GEOMETRY
from ..sources.work import deleted, written

#: Lattice points a px, and whole numbers a lattice step.
LATTICE, STEP = 4096, 2
LINES = 4096
#: A cell's side in typical lengths of a segment.
SIDE = 32
#: Doubles hold all whole numbers below.
EXACT = float(1 << 53)
#: Corners of a key that is worked on in one task, how far they may lie from 0 (px), and about how many are taken at once.
FEW, REACH, AT_ONCE = 1024, 65536.0, 25_000
OPERATIONS = ("union", "intersection", "difference", "xor")
SEGMENT = ("ax", "ay", "bx", "by")
#: Splitting ends after a few rounds; more than so many would be a fault.
ROUNDS = 30


def segments(regions: DataFrame, key: str, clip: int) -> DataFrame:
    """key, segment ends as whole numbers and the number of times it runs for subject (ds) and clip (dc). Shells run anticlockwise, holes clockwise."""
    rings = regions.select(F.col(key).alias("key"), F.explode("geometry").alias("polygon")).select("key", F.posexplode("polygon").alias("hole", "ring"))
    whole = lambda v: F.round(v * LATTICE).cast("long") * STEP
    rings = rings.withColumn("ring", F.transform("ring", lambda p: F.array(whole(p[0]), whole(p[1])))).filter(F.size("ring") > 2)
    shut = F.when(F.element_at("ring", 1) == F.element_at("ring", -1), F.col("ring")).otherwise(F.concat("ring", F.slice("ring", 1, 1)))
    rings = rings.withColumn("ring", shut)
    part = lambda i: (F.col("ring")[i - 1][0].cast("double") * F.col("ring")[i][1] - F.col("ring")[i][0].cast("double") * F.col("ring")[i - 1][1])
    turn = F.aggregate(F.sequence(F.lit(1), F.size("ring") - 1), F.lit(0.0), lambda s, i: s + part(i))
    back = (turn < 0) != (F.col("hole") > 0)
    rings = rings.withColumn("ring", F.when(back, F.reverse("ring")).otherwise(F.col("ring")))
    pair = F.explode(F.arrays_zip(F.slice("ring", 1, F.size("ring") - 1).alias("a"), F.slice("ring", 2, F.size("ring") - 1).alias("b"))).alias("s")
    ends = rings.select("key", pair).select("key", F.col("s.a")[0].alias("ax"), F.col("s.a")[1].alias("ay"), F.col("s.b")[0].alias("bx"), F.col("s.b")[1].alias("by"))
    return ends.withColumn("ds", F.lit(1 - clip).cast("long")).withColumn("dc", F.lit(clip).cast("long"))


def merged(pieces: DataFrame) -> DataFrame:
    """One row a place: pieces run upwards (level ones to the right), and what runs against that counts as -1. Those that cancel go, and so do those without length."""
    down = (F.col("by") < F.col("ay")) | ((F.col("by") == F.col("ay")) & (F.col("bx") < F.col("ax")))
    ends = [F.when(down, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("bx", "ax"), ("by", "ay"), ("ax", "bx"), ("ay", "by"))]
    sign = F.when(down, F.lit(-1)).otherwise(F.lit(1))
    turned = pieces.filter("ax <> bx OR ay <> by").select("key", *ends, (sign * F.col("ds")).alias("ds"), (sign * F.col("dc")).alias("dc"))
    return turned.groupBy("key", *SEGMENT).agg(F.sum("ds").alias("ds"), F.sum("dc").alias("dc")).filter("ds <> 0 OR dc <> 0")


def with_grid(pieces: DataFrame) -> DataFrame:
    """pieces with `side`, the side of the key's cells, an even number."""
    length = F.sqrt((F.col("bx") - F.col("ax")).cast("double") ** 2 + (F.col("by") - F.col("ay")).cast("double") ** 2)
    extent = F.greatest(F.max(F.greatest("ax", "bx")) - F.min(F.least("ax", "bx")), F.max("by") - F.min("ay"))
    grid = pieces.groupBy("key").agg(F.exp(F.avg(F.log(F.greatest(length, F.lit(1.0))))).alias("typical"), extent.alias("extent"))
    side = F.greatest(F.lit(64.0), F.col("typical") * SIDE, F.col("extent") / LINES)
    return pieces.join(grid.select("key", (F.ceil(side / 2) * 2).cast("long").alias("side")), "key")


def by_cell(pieces: DataFrame) -> DataFrame:
    """A row a piece and cell (gx, gy) that it may touch: of each row of cells, those between where the piece enters it and leaves it. Cell borders lie on odd numbers, where there are no corners."""
    cell = lambda v: F.floor((v - 1) / F.col("side")).cast("long")
    rows = pieces.withColumn("gy", F.explode(F.sequence(cell(F.col("ay")), cell(F.col("by")))))
    # doubles are off by far less than 2
    slope = F.try_divide((F.col("bx") - F.col("ax")).cast("double"), (F.col("by") - F.col("ay")).cast("double"))
    at = lambda y: F.when(F.col("by") == F.col("ay"), None).otherwise(F.col("ax") + (y - F.col("ay")) * slope)
    low, high = F.greatest(F.col("ay"), F.col("gy") * F.col("side") + 1), F.least(F.col("by"), (F.col("gy") + 1) * F.col("side") + 1)
    ends = [F.coalesce(at(low), F.col("ax").cast("double")), F.coalesce(at(high), F.col("bx").cast("double"))]
    x0 = F.greatest(F.least(*ends) - 2, F.least("ax", "bx").cast("double"))
    x1 = F.least(F.greatest(*ends) + 2, F.greatest("ax", "bx").cast("double"))
    return rows.withColumn("gx", F.explode(F.sequence(cell(x0), cell(x1))))


def turns(ax, ay, bx, by, px, py) -> np.ndarray:
    """The exact sign of the turn a, b, p: 1 to the left. Doubles decide where they can, whole numbers of any size elsewhere."""
    left, right = (bx - ax).astype(np.float64) * (py - ay), (by - ay).astype(np.float64) * (px - ax)
    d = left - right
    out = np.sign(d).astype(np.int64)
    size = np.abs(left) + np.abs(right)
    unsure = np.flatnonzero((np.abs(d) <= size * 1e-14) & (size >= EXACT))
    for k in unsure:
        e = int(bx[k] - ax[k]) * int(py[k] - ay[k]) - int(by[k] - ay[k]) * int(px[k] - ax[k])
        out[k] = (e > 0) - (e < 0)
    return out


def spans(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for every i and each j from low[i] to below high[i], a bounded number at a time."""
    counts = high - low
    upto = np.cumsum(counts)
    start = 0
    while start < len(counts):
        before = upto[start] - counts[start]
        end = max(start + 1, int(np.searchsorted(upto, before + (1 << 18), side="right")))
        n = counts[start:end]
        yield np.repeat(np.arange(start, end), n), np.arange(n.sum()) + np.repeat(low[start:end] - (upto[start:end] - n - before), n)
        start = end


def ranked(group: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The values as numbers in the order of (group, value)."""
    known, number = np.unique(np.concatenate(values), return_inverse=True)
    return [group * len(known) + part for part in np.split(number, len(values))]


def close_pairs(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of boxes of a group that meet, a bounded number at a time: in the order of x0 a box meets followers up to its x1."""
    low, high = ranked(np.zeros(len(x0), dtype=np.int64) if group is None else group, x0, x1)
    order = np.argsort(low, kind="stable")
    last = np.searchsorted(low[order], high[order], side="right")
    for i, j in spans(np.arange(1, len(order) + 1), last):
        i, j = order[i], order[j]
        meet = (y0[i] <= y1[j]) & (y0[j] <= y1[i])
        yield i[meet], j[meet]


def nearest_even(top: int, below: int) -> int:
    """The even number nearest to top / below, the higher one of two."""
    if below < 0:
        top, below = -top, -below
    return (top + below) // (2 * below) * 2


def crossing(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, int]:
    """Where two segments that cross do so, rounded to the lattice."""
    dx, dy, ex, ey = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    below = dx * ey - dy * ex
    t = (b[0] - a[0]) * ey - (b[1] - a[1]) * ex
    return nearest_even(a[0] * below + t * dx, below), nearest_even(a[1] * below + t * dy, below)


def crossings(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """crossing() of rows."""
    d, e, off = p[:, 2:] - p[:, :2], q[:, 2:] - q[:, :2], q[:, :2] - p[:, :2]
    # what is below 2^30 needs 62 bits: products of three wrap around, their differences do not
    below, t = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0], off[:, 0] * e[:, 1] - off[:, 1] * e[:, 0]
    below, t = np.abs(below), t * np.sign(below)
    out = p[:, :2].copy()
    for v in (0, 1):
        steps = np.rint(t.astype(np.float64) / below * d[:, v] / 2).astype(np.int64) * 2
        rest = t * d[:, v] - steps * below
        out[:, v] += steps + 2 * (rest >= below) - 2 * (rest < -below)
    for k in np.flatnonzero((np.abs(np.hstack([d, e])) >= 1 << 30).any(axis=1)):
        out[k] = crossing(tuple(map(int, p[k])), tuple(map(int, q[k])))
    return out


def split_points(s: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """piece, (x, y), moved: where pieces (rows ax, ay, bx, by) of a group are to be split so that they meet at ends alone, and whether rounding takes the point off the piece."""
    box = np.minimum(s[:, 0], s[:, 2]), np.maximum(s[:, 0], s[:, 2]), s[:, 1], s[:, 3]
    found = [(np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=bool))]
    for i, j in close_pairs(*box, group):
        p, q = s[i], s[j]
        c1, c2 = turns(*p.T, q[:, 0], q[:, 1]), turns(*p.T, q[:, 2], q[:, 3])
        c3, c4 = turns(*q.T, p[:, 0], p[:, 1]), turns(*q.T, p[:, 2], p[:, 3])
        k = np.flatnonzero((c1 * c2 < 0) & (c3 * c4 < 0))
        at = crossings(p[k], q[k])
        for piece, own in ((i[k], p[k]), (j[k], q[k])):
            cut = (at != own[:, :2]).any(axis=1) & (at != own[:, 2:]).any(axis=1)
            found.append((piece[cut], at[cut], turns(*own[cut].T, *at[cut].T) != 0))
        # an end of one lies within the other
        for turn, own, other, of, ends in ((c1, q, p, i, (0, 1)), (c2, q, p, i, (2, 3)), (c3, p, q, j, (0, 1)), (c4, p, q, j, (2, 3))):
            k = np.flatnonzero(turn == 0)
            at, other, of = own[k][:, ends], other[k], of[k]
            x, y = at.T
            within = (np.minimum(other[:, 0], other[:, 2]) <= x) & (x <= np.maximum(other[:, 0], other[:, 2])) & (other[:, 1] <= y) & (y <= other[:, 3])
            cut = within & (at != other[:, :2]).any(axis=1) & (at != other[:, 2:]).any(axis=1)
            found.append((of[cut], at[cut], np.zeros(cut.sum(), dtype=bool)))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def split(pieces: DataFrame) -> tuple[DataFrame, bool]:
    """The pieces, cut where they meet, and whether any was cut."""

    def points(pdf: pd.DataFrame) -> pd.DataFrame:
        piece, at, _ = split_points(pdf[list(SEGMENT)].to_numpy(dtype=np.int64))
        own = pdf.iloc[piece]
        return pd.DataFrame({"key": own["key"].to_numpy(), **{c: own[c].to_numpy() for c in SEGMENT}, "x": at[:, 0], "y": at[:, 1]}).drop_duplicates()

    kind = pieces.schema["key"].dataType.simpleString()
    listed = by_cell(pieces)
    # a cell with one piece has nothing to split
    cuts = written(listed.groupBy("key", "gx", "gy").applyInPandas(points, f"key {kind}, {', '.join(f'{c} long' for c in SEGMENT)}, x long, y long"), "cuts")
    if cuts.isEmpty():
        deleted(cuts)
        return pieces, False
    # along a piece: pieces run upwards, level ones to the right, and so do those that rounding has turned by a step
    along = ((F.col("x") - F.col("ax")) * (F.col("bx") - F.col("ax")).cast("double") + (F.col("y") - F.col("ay")) * (F.col("by") - F.col("ay")).cast("double")).alias("t")
    at = F.struct(along, "x", "y")
    ordered = cuts.groupBy("key", *SEGMENT).agg(F.sort_array(F.collect_set(at)).alias("cuts"))
    met = pieces.join(ordered, ["key", *SEGMENT], "left")
    point = lambda x, y: F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    path = F.concat(point("ax", "ay"), F.coalesce(F.transform("cuts", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))), F.array().cast("array<struct<x:bigint,y:bigint>>")), point("bx", "by"))
    met = met.withColumn("path", path).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("path") - 1)))
    a, b = F.col("path")[F.col("i") - 1], F.col("path")[F.col("i")]
    parts = met.select("key", "side", a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"), "ds", "dc")
    sides = pieces.select("key", "side").distinct()
    out = written(merged(parts).join(sides, "key"), "pieces")
    deleted(cuts)
    return out, True


def arrangement(subjects: DataFrame, clips: DataFrame, key: str) -> DataFrame:
    """Pieces of both that meet at ends alone: key, ends, ds, dc, side."""
    held = written(with_grid(merged(segments(subjects, key, 0).unionByName(segments(clips, key, 1)))), "pieces")
    for _ in range(ROUNDS):
        after, cut = split(held)
        if not cut:
            return held
        deleted(held)
        held = after
    raise RuntimeError(f"pieces still cross after {ROUNDS} rounds")


def windings(pieces: DataFrame) -> DataFrame:
    """pieces with ws and wc: the winding numbers to their left (above level ones)."""
    side = F.col("side")
    # crossings of the lines below rows of cells, by the column of cells in which they lie
    gy = F.explode(F.sequence(F.floor((F.col("ay") - 1) / side).cast("long") + 1, F.floor((F.col("by") - 1) / side).cast("long")))
    lines = pieces.filter(F.floor((F.col("ay") - 1) / side) < F.floor((F.col("by") - 1) / side)).withColumn("gy", gy)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    # exact: floor((x - 1) / side) of the crossing x of the line y = gy * side + 1, as one fraction
    top = (wide("ax") - 1) * (wide("by") - wide("ay")) + ((F.col("gy") * side + 1).cast("decimal(20,0)") - wide("ay")) * (wide("bx") - wide("ax"))
    below = (wide("by") - wide("ay")) * side.cast("decimal(12,0)")
    lines = lines.withColumn("top", top.cast("decimal(38,0)")).withColumn("below", below.cast("decimal(38,0)"))
    quotient = F.expr("top div below")
    down = F.when((F.expr("top % below") != 0) & (F.col("top") < 0), quotient - 1).otherwise(quotient)
    crossed = lines.groupBy("key", "gy", down.alias("gx")).agg(F.sum("ds").alias("cs"), F.sum("dc").alias("cc"))
    middle = lambda a, b, s: F.floor(((F.col(a) + F.col(b)) / 2 - 1) / s).cast("long")
    home = pieces.select("key", middle("ay", "by", side).alias("gy"), middle("ax", "bx", side).alias("gx")).distinct()
    none = [F.lit(0).cast("long").alias(c) for c in ("cs", "cc")]
    rows = crossed.withColumn("wanted", F.lit(0)).unionByName(home.select("*", *none, F.lit(1).alias("wanted")))
    rows = rows.groupBy("key", "gy", "gx").agg(F.sum("cs").alias("cs"), F.sum("cc").alias("cc"), F.max("wanted").alias("wanted"))
    # a window runs along a row of cells, from the right
    along = Window.partitionBy("key", "gy").orderBy(F.col("gx").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    corner = rows.withColumn("ks", F.sum("cs").over(along)).withColumn("kc", F.sum("cc").over(along)).filter("wanted = 1").select("key", "gx", "gy", "ks", "kc")
    inner = by_cell(pieces).join(corner, ["key", "gx", "gy"])

    def beside(pdf: pd.DataFrame) -> pd.DataFrame:
        side, gx, gy = int(pdf["side"].iloc[0]), int(pdf["gx"].iloc[0]), int(pdf["gy"].iloc[0])
        s = pdf[list(SEGMENT)].to_numpy(dtype=np.int64)
        d = pdf[["ds", "dc"]].to_numpy(dtype=np.int64)
        mx, my = (s[:, 0] + s[:, 2]) // 2, (s[:, 1] + s[:, 3]) // 2
        own = np.flatnonzero(((mx - 1) // side == gx) & ((my - 1) // side == gy))
        x0 = np.full(1, gx * side + 1)
        out = np.zeros((len(own), 2), dtype=np.int64)
        lift = (np.minimum(s[:, 0], s[:, 2]) < x0) & (np.maximum(s[:, 0], s[:, 2]) > x0)
        right = np.sign(s[:, 2] - s[:, 0])
        step = max(1, (1 << 20) // max(len(s), 1))
        for at in range(0, len(own), step):
            m = own[at : at + step]
            # to the right from the left border, at the middle's height and a little above: pieces whose height holds it
            k, p = np.nonzero((s[None, :, 1] <= my[m][:, None]) & (my[m][:, None] < s[None, :, 3]))
            p_mid = m[k]
            before = turns(*s[p].T, mx[p_mid], my[p_mid]) < 0
            start = turns(*s[p].T, np.broadcast_to(x0, len(p)), my[p_mid])
            after = (start > 0) | ((start == 0) & (right[p] > 0))
            hit = before & after & (p != p_mid)
            np.subtract.at(out, at + k[hit], d[p[hit]])
            # up the left border: pieces that cross it between the corner and that height
            k, p = np.nonzero(np.broadcast_to(lift, (len(m), len(s))))
            y0 = np.full(len(p), gy * side + 1)
            high = turns(*s[p].T, np.broadcast_to(x0, len(p)), my[m[k]]) * right[p] >= 0
            # a piece through the corner itself: the corner stands for a point a little to its left
            below = turns(*s[p].T, np.broadcast_to(x0, len(p)), y0) * right[p]
            low = (below < 0) | ((below == 0) & (right[p] < 0))
            hit = high & low & ((p != m[k]) | (right[p] > 0))
            np.add.at(out, at + k[hit], d[p[hit]] * right[p[hit]][:, None])
        found = pdf.iloc[own]
        return found[["key", *SEGMENT, "ds", "dc"]].assign(ws=found["ks"].to_numpy() + out[:, 0], wc=found["kc"].to_numpy() + out[:, 1])

    kind = pieces.schema["key"].dataType.simpleString()
    names = ", ".join(f"{c} long" for c in (*SEGMENT, "ds", "dc", "ws", "wc"))
    return inner.groupBy("key", "gx", "gy").applyInPandas(beside, f"key {kind}, {names}")


#: Whether a place that lies in the subject (s) and the clip (c) or not lies in the result: of columns or arrays.
INSIDE = {"union": lambda s, c: s | c, "intersection": lambda s, c: s & c, "difference": lambda s, c: s & ~c, "xor": lambda s, c: s != c}


def checked(operations: Sequence[str]) -> Sequence[str]:
    wrong = set(operations) - set(OPERATIONS)
    if wrong:
        raise ValueError(f"no operation {sorted(wrong)[0]}; there are {', '.join(OPERATIONS)}")
    return operations


def bounding(pieces: DataFrame, operations: Sequence[str]) -> DataFrame:
    """The pieces of windings() that bound each result, with its inside to their left: key, operation, ax, ay, bx, by."""
    each = []
    for operation in checked(operations):
        inside = INSIDE[operation]
        left = inside(F.col("ws") != 0, F.col("wc") != 0)
        right = inside(F.col("ws") != F.col("ds"), F.col("wc") != F.col("dc"))
        each.append(F.struct(F.lit(operation).alias("operation"), left.alias("left"), (left != right).alias("bounds")))
    pieces = pieces.withColumn("o", F.explode(F.array(*each))).filter("o.bounds")
    turned = [F.when(F.col("o.left"), F.col(c)).otherwise(F.col(o)).alias(c) for c, o in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))]
    return pieces.select("key", "o.operation", *turned)


def _side(d: tuple[int, int], zero: tuple[int, int]) -> int:
    cross = zero[0] * d[1] - zero[1] * d[0]
    ahead = zero[0] * d[0] + zero[1] * d[1]
    return 0 if cross == 0 and ahead > 0 else 1 if cross > 0 else 2 if cross == 0 else 3


def _next(back: tuple[int, int], ways: list[tuple[int, int]]) -> int:
    """Of directions, the first in clockwise order from `back`."""

    def order(i: int, j: int) -> int:
        a, b = ways[i], ways[j]
        sa, sb = _side(a, back), _side(b, back)
        if sa != sb:
            return sb - sa
        cross = a[0] * b[1] - a[1] * b[0]
        return (cross > 0) - (cross < 0)

    # anticlockwise angles from `back`, the greatest first
    return min(range(len(ways)), key=functools.cmp_to_key(order))


def ring_area(ring: list[tuple[int, int]]) -> int:
    """Twice the signed area of an open ring."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))


def rings_of(pieces: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Rings, inside to the left; rings that touch at a corner stay apart where their insides do."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for ax, ay, bx, by in sorted(pieces):
        out[ax, ay].append((bx, by))
    rings = []
    for start in sorted(out):
        while out[start]:
            ring, at, to = [start], start, out[start].pop(0)
            first = to
            while True:
                ways = out[to]
                # the ring shuts where it would go on along its first piece
                dirs = [(x - to[0], y - to[1]) for x, y in ways]
                back = (at[0] - to[0], at[1] - to[1])
                if to == start:
                    if not ways or _next(back, [*dirs, (first[0] - to[0], first[1] - to[1])]) == len(dirs):
                        break
                ring.append(to)
                at, to = to, ways.pop(_next(back, dirs))
            rings.append(ring)
    return rings


def holds(ring: np.ndarray, x: int, y: int) -> bool:
    """Whether an open ring of whole numbers holds a point that is not on it."""
    a, b = ring, np.roll(ring, -1, axis=0)
    up = (a[:, 1] <= y) & (b[:, 1] > y)
    down = (b[:, 1] <= y) & (a[:, 1] > y)
    k = np.flatnonzero(up | down)
    turn = turns(a[k, 0], a[k, 1], b[k, 0], b[k, 1], np.full(len(k), x), np.full(len(k), y))
    return bool(np.sum(np.where(up[k], turn > 0, 0)) - np.sum(np.where(down[k], turn < 0, 0)))


def polygons_of(rings: list[list[tuple[int, int]]]) -> list[list[list[list[float]]]]:
    """Shells with their holes, in px; each hole goes to the smallest shell that holds it."""
    areas = [ring_area(r) for r in rings]
    shells = sorted((k for k, a in enumerate(areas) if a > 0), key=lambda k: (areas[k], rings[k]))
    arrays = {k: np.array(rings[k], dtype=np.int64) for k in shells}
    boxes = np.array([[*arrays[k].min(0), *arrays[k].max(0)] for k in shells]).reshape(-1, 4)
    held: dict[int, list[int]] = {k: [] for k in shells}
    for k, a in enumerate(areas):
        if a < 0:
            (ax, ay), (bx, by) = rings[k][0], rings[k][1]
            x, y = (ax + bx) // 2, (ay + by) // 2
            near = np.flatnonzero((boxes[:, 0] <= x) & (x <= boxes[:, 2]) & (boxes[:, 1] <= y) & (y <= boxes[:, 3]))
            held[next(shells[i] for i in near if holds(arrays[shells[i]], x, y))].append(k)
    shut = lambda k: [[x / (LATTICE * STEP), y / (LATTICE * STEP)] for x, y in [*rings[k], rings[k][0]]]
    return [[shut(k), *map(shut, sorted(held[k]))] for k in sorted(shells, key=lambda k: rings[k])]


def packed(xy: np.ndarray) -> np.ndarray:
    """Corners as numbers in the order of x and y, both within REACH."""
    return (xy[:, 0] << 31) + xy[:, 1]


def begins(*columns: np.ndarray) -> np.ndarray:
    """The rows that differ from the row before."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def merged_rows(s: np.ndarray, d: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """merged() of arrays, in the order of groups and ends."""
    down = ((s[:, 3] < s[:, 1]) | ((s[:, 3] == s[:, 1]) & (s[:, 2] < s[:, 0])))[:, None]
    s, d = np.where(down, s[:, [2, 3, 0, 1]], s), np.where(down, -d, d)
    a, b = packed(s), packed(s[:, 2:])
    order = np.lexsort((b, a, group))
    order = order[a[order] != b[order]]
    s, d, group = s[order], d[order], group[order]
    first = begins(group, a[order], b[order])
    if len(first) < len(s):
        s, d, group = s[first], np.add.reduceat(d, first), group[first]
    kept = (d[:, 0] != 0) | (d[:, 1] != 0)
    return s[kept], d[kept], group[kept]


def cut_rows(s: np.ndarray, piece: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces cut at points, and the piece that each part is of."""
    own, x, y = s[piece], at[:, 0], at[:, 1]
    along = (x - own[:, 0]) * (own[:, 2] - own[:, 0]).astype(np.float64) + (y - own[:, 1]) * (own[:, 3] - own[:, 1]).astype(np.float64)
    order = np.lexsort((packed(at), along, piece))
    order = order[begins(piece[order], packed(at)[order])]
    piece, at = piece[order], at[order]
    counts = np.bincount(piece, minlength=len(s))
    of = np.repeat(np.arange(len(s)), counts + 1)
    # the k-th point of all ends the part piece + k and begins the next one
    parts, k = s[of], np.arange(len(piece))
    parts[piece + k, 2:] = at
    parts[piece + k + 1, :2] = at
    return parts, of


def arranged(s: np.ndarray, d: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """arrangement() of arrays. A group is done when no point of its cuts was moved: its parts lie on pieces whose meeting points are all cuts."""
    done = []
    for _ in range(ROUNDS):
        s, d, group = merged_rows(s, d, group)
        piece, at, moved = split_points(s, group)
        parts, of = cut_rows(s, piece, at)
        open_ = np.isin(group[of], group[piece[moved]])
        done.append((parts[~open_], d[of[~open_]], group[of[~open_]]))
        if not open_.any():
            return merged_rows(*map(np.concatenate, zip(*done, strict=True)))
        s, d, group = parts[open_], d[of[open_]], group[of[open_]]
    raise RuntimeError(f"pieces still cross after {ROUNDS} rounds")


def windings_of(s: np.ndarray, d: np.ndarray, group: np.ndarray) -> np.ndarray:
    """windings() of arrays: the pieces to the left of each one's middle, at its height and a little above."""
    mx, my = (s[:, 0] + s[:, 2]) // 2, (s[:, 1] + s[:, 3]) // 2
    x0, x1 = np.minimum(s[:, 0], s[:, 2]), np.maximum(s[:, 0], s[:, 2])
    height, low, high = ranked(group, my, s[:, 1], s[:, 3])
    order = np.argsort(height, kind="stable")
    low, high = np.searchsorted(height[order], low), np.searchsorted(height[order], high)
    out = np.zeros_like(d)
    for p, m in spans(low, high):
        m = order[m]
        right = np.flatnonzero(mx[m] > x0[p])
        p, m = p[right], m[right]
        sure = mx[m] > x1[p]
        k = np.flatnonzero(~sure)
        sure[k] = turns(*s[p[k]].T, mx[m[k]], my[m[k]]) < 0
        for c in (0, 1):
            out[:, c] -= np.bincount(m[sure], d[p[sure], c], len(s)).astype(np.int64)
    return out


def goes_on(s: np.ndarray, group: np.ndarray) -> np.ndarray:
    """_next() of arrays: for pieces in the order of groups and ends, the piece that follows each one around the same inside."""
    n, a, b = len(s), packed(s), packed(s[:, 2:])
    order = np.lexsort((b, group))
    # as many pieces end at a corner as begin there
    if (group[order] != group).any() or (b[order] != a).any():
        raise RuntimeError("outlines that do not shut")
    first = begins(group, a)
    size = np.diff(np.append(first, n))
    low, size = np.repeat(first, size), np.repeat(size, size)
    best = np.arange(n)
    many = np.flatnonzero(size > 1)
    best[many] = low[many]
    ahead = s[:, 2:] - s[:, :2]
    back = -ahead[order]

    def turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        zero = np.zeros(len(a), dtype=np.int64)
        return turns(zero, zero, *a.T, *b.T)

    def side(k: np.ndarray, way: np.ndarray) -> np.ndarray:
        cross, dot = turn(back[k], ahead[way]), (back[k].astype(np.float64) * ahead[way]).sum(axis=1)
        return np.where(cross == 0, np.where(dot > 0, 0, 2), 2 - cross)

    step = 1
    while len(many):
        now, new = best[many], low[many] + step
        a, b = side(many, new), side(many, now)
        best[many] = np.where((a > b) | ((a == b) & (turn(ahead[new], ahead[now]) < 0)), new, now)
        step += 1
        many = many[size[many] > step]
    out = np.empty(n, dtype=np.int64)
    out[order] = best
    if n and np.bincount(out).max() > 1:
        raise RuntimeError("outlines that part")
    return out


def around(follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces ring by ring, each from its first piece on, and where rings begin."""
    ring, jump = np.arange(len(follows)), follows
    while (ring[jump] < ring).any():
        ring, jump = np.minimum(ring, ring[jump]), jump[jump]
    last = follows == ring
    jump, left = np.where(last, np.arange(len(follows)), follows), np.where(last, 0, 1)
    while (jump[jump] != jump).any():
        left, jump = left + left[jump], jump[jump]
    order = np.lexsort((-left, ring))
    return order, np.flatnonzero(ring[order] == order)


def geometries(s: np.ndarray, group: np.ndarray, n: int) -> pa.Array:
    """rings_of() and polygons_of() of arrays: the geometry of each of n groups."""
    order = np.lexsort((packed(s[:, 2:]), packed(s), group))
    s, group = s[order], group[order]
    order, first = around(goes_on(s, group))
    corners, unit = s[order, :2], group[order[first]]
    size = np.diff(np.append(first, len(order)))
    from_first = corners - np.repeat(corners[first], size, axis=0)
    after = np.arange(1, len(order) + 1)
    after[first + size - 1] = first
    area = np.add.reduceat(from_first[:, 0] * from_first[after, 1] - from_first[after, 0] * from_first[:, 1], first) if len(first) else np.zeros(0, dtype=np.int64)
    hole = area < 0
    shells = np.bincount(unit[~hole], minlength=n)
    shell = np.arange(len(first))
    of_unit = np.zeros(n, dtype=np.int64)
    of_unit[unit[~hole]] = shell[~hole]
    shell[hole] = of_unit[unit[hole]]
    for k in np.flatnonzero(hole & (shells[unit] > 1)):
        near = np.arange(np.searchsorted(unit, unit[k]), np.searchsorted(unit, unit[k], side="right"))
        near = near[~hole[near]]
        x, y = map(int, corners[first[k] : first[k] + 2].sum(axis=0) // 2)
        shell[k] = next(i for i in near[np.argsort(area[near], kind="stable")] if holds(corners[first[i] : first[i] + size[i]], x, y))
    rings = np.lexsort((np.arange(len(first)), hole, shell))
    size = size[rings] + 1
    # corners of each ring, and its first one once more
    ends = np.cumsum(size)
    at = np.arange(size.sum()) + np.repeat(first[rings] - (ends - size), size)
    at[ends - 1] = first[rings]
    offsets = lambda counts: pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    points = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(at) + 1, 2, dtype=np.int32)), pa.array((corners[at] / (LATTICE * STEP)).ravel()))
    polygons = pa.ListArray.from_arrays(offsets(np.bincount(shell, minlength=len(first))[~hole]), pa.ListArray.from_arrays(offsets(size), points))
    return pa.ListArray.from_arrays(offsets(shells), polygons)


def overlaid(clip: np.ndarray, hole: np.ndarray, size: np.ndarray, xy: np.ndarray, of: np.ndarray, n: int, operations: Sequence[str]) -> pa.Array:
    """Geometries of n keys by operation, from rings (of which key, of the clip or the subject, place in the polygon, number of corners) and all their corners in px."""
    kept = size > 2
    xy = xy[np.repeat(kept, size)] * LATTICE
    clip, hole, size, of = clip[kept], hole[kept], size[kept], of[kept]
    whole = np.trunc(xy)
    whole = (whole + np.sign(xy) * (np.abs(xy - whole) >= 0.5)).astype(np.int64) * STEP
    first = np.cumsum(size) - size
    after = np.arange(1, len(whole) + 1)
    after[first + size - 1] = first
    s = np.hstack([whole, whole[after]])
    u = (s - np.tile(np.repeat(whole[first], size, axis=0), 2)).astype(np.float64)
    turn = np.add.reduceat(u[:, 0] * u[:, 3] - u[:, 2] * u[:, 1], first) if len(first) else np.zeros(0)
    back = np.repeat((turn < 0) != (hole > 0), size)[:, None]
    s = np.where(back, s[:, [2, 3, 0, 1]], s)
    s, d, group = arranged(s, np.repeat(np.column_stack([1 - clip, clip]).astype(np.int64), size, axis=0), np.repeat(of, size))
    w = windings_of(s, d, group)
    bounds = []
    for k, operation in enumerate(operations):
        left, right = (INSIDE[operation](*(v != 0).T) for v in (w, w - d))
        b = np.flatnonzero(left != right)
        bounds.append((np.where(left[b][:, None], s[b], s[b][:, [2, 3, 0, 1]]), group[b] * len(operations) + k))
    return geometries(*map(np.concatenate, zip(*bounds, strict=True)), n * len(operations))


def together(rows: DataFrame, operations: Sequence[str]) -> DataFrame:
    """overlays() of rows (key, geometry, clip) whose keys have few corners each: many keys are worked on at once."""
    rings = rows.select("key", "clip", F.explode_outer("geometry").alias("polygon")).select("key", "clip", F.posexplode_outer("polygon").alias("hole", "ring"))
    held = F.collect_list(F.when(F.col("ring").isNotNull(), F.struct("clip", "hole", F.flatten("ring").alias("ring"))))
    keys = rings.groupBy("key").agg(held.alias("held"))

    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, held = batch.column("key"), batch.column("held")
            rings = pc.list_value_length(held).to_numpy(zero_copy_only=False)
            clip, hole, ring = held.flatten().flatten()
            clip, hole, size = clip.to_numpy(), hole.to_numpy(), pc.list_value_length(ring).to_numpy(zero_copy_only=False) // 2
            xy = ring.flatten().to_numpy().reshape(-1, 2)
            ring_ends, corner_ends = np.append(0, np.cumsum(rings)), np.append(0, np.cumsum(size))
            lots = corner_ends[ring_ends[1:]] // AT_ONCE
            starts = np.append(np.flatnonzero(np.append(True, lots[1:] != lots[:-1])), len(lots)) if len(lots) else []
            for a, b in zip(starts, starts[1:], strict=False):
                r = slice(ring_ends[a], ring_ends[b])
                shapes = overlaid(clip[r], hole[r], size[r], xy[corner_ends[r.start] : corner_ends[r.stop]], np.repeat(np.arange(b - a), rings[a:b]), b - a, operations)
                names = pa.array(list(operations) * int(b - a))
                yield pa.RecordBatch.from_arrays([key.take(pa.array(np.repeat(np.arange(a, b), len(operations)))), names, shapes], ["key", "operation", "geometry"])

    kind = keys.schema["key"].dataType.simpleString()
    return keys.mapInArrow(outlines, f"key {kind}, operation string, geometry {GEOMETRY}")


def by_cells(subjects: DataFrame, clips: DataFrame, operations: Sequence[str], key: str) -> DataFrame:
    """overlays() of keys of any number of corners: work is dealt by the cells of their grids."""
    keys = subjects.select(F.col(key).alias("key")).union(clips.select(F.col(key).alias("key"))).filter("key IS NOT NULL").distinct()
    keys = keys.select("key", F.explode(F.array(*map(F.lit, operations))).alias("operation"))
    given = lambda t: t.filter(F.col(key).isNotNull() & F.col("geometry").isNotNull()).select(key, "geometry")
    pieces = arrangement(given(subjects), given(clips), key)
    found = written(bounding(windings(pieces), operations), "bounds")
    deleted(pieces)

    def outline(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(map(tuple, pdf[list(SEGMENT)].to_numpy(dtype=np.int64).tolist()))
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "operation": pdf["operation"].iloc[:1], "geometry": [polygons_of(rings_of(rows))]})

    kind = found.schema["key"].dataType.simpleString()
    shapes = found.groupBy("key", "operation").applyInPandas(outline, f"key {kind}, operation string, geometry {GEOMETRY}")
    return keys.join(shapes, ["key", "operation"], "left").select("key", "operation", F.coalesce("geometry", F.from_json(F.lit("[]"), GEOMETRY)).alias("geometry"))


def overlays(subjects: DataFrame, clips: DataFrame, operations: Sequence[str] = OPERATIONS, key: str = "roi_id") -> DataFrame:
    """key, operation, geometry: the regions of subjects and clips under each key combined (rows of one key and table add up).

    Operations are union, intersection, difference (subject without clip) and xor; they share all work but the last
    step. A key of either table has a row an operation; where nothing is left its geometry is empty. Null geometries
    are empty; rows with a null key go. Columns beside key and geometry are never read.

    Keys of up to FEW corners are worked on in the task that has them, others by cells.
    """
    checked(operations)
    named = lambda t, clip: t.select(F.col(key).alias("key"), "geometry", F.lit(clip).alias("clip")).filter("key IS NOT NULL")
    rows = named(subjects, 0).unionByName(named(clips, 1))
    corners = F.when(F.col("geometry").isNull(), 0).otherwise(F.size(G.points(F.col("geometry"))))
    near = F.forall(G.points(F.col("geometry")), lambda p: (F.size(p) == 2) & (F.abs(p[0]) < REACH) & (F.abs(p[1]) < REACH))
    odd = F.col("geometry").isNotNull() & ~F.coalesce(near, F.lit(False))
    sizes = rows.groupBy("key").agg(F.sum(corners.cast("long")).alias("n"), F.max(odd).alias("odd"))
    many = written(sizes.filter((F.col("n") > FEW) | F.col("odd")).select("key"), "many")
    if many.isEmpty():
        deleted(many)
        return together(rows, operations).withColumnRenamed("key", key)
    large = rows.join(many, "key", "left_semi")
    large = by_cells(large.filter("clip = 0"), large.filter("clip = 1"), operations, "key")
    return together(rows.join(many, "key", "left_anti"), operations).unionByName(large).withColumnRenamed("key", key)


def overlay(subjects: DataFrame, clips: DataFrame, operation: str, key: str = "roi_id") -> DataFrame:
    """key, geometry: one operation of overlays()."""
    return overlays(subjects, clips, (operation,), key).drop("operation")
