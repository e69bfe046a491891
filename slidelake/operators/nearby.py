"""Which targets can be nearest to a point: a search over cells of a tree, for any density and any distance.

Both sides are summed up in square cells, each with its number and the tight box of what it holds. Pairs of a query
cell and a target cell go down the tree together, 16 cells for one. A pair stays while the least distance of its boxes
is no more than the query cell's bound, the smallest of the greatest distances to its target cells. Pairs of small cells
are set aside; each of their queries gets a bound of its own, and what is left meets the points; dense cells go further down. So work follows the number of
points, also where all targets are far away or a third of the points lie in one spot.

A query cell that many target cells surround at one distance keeps them all: no bound can tell them apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import deleted, written

#: Cells of up to so many members go no further down.
SMALL = 12
#: Of 4^13 cells a side; those that are full even there are joined as they are.
DEEPEST = 13
SLACK = 1 + 1e-9
BOX = ("x0", "y0", "x1", "y1")
WIDE = 1 << 26


def _code(level: int, box: str, frame: dict) -> str:
    """SQL: the cell of a level that holds the middle of a box with columns of this prefix."""
    side = 4**level
    at = lambda v: f"CAST(least({side - 1}, greatest(0, floor((({box}{v}0 + {box}{v}1) / 2 - {frame[v]!r}D) / {frame['extent']!r}D * {side}))) AS BIGINT)"
    return f"{at('x')} * {WIDE} + {at('y')}"


def _cells(rows: DataFrame, level: int, frame: dict, up: int, side: str) -> DataFrame:
    table = rows.groupBy(F.expr(_code(level, "", frame)).alias("cell")).agg(*[F.expr(e) for e in ("count(*) AS n", "min(x0) AS x0", "min(y0) AS y0", "max(x1) AS x1", "max(y1) AS y1")])
    parent = f"shiftright(cell DIV {WIDE}, {2 * up}) * {WIDE} + shiftright(cell % {WIDE}, {2 * up})"
    return table.selectExpr(f"{parent} AS {side}_up", *[f"{c} AS {side}_{c}" for c in ("cell", "n", *BOX)])


def gap(a: str, b: str) -> str:
    """SQL: the least distance of two boxes."""
    x, y = (f"greatest({a}_{v}0 - {b}_{v}1, {b}_{v}0 - {a}_{v}1, 0D)" for v in "xy")
    return f"sqrt({x} * {x} + {y} * {y})"


def reach(a: str, b: str) -> str:
    """SQL: the greatest distance of points of two boxes."""
    x, y = (f"greatest({a}_{v}1 - {b}_{v}0, {b}_{v}1 - {a}_{v}0)" for v in "xy")
    return f"sqrt({x} * {x} + {y} * {y})"


def _tightened(pairs: DataFrame, by: str, counts: str = "true") -> DataFrame:
    """The pairs that the smallest greatest distance of their query cell leaves, with it as their bound; only pairs where `counts` holds give one."""
    columns = [c for c in pairs.columns if c != "bound"]
    own = f"min(CASE WHEN {counts} THEN {reach('q', 't')} END) OVER (PARTITION BY {by}) * {SLACK}D"
    return pairs.selectExpr(*columns, f"least(bound, {own}) AS bound").filter(f"{gap('q', 't')} <= bound")


def candidates(query: DataFrame, target: DataFrame, not_self: bool = False) -> tuple[DataFrame | None, list[DataFrame]]:
    """Every pair of query(q, x0, y0, x1, y1) and target(t, x0, y0, x1, y1) that can be the query's nearest, as columns q, t, q_x0, ...; None where a side is empty. And the written tables that these rows are read from.

    A query is a point (x0 = x1, y0 = y1), a target a box about some shape that touches its sides. With not_self both
    sides are one set of different points, and a point is no candidate of its own.
    """
    box = lambda df: df.selectExpr("min(x0) AS x0", "min(y0) AS y0", "max(x1) AS x1", "max(y1) AS y1").first()
    a, b = box(query), box(target)
    if a["x0"] is None or b["x0"] is None:
        return None, []
    low = {v: min(a[f"{v}0"], b[f"{v}0"]) for v in "xy"}
    frame = {**low, "extent": max(max(a[f"{v}1"], b[f"{v}1"]) - low[v] for v in "xy") or 1.0}
    spark, level, up = query.sparkSession, 2, 2
    pairs = spark.range(1).selectExpr("0L AS q_up", "0L AS t_up", "double('infinity') AS bound", *[f"{a[c]!r}D AS q_{c}" for c in BOX])
    found: DataFrame | None = None
    rounds: list[DataFrame] = []
    named = lambda df, side, cell: df.selectExpr(side, *[f"{c} AS {side}_{c}" for c in BOX], f"{_code(level, '', frame)} AS {cell}")
    boxes = lambda side, out: [f"{side}_{c} AS {out}_{c}" for c in BOX]
    while True:
        # first the targets go down, so that few of their cells are left when the queries do
        met = pairs.join(_cells(target, level, frame, up, "t"), "t_up").filter(f"{gap('q', 't')} <= bound")
        met = _tightened(met, "q_up", "q_up <> t_up OR t_n > 1" if not_self else "true").drop(*[f"q_{c}" for c in BOX])
        met = met.join(_cells(query, level, frame, up, "q"), "q_up").filter(f"{gap('q', 't')} <= bound")
        if not_self:
            met = met.filter("q_cell <> t_cell OR t_n > 1")
        met = _tightened(met, "q_cell")
        held = met.selectExpr("q_cell", "t_cell", "bound", *boxes("q", "q"), *boxes("t", "b"), f"(q_n <= {SMALL} AND t_n <= {SMALL}) OR {level == DEEPEST} AS small")
        held = written(held, "cell-pairs")
        near = held.filter("small").drop("small", *[f"q_{c}" for c in BOX]).join(named(query, "q", "q_cell"), "q_cell").withColumn("least", F.expr(gap("q", "b"))).filter("least <= bound")
        own = near.groupBy("q").agg(F.expr(f"min({reach('q', 'b')}) * {SLACK}D AS own"))
        near = near.join(own, "q").filter("least <= own").select("q", *[f"q_{c}" for c in BOX], "t_cell")
        near = near.join(named(target, "t", "t_cell"), "t_cell").drop("t_cell")
        found = near if found is None else found.unionByName(near)
        pairs = held.filter("NOT small").selectExpr("q_cell AS q_up", "t_cell AS t_up", "bound", *boxes("q", "q"))
        rounds.append(held)
        if pairs.isEmpty():
            return found, rounds
        level, up = level + 1, 1


def nearest_point(query: DataFrame, target: DataFrame, not_self: bool = False) -> DataFrame | None:
    """q, t, d: the nearest target point of each query point, the smallest t on ties; written."""
    met, rounds = candidates(query, target, not_self)
    if met is None:
        return None
    if not_self:
        met = met.filter("q_x0 <> t_x0 OR q_y0 <> t_y0")
    d = "sqrt((q_x0 - t_x0) * (q_x0 - t_x0) + (q_y0 - t_y0) * (q_y0 - t_y0))"
    best = met.groupBy("q").agg(F.expr(f"min(struct({d} AS d, t)) AS best"))
    out = written(best.select("q", "best.t", "best.d"), "nearest")
    deleted(*rounds)
    return out
