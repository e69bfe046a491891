"""Labels smoothed in space by support vector machines.

A radial kernel on two standardised coordinates has few directions that matter. On a lattice finer than the kernel's
width it is, to about eight digits, a product of short feature vectors, so that the machine becomes linear in some hundred
features and each pass over the points is a sum: value, slope and curvature of the objective. Samples of up to `block`
places are solved in a task; larger ones are dealt out in parts whose sums are folded, 32 at a time, pass by pass. Their
passes begin at the optimum of one part, which is near that of all, so that few are left; the optimum itself is of all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import deleted, written

WIDTHS = (0.5, 0.05, 0.005)  # of the rounded corner of the hinge, one after another
STEPS = (1.0, 0.25, 0.03)
PASSES = 40  # for each width
FOLD = 32
FEATURES = 1500
STATE = "g string, a string, b string, w array<double>, d array<double>, f double, width int, passes int"

PARTS = "explode(sequence(0L, parts - 1))"
PAIRS = "inline(flatten(transform(labels, (a, i) -> transform(slice(labels, i + 2, size(labels)), b -> struct(a AS a, b AS b)))))"


def axis(cells, gamma: float):
    """Lattice nodes under the occupied cells of an axis and three beyond on each side, eigenvectors of the kernel between them, eigenvalues."""
    step = 0.5 / np.sqrt(2 * gamma)
    at = np.unique(np.add.outer(np.asarray(cells, dtype=np.int64), np.arange(-3, 5)).ravel()) * step
    values, vectors = np.linalg.eigh(np.exp(-gamma * np.subtract.outer(at, at) ** 2))
    keep = values > 1e-9
    return at, vectors[:, keep], values[keep]


def features(shape, gamma: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of features whose products are the kernel, and a constant."""
    sides, powers = [], []
    for name, v in (("x", x), ("y", y)):
        at, vectors, values = axis(shape[f"c{name}"], gamma)
        u = (v - shape[f"m{name}"]) / shape[f"s{name}"]
        sides.append(np.exp(-gamma * np.subtract.outer(u, at) ** 2) @ vectors / np.sqrt(values))
        powers.append(values)
    left, right = np.nonzero(np.outer(*powers) > 1e-8)
    if len(left) > FEATURES:
        raise ValueError(f"{len(left)} features; take a smaller gamma or divide the sample by tiles")
    return np.column_stack([sides[0][:, left] * sides[1][:, right], np.ones(len(x))])


def slopes(phi, sign, weight, w, h: float) -> np.ndarray:
    """Sums of loss, its gradient and the upper triangle of its curvature at w, in one array."""
    m = 1 - sign * (phi @ w)
    near = np.abs(m) < h
    loss = np.where(m >= h, m, np.where(near, (m + h) ** 2 / (4 * h), 0.0))
    pull = np.where(m >= h, 1.0, np.where(near, (m + h) / (2 * h), 0.0))
    part = phi[near] * (weight[near] / (2 * h))[:, None]
    return np.concatenate([[loss @ weight], -(phi.T @ (pull * weight * sign)), (part.T @ phi[near])[np.triu_indices(phi.shape[1])]])


def tried(state) -> list[np.ndarray]:
    """The places where a pass looks: w itself at first, then w and steps of d."""
    w, d = np.asarray(state["w"]), np.asarray(state["d"])
    return [w + t * d for t in STEPS] if len(d) else [w]


def moved(state, sums: np.ndarray, cost: float) -> dict:
    """The state after a pass: the best place looked at, the Newton direction from there; sharper corners once a width has settled."""
    size = len(state["w"])
    ridge = np.ones(size)
    ridge[-1] = 0.0  # the constant is free
    places = tried(state)
    values = [cost * s[0] + 0.5 * ridge @ (p * p) for p, s in zip(places, sums, strict=True)]
    k = int(np.argmin(values))
    first = not len(state["d"])
    out = dict(state, passes=state["passes"] + 1)
    if not first and values[k] > state["f"]:  # too far: look nearer
        out["d"] = (np.asarray(state["d"]) * 0.01).tolist()
        settled = np.abs(out["d"]).max() < 1e-9
    else:
        settled = not first and state["f"] - values[k] <= 1e-9 * abs(values[k])
        gradient = cost * sums[k][1 : 1 + size] + ridge * places[k]
        half = np.zeros((size, size))
        half[np.triu_indices(size)] = sums[k][1 + size :]
        curve = cost * (np.triu(half) + np.triu(half, 1).T) + np.diag(ridge)
        curve[-1, -1] += 1e-6 * cost
        out |= {"w": places[k].tolist(), "d": (-np.linalg.solve(curve, gradient)).tolist(), "f": float(values[k])}
    if settled or out["passes"] >= PASSES:
        out |= {"width": state["width"] + 1, "passes": 0, "d": []}
    return out


def _part(places: pd.DataFrame, shape, gamma: float, states) -> list[np.ndarray]:
    """The sums over some places of every place that the states look at."""
    phi = features(shape, gamma, places["x"].to_numpy(), places["y"].to_numpy())
    label, out = places["label"].to_numpy(), []
    for s in states:
        mine = (label == s["a"]) | (label == s["b"])
        sign, weight = np.where(label[mine] == s["a"], 1.0, -1.0), places["n"].to_numpy(dtype=float)[mine]
        out.append(np.array([slopes(phi[mine], sign, weight, p, WIDTHS[int(s["width"])]) for p in tried(s)]))
    return out


def _start(shape, gamma: float) -> dict:
    size = features(shape, gamma, np.zeros(0), np.zeros(0)).shape[1]
    return {"g": shape["g"], "a": shape["a"], "b": shape["b"], "w": [0.0] * size, "d": [], "f": 0.0, "width": 0, "passes": 0}


def _solved(places: DataFrame, shapes: DataFrame, again: DataFrame, gamma: float, cost: float, near: bool = False) -> DataFrame:
    """All passes for each pair of labels over places of a sample that fit a task, a pair a task.

    near: where the passes over a sample in parts begin, the optimum of places of one part, whose rows weigh as much as
    all; 0 where it has none of the pair. `again` is shapes once more, as both sides of a cogroup may not share columns.
    """

    def solve(_, held, both):
        if not len(both):
            return pd.DataFrame(columns=["g", "a", "b", "w", "d", "f", "width", "passes"])
        shape = both.iloc[0]
        s, much = _start(shape, gamma), cost * float(shape["parts"])
        if len(held):
            phi = features(shape, gamma, held["x"].to_numpy(), held["y"].to_numpy())
            sign, weight = np.where(held["label"] == s["a"], 1.0, -1.0), held["n"].to_numpy(dtype=float)
            while s["width"] < len(WIDTHS):
                s = moved(s, np.array([slopes(phi, sign, weight, w, WIDTHS[s["width"]]) for w in tried(s)]), much)
            if near:
                s |= {"d": [], "f": 0.0, "width": 1, "passes": 0}
        return pd.DataFrame([s])

    pairs = lambda table: table.select("*", F.expr(PAIRS))
    # few rows that make much work: a number of parts that is not cut down by their size
    dealt = lambda table: table.repartition(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", "a", "b").groupBy("g", "a", "b")
    mine = places.select("g", "x", "y", "label", "n").join(pairs(shapes).select("g", "a", "b"), "g").filter("label = a OR label = b")
    return dealt(mine).cogroup(dealt(pairs(again))).applyInPandas(solve, STATE)


def _again(table: DataFrame) -> DataFrame:
    """A written table read anew, as both sides of a cogroup may not share columns."""
    return table.sparkSession.read.schema(table.schema).parquet(table._work_path)


def _passes(places: DataFrame, shapes: DataFrame, again: DataFrame, gamma: float, cost: float) -> DataFrame:
    """The states of samples dealt out in parts, pass by pass; states are a table, of which a count alone reaches the driver."""
    spark = places.sparkSession

    def sums(key, held, both):
        states = [dict(r) for r in both[both["a"].notna()].to_dict("records")]
        shape = both[both["labels"].notna()]
        if not len(held) or not states or not len(shape):
            return pd.DataFrame(columns=["g", "a", "b", "part", "looked", "total"])
        found = _part(held, shape.iloc[0], gamma, states)
        return pd.DataFrame([{"g": key[0], "a": s["a"], "b": s["b"], "part": key[1], "looked": len(v), "total": v.ravel()} for s, v in zip(states, found, strict=True)])

    def fold(key, rows):
        return pd.DataFrame([{"g": key[0], "a": key[1], "b": key[2], "part": key[3], "looked": rows["looked"].iloc[0], "total": np.sum(np.vstack(rows["total"].to_numpy()), axis=0)}])

    def step(key, rows, held):
        if not len(rows) or not len(held):
            return pd.DataFrame(columns=["g", "a", "b", "w", "d", "f", "width", "passes"])
        return pd.DataFrame([moved(held.iloc[0].to_dict(), rows["total"].iloc[0].reshape(rows["looked"].iloc[0], -1), cost)])

    most = shapes.agg(F.max("parts")).first()[0]
    spread = shapes.withColumn("part", F.expr(PARTS))
    total = "g string, a string, b string, part long, looked int, total array<double>"
    places = written(places, "svm_dealt")
    state = written(_solved(places.filter("part = 0"), shapes, again, gamma, cost, near=True), "svm_state")
    over, ended = F.col("width") >= len(WIDTHS), []
    while True:
        left = {r["over"] for r in state.select(over.alias("over")).distinct().collect()}
        if True in left:
            ended.append(written(state.filter(over), "svm_model"))
        if False not in left:
            break
        live = state.filter(~over)
        sent = spread.unionByName(live.join(shapes.select("g", "parts"), "g").withColumn("part", F.expr(PARTS)), allowMissingColumns=True)
        table, left = places.groupBy("g", "part").cogroup(sent.groupBy("g", "part")).applyInPandas(sums, total), most
        while left > 1:
            table = table.withColumn("part", F.floor(F.col("part") / FOLD)).groupBy("g", "a", "b", "part").applyInPandas(fold, total)
            left = -(-left // FOLD)
        after = written(table.groupBy("g", "a", "b").cogroup(_again(state).filter(~over).groupBy("g", "a", "b")).applyInPandas(step, STATE), "svm_state")
        deleted(state)
        state = after
    deleted(places, state)
    return spark.read.schema(STATE).parquet(*[e._work_path for e in ended])


def refine_labels(points: DataFrame, label: str = "label", by: list[str] | None = None, cost: float = 1.0, gamma: float = 0.5, block: int = 20_000, out: str = "refined") -> DataFrame:
    """Each row with `out`, the label by a radial machine on (x, y) trained on the labelled rows of its sample, labels two by two, by votes.

    Samples are the values of `by` (columns such as sample and tile); none: all rows are one. Coordinates are standardised by the
    labelled rows. A tie of votes goes to the smallest label. A sample with one label gives it to all of its rows; one without
    labels leaves null. Null is a value of `by`. Rows without finite coordinates are an error. Rows that repeat a place
    count as often. All rows train, however many; `block` is the number of places of one part. Other columns pass through.
    """
    for name in (out, "__g", "__part"):
        if name in points.columns:
            raise ValueError(f"there is a column {name} already")
    fine = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") != float("inf")) & (F.abs("y") != float("inf"))
    key = F.to_json(F.array(*[F.col(c).cast("string") for c in by]), {"ignoreNullFields": "false"}) if by else F.lit("")
    at = points.select(key.alias("g"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(label).cast("string").alias("label"), fine.alias("fine"))
    bad = F.raise_error(F.lit("refinement needs finite coordinates")).cast("boolean")
    places = written(at.filter(F.when(F.col("fine"), F.lit(True)).otherwise(bad)).groupBy("g", "x", "y", "label").agg(F.count("*").alias("n")), "svm_places")
    known = F.col("label").isNotNull()
    mean = lambda c: F.sum(F.when(known, F.col(c) * F.col("n"))) / F.sum(F.when(known, F.col("n")))
    centre = places.groupBy("g").agg(mean("x").alias("mx"), mean("y").alias("my"), F.sum(F.when(known, F.col("n"))).alias("rows"), F.sort_array(F.collect_set("label")).alias("labels"), F.count("*").alias("k"))
    apart = places.join(centre, "g")
    spread = lambda c: F.sqrt(F.sum(F.when(known, F.col("n") * (F.col(c) - F.col(f"m{c}")) ** 2)) / F.greatest(F.max("rows") - 1, F.lit(1)))
    scales = apart.groupBy("g").agg(*[spread(c).alias(f"s{c}") for c in "xy"])
    one = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(1.0))
    shape = centre.join(scales, "g").withColumns({"sx": one("sx"), "sy": one("sy"), "parts": F.ceil(F.col("k") / block)})
    several = shape.filter(F.size("labels") > 1)
    lattice = 0.5 / (2 * gamma) ** 0.5
    cell = lambda c: F.floor((F.col(c) - F.col(f"m{c}")) / F.col(f"s{c}") / lattice)
    cells = places.join(several, "g").groupBy("g").agg(*[F.collect_set(cell(c)).alias(f"c{c}") for c in "xy"])
    shapes = written(several.join(cells, "g").drop("rows", "k"), "svm_shapes")
    dealt = places.join(_again(shapes).select("g", "parts"), "g").withColumn("part", F.pmod(F.xxhash64("x", "y"), "parts"))
    trained = dealt.filter(known)
    models = written(_solved(trained.filter("parts = 1"), shapes.filter("parts = 1"), _again(shapes).filter("parts = 1"), gamma, cost), "svm_model")
    large = shapes.filter("parts > 1")
    if large.limit(1).count():
        models = models.unionByName(_passes(trained.filter("parts > 1").drop("parts"), large, _again(shapes).filter("parts > 1"), gamma, cost))

    def vote(key, held, both):
        if not len(held):
            return pd.DataFrame(columns=["g", "x", "y", "found"])
        shape, machines = both[both["labels"].notna()].iloc[0], both[both["a"].notna()].sort_values(["a", "b"])
        labels = sorted(shape["labels"])
        phi, votes = features(shape, gamma, held["x"].to_numpy(), held["y"].to_numpy()), np.zeros((len(held), len(labels)), dtype=int)
        for m in machines.itertuples():
            first = phi @ np.asarray(m.w) > 0
            votes[:, labels.index(m.a)] += first
            votes[:, labels.index(m.b)] += ~first
        return pd.DataFrame({"g": held["g"], "x": held["x"], "y": held["y"], "found": np.asarray(labels, dtype=object)[votes.argmax(axis=1)]})

    sent = shapes.withColumn("part", F.expr(PARTS)).unionByName(models.select("g", "a", "b", "w").join(shapes.select("g", "parts"), "g").withColumn("part", F.expr(PARTS)), allowMissingColumns=True)
    asked = dealt.select("g", "x", "y", "part").distinct()
    voted = asked.groupBy("g", "part").cogroup(sent.groupBy("g", "part")).applyInPandas(vote, "g string, x double, y double, found string")
    single = places.join(shape.filter(F.size("labels") == 1).select("g", F.get("labels", F.lit(0)).alias("found")), "g").select("g", "x", "y", "found").distinct()
    answers = written(voted.unionByName(single), "svm_labels").select(F.col("g").alias("__g"), F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("found").alias(out))
    rows = points.withColumn("__g", key)
    same = (rows["__g"] == answers["__g"]) & (rows["x"].cast("double") == answers["__x"]) & (rows["y"].cast("double") == answers["__y"])
    return rows.join(answers, same, "left").select(*[rows[c] for c in points.columns], answers[out])
