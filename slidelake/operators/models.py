"""Feature preparation and a partial-least-squares discriminant classifier (I, N28-N33)."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import deleted, written


@dataclass
class Recipe:
    """Features kept, by their places in the vector, with their means and scales (training rows only)."""

    at: list[int]
    mean: list[float]
    scale: list[float]


def fit_recipe(train: DataFrame, vector: str, max_features: int | None = None, scale: bool = True) -> Recipe:
    """Of the training rows, features with at least two finite values and a variance; by variance, then place; nulls later become the mean."""
    long = train.select(F.posexplode(vector).alias("at", "v")).withColumn("v", F.col("v").cast("double")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    n = train.count()
    stats = long.groupBy("at").agg(F.count("*").alias("k"), F.avg("v").alias("m"), F.var_samp("v").alias("s2")).filter("k >= 2 AND s2 > 0")
    # filled in with the mean, missing values add nothing to the sum of squares
    stats = stats.withColumn("s2", F.col("s2") * (F.col("k") - 1) / F.lit(max(n - 1, 1)))
    stats = stats.orderBy(F.col("s2").desc(), "at").limit(max_features) if max_features else stats
    rows = sorted(stats.collect(), key=lambda r: r["at"])  # a row a feature
    return Recipe([r["at"] for r in rows], [r["m"] for r in rows], [r["s2"] ** 0.5 if scale else 1.0 for r in rows])


def apply_recipe(df: DataFrame, recipe: Recipe, vector: str, out: str = "x") -> DataFrame:
    """The kept features centred and scaled, missing ones 0."""
    kept = F.arrays_zip(F.lit(recipe.at).alias("i"), F.lit(recipe.mean).alias("m"), F.lit(recipe.scale).alias("s"))
    one = lambda f: F.coalesce(F.nanvl((F.get(F.col(vector), f["i"]).cast("double") - f["m"]) / f["s"], F.lit(0.0)), F.lit(0.0))
    return df.withColumn(out, F.transform(kept, one) if recipe.at else F.array().cast("array<double>"))


def summed(df: DataFrame, x: str, columns: list[str], part) -> np.ndarray:
    """The sum over the batches of every task of part(matrix of x, frame of columns), a matrix; one matrix a task is summed by Spark."""

    def run(batches):
        import pandas as pd

        total = None
        for pdf in batches:
            if len(pdf):
                found = part(np.vstack(pdf["x"].to_numpy()), pdf)
                total = found if total is None else total + found
        if total is not None:
            yield pd.DataFrame({"i": np.repeat(np.arange(total.shape[0]), total.shape[1]), "j": np.tile(np.arange(total.shape[1]), total.shape[0]), "v": total.ravel()})

    sums = df.select(F.col(x).alias("x"), *columns).mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((sums["i"].max() + 1, sums["j"].max() + 1))
    out[sums["i"], sums["j"]] = sums["v"]
    return out


def simpls(df: DataFrame, x: str, xy: np.ndarray, components: int) -> np.ndarray:
    """SIMPLS weights R (features x components) of centred data, from X'Y and a pass over the rows for each component: X'(X r), so that no features x features matrix is built."""
    s, weights, loads = xy.copy(), [], []
    for _ in range(components):
        if np.abs(s).max() < 1e-12:
            break
        r = np.linalg.svd(s, full_matrices=False)[0][:, 0]
        r = r * np.sign(r[np.argmax(np.abs(r))])
        p = summed(df, x, [], lambda m, _, r=r: (m.T @ (m @ r))[:, None])[:, 0]
        length = np.sqrt(r @ p)
        if length < 1e-12:
            break
        r, p = r / length, p / length
        v = p.copy()
        for w in loads:
            v -= w * (w @ p)
        v /= np.linalg.norm(v)
        s = s - np.outer(v, v @ s)
        weights.append(r)
        loads.append(v)
    return np.column_stack(weights)


@dataclass
class Classifier:
    """Discriminant scores on SIMPLS components."""

    recipe: Recipe
    classes: list
    weights: np.ndarray
    coefficients: np.ndarray
    intercepts: np.ndarray

    def scores(self, x):
        """One column expression a class: linear in the features."""
        linear = self.weights @ self.coefficients
        return [F.aggregate(F.zip_with(x, F.array(*[F.lit(float(c)) for c in linear[:, k]]), lambda a, b: a * b), F.lit(float(self.intercepts[k])), lambda s, v: s + v) for k in range(len(self.classes))]


def train(df: DataFrame, vector: str, label: str, components: int = 2, max_features: int | None = None) -> Classifier:
    """The recipe, the components and a linear discriminant on them, from training rows with a label. At least 3 rows and 2 classes."""
    rows = df.filter(F.col(label).isNotNull())
    classes = sorted(r[0] for r in rows.select(label).distinct().collect())
    if len(classes) < 2 or rows.count() < 3:
        raise ValueError("training needs at least 3 rows and 2 classes")
    recipe = fit_recipe(rows, vector, max_features)
    held = written(apply_recipe(rows, recipe, vector).select("x", F.col(label).alias("y")), "prepared")
    one = lambda pdf: (pdf["y"].to_numpy()[:, None] == np.asarray(classes)).astype(float)
    both = summed(held, "x", ["y"], lambda m, pdf: np.vstack([m.T @ one(pdf), one(pdf).sum(axis=0)]))
    xs, n = both[:-1], both[-1]
    weights = simpls(held, "x", xs - np.outer(xs.sum(axis=1), n) / n.sum(), components)
    means = weights.T @ (xs / n)
    within = summed(held, "x", [], lambda m, _: (m @ weights).T @ (m @ weights)) - (means * n) @ means.T
    deleted(held)
    inverse = np.linalg.pinv(within / max(n.sum() - len(classes), 1))
    coefficients = inverse @ means
    return Classifier(recipe, classes, weights, coefficients, -0.5 * np.einsum("ik,ik->k", means, coefficients) + np.log(n / n.sum()))


def predict(model: Classifier, df: DataFrame, vector: str) -> DataFrame:
    """Label and probability of each row, as column arithmetic."""
    prepared = apply_recipe(df, model.recipe, vector, "__x")
    for k, s in enumerate(model.scores(F.col("__x"))):
        prepared = prepared.withColumn(f"__s{k}", s)
    names = [F.col(f"__s{k}") for k in range(len(model.classes))]
    top = F.greatest(*names)
    best = F.coalesce(*[F.when(s == top, F.lit(c)) for s, c in zip(names, model.classes, strict=True)])
    share = 1 / sum((F.exp(s - top) for s in names), F.lit(0.0))
    return prepared.withColumn("predicted", best).withColumn("probability", share).drop("__x", *[f"__s{k}" for k in range(len(names))])


def estimate_transform(landmarks: DataFrame) -> list[list[float]]:
    """D3: the least-squares affine from landmarks(x, y, u, v), from sums of products. At least three, not on a line."""
    a, b = [F.col("x"), F.col("y"), F.lit(1.0)], [F.col("u"), F.col("v")]
    sums = landmarks.agg(*[F.sum(p * q).alias(f"a{i}{j}") for i, p in enumerate(a) for j, q in enumerate(a)], *[F.sum(p * q).alias(f"b{i}{j}") for i, p in enumerate(a) for j, q in enumerate(b)]).first()
    left = np.array([[sums[f"a{i}{j}"] or 0.0 for j in range(3)] for i in range(3)])
    if left[2, 2] < 3 or abs(np.linalg.det(left)) < 1e-9:
        raise ValueError("at least three landmarks that lie on no line")
    out = np.linalg.solve(left, np.array([[sums[f"b{i}{j}"] for j in range(2)] for i in range(3)])).T
    return [[float(v) for v in out[0]], [float(v) for v in out[1]], [0.0, 0.0, 1.0]]


def aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of both tables with the feature columns that both have."""
    shared = [c for c in a.columns if c in b.columns]
    if len(shared) < 2:
        raise ValueError("no common feature")
    return a.select(key, *[c for c in shared if c != key]).unionByName(b.select(key, *[c for c in shared if c != key]))


def stacked(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both tables, missing columns null."""
    return a.unionByName(b, allowMissingColumns=True)


def test_rows(points: DataFrame, train_ids: DataFrame, key: str, slides: list[str] | None = None, members: DataFrame | None = None) -> DataFrame:
    """Rows to predict: all that are not for training, or those of given slides or regions less the training rows."""
    wanted = points
    if slides is not None or members is not None:
        by_slide = points.filter(F.col("slide_id").isin(slides or []))
        wanted = by_slide if members is None else by_slide.unionByName(points.join(members.select(key).distinct(), key, "left_semi")).dropDuplicates([key])
    return wanted.join(train_ids.select(key).distinct(), key, "left_anti")


def write_classifier(spark, model: Classifier, path: str, mode: str = "error") -> None:
    """The model as one JSON line; Spark's commit makes it appear whole or not at all."""
    held = {"at": model.recipe.at, "mean": model.recipe.mean, "scale": model.recipe.scale, "classes": [str(c) for c in model.classes], "kind": type(model.classes[0]).__name__, "weights": model.weights.tolist(), "coefficients": model.coefficients.tolist(), "intercepts": model.intercepts.tolist()}
    spark.range(1).select(F.lit(json.dumps(held)).alias("value")).coalesce(1).write.mode(mode).text(path)


def read_classifier(spark, path: str) -> Classifier:
    """A29."""
    held = json.loads(spark.read.text(path).first()[0])
    classes = [int(c) for c in held["classes"]] if held["kind"] == "int" else held["classes"]
    return Classifier(Recipe(held["at"], held["mean"], held["scale"]), classes, np.array(held["weights"]), np.array(held["coefficients"]), np.array(held["intercepts"]))
