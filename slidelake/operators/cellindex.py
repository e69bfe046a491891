"""Queries over a cell index: cells, predictions, features."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(predictions: DataFrame, model_id: str) -> DataFrame:
    """Cells by status and label of a model."""
    return predictions.filter(F.col("model_id") == model_id).groupBy("status", "label").agg(F.count("*").alias("n"))


def needs_review(threshold: float) -> Column:
    return F.col("status").isNull() | (F.col("status") != "predicted") | F.col("probability").isNull() | (F.col("probability") < threshold)


def scoped(cells: DataFrame, predictions: DataFrame, model_id: str, label: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Cells with their prediction by a model; a label, or those that need review."""
    met = cells.join(predictions.filter(F.col("model_id") == model_id).drop("model_id"), "row_id", "left")
    if label == "__review__":
        return met.filter(needs_review(threshold))
    return met if label is None else met.filter(F.col("label") == label)


def in_box(box: tuple[float, float, float, float]) -> Column:
    x0, y0, x1, y1 = box
    return (F.col("xmax") >= x0) & (F.col("xmin") <= x1) & (F.col("ymax") >= y0) & (F.col("ymin") <= y1)


def viewport(cells: DataFrame, predictions: DataFrame, model_id: str, box: tuple[float, float, float, float], label: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Cells whose box meets the window. The box filter reaches the scan of cells before the join."""
    return scoped(cells.filter(in_box(box)), predictions, model_id, label, threshold)


def queue(cells: DataFrame, predictions: DataFrame, model_id: str, label: str | None, threshold: float, limit: int) -> DataFrame:
    """The least confident first, cells without a probability before all; a top-k, so no full sort."""
    return scoped(cells, predictions, model_id, label, threshold).withColumn("score", F.coalesce("probability", F.lit(-1.0))).orderBy("score", "row_id").limit(limit)


def cells_by_id(cells: DataFrame, ids: DataFrame) -> DataFrame:
    """The named cells; a name without a cell is an error."""
    met = ids.select(F.col("cell_id").alias("asked")).distinct().join(cells, F.col("asked") == F.col("cell_id"), "left")
    missing = F.raise_error(F.concat(F.lit("no cell "), "asked")).cast("boolean")
    return met.filter(F.when(F.col("cell_id").isNull(), missing).otherwise(F.lit(True))).drop("asked")


def scope_digest(**scope) -> str:
    return hashlib.sha256(json.dumps(scope, sort_keys=True).encode()).hexdigest()


def page(ordered: DataFrame, scope: str, size: int, cursor: dict | None = None) -> tuple[DataFrame, dict | None]:
    """The next `size` rows by (score, row_id) after the cursor, and the cursor after them, None at the end. A cursor of another scope is an error."""
    if cursor and cursor["scope"] != scope:
        raise ValueError("the cursor belongs to another query")
    rows = ordered
    if cursor:
        rows = rows.filter((F.col("score") > cursor["score"]) | ((F.col("score") == cursor["score"]) & (F.col("row_id") > cursor["row_id"])))
    rows = rows.orderBy("score", "row_id")
    edge = rows.select("score", "row_id").limit(size + 1).collect()
    after = {"scope": scope, "score": edge[size - 1]["score"], "row_id": edge[size - 1]["row_id"]} if len(edge) > size else None
    return rows.limit(size), after


def density(cells: DataFrame, box: tuple[float, float, float, float], bins: int = 32) -> DataFrame:
    """Exact counts of cells in a bins x bins grid over the window."""
    x0, y0, x1, y1 = box
    at = lambda v, lo, hi: F.least(F.lit(bins - 1), F.greatest(F.lit(0), ((F.col(v) - lo) / ((hi - lo) / bins)).cast("int")))
    return cells.filter(in_box(box)).groupBy(at("x", x0, x1).alias("bx"), at("y", y0, y1).alias("by")).agg(F.count("*").alias("n"))


def mismatches(cells: DataFrame, other: DataFrame) -> DataFrame:
    """Row ids that only one of the two tables has; null equals nothing.

    Ids of both meet in one shuffle, about a million a part, so that no task's share grows with the tables.
    """
    a, b = (t.select("row_id", F.lit(n).alias("side")) for t, n in ((cells, 1), (other, 2)))
    both = a.unionByName(b)
    parts = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-both.count() // 1_000_000))
    met = both.repartition(parts, "row_id").groupBy("row_id").agg(F.bit_or("side").alias("sides"))
    alone = F.when(F.col("row_id").isNotNull() & (F.col("sides") == 3), F.array().cast("array<string>"))
    missing = alone.when(F.col("sides") == 1, F.array(F.lit("other"))).when(F.col("sides") == 2, F.array(F.lit("cells"))).otherwise(F.array(F.lit("other"), F.lit("cells")))
    return met.select("row_id", F.explode(missing).alias("missing"))


def display_points(cells: DataFrame) -> DataFrame:
    """Cells whose JSON agrees with its columns, with the probability vector checked: values from 0 to 1 that sum to 1."""
    raw = F.col("raw_json")
    number = lambda k: F.get_json_object(raw, f"$.{k}").try_cast("double")
    p = F.from_json(F.get_json_object(raw, "$.probabilities"), "array<double>")
    total = F.aggregate(p, F.lit(0.0), lambda s, v: s + v)
    fine = p.isNull() | (F.forall(p, lambda v: (v >= 0) & (v <= 1)) & (F.abs(total - 1) < 1e-6))
    return cells.filter((number("x") == F.col("x")) & (number("y") == F.col("y")) & fine).select("row_id", "cell_id", "x", "y", F.array_max(p).alias("top"))


def features_of(cells: DataFrame, features: DataFrame) -> DataFrame:
    """Cells with their feature vectors."""
    return cells.select("row_id", "cell_id").join(features.select("row_id", F.from_json("values_json", "array<double>").alias("features")), "row_id")
