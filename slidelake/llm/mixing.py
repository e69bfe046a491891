"""Mixing sources to target weights by fitting a word budget for each source.

Documents are counted by exact length (words). A source whose target is k whole turns plus a rest takes every
document k times; for the rest, most of the budget is shared among lengths in proportion, and a bounded
knapsack over what remains of the counts settles the last words. Which documents of a length are taken is
decided by a seeded hash, so reruns agree.

Defined results: a null text has no words; documents without words take none. Sources are ordered by code
point, null last (null is a source of its own). An empty table gives an empty result. Rows that repeat an id, or id
and text, are rows of their own, each taken as often as it is due: which of equal rows is taken makes no difference.
Columns beside id, text and source are never read, and may have any names that do not begin with two underscores.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import word_count, written

#: Words of the budget that the knapsack settles, beside what sharing in proportion leaves.
RESERVE = 1 << 15
#: Bits of the hash that deal a length's documents into parts, at least.
LEAST_BITS = 8


def targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """source, source_size, target from source, source_size: one row a source.

    Targets are min(most * size, level * weight) with the level at which they sum to the budget: what sources
    above their limit leave is shared by weight among the others until none is above.
    """
    everyone = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    cap = F.col("source_size") * F.lit(float(most))
    rows = totals.withColumn("w", w).withColumn("ratio", cap / F.col("w"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everyone) * F.lit(float(share)) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", level)
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everyone)
    return rows.select("source", "source_size", F.least(cap, F.coalesce(level, F.lit(float("inf"))) * F.col("w")).alias("target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, reserve: int = RESERVE) -> np.ndarray:
    """How many documents of each length (ascending, over 0) to take so that their words come nearest to the budget.

    Sharing in proportion runs from the longest down and carries what does not fill a whole document. The rest
    is an exact bounded knapsack over the documents not yet taken: a length with c left becomes items of
    1, 2, 4, ... documents, and `by` keeps the item with which each sum was first reached.
    """
    taken = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        return counts.astype(np.int64)
    spread, carry = max(0, budget - reserve), 0.0
    for i in range(len(lengths) - 1, -1, -1):
        want = float(counts[i]) * float(lengths[i]) * spread / total + carry
        taken[i] = min(int(counts[i]), int(want // lengths[i]))
        carry = want - float(taken[i]) * float(lengths[i])
    rest = budget - int((taken * lengths).sum())
    for i in range(len(lengths) - 1, -1, -1):
        more = min(int(counts[i] - taken[i]), max(0, (rest - reserve) // int(lengths[i])))
        taken[i] += more
        rest -= more * int(lengths[i])
    left = counts - taken
    if not left.any():
        return taken
    top = min(rest + int(lengths[left > 0].max()), 2 * rest)  # taking nothing more is no farther than that
    by = np.full(top + 1, -1, dtype=np.int32)
    by[0] = 0
    items: list[tuple[int, int]] = [(0, 0)]
    for i in np.flatnonzero(left):
        c, k = min(int(left[i]), top // int(lengths[i])), 1
        while c > 0 and by[rest] < 0:
            k = min(k, c)
            words = k * int(lengths[i])
            reach = np.flatnonzero((by[: top + 1 - words] >= 0) & (by[words:] < 0)) + words
            items.append((i, k))
            by[reach] = len(items) - 1
            c, k = c - k, 2 * k
        if by[rest] >= 0:
            break
    sums = np.flatnonzero(by >= 0)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    while at:
        i, k = items[by[at]]
        taken[i] += k
        at -= k * int(lengths[i])
    return taken


def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one source: turns that every document takes, and documents of each length that take one more."""
    pdf = pdf.sort_values("__size")
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    turns = int(target // size) if size else 0
    words = pdf["__size"].to_numpy() > 0
    pdf["turns"], pdf["extra"] = turns, 0
    extra = fit_budget(pdf["__size"].to_numpy()[words], pdf["n"].to_numpy()[words], round(target - turns * size))
    pdf.loc[words, "extra"] = extra
    return pdf[["__no_source", "__src", "__size", "source_size", "target", "turns", "extra"]]


def ranked(docs: DataFrame, keep: list, weights: tuple[int, ...], share: float, most: float, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The columns `keep` of every row with size, source_size, target, repeats.

    Sources, lengths and places are written once; the plan comes from their counts. A length's rows fall into parts by
    the first bits of their hash, about as many parts as a part has rows; parts below the quota are taken whole, the
    one at the quota by rank. So neither a task nor a sum has more than the square root of a length's rows.
    """
    source = F.col(source_col).cast("string")
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    own = [source.isNull().alias("__no_source"), F.coalesce(source, F.lit("")).alias("__src"), word_count(F.col(text_col)).alias("__size"), order.alias("__place")]
    key = ["__no_source", "__src", "__size"]
    rows = written(docs.select(*own), "mix-rows")
    lengths = written(rows.groupBy(*key).agg(F.count("*").alias("n")), "mix-lengths")
    longest = lengths.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    bits = min(48, max(LEAST_BITS, math.ceil(math.log2(longest) / 2)))
    part = F.shiftrightunsigned("__place", 64 - bits)
    parts = rows.groupBy(*key, part.alias("__part")).agg(F.count("*").alias("n"))
    totals = lengths.groupBy("__no_source", "__src").agg(F.sum(F.col("n") * F.col("__size")).alias("source_size"))
    goals = targets(totals.select(F.when(~F.col("__no_source"), F.col("__src")).alias("source"), "source_size"), weights, share, most)
    goals = goals.select(F.col("source").isNull().alias("__no_source"), F.coalesce("source", F.lit("")).alias("__src"), "source_size", "target")
    plan = lengths.join(goals, ["__no_source", "__src"]).groupBy("__no_source", "__src").applyInPandas(
        quotas, "__no_source boolean, __src string, __size long, source_size long, target double, turns long, extra long"
    )
    plan = written(plan, "mix-plan")
    up_to = F.sum("n").over(Window.partitionBy(*key).orderBy("__part")) - F.col("n")
    share_of_part = parts.withColumn("before", up_to).join(plan, key).select(
        *key, "__part", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("turns").alias("__turns"), F.least(F.col("n"), F.greatest(F.lit(0), F.col("extra") - F.col("before"))).alias("__quota")
    )
    rank = F.row_number().over(Window.partitionBy(*key, "__part").orderBy("__place"))
    repeats = F.when(F.col("__size") > 0, F.col("__turns") + (F.col("__rank") <= F.col("__quota")).cast("long")).otherwise(F.lit(0).cast("long"))
    met = docs.select(F.struct(*keep).alias("__row"), *own).withColumn("__part", part).withColumn("__rank", rank).join(share_of_part, [*key, "__part"])
    return met.select("__row", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), repeats.alias("repeats"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """For every row: id, size, source_size, target, taken (words the mix takes, repeats counted), repeats."""
    rows = ranked(docs, [F.col(id_col)], weights, share, most, seed, id_col, text_col, source_col)
    return rows.select("__row.*", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it, with all its columns, which travel with it: a row that repeats an id is taken as often as it is due itself."""
    rows = ranked(docs, [F.col(c) for c in docs.columns], weights, share, most, seed, id_col, text_col, source_col).filter("repeats > 0")
    return rows.select("__row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("__turn")).select("__row.*")
