"""Running sums, ranks and exact percentiles over any number of rows, without a task that sorts them all.

Rows are dealt into ranges of the order (Spark's range partitioning, which cuts ties by further columns) and written,
so that a row's range is fixed. Each range is summed, the sums of earlier ranges are added to the running sum within
one. Windows run within a range, or over the ranges' sums: one row a range and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.work import written


def meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left, all rows, with right's columns by the keys, null equal to null."""
    named = right.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & left[k].eqNullSafe(named[f"__r{i}"])
    return left.join(named, same, "left").drop(*[f"__r{i}" for i in range(len(keys))])


def running(rows: DataFrame, order: list[Column], amount: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with `upto`, the sum of `amount` up to and with the row in the order within `by`, and `total`, that of all of `by`. The order must be total."""
    held = written(rows.withColumn("__n", amount).repartitionByRange(*[F.col(b) for b in by], *order).withColumn("__part", F.spark_partition_id()), "ranges")
    keys = [*by, "__part"]
    sums = held.groupBy(*keys).agg(F.sum("__n").alias("__sum"))
    earlier = F.sum("__sum").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__sum")
    sums = sums.withColumn("__before", earlier).withColumn("total", F.sum("__sum").over(Window.partitionBy(*by))).drop("__sum")
    own = F.sum("__n").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return meet(held.withColumn("__own", own), sums, keys).withColumn("upto", F.col("__before") + F.col("__own")).drop("__n", "__part", "__own", "__before")


def distinct_values(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, value, n, upto, total: each different value of a group with its number of rows and that of the values up to it."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return running(counts, [F.col(value)], F.col("n"), by)


def _renamed(df: DataFrame, value: str, by: tuple[str, ...]) -> tuple[DataFrame, tuple[str, ...]]:
    """The rows with a value as __v and the groups as __b0, ..., so that no name clashes with those made here."""
    keys = tuple(f"__b{i}" for i in range(len(by)))
    return df.filter(F.col(value).isNotNull()).select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(value).alias("__v")), keys


def average_ranks(df: DataFrame, value: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with `out`: the rank from 1 within `by`, ties averaged. Rows with a null value go."""
    held, keys = _renamed(df, value, by)
    ranks = distinct_values(held, "__v", keys).withColumn(out, F.col("upto") - (F.col("n") - 1) / 2)
    ranks = ranks.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], F.col("__v").alias(value), out)
    return meet(df.filter(F.col(value).isNotNull()), ranks, [*by, value])


def percentiles(df: DataFrame, value: str, shares: list[float], by: tuple[str, ...] = (), out: str = "q") -> DataFrame:
    """by, `out`: the type-7 percentiles of the values that are not null, one a share, exact. A group without values has no row.

    Of the range that holds a wanted place only the value at that place travels on.
    """
    held, keys = _renamed(df, value, by)
    held = distinct_values(held.withColumn("__v", F.col("__v").cast("double")), "__v", keys)
    at = F.array(*[F.lit(float(s)) for s in shares])
    wanted = F.transform(at, lambda s, k: F.struct(k.alias("k"), (s * (F.col("total") - 1)).alias("h")))
    first = F.col("upto") - F.col("n")
    holds = lambda i: (i >= first) & (i < F.col("upto"))
    low, high = (lambda w: F.floor(w["h"])), (lambda w: F.ceil(w["h"]))
    hits = held.filter(F.exists(wanted, lambda w: holds(low(w)) | holds(high(w)))).withColumn("w", F.explode(wanted))
    part = lambda f, n: F.max(F.when(holds(f(F.col("w"))), F.col("__v"))).alias(n)
    each = hits.groupBy(*keys, F.col("w.k").alias("k")).agg(part(low, "lo"), part(high, "hi"), F.max("w.h").alias("h"))
    between = F.col("lo") + (F.col("h") - F.floor("h")) * (F.col("hi") - F.col("lo"))
    q = F.transform(F.sort_array(F.collect_list(F.struct("k", between.alias("v")))), lambda s: s["v"])
    return each.groupBy(*keys).agg(q.alias("q")).select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], F.col("q").alias(out))
