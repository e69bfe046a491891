"""Nearest neighbours, proximity between regions, and what it says about features."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.work import written
from . import nearby, ranges
from .regions import associate


def finite(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return out


def _spots(points: DataFrame, key: str) -> DataFrame:
    """x, y, t (the smallest key), n of each place with points; points without finite coordinates have none."""
    at = points.select(F.col(key).alias("t"), *[F.col(c).cast("double").alias(c) for c in "xy"]).filter(finite("x", "y"))
    return written(at.groupBy("x", "y").agg(F.min("t").alias("t"), F.count("*").alias("n")), "spots")


def _boxed(spots: DataFrame, name: str) -> DataFrame:
    return spots.select(F.col("t").alias(name), *[F.col(v).alias(f"{v}{i}") for i in (0, 1) for v in "xy"])


def nearest(query: DataFrame, target: DataFrame, qkey: str, tkey: str) -> DataFrame:
    """Each query point's nearest target by Euclidean distance, the smallest target key on ties; null without a target or finite coordinates.

    Points at one place are one point of the search (nearby.candidates), so copies cost nothing.
    """
    asked, spots = _spots(query, qkey), _spots(target, tkey)
    found = nearby.nearest_point(_boxed(asked, "q"), _boxed(spots, "t"))
    rows = query.select(F.col(qkey), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    if found is None:
        return rows.select(qkey, F.lit(None).cast(spots.schema["t"].dataType).alias("nearest_id"), F.lit(None).cast("double").alias("distance_px"))
    places = asked.join(found, asked["t"] == found["q"]).select("x", "y", found["t"].alias("nearest_id"), F.col("d").alias("distance_px"))
    return rows.join(places, ["x", "y"], "left").select(qkey, "nearest_id", "distance_px")


def nearest_cells(points: DataFrame, key: str, pixel_size: float | None = None) -> DataFrame:
    """Each point's nearest other point, the smallest key on ties. Keys are unique.

    Of points at one place all but the first have that one as their nearest, and it has the second; only points that
    are alone are searched for.
    """
    spots = _spots(points, key)
    rows = points.select(F.col(key), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    shared = spots.filter("n > 1").select("x", "y", F.col("t").alias("first"))
    second = rows.join(shared, ["x", "y"]).filter(F.col(key) != F.col("first")).groupBy("x", "y").agg(F.min(key).alias("second"))
    found = nearby.nearest_point(_boxed(spots.filter("n = 1"), "q"), _boxed(spots, "t"), not_self=True)
    if found is None:
        found = spots.filter("false").select(F.col("t").alias("q"), "t", F.lit(0.0).alias("d"))
    far = found.select(F.col("q").alias("first"), F.col("t").alias("other"), "d")
    places = spots.select("x", "y", F.col("t").alias("first"), "n").join(second, ["x", "y"], "left").join(far, "first", "left")
    met = rows.join(places, ["x", "y"], "left")
    other = F.when(F.col("n") == 1, F.col("other")).when(F.col(key) == F.col("first"), F.col("second")).otherwise(F.col("first"))
    d = F.when(F.col("n") == 1, F.col("d")).when(F.col("n") > 1, F.lit(0.0))
    return met.select(key, other.alias("nearest_id"), d.alias("distance_px"), (d * F.lit(pixel_size).cast("double")).alias("distance_um"))


def proximity(points: DataFrame, rois: DataFrame, query_rois: list[str], target_rois: list[str], key: str, mpp: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Finite points of the query regions with their nearest point of the target regions; µm by the mean pixel size."""
    fine = points.filter(finite("x", "y"))
    of = lambda ids: associate(fine, rois.filter(F.col("roi_id").isin(ids))).filter("roi_id IS NOT NULL")
    query, target = written(of(query_rois), "query"), written(of(target_rois), "target")
    near = nearest(query, target, key, key)
    named = target.select(F.col(key).alias("nearest_id"), F.col("roi_id").alias("target_roi"))
    out = query.select(key, F.col("roi_id").alias("query_roi"), "x", "y").join(near, key).join(named, "nearest_id", "left")
    return out.withColumn("distance_um", F.col("distance_px") * F.lit((mpp[0] + mpp[1]) / 2))


def quantile_position(df: DataFrame, value: str) -> DataFrame:
    """(average rank - 1) / (n - 1), one half where all values are equal, and the index of one of 101 colours. A row without a value has neither."""
    counts = ranges.distinct_values(df.filter(F.col(value).isNotNull()).select(F.col(value).alias("__v")), "__v")
    rank = F.col("upto") - (F.col("n") - 1) / 2
    at = F.when(F.col("n") == F.col("total"), F.lit(0.5)).otherwise(F.try_divide(rank - 1, F.col("total") - 1))
    met = df.join(counts.select(F.col("__v").alias(value), at.alias("position")), value, "left")
    return met.withColumn("colour_index", F.greatest(F.lit(1), F.least(F.lit(101), (F.floor(F.col("position") * 100) + 1).cast("int"))))


def binned(df: DataFrame, value: str, features: list[str], step: float = 0.005) -> DataFrame:
    """The means of features in bins of the value: type-7 quantiles as breaks, equal ones once, bins (a, b] with the lowest included.

    Rows with a null in any column are left out. Where fewer than two breaks differ there is no bin.
    """
    whole = df.dropna(subset=[value, *features])
    shares = [round(k * step, 10) for k in range(round(1 / step) + 1)]
    breaks = ranges.percentiles(whole, value, shares).select(F.array_distinct("q").alias("breaks"))
    met = whole.crossJoin(F.broadcast(breaks))  # one row
    below = F.size(F.filter("breaks", lambda b: b < F.col(value)))
    bin_ = F.greatest(below, F.lit(1))
    edge = lambda i: F.element_at("breaks", i)
    met = met.filter(F.size("breaks") > 1).withColumn("bin", bin_.cast("int")).withColumn("mid", (edge(bin_) + edge(bin_ + 1)) / 2)
    return met.groupBy("bin", "mid").agg(F.count("*").alias("n"), *[F.avg(f).alias(f) for f in features])


def long_features(df: DataFrame, key: str, vector: str, names: list[str] | None = None) -> DataFrame:
    """key, feature, value from an array column."""
    long = df.select(key, F.posexplode(vector).alias("i", "value"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1) if names else F.concat(F.lit("f"), F.col("i"))
    return long.select(key, name.alias("feature"), F.col("value").cast("double").alias("value"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return h


def t_probability(r: float | None, n: int | None) -> float | None:
    """Two-sided p of a correlation by Student's t with n - 2 degrees of freedom."""
    if r is None or n is None or n < 3 or math.isnan(r):
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    x = df / (df + r * r * df / (1 - r * r))
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    return min(1.0, front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b)


def t_probabilities(r: Column, n: Column) -> Column:
    def p(rs: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([t_probability(None if pd.isna(a) else a, None if pd.isna(b) else int(b)) for a, b in zip(rs, ns, strict=True)], dtype="float64")

    return F.pandas_udf(p, "double")(r, n)


def correlations(long: DataFrame, distances: DataFrame, key: str, distance: str, method: str = "pearson") -> DataFrame:
    """Each feature's correlation with the distance and its p, ordered by strength. Features with fewer than two values or no variance are left out.

    p values come from a vectorised call over the features, after the aggregation.
    """
    met = long.join(distances.select(key, F.col(distance).alias("d")), key).filter(F.col("value").isNotNull() & ~F.isnan("value") & F.col("d").isNotNull() & ~F.isnan("d"))
    if method == "spearman":
        met = written(met.select("feature", "value", "d"), "ranked")
        for c in ("value", "d"):
            met = ranges.average_ranks(met, c, f"{c}_rank", ("feature",))
        met = met.select("feature", F.col("value_rank").alias("value"), F.col("d_rank").alias("d"))
    stats = met.groupBy("feature").agg(F.count("*").alias("n"), F.try_divide(F.covar_samp("value", "d"), F.stddev_samp("value") * F.stddev_samp("d")).alias("r"), F.var_samp("value").alias("v"))
    return stats.filter("n >= 2 AND v > 0").select("feature", "n", "r", t_probabilities(F.col("r"), F.col("n")).alias("p")).orderBy(F.abs("r").desc_nulls_last(), F.col("p").asc_nulls_last(), "feature")


def adjusted(table: DataFrame, p: str = "p") -> DataFrame:
    """Benjamini-Hochberg adjusted p and the rank: min over larger p of p n / rank. One row a feature."""
    known = table.filter(F.col(p).isNotNull())
    order = Window.orderBy(p, "feature")
    raw = F.col(p) * F.count("*").over(Window.partitionBy()) / F.row_number().over(order)
    up = Window.orderBy(F.col(p).desc(), F.col("feature").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return known.withColumn("raw", raw).withColumn("p_adjusted", F.least(F.lit(1.0), F.min("raw").over(up))).withColumn("rank", F.row_number().over(order)).drop("raw")


def trajectory(long: DataFrame, profile: DataFrame, key: str, method: str = "pearson") -> DataFrame:
    """Correlations with distance_fraction; blank ids and fractions that are not finite go, and the first row of an id wins."""
    fine = profile.filter((F.trim(F.col(key).cast("string")) != "") & F.col("distance_fraction").isNotNull() & ~F.isnan("distance_fraction"))
    first = fine.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("row"))).filter("rn = 1")
    return adjusted(correlations(long, first, key, "distance_fraction", method))


def top_variance(long: DataFrame, k: int) -> DataFrame:
    """The k features of largest variance among those with at least two values and any variance."""
    stats = long.filter(~F.isnan("value")).groupBy("feature").agg(F.count("value").alias("n"), F.var_samp("value").alias("variance"))
    return stats.filter("n >= 2 AND variance > 0").orderBy(F.col("variance").desc(), "feature").limit(k)


def spot_spacing(points: DataFrame, key: str, centre_um: float = 100.0) -> DataFrame:
    """The median distance to the nearest spot and the pixel size it implies; null where the quartiles lie more than a quarter of the median apart."""
    d = nearest_cells(points, key).filter("distance_px > 0")
    q = ranges.percentiles(d, "distance_px", [0.25, 0.5, 0.75])
    steady = (F.col("q")[2] - F.col("q")[0]) / F.col("q")[1] <= 0.25
    return q.select(F.col("q")[1].alias("spacing_px"), F.when(steady, F.lit(centre_um) / F.col("q")[1]).alias("mpp"))
