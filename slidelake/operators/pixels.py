"""Stain channels and per-tile image measures over pixels (F3, F4, H): pixels(tile_id, row, col, r, g, b) with values from 0 to 1."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ranges, regions

# fixed values: optical-density vectors of common stains
HEMATOXYLIN_IHC, DAB = (0.650, 0.704, 0.286), (0.268, 0.570, 0.776)
HEMATOXYLIN, EOSIN = (0.644, 0.717, 0.267), (0.093, 0.954, 0.283)
EPSILON = 1 / 255
# fixed values: colours of stain channels
STAIN_COLOURS = ("#4b3f99", "#8b5a2b", "#d73027", "#008fd5", "#2ca25f", "#c51b8a", "#fdae61", "#7b3294")
HE_COLOURS = {"Hematoxylin": "#4b3f99", "Eosin": "#e85b90", "Residual": "#6b7280"}


def basis(*stains: tuple[float, float, float]) -> np.ndarray:
    """The stains as unit columns, completed to three by cross products; an error where they are not independent."""
    columns = [np.asarray(s, dtype=float) / np.linalg.norm(s) for s in stains]
    if len(columns) == 1:
        axis = np.eye(3)[int(np.argmin(np.abs(columns[0])))]
        columns.append(np.cross(columns[0], axis) / np.linalg.norm(np.cross(columns[0], axis)))
    if len(columns) == 2:
        third = np.cross(columns[0], columns[1])
        if np.linalg.norm(third) < 1e-8:
            raise ValueError("the stains are not independent")
        columns.append(third / np.linalg.norm(third))
    m = np.column_stack(columns)
    if abs(np.linalg.det(m)) < 1e-8:
        raise ValueError("the stains are not independent")
    return m


def density(channel: str) -> Column:
    """Optical density, the value held at EPSILON or above."""
    return -F.log(F.greatest(F.col(channel), F.lit(EPSILON)))


def deconvolved(pixels: DataFrame, m: np.ndarray, names: tuple[str, ...], keep: tuple[str, ...] | None = None) -> DataFrame:
    """Concentrations of up to three stains, at least 0: the optical densities times the inverse basis."""
    inverse = np.linalg.inv(m)
    od = [density(c) for c in ("r", "g", "b")]
    made = {n: F.greatest(F.lit(0.0), sum((od[j] * float(inverse[i, j]) for j in range(3)), F.lit(0.0))) for i, n in enumerate(names)}
    return pixels.select(*(keep or pixels.columns), *[v.alias(k) for k, v in made.items()])


def deconvolved_he(pixels: DataFrame, m: np.ndarray | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Two stains by least squares, and the length of what they leave."""
    m = (basis(HEMATOXYLIN, EOSIN) if m is None else m)[:, :2]
    pseudo = np.linalg.pinv(m)
    od = [density(c) for c in ("r", "g", "b")]
    raw = [sum((od[j] * float(pseudo[i, j]) for j in range(3)), F.lit(0.0)) for i in range(2)]
    held = [F.greatest(F.lit(0.0), x) for x in raw]
    rest = [od[j] - held[0] * float(m[j, 0]) - held[1] * float(m[j, 1]) for j in range(3)]
    return pixels.select(*(keep or pixels.columns), held[0].alias("hematoxylin"), held[1].alias("eosin"), F.sqrt(sum((x * x for x in rest), F.lit(0.0))).alias("residual"))


def reconstructed(channels: DataFrame, m: np.ndarray, names: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """Colours from concentrations, held within 0 and 1."""
    rgb = [F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(-sum((F.col(n) * float(m[j, i]) for i, n in enumerate(names)), F.lit(0.0))))) for j in range(3)]
    return channels.select(*keep, *[v.alias(c) for v, c in zip(rgb, ("r", "g", "b"), strict=True)])


def normalised(pixels: DataFrame, source: np.ndarray, target: np.ndarray, target_high: tuple[float, float], percentile: float = 99, keep: tuple[str, ...] = ("tile_id", "row", "col")) -> DataFrame:
    """Concentrations scaled to the target's percentile and put on the target's basis. One value a stain travels to all tasks."""
    names = ("c1", "c2")
    found = deconvolved(pixels, source, names, keep)
    met = found
    for n in names:
        high = ranges.percentiles(found, n, [percentile / 100]).select(F.get("q", F.lit(0)).alias(f"{n}_high"))
        met = met.crossJoin(F.broadcast(high))  # one row
    ratio = lambda n, t: F.lit(float(t)) / F.when(F.coalesce(F.col(f"{n}_high"), F.lit(0.0)) > 0, F.col(f"{n}_high")).otherwise(F.lit(1.0))
    for n, t in zip(names, target_high, strict=True):
        met = met.withColumn(n, F.col(n) * ratio(n, t))
    return reconstructed(met, target, names, keep)


def factorised(densities: DataFrame, start: np.ndarray, sparsity: float = 0.05, passes: int = 80, settle: int = 20, tolerance: float = 1e-6) -> tuple[np.ndarray, list[float]]:
    """Two non-negative stain vectors (rows, of length 1) such that densities (or, og, ob) are about sparse non-negative amounts of them, and the cost after each pass.

    The cost is half the squared error plus `sparsity` times the amounts. A pass goes over all pixels: with the vectors
    given, each pixel's best two amounts follow from its own three densities (a convex problem of two unknowns, solved
    as an expression), so no amounts are kept between passes; what leaves the tasks is sums of amounts by amounts and
    amounts by densities, 2 x 2 and 2 x 3, and the cost. The vectors then take multiplicative steps on these sums until
    they are at rest. Ends early where a pass gains less than `tolerance` of the cost.
    """
    h, costs = np.maximum(start, 1e-6), []
    before = h = h / np.linalg.norm(h, axis=1, keepdims=True)
    held = densities.select("or", "og", "ob")
    for _ in range(passes):
        lit = lambda v: F.lit(float(v))
        dot = h @ h.T
        p, q = (sum((F.col(f"o{c}") * lit(h[k, i]) for i, c in enumerate("rgb")), F.lit(0.0)) - lit(sparsity) for k in (0, 1))
        det = dot[0, 0] * dot[1, 1] - dot[0, 1] ** 2
        alone = [F.greatest(p, F.lit(0.0)) / lit(dot[0, 0]), F.greatest(q, F.lit(0.0)) / lit(dot[1, 1])]
        if det > 1e-12:
            u, v = (p * lit(dot[1, 1]) - q * lit(dot[0, 1])) / lit(det), (q * lit(dot[0, 0]) - p * lit(dot[0, 1])) / lit(det)
            # where both cannot be positive the better of the two alone
            gain = [alone[0] * p, alone[1] * q]
            both = (u > 0) & (v > 0)
            w0 = F.when(both, u).when(gain[0] >= gain[1], alone[0]).otherwise(0.0)
            w1 = F.when(both, v).when(gain[0] >= gain[1], 0.0).otherwise(alone[1])
        else:
            w0, w1 = alone[0], F.lit(0.0)
        made = held.withColumn("w0", w0).withColumn("w1", w1)
        rest = sum(((F.col(f"o{c}") - F.col("w0") * lit(h[0, i]) - F.col("w1") * lit(h[1, i])) ** 2 for i, c in enumerate("rgb")), F.lit(0.0))
        sums = {f"w{i}w{j}": F.sum(F.col(f"w{i}") * F.col(f"w{j}")) for i, j in ((0, 0), (0, 1), (1, 1))}
        sums |= {f"w{i}{c}": F.sum(F.col(f"w{i}") * F.col(f"o{c}")) for i in (0, 1) for c in "rgb"}
        r = made.agg(*[c.alias(n) for n, c in sums.items()], (F.sum(rest) / 2 + lit(sparsity) * F.sum(F.col("w0") + F.col("w1"))).alias("cost")).first()
        if r["cost"] is None:
            break
        if costs and r["cost"] > costs[-1]:
            return before, costs
        costs.append(r["cost"])
        if len(costs) > 1 and costs[-2] - costs[-1] <= tolerance * costs[-2]:
            break
        before = h
        ww = np.array([[r["w0w0"], r["w0w1"]], [r["w0w1"], r["w1w1"]]])
        wo = np.array([[r[f"w{i}{c}"] for c in "rgb"] for i in (0, 1)])
        for _ in range(settle):
            h = h * wo / np.maximum(ww @ h, 1e-12)
        h = np.maximum(h, 1e-12) / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
    return h, costs


def estimated_basis(pixels: DataFrame, method: str = "macenko", od_threshold: float = 0.15, percentile: float = 1.0, sparsity: float = 0.05, passes: int = 80) -> np.ndarray:
    """The stain basis of tissue pixels. Only sums of products of densities and two angle percentiles come to the driver.

    macenko: the plane of the two greatest eigenvectors, and the extreme angles in it. vahadane: sparse non-negative
    factors of all tissue pixels, from those of macenko (factorised). fixed: the standard basis.
    """
    if method == "fixed":
        return basis(HEMATOXYLIN, EOSIN)
    if method == "vahadane":
        start = estimated_basis(pixels, "macenko", od_threshold, percentile)[:, :2].T
        od = pixels.select(*[density(c).alias(f"o{c}") for c in "rgb"]).filter(F.greatest("or", "og", "ob") > od_threshold)
        # read once and kept by Spark: each pass goes over the same densities
        h, costs = factorised(od.persist(), start, sparsity, passes)
        od.unpersist()
        if not costs:
            return basis(HEMATOXYLIN, EOSIN)
        # hematoxylin takes more of the red light
        h = h if h[0, 0] >= h[1, 0] else h[::-1]
        return basis(tuple(h[0]), tuple(h[1]))
    if method != "macenko":
        raise ValueError(f"unknown method {method}")
    od = pixels.select(*[density(c).alias(f"o{c}") for c in "rgb"]).filter(F.greatest("or", "og", "ob") > od_threshold)
    pairs = [(a, b) for a in "rgb" for b in "rgb" if a <= b]
    sums = od.agg(*[F.sum(F.col(f"o{a}") * F.col(f"o{b}")).alias(a + b) for a, b in pairs]).first()
    if sums["rr"] is None:
        return basis(HEMATOXYLIN, EOSIN)
    gram = np.array([[sums["".join(sorted(a + b))] for b in "rgb"] for a in "rgb"])
    _, vectors = np.linalg.eigh(gram)
    plane = vectors[:, [2, 1]]
    plane = plane * np.where(plane.sum(axis=0) < 0, -1.0, 1.0)
    x, y = (sum((F.col(f"o{c}") * float(plane[i, k]) for i, c in enumerate("rgb")), F.lit(0.0)) for k in range(2))
    low, high = ranges.percentiles(od.select(F.atan2(y, x).alias("angle")), "angle", [percentile / 100, 1 - percentile / 100]).first()[0]
    ends = [plane @ np.array([np.cos(t), np.sin(t)]) for t in (low, high)]
    ends = [np.abs(e) / np.linalg.norm(e) for e in ends]
    first, second = sorted(ends, key=lambda e: -e[0])
    return basis(tuple(first), tuple(second))


def stain_intensity(long: DataFrame, by: list[str], threshold: float | None = None) -> DataFrame:
    """Finite values of each group: count, mean, median, sd (0 for one value), extremes, p10, p90 (type 7), share at or above the threshold."""
    fine = long.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    positive = F.avg((F.col("value") >= F.lit(threshold).cast("double")).cast("double"))
    table = fine.groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"), positive.alias("positive_fraction"))
    table = ranges.meet(table, ranges.percentiles(fine, "value", [0.1, 0.5, 0.9], tuple(by)), by)
    return table.select(*by, "n", "mean", F.col("q")[1].alias("median"), "sd", "min", "max", F.col("q")[0].alias("p10"), F.col("q")[2].alias("p90"), "positive_fraction")


def ihc_intensity(pixels: DataFrame, dab_threshold: float = 0.1, pixel_size: float | None = None) -> DataFrame:
    """By region of pixels(roi_id, class, hematoxylin, dab): means, medians, positive pixels and area, DAB over hematoxylin."""
    table = pixels.groupBy("roi_id", "class").agg(
        F.count("*").alias("n"), F.avg("dab").alias("dab_mean"), F.avg("hematoxylin").alias("hematoxylin_mean"), F.sum((F.col("dab") >= dab_threshold).cast("long")).alias("positive"),
    )
    for c in ("dab", "hematoxylin"):
        middle = ranges.percentiles(pixels, c, [0.5], ("roi_id", "class")).select("roi_id", "class", F.get("q", F.lit(0)).alias(f"{c}_median"))
        table = ranges.meet(table, middle, ["roi_id", "class"])
    return _ihc_shares(table, pixel_size)


def ihc_in_regions(pixels: DataFrame, rois: DataFrame, dab_threshold: float = 0.1, pixel_size: float | None = None) -> DataFrame:
    """ihc_intensity of pixels(x, y, hematoxylin, dab) in regions, all that hold a pixel, without a row a pixel and region: pixels are summed by place first."""
    at, by = [F.col(c).cast("double").alias(c) for c in "xy"], ["roi_id", "class"]
    held = pixels.select(*at, "hematoxylin", "dab")
    places, groups = regions.places_of_groups(held, rois, by)
    sums = held.groupBy("x", "y").agg(F.count("*").alias("n"), F.sum((F.col("dab") >= dab_threshold).cast("long")).alias("positive"), *[f(c).alias(f"{c}_{n}") for c in ("dab", "hematoxylin") for n, f in (("n", F.count), ("sum", F.sum))])
    table = places.join(sums, ["x", "y"]).groupBy("__set").agg(*[F.sum(c).alias(c) for c in sums.columns if c not in ("x", "y")])
    table = table.select("__set", "n", *[F.try_divide(f"{c}_sum", f"{c}_n").alias(f"{c}_mean") for c in ("dab", "hematoxylin")], "positive")
    for c in ("dab", "hematoxylin"):
        table = table.join(regions.set_percentiles(held, places, c, [0.5]).select("__set", F.get("q", F.lit(0)).alias(f"{c}_median")), "__set", "left")
    return _ihc_shares(groups.join(table, "__set").drop("__set"), pixel_size)


def _ihc_shares(table: DataFrame, pixel_size: float | None) -> DataFrame:
    area = F.col("positive") * F.lit(pixel_size**2 if pixel_size else None).cast("double")
    return table.withColumn("positive_fraction", F.col("positive") / F.col("n")).withColumn("positive_um2", area).withColumn("ratio", F.when(F.col("hematoxylin_mean") > 1e-12, F.try_divide("dab_mean", "hematoxylin_mean")))


def ihc_classes(by_roi: DataFrame) -> DataFrame:
    """Class rows; means and medians are means of the regions' values weighted by pixels."""
    w = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    table = by_roi.groupBy("class").agg(F.count("*").alias("n_rois"), F.sum("n").alias("n"), w("dab_mean"), w("dab_median"), w("hematoxylin_mean"), w("hematoxylin_median"), F.sum("positive").alias("positive"))
    return table.withColumn("positive_fraction", F.try_divide("positive", "n")).withColumn("ratio", F.when(F.col("hematoxylin_mean") > 1e-12, F.try_divide("dab_mean", "hematoxylin_mean")))


def brightness() -> Column:
    return (F.col("r") + F.col("g") + F.col("b")) / 3


def saturation() -> Column:
    high, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    return F.when(high > 0, (high - low) / high).otherwise(F.lit(0.0))


def _checked(options, most: float = math.inf):
    """The options, if each is a number from 0 to `most`; else an error that names the first that is not."""
    for name, v in vars(options).items():
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 <= v <= most or math.isinf(v):
            raise ValueError(f"{name} is a number from 0" + (f" to {most:g}" if math.isfinite(most) else ""))


@dataclass(frozen=True)
class WhitespaceOptions:
    """C11: the thresholds of `whitespace`, checked: whitespace(pixels, **vars(WhitespaceOptions(bright=0.9)))."""

    bright: float = 0.86
    pale: float = 0.12
    fraction: float = 0.75
    bright_mean: float = 0.90
    pale_mean: float = 0.10

    def __post_init__(self):
        _checked(self, 1.0)


@dataclass(frozen=True)
class ArtifactOptions:
    """The thresholds of `artifacts`, checked; those of bubbles go to candidates.detect."""

    blur: float = 0.012
    out_of_focus: float = 0.008
    focus_sd: float = 0.025
    dark_mean: float = 0.12
    bright_mean: float = 0.92
    dark: float = 0.18
    bright: float = 0.92
    most: float = 0.80
    pen_saturation: float = 0.45
    pen_dominance: float = 1.25
    pen_fraction: float = 0.01
    fold_dark: float = 0.28
    fold_saturation: float = 0.25
    fold_fraction: float = 0.08

    def __post_init__(self):
        _checked(self)


def whitespace(pixels: DataFrame, bright: float = 0.86, pale: float = 0.12, fraction: float = 0.75, bright_mean: float = 0.90, pale_mean: float = 0.10) -> DataFrame:
    """H3: by tile the share of bright pale pixels, the means, and whether the tile is white space."""
    white = ((brightness() >= bright) & (saturation() <= pale)).cast("double")
    table = pixels.groupBy("tile_id").agg(F.count("*").alias("n"), F.avg(white).alias("whitespace_fraction"), F.avg(brightness()).alias("brightness_mean"), F.avg(saturation()).alias("saturation_mean"))
    return table.withColumn("whitespace", (F.col("whitespace_fraction") >= fraction) | ((F.col("brightness_mean") >= bright_mean) & (F.col("saturation_mean") <= pale_mean)))


def flag_whitespace(tiles: DataFrame, pixels: DataFrame, action: str = "flag", **options) -> DataFrame:
    """Tiles with white-space measures; a tile without pixels counts as white space. `drop` leaves those out."""
    met = tiles.join(whitespace(pixels, **options), "tile_id", "left").withColumn("whitespace", F.coalesce("whitespace", F.lit(True)))
    return met.filter(~F.col("whitespace")) if action == "drop" else met


def grey() -> Column:
    return 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")


def edges(pixels: DataFrame) -> DataFrame:
    """Each pixel with the absolute differences to its right and lower neighbours of the grey value."""
    held = pixels.withColumn("v", grey())
    right = F.lead("v").over(Window.partitionBy("tile_id", "row").orderBy("col"))
    below = F.lead("v").over(Window.partitionBy("tile_id", "col").orderBy("row"))
    return held.withColumn("dx", F.abs(right - F.col("v"))).withColumn("dy", F.abs(below - F.col("v")))


def artifacts(pixels: DataFrame, bubbles: DataFrame | None = None, blur: float = 0.012, out_of_focus: float = 0.008, focus_sd: float = 0.025, dark_mean: float = 0.12, bright_mean: float = 0.92, dark: float = 0.18, bright: float = 0.92, most: float = 0.80, pen_saturation: float = 0.45, pen_dominance: float = 1.25, pen_fraction: float = 0.01, fold_dark: float = 0.28, fold_saturation: float = 0.25, fold_fraction: float = 0.08) -> DataFrame:
    """H5: by tile brightness, the shares of dark, bright, pen-like and fold-like pixels, edge strength, and flags with their mean as score.

    `bubbles` holds the tiles with a bubble candidate (tile_id, candidate); without it none has one.
    """
    ranked = F.sort_array(F.array("r", "g", "b"))
    middle, high = ranked[1], ranked[2]
    v = brightness()
    pen, fold = (high >= pen_dominance * middle) & (saturation() >= pen_saturation), (v <= fold_dark) & (saturation() >= fold_saturation)
    share = lambda c, n: F.avg(c.cast("double")).alias(n)
    table = edges(pixels).groupBy("tile_id").agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.avg(saturation()).alias("saturation_mean"), share(v <= dark, "dark_fraction"),
        share(v >= bright, "bright_fraction"), share(pen, "pen_fraction"), share(fold, "fold_fraction"), F.coalesce(F.try_divide(F.coalesce(F.sum("dx"), F.lit(0.0)) + F.coalesce(F.sum("dy"), F.lit(0.0)), F.count("dx") + F.count("dy")), F.lit(0.0)).alias("edge_strength"),
    )
    if bubbles is None:
        table = table.withColumn("bubble", F.lit(False))
    else:
        held = bubbles.select(F.col("tile_id").alias("b_id"), F.col("candidate").alias("bubble"))
        table = table.join(held, table["tile_id"].cast("string") == held["b_id"].cast("string"), "left").drop("b_id").withColumn("bubble", F.coalesce("bubble", F.lit(False)))
    flags = {
        "too_dark": (F.col("mean") <= dark_mean) | (F.col("dark_fraction") >= most), "too_bright": (F.col("mean") >= bright_mean) | (F.col("bright_fraction") >= most), "blur": F.col("edge_strength") <= blur,
        "out_of_focus": (F.col("edge_strength") <= out_of_focus) & (F.col("sd") <= focus_sd), "pen": F.col("pen_fraction") >= pen_fraction, "fold": F.col("fold_fraction") >= fold_fraction, "bubble": F.col("bubble"),
    }
    for k, flag in flags.items():
        table = table.withColumn(k, flag)
    return table.withColumn("artifact_score", sum((F.col(k).cast("double") for k in flags), F.lit(0.0)) / len(flags)).withColumn("artifact", F.col("artifact_score") > 0)


def focus(pixels: DataFrame, threshold: float = 0.001) -> DataFrame:
    """By tile the variance of the 3x3 Laplacian, the mean Sobel magnitude and Tenengrad, the contrast of the grey values, and whether the tile is blurry. Pixels without all eight neighbours have stencils of 0.

    A tile has one pixel at a place. Stencils are sums of rows' sums: each pixel meets its neighbours in its row, and these
    sums meet those of the rows above and below, so that no pixel is copied and no task holds more than a row or column.
    """
    held = pixels.select("tile_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), grey().alias("v"))
    across, down = Window.partitionBy("tile_id", "row").orderBy("col"), Window.partitionBy("tile_id", "col").orderBy("row")
    sides = F.struct("v", "col")
    held = held.withColumn("l", F.lag(sides).over(across)).withColumn("r", F.lead(sides).over(across))
    full = (F.col("l.col") == F.col("col") - 1) & (F.col("r.col") == F.col("col") + 1)
    sums = F.when(full, F.struct("row", F.col("v").alias("at"), (F.col("r.v") - F.col("l.v")).alias("step"), (F.col("l.v") + 2 * F.col("v") + F.col("r.v")).alias("sum"), (F.col("l.v") + F.col("r.v")).alias("beside")))
    held = held.select("tile_id", "row", "col", "v", sums.alias("own"))
    held = held.withColumn("a", F.lag("own").over(down)).withColumn("b", F.lead("own").over(down))
    inner = F.col("own").isNotNull() & (F.col("a.row") == F.col("row") - 1) & (F.col("b.row") == F.col("row") + 1)
    zero = lambda c: F.when(inner, c).otherwise(F.lit(0.0))
    gx, gy = F.col("a.step") + 2 * F.col("own.step") + F.col("b.step"), F.col("b.sum") - F.col("a.sum")
    each = held.select("tile_id", "v", zero(F.col("a.at") + F.col("b.at") + F.col("own.beside") - 4 * F.col("v")).alias("lap"), zero(gx * gx + gy * gy).alias("g2"))
    out = each.groupBy("tile_id").agg(F.var_samp("lap").alias("laplacian_variance"), F.avg(F.sqrt("g2")).alias("sobel_mean"), F.avg("g2").alias("tenengrad"), F.stddev_samp("v").alias("contrast"))
    return out.withColumn("blurry", F.col("laplacian_variance") <= threshold)


def stain_quality(pixels: DataFrame, low_saturation: float = 0.08, high_brightness: float = 0.88, low_od: float = 0.15, high_od: float = 2.2, low_brightness: float = 0.18) -> DataFrame:
    """H16 without the least area of components: by tile the shares of over- and understained pixels and 1 less their sum. candidates.detect counts components alone."""
    od, top = density("r") + density("g") + density("b"), F.greatest("r", "g", "b")
    over = (od > high_od) | (top < low_brightness)
    low = ~over & ((saturation() < low_saturation) | (top > high_brightness) | (od < low_od))
    table = pixels.groupBy("tile_id").agg(F.avg(low.cast("double")).alias("low_fraction"), F.avg(over.cast("double")).alias("over_fraction"))
    return table.withColumn("quality", 1 - F.col("low_fraction") - F.col("over_fraction"))


def otsu(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """By group the threshold of a 256-bin histogram on [0, 1] with the greatest variance between classes, the first on ties.

    Windows run over at most 256 bins a group.
    """
    bin_ = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col(value) * 256).cast("int")))
    hist = df.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"))
    low = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    mid = (F.col("bin") + 0.5) / 256
    table = hist.withColumn("w0", F.sum("n").over(low)).withColumn("s0", F.sum(F.col("n") * mid).over(low)).withColumn("w", F.sum("n").over(whole)).withColumn("s", F.sum(F.col("n") * mid).over(whole))
    w1 = F.col("w") - F.col("w0")
    gap = F.try_divide("s0", "w0") - F.try_divide(F.col("s") - F.col("s0"), w1)
    between = F.coalesce(F.col("w0") * w1 * gap * gap, F.lit(0.0))
    return table.groupBy(*by).agg(F.min(F.struct((-between).alias("v"), F.col("bin").alias("bin"))).alias("best")).select(*by, ((F.col("best.bin") + 1) / 256).alias("threshold"))


def pyramid_step(pixels: DataFrame, how: str = "mean") -> DataFrame:
    """The next level of a pyramid: each 2x2 block becomes one pixel."""
    pick = {"mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5)), "max": F.max, "min": F.min}
    keys = [F.col("tile_id"), F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col")]
    if how == "nearest":
        first = lambda c: F.min_by(c, F.struct("row", "col"))
        return pixels.groupBy(*keys).agg(*[first(c).alias(c) for c in "rgb"])
    if how == "mode":
        return pixels.groupBy(*keys).agg(*[F.mode(c, True).alias(c) for c in "rgb"])
    return pixels.groupBy(*keys).agg(*[pick[how](c).alias(c) for c in "rgb"])


def stain_channels(spark, names: tuple[str, ...] = ("Hematoxylin", "HRP/DAB"), vectors: tuple[tuple[float, float, float], ...] = (HEMATOXYLIN_IHC, DAB), colours: tuple[str, ...] | None = None) -> DataFrame:
    """channel_index, name, vector (of length 1), colour of stains. Vectors that are not independent are an error."""
    m = basis(*vectors)
    colours = colours or tuple(STAIN_COLOURS[i % len(STAIN_COLOURS)] for i in range(len(names)))
    rows = [(i, n, [float(v) for v in m[:, i]], c) for i, (n, c) in enumerate(zip(names, colours, strict=True))]
    return spark.createDataFrame(rows, "channel_index int, name string, vector array<double>, colour string")


def he_stain_channels(spark, hematoxylin: tuple[float, float, float] = HEMATOXYLIN, eosin: tuple[float, float, float] = EOSIN, residual: bool = True) -> DataFrame:
    """Hematoxylin, eosin and, if wanted, the completing vector."""
    third = tuple(float(v) for v in basis(hematoxylin, eosin)[:, 2])
    names = ("Hematoxylin", "Eosin", "Residual")[: 3 if residual else 2]
    return stain_channels(spark, names, (hematoxylin, eosin, third)[: len(names)], tuple(HE_COLOURS[n] for n in names))


def estimated_he_channels(pixels: DataFrame, method: str = "macenko", residual: bool = True) -> DataFrame:
    """The channels of the basis that pixels suggest."""
    m = estimated_basis(pixels, method)
    return he_stain_channels(pixels.sparkSession, tuple(m[:, 0]), tuple(m[:, 1]), residual)


def channel_values(cells: DataFrame, channels: DataFrame, key: str, width: int, height: int, origin: tuple[float, float] = (0.0, 0.0), downsample: float = 1.0, radius: float = 0.0, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Each cell's mean of channels(channel_id, row, col, value) within a disk about its pixel, `in_bounds`, and with thresholds whether it is positive.

    A cell asks for the pixels of its disk by an equality on row and column.
    """
    r = radius / downsample
    reach = int(np.ceil(r))
    disk = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if i * i + j * j <= r * r]
    at = lambda v, o: F.floor((F.col(v) - o) / downsample).cast("long")
    placed = cells.select(key, at("y", origin[1]).alias("r0"), at("x", origin[0]).alias("c0"))
    inside = F.coalesce(F.col("r0").between(0, height - 1) & F.col("c0").between(0, width - 1), F.lit(False))
    placed = placed.withColumn("in_bounds", inside)
    asked = placed.filter("in_bounds").withColumn("s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in disk]))).select(key, (F.col("r0") + F.col("s.i")).alias("row"), (F.col("c0") + F.col("s.j")).alias("col"))
    met = asked.join(channels.select("channel_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value").filter(~F.isnan("value")), ["row", "col"])
    means = met.groupBy(key, "channel_id").agg(F.avg("value").alias("value"))
    out = placed.select(key, "in_bounds").join(means, key, "left")
    if thresholds:
        limit = F.lit(None).cast("double")
        for c, t in thresholds.items():
            limit = F.when(F.col("channel_id") == c, F.lit(float(t))).otherwise(limit)
        out = out.withColumn("positive", F.coalesce(F.col("value") >= limit, F.lit(False)))
    return out
