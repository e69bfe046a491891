"""Experiment tables, registration of tissue and points, and combined reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from ..functions.scalars import namespace_id
from ..sources.work import deleted, written
from . import pixels as P
from . import proximity, regions

IMAGE = StructType([StructField(n, t) for n, t in (("sha256", StringType()), ("width", LongType()), ("height", LongType()), ("mpp_x", DoubleType()), ("mpp_y", DoubleType()), ("frame_id", StringType()), ("coordinate_convention", StringType()))])
FEATURES = StructType([StructField(n, StringType()) for n in ("id", "path", "sha256", "unit")])
MANIFEST = StructType([StructField("version", LongType()), StructField("experiment_id", StringType()), StructField("tissues", ArrayType(StructType([StructField("tissue_id", StringType()), StructField("image", IMAGE), StructField("feature_sets", ArrayType(FEATURES))])))])


def read_experiment(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """A row a tissue and feature set from a version-1 manifest; with `verify`, files whose SHA-256 differs are an error."""
    rows = spark.read.schema(MANIFEST).json(path, multiLine=True)
    bad = F.raise_error(F.lit("only version 1 manifests can be read")).cast("boolean")
    rows = rows.filter(F.when(F.col("version") == 1, F.lit(True)).otherwise(bad))
    table = rows.select("experiment_id", F.explode("tissues").alias("t")).select("experiment_id", "t.tissue_id", "t.image", F.explode("t.feature_sets").alias("f")).select("experiment_id", "tissue_id", "image.*", F.col("f.id").alias("feature_set_id"), F.col("f.path").alias("feature_path"), F.col("f.sha256").alias("feature_sha256"), F.col("f.unit").alias("unit"))
    if not verify:
        return table
    base = path.rpartition("/")[0]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv*").option("recursiveFileLookup", "true").load(base)
    hashes = files.select(F.replace(F.regexp_replace("path", "^file:/+", "/"), F.lit(f"{base}/"), F.lit("")).alias("feature_path"), F.sha2("content", 256).alias("found"))
    differs = F.raise_error(F.concat(F.lit("hash differs: "), "feature_path")).cast("boolean")
    return table.join(hashes, "feature_path", "left").filter(F.when(F.col("found").eqNullSafe(F.col("feature_sha256")), F.lit(True)).otherwise(differs)).drop("found")


def experiment_features(spark: SparkSession, base: str, tissues: DataFrame, feature_set_id: str, id_col: str = "id") -> DataFrame | None:
    """Feature tables of all tissues in one: namespaced id, tissue_id, features. All files are read at once; a header that differs from the first is an error. None without such a set.

    One small row a tissue, its path, is on the driver, which names the files.
    """
    wanted = tissues.filter(F.col("feature_set_id") == feature_set_id).select("tissue_id", "feature_path").distinct()
    paths = sorted({f"{base}/{r['feature_path']}" for r in wanted.collect()})
    if not paths:
        return None
    names = spark.read.csv(paths[0], header=True).columns
    rows = spark.read.schema(", ".join(f"`{c}` string" for c in names)).csv(paths, header=True, enforceSchema=False)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    came = plain(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))))
    features = F.array(*[F.col(f"`{c}`").try_cast("double") for c in names if c != id_col])
    held = rows.select(F.col(f"`{id_col}`").alias("own"), features.alias("features"), came.alias("path"))
    whose = wanted.select("tissue_id", plain(F.concat(F.lit(f"{base}/"), "feature_path")).alias("path"))
    return held.join(whose, "path").select(namespace_id(F.col("tissue_id"), F.col("own")).alias("id"), "tissue_id", "features")


def tissue_translation(mask: DataFrame, points: DataFrame, scale: float, width: float, height: float, offsets: list[float], sample: int | None = None) -> DataFrame:
    """The shift (dx, dy) among the offsets with the largest share of points on tissue times the share within the slide; then the smallest shift.

    mask(row, col) are tissue cells of a side `scale`. Shifted points meet cells by equality; one row an offset pair comes out.
    All points count; `sample` takes so many of them, by hash.
    """
    held = points.orderBy(F.xxhash64("x", "y"), "x", "y").limit(sample) if sample else points
    pairs = F.array(*[F.struct(F.lit(float(a)).alias("dx"), F.lit(float(b)).alias("dy")) for a in offsets for b in offsets])
    moved = held.select("x", "y", F.inline(pairs)).withColumn("u", F.col("x") + F.col("dx")).withColumn("v", F.col("y") + F.col("dy"))
    inside = (F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height)
    cells = mask.select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), F.lit(1.0).alias("hit")).distinct()
    met = moved.withColumn("r", F.floor(F.col("v") / scale)).withColumn("c", F.floor(F.col("u") / scale)).withColumn("inside", inside).join(cells, ["r", "c"], "left")
    score = met.groupBy("dx", "dy").agg((F.coalesce(F.avg(F.when(F.col("inside"), F.coalesce("hit", F.lit(0.0)))), F.lit(0.0)) * F.avg(F.col("inside").cast("double"))).alias("score"))
    return score.orderBy(F.col("score").desc(), F.abs("dx") + F.abs("dy"), "dx", "dy").limit(1)


def estimate_translation(mask: DataFrame, points: DataFrame, mask_size: tuple[int, int], slide_size: tuple[float, float], max_shift: float = 0.25, coarse_step: int = 20, refine_radius: int = 25, refine_step: int = 1) -> DataFrame:
    """The shift of points onto tissue, first by steps over all shifts up to max_shift, then by finer ones around the best: dx, dy (slide), score, thumbnail_dx, thumbnail_dy, points.

    mask(row, col) are the tissue pixels of a thumbnail of mask_size, from 1. The score is the number of points that a shift
    brings onto tissue over that of all points, those without finite coordinates included. Ties go to the smallest dx,
    then dy; a finer shift must score more than the coarse one. A max_shift of at most 1 is a share of the thumbnail.
    All points count: they are summed by pixel once, and counts meet tissue row by row, so work beyond the first pass
    follows the thumbnail, not the points. Without points the score is 0 at the first shift.
    """
    (width, height), spark = mask_size, mask.sparkSession
    if min(coarse_step, refine_step) < 1 or refine_radius < 0 or max_shift < 0:
        raise ValueError("steps are at least 1, shifts and radius at least 0")
    top = [math.ceil(v * max_shift if max_shift <= 1 else max_shift) for v in mask_size]
    reach = max(top) + refine_radius
    at = lambda c, k: F.bround(F.col(c).cast("double") * mask_size[k] / slide_size[k])
    placed = points.select(at("x", 0).alias("px"), at("y", 1).alias("py"))
    counts = written(placed.groupBy("px", "py").agg(F.count("*").alias("n")), "pixels")
    total = counts.agg(F.sum("n")).first()[0] or 0
    near = counts.filter(F.col("px").between(1 - reach, width + reach) & F.col("py").between(1 - reach, height + reach))
    lines = near.groupBy(F.col("py").cast("int").alias("py")).agg(F.collect_list(F.col("px").cast("int")).alias("at"), F.collect_list("n").alias("n"))
    inside = mask.filter(F.col("row").between(1, height) & F.col("col").between(1, width))
    tissue = inside.groupBy(F.col("row").cast("int").alias("row")).agg(F.collect_set(F.col("col").cast("int")).alias("cols"))

    def best(across: range, down: range):
        def hits(batches):
            import numpy as np
            import pandas as pd

            found, dx = {}, np.asarray(across)
            for pdf in batches:
                for dy, at, n, cols in zip(pdf["dy"], pdf["at"], pdf["n"], pdf["cols"], strict=True):
                    line = np.zeros(width + 2, dtype=np.int64)
                    line[cols] = 1
                    met = line[np.clip(np.add.outer(dx, at), 0, width + 1)] @ np.asarray(n, dtype=np.int64)
                    found[dy] = found.get(dy, 0) + met
            for dy, met in found.items():
                yield pd.DataFrame({"dx": dx, "dy": dy, "hits": met})

        moved = lines.withColumn("dy", F.explode(F.array(*[F.lit(d) for d in down])))
        sums = moved.join(tissue, moved["py"] + moved["dy"] == tissue["row"]).select("dy", "at", "n", "cols").mapInPandas(hits, "dx int, dy int, hits long").groupBy("dx", "dy").agg(F.sum("hits").alias("hits"))
        row = sums.orderBy(F.col("hits").desc(), "dx", "dy").first()
        return (row["hits"], row["dx"], row["dy"]) if row and row["hits"] else (0, across[0], down[0])

    found = best(*[range(-t, t + 1, coarse_step) for t in top])
    if refine_radius:
        finer = best(*[range(v - refine_radius, v + refine_radius + 1, refine_step) for v in found[1:]])
        found = finer if finer[0] > found[0] else found
    deleted(counts)
    shift = [v * s / m for v, s, m in zip(found[1:], slide_size, mask_size, strict=True)]
    return spark.createDataFrame([(*shift, found[0] / total if total else 0.0, *found[1:], total)], "dx double, dy double, score double, thumbnail_dx long, thumbnail_dy long, points long")


def linked(coordinates: DataFrame, embeddings: DataFrame, width: float, height: float, image_width: float, image_height: float) -> DataFrame:
    """Coordinates with embeddings by id; where points overrun the image by more than 15 %, they are taken as full-resolution and scaled down to it."""
    top = coordinates.agg(F.max("x").alias("x"), F.max("y").alias("y")).first()
    over = (top["x"] or 0) > 1.15 * image_width or (top["y"] or 0) > 1.15 * image_height
    sx, sy = (image_width / width, image_height / height) if over else (1.0, 1.0)
    return coordinates.join(embeddings, "id").withColumn("x", F.col("x") * sx).withColumn("y", F.col("y") * sy)


def feature_geometry(features: DataFrame, step: float, width: float, height: float) -> DataFrame:
    """features(row, col) on a grid of a step: the logical centre, held within the image, and whether the cell runs over its edge. Cells that begin beyond it are an error."""
    x0, y0 = F.col("col") * step, F.col("row") * step
    bad = F.raise_error(F.lit("a feature lies beyond the image")).cast("boolean")
    fine = features.filter(F.when((x0 < width) & (y0 < height) & (x0 >= 0) & (y0 >= 0), F.lit(True)).otherwise(bad))
    return fine.withColumn("x", F.least(x0 + step / 2, F.lit(float(width)))).withColumn("y", F.least(y0 + step / 2, F.lit(float(height)))).withColumn("padded", (x0 + step > width) | (y0 + step > height))


def native_points(scores: DataFrame, matrix: list[list[float]], width: float, height: float) -> DataFrame:
    """Points through an affine map into the slide; those beyond it are left out."""
    x = F.col("x") * matrix[0][0] + F.col("y") * matrix[0][1] + matrix[0][2]
    y = F.col("x") * matrix[1][0] + F.col("y") * matrix[1][1] + matrix[1][2]
    moved = scores.withColumn("__x", x).withColumn("__y", y).drop("x", "y").withColumnsRenamed({"__x": "x", "__y": "y"})
    return moved.filter((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") <= width) & (F.col("y") <= height))


def measurement_report(rois: DataFrame, cells: DataFrame | None = None, channel_pixels: DataFrame | None = None, key: str = "point_id", pixel_size: float | None = None, threshold: float = 0.1, only: set[str] | None = None) -> dict[str, DataFrame]:
    """up to seven tables: regions, classes, nearest cells, cell boundaries, stain values by region, IHC by region and by class; `only` names those wanted.

    channel_pixels(x, y, hematoxylin, dab) are placed in regions as points are.
    """
    made = {"rois": lambda: regions.roi_table(rois, pixel_size), "classes": lambda: regions.summarise_rois(rois, cells, pixel_size)}
    if cells is not None:
        made |= {"nearest_cells": lambda: proximity.nearest_cells(cells, key, pixel_size), "cells_to_roi": lambda: regions.cells_to_roi(cells, rois, key, pixel_size)}
    if channel_pixels is not None:
        long = lambda: regions.all_regions(channel_pixels, rois).select("roi_id", F.explode(F.create_map(F.lit("hematoxylin"), "hematoxylin", F.lit("dab"), "dab")).alias("channel", "value"))
        by_roi = lambda: P.ihc_in_regions(channel_pixels, rois, threshold, pixel_size)
        made |= {"stain": lambda: P.stain_intensity(long(), ["roi_id", "channel"], threshold), "ihc": by_roi, "ihc_classes": lambda: P.ihc_classes(by_roi())}
    return {name: table() for name, table in made.items() if only is None or name in only}


def coordinate_scale(coordinates: DataFrame, slide: tuple[float, float], fullres: tuple[float, float], scale: str = "auto", factors: dict[str, float] | None = None, image: tuple[float, float] | None = None, custom: tuple[float, float] | None = None) -> tuple[str, float, float]:
    """The method and the factors that bring spot coordinates to the slide. auto: those of the object's image where points lie within 1.15 times it, else full resolution."""
    full = (slide[0] / fullres[0], slide[1] / fullres[1])
    if scale == "custom":
        if not custom or min(custom) <= 0:
            raise ValueError("a custom scale has two factors above 0")
        return ("custom", *custom)
    if scale == "none":
        return ("none", 1.0, 1.0)
    if scale == "fullres":
        return ("fullres", *full)
    if scale in ("hires", "lowres"):
        if not (factors or {}).get(scale):
            raise ValueError(f"no scale factor for {scale}")
        return (scale, full[0] / factors[scale], full[1] / factors[scale])
    if not image or min(image) <= 0:
        return ("auto_fullres", *full)
    own = (slide[0] / image[0], slide[1] / image[1])
    if scale == "image":
        return ("image", *own)
    top = coordinates.agg(F.max("x").alias("x"), F.max("y").alias("y")).first()
    within = (top["x"] or 0) <= 1.15 * image[0] and (top["y"] or 0) <= 1.15 * image[1]
    return ("auto_image", *own) if within else ("auto_fullres", *full)


def scaled(coordinates: DataFrame, found: tuple[str, float, float]) -> DataFrame:
    """Coordinates by the factors of coordinate_scale."""
    return coordinates.withColumn("x", F.col("x") * found[1]).withColumn("y", F.col("y") * found[2])


def read_display_bundle(spark: SparkSession, path: str, sha256: str, most: int = 10_000) -> DataFrame:
    """Observations of a display bundle (Parquet or JSON lines in one file), if its hash agrees and it has at most `most` rows; else an error."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).collect()
    if [r["h"] for r in found] != [sha256]:
        raise ValueError("the bundle's hash differs")
    rows = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.json(path)
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} observations")
    return rows


def partition_features(files: DataFrame, width: int, most: int = 2000) -> DataFrame:
    """files(path, content, sha256, rows: the row numbers wanted) of little-endian float32 rows of a width: path, row, features. A file whose hash differs or that lacks a row, and more rows than `most`, are errors."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for path, content, rows in zip(pdf["path"], pdf["content"], pdf["rows"], strict=True):
                if len(rows) > most:
                    raise ValueError(f"more than {most} rows of {path}")
                table = np.frombuffer(content, dtype="<f4").reshape(-1, width)
                if len(rows) and max(rows) >= len(table):
                    raise ValueError(f"{path} has {len(table)} rows")
                yield pd.DataFrame({"path": path, "row": list(rows), "features": [table[r].astype(float).tolist() for r in rows]})

    differs = F.raise_error(F.concat(F.lit("hash differs: "), "path")).cast("boolean")
    fine = files.filter(F.when(F.sha2("content", 256) == F.col("sha256"), F.lit(True)).otherwise(differs))
    return fine.select("path", "content", "rows").mapInPandas(run, "path string, row int, features array<double>")


def gradient(df: DataFrame, value: str, low: str = "#2B6CB0", mid: str = "#F8FAFC", high: str = "#B91C1C", out: str = "color") -> DataFrame:
    """A colour from low over mid to high in Lab space by the value's place between the extremes; grey where it is not finite, low where all values are equal. Only the extremes travel."""
    fine = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    ends = df.filter(fine).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    met = df.crossJoin(F.broadcast(ends))  # one row
    flat = F.col("__lo").isNull() | (F.col("__hi") - F.col("__lo") < 1e-12)
    t = (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    stops = [_lab(c) for c in (low, mid, high)]
    k = F.when(t < 0.5, F.lit(0)).otherwise(F.lit(1))
    u = t * 2 - k
    lab = [F.when(k == 0, (1 - u) * stops[0][i] + u * stops[1][i]).otherwise((1 - u) * stops[1][i] + u * stops[2][i]) for i in range(3)]
    fy = (lab[0] + 16) / 116
    xyz = [F.when(f * f * f > 216 / 24389, f * f * f).otherwise((116 * f - 16) * 27 / 24389) * w for f, w in ((fy + lab[1] / 500, WHITE[0]), (fy, WHITE[1]), (fy - lab[2] / 200, WHITE[2]))]
    linear = [sum((v * m for v, m in zip(xyz, row, strict=True)), F.lit(0.0)) for row in FROM_XYZ]
    srgb = [F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055) for v in linear]
    part = lambda v: F.lpad(F.hex(F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), v * 255)) + 0.5)), 2, "0")
    made = F.concat(F.lit("#"), *[part(v) for v in srgb])
    return met.withColumn(out, F.when(~fine, F.when(F.col("__lo").isNull(), F.lit(low)).otherwise(F.lit("#999999"))).when(flat, F.lit(low)).otherwise(made)).drop("__lo", "__hi")


# fixed values: the sRGB primaries and the D65 white
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)


def _lab(colour: str) -> tuple[float, float, float]:
    v = [int(colour[i : i + 2], 16) / 255 for i in (1, 3, 5)]
    linear = [c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in v]
    f = [(lambda q: q ** (1 / 3) if q > 216 / 24389 else (24389 / 27 * q + 16) / 116)(sum(a * b for a, b in zip(row, linear, strict=True)) / w) for row, w in zip(TO_XYZ, WHITE, strict=True)]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])
