"""Tile grids, sampling, balancing, splitting and review plans (G, F8, N40-N43, N69)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions.scalars import hash_order, label_or


def slide(spark: SparkSession, width: float = 10000, height: float = 8000, downsamples: tuple[float, ...] = (1, 4, 16)) -> DataFrame:
    """A one-row slide: size and pyramid levels (A1-A4)."""
    level = ", ".join(f"named_struct('level', {k}, 'width', ceil({width} / {d}), 'height', ceil({height} / {d}), 'downsample', CAST({d} AS DOUBLE))" for k, d in enumerate(downsamples))
    return spark.sql(f"SELECT 'slide' AS slide_id, CAST({width} AS DOUBLE) AS width, CAST({height} AS DOUBLE) AS height, array({level}) AS levels")


def levels(slides: DataFrame) -> DataFrame:
    """A4."""
    return slides.select("slide_id", F.inline("levels"))


def tile_grid(slides: DataFrame, tile_size: int = 512, overlap: int = 0, level: int = 0, include_partial: bool = False) -> DataFrame:
    """G1: tiles row by row. x and y are level-0 pixels, rounded half to even; width and height are pixels of the level."""
    step = tile_size - overlap
    if step <= 0:
        raise ValueError("overlap must be less than the tile size")
    at = slides.withColumn("l", F.get("levels", F.lit(level))).select("slide_id", F.col("l.downsample").alias("downsample"), (F.col("width") / F.col("l.downsample")).alias("w"), (F.col("height") / F.col("l.downsample")).alias("h"))

    def starts(extent: str) -> Column:
        last = F.ceil(extent) - 1 if include_partial else F.floor(F.col(extent) - tile_size)
        return F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    grid = at.select("*", F.posexplode(starts("h")).alias("row", "ly")).select("*", F.posexplode(starts("w")).alias("col", "lx"))
    size = lambda extent, start: F.least(F.lit(tile_size).cast("double"), F.ceil(F.col(extent) - F.col(start)).cast("double")).cast("int")
    return grid.select(
        "slide_id", F.format_string(f"L{level}_R%05d_C%05d", F.col("row") + 1, F.col("col") + 1).alias("tile_id"), F.bround(F.col("lx") * F.col("downsample")).cast("long").alias("x"), F.bround(F.col("ly") * F.col("downsample")).cast("long").alias("y"),
        size("w", "lx").alias("width"), size("h", "ly").alias("height"), F.lit(level).alias("level"), (F.col("row") + 1).alias("row"), (F.col("col") + 1).alias("col"), "downsample",
    )


def grid_from_coords(coords: DataFrame, width: float, height: float, tile_size: int = 512, anchor: str = "top_left", bounds: str = "error") -> DataFrame:
    """Tiles at given points; beyond the edge they are trimmed, dropped or an error."""
    half = tile_size / 2 if anchor == "center" else 0
    x, y = F.bround(F.col("x") - half), F.bround(F.col("y") - half)
    tiles = coords.withColumn("x", x).withColumn("y", y)
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + tile_size <= width) & (F.col("y") + tile_size <= height)
    if bounds == "drop":
        return tiles.filter(inside).withColumn("width", F.lit(float(tile_size))).withColumn("height", F.lit(float(tile_size)))
    if bounds == "trim":
        left, top = F.greatest(F.col("x"), F.lit(0.0)), F.greatest(F.col("y"), F.lit(0.0))
        right, low = F.least(F.col("x") + tile_size, F.lit(float(width))), F.least(F.col("y") + tile_size, F.lit(float(height)))
        return tiles.withColumn("width", right - left).withColumn("height", low - top).withColumn("x", left).withColumn("y", top).filter("width > 0 AND height > 0")
    return tiles.withColumn("width", F.when(inside, F.lit(float(tile_size))).otherwise(F.raise_error(F.lit("a tile lies beyond the slide")).cast("double"))).withColumn("height", F.lit(float(tile_size)))


def roi_tiles(tiles: DataFrame, rois: DataFrame) -> DataFrame:
    """Tiles whose centre lies in a region, with its id and class (the first by index)."""
    from .regions import associate

    centred = tiles.withColumn("tx", F.col("x")).withColumn("ty", F.col("y"))
    mid = centred.withColumn("x", F.col("tx") + F.col("width") * F.col("downsample") / 2).withColumn("y", F.col("ty") + F.col("height") * F.col("downsample") / 2)
    met = associate(mid, rois).filter("roi_id IS NOT NULL")
    return met.withColumn("x", F.col("tx")).withColumn("y", F.col("ty")).drop("tx", "ty").withColumn("class", label_or(F.col("class"), "unlabelled"))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 1) -> DataFrame:
    """N rows, chosen by a seeded hash of the key."""
    return df.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def balance(tiles: DataFrame, key: str, per_class: int | None = None, most: int | None = None, seed: int = 1) -> DataFrame:
    """As many tiles of each class as the smallest class has, or per_class, but no more than most / number of classes; chosen by a seeded hash.

    Ranks run within parts of a class by the first byte of the hash, so that a large class is no single task's work.
    """
    tiles = tiles.withColumn("__class", label_or(F.col("class"), "unlabelled")).withColumn("__order", hash_order(seed, F.col(key))).withColumn("__part", F.substring("__order", 1, 2))
    parts = tiles.groupBy("__class", "__part").agg(F.count("*").alias("__n"))
    sizes = parts.groupBy("__class").agg(F.sum("__n").alias("n"))
    limit = F.lit(per_class) if per_class else F.least("least", F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("k")))) if most else F.col("least")
    quota = sizes.agg(F.min("n").alias("least"), F.count("*").alias("k")).select(limit.cast("long").alias("__quota"))
    before = F.sum("__n").over(Window.partitionBy("__class").orderBy("__part")) - F.col("__n")
    parts = parts.withColumn("__before", before).crossJoin(F.broadcast(quota)).filter("__before < __quota")
    rank = F.row_number().over(Window.partitionBy("__class", "__part").orderBy("__order", key))
    met = tiles.withColumn("__rank", rank).join(parts, ["__class", "__part"])
    return met.filter("__before + __rank <= __quota").withColumn("class", F.col("__class")).drop("__class", "__part", "__order", "__n", "__before", "__quota", "__rank")


def split_counts(sizes: DataFrame, shares: dict[str, float]) -> DataFrame:
    """For each class the rows of each split: one of each with a share, then the rest by floors and largest remainders (on ties the greater share). With fewer rows than splits the greatest shares get one."""
    names = [k for k, v in shares.items() if v > 0]
    total, k = sum(shares[n] for n in names), len(names)
    rest = F.greatest(F.col("n") - k, F.lit(0))
    raw = {n: rest * F.lit(shares[n] / total) for n in names}
    left = rest - sum((F.floor(r) for r in raw.values()), F.lit(0))
    order = F.array_sort(F.array(*[F.struct(F.round(F.floor(r) - r, 9).alias("r"), F.lit(-shares[n]).alias("s"), F.lit(i).alias("i")) for i, (n, r) in enumerate(raw.items())]))
    place = lambda i: F.array_position(F.transform(order, lambda s: s["i"]), F.lit(i))
    by_share = sorted(names, key=lambda n: -shares[n])
    out = sizes
    for i, n in enumerate(names):
        many = 1 + F.floor(raw[n]) + (place(i) <= left).cast("long")
        out = out.withColumn(f"n_{n}", F.when(F.col("n") >= k, many).otherwise((F.col("n") > by_share.index(n)).cast("long")))
    for n in shares:
        if n not in names:
            out = out.withColumn(f"n_{n}", F.lit(0).cast("long"))
    return out


def split(tiles: DataFrame, key: str, shares: dict[str, float], seed: int = 1) -> DataFrame:
    """Every tile with its `split`, in exact proportions within each class, dealt by a seeded hash."""
    tiles = tiles.withColumn("__class", label_or(F.col("class"), "unlabelled")).withColumn("__order", hash_order(seed, F.col(key))).withColumn("__part", F.substring("__order", 1, 2))
    parts = tiles.groupBy("__class", "__part").agg(F.count("*").alias("__n"))
    sizes = split_counts(parts.groupBy("__class").agg(F.sum("__n").alias("n")), shares)
    parts = parts.withColumn("__before", F.sum("__n").over(Window.partitionBy("__class").orderBy("__part")) - F.col("__n")).join(sizes, "__class")
    rank = F.row_number().over(Window.partitionBy("__class", "__part").orderBy("__order", key))
    met = tiles.withColumn("__rank", rank).join(parts, ["__class", "__part"])
    names, at, edge, choice = list(shares), F.col("__before") + F.col("__rank"), F.lit(0), None
    for name in names[:-1]:
        edge = edge + F.col(f"n_{name}")
        choice = F.when(at <= edge, F.lit(name)) if choice is None else choice.when(at <= edge, F.lit(name))
    choice = F.lit(names[-1]) if choice is None else choice.otherwise(F.lit(names[-1]))
    return met.withColumn("split", choice).select(*[c for c in tiles.columns if not c.startswith("__")], "split")


def tissue_fraction(tiles: DataFrame, mask: DataFrame, scale: float, tile_extent: Column | None = None) -> DataFrame:
    """The share of tissue among mask cells that a tile overlaps. mask(row, col, tissue) from 0, a cell is `scale` level-0 pixels wide."""
    w = F.col("width") * F.col("downsample")
    h = F.col("height") * F.col("downsample")
    first = lambda v: F.floor(v / scale).cast("long")
    last = lambda v, e: F.greatest(F.floor(v / scale), F.ceil((v + e) / scale) - 1).cast("long")
    cells = tiles.select("tile_id", F.explode(F.sequence(first(F.col("y")), last(F.col("y"), h))).alias("row"), "x", w.alias("w")).select("tile_id", "row", F.explode(F.sequence(first(F.col("x")), last(F.col("x"), F.col("w")))).alias("col"))
    met = cells.join(mask.select(F.col("row").cast("long"), F.col("col").cast("long"), "tissue"), ["row", "col"])
    share = met.groupBy("tile_id").agg(F.avg(F.col("tissue").cast("double")).alias("tissue_fraction"))
    return tiles.join(share, "tile_id", "left")


def review_plan(observations: DataFrame, images: DataFrame, tile_size: float, units: str = "px", bounds: str = "drop", max_tiles: int = 10_000) -> DataFrame:
    """F8: the tiles of a floor grid that hold selected observations(id, tissue_id, x, y), with their ids; edges dropped, trimmed or an error.

    More tiles than max_tiles are an error, never a cut. The plan id hashes tile and members, so order does not matter.
    """
    side = F.lit(float(tile_size)) if units == "px" else F.lit(float(tile_size)) / F.col("mpp_x")
    met = observations.join(images.select("tissue_id", F.col("width").alias("iw"), F.col("height").alias("ih"), "mpp_x"), "tissue_id").withColumn("side", side)
    met = met.withColumn("tx", F.floor(F.col("x") / F.col("side")) * F.col("side")).withColumn("ty", F.floor(F.col("y") / F.col("side")) * F.col("side"))
    tiles = met.groupBy("tissue_id", "tx", "ty", "side", "iw", "ih").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    tiles = tiles.withColumn("w", F.least("side", F.col("iw") - F.col("tx"))).withColumn("h", F.least("side", F.col("ih") - F.col("ty")))
    whole = (F.col("w") == F.col("side")) & (F.col("h") == F.col("side"))
    if bounds == "drop":
        tiles = tiles.filter(whole)
    elif bounds == "error":
        tiles = tiles.filter(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("a tile lies beyond the image")).cast("boolean")))
    else:
        tiles = tiles.filter("w > 0 AND h > 0")
    if tiles.limit(max_tiles + 1).count() > max_tiles:
        raise ValueError(f"more than {max_tiles} tiles")
    name = F.sha2(F.concat_ws("|", "tissue_id", F.col("tx").cast("string"), F.col("ty").cast("string"), F.concat_ws(",", F.col("ids").cast("array<string>"))), 256)
    return tiles.select(name.alias("plan_id"), "tissue_id", F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("w").alias("width"), F.col("h").alias("height"), F.size("ids").alias("n"), "ids")


def deep_zoom(slides: DataFrame, tile_size: int = 512, overlap: int = 1) -> DataFrame:
    """Every tile address of a Deep Zoom pyramid with its level-0 region."""
    top = F.ceil(F.log2(F.greatest("width", "height"))).cast("int")
    at = slides.withColumn("max_level", top).select("slide_id", "width", "height", "max_level", F.explode(F.sequence(F.lit(0), top)).alias("level"))
    at = at.withColumn("downsample", F.pow(F.lit(2.0), F.col("max_level") - F.col("level"))).withColumn("lw", F.ceil(F.col("width") / F.col("downsample"))).withColumn("lh", F.ceil(F.col("height") / F.col("downsample")))
    count = lambda c: F.greatest(F.ceil(F.col(c) / tile_size).cast("int"), F.lit(1))
    at = at.select("*", F.explode(F.sequence(F.lit(0), count("lw") - 1)).alias("tx")).select("*", F.explode(F.sequence(F.lit(0), count("lh") - 1)).alias("ty"))
    low = lambda c: F.when(F.col(c) > 0, F.col(c) * tile_size - overlap).otherwise(F.lit(0))
    high = lambda c, e: F.least(F.col(e), (F.col(c) + 1) * tile_size + overlap)
    return at.select(
        "slide_id", "level", "tx", "ty", "downsample", (low("tx") * F.col("downsample")).alias("x"), (low("ty") * F.col("downsample")).alias("y"),
        (high("tx", "lw") - low("tx")).cast("long").alias("out_width"), (high("ty", "lh") - low("ty")).cast("long").alias("out_height"),
    )


def tile_rois(rois: DataFrame, tile_size: int, step: int | None = None) -> DataFrame:
    """The boxes of regions cut into tiles of a side, row by row; partial tiles are left out."""
    from .regions import with_bbox

    step = step or tile_size
    starts = lambda lo, hi: F.when(F.col(hi) - F.col(lo) >= tile_size, F.sequence(F.bround(F.col(lo)).cast("long"), F.floor(F.col(hi) - tile_size).cast("long"), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    boxes = with_bbox(rois)
    return boxes.select("roi_id", "class", F.explode(starts("ymin", "ymax")).alias("y"), "xmin", "xmax").select("roi_id", "class", F.explode(starts("xmin", "xmax")).alias("x"), "y", F.lit(tile_size).alias("width"), F.lit(tile_size).alias("height"))


def circles(points: DataFrame, radius: float = 8.0) -> DataFrame:
    """A 24-cornered region about each point."""
    return points.withColumn("geometry", G.circle(F.col("x"), F.col("y"), radius))
