"""Regions, thumbnails, crops and tiles of slides kept as pixel tables, tile filters and their heatmaps.

A slide's pixels are levels(slide_id, level, row, col, r, g, b), rows and columns from 0 in pixels of the level; tables
partitioned by level and sorted by row read only what a box covers. Requests are in level-0 pixels. Images leave as
binary PPM in a column, a row a tile, so any sink of Spark takes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import candidates, masks, regions, tiles
from . import pixels as P

#: The side of the blocks in which pixels meet tiles.
BLOCK = 256


def associated_images(slides: DataFrame) -> DataFrame:
    """slide_id and the sorted names of associated images, from properties `openslide.associated.<name>.width`."""
    keys = F.filter(F.map_keys("properties"), lambda k: k.rlike(r"^openslide\.associated\.[^.]+\.width$"))
    return slides.select("slide_id", F.sort_array(F.transform(keys, lambda k: F.regexp_extract(k, r"associated\.([^.]+)\.", 1))).alias("images"))


def properties(slides: DataFrame) -> DataFrame:
    """A5: a row a property."""
    return slides.select("slide_id", F.explode("properties").alias("key", "value"))


def in_region(x: float, y: float, width: float, height: float, downsample: float, level: int) -> Column:
    """The filter of a region: it reaches the scan. x, y are level-0 pixels, width and height pixels of the level."""
    c0, r0 = int(x // downsample), int(y // downsample)
    return (F.col("level") == level) & (F.col("row") >= r0) & (F.col("row") < r0 + int(height)) & (F.col("col") >= c0) & (F.col("col") < c0 + int(width))


def read_region(levels: DataFrame, x: float, y: float, width: float, height: float, level: int = 0, downsample: float = 1.0) -> DataFrame:
    """The pixels of a rectangle, rows and columns from 0 at its corner. Places beyond the slide have no row."""
    if width <= 0 or height <= 0:
        raise ValueError("a region has a width and a height")
    held = levels.filter(in_region(x, y, width, height, downsample, level))
    return held.withColumn("row", F.col("row") - int(y // downsample)).withColumn("col", F.col("col") - int(x // downsample))


def deconvolved_region(levels: DataFrame, box: tuple[float, float, float, float], m, names: tuple[str, ...], level: int = 0, downsample: float = 1.0) -> DataFrame:
    """A region's stain concentrations."""
    return P.deconvolved(read_region(levels, *box, level, downsample), m, names, ("slide_id", "row", "col"))


def deconvolved_he_region(levels: DataFrame, box: tuple[float, float, float, float], level: int = 0, downsample: float = 1.0) -> DataFrame:
    """H27."""
    return P.deconvolved_he(read_region(levels, *box, level, downsample), keep=("slide_id", "row", "col"))


def normalised_region(levels: DataFrame, box: tuple[float, float, float, float], source, target, target_high: tuple[float, float], level: int = 0, downsample: float = 1.0) -> DataFrame:
    """H30."""
    return P.normalised(read_region(levels, *box, level, downsample), source, target, target_high, keep=("slide_id", "row", "col"))


def thumbnail(levels: DataFrame, slides: DataFrame, width: int = 1024, level: int = 0) -> DataFrame:
    """A10: each slide's level shrunk by the whole number at which it is at most `width` pixels wide, by means. slides(slide_id, level_width)."""
    step = F.greatest(F.lit(1), F.ceil(F.col("level_width") / width)).cast("int")
    met = levels.filter(F.col("level") == level).join(slides.select("slide_id", step.alias("step")), "slide_id")
    at = lambda c: F.floor(F.col(c) / F.col("step")).cast("int").alias(c)
    return met.groupBy("slide_id", at("row"), at("col")).agg(*[F.avg(c).alias(c) for c in "rgb"])


def read_grid(levels: DataFrame, grid: DataFrame) -> DataFrame:
    """pixels(tile_id, row, col, r, g, b) of tiles(slide_id, tile_id, x, y, width, height, level, downsample), which may overlap.

    Tiles are listed by the blocks that they touch and meet pixels by an equality on the block.
    """
    c0, r0 = F.floor(F.col("x") / F.col("downsample")).cast("int"), F.floor(F.col("y") / F.col("downsample")).cast("int")
    held = grid.select("slide_id", "level", "tile_id", c0.alias("c0"), r0.alias("r0"), F.col("width").cast("int").alias("w"), F.col("height").cast("int").alias("h"))
    span = lambda low, n: F.sequence(F.floor(F.col(low) / BLOCK), F.floor((F.col(low) + F.col(n) - 1) / BLOCK))
    listed = held.withColumn("br", F.explode(span("r0", "h"))).withColumn("bc", F.explode(span("c0", "w")))
    met = levels.withColumn("br", F.floor(F.col("row") / BLOCK)).withColumn("bc", F.floor(F.col("col") / BLOCK)).join(listed, ["slide_id", "level", "br", "bc"])
    inside = met.filter("row >= r0 AND row < r0 + h AND col >= c0 AND col < c0 + w")
    return inside.select("tile_id", (F.col("row") - F.col("r0")).alias("row"), (F.col("col") - F.col("c0")).alias("col"), "r", "g", "b")


def roi_crops(rois: DataFrame, slide_id: str, level: int = 0, downsample: float = 1.0, only: list[str] | None = None) -> DataFrame:
    """The boxes of regions as tiles for read_grid, widened to whole pixels of the level."""
    held = regions.with_bbox(regions.areal(rois if only is None else rois.filter(F.col("roi_id").isin(only))))
    low = lambda c: F.floor(F.col(c) / downsample)
    high = lambda c: F.ceil(F.col(c) / downsample)
    return held.select(
        F.lit(slide_id).alias("slide_id"), F.col("roi_id").alias("tile_id"), (low("xmin") * downsample).cast("double").alias("x"), (low("ymin") * downsample).cast("double").alias("y"),
        (high("xmax") - low("xmin")).cast("int").alias("width"), (high("ymax") - low("ymin")).cast("int").alias("height"), F.lit(level).alias("level"), F.lit(float(downsample)).alias("downsample"),
    )


def encoded_tiles(pixels: DataFrame) -> DataFrame:
    """tile_id, width, height, content (binary PPM), sha256: a tile is a small group, whose missing pixels are black."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        h, w = int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1
        image = np.zeros((h, w, 3), dtype=np.uint8)
        image[pdf["row"], pdf["col"]] = np.clip(np.rint(pdf[["r", "g", "b"]].to_numpy() * 255), 0, 255)
        return pd.DataFrame({"tile_id": [str(pdf["tile_id"].iloc[0])], "width": [w], "height": [h], "content": [f"P6 {w} {h} 255\n".encode() + image.tobytes()]})

    made = pixels.groupBy("tile_id").applyInPandas(run, "tile_id string, width int, height int, content binary")
    return made.withColumn("sha256", F.sha2("content", 256))


def export_tiles(levels: DataFrame, grid: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Writes the tiles' images as Parquet under path and returns the manifest: tile_id, width, height, bytes, sha256."""
    encoded_tiles(read_grid(levels, grid)).write.mode(mode).parquet(path)
    return levels.sparkSession.read.parquet(path).select("tile_id", "width", "height", F.octet_length("content").alias("bytes"), "sha256")


def flag_artifacts(grid: DataFrame, pixels: DataFrame, action: str = "flag", **options) -> DataFrame:
    """Tiles with their artefact measures; a tile without pixels has none and is no artefact. `drop` leaves artefacts out."""
    met = grid.join(P.artifacts(pixels, **options), "tile_id", "left").withColumn("artifact", F.coalesce("artifact", F.lit(False)))
    return met.filter(~F.col("artifact")) if action == "drop" else met


def matrix(grid: DataFrame, value: str) -> DataFrame:
    """grid(row, col, value) from 1 as one row a tile row: row, values (null where no tile is). A value that lies nowhere makes no matrix. Of tiles at one place the greatest value counts.

    Rows are filled up with empty places and put in order once, so work follows the size of the matrix.
    """
    held = grid.filter("row >= 1 AND col >= 1").select("row", F.col("col").cast("int").alias("col"), F.col(value).alias("v"))
    width = held.agg(F.max("col").alias("width"))
    places = held.select("row").distinct().crossJoin(F.broadcast(width)).select("row", F.explode(F.sequence(F.lit(1), "width")).alias("col"))  # one row
    full = held.unionByName(places, allowMissingColumns=True).groupBy("row", "col").agg(F.max("v").alias("v"))
    return full.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "v"))), lambda s: s["v"]).alias("values"))


def focus_heatmap(grid: DataFrame, pixels: DataFrame, threshold: float = 0.001, tissue: DataFrame | None = None, least_tissue: float = 0.05) -> DataFrame:
    """H8: tiles with their focus measures; of tissue(tile_id, tissue_fraction) those with enough. matrix(…, 'laplacian_variance') is the heatmap, matrix(…, 'blurry') the mask."""
    held = grid if tissue is None else grid.join(tissue.filter(F.col("tissue_fraction") >= least_tissue).select("tile_id"), "tile_id", "left_semi")
    return held.join(P.focus(pixels, threshold), "tile_id", "left")


def candidate_heatmap(grid: DataFrame, pixels: DataFrame, kind: str, **limits) -> DataFrame:
    """Tiles with a kind's candidates: objects, n, fraction, candidate. matrix(…, 'fraction') is the heatmap."""
    found = candidates.detect(pixels, kind, **limits)
    return grid.withColumn("tile_id", F.col("tile_id").cast("string")).join(found, "tile_id", "left")


def tissue_regions(pixels: DataFrame, method: str = "simple", saturation: float = 0.05, brightness: float = 0.8, least_area: int = 1000, scale: float = 1.0, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """H1, H2: the tissue of thumbnails pixels(tile_id, row, col, r, g, b) as regions in level-0 pixels: components of at least least_area pixels. otsu: the saturation's own threshold a thumbnail."""
    mask = masks.tissue_mask(pixels, saturation, brightness)
    if method == "otsu":
        held = pixels.withColumn("s", P.saturation())
        limit = P.otsu(held, "s", ["tile_id"])
        mask = held.join(limit, "tile_id").filter("s >= threshold").select(F.col("tile_id").cast("string").alias("mask_id"), "row", "col", F.lit(1).alias("label"))
    return masks.mask_to_rois(mask, scale, origin, least_area)


def tiled(grid: DataFrame, pixels: DataFrame, tissue: DataFrame | None = None, least_tissue: float = 0.1, whitespace: bool = False, artifacts: bool = False) -> DataFrame:
    """A grid (tiles.tile_grid or tiles.grid_from_coords) after the wanted filters: enough of tissue(row, col, tissue, scale in its rows), no white space, no artefact. read_grid gives the pixels, export_tiles the images."""
    out = grid
    if tissue is not None:
        out = tiles.tissue_fraction(out, tissue, float(tissue.first()["scale"])).filter(F.col("tissue_fraction") >= least_tissue)
    if whitespace:
        out = P.flag_whitespace(out, pixels, "drop").select(*out.columns)
    return flag_artifacts(out, pixels, "drop").select(*out.columns) if artifacts else out


def geojson_viewport(rois: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Regions whose box meets the window, with their geometry and how many corners they have."""
    held = regions.with_bbox(regions.areal(rois))
    x0, y0, x1, y1 = box
    return held.filter((F.col("xmax") >= x0) & (F.col("xmin") <= x1) & (F.col("ymax") >= y0) & (F.col("ymin") <= y1)).withColumn("corners", F.size(G.points(F.col("geometry"))))
