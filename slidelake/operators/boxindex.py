"""A stored index of boxes: Parquet in Hilbert order, large boxes apart by level.

A box lies at the level of a quadtree whose cells are just as wide as it, and within the level at the place of its
middle on a Hilbert curve. Neighbours share row groups whose statistics are narrow, since no large box widens those of
small ones. A window is then a plain filter on four columns that the Parquet reader prunes by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 16
DEEPEST = 24
SIDES = ("xmin", "ymin", "xmax", "ymax")


def hilbert(x: Column, y: Column) -> Column:
    """The place of a cell (x, y), whole numbers below 2^16, on the Hilbert curve through all of them."""
    top = F.lit((1 << BITS) - 1).cast("long")

    def turn(at: Column, s: Column) -> Column:
        right, up = at["x"].bitwiseAND(s) > 0, at["y"].bitwiseAND(s) > 0
        quarter = F.when(right & up, 2).when(right, 3).when(up, 1).otherwise(0)
        flip = lambda v: F.when(right, top - at[v]).otherwise(at[v])
        return F.struct(F.when(up, at["x"]).otherwise(flip("y")).alias("x"), F.when(up, at["y"]).otherwise(flip("x")).alias("y"), (at["d"] + s * s * quarter).alias("d"))

    begin = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.array(*[F.lit(1 << k).cast("long") for k in reversed(range(BITS))]), begin, turn, lambda at: at["d"])


def write_index(boxes: DataFrame, path: str, mode: str = "error", group_bytes: int = 8 << 20, files: int | None = None) -> None:
    """boxes(xmin, ymin, xmax, ymax and any other columns) as an index under path, in `files` ranges of the order (default: as Spark's shuffles have).

    Only the extent of all boxes, one row, reaches the driver. Boxes without four finite sides or with xmin > xmax or
    ymin > ymax are an error, and so is an empty table. The columns level and place are added and may not be there before.
    """
    for name in ("level", "place"):
        if name in boxes.columns:
            raise ValueError(f"there is a column {name} already")
    fine = F.lit(True)
    for c in SIDES:
        fine = fine & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    fine = fine & (F.col("xmin") <= F.col("xmax")) & (F.col("ymin") <= F.col("ymax"))
    held = boxes.withColumns({c: F.col(c).cast("double") for c in SIDES})
    held = held.filter(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit("a box has four finite sides, the smaller first")).cast("boolean")))
    ends = held.agg(F.min("xmin").alias("x"), F.min("ymin").alias("y"), F.greatest(F.max("xmax") - F.min("xmin"), F.max("ymax") - F.min("ymin")).alias("extent")).first()
    if ends["x"] is None:
        raise ValueError("no boxes")
    extent = float(ends["extent"] or 1.0)
    wide = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    level = F.least(F.lit(DEEPEST), F.floor(F.log2(F.lit(extent) / F.greatest(wide, F.lit(extent / 2**DEEPEST))))).cast("int")
    at = lambda a, b, low: F.least(F.lit((1 << BITS) - 1), F.floor(((F.col(a) + F.col(b)) / 2 - F.lit(float(low))) / F.lit(extent) * (1 << BITS)))
    placed = held.withColumn("level", level).withColumn("place", hilbert(at("xmin", "xmax", ends["x"]), at("ymin", "ymax", ends["y"])))
    ranged = placed.repartitionByRange(files, "level", "place") if files else placed.repartitionByRange("level", "place")
    ranged.sortWithinPartitions("level", "place").write.mode(mode).option("parquet.block.size", group_bytes).partitionBy("level").parquet(path)


def window(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """The boxes of an index that touch (xmin, ymin, xmax, ymax), sides included, with their columns. Row groups that cannot are not read."""
    x0, y0, x1, y1 = map(float, box)
    held = spark.read.parquet(path).filter((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))
    return held.drop("level", "place")
