"""A stored box index: its order, its windows against brute force, and how little a window reads."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from slidelake.operators import boxindex

KIND = "id long, xmin double, ymin double, xmax double, ymax double"


def boxes(seed, n):
    r = np.random.default_rng(seed)
    at, size = r.uniform(0, 10_000, (n, 2)), 2.0 ** r.uniform(0, 5, (n, 2))
    size[: n // 100] *= 300
    return [(i, float(x), float(y), float(x + w), float(y + h)) for i, ((x, y), (w, h)) in enumerate(zip(at, size, strict=True))]


def test_curve_visits_every_cell_in_steps(spark):
    side = 16
    low = spark.range(side * side).select((F.col("id") % side).alias("x"), F.floor(F.col("id") / side).alias("y"))
    order = [(r["x"], r["y"]) for r in low.withColumn("d", boxindex.hilbert(F.col("x"), F.col("y"))).orderBy("d").collect()]
    assert len(set(order)) == side * side and all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(order, order[1:]))
    top = spark.range(1).select(boxindex.hilbert(F.lit(65535), F.lit(0)).alias("d")).first()["d"]
    assert top == 2**32 - 1


def test_windows_equal_brute_force_and_read_little(spark, tmp_path):
    rows = boxes(1, 20_000)
    path = str(tmp_path / "index")
    boxindex.write_index(spark.createDataFrame(rows, KIND), path, group_bytes=1 << 14, files=8)
    for w in [(4000.0, 4000.0, 4300.0, 4200.0), (-5.0, -5.0, 1e6, 1e6), (-10.0, -10.0, -5.0, -5.0), (rows[7][3], rows[7][4], rows[7][3], rows[7][4])]:
        got = boxindex.window(spark, path, w)
        assert sorted(r["id"] for r in got.collect()) == [i for i, x0, y0, x1, y1 in rows if x0 <= w[2] and x1 >= w[0] and y0 <= w[3] and y1 >= w[1]]
        assert got.columns == ["id", "xmin", "ymin", "xmax", "ymax"]
    w, read, total = (4000.0, 4000.0, 4300.0, 4200.0), 0, 0
    for f in (tmp_path / "index").rglob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            s = {c: meta.row_group(g).column(at[c]).statistics for c in boxindex.SIDES}
            n = meta.row_group(g).num_rows
            total += n
            read += n if s["xmin"].min <= w[2] and s["xmax"].max >= w[0] and s["ymin"].min <= w[3] and s["ymax"].max >= w[1] else 0
    assert total == 20_000 and read < total / 5
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = boxindex.window(spark, path, w)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThanOrEqual(xmin,4300.0)" in plan and "GreaterThanOrEqual(xmax,4000.0)" in plan


def test_points_one_box_none_and_broken_ones(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, KIND)
    boxindex.write_index(frame([(1, 2.0, 3.0, 2.0, 3.0), (1, 2.0, 3.0, 2.0, 3.0)]), str(tmp_path / "a"))
    assert boxindex.window(spark, str(tmp_path / "a"), (2, 3, 2, 3)).count() == 2
    for broken in [(1, None, 0.0, 1.0, 1.0), (1, 2.0, 0.0, 1.0, 1.0), (1, 0.0, 0.0, float("inf"), 1.0)]:
        with pytest.raises(Exception, match="four finite sides"):
            boxindex.write_index(frame([broken]), str(tmp_path / "b"), mode="overwrite")
    with pytest.raises(ValueError, match="no boxes"):
        boxindex.write_index(frame([]), str(tmp_path / "c"))
    with pytest.raises(ValueError, match="level"):
        boxindex.write_index(frame([]).withColumn("level", F.lit(1)), str(tmp_path / "c"))
