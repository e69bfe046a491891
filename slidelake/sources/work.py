"""Intermediate tables in the folder that all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. A local session that names none, as in tests, gets a temporary one; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="slidelake-"))
            held = context._jsc.sc().getCheckpointDir()
        base = held.get()
    return f"{base.rstrip('/')}/slidelake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df written as Parquet and read again, so that later rounds do not compute them anew."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def deleted(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more, such as the rounds of a loop that has ended."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._work_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
