"""What the corpus operators share: the working folder, the white-space class, content hashes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: One word: a longest run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
TOKENIZERS = "/opt/tokenizers"
#: Bytes of the Arrow batches in which texts go to Python workers: a task holds a batch several times, in the JVM and in Python.
BATCH_BYTES = 4 << 20


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    A local session that names none, as in tests, gets a temporary folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="slidelake-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    return f"{base.rstrip('/')}/slidelake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df written as Parquet in the shared folder and read again: lineage ends here."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def small_batches(df: DataFrame) -> DataFrame:
    """df, with batches for Python of BATCH_BYTES or a row at most from now on in its session; a smaller limit of the session stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return df


def exists(spark: SparkSession, path: str, delete: bool = False) -> bool:
    """Whether the path is there, in any store that Spark knows; it may be removed at once."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return store.delete(at, True) if delete else store.exists(at)


def deleted(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for df in tables:
        exists(df.sparkSession, df._work_path, delete=True)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    """Words of [^\\x20\\x09-\\x0D]+ in the text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
