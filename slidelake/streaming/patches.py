"""Revisioned patches over a keyed table as a stream (K11-K18, N68): upserts and removals, replayed at will.

A patch has client, revision, op (upsert or remove), key and payload. A client's revisions count up; a revision seen
before changes nothing; a gap asks for a new snapshot. Nothing here is about event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "client string, revision long, op string, key string, payload string"


def latest(patches: DataFrame) -> DataFrame:
    """The state after all patches, whatever their order and however often they come: the last patch of each key wins, removed keys go."""
    top = patches.groupBy("key").agg(F.max(F.struct("revision", "client", "op", "payload")).alias("top"))
    return top.filter("top.op <> 'remove'").select("key", F.col("top.payload").alias("payload"), F.col("top.revision").alias("revision"))


def gaps(patches: DataFrame) -> DataFrame:
    """Clients whose revisions from 1 to their highest are not all there: they need a snapshot."""
    by = patches.groupBy("client").agg(F.max("revision").alias("high"), F.count_distinct("revision").alias("seen"))
    return by.filter("seen < high")


def run(stream: DataFrame, table: str, checkpoint: str):
    """Keeps the state at `table` (Parquet, one folder a batch) up to date; a batch that is replayed writes its own folder again."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marked = batch.select("client", "revision", "op", "key", "payload")
        if number > 0:
            marked = marked.unionByName(spark.read.schema(SCHEMA).parquet(f"{table}/batch={number - 1}"))
        top = marked.groupBy("key").agg(F.max(F.struct("revision", "client", "op", "payload")).alias("top"))
        top.select("top.client", "top.revision", "top.op", "key", "top.payload").write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark, table: str, number: int) -> DataFrame:
    """The table after a batch."""
    return spark.read.schema(SCHEMA).parquet(f"{table}/batch={number}").filter("op <> 'remove'").select("key", "payload", "revision")
