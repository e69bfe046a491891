"""Sharding by fixed virtual slots.

Every record hashes into one of thousands of slots; the slot never changes. A stored map, one version
after another, says which shard holds which slot, and how many shards there are. The first version deals the slots out
by their bytes. A run with a map at its path keeps to the newest version while that is even enough; else it edits it
and stores the next: asked for more shards, slots move into the new ones alone; with as many as before, slots move from
the fullest to the emptiest shards until none has more than SLACK over its share. Where nothing would move no version
is made; a version that is there is never written over, so of two writers one fails. The main path is DataFrame
functions alone; what meets on the driver is one row a slot, whose number is a parameter.

The law is `bytes`: equal texts under different ids are records of their own and may lie in different shards, so
that a group of copies, which may be a third of all bytes, is spread evenly like any other rows.

Defined results: a null text has no bytes and the crc of the empty text. Rows that repeat id and text are
one record and share a slot. An empty table gives an empty result and a map in which the slots are dealt
out in turn. Columns beside id and text are never read.
"""

from __future__ import annotations

import bisect
import heapq
import json
import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import exists, text_or_empty, work_path, written

#: Bytes that a record takes beside its text.
OVERHEAD = 16
SLOTS = 8192
#: What a shard may hold over its share of bytes before a map of as many shards is edited.
SLACK = 0.1


def records(docs: DataFrame, n_slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, vslot of every record."""
    text = text_or_empty(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), text), F.lit(n_slots)).cast("int").alias("vslot"),
    )


def slot_bytes(parts: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot that has any; one row a slot comes to the driver."""
    found = parts.groupBy("vslot").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).collect()
    return {r["vslot"]: (r["b"], r["n"]) for r in found}


def first_map(stats: dict[int, tuple[int, int]], n_slots: int, shards: int) -> list[int]:
    """The shard of each slot: the largest slot first, each to the shard with the fewest bytes so far."""
    held, loads = [0] * n_slots, [(0, 0, s) for s in range(shards)]
    for slot in sorted(range(n_slots), key=lambda s: (-stats.get(s, (0, 0))[0], s)):
        load, count, shard = heapq.heappop(loads)
        held[slot] = shard
        heapq.heappush(loads, (load + stats.get(slot, (0, 0))[0], count + 1, shard))
    return held


def edited_map(held: list[int], stats: dict[int, tuple[int, int]], old: int, shards: int) -> list[int]:
    """The map for `shards` shards, more than the `old` ones: slots move only into the new shards, each time from the fullest old one, until the new ones hold their share. A slot weighs its bytes and one, so empty slots are dealt out too."""
    held, size = list(held), lambda s: stats.get(s, (0, 0))[0] + 1
    share = sum(map(size, range(len(held)))) / shards
    own: dict[int, list[int]] = {s: [] for s in range(old)}
    for slot, shard in enumerate(held):
        own[shard].append(slot)
    for slots in own.values():
        slots.sort(key=lambda s: (size(s), s))
    fullest = [(-sum(map(size, own[s])), s) for s in range(old)]
    for new in range(old, shards):
        heapq.heapify(fullest)
        load, count, passed = 0, 0, []
        # few slots with all the bytes would else leave the other new shards without any
        while load < share and count < 2 * len(held) / shards and fullest:
            minus, shard = heapq.heappop(fullest)
            # slots are in order of size: the largest that fits
            at = bisect.bisect_right(own[shard], share - load, key=size) - 1
            if at < 0 or len(own[shard]) == 1:
                passed.append((minus, shard))
                continue
            slot = own[shard].pop(at)
            held[slot] = new
            load, count = load + size(slot), count + 1
            heapq.heappush(fullest, (minus + size(slot), shard))
        fullest += passed
    return held


def rebalanced_map(held: list[int], stats: dict[int, tuple[int, int]], shards: int, slack: float = SLACK) -> list[int]:
    """The map with as many shards where none has more than `slack` over its share of bytes, if slots allow: each time the largest slot that narrows the gap moves from the fullest to the emptiest shard."""
    held, size = list(held), lambda s: stats.get(s, (0, 0))[0]
    own: dict[int, list[int]] = {s: [] for s in range(shards)}
    for slot, shard in enumerate(held):
        own[shard].append(slot)
    for slots in own.values():
        slots.sort(key=lambda s: (size(s), s))
    load = {s: sum(map(size, own[s])) for s in own}
    share = sum(load.values()) / shards
    while (full := max(load, key=lambda s: (load[s], -s))) is not None and load[full] > (1 + slack) * share:
        empty = min(load, key=lambda s: (load[s], s))
        # a slot of less than the gap makes the larger of the two loads smaller
        at = bisect.bisect_right(own[full], (load[full] - load[empty]) / 2, key=size) - 1
        if at < 0 or not size(own[full][at]):
            at = bisect.bisect_left(own[full], load[full] - load[empty], key=size) - 1
        if at < 0 or not size(own[full][at]):
            break
        slot = own[full].pop(at)
        bisect.insort(own[empty], slot, key=lambda s: (size(s), s))
        held[slot], load[full], load[empty] = empty, load[full] - size(slot), load[empty] + size(slot)
    return held


def map_rows(spark: SparkSession, held: Iterable[int], stats: dict[int, tuple[int, int]]) -> DataFrame:
    """vslot, shard, first (the place in its shard at which the slot's rows begin): a row a slot."""
    ends: dict[int, int] = {}
    rows = []
    for slot, shard in enumerate(held):
        rows.append([slot, shard, ends.get(shard, 0)])
        ends[shard] = ends.get(shard, 0) + stats.get(slot, (0, 0))[1]
    row = F.explode(F.from_json(F.lit(json.dumps(rows)), "array<array<bigint>>")).alias("r")
    return spark.range(1).select(row).select(F.col("r")[0].cast("int").alias("vslot"), F.col("r")[1].cast("int").alias("shard"), F.col("r")[2].alias("first"))


def store_map(spark: SparkSession, path: str, held: Iterable[int], version: int, shards: int) -> None:
    map_rows(spark, held, {}).drop("first").withColumn("shards", F.lit(shards)).coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int], int] | None:
    """The number of a version, the newest unless told, the shard of each slot and the number of shards; None where there is no map yet."""
    if not exists(spark, path):
        return None
    rows = spark.read.parquet(path)
    version = rows.agg(F.max("version")).first()[0] if version is None else version
    found = rows.filter(F.col("version") == version).select("vslot", "shard", "shards").orderBy("vslot").collect()
    return version, [r["shard"] for r in found], found[0]["shards"]


def current_map(spark: SparkSession, path: str, stats: dict[int, tuple[int, int]], n_slots: int, shards: int, slack: float = SLACK) -> tuple[int, list[int]]:
    """The map in force for so many shards: the newest, where it has them and is even enough, else the next version, stored now."""
    known = load_map(spark, path)
    if known is None:
        version, held = 1, first_map(stats, n_slots, shards)
    else:
        last, before, old = known
        if len(before) != n_slots:
            raise ValueError(f"the map at {path} has {len(before)} slots")
        if old > shards:
            raise ValueError(f"the map at {path} has more shards")
        held = rebalanced_map(before, stats, shards, slack) if old == shards else edited_map(before, stats, old, shards)
        if old == shards and held == before:
            return last, before
        version = last + 1
    store_map(spark, path, held, version, shards)
    return version, held


def sharded(docs: DataFrame, shards: int = 40, n_slots: int = SLOTS, map_path: str | None = None, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version.

    `slot` is the row's place within its shard, without gaps from 0: where its virtual slot begins, plus its rank
    there. A slot's rows are ranked in parts by a further hash, about as many parts as a part has rows, so no task
    ranks a whole slot.
    """
    spark = docs.sparkSession
    rows = written(records(docs, n_slots, id_col, text_col), "records")
    fullest = rows.groupBy("vslot").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("text_crc32", "size", "id"), F.lit(max(1, math.isqrt(fullest)))))
    parts = rows.groupBy("vslot", "part").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    stats = slot_bytes(parts)
    version, held = current_map(spark, map_path or work_path(spark, "slot-map"), stats, n_slots, shards, slack)
    before = F.sum("n").over(Window.partitionBy("vslot").orderBy("part")) - F.col("n")
    starts = parts.withColumn("before", before).join(F.broadcast(map_rows(spark, held, stats)), "vslot")  # a row a slot
    place = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("id", "text_crc32", "size"))
    return (
        rows.withColumn("rank", place)
        .join(starts.select("vslot", "part", "shard", (F.col("first") + F.col("before")).alias("start")), ["vslot", "part"])
        .select(
            F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(version).alias("map_version"),
        )
    )
