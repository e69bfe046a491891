"""Document fingerprints of improbable features.

A feature is a window of 64 bytes. Its entropy falls into one of 1001 bins, and the fewer windows of the corpus share
the bin, the rarer the feature. Of every 64 neighbouring windows the rarest gets a vote, and features with 16 votes or
more are selected. Each sets 5 bits in a Bloom filter of 2048; after 160 features a new filter begins. Two
fingerprints are as alike as the filters of the shorter chain find bits in their best partners, above what chance gives.

Entropies are exact: for each byte the equal ones among its 63 neighbours on either side are counted, and the sum of
c log c of a window follows from its neighbour's in whole numbers.

Defined results: null texts count as empty; an empty text has the empty fingerprint, two of them have likeness 1, one
and another 0. A text of fewer than 64 bytes is one feature. A text in which no window gathers the votes gives its
first rarest window. Rows with a null id have no place in the order: their edited columns and near_next are null. The
id names a row; of rows that repeat one, the order among them is that of their texts. Other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bagminhash import M3, mix
from .common import text_or_empty

WINDOW = 64
VOTES = 16
BINS = 1001
#: Windows whose entropy lies below this bin say too little and are chosen only where nothing else is.
LEAST_BIN = 150
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
#: Bytes that are worked on at once.
STEP = 1 << 18
#: Overlap that counts as chance, as a part of the way from the expected to the greatest.
CHANCE = 0.3

_counts = np.arange(WINDOW + 1)
_clogc = np.rint((_counts * np.log2(np.maximum(_counts, 1))) * (1 << 16)).astype(np.int64)
#: What one more equal byte adds to the sum of c log c.
ADDED = np.diff(_clogc)
TOP = int(_clogc[WINDOW])


def bins(x: np.ndarray) -> np.ndarray:
    """The entropy bin of every window of 64 bytes in x."""
    n = len(x) - WINDOW + 1
    after, before = np.zeros(len(x), dtype=np.uint8), np.zeros(len(x), dtype=np.uint8)
    for d in range(1, WINDOW):
        same = (x[d:] == x[:-d]).view(np.uint8)
        after[:-d] += same
        before[d:] += same
    first = _clogc[np.bincount(x[:WINDOW], minlength=256)].sum()
    change = ADDED[before[WINDOW:]] - ADDED[after[: n - 1]]
    sums = np.concatenate(([first], first + np.cumsum(change)))
    return (BINS - 1) - (sums * (BINS - 1)) // TOP


def streams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, int, list[int], np.ndarray]]:
    """Bytes to work on: the bytes, for each its distance to its text's end, how many windows begin here, the texts' places and where they begin. Texts of fewer than 64 bytes are left out; a long text comes in parts that overlap."""
    lot: list[int] = []
    size = 0

    def joined() -> tuple:
        lens = np.array([len(texts[i]) for i in lot])
        starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
        x = np.frombuffer(b"".join([texts[i] for i in lot]), dtype=np.uint8)
        return x, np.repeat(starts + lens, lens) - np.arange(len(x)), len(x), list(lot), starts

    for i, text in enumerate(texts):
        if len(text) < WINDOW:
            continue
        if len(text) > STEP:
            for at in range(0, len(text) - WINDOW + 1, STEP):
                x = np.frombuffer(text, dtype=np.uint8, count=min(STEP + 2 * WINDOW, len(text) - at), offset=at)
                yield x, len(text) - at - np.arange(len(x)), STEP, [i], np.array([-at])
            continue
        if size + len(text) > STEP and lot:
            yield joined()
            lot, size = [], 0
        lot.append(i)
        size += len(text)
    if lot:
        yield joined()


def bin_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows fall into each bin."""
    n = np.zeros(BINS, dtype=np.int64)
    for x, to_end, own, _, _ in streams(texts):
        q = bins(x)[:own]
        n += np.bincount(q[to_end[: len(q)] >= WINDOW], minlength=BINS)
    return n


def rarity(counts: np.ndarray) -> np.ndarray:
    """The rank of each bin, rarest first; bins of little entropy come after all others."""
    rank = np.empty(BINS, dtype=np.int64)
    rank[np.lexsort((np.arange(BINS), counts, np.arange(BINS) < LEAST_BIN))] = np.arange(BINS)
    return rank


def selected(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The first bytes' places of the selected windows of each text."""
    votes: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    best: list[list[tuple[int, int]]] = [[] for _ in texts]
    far = np.int64(1) << np.int64(62)
    for x, to_end, own, lot, starts in streams(texts):
        q = bins(x)
        whole = to_end[: len(q)] >= WINDOW
        key = np.where(whole, (rank[q] << 32) | np.arange(len(q)), far)
        low, width = key, 1
        while width < WINDOW and len(low) > width:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        n = min(len(low), own)
        full = to_end[:n] >= 2 * WINDOW - 1 if width == WINDOW else np.zeros(n, dtype=bool)
        chosen, count = np.unique(low[:n][full] & 0xFFFFFFFF, return_counts=True)
        edges = np.searchsorted(chosen, starts) if len(lot) > 1 else np.array([0])
        ends = np.append(edges[1:], len(chosen))
        least = np.minimum.reduceat(key, np.maximum(starts, 0)) if len(lot) > 1 else np.array([key.min()])
        for j, i in enumerate(lot):
            votes[i].append((chosen[edges[j] : ends[j]] - starts[j], count[edges[j] : ends[j]]))
            best[i].append((int(least[j] >> 32), int(least[j] & 0xFFFFFFFF) - int(starts[j])))
    out = []
    for i, text in enumerate(texts):
        if len(text) < WINDOW:
            out.append(np.zeros(min(1, len(text)), dtype=np.int64))
            continue
        at, n = votes[i][0] if len(votes[i]) == 1 else (np.concatenate(v) for v in zip(*votes[i], strict=True))
        if len(votes[i]) > 1:
            at, where = np.unique(at, return_inverse=True)
            n = np.bincount(where, weights=n)
        found = at[n >= VOTES]
        out.append(found if len(found) else np.array([min(best[i])[1]]))
    return out


def chains(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The filters of each text, as rows of bits. A text shorter than a window is filled up with zeros."""
    at = selected(texts, rank)
    n = np.array([len(x) for x in at], dtype=np.int64)
    if not n.sum():
        return [np.zeros((0, FILTER_BITS), dtype=bool) for _ in texts]
    padded = [t.ljust(WINDOW, b"\0") for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(t) for t in padded])[:-1]))
    x = np.frombuffer(b"".join(padded), dtype=np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[np.concatenate(at) + np.repeat(starts, n)].view("<u8")
    h = np.repeat(np.array([min(len(t), WINDOW) for t in texts], dtype=np.uint64), n)
    for k in range(words.shape[1]):
        h = mix((h ^ words[:, k]) * M3)
    filters = -(-n // FILTER_FEATURES)
    first = np.concatenate(([0], np.cumsum(filters)))
    order = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row = np.repeat(first[:-1], n) + order // FILTER_FEATURES
    held = np.zeros((int(first[-1]), FILTER_BITS), dtype=bool)
    for k in range(HASHES):
        held[row, ((h >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    return [held[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1: the mean over the filters of the shorter chain of their best partner's normalised overlap of bits, weighted by their bits."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) == 1:
        na, nb, both = (int(np.count_nonzero(x)) for x in (a, b, a & b))
        most, least = min(na, nb), na * nb / FILTER_BITS
        cut = least + CHANCE * (most - least)
        return min(1.0, max(0.0, (both - cut) / max(most - cut, 1e-9)))
    if len(a) > len(b) or len(a) == len(b) and a.sum() > b.sum():
        a, b = b, a
    na, nb = a.sum(axis=1).astype(np.float64), b.sum(axis=1).astype(np.float64)
    total, right = 0.0, b.T.astype(np.float32)
    for at in range(0, len(a), 128):
        both = a[at : at + 128].astype(np.float32) @ right
        most = np.minimum(na[at : at + 128, None], nb)
        least = na[at : at + 128, None] * nb / FILTER_BITS
        cut = least + CHANCE * (most - least)
        score = np.clip((both - cut) / np.maximum(most - cut, 1e-9), 0, 1)
        total += float((score.max(axis=1) * na[at : at + 128]).sum())
    return min(1.0, total / float(na.sum()))


def written_out(held: np.ndarray) -> str:
    return "|".join(base64.b64encode(row.tobytes()).decode() for row in np.packbits(held, axis=1))


def read_back(fingerprint: str) -> np.ndarray:
    if not fingerprint:
        return np.zeros((0, FILTER_BITS), dtype=bool)
    return np.array([np.unpackbits(np.frombuffer(base64.b64decode(x), dtype=np.uint8)) for x in fingerprint.split("|")], dtype=bool)


def corpus_rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Ranks of the entropy bins over all texts; at most 1001 sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                total += bin_counts([t.encode("utf-8", "surrogatepass") for t in batch.column(0).slice(at, 500).to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS, dtype=np.int32)), pa.array(total)], names=["bin", "n"])

    rows = docs.select(text_or_empty(F.col(text_col)).alias("text")).mapInArrow(run, "bin int, n long")
    counts = np.zeros(BINS, dtype=np.int64)
    for r in rows.groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r["bin"]] = r["n"]
    return rarity(counts)


def fingerprints(docs: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint of every row, in place."""
    held = docs.sparkSession.sparkContext.broadcast(rank)
    rows = docs.select(F.col(id_col), text_or_empty(F.col(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                lot = batch.slice(at, 500)
                found = chains([t.encode("utf-8", "surrogatepass") for t in lot.column(1).to_pylist()], held.value)
                yield pa.RecordBatch.from_arrays([lot.column(0), pa.array(map(written_out, found), type=pa.string())], names=[id_col, "fingerprint"])

    return rows.mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, fingerprint string")


def neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows in lots of falling id, each lot closed by the first row of the next (`guest`), the last by the very first.

    Lots are ranges of the id between approximate quantiles, four to a shuffle partition; the one full shuffle of
    texts deals them out, and each task finds a row's neighbour as the row after it.
    """
    spark = docs.sparkSession
    partitions = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    shares = [k / (4 * partitions) for k in range(1, 4 * partitions)]
    cuts = rows.agg(F.percentile_approx("id", F.array(*[F.lit(x) for x in shares]), F.lit(100_000))).first()[0] or []
    splits = [-float("inf"), *sorted({float(c) for c in cuts} or {0.0}), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="place", outputCol="bucket", handleInvalid="keep")
    lot = F.when(F.col("id").isNull(), F.lit(len(splits))).otherwise(F.lit(len(splits)) - 1 - F.col("bucket")).cast("int")
    rows = ranged.transform(rows.withColumn("place", F.col("id").cast("double"))).withColumn("lot", lot).drop("place", "bucket")
    heads = sorted((r["lot"], r["id"]) for r in rows.filter("id IS NOT NULL").groupBy("lot").agg(F.max("id").alias("id")).collect())
    visits = spark.range(0).select(F.col("id").alias("head"), F.lit(0).alias("visit"))
    if heads:
        pairs = ", ".join(f"({id_}, {heads[k - 1][0]})" for k, (_, id_) in enumerate(heads))
        visits = spark.sql(f"SELECT CAST(head AS BIGINT) head, CAST(visit AS INT) visit FROM VALUES {pairs} AS t(head, visit)")
    met = rows.join(F.broadcast(visits), F.col("id") == F.col("head"), "left")
    stays = F.struct(F.col("lot"), F.lit(False).alias("guest"))
    goes = F.struct(F.col("visit").alias("lot"), F.lit(True).alias("guest"))
    copies = F.when(F.col("visit").isNull(), F.array(stays)).otherwise(F.array(stays, goes))
    out = met.select("id", "text", F.explode(copies).alias("at")).select("at.lot", "at.guest", "id", "text")
    return out.repartition(partitions, "lot").sortWithinPartitions("lot", "guest", F.col("id").desc_nulls_last(), "text")


def edited(text: str, following: str) -> str:
    """The last third of the characters replaced by the first as many of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    held = docs.sparkSession.sparkContext.broadcast(corpus_rarity(docs, text_col))
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def results(rows: list[tuple]) -> pa.RecordBatch:
        """Of all rows but those that only close a lot; each row's neighbour is the next of the list."""
        raw = [r[3].encode("utf-8", "surrogatepass") for r in rows]
        own = chains(raw, held.value)
        pairs = [(i, i + 1) for i, r in enumerate(rows[:-1]) if not r[1] and r[2] is not None and rows[i + 1][0] == r[0]]
        new = [edited(rows[i][3], rows[j][3]).encode("utf-8", "surrogatepass") for i, j in pairs]
        after = {i: (j, n, c) for (i, j), n, c in zip(pairs, new, chains(new, held.value), strict=True)}
        out: list[tuple] = []
        for i, (_, guest, id_, text) in enumerate(rows):
            if guest:
                continue
            j, n, c = after.get(i, (None, None, None))
            edit = (hashlib.sha256(n).hexdigest(), written_out(own[i]), written_out(c), likeness(own[i], c), likeness(own[i], own[j])) if j is not None else (None, written_out(own[i]), None, None, None)
            out.append((id_, len(text), *edit))
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], type=kinds[k]) for k in range(len(names))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                lot = batch.slice(at, 250)
                kept += zip(*(lot.column(c).to_pylist() for c in ("lot", "guest", "id", "text")), strict=True)
                if len(kept) > 1:
                    yield results([*kept[:-1], (kept[-1][0], True, *kept[-1][2:])])
                    kept = kept[-1:]
        if kept and not kept[0][1]:
            yield results(kept)

    rows = neighbours(docs, id_col, text_col)
    return rows.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)
