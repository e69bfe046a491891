"""Near-duplicate detection by weighted MinHash: BagMinHash signatures, banding, verified multiset overlap.

A document is the bag of its five-word shingles. Each shingle has a Poisson process of points in time for every
dyadic interval of weight (0-1, 1-2, 2-4, ...); a point has a register and a weight mark and counts for documents
whose weight reaches the mark. A register holds the earliest point. Two registers agree with the probability of
the weighted Jaccard similarity. Points are drawn in order of time up to a horizon at which the registers are
full, so the work is one draw a shingle and a fixed number of draws a document.

Documents that share a band of registers are candidates. In each bucket all members are compared with two leaders;
connected components follow; in buckets that still hold several components, members are compared across components,
in blocks. So no candidate pair of different components goes uncompared, and members that a leader already joins
cause no work. Copies meet before all this, as one node.

Defined results: texts with one to four words have one shingle of all words. Null texts and texts without a word
have no shingle and are classes of their own. A row with a null id has a null class and takes no part. Rows that
repeat an id are one document: what links one links the other. An empty table gives an empty result. Columns beside
id and text are never read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, small_batches, written

SHINGLE = 5
SIMILARITY = 0.8
#: 28 bands of 6 registers miss a pair at the threshold with a probability of 0.0002, and ever fewer above.
BANDS, ROWS = 28, 6
#: Bytes of text that are worked on at once.
CHUNK = 1 << 18
#: Members and askers of a bucket that meet in one block, about.
MEMBERS, ASKERS = 1024, 256
#: Bits of the map of wanted nodes: 2^20 rows of 64 bits at most, whatever the input.
MAP_BITS = 1 << 26

M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x5851F42D4C957F2D)
IS_SPACE = np.isin(np.arange(256), [ord(c) for c in SPACES])


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the i, and its inverse, modulo 2^64, for i up to n."""
    if not hasattr(powers, "held") or len(powers.held[0]) < n:
        both = []
        for b in (int(BASE), pow(int(BASE), -1, 1 << 64)):
            x = np.full(max(n, CHUNK), b, dtype=np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        powers.held = tuple(both)
    return powers.held[0][:n], powers.held[1][:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the first byte's place of every word, by sums of bytes times powers."""
    raw = np.frombuffer(data, dtype=np.uint8)
    word = np.concatenate(([False], ~IS_SPACE[raw], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def document_words(texts: list[str | None]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Lots of documents: their places, and their words' hashes. A longer text is hashed in parts cut at spaces."""
    at: list[int] = []
    lot: list[bytes] = []
    size = 0

    def hashed() -> list[np.ndarray]:
        h, starts = word_hashes(b" ".join(lot))
        cuts = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in lot])[:-1])
        return np.split(h, cuts)

    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if len(data) > CHUNK:
            parts, rest = [], memoryview(data)
            while len(rest) > CHUNK:
                spaces = np.flatnonzero(IS_SPACE[np.frombuffer(rest[:CHUNK], dtype=np.uint8)])
                cut = int(spaces[-1]) if len(spaces) and spaces[-1] else CHUNK
                parts.append(word_hashes(bytes(rest[:cut]))[0])
                rest = rest[cut:]
            yield [i], [np.concatenate([*parts, word_hashes(bytes(rest))[0]])]
            continue
        at.append(i)
        lot.append(data)
        size += len(data)
        if size >= CHUNK:
            yield at, hashed()
            at, lot, size = [], [], 0
    if lot:
        yield at, hashed()


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """A hash of every run of k words, or of all words if there are fewer; sorted."""
    k = min(k, len(words))
    if not k:
        return words
    h = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for j in range(k):
        h = h * M3 + words[j : len(words) - k + 1 + j]
    h = mix(h)
    h.sort()
    return h


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    if not len(a) or not len(b):
        return 0.0
    ka, na = np.unique(a, return_counts=True)
    kb, nb = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    both = int(np.minimum(na, nb[at])[kb[at] == ka].sum())
    return both / (len(a) + len(b) - both)


def uniform(x: np.ndarray) -> np.ndarray:
    """From a hash to (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def bag_minhash(keys: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m registers of the bags given as distinct keys with whole weights, sorted by owner: the earliest point's hash, or 0 for an empty bag."""
    held = np.zeros((n, m), dtype=np.uint64)
    total = np.bincount(owner, weights=weights, minlength=n)
    # one process for every element and dyadic interval that its weight reaches
    level = np.zeros(len(keys), dtype=np.int64)
    deeper = [(keys, weights, owner, level)]
    while True:
        k, w, o, lv = deeper[-1]
        more = w > (1 << lv) if len(lv) else np.zeros(0, dtype=bool)
        if not more.any():
            break
        deeper.append((k[more], w[more], o[more], lv[more] + 1))
    keys, weights, owner, level = (np.concatenate(x) for x in zip(*deeper, strict=True))
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0)).astype(np.float64)
    span = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0)).astype(np.float64)
    seed = mix(keys + (level.astype(np.uint64) + np.uint64(1)) * M3)
    reach = np.log(m) + 8.0
    todo = np.flatnonzero(total > 0)
    while len(todo):
        horizon = np.zeros(n)
        horizon[todo] = reach / total[todo]
        first = np.full(n * m, np.inf)
        at, t, i = np.flatnonzero(horizon[owner] > 0), None, 0
        t = np.zeros(len(at))
        while len(at):
            block = 1 if len(at) > 4096 else 64
            step = np.arange(i, i + block, dtype=np.uint64) * np.uint64(3)
            gap = -np.log(uniform(mix(seed[at][:, None] + (step + np.uint64(1)) * M3))) / (m * span[at][:, None])
            gap[:, 0] += t
            times = np.cumsum(gap, axis=1)
            row, col = np.nonzero(times <= horizon[owner[at]][:, None])
            source, when = at[row], times[row, col]
            point = mix(seed[source] + (step[col] + np.uint64(2)) * M3)
            wide = span[source] > 1
            if wide.any():
                mark = low[source] + span[source] * uniform(mix(seed[source] + (step[col] + np.uint64(3)) * M3))
                inside = ~wide | (mark <= weights[source])
                source, when, point = source[inside], when[inside], point[inside]
            slot = owner[source] * m + (point % np.uint64(m)).astype(np.int64)
            np.minimum.at(first, slot, when)
            wins = when == first[slot]
            held.reshape(-1)[slot[wins]] = point[wins]
            alive = times[:, -1] <= horizon[owner[at]]
            at, t, i = at[alive], times[alive, -1], i + block
        todo = todo[np.isinf(first.reshape(n, m)[todo]).any(axis=1)]
        held[todo] = 0
        reach *= 2
    return held


def signatures(texts: list[str | None], bands: int = BANDS, rows: int = ROWS) -> tuple[list[bytes | None], list[list[int]], list[int]]:
    """For each text: a 128-bit hash of its words, its buckets (a hash of each band), empty without words, and the number of its shingles."""
    copies: list[bytes | None] = [None] * len(texts)
    sizes = [0] * len(texts)
    buckets: list[list[int]] = [[] for _ in texts]
    band = np.arange(1, bands + 1, dtype=np.uint64) * M2
    for at, lot in document_words(texts):
        keys, weights, owner = [], [], []
        for j, words in enumerate(lot):
            if len(words):
                copies[at[j]] = hashlib.md5(words.tobytes()).digest()
                k, c = np.unique(shingles(words), return_counts=True)
                keys.append(k)
                weights.append(c)
                owner.append(np.full(len(k), j))
        if not keys:
            continue
        held = bag_minhash(np.concatenate(keys), np.concatenate(weights), np.concatenate(owner), len(lot), bands * rows).reshape(len(lot), bands, rows)
        h = np.broadcast_to(band, (len(lot), bands)).copy()
        for r in range(rows):
            h = mix(h * M3 + held[:, :, r])
        h = h.view(np.int64)
        for j, words in enumerate(lot):
            if len(words):
                buckets[at[j]] = h[j].tolist()
                sizes[at[j]] = max(1, len(words) - SHINGLE + 1)
    return copies, buckets, sizes


def signed(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            copies, buckets, sizes = signatures(pdf["text"].tolist(), bands, rows)
            yield pd.DataFrame({"id": pdf["id"], "copy": copies, "buckets": buckets, "size": sizes})

    rows_in = small_batches(docs).filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows_in.mapInPandas(run, "id long, copy binary, buckets array<long>, size long")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts' shingle bags overlap enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bags: dict[str, np.ndarray] = {}
            names = list(dict.fromkeys([*pdf["text_a"], *pdf["text_b"]]))
            for at, lot in document_words(names):
                bags |= {names[i]: shingles(w) for i, w in zip(at, lot, strict=True)}
            like = [overlap(bags[a], bags[b]) >= similarity for a, b in zip(pdf["text_a"], pdf["text_b"], strict=True)]
            yield pdf.loc[like, ["a", "b"]]

    of = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label for the nodes of links (a, b): label is the smallest node of its component.

    Each round takes the smallest label among neighbours, then the label's own label; every round is written,
    so a lost executor costs one round at most.
    """
    edges = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        own = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        above = own.select(F.col("node").alias("at"), F.col("label").alias("up"))
        after = own.join(above, F.col("label") == F.col("at")).select("node", F.least("label", "up").alias("label"), (F.least("label", "up") != F.col("old")).alias("changed"))
        after = written(after, "labels")
        labels = after.select("node", "label")
        if after.filter("changed").isEmpty():
            return labels


def expanded(h: np.ndarray) -> np.ndarray:
    """The sorted multiset as a sorted set: the k-th of equal shingles gets a hash of its own."""
    new = np.concatenate(([True], h[1:] != h[:-1]))
    first = np.flatnonzero(new)
    turn = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return np.sort(mix(h + turn.astype(np.uint64) * M3))


def block_links(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Of one block: links from each query to members of other labels, the smallest node of each label.

    All members' shingles lie in one sorted array; a query looks its own up and counts by member.
    """
    sets: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)] * len(pdf)
    for at, lot in document_words(pdf["text"].tolist()):
        for i, w in zip(at, lot, strict=True):
            sets[i] = expanded(shingles(w)) if len(w) else w
    node, label, asks = pdf["node"].to_numpy(), pdf["label"].to_numpy(), pdf["asks"].to_numpy(dtype=bool)
    members = np.flatnonzero(~asks)
    size = np.array([len(sets[i]) for i in members])
    keys = np.concatenate([sets[i] for i in members] or [np.zeros(0, dtype=np.uint64)])
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], np.repeat(np.arange(len(members)), size)[order]
    out = []
    for q in np.flatnonzero(asks):
        low, high = np.searchsorted(keys, sets[q], "left"), np.searchsorted(keys, sets[q], "right")
        n = high - low
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        both = np.bincount(owner[at], minlength=len(members))
        near = members[(both >= similarity * (len(sets[q]) + size - both)) & (label[members] != label[q])]
        best: dict[int, int] = {}
        for i in near:
            best[label[i]] = min(best.get(label[i], node[i]), node[i])
        out += [(min(node[q], x), max(node[q], x)) for x in best.values()]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows (node, text) of docs whose node is among the nodes.

    A bit map over hashes of the nodes, of a fixed size and so broadcast, drops most other rows before texts move;
    the join on the node itself drops the rest. A map that fills up on a very large input lets more rows through.
    """
    at = F.pmod(F.xxhash64("node"), F.lit(MAP_BITS))
    word, bit = F.shiftright(at, 6), F.expr("shiftleft(1L, CAST({} AS INT))".format(f"pmod(xxhash64(node), {MAP_BITS}L) & 63L"))
    held = written(nodes.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")), "map")
    near = docs.withColumn("word", word).join(F.broadcast(held), "word").filter(F.col("bits").bitwiseAND(bit) != 0).select("node", "text")
    return near.join(nodes, "node", "left_semi")


def links_across(members: DataFrame, labels: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links between members of one bucket that have different labels so far, for buckets of four or more.

    (In smaller ones the leaders have met everyone.) Members outside the bucket's most frequent label ask all members.
    Bags whose sizes differ by more than the threshold cannot be alike: a bucket falls into classes of sizes that grow by
    1 / threshold, and a member is in its own class and the one below, where it meets the smaller ones that it can be
    like (at a threshold of 1 a class is one size). Within a class askers and members meet in blocks: each block of
    askers with each block of members, so that no task holds a whole bucket and pairs are never rows. Of buckets with
    the same members (by two sums of their hashes) one is worked on.
    """
    named = members.join(labels, "node", "left").select("bucket", "size", "node", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b")).filter("n > 3 AND a < b").select("bucket")
    class_ = F.floor(F.log("size") / F.lit(-math.log(similarity))).cast("int") if similarity < 1 else F.col("size").cast("int")
    below = F.array(class_, class_ - 1) if similarity < 1 else F.array(class_)
    named = named.join(mixed, "bucket").withColumn("class", F.explode(below)).withColumn("bucket", F.struct("bucket", "class")).drop("class", "size")
    named = written(named, "classed")
    # sums, not exclusive or: an id that is there twice must not cancel out
    whose = [F.sum(F.xxhash64("node", F.lit(i)).cast("decimal(38,0)")).alias(f"x{i}") for i in (3, 4)]
    kinds = named.groupBy("bucket", "label").agg(F.count("*").alias("n"), *whose)
    open_ = kinds.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("k"), F.sum("x3").alias("x3"), F.sum("x4").alias("x4")).filter("k > 1")
    open_ = open_.groupBy("n", "x3", "x4").agg(F.min("bucket").alias("bucket"), F.min("top").alias("top"))
    open_ = written(open_.select("bucket", F.col("top.label").alias("major"), F.ceil(F.col("n") / MEMBERS).cast("int").alias("mb"), F.ceil((F.col("n") - F.col("top.n")) / ASKERS).cast("int").alias("ab")), "open")
    held = named.join(open_, "bucket")
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    member = F.transform(spread("ab"), lambda i: F.struct(i.alias("a"), own("mb", 1).alias("m"), F.lit(False).alias("asks")))
    asker = F.transform(spread("mb"), lambda i: F.struct(own("ab", 2).alias("a"), i.alias("m"), F.lit(True).alias("asks")))
    roles = F.when(F.col("label") == F.col("major"), member).otherwise(F.concat(member, asker))
    dealt = held.select("bucket", "node", "label", F.explode(roles).alias("r")).select("bucket", "r.*", "node", "label").join(texts, "node")
    return dealt.groupBy("bucket", "a", "m").applyInPandas(lambda pdf: block_links(pdf, similarity), "a long, b long").distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For every row: id, class_id (the smallest id of its class)."""
    signs = written(signed(docs, id_col, text_col, bands, rows), "signs")
    reps = written(signs.filter("copy IS NOT NULL").groupBy("copy").agg(F.min("id").alias("node")), "reps")
    held = signs.join(reps.select(F.col("node").alias("id")), "id", "left_semi").select(F.col("id").alias("node"), "size", F.explode("buckets").alias("bucket"))
    one = F.struct("node", "size")
    shared = written(held.groupBy("bucket").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).filter("lo.node < hi.node"), "shared")
    members = written(held.join(shared, "bucket"), "members")
    spokes = members.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), one.alias("b")), F.struct(one.alias("a"), F.col("hi").alias("b")))).alias("e"))
    # bags cannot be more alike than their sizes
    spokes = spokes.filter(F.col("e.a.node") < F.col("e.b.node")).filter(F.least("e.a.size", "e.b.size") >= F.lit(similarity * (1 - 1e-9)) * F.greatest("e.a.size", "e.b.size"))
    pairs = written(spokes.select(F.col("e.a.node").alias("a"), F.col("e.b.node").alias("b")).distinct(), "pairs")
    wanted = written(members.select("node").distinct(), "wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    texts = written(texts_of(texts, wanted), "texts")
    links = written(verified(pairs, texts, similarity), "links")
    labels = components(links)
    more = written(links_across(members, labels, texts, similarity), "links")
    if not more.isEmpty():
        labels = components(links.union(more))
    classes = reps.join(labels, "node", "left")
    classes = written(classes.select("copy", F.coalesce("label", "node").alias("class_id")), "classes")
    known = signs.select("id", "copy").join(classes, "copy", "left").select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"))
    unnamed = docs.filter(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias(id_col), F.lit(None).cast("long").alias("class_id"))
    return known.unionByName(unnamed)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs with the smallest id of their class, with all columns; rows with a null id stay."""
    gone = near_classes(docs, id_col, **how).filter(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias("__gone"))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
