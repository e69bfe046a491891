"""Collocation mining by hierarchical pair naming.

A phrase of k words is a pair of neighbouring phrases of k - 1 words that overlap. Words, then pairs, triples and so
on get numbers, level by level: neighbouring numbers of one level are counted as pairs, pairs with too few occurrences
go (no longer phrase through them can have more), and those that stay get a number that holds in all documents. The
two numbers of a pair are pointers to its parents, along which frequencies of first and last parts (for the cuts) and
of longer phrases (for the subsumption) are looked up; the words themselves are never compared again.

How it is dealt out: documents are packed into chunks of a fixed number of words, in which different words and pairs
have local codes. For counting, a chunk's words or pairs go over the network in buckets by a hash, packed; there are so
many buckets that one holds about BUCKET words of the corpus, whatever its size. A bucket's names are counted, and what
is frequent goes back to its chunks and meets their sequences. The number of a name is the place, chunk and code, where
it comes first, so numbers take no further join. No dictionary is broadcast and none reaches the driver.

Defined results: null texts are empty, a null lang is `und`. Rows that repeat an id are documents of their own; ids
and other columns are never read. Ties of score and frequency are ranked by the phrase's UTF-8 bytes. Documents without
words count for nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import deleted, written

#: Words of a chunk, about: a document that is longer is cut where a piece ends.
CHUNK = 1 << 20
#: A number is a place: part, chunk of the part, code of the chunk, with so many bits for the latter two.
CHUNK_BITS, CODE_BITS = 12, 30
#: Words of the corpus for each bucket of names, about.
BUCKET = 1 << 20
#: A-Z as a-z, what ends a piece as a line feed, a tab as a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
#: Groups by hash in which candidates are ranked before those left of a language meet.
SALTS = 64


class Codes(dict):
    """Codes of words; a new word gets the next one."""

    def __init__(self, order: list[bytes]):
        super().__init__()
        self.order = order

    def __missing__(self, word: bytes) -> int:
        self.order.append(word)
        code = self[word] = len(self.order)
        return code


def place(number: int) -> int:
    """What stands for the chunk in the numbers of this task's chunk."""
    return (TaskContext.get().partitionId() << CHUNK_BITS | number) << CODE_BITS


def place(number: int) -> int:
    """What stands for the chunk in the numbers of this task's chunk."""
    return (TaskContext.get().partitionId() << CHUNK_BITS | number) << CODE_BITS


def packed(values: np.ndarray) -> bytes:
    """Compressed by bytes of like weight."""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes())


def unpacked(data: bytes, kind: str = "i4") -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def word_chunks(docs: DataFrame, chunk_words: int, lang_col: str, text_col: str) -> DataFrame:
    """chunk, codes (0 between pieces), lang, n (words), and the different words with their occurrences c by code from 1, packed."""

    def closed(number: int, lang: str, codes: array, order: list[bytes]) -> pd.DataFrame:
        found = np.frombuffer(codes, dtype=np.int32)
        words = zstandard.ZstdCompressor(level=1).compress(b"\n".join(order))
        return pd.DataFrame([{"chunk": place(number), "codes": packed(found), "lang": lang, "n": int(np.count_nonzero(found)), "words": words, "c": packed(np.bincount(found)[1:].astype(np.int32))}])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # each language has a chunk of its own
        open_: dict[str, tuple[array, list[bytes], Codes]] = {}
        number = held = 0
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                for piece in text.translate(TABLE).split(b"\n"):
                    words = piece.split()
                    if not words:
                        continue
                    if lang not in open_:
                        order: list[bytes] = []
                        open_[lang] = (array("i"), order, Codes(order))
                    codes, order, own = open_[lang]
                    codes.extend(map(own.__getitem__, words))
                    codes.append(0)
                    held += len(words) + 1
                    if held >= chunk_words:
                        # the fullest goes, so that many languages together are bounded too
                        full = max(open_, key=lambda k: len(open_[k][0]))
                        codes, order, _ = open_.pop(full)
                        held -= len(codes)
                        yield closed(number, full, codes, order)
                        number += 1
        for lang, (codes, order, _) in open_.items():
            yield closed(number, lang, codes, order)
            number += 1

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInPandas(run, "chunk long, codes binary, lang string, n long, words binary, c binary")


#: A row a chunk and bucket has codes, numbers (id) and occurrences (f) of its frequent names; a row a bucket without a chunk has the names: numbers, words (with lang) or numbers of parents (a, b), occurrences.
NAMED = "chunk long, lang string, code array<int>, id array<long>, f array<long>, a array<long>, b array<long>, words array<string>"


def named(pdf: pd.DataFrame, codes: list[np.ndarray], index: np.ndarray, first: np.ndarray, total: np.ndarray, least: int, **names) -> pd.DataFrame:
    """Rows of NAMED: codes by chunk, for each code the index of its name, for each name its first place and occurrences; and what else is known of names."""
    keep = total >= least
    rows, at = [], 0
    for chunk, code in zip(pdf["chunk"], codes, strict=True):
        own = index[at : at + len(code)]
        at += len(code)
        good = keep[own]
        if good.any():
            rows.append({"chunk": chunk, "code": code[good], "id": first[own[good]], "f": total[own[good]]})
    if keep.any():
        of = np.flatnonzero(keep)
        rows.append({"lang": pdf["lang"].iloc[0] if "lang" in pdf else None, "id": first[of], "f": total[of], **{k: v[of] if isinstance(v, np.ndarray) else [v[i] for i in of] for k, v in names.items()}})
    none = dict.fromkeys(("chunk", "lang", "code", "id", "f", "a", "b", "words"))
    return pd.DataFrame([none | r for r in rows], columns=list(none), dtype=object).astype({"chunk": "Int64"})


def words_numbered(chunks: DataFrame, least: int, buckets: int) -> DataFrame:
    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, lang, words, c in pdf.itertuples(index=False):
                words = np.array(zstandard.ZstdDecompressor().decompress(words).split(b"\n"), dtype=object)
                c = unpacked(c)
                bucket = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % buckets
                order = np.argsort(bucket, kind="stable")
                ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
                lots = np.split(order, ends[:-1])
                press = zstandard.ZstdCompressor(level=1)
                yield pd.DataFrame({"chunk": chunk, "lang": lang, "bucket": [bucket[x[0]] for x in lots], "words": [press.compress(b"\n".join(words[x])) for x in lots], "code": [packed((x + 1).astype(np.int32)) for x in lots], "c": [packed(c[x]) for x in lots]})

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        own: dict[bytes, int] = {}
        index, codes, c, places = [], [], [], []
        for chunk, words, code, n in zip(pdf["chunk"], pdf["words"], pdf["code"], pdf["c"], strict=True):
            index.append(np.array([own.setdefault(w, len(own)) for w in zstandard.ZstdDecompressor().decompress(words).split(b"\n")], dtype=np.int64))
            codes.append(unpacked(code))
            c.append(unpacked(n))
            places.append(chunk + codes[-1].astype(np.int64))
        index = np.concatenate(index)
        # chunks are in order, so a word is first seen at its smallest place
        _, seen = np.unique(index, return_index=True)
        total = np.zeros(len(own), dtype=np.int64)
        np.add.at(total, index, np.concatenate(c))
        return named(pdf, codes, index, np.concatenate(places)[seen], total, least, words=[w.decode("utf-8", "replace") for w in own])

    rows = chunks.select("chunk", "lang", "words", "c").mapInPandas(dealt, "chunk long, lang string, bucket int, words binary, code binary, c binary")
    return written(rows.groupBy("lang", "bucket").applyInPandas(counted, NAMED), "names")


def pair_chunks(chunks: DataFrame, known: DataFrame, buckets: int) -> DataFrame:
    """The next level: a row a chunk with its codes, and a row a chunk and bucket with codes, left and right numbers (a, b) and occurrences c of its pairs, packed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, codes, known, ids in zip(pdf["chunk"], pdf["codes"], pdf["known"], pdf["ids"], strict=True):
                codes = unpacked(codes)
                known, ids = (np.concatenate(list(x)) for x in (known, ids))
                places = np.zeros(max(int(codes.max(initial=0)), int(known.max())) + 1, dtype=np.int64)
                places[known] = np.arange(1, len(known) + 1)
                at = places[codes]
                left, right = at[:-1], at[1:]
                pair = np.flatnonzero((left > 0) & (right > 0))
                if not len(pair):
                    continue
                names, inverse, counts = np.unique(left[pair] * (len(known) + 1) + right[pair], return_inverse=True, return_counts=True)
                a, b = ids[names // (len(known) + 1) - 1], ids[names % (len(known) + 1) - 1]
                mixed = (a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ b.view(np.uint64)
                bucket = ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % buckets
                order = np.lexsort((b, a, bucket))
                code = np.empty(len(order), dtype=np.int32)
                code[order] = np.arange(1, len(order) + 1)
                found = np.zeros(len(codes), dtype=np.int32)
                found[pair] = code[inverse]
                a, b, bucket, counts = a[order], b[order], bucket[order], counts[order].astype(np.int32)
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                cut = list(zip(starts, [*starts[1:], len(a)], strict=True))
                # codes run on within a bucket; left numbers rise
                whole = pd.DataFrame([{"chunk": chunk, "codes": packed(found), "bucket": None, "base": None, "a": None, "b": None, "c": None}], dtype=object)
                yield whole.astype({"chunk": "Int64", "bucket": "Int64", "base": "Int64"})
                yield pd.DataFrame({"chunk": chunk, "codes": None, "bucket": bucket[starts], "base": starts + 1, "a": [packed(np.diff(a[i:j], prepend=0)) for i, j in cut], "b": [packed(b[i:j]) for i, j in cut], "c": [packed(counts[i:j]) for i, j in cut]})

    rows = chunks.filter("codes IS NOT NULL").select("chunk", "codes").join(known, "chunk")
    return rows.mapInPandas(run, "chunk long, codes binary, bucket int, base int, a binary, b binary, c binary")


def pairs_numbered(chunks: DataFrame, least: int) -> DataFrame:
    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        a = [np.cumsum(unpacked(x, "i8")) for x in pdf["a"]]
        codes = [base + np.arange(len(x), dtype=np.int32) for base, x in zip(pdf["base"], a, strict=True)]
        places = np.concatenate([chunk + code.astype(np.int64) for chunk, code in zip(pdf["chunk"], codes, strict=True)])
        a, b, c = np.concatenate(a), np.concatenate([unpacked(x, "i8") for x in pdf["b"]]), np.concatenate([unpacked(x) for x in pdf["c"]])
        # chunks are in order and sorting is stable, so a pair's first place comes first
        order = np.lexsort((b, a))
        new = np.flatnonzero((np.diff(a[order], prepend=-1) != 0) | (np.diff(b[order], prepend=-1) != 0))
        index = np.empty(len(a), dtype=np.int64)
        index[order] = np.repeat(np.arange(len(new)), np.diff(new, append=len(a)))
        return named(pdf, codes, index, places[order][new], np.add.reduceat(c[order].astype(np.int64), new), least, a=a[order][new], b=b[order][new])

    rows = chunks.filter("codes IS NULL").select("chunk", "bucket", "base", "a", "b", "c")
    return written(rows.groupBy("bucket").applyInPandas(counted, NAMED), "names")


def phrase_levels(docs: DataFrame, least: int = 30, longest: int = 4, chunk_words: int = CHUNK, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """Words a language (lang, n), and for each length the frequent phrases: words as id, a (lang), b (word), f, longer ones as id, a and b (ids of their parents), f."""
    chunks = written(word_chunks(docs, chunk_words, lang_col, text_col), "chunks")
    words = written(chunks.groupBy("lang").agg(F.sum("n").alias("n")), "words")
    buckets = max(1, math.ceil((words.agg(F.sum("n")).first()[0] or 0) / BUCKET))
    levels = []
    for length in range(1, longest + 1):
        held = words_numbered(chunks, least, buckets) if length == 1 else pairs_numbered(chunks, least)
        names = ["id", "f", *(["words"] if length == 1 else ["a", "b"])]
        grams = held.filter("chunk IS NULL").select("lang", F.explode(F.arrays_zip(*names)).alias("x"))
        grams = grams.select("x.id", F.col("lang").alias("a"), F.col("x.words").alias("b"), "x.f") if length == 1 else grams.select("x.id", "x.a", "x.b", "x.f")
        levels.append(written(grams, "grams"))
        if length < longest:
            known = held.filter("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list("code").alias("known"), F.collect_list("id").alias("ids"))
            following = written(pair_chunks(chunks, known, buckets), "chunks")
            deleted(chunks)
            chunks = following
        deleted(held)
    deleted(chunks)
    return words, levels


def candidates(levels: list[DataFrame]) -> DataFrame:
    """lang, phrase, a (occurrences), heads and tails (occurrences of the first and last 1, 2, ... words), longer (most occurrences of a phrase that holds it, or null) of all phrases of two words and more."""
    one = levels[0].select("id", F.col("a").alias("lang"), F.col("b").alias("phrase"), F.col("b").alias("last"), "f", F.expr("cast(array() as array<bigint>)").alias("heads"), F.expr("cast(array() as array<bigint>)").alias("tails"))
    out, shorter = None, one
    for k, level in enumerate(levels[1:], 1):
        left = shorter.select(F.col("id").alias("a"), "lang", "phrase", F.concat("heads", F.array("f")).alias("heads"))
        right = shorter.select(F.col("id").alias("b"), "last", F.concat("tails", F.array("f")).alias("tails"))
        made = level.join(left, "a").join(right, "b")
        shorter = written(made.select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", "heads", "tails"), "phrases")
        found = shorter.withColumn("longer", F.lit(None).cast("long"))
        if k + 1 < len(levels):
            # a phrase two words longer has no more occurrences than one of the two between
            above = levels[k + 1].select(F.explode(F.array("a", "b")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer"))
            found = shorter.join(above, "id", "left")
        found = found.select("lang", "phrase", F.col("f").alias("a"), "heads", "tails", "longer")
        out = found if out is None else out.unionByName(found)
    return out


def scored(found: DataFrame, subsumed: int = 80) -> DataFrame:
    """Candidates that no longer phrase subsumes, with l, r and score of their lowest-scoring cut, the smallest on ties. Products are decimals of 38 digits."""
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    kept = found.filter(F.col("longer").isNull() | (whole("longer") * 100 < whole("a") * subsumed))
    cut = F.expr("""array_min(transform(sequence(1, size(heads)), k -> named_struct(
        'score', (cast(a as decimal(20,0)) * 2000000) div (cast(heads[k - 1] as decimal(20,0)) + cast(tails[size(tails) - k] as decimal(20,0))),
        'k', k, 'l', heads[k - 1], 'r', tails[size(tails) - k])))""")
    return kept.withColumn("cut", cut).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, subsumed: int = 80, chunk_words: int = CHUNK, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    words, levels = phrase_levels(docs, least, longest, chunk_words, lang_col, text_col)
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    found = scored(candidates(levels), subsumed).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    # what is not among the first of its group is not among the first of its language
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("rank") <= top)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return first.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
