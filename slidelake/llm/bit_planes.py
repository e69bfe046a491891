"""Token ids in files of bit planes.

Ids are 32-bit numbers in blocks of fixed size. A block is transposed: all lowest bits (or bytes) of its ids together,
then all second ones, and so on; each plane is compressed by zstandard, planes that are all zero are left out. A file:

    planes of block 0, of block 1, ...; documents; index; its size (8 bytes, little-endian), MAGIC, line feed

The index is JSON: the plane unit, the ids of a block, the place and the sizes of the planes of each block (so that a
window of ids reads the blocks alone that it touches), the number of ids and documents, and where the file stands: its
part and the ids of that part before it. `documents` are planes too: ids, whether they are null, and lengths.

Documents are dealt into ranges of their id and sorted; each task packs its range into files of a bounded number of ids
(a longer document alone has a longer file). Files are written by Spark's text writer, a file a row, so any store that
Spark knows will do, what lost tasks leave is never seen, and the line feed is the writer's. A document's place in
the whole follows from the sums of earlier parts, one row a part.

Tokens: a tokenizer whose pieces never cross the white space [\\x20\\x09-\\x0D] encodes what stands between once and
remembers it (`Encoder`); texts are encoded as wholes, special tokens are not added, and an end id follows each.

Defined results: a null text is empty and has the end id alone. Documents with equal ids follow in the order of a hash
of their texts; a null id comes first. Ids of documents must be whole numbers. Columns beside id and text are never
read. An empty table writes no file and gives an empty result.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import TOKENIZERS, text_or_empty, work_path, written

VOCABULARY = f"{TOKENIZERS}/word_bpe_49k.json"
#: The id that ends each document.
END = 1
#: Ids of a block, and of a file, about.
BLOCK, FILE = 1 << 16, 1 << 24
MAGIC = b"IDPLANES"
#: Words that a worker remembers, and the longest of them in bytes; text that is looked at in one go.
MEMORY, LONGEST, PIECE = 3 << 19, 64, 1 << 20
#: Words that are encoded in one go.
TOGETHER = 200
UNITS = {"bit": 1, "byte": 8}


def to_planes(values: np.ndarray, unit: str) -> list[bytes]:
    """The planes of unsigned numbers, lowest first; empty where all is zero."""
    width = values.dtype.itemsize
    grid = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), width)
    out = []
    for byte in range(width):
        column = np.ascontiguousarray(grid[:, byte])
        if unit == "byte":
            out.append(column.tobytes() if column.any() else b"")
            continue
        # bits without one in any number have no plane
        seen = int(np.bitwise_or.reduce(column, initial=0))
        out += [np.packbits((column >> bit) & 1).tobytes() if seen >> bit & 1 else b"" for bit in range(8)]
    return out


def from_planes(planes: list[bytes], n: int, kind: type, unit: str) -> np.ndarray:
    values = np.zeros((n, np.dtype(kind).itemsize), dtype=np.uint8)
    for k, plane in enumerate(planes):
        if plane:
            own = np.frombuffer(plane, dtype=np.uint8)
            if unit == "byte":
                values[:, k] = own
            else:
                values[:, k // 8] |= np.unpackbits(own, count=n) << (k % 8)
    return values.reshape(-1).view(kind)


def packed(values: np.ndarray, unit: str, level: int = 3) -> tuple[bytes, list[int]]:
    """Compressed planes one after the other, and their sizes."""
    press = zstandard.ZstdCompressor(level=level)
    planes = [press.compress(p) if p else b"" for p in to_planes(values, unit)]
    return b"".join(planes), [len(p) for p in planes]


def unpacked(data: bytes | memoryview, sizes: list[int], n: int, kind: type, unit: str) -> np.ndarray:
    planes, at, expand = [], 0, zstandard.ZstdDecompressor()
    for size in sizes:
        planes.append(expand.decompress(data[at : at + size]) if size else b"")
        at += size
    return from_planes(planes, n, kind, unit)


def file_of(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], part: int = 0, first: int = 0, unit: str = "byte", block: int = BLOCK) -> bytes:
    """A file without its last line feed."""
    out, at, blocks = [], 0, []
    for start in range(0, len(ids), block):
        data, sizes = packed(ids[start : start + block], unit)
        out.append(data)
        blocks.append([at, sizes])
        at += len(data)
    columns = {
        "ids": np.array([0 if d is None else d for d in doc_ids], dtype=np.int64).view(np.uint64),
        "nulls": np.array([d is None for d in doc_ids], dtype=np.uint8),
        "lengths": np.array(lengths, dtype=np.uint64),
    }
    documents = {}
    for name, values in columns.items():
        data, sizes = packed(values, "byte")
        out.append(data)
        documents[name] = [at, sizes]
        at += len(data)
    index = json.dumps({"unit": unit, "block": block, "blocks": blocks, "documents": documents, "n_ids": len(ids), "n_docs": len(lengths), "part": part, "first": first}).encode()
    return b"".join([*out, index, len(index).to_bytes(8, "little"), MAGIC])


def index_of(data: bytes) -> dict:
    tail = len(MAGIC) + 1
    if data[-tail:] != MAGIC + b"\n":
        raise ValueError("not a whole file of id planes")
    size = int.from_bytes(data[-tail - 8 : -tail], "little")
    return json.loads(data[-tail - 8 - size : -tail - 8])


def window(data: bytes, start: int, end: int, index: dict | None = None) -> np.ndarray:
    """Ids from start to before end of a file; blocks outside are not touched."""
    index = index or index_of(data)
    size, start, end = index["block"], max(start, 0), min(end, index["n_ids"])
    if start >= end:
        return np.zeros(0, dtype=np.uint32)
    parts = []
    for k in range(start // size, (end - 1) // size + 1):
        at, sizes = index["blocks"][k]
        parts.append(unpacked(memoryview(data)[at:], sizes, min(size, index["n_ids"] - k * size), np.uint32, index["unit"]))
    skip = start // size * size
    return np.concatenate(parts)[start - skip : end - skip]


def documents_of(data: bytes, index: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, whether they are null, and lengths of a file's documents."""
    index = index or index_of(data)
    found = []
    for name, kind in (("ids", np.uint64), ("nulls", np.uint8), ("lengths", np.uint64)):
        at, sizes = index["documents"][name]
        found.append(unpacked(memoryview(data)[at:], sizes, index["n_docs"], kind, "byte"))
    return found[0].view(np.int64), found[1].astype(bool), found[2].astype(np.int64)


class Encoder(dict):
    """Ids, as little-endian bytes, of what stands between white space.

    New words are encoded together with a control character between them, whose id no other character has.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.between = self.tokenizer.encode("\x01", add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def __missing__(self, word: bytes) -> bytes:
        return self.ids(word.decode("utf-8", "replace")).tobytes()

    def learn(self, words: list[bytes]) -> None:
        for k in range(0, len(words), TOGETHER):
            lot = words[k : k + TOGETHER]
            ids = self.ids(b" \x01 ".join(lot).decode("utf-8", "replace"))
            ends = [*np.flatnonzero(ids == self.between[0]).tolist(), len(ids)]
            data, start = ids.tobytes(), 0
            for word, end in zip(lot, ends, strict=True):
                self[word] = data[4 * start : 4 * end]
                start = end + 1

    def pieces(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. What is new in any of them is learned at once; of long words and those with the control character nothing is remembered."""
        split = [text.split() for text in texts]
        found = [list(map(self.get, words)) for words in split]
        lacking = [k for k, ids in enumerate(found) if None in ids]
        new = {w for k in lacking for w, ids in zip(split[k], found[k], strict=True) if ids is None}
        if len(self) + len(new) > MEMORY:
            self.clear()
        self.learn([w for w in new if len(w) <= LONGEST and b"\x01" not in w])
        for k in lacking:
            found[k] = [self[w] if ids is None else ids for w, ids in zip(split[k], found[k], strict=True)]
        return list(map(b"".join, found))

    def texts(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """The ids of each text in turn; texts are taken together up to a size, longer ones cut at spaces."""
        lot: list[bytes] = []
        size = 0
        for text in texts:
            if size + len(text) > PIECE and lot:
                yield from self.pieces(lot)
                lot, size = [], 0
            if len(text) > PIECE:
                cuts = [0]
                while len(text) - cuts[-1] > PIECE and (end := text.find(b" ", cuts[-1] + PIECE)) >= 0:
                    cuts.append(end)
                yield b"".join(self.pieces([text[a:b]])[0] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True))
                continue
            lot.append(text)
            size += len(text)
        yield from self.pieces(lot)


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One a worker, so that words are remembered from task to task."""
    return Encoder(path)


def write_ids(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, unit: str = "byte", block: int = BLOCK, file_ids: int = FILE, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every document, in ascending order of their ids, to files under path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before = TaskContext.get().partitionId(), 0
        encoder = encoder_of(vocabulary)
        last = np.array([end], dtype="<u4").tobytes()
        buffer, doc_ids, lengths = bytearray(), [], []

        def closed() -> pd.DataFrame:
            ids = np.frombuffer(bytes(buffer), dtype=np.uint32)
            return pd.DataFrame({"value": [file_of(ids, doc_ids, lengths, part, before, unit, block)]})

        for pdf in batches:
            for null, doc_id, ids in zip(pdf["none"], pdf["id"], encoder.texts(pdf["text"]), strict=True):
                buffer += ids + last
                doc_ids.append(None if null else doc_id)
                lengths.append(len(ids) // 4 + 1)
                if len(buffer) >= 4 * file_ids:
                    yield closed()
                    before += len(buffer) // 4
                    buffer, doc_ids, lengths = bytearray(), [], []
        if lengths:
            yield closed()

    id_ = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(id_, F.lit(0)).alias("id"), id_.isNull().alias("none"), text_or_empty(F.col(text_col)).cast("binary").alias("text"))
    # equal rows may be very many: their number in the table lets ranges part them
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("number", F.monotonically_increasing_id())
    order = [F.col("none").desc(), F.col("id"), F.col("tie"), F.col("number")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "none", "text")
    files = ordered.mapInPandas(run, "value binary")
    # a cast leaves bytes as they are
    files.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """A row a document of the files under path: part, first (ids of the part before it), id, ids (little-endian, 4 bytes each)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                index = index_of(data)
                doc_ids, nulls, lengths = documents_of(data, index)
                ends = np.cumsum(lengths)
                # about 2^20 ids at a time
                at = 0
                while at < len(ends):
                    start = int(ends[at] - lengths[at])
                    to = max(at + 1, int(np.searchsorted(ends, start + (1 << 20), side="right")))
                    ids = window(data, start, int(ends[to - 1]), index).astype("<u4", copy=False)
                    firsts = (ends - lengths)[at:to]
                    found = [ids[a - start : b - start].tobytes() for a, b in zip(firsts, ends[at:to], strict=True)]
                    yield pd.DataFrame({"part": index["part"], "first": index["first"] + firsts, "id": pd.array(doc_ids[at:to], dtype="Int64"), "ids": found}).assign(id=lambda d, m=nulls[at:to]: d["id"].mask(m))
                    at = to

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "part int, first long, id long, ids binary")


def id_digest(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", **how) -> DataFrame:
    """Writes the ids of documents and reads the files back: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or work_path(spark, "ids")
    write_ids(docs, path, id_col=id_col, **how)
    found = read_ids(spark, path).select("part", "first", "id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    found = written(found, "digests")
    parts = found.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # a row a part; their number is that of the tasks that wrote
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return found.join(F.broadcast(starts), "part").select(F.col("id").alias(id_col), (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
