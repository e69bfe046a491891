"""SentencePiece encoding and decoding by a unigram model.

The best segmentation of a text is found by Viterbi over a double-array trie of the pieces, each with a log score.
What no piece covers is spelled in byte pieces. Spaces are the marker U+2581 and a text gets one before it; decoding
joins the pieces, turns markers into spaces and drops the first.

No piece of the vocabulary continues with a marker after another character (this is checked), so the best
segmentation of a text is that of its stretches between such places, and equal stretches are segmented once. Long
stretches, as texts without spaces have, are cut further at places that no piece runs over; what cannot be cut there
(as one letter a million times) goes by a plain loop. So no text is worked on byte by byte across few rows.

No normaliser is applied: the text is encoded as it is.

The public model file is of merges: its stored scores are minus the rank of the merge, no log probabilities. By
default the log score of a piece is therefore that of Zipf's law over the rank; `scores="stored"` takes the file's.

Defined results: null texts have null ids; the empty text has no ids. A byte costs `BYTE_PENALTY` more than the
least likely piece. Of segmentations with equal scores the one whose last piece is longest wins, from the end on.
A marker in the text itself decodes to a space, as in the original scheme; such texts are reported by `exact`.
Rows that repeat an id are rows of their own; columns beside id and text are never read. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TOKENIZERS, small_batches

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
MARK = "▁"
BYTE_PENALTY = 10.0
#: Stretches whose ids a task remembers; beyond, it begins anew.
MEMORY = 150_000
#: Bytes of a stretch that is cut further, and of what is left that goes by a plain loop.
LONG, VERY_LONG = 64, 2048
#: Bytes in which places to cut are looked for at once.
STEP = 1 << 20
#: Texts that are encoded at once; cells (a byte of a stretch each, 21 bytes) of the tables in which stretches are segmented together.
LOT, CELLS = 250, 1 << 19
#: A stretch: markers and what follows them up to the next.
STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass
class Pieces:
    """Ids from 0: the text of each piece (None for control pieces and bytes), its log score, and the ids of the 256 bytes."""

    texts: list[str | None]
    scores: list[float]
    bytes_: list[int]


def read_pieces(path: str = MODEL, scores: str = "zipf") -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
    texts = [model.id_to_piece(i) if plain[i] else None for i in range(n)]
    bytes_ = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if any(model.is_unknown(i) for i in bytes_):
        raise ValueError("the model has no byte pieces")
    if scores == "stored":
        found = [model.get_score(i) for i in range(n)]
    else:
        ranked = sorted((i for i in range(n) if plain[i]), key=lambda i: (-model.get_score(i), i))
        total = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
        found = [0.0] * n
        for r, i in enumerate(ranked):
            found[i] = -math.log(r + 1) - total
    least = min(s for s, p in zip(found, plain, strict=True) if p)
    for i in bytes_:
        found[i] = least - BYTE_PENALTY
    if any(t and re.search(f"[^{MARK}]{MARK}", t) for t in texts):
        raise ValueError("a piece runs over a word's start")
    return Pieces(texts, found, bytes_)


class DoubleArray:
    """A trie of byte strings in two arrays: node n goes by byte b to base[n] + b + 1 if check there is n. value: the piece that ends at the node, or -1."""

    def __init__(self, pieces: dict[bytes, int]):
        tree: dict = {}
        for piece, i in pieces.items():
            at = tree
            for byte in piece:
                at = at.setdefault(byte, {})
            at[-1] = i
        base, check, value = [0] * 257, [0] + [-1] * 256, [-1] * 257
        free = dense = 257  # so that no start is below 0
        todo = deque([(0, tree)])
        while todo:
            node, below = todo.popleft()
            value[node] = below.pop(-1, -1)
            codes = sorted(below)
            if not codes:
                continue
            while free < len(check) and check[free] >= 0:
                free += 1
            start = free if len(codes) == 1 else max(free, dense)
            at, tries = start - codes[0] - 1, 0
            while any(at + b + 1 < len(check) and check[at + b + 1] >= 0 for b in codes):
                at, tries = at + 1, tries + 1
            if len(codes) > 1 and tries > 256:
                dense = at
            grow = at + codes[-1] + 2 - len(check)
            if grow > 0:
                base.extend([0] * grow)
                check.extend([-1] * grow)
                value.extend([-1] * grow)
            base[node] = at
            for b in codes:
                check[at + b + 1] = node
                todo.append((at + b + 1, below[b]))
        end = [0] * 257
        self.base = np.asarray(base + end, dtype=np.int32)
        self.check = np.asarray(check + [-1] * 257, dtype=np.int32)
        self.value = np.asarray(value + [-1] * 257, dtype=np.int32)


class Encoder:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.trie = DoubleArray({t.encode(): i for i, t in enumerate(pieces.texts) if t})
        self.scores = np.asarray(pieces.scores)
        self.bytes_ = np.asarray(pieces.bytes_, dtype=np.int32)
        self.out = [t.encode() if t else b"" for t in pieces.texts]
        for b, i in enumerate(pieces.bytes_):
            self.out[i] = bytes([b])
        self.held: dict[str, bytes] = {}
        self.longest = max((len(t.encode()) for t in pieces.texts if t), default=1)

    def cut(self, data: bytes) -> list[bytes]:
        """data in parts that no piece runs over. From every place the trie is walked at once; a place is a cut where no match from before it ends after it."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        x = np.frombuffer(data, dtype=np.uint8)
        cuts, far = [0], 0
        for low in range(0, len(x), STEP):
            part = x[low : low + STEP + self.longest]
            at = np.arange(min(STEP, len(x) - low))
            reach, node, depth = at + 1, np.zeros(len(at), dtype=np.int32), 0
            while True:
                inside = at + depth < len(part)
                at, node = at[inside], node[inside]
                nxt = base[node] + part[at + depth] + 1
                goes = check[nxt] == node
                at, node, depth = at[goes], nxt[goes], depth + 1
                if not len(at):
                    break
                ends = at[value[node] >= 0]
                reach[ends] = ends + depth
            reach = np.maximum.accumulate(np.maximum(reach + low, far))
            places = np.arange(low + 1, low + 1 + len(reach))
            cuts += places[reach <= places].tolist()
            far = int(reach[-1])
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def plain_viterbi(self, data: bytes) -> bytes:
        """The ids of one long byte string, by a loop over its bytes; the same choice among equal scores as viterbi."""
        base, check, value = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist()
        scores, bytes_, n = self.scores.tolist(), self.bytes_.tolist(), len(data)
        best, piece, back = [-math.inf] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            here, node, end = best[start], 0, start
            score = here + scores[bytes_[0]]
            if score > best[start + 1]:
                best[start + 1], piece[start + 1], back[start + 1] = score, bytes_[data[start]], start
            while end < n:
                nxt = base[node] + data[end] + 1
                if check[nxt] != node:
                    break
                node, end = nxt, end + 1
                i = value[node]
                if i >= 0 and here + scores[i] > best[end]:
                    best[end], piece[end], back[end] = here + scores[i], i, start
        ids, at = [], n
        while at:
            ids.append(piece[at])
            at = back[at]
        return np.asarray(ids[::-1], dtype=np.int32).tobytes()

    def viterbi(self, parts: list[bytes]) -> list[bytes]:
        """For each byte string the ids (int32 as bytes) with the highest sum of log scores; single bytes lead over what no piece covers.

        All strings advance together, longest first: at each start every string walks the trie from there,
        and each piece that ends on the way may better the score of its end.
        """
        order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
        length = np.asarray([len(parts[i]) for i in order])
        data = np.zeros((len(parts), int(length[0]) + 1), dtype=np.uint8)
        inside = np.arange(data.shape[1]) < length[:, None]
        data[inside] = np.frombuffer(b"".join([parts[i] for i in order]), dtype=np.uint8)
        best = np.full(data.shape, -np.inf)
        best[:, 0] = 0
        piece, back = np.zeros(data.shape, dtype=np.int32), np.zeros(data.shape, dtype=np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        byte_score = self.scores[self.bytes_[0]]

        def better(rows: np.ndarray, end: int, found: np.ndarray, i: np.ndarray, start: int) -> None:
            up = found > best[rows, end]
            rows = rows[up]
            best[rows, end], piece[rows, end], back[rows, end] = found[up], i[up], start

        for start in range(int(length[0])):
            rows = np.arange(np.searchsorted(-length, -start))
            here = best[: len(rows), start]
            better(rows, start + 1, here + byte_score, self.bytes_[data[rows, start]], start)
            node, end = np.zeros(len(rows), dtype=np.int32), start
            while len(rows):
                nxt = base[node] + data[rows, end] + 1
                goes = (check[nxt] == node) & (length[rows] > end)
                rows, node, end = rows[goes], nxt[goes], end + 1
                if not len(rows):
                    break
                i = value[node]
                ends = i >= 0
                better(rows[ends], end, here[rows[ends]] + self.scores[i[ends]], i[ends], start)
        ids = np.zeros(data.shape, dtype=np.int32)
        n, at, rows = np.zeros(len(parts), dtype=np.int64), length.copy(), np.flatnonzero(length)
        while len(rows):
            n[rows] += 1
            ids[rows, data.shape[1] - n[rows]] = piece[rows, at[rows]]
            at[rows] = back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        out = [b""] * len(parts)
        for j, i in enumerate(order):
            out[i] = ids[j, data.shape[1] - n[j] :].tobytes()
        return out

    def learn(self, new: list[str]) -> None:
        """Segments the stretches; strings of like length go together, so that a long one makes no wide table. Long ones are segmented part by part."""
        long = {t: self.cut(t.encode("utf-8", "surrogatepass")) for t in new if len(t) > LONG}
        if long:
            parts = set().union(*long.values())
            self.learn_parts(parts_held := {}, [p for p in parts if len(p) <= VERY_LONG])
            parts_held |= {p: self.plain_viterbi(p) for p in parts if len(p) > VERY_LONG}
            self.held.update({t: b"".join(map(parts_held.__getitem__, p)) for t, p in long.items()})
        short = [t for t in new if len(t) <= LONG]
        self.learn_parts(found := {}, [t.encode("utf-8", "surrogatepass") for t in short])
        self.held.update({t: found[t.encode("utf-8", "surrogatepass")] for t in short})

    def learn_parts(self, out: dict[bytes, bytes], new: list[bytes]) -> None:
        new = sorted(new, key=len)
        at = 0
        while at < len(new):
            lot = [new[at]]
            limit = 2 * len(lot[0]) + 16
            at += 1
            while at < len(new) and len(lot) * limit < CELLS and len(new[at]) <= limit:
                lot.append(new[at])
                at += 1
            out.update(zip(lot, self.viterbi(lot), strict=True))

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The ids of each text; null gives None."""
        parts = [None if t is None else STRETCH.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.held) > MEMORY:
            self.held.clear()
        self.learn(list(set().union(*(p for p in parts if p)) - self.held.keys()))
        return [None if p is None else np.frombuffer(b"".join(map(self.held.__getitem__, p)), dtype=np.int32) for p in parts]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if len(ids) else text


_encoders: dict[tuple[str, str], Encoder] = {}


def spread_encoder(spark: SparkSession, model: str, scores: str) -> Broadcast:
    """The encoder for all workers. The trie is built once, by the driver: building takes many times the memory that the trie does."""
    return spark.sparkContext.broadcast(Encoder(read_pieces(model, scores)))


def encoder_of(held: Broadcast, name: tuple[str, str]) -> Encoder:
    """This Python worker's encoder for the model; workers live on from task to task, and with them what the encoder remembers."""
    if name not in _encoders:
        _encoders[name] = held.value
    return _encoders[name]


def encoded(docs: DataFrame, model: str = MODEL, scores: str = "zipf", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id, n_chars, n_pieces, ids, exact (decoding the ids gives the text)."""
    held = spread_encoder(docs.sparkSession, model, scores)
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(held, (model, scores))
        for batch in batches:
            for at in range(0, batch.num_rows, LOT):
                lot = batch.slice(at, LOT)
                texts = lot.column("text").to_pylist()
                ids = encoder.encode_all(texts)
                exact = [None if t is None else encoder.decode(x) == t for t, x in zip(texts, ids, strict=True)]
                n = [None if x is None else len(x) for x in ids]
                ends = np.concatenate(([0], np.cumsum([k or 0 for k in n]))).astype(np.int32)
                flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, dtype=np.int32)])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=pa.int32()), mask=pa.array([x is None for x in ids]))
                yield pa.RecordBatch.from_arrays([lot.column("id"), pa.array([None if t is None else len(t) for t in texts], type=pa.int64()), pa.array(n, type=pa.int64()), lists, pa.array(exact, type=pa.bool_())], names=["id", "n_chars", "n_pieces", "ids", "exact"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_chars long, n_pieces long, ids array<int>, exact boolean").withColumnRenamed("id", id_col)


def decoded(rows: DataFrame, model: str = MODEL, scores: str = "zipf", ids_col: str = "ids") -> DataFrame:
    """rows with their ids' text as the column `text`; null ids give null."""
    held = spread_encoder(rows.sparkSession, model, scores)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_of(held, (model, scores))
        for ids in batches:
            yield pd.Series([None if x is None else encoder.decode(np.asarray(x)) for x in ids], dtype=object)

    return small_batches(rows).withColumn("text", text(F.col(ids_col)))
