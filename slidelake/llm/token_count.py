"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie of byte strings. Every node has a failure link to the node of what is left after the
greedy pieces of its own string are taken off, and the number of pieces so taken. A word is read once, byte by
byte; where no edge fits, the popped pieces are counted and the link is followed. No piece is built.

A word is a run of [^\\x20\\x09-\\x0D]+ with one space before it; pieces that begin with a space open a word.
The vocabulary file (base64 bytes and a number a line) is a parameter and must hold all 256 single bytes, so
every text has a count.

Defined results: null texts and texts without words have 0 words and 0 tokens. Rows that repeat an id are rows of
their own. Columns beside id and text are never read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZERS

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
#: Words whose counts a task remembers; beyond, it begins anew.
MEMORY = 200_000


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """Edges, failure links and popped counts of the vocabulary's trie; node 0 is the root."""

    def __init__(self, vocabulary: list[bytes]):
        self.edges: list[dict[int, int]] = [{}]
        piece = [False]
        for token in vocabulary:
            at = 0
            for byte in token:
                nxt = self.edges[at].get(byte)
                if nxt is None:
                    nxt = self.edges[at][byte] = len(self.edges)
                    self.edges.append({})
                    piece.append(False)
                at = nxt
            piece[at] = True
        missing = [b for b in range(256) if not piece[self.edges[0].get(b, 0)]]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes, {missing[0]:#04x} first")
        self.link, self.popped = [0] * len(self.edges), [0] * len(self.edges)
        todo = deque([0])
        while todo:
            parent = todo.popleft()
            for byte, node in self.edges[parent].items():
                todo.append(node)
                if piece[node]:
                    self.popped[node] = 1
                    continue
                z, popped = self.link[parent], self.popped[parent]
                while byte not in self.edges[z]:
                    popped += self.popped[z]
                    z = self.link[z]
                self.link[node], self.popped[node] = self.edges[z][byte], popped

    def count(self, word: bytes) -> int:
        """Greedy longest-match pieces of the word."""
        edges, link, popped = self.edges, self.link, self.popped
        at = n = 0
        for byte in word:
            nxt = edges[at].get(byte)
            while nxt is None:
                n += popped[at]
                at = link[at]
                nxt = edges[at].get(byte)
            at = nxt
        while at:
            n += popped[at]
            at = link[at]
        return n


class Counts(dict):
    """Remembered counts of words; a word not yet seen goes through the automaton."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= 64:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = n
        return n


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id, n_words, n_tokens."""
    held = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts(Automaton(held.value))
        for pdf in batches:
            words, tokens = [], []
            for text in pdf["text"]:
                parts = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
                words.append(len(parts))
                tokens.append(sum(map(counts.__getitem__, parts)))
            yield pd.DataFrame({"id": pdf["id"], "n_words": words, "n_tokens": tokens})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
