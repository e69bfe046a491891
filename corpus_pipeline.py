"""The corpus pipeline: each stage takes what its predecessor kept, written as Parquet and read again.

Every stage but the last returns the columns of documents. Documents that the language models reject go; of exact
copies and of near duplicates one stays; sources are brought to their target weights (rows repeat as often as the
mix takes them); what is left is encoded into pieces.

Defined results: null texts, and texts without a letter, have no language and go with the first stage; a null lang is
no fault. Of rows with equal texts exact dedup keeps the longest original, then the smallest id; of near copies the
smallest id stays, rows with a null id stay too. Rows that repeat id and text are copies. Columns beside those of
documents pass through the stages that return documents. An empty table gives an empty result.
"""

from __future__ import annotations

from slidelake.llm.bagminhash import near_dedup
from slidelake.llm.common import table, written
from slidelake.llm.exact_dedup import exact_dedup
from slidelake.llm.langid import keep_identified
from slidelake.llm.mixing import mix
from slidelake.llm.unigram import encoded


def identify_language(spark, docs, sf_dir):
    return keep_identified(docs)


def drop_exact_copies(spark, docs, sf_dir):
    return exact_dedup(docs)


def drop_near_copies(spark, docs, sf_dir):
    return near_dedup(docs)


def mix_sources(spark, docs, sf_dir):
    return mix(docs)


def encode_pieces(spark, docs, sf_dir):
    return encoded(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]


def run(spark, sf_dir):
    """The stages in turn over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs


#: Language models, signatures and segmentations are beyond SQL; tests/llm holds the run against brute force.
ORACLE_SQL = None
