"""Exact dedup: group by 128-bit content hash, keep one row, compare bytes inside groups.

The main path is DataFrame functions alone. Texts are equal when their bytes agree after all
characters of [\\x20\\x09-\\x0D] are deleted. The hash deals the rows out; the normalised bytes
are a grouping key next to it, so two texts with one hash stay two groups.

Defined results: a null text counts as empty, and empty texts are one group. Among equal texts the
row with the most code points of original text stays, then the smallest id (a null id comes last).
The id names a row: rows that repeat both id and text get the same answer. Columns beside id and
text are never read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE_RUN, "")


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.length(text_or_empty(F.col(text_col))).cast("long").alias("n"),
        normalized(F.col(text_col)).alias("norm"),
    )
    return rows.select("id", "n", F.unhex(F.md5("norm")).alias("hash"), "norm")


def groups_of_copies(rows: DataFrame) -> DataFrame:
    """One row for each distinct text that occurs more than once.

    The hash and the bytes are both keys: tasks combine their own rows first, so a group of any size
    sends one row a task, and the key comparison is the comparison of bytes.
    """
    return (
        rows.groupBy("hash", "norm")
        .agg(F.count("*").alias("group_size"), F.min(F.struct(-F.col("n"), F.col("id").isNull(), "id")).alias("best"))
        .filter("group_size > 1")
        .select(F.col("hash").alias("g_hash"), F.col("norm").alias("g_norm"), "group_size", F.col("best.id").alias("best_id"))
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id, keep_id, group_size, kept, text_sha256.

    The rows meet the groups of copies on the hash alone, so that Spark can split a hash that a third
    of the rows share; a hash has one group, or a few if texts collide. The two inequalities compare
    the bytes; an equality would become part of the join key and tie the join to the grouping above.
    """
    rows = hashed(docs, id_col, text_col)
    copies = groups_of_copies(rows)
    same = (F.col("hash") == F.col("g_hash")) & (F.col("norm") >= F.col("g_norm")) & (F.col("norm") <= F.col("g_norm"))
    met = rows.join(copies, same, "left")
    alone = F.col("group_size").isNull()
    return met.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | F.col("id").eqNullSafe(F.col("best_id"))).alias("kept"),
        F.sha2("norm", 256).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows without an id that share a text with such rows alone, all stay.

    A row travels once, as it is: only where the hash finds a group is its text normalised again and compared.
    """
    copies = groups_of_copies(hashed(docs, id_col, text_col))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.unhex(F.md5(normalized(F.col(text_col)))).alias("hash"))
    own = normalized(F.col("row")[text_col])
    met = rows.join(copies, (F.col("hash") == F.col("g_hash")) & (own >= F.col("g_norm")) & (own <= F.col("g_norm")), "left")
    return met.filter(F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("best_id"))).select("row.*")
