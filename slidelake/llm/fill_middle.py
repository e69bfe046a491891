"""Fill-in-the-middle rewriting of documents by lookaround splitting.

A unit grammar says which runs of characters are units. All grammars here are local: whether a unit ends between two
characters follows from the classes of the two neighbours alone. A grammar is therefore a list of (class before, class
after) pairs, translated to one zero-width regular expression, `(?<=before)(?=after)|...`, at which Spark's own split
cuts a text and loses nothing. Splitting an empty text gives one empty string, so empty texts are set apart: they have
no units.

Two cuts between units, taken from a seeded hash of the id, make prefix, middle and suffix; they are written in one of
two orders, each part behind a mark:

    psm   <P>prefix<S>suffix<M>middle
    spm   <S>suffix<P>prefix<M>middle

Texts that are empty or hold a mark, and the share that the rate leaves out, stay plain. A mark begins and ends with
characters that it has nowhere else, so none can arise where parts meet, and the text comes back from output and form.
All of it is column expressions: no shuffle, no Python worker.

Defined results: a null text is empty. A null id hashes as the empty string. Rows that repeat an id are cut by the
same numbers. Columns beside id and text are never read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: For each unit the grammar that its pieces follow from left to right, and the neighbours between which a piece ends.
ANY = r"[\s\S]"
GRAMMARS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "line": (r"[^\n]*\n|[^\n]+", [(r"\n", ANY)]),
    "word": (r"[^ \t\n]+[ \t\n]*|[ \t\n]+", [(r"[ \t\n]", r"[^ \t\n]")]),
    "run": (r"[^ \t\n]+|[ \t\n]+", [(r"[ \t\n]", r"[^ \t\n]"), (r"[^ \t\n]", r"[ \t\n]")]),
    "sentence": (r"[^.!?]*[.!?]+|[^.!?]+", [(r"[.!?]", r"[^.!?]")]),
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def boundary(unit: str) -> str:
    """The zero-width expression that matches where a unit ends and another begins."""
    return "|".join(f"(?<={before})(?={after})" for before, after in GRAMMARS[unit][1])


def units(text: Column, unit: str = "line") -> Column:
    """The units of a text, which together are the text; none of an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(unit), -1))


def draws(id_: Column, seed: int, n: int = 4) -> list[Column]:
    """The first n groups of 8 hexadecimal digits of sha256("seed:id") as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: id, text (null as empty), n, form (plain, psm or spm), prefix, middle, suffix (null where plain), output. rate and spm are percentages: of documents that are rewritten, and of those in spm."""
    cut1, cut2, chosen, order = (F.col(f"h{k}") for k in range(4))
    found = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"), *[h.alias(f"h{k}") for k, h in enumerate(draws(F.col(id_col), seed))])
    found = found.withColumn("units", units(F.col("text"), unit)).withColumn("n", F.size("units").cast("long"))
    low, high = F.least(cut1 % (F.col("n") + 1), cut2 % (F.col("n") + 1)), F.greatest(cut1 % (F.col("n") + 1), cut2 % (F.col("n") + 1))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(F.col("text"), F.lit(mark))
    plain = (F.col("text") == "") | marked | (chosen % 100 >= rate)
    form = F.when(plain, "plain").when(order % 100 < spm, "spm").otherwise("psm")
    found = found.withColumn("low", low.cast("int")).withColumn("high", high.cast("int")).withColumn("form", form)
    part = lambda at, end: F.when(F.col("form") != "plain", F.array_join(F.slice("units", at + 1, end - at), ""))
    found = found.withColumn("prefix", part(F.lit(0), F.col("low"))).withColumn("middle", part(F.col("low"), F.col("high"))).withColumn("suffix", part(F.col("high"), F.size("units")))
    head, tail = F.concat(F.lit(PREFIX), "prefix"), F.concat(F.lit(SUFFIX), "suffix")
    output = F.when(F.col("form") == "psm", F.concat(head, tail, F.lit(MIDDLE), "middle")).when(F.col("form") == "spm", F.concat(tail, head, F.lit(MIDDLE), "middle")).otherwise(F.col("text"))
    return found.select(F.col("id").alias(id_col), "text", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text of an output, from it and its form alone."""
    outer = F.substring_index(output, MIDDLE, 1)
    middle = F.substr(output, F.length(outer) + F.lit(len(MIDDLE) + 1))
    first, second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.lit(3)
    at = F.instr(outer, first)
    one, two = F.substr(outer, F.lit(4), at - F.lit(4)), F.substr(outer, at + second)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def fim_digest(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    made = fill_in_middle(docs, id_col=id_col, **how)
    return made.select(
        id_col, "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
