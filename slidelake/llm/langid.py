"""Language identification by interpolated Kneser-Ney character models.

Per language, n-grams of letters up to order 4 are counted over all training texts by Spark. The probabilities
of all languages lie side by side in sorted arrays of n-gram keys, searched by bisection. The language with the
lowest cross-entropy per symbol is chosen; what scores far above the language's own texts of its length is
rejected. The bound is calibrated on texts that the calibrating model has not seen: texts fall into two halves by a
hash of the text, so that exact copies stay together, and a model of one half scores the other. The bound of a
language and length band (powers of two) is the median plus 10 times the larger of the deviation (MAD) and a tenth
of the median: noise among the labelled rows, unless it is half of a band, moves neither. What the labelled rows
hold in both halves, as near copies of noise or a language under many wrong labels, is learned and passes.

The model is of words: the history of a letter ends at the word's start, so a text may be cut between words
and batches do not matter.

Defined results: null texts and texts without a letter are `und` with score 0 and rejected. Ties go to the
language that sorts first. Without any training text all texts are `und`. Rows with a null language train
nothing. Rows that repeat an id, or id and text, are rows of their own and count as often as they come. A letter beyond
the first 65,536 code points shares its symbol with another letter. Columns beside id, text and language are never read, and those only where said.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranges
from .common import small_batches, text_or_empty, written

ORDER = 4
#: A letter n-gram belongs to a language's model if its training texts have it so often. 1: all belong.
LEAST_COUNT = 1
#: Rows of n-gram counts that driver and workers have memory for: 40 bytes each and 8 more a language. More are an error, which names the two ways on.
MODEL_ROWS = 60_000_000
#: Rejection: deviations above the median, the least deviation as a share of the median, the last length band (2^12 symbols and more), rows that a band needs for figures of its own.
DEVIATIONS, LEAST_DEVIATION, LAST_BAND, BAND_ROWS = 10, 0.1, 12, 30
#: Characters that are worked on at once.
CHUNK = 1 << 18
BITS = 16


def letter_table() -> np.ndarray:
    """For every code point: 0 unless it is a letter, else a 16-bit symbol."""
    if not hasattr(letter_table, "held"):
        codes = np.arange(0x110000, dtype=np.uint32)
        held = np.where([chr(c).isalpha() for c in codes], np.maximum(codes & 0xFFFF, 1), 0)
        letter_table.held = held.astype(np.uint16)
    return letter_table.held


def pieces(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[list[int], list[str]]]:
    """Lower-case texts, and their places, in lots of about `limit` characters; longer texts are cut at white space."""
    at, lot, size = [], [], 0
    for i, text in enumerate(texts):
        rest = text.lower() if isinstance(text, str) else ""
        start = 0
        while start < len(rest):
            end = min(len(rest), start + limit)
            if end < len(rest):
                end = max(rest.rfind(" ", start + 1, end), rest.rfind("\n", start + 1, end)) if " " in rest[start + 1 : end] or "\n" in rest[start + 1 : end] else end
            at.append(i)
            lot.append(rest[start:end])
            size += end - start
            start = end
            if size >= limit:
                yield at, lot
                at, lot, size = [], [], 0
    if lot:
        yield at, lot


def grams(at: list[int], lot: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of each letter (or word end) with its history, and the text that it belongs to."""
    joined = " ".join(lot) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    symbols = letter_table()[codes]
    owner = np.repeat(np.asarray(at, dtype=np.int32), [len(x) + 1 for x in lot])
    ends = np.empty(len(symbols), dtype=bool)
    ends[0] = symbols[0] != 0
    ends[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    s, owner = symbols[ends].astype(np.int64), owner[ends]
    key, back, inside = s.copy(), s, np.ones(len(s), dtype=bool)
    for k in range(1, order):
        back = np.concatenate(([0], back[:-1]))
        inside = inside & (back != 0)
        key |= np.where(inside, back, 0) << (BITS * k)
    return key, owner


def half(text: Column) -> Column:
    """0 or 1; equal for equal texts."""
    return F.pmod(F.xxhash64(F.lit("half"), text), F.lit(2)).cast("int")


def count_grams(docs: DataFrame, text: str, lang: str, order: int) -> DataFrame:
    """lang, half, key, n over all texts."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            langs, names = pd.factorize(pd.MultiIndex.from_frame(pdf[["lang", "half"]]))
            for at, lot in pieces(pdf["text"].tolist()):
                key, owner = grams(at, lot, order)
                by = langs[owner]
                for k in np.unique(by):
                    keys, n = np.unique(key[by == k], return_counts=True)
                    yield pd.DataFrame({"lang": names[k][0], "half": names[k][1], "key": keys, "n": n})

    rows = small_batches(docs).select(F.col(lang).alias("lang"), half(F.col(text)).alias("half"), F.col(text).alias("text")).mapInPandas(counted, "lang string, half int, key long, n long")
    return rows.groupBy("lang", "half", "key").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    order: int
    #: For each order n from 1: sorted keys, and the natural logs of the probabilities, a column a language.
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    #: For each order n from 1: sorted histories of n - 1 symbols, and the logs of what they leave to shorter ones.
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    unseen: np.ndarray
    #: By language and length band: the cross-entropy above which a text is rejected. Symbols that confidence counts.
    limit: np.ndarray | None = None
    strength: float = 20.0

    def losses(self, keys: np.ndarray) -> np.ndarray:
        """Minus log probability of each key in each language; what no language has seen is looked up with shorter histories."""
        out = np.zeros((len(keys), len(self.langs)), dtype=np.float32)
        left = np.arange(len(keys))
        for n in range(self.order, 0, -1):
            key = keys[left] & ((1 << (BITS * n)) - 1) if n < 4 else keys[left]
            at = np.minimum(np.searchsorted(self.keys[n - 1], key), len(self.keys[n - 1]) - 1)
            hit = self.keys[n - 1][at] == key
            out[left[hit]] -= self.logp[n - 1][at[hit]]
            left, key = left[~hit], key[~hit]
            if not len(left):
                return out
            c = _shift(key)
            at = np.minimum(np.searchsorted(self.contexts[n - 1], c), len(self.contexts[n - 1]) - 1)
            out[left] -= np.where((self.contexts[n - 1][at] == c)[:, None], self.backoff[n - 1][at], 0)
        out[left] -= self.unseen
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a symbol in each language, and the number of symbols, of each text."""
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=np.int64)
        for at, lot in pieces(texts):
            keys, owner = grams(at, lot, self.order)
            if len(keys):
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                total[owner[first]] += np.add.reduceat(self.losses(keys), first, axis=0, dtype=np.float64)
                n[owner[first]] += np.diff(np.r_[first, len(owner)])
        return total / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """lang, score (confidence from 0 to 1), loss, rejected."""
        h, n = self.entropies(texts)
        best = h.argmin(axis=1)
        low = h[np.arange(len(h)), best]
        weight = np.minimum(n, self.strength)[:, None]
        score = 1 / np.exp(-(h - low[:, None]) * weight).sum(axis=1)
        far = low > self.limit[best, band(n)] if self.limit is not None else np.zeros(len(low), dtype=bool)
        none = n == 0
        return pd.DataFrame({"lang": np.where(none, "und", np.asarray(self.langs, dtype=object)[best]), "score": np.where(none, 0.0, score), "loss": np.where(none, np.nan, low), "rejected": none | far})


def band(n: np.ndarray) -> np.ndarray:
    """The length band of a text of n symbols."""
    return np.minimum(np.log2(np.maximum(n, 1)).astype(int), LAST_BAND)


def _shift(key: np.ndarray) -> np.ndarray:
    """The history of a key: all symbols but the last. Keys of four symbols fill all 64 bits, so the shift is unsigned."""
    return (key.view(np.uint64) >> np.uint64(BITS)).view(np.int64)


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> Model:
    """The interpolated model from each language's counts of the longest n-grams.

    Shorter n-grams count the different symbols before them. One discount an order, n1 / (n1 + 2 n2).
    All languages get a probability for every key that any has seen.
    """
    langs = sorted(counts)
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for lang in langs:
        key, n = counts[lang]
        own = [(key, n)]
        for k in range(order - 1, 0, -1):
            own.append(np.unique(own[-1][0] & ((1 << (BITS * k)) - 1), return_counts=True))
        levels.append(own[::-1])
    vocabulary = len(np.unique(np.concatenate([own[0][0] for own in levels]))) + 1
    keys, logp, contexts, backoff = [], [], [], []
    lower = np.full((1, len(langs)), 1 / vocabulary)
    unseen = np.full(len(langs), np.log(1 / vocabulary))
    for n in range(1, order + 1):
        union = np.unique(np.concatenate([own[n - 1][0] for own in levels]))
        context = np.unique(_shift(union)) if n > 1 else np.zeros(1, dtype=np.int64)
        where = np.searchsorted(context, _shift(union)) if n > 1 else np.zeros(len(union), dtype=np.int64)
        below = np.searchsorted(keys[-1], union & ((1 << (BITS * (n - 1))) - 1)) if n > 1 else np.zeros(len(union), dtype=np.int64)
        p, left = np.zeros((len(union), len(langs))), np.ones((len(context), len(langs)))
        for j, own in enumerate(levels):
            key, c = own[n - 1]
            n1, n2 = int((c == 1).sum()), int((c == 2).sum())
            d = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.05), 0.95)
            at = np.searchsorted(union, key)
            total = np.bincount(where[at], weights=c, minlength=len(context))
            kinds = np.bincount(where[at], minlength=len(context))
            seen = total > 0
            left[seen, j] = d * kinds[seen] / total[seen]
            p[at, j] = np.maximum(c - d, 0) / total[where[at]]
            p[:, j] += left[where, j] * lower[below, j]
        keys.append(union)
        logp.append(np.log(p).astype(np.float32))
        contexts.append(context)
        backoff.append(np.log(left).astype(np.float32))
        lower = p
    return Model(langs, order, keys, logp, contexts, backoff, unseen.astype(np.float32))


def gathered(rows: DataFrame, text_col: str, lang_col: str, order: int, least_count: int, model_rows: int) -> pd.DataFrame:
    """Counts (lang, half, key, n) of the rows: of the n-grams that belong to the model, whatever their number.

    What comes to the driver is the model itself, bounded by the languages' letters and not by the number of texts; its
    size is checked before, and a larger one is refused rather than made another model. It comes as Arrow columns with the
    languages as a dictionary, 21 bytes a row, and never as Python rows.
    """
    held = written(count_grams(rows, text_col, lang_col, order), "grams")
    if least_count > 1:
        common = held.groupBy("lang", "key").agg(F.sum("n").alias("all")).filter(F.col("all") >= least_count).drop("all")
        held = held.join(common, ["lang", "key"], "left_semi")
    if held.count() > model_rows:
        raise ValueError(f"the model has more than {model_rows} n-grams: raise least_count, or model_rows where driver and workers have the memory")
    return held.orderBy("lang", "half", "key").toArrow().to_pandas(strings_to_categorical=True, self_destruct=True)


def model_of(counts: pd.DataFrame, order: int) -> Model | None:
    if counts.empty:
        return None
    if counts["half"].nunique() > 1:
        counts = counts.groupby(["lang", "key"], as_index=False, observed=True)["n"].sum()
    return kneser_ney({k: (g["key"].to_numpy(), g["n"].to_numpy()) for k, g in counts.groupby("lang", observed=True)}, order)


def unseen_losses(models: dict[int, Model], rows: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """half, lang, n, own, other: what the model of the other half makes of every labelled row with a letter whose language it knows; written."""
    spread = rows.sparkSession.sparkContext.broadcast(models)

    def own_loss(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, model in spread.value.items():
                lot = pdf[(pdf["half"] == 1 - k) & pdf["lang"].isin(model.langs)]
                if lot.empty:
                    continue
                h, n = model.entropies(lot["text"].tolist())
                j = lot["lang"].map({x: i for i, x in enumerate(model.langs)}).to_numpy()
                own = h[np.arange(len(h)), j]
                h[np.arange(len(h)), j] = np.inf
                yield pd.DataFrame({"half": k, "lang": lot["lang"].to_numpy(), "n": n, "own": own, "other": np.minimum(h.min(axis=1), 1e3)})

    asked = small_batches(rows).select(half(F.col(text_col)).alias("half"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return written(asked.mapInPandas(own_loss, "half int, lang string, n long, own double, other double").filter("n > 0"), "unseen")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, least_count: int = LEAST_COUNT, model_rows: int = MODEL_ROWS) -> Model | None:
    """A model of all rows of docs with a language, calibrated by what a model of the one half makes of the other; None if there are none with a letter."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = gathered(rows, text_col, lang_col, order, least_count, model_rows)
    model, part = model_of(counts, order), model_of(counts[counts["half"] == 0], order)
    if part is None:
        return model
    return calibrated({0: model}, unseen_losses({0: part}, rows, text_col, lang_col))[0]


def crossed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, least_count: int = LEAST_COUNT, model_rows: int = MODEL_ROWS) -> dict[int, Model | None]:
    """For each half of docs, the model of the other half, calibrated on the half that it is for. Without text in one half there is one model, of all rows, and no bound."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = gathered(rows, text_col, lang_col, order, least_count, model_rows)
    models = {k: model_of(counts[counts["half"] == k], order) for k in (0, 1)}
    if None in models.values():
        return dict.fromkeys((0, 1), model_of(counts, order))
    found = calibrated(models, unseen_losses(models, rows, text_col, lang_col))
    return {1 - k: m for k, m in found.items()}


def calibrated(models: dict[int, Model], seen: DataFrame) -> dict[int, Model]:
    """Bounds by language and length band from losses of all texts that were not trained on. Strength: the length at which confidence fits them best.

    A band of few rows takes its language's median, and the deviation that its length leads to expect; a language of few rows takes those of all.
    Medians are exact; a row a language and band, some hundred, comes to the driver.
    """
    seen = seen.withColumn("band", F.least(F.lit(LAST_BAND), F.floor(F.log2(F.greatest(F.col("n"), F.lit(1)))).cast("int")))
    counts = {(r["half"], r["lang"], r["band"]): r["count"] for r in seen.groupBy("half", "lang", "band").count().collect()}
    if not counts:
        return models
    size = lambda k, lang: sum(c for (h, g, _), c in counts.items() if (h, g) == (k, lang))
    # a null language stands for all
    few = any(size(k, lang) < BAND_ROWS for k, m in models.items() for lang in m.langs)
    held = seen.select("half", "lang", "band", "n", "own")
    held = held.unionByName(held.withColumn("lang", F.lit(None).cast("string"))) if few else held

    def medians(rows: DataFrame, value: str, by: tuple[str, ...]) -> dict[tuple, float]:
        found = ranges.percentiles(rows, value, [0.5], by).select(*by, F.col("q")[0].alias("m")).collect()
        return {tuple(r)[:-1]: r["m"] for r in found}

    def less(found: dict, by: tuple[str, ...]) -> DataFrame:
        """held with the distance of `own` from the median of its group."""
        table = held.sparkSession.createDataFrame([(*g, m) for g, m in found.items()], ", ".join(f"{b} {dict(held.dtypes)[b]}" for b in by) + ", m double")
        return ranges.meet(held, F.broadcast(table), list(by)).withColumn("d", F.abs(F.col("own") - F.col("m")))

    whole, banded = ("half", "lang"), ("half", "lang", "band")
    middle, middles = medians(held, "own", whole), medians(held, "own", banded)
    root = F.sqrt(F.least(F.col("n"), F.lit(1 << LAST_BAND)).cast("double"))
    units = medians(less(middle, whole).withColumn("d", F.col("d") * root), "d", whole)
    spreads = medians(less(middles, banded), "d", banded)
    z = lambda s: (F.col("own") - F.col("other")) * F.least(F.col("n").cast("double"), F.lit(s))
    lengths = (2.0, 5.0, 10.0, 20.0, 40.0)
    fits = seen.groupBy("half").agg(*[F.avg(F.greatest(z(s), F.lit(0.0)) + F.log1p(F.exp(-F.abs(z(s))))).alias(str(s)) for s in lengths]).collect()
    for k, model in models.items():
        loss = next((r for r in fits if r["half"] == k), None)
        if loss is None:
            continue
        model.strength = min(lengths, key=lambda s: loss[str(s)])
        model.limit = np.empty((len(model.langs), LAST_BAND + 1))
        for j, lang in enumerate(model.langs):
            g = lang if size(k, lang) >= BAND_ROWS else None
            for b in range(LAST_BAND + 1):
                n = counts.get((k, g, b), 0) if g is not None else sum(c for (h, _, o), c in counts.items() if (h, o) == (k, b))
                at = middle[k, g] if n < BAND_ROWS else middles[k, g, b]
                deviation = 1.4826 * (units[k, g] / 2 ** (b / 2) if n < BAND_ROWS else spreads[k, g, b])
                model.limit[j, b] = at + DEVIATIONS * max(deviation, LEAST_DEVIATION * at)
    return models


def identify(model: Model | None, text: Column, spark) -> Column:
    """A struct of lang, score, loss, rejected for the text column."""
    if model is None:
        return F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("loss"), F.lit(True).alias("rejected"))
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, loss double, rejected boolean")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield held.value.predict(texts.tolist())

    return predicted(text)


def held_out(id_col: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.pmod(F.crc32(text_or_empty(id_col.cast("string"))), F.lit(folds)) == fold


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """For every row: id, held_out, lang_pred, score, rejected. Trained on the rows that are not held out."""
    model = train(docs.filter(~held_out(F.col(id_col))), id_col, text_col, lang_col)
    rows = small_batches(docs).select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), identify(model, F.col(text_col), docs.sparkSession).alias("found"))
    return rows.select(id_col, "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.rejected").alias("rejected"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose text is not rejected by the model of the half that the text is not in, with all their columns.

    A text with letters in a labelled language that the other half lacks cannot be judged and stays.
    """
    models = crossed(docs, id_col, text_col, lang_col)
    held = docs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("boolean")
    def kept(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, langs, halves in batches:
            out = np.zeros(len(texts), dtype=bool)
            for k, model in held.value.items():
                at = np.flatnonzero(halves == k)
                if len(at) and model is not None:
                    found = model.predict(texts.iloc[at].tolist())
                    unknown = langs.iloc[at].notna().to_numpy() & ~langs.iloc[at].isin(model.langs).to_numpy()
                    out[at] = ~found["rejected"] | (unknown & (found["lang"] != "und").to_numpy())
            yield pd.Series(out)

    return small_batches(docs).filter(kept(F.col(text_col), F.col(lang_col), half(text_or_empty(F.col(text_col)))))
