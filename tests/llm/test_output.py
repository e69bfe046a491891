"""Token-id files, collocations and fill-in-the-middle against brute force and exact round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slidelake.llm import bit_planes, collocations, fill_middle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, id string, part string, n int, a string, chunk int, units int, form string"


def frame(spark, rows):
    """With columns whose names clash with those that operators make."""
    return spark.createDataFrame([(*r, *[None] * 10) for r in rows], DOCS)


# token ids


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bit_planes.VOCABULARY)


def wanted_ids(tokenizer, rows, order):
    """id, start, n_tokens, ids_crc32 in the order."""
    out, start = [], 0
    for i, text, _ in sorted(rows, key=order):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


TEXTS = [
    None, "", "  \t\n ", "It's what they'LL say: don't!", "ÉCOLE école école naïve", "Σίσυφος ΟΔΟΣ", "a\x01b \x01 c\x01", "x\x1cy z w\x85v", "<|endoftext|> <|startoftext|>x <|ENDOFTEXT|>",
    "日本語 テキスト", "😀😀 12345 3.14", "w" * 5000, "un" * 60 + " " + "re" * 31, " ".join(f"word{i}" for i in range(3000)), "́ leading mark", "İstanbul ǅ",
]


def test_ids_of_whole_documents(spark, tokenizer):
    r = random.Random(1)
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(1000 - i, " ".join(r.choice(("alpha", "Beta,", "c-d", "Éa")) for _ in range(r.randint(0, 80))), "en") for i in range(200)] + [(-5, "below zero", "en")]
    got = sorted(tuple(x) for x in bit_planes.id_digest(frame(spark, rows), file_ids=700, block=256).collect())
    assert got == sorted(wanted_ids(tokenizer, rows, lambda x: x[0]))


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_ties_nulls_and_one_id_for_all(spark, tokenizer, unit):
    rows = [(7, f"same id {i % 3}", "en") for i in range(300)] + [(None, "no id", "en"), (None, "no id", "en"), (6, "six", "en"), (8, "eight", "en")]
    got = [tuple(x) for x in bit_planes.id_digest(frame(spark, rows), unit=unit, file_ids=100).collect()]
    assert len(got) == len(rows)
    got.sort(key=lambda x: x[1])
    # gapless, nulls first, equal texts of one id together
    assert [x[1] for x in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    assert [x[0] for x in got] == [None, None, 6, *[7] * 300, 8]
    assert Counter(x[3] for x in got if x[0] == 7) == Counter(x[3] for x in wanted_ids(tokenizer, rows[:300], lambda x: x[1]))
    assert len({x[3] for x in got[3:103]}) == len({x[3] for x in got[103:203]}) == 1
    assert bit_planes.id_digest(frame(spark, [])).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from(["bit", "byte"]), st.integers(1, 64), st.data())
@settings(max_examples=60, deadline=None)
def test_files_and_windows(values, unit, block, data):
    ids = np.array(values, dtype=np.uint32)
    cut = sorted(data.draw(st.lists(st.integers(0, len(ids)), max_size=5)))
    lengths = np.diff([0, *cut, len(ids)]).tolist()
    names = [data.draw(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1))) for _ in lengths]
    found = bit_planes.file_of(ids, names, lengths, 3, 99, unit, block) + b"\n"
    index = bit_planes.index_of(found)
    assert (index["n_ids"], index["n_docs"], index["part"], index["first"]) == (len(ids), len(lengths), 3, 99)
    a, b = sorted((data.draw(st.integers(0, len(ids))), data.draw(st.integers(0, len(ids)))))
    assert bit_planes.window(found, a, b).tolist() == values[a:b] and bit_planes.window(found, 0, 10**9).tolist() == values
    doc_ids, nulls, n = bit_planes.documents_of(found)
    assert [None if z else int(d) for d, z in zip(doc_ids, nulls)] == names and n.tolist() == lengths


def test_a_window_touches_its_blocks_alone():
    ids = np.arange(1000, dtype=np.uint32)
    whole = bytearray(bit_planes.file_of(ids, [1], [1000], block=100) + b"\n")
    index = bit_planes.index_of(bytes(whole))
    for k, (at, sizes) in enumerate(index["blocks"]):
        if k not in (3, 4):
            whole[at : at + sum(sizes)] = b"\xff" * sum(sizes)
    assert bit_planes.window(bytes(whole), 320, 480).tolist() == list(range(320, 480))
    with pytest.raises(Exception):
        bit_planes.window(bytes(whole), 290, 310)
    with pytest.raises(ValueError):
        bit_planes.index_of(bytes(whole[:-3]))


def test_planes():
    v = np.array([1, 256, 3, 2**31], dtype=np.uint32)
    assert bit_planes.to_planes(v, "byte") == [b"\x01\x00\x03\x00", b"\x00\x01\x00\x00", b"", b"\x00\x00\x00\x80"]
    assert bit_planes.to_planes(v, "bit")[:2] == [b"\xa0", b"\x20"] and sum(map(bool, bit_planes.to_planes(v, "bit"))) == 4


def test_a_worker_that_forgets(tokenizer, monkeypatch):
    monkeypatch.setattr(bit_planes, "MEMORY", 7)
    monkeypatch.setattr(bit_planes, "PIECE", 40)
    encoder = bit_planes.Encoder(bit_planes.VOCABULARY)
    got = list(encoder.texts((t or "").encode() for t in TEXTS * 2))
    assert got == [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in TEXTS * 2]


# collocations


def brute(rows, least, top=2000, subsumed=80, longest=4):
    table = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(table)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in good.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        rank = []
        for p, a in good.items():
            if p in inside and 100 * inside[p] >= subsumed * a:
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rank.append((-score, -a, " ".join(p).encode(), " ".join(p), a, counts[p[:k]], counts[p[k:]]))
        for place, (s, _, _, phrase, a, l, r) in enumerate(sorted(rank)[:top], 1):
            out.append((lang, place, phrase, a, l, r, n[lang], -s))
    return sorted(out)


def phrases(seed, n):
    r = random.Random(seed)
    words = ["a", "A", "b", "the", "New", "york", "é", "É", "x\x1cy", "日本"]
    rows = []
    for i in range(n):
        text = "".join(r.choice(words) + r.choice((" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!")) for _ in range(r.randint(0, 60)))
        rows.append((i % 50, text, r.choice(("en", "de", None))))
    rows += [(1, "the new york times is new york " * 8, "en"), (2, None, "en"), (3, "", None), (4, "one two", "rare"), (None, " \t.,", None), (5, "hot pair " * 3000, "en")]
    return rows


@pytest.mark.parametrize(("chunk", "bucket", "top", "least"), [(1 << 20, 1 << 20, 2000, 5), (300, 100, 2000, 5), (40, 1000, 7, 12)])
def test_collocations(spark, monkeypatch, chunk, bucket, top, least):
    monkeypatch.setattr(collocations, "BUCKET", bucket)
    rows = phrases(chunk, 250)
    got = sorted(tuple(r) for r in collocations.collocations(frame(spark, rows), least=least, top=top, chunk_words=chunk).collect())
    want = brute(rows, least, top)
    assert got == want and len(want) > 12


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(1, None, "en"), (2, "a b", None)]), least=1).collect() == [("und", 1, "a b", 1, 1, 1, 2, 1000000)]


def test_products_beyond_64_bits(spark):
    a = 5 * 10**18
    found = spark.createDataFrame([("en", "p q", a, [a], [a], None), ("en", "r s", a, [a + 1], [a], a), ("en", "t u v", 3, [4, 3], [5, 3], 2)], "lang string, phrase string, a long, heads array<long>, tails array<long>, longer long")
    got = {r["phrase"]: (r["l"], r["r"], r["score"]) for r in collocations.scored(found).collect()}
    assert got == {"p q": (a, a, 1000000), "t u v": (3, 5, 6000000 // 8)}


def test_packing():
    for v in (np.zeros(0, np.int32), np.arange(-5, 70000, dtype=np.int32), np.array([2**62, -1, 7])):
        assert collocations.unpacked(collocations.packed(v), v.dtype.str).tolist() == v.tolist()


# fill in the middle


def grammar_pieces(unit, text):
    return re.findall(fill_middle.GRAMMARS[unit][0], text)


def test_splits_follow_their_grammars(spark):
    r = random.Random(2)
    texts = ["", "\n", "\n\n", "a", "a\n", "\na", "a\nb\r\n\nc", "é😀\n日本\n", " x", "x ", "a.b!?c. d", "...", " a\u0085b\x0bc\n"] + ["".join(r.choice("ab \t\n.!é😀") for _ in range(r.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for unit in fill_middle.GRAMMARS:
        for row in df.select("t", fill_middle.units(F.col("t"), unit).alias("u")).collect():
            assert row.u == grammar_pieces(unit, row.t), (unit, row.t)
            assert "".join(row.u) == row.t


def by_hand(i, text, unit="line", seed=7, rate=100, spm=50):
    text = text or ""
    pieces, h = grammar_pieces(unit, text), hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(pieces)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(pieces[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"


def middles(seed=3):
    r = random.Random(seed)
    rows = [(i, "".join(r.choice(("ab", "<", "P>", "S", "é😀", "\n", "\r\n", " ", "<M", ">")) for _ in range(r.randint(0, 40))), "en") for i in range(400)]
    return rows + [(5, "one\ntwo\nthree", "en"), (5, "one\ntwo\nthree", "en"), (None, "no\nid\n", "en"), (900, None, "en"), (901, "has <P> in it\n", "en"), (902, "x\n" * 20000, "en"), (903, "y" * 100000, "en")]


@pytest.mark.parametrize("how", [{}, {"unit": "word", "seed": 1, "rate": 60, "spm": 20}])
def test_fill_in_middle(spark, how):
    rows = middles()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted(map(str, (tuple(r) for r in fill_middle.fim_digest(frame(spark, rows), **how).collect())))
    want = [(i, *(w := by_hand(i, t, **how))[:4], sha(w[4]), sha(t or "")) for i, t, _ in rows]
    assert got == sorted(map(str, want))
    made = fill_middle.fill_in_middle(frame(spark, rows), **how).filter("form <> 'plain'").collect()
    assert all(r.prefix + r.middle + r.suffix == r.text for r in made) and {r.form for r in made} == {"psm", "spm"}
    assert fill_middle.fim_digest(frame(spark, [])).count() == 0


@given(st.text("<>PSMab\n", max_size=40), st.integers(0, 10**6))
@settings(max_examples=300, deadline=None)
def test_marks_cannot_arise_where_parts_meet(text, i):
    n, form, _, _, output = by_hand(i, text)
    if form != "plain":
        assert all(output.count(m) == 1 for m in ("<P>", "<S>", "<M>"))
