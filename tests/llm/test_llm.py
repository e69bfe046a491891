"""The corpus operators against brute force, on small tables with nulls, ties, repeats and clashing names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidelake.llm import bagminhash, common, exact_dedup, fingerprint, html_blocks, langid, mixing, sharding, token_count, unigram, warc

WORDS = [f"w{i}" for i in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def changed(t, places):
    words = t.split(" ")
    for p in places:
        words[p] = f"x{p}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, source)"""
    base = text(1, 120)
    out = [(0, base, "en", "a"), (1, base, "en", "b"), (2, changed(base, [60]), "en", "a"), (3, changed(base, [5, 30, 60, 90]), "en", "a"), (4, base.replace(" ", "\n\t"), "en", None), (5, None, "en", "a"), (6, "", None, "b"), (7, " \t\n", "en", "b"), (8, "one two", "en", "c"), (9, "one two", "en", "c")]
    out += [(10 + i, text(100 + i, 10 + 7 * i), "en", "abc"[i % 3]) for i in range(25)]
    out += [(50, text(7, 3000), "en", "z")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names clash with those that operators make."""
    made = [(*r, len(r[1] or ""), 1, "x", "y", 2, "z") for r in rows]
    return spark.createDataFrame(made, DOCS + ", size long, id string, node string, keep_id int, source_size string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def collected(df):
    return [r.asDict() for r in df.collect()]


def test_words(spark):
    df = spark.createDataFrame([(None,), ("",), (" a\tb\x0bc d ",)], "t string")
    assert [r[0] for r in df.select(common.word_count(df.t)).collect()] == [0, 0, 3]


# exact dedup


def test_exact_groups_against_brute_force(docs, rows, empty):
    strip = lambda t: (t or "").translate({ord(c): None for c in common.SPACES})
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[strip(t)].append((-len(t or ""), i))
    got = {r["doc_id"]: r for r in collected(exact_dedup.exact_groups(docs))}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        g = groups[strip(t)]
        best = min(g)[1]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (best, len(g), best == i)
        assert got[i]["text_sha256"] == hashlib.sha256(strip(t).encode()).hexdigest()
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.exact_dedup(docs).count() == len(groups)


def test_exact_groups_tell_colliding_hashes_apart(spark, monkeypatch):
    """With one hash for all texts the bytes decide."""
    real = exact_dedup.hashed
    monkeypatch.setattr(exact_dedup, "hashed", lambda *a: real(*a).selectExpr("id", "n", "X'00' AS hash", "norm"))
    df = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c"), (4, "c"), (5, "d"), (None, "e")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in collected(exact_dedup.exact_groups(df))}
    assert got == {1: (1, 2, True), 2: (1, 2, False), 3: (3, 2, True), 4: (3, 2, False), 5: (5, 1, True), None: (None, 1, True)}


# sharding


def test_sharding(docs, rows, empty):
    got = collected(sharding.sharded(docs, shards=5, n_slots=64))
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"} and all(r["grown_shard"] is None for r in got)
    by = {r[0]: r[1] for r in rows}
    places = defaultdict(list)
    for r in got:
        t = (by[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 16 and r["text_crc32"] == zlib.crc32(t)
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert collected(sharding.sharded(docs, 5, 64).orderBy("doc_id")) == sorted(got, key=lambda r: r["doc_id"])
    assert sharding.sharded(empty, 5, 64).count() == 0


def test_shards_are_even_and_growth_moves_into_new_shards_alone():
    r = random.Random(3)
    stats = {s: (r.randint(1, 5000), 1) for s in range(2000)}
    load = lambda held, n: [sum(stats[s][0] for s in range(2000) if held[s] == k) for k in range(n)]
    first = sharding.first_map(stats, 2000, 40)
    assert max(load(first, 40)) <= 1.01 * min(load(first, 40))
    grown = sharding.edited_map(first, stats, 40, 42)
    assert all(a == b or b >= 40 for a, b in zip(first, grown))
    assert max(load(grown, 42)) <= 1.1 * sum(v[0] for v in stats.values()) / 42
    assert min(load(grown, 42)) >= 0.9 * sum(v[0] for v in stats.values()) / 42


def test_map_versions_are_stored(spark, tmp_path):
    stats, path = {s: (10, 2) for s in range(16)}, str(tmp_path / "map")
    assert sharding.load_map(spark, path) is None
    first = sharding.current_map(spark, path, stats, 16, 4)
    assert first == (1, sharding.first_map(stats, 16, 4)) == sharding.current_map(spark, path, {}, 16, 4)
    version, two = sharding.current_map(spark, path, stats, 16, 5)
    assert version == 2 and sharding.load_map(spark, path) == (2, two, 5) and sharding.load_map(spark, path, 1) == (*first, 4)
    assert {s for s in range(16) if first[1][s] != two[s]} == {s for s in range(16) if two[s] == 4}
    with pytest.raises(ValueError):
        sharding.current_map(spark, path, stats, 16, 4)


@pytest.mark.parametrize("stats", [{}, {5: (300, 1), 77: (20, 1)}, {s: (1000 + s, 1) for s in range(20)}])
def test_growth_on_few_rows_makes_one_version(spark, tmp_path, stats):
    path = str(tmp_path / "few")
    made = [sharding.current_map(spark, path, stats, 512, n) for n in (40, 40, 60, 60, 60)]
    assert [v for v, _ in made] == [1, 1, 2, 2, 2] and set(made[-1][1]) == set(range(60))
    assert all(a == b or b >= 40 for a, b in zip(made[0][1], made[2][1]))
    with pytest.raises(Exception, match="exists"):
        sharding.store_map(spark, path, made[0][1], 2, 40)


def test_an_uneven_map_of_as_many_shards_is_edited(spark, tmp_path):
    r, path = random.Random(4), str(tmp_path / "uneven")
    before = {s: (r.randint(1, 500), 1) for s in range(1000)}
    one = sharding.current_map(spark, path, before, 1000, 10)
    after = {s: (b * (8 if one[1][s] == 3 else 1), n) for s, (b, n) in before.items()}
    version, held = sharding.current_map(spark, path, after, 1000, 10)
    load = lambda held, stats: [sum(stats[s][0] for s in range(1000) if held[s] == k) for k in range(10)]
    share = sum(b for b, _ in after.values()) / 10
    assert version == 2 and max(load(held, after)) <= 1.1 * share < max(load(one[1], after))
    assert {one[1][s] for s in range(1000) if one[1][s] != held[s]} == {3}
    assert sharding.current_map(spark, path, after, 1000, 10) == (2, held)
    # one slot that is more than a share cannot be split
    assert sharding.rebalanced_map([0, 0, 1], {0: (100, 1), 1: (1, 1), 2: (1, 1)}, 2) in ([0, 1, 1], [1, 0, 1], [1, 0, 0])


def test_grown_data_moves_rows_into_new_shards_alone(spark, tmp_path):
    made = lambda n: spark.createDataFrame([(i, text(i, 1 + i % 40)) for i in range(n)], "doc_id long, text string")
    at = lambda n, shards: {r["doc_id"]: (r["shard"], r["slot"], r["map_version"]) for r in sharding.sharded(made(n), shards, 256, str(tmp_path / "m"), slack=9.0).collect()}
    one, grown, more = at(300, 6), at(900, 6), at(900, 8)
    assert all(grown[i][0] == one[i][0] for i in one) and {v[2] for v in grown.values()} == {1}
    assert all(more[i][0] == grown[i][0] or more[i][0] >= 6 for i in grown) and {v[2] for v in more.values()} == {2}
    for found in (one, grown, more):
        places = defaultdict(list)
        for shard, slot, _ in found.values():
            places[shard].append(slot)
        assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert {v[0] for v in more.values()} == set(range(8))


def test_forty_shards_against_a_map_made_by_hand(spark):
    """The query's own parameters on the smallest documents: sizes, slots and the map by plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = collected(sharding.sharded(docs))
    by = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    load, slots = Counter(), defaultdict(int)
    for r in got:
        assert (r["size"], r["text_crc32"]) == (len(by[r["doc_id"]]) + 16, zlib.crc32(by[r["doc_id"]]))
        load[r["shard"]] += r["size"]
        slots[r["vslot"]] += r["size"]
    loads = [(0, s) for s in range(40)]
    for _, size in sorted(((s, b) for s, b in slots.items()), key=lambda x: (-x[1], x[0])):
        loads.sort()
        loads[0] = (loads[0][0] + size, loads[0][1])
    assert sorted(load.values()) == sorted(x for x, _ in loads)
    assert max(load.values()) <= 1.05 * min(load.values()) or max(load.values()) == max(slots.values())


# mixing


def water_fill(sizes, weights, budget, most):
    left, goal, over = dict(weights), {}, budget
    while left:
        level = over / sum(left.values())
        full = [s for s in left if level * left[s] > most * sizes[s]]
        if not full:
            return goal | {s: level * w for s, w in left.items()}
        for s in full:
            goal[s] = most * sizes[s]
            over -= goal[s]
            del left[s]
    return goal


def test_mixed_meets_targets(docs, rows, empty):
    got = {r["doc_id"]: r for r in collected(mixing.mixed(docs))}
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    source = {r[0]: r[3] for r in rows}
    sizes = defaultdict(int)
    for i, s in source.items():
        sizes[s] += size[i]
    names = sorted((s for s in sizes if s is not None)) + [None]
    goals = water_fill(sizes, {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}, sum(sizes.values()), 3)
    taken = defaultdict(int)
    for i, r in got.items():
        assert r["size"] == size[i] and r["source_size"] == sizes[source[i]] and r["target"] == pytest.approx(goals[source[i]])
        assert r["taken"] <= 3 * size[i] and r["taken"] == r["size"] * r["repeats"]
        taken[source[i]] += r["taken"]
    for s in sizes:
        least = min(size[i] for i in size if source[i] == s and size[i])
        assert abs(taken[s] - goals[s]) <= max(least, 1)
    assert {r["doc_id"]: r["taken"] for r in collected(mixing.mixed(docs))} == {i: r["taken"] for i, r in got.items()}
    assert mixing.mixed(empty).count() == 0
    again = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert again == Counter({i: r["repeats"] for i, r in got.items() if r["repeats"]})


@pytest.mark.parametrize("seed", range(40))
def test_budget_is_fitted_as_near_as_any_choice(seed):
    r = random.Random(seed)
    lengths = np.array(sorted(r.sample(range(1, 60), r.randint(1, 6))))
    counts = np.array([r.randint(1, 5) for _ in lengths])
    budget = r.randint(0, int((lengths * counts).sum()) + 5)
    got = mixing.fit_budget(lengths, counts, budget)
    assert (got >= 0).all() and (got <= counts).all()
    sums = {0}
    for x, c in zip(lengths.tolist(), counts.tolist()):
        sums = {s + k * x for s in sums for k in range(c + 1)}
    assert abs(int((got * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_large_budget_is_met_exactly():
    lengths, counts = np.arange(1, 3000), np.full(2999, 50)
    budget = 123_456_789
    assert int((mixing.fit_budget(lengths, counts, budget) * lengths).sum()) == budget


# fingerprints


def entropy_bin(window):
    c = Counter(window)
    return 1000 - (sum(int(round(n * np.log2(n) * (1 << 16))) for n in c.values()) * 1000) // (384 << 16)


def brute_selection(data, rank):
    if len(data) < 64:
        return [0] if data else []
    r = [rank[entropy_bin(data[i : i + 64])] for i in range(len(data) - 63)]
    votes = Counter()
    for i in range(len(r) - 63):
        votes[min(range(i, i + 64), key=lambda j: (r[j], j))] += 1
    return sorted(j for j, n in votes.items() if n >= 16) or [min(range(len(r)), key=lambda j: (r[j], j))]


def test_fingerprints_against_brute_force(spark, docs, rows, empty):
    raw = [(r[1] or "").encode() for r in rows]
    counts = np.zeros(1001, dtype=int)
    for data in raw:
        for i in range(len(data) - 63):
            counts[entropy_bin(data[i : i + 64])] += 1
    rank = fingerprint.corpus_rarity(docs)
    assert np.array_equal(rank, fingerprint.rarity(counts))
    for data, got in zip(raw, fingerprint.selected(raw, rank)):
        assert got.tolist() == brute_selection(data, rank)
    order = sorted(rows, key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in collected(fingerprint.digests(docs))}
    assert len(got) == len(rows)
    for k, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edit = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        a, b, c = fingerprint.chains([t.encode(), edit.encode(), after.encode()], rank)
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (fingerprint.written_out(a), fingerprint.written_out(b))
        assert got[i]["near_edited"] == pytest.approx(fingerprint.likeness(a, b)) and got[i]["near_next"] == pytest.approx(fingerprint.likeness(a, c))
        assert np.array_equal(fingerprint.read_back(got[i]["fingerprint"]), a)
    assert got[0]["fingerprint"] == got[1]["fingerprint"] and got[50]["near_edited"] > 0.5 > got[50]["near_next"]
    assert fingerprint.digests(empty).count() == 0
    odd = spark.createDataFrame([(None, "abc"), (1, "abcdef"), (None, None)], "doc_id long, text string")
    found = sorted(((r["doc_id"] or 0, r["n_chars"], r["near_next"]) for r in fingerprint.digests(odd).collect()), key=str)
    assert found == [(0, 0, None), (0, 3, None), (1, 6, 1.0)]


def test_long_texts_in_parts_are_as_whole(monkeypatch):
    data = text(9, 4000).encode()
    rank = fingerprint.rarity(fingerprint.bin_counts([data]))
    whole = fingerprint.selected([data], rank)[0]
    monkeypatch.setattr(fingerprint, "STEP", 1000)
    assert np.array_equal(fingerprint.rarity(fingerprint.bin_counts([data])), rank)
    assert np.array_equal(fingerprint.selected([data], rank)[0], whole)


# WARC


def test_archives_round_trip(spark, tmp_path):
    big, odd = "<p>" + "é" * 600 + "</p>", "a\r\n\r\nWARC/1.1\r\nb"
    pages = [(1, "http://a/1", big), (2, None, big), (3, "http://a/3\r\nX: y", odd), (4, "http://a/4", odd), (5, "u", None), (6, "u", big), (6, "u", big), (None, "u", big), (7, "u", "x" * 1000)]
    df = spark.createDataFrame([(*p, "d") for p in pages], "page_id long, url string, html string, digest string")
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.archived(df, str(tmp_path / "a")).collect()), key=str)
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        again = h == big and i in (1, 2)
        want.append((i or 0, "revisit" if again else "response", 6 if again else None, len(data), hashlib.sha1(data).hexdigest()))
    assert got == sorted(want, key=str)
    kept = {r["id"]: bytes(r["payload"]) for r in warc.read_archives(spark, str(tmp_path / "a")).filter("record_type = 'response'").collect()}
    assert kept[3] == odd.encode() and kept[6] == big.encode() and kept[5] == b""
    warc.rewritten(spark, str(tmp_path / "a"), str(tmp_path / "b"), least_bytes=5)
    types = Counter((r["id"], r["record_type"]) for r in warc.read_archives(spark, str(tmp_path / "b")).collect())
    assert types[3, "revisit"] == 1 and types[4, "response"] == 1 and types[1, "revisit"] >= 1
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(none, str(tmp_path / "c")).count() == 0


def test_records_of_many_members_and_archives_of_bounded_size(spark, tmp_path, monkeypatch):
    r = random.Random(9)
    data = bytes(r.randrange(256) for _ in range(5000))
    monkeypatch.setattr(warc, "MEMBER", 1000)
    import gzip

    assert gzip.decompress(warc.packed(data) + b"\0") == data and gzip.decompress(warc.packed(b"") + b"\0") == b""
    rows = [(i, "u", "x" * (70_000 if i % 10 == 0 else 10) + str(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "a"), archive_bytes=100_000)
    assert len(list((tmp_path / "a").glob("part-*"))) >= 7
    got = {x["id"]: bytes(x["payload"]).decode() for x in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert got == {i: h for i, _, h in rows}


def test_rewritten_archives_lose_no_record(spark, tmp_path):
    import base64
    import gzip

    from pyspark.sql import functions as F

    def made(kind, urn, block, **fields):
        lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {urn}", *[f"WARC-{k.replace('_', '-')}: {v}" for k, v in fields.items()], f"Content-Length: {len(block)}"]
        return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block

    http, big, other = b"HTTP/1.1 200 OK\r\n\r\n", b"\xff\xfe<p>" + b"x" * 2000, b"y" * 3000
    digest = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    through = [
        made("warcinfo", "<urn:uuid:0>", b"software: crawler\r\n\r\n"), made("request", "<urn:uuid:1>", b"GET / HTTP/1.1\r\n\r\n", Concurrent_To="<urn:uuid:a>"), made("resource", "<urn:uuid:2>", b"\x00\xff"),
        made("revisit", "<urn:uuid:3>", http, Refers_To="<urn:uuid:elsewhere>", Payload_Digest=digest(b"not here")),
        made("revisit", "<urn:uuid:4>", http, Refers_To="<urn:uuid:b>", Payload_Digest=digest(b"another")), made("revisit", "<urn:uuid:5>", http, Refers_To="<urn:uuid:b>"),
    ]
    # the id b is on two payloads; d names an original that is not here, whose payload is; e names one without a digest
    rest = [
        made("response", "<urn:uuid:a>", http + big, Date="2020-02-02T00:00:00Z"), made("response", "<urn:uuid:b>", http + big), made("response", "<urn:uuid:b>", http + other),
        made("revisit", "<urn:uuid:c>", http, Refers_To="<urn:uuid:b>", Payload_Digest=digest(big)), made("revisit", "<urn:uuid:d>", http, Refers_To="<urn:uuid:elsewhere>", Payload_Digest=digest(other)),
        made("revisit", "<urn:uuid:e>", http, Refers_To="<urn:uuid:a>"),
    ]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "crawl.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in through + rest))
    warc.rewritten(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    got = warc.read_records(spark, str(tmp_path / "b")).withColumn("sha1", F.coalesce("sha1", "digest")).collect()
    assert {r["http"] is None or bytes(r["http"]) == http for r in got} == {True}
    assert {r["date"] for r in got if r["urn"] == "<urn:uuid:a>"} == {"2020-02-02T00:00:00Z"}
    # one gzip member a record
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "b").glob("part-*")))
    members = 0
    while data:
        one = zlib.decompressobj(31)
        assert one.decompress(data).startswith(b"WARC/1.")
        data, members = one.unused_data, members + 1
    assert members == 12
    raw = [bytes(r["raw"]) for r in got if r["raw"] is not None]
    assert len(got) == 12 and all(raw.count(r) == 1 for r in through)
    assert Counter((r["urn"], r["sha1"]) for r in got if r["urn"][-2] in "abcde") == Counter((f"<urn:uuid:{k}>", hashlib.sha1(p).hexdigest()) for k, p in [("a", big), ("b", big), ("b", other), ("c", big), ("d", other), ("e", big)])
    assert sorted(bytes(r["payload"]) for r in got if r["payload"] is not None) == [other, big]


# token counts


def test_token_counts(spark, docs, rows, empty):
    vocabulary = set(token_count.read_vocabulary())
    longest = max(map(len, vocabulary))

    def greedy(word):
        n = i = 0
        while i < len(word):
            i = next(j for j in range(min(len(word), i + longest), i, -1) if word[i:j] in vocabulary)
            n += 1
        return n

    got = {r["doc_id"]: r for r in collected(token_count.token_counts(docs))}
    for i, t, *_ in rows:
        words = (t or "").encode().split()
        assert (got[i]["n_words"], got[i]["n_tokens"]) == (len(words), sum(greedy(b" " + w) for w in words))
    assert token_count.token_counts(empty).count() == 0
    automaton, r = token_count.Automaton(sorted(vocabulary)), random.Random(5)
    for _ in range(3000):
        word = bytes(r.choice(b"aetnoTHE\xc3\xa9\xff0-") for _ in range(r.randint(1, 30)))
        assert automaton.count(word) == greedy(word)


def test_automaton_with_pieces_that_overlap():
    base = [bytes([b]) for b in range(256)]
    automaton = token_count.Automaton([*base, b"ab", b"abcde", b"cd", b"bcd"])
    assert [automaton.count(w) for w in (b"abcd", b"abcde", b"abcdx", b"", b"bcdab")] == [2, 1, 3, 0, 2]
    with pytest.raises(ValueError):
        token_count.Automaton([b"a"])


# near duplicates


def bag(t):
    w = (t or "").encode().split()
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else Counter()


def weighted(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows):
    bags = {i: bag(t) for i, t, *_ in rows}
    label = {i: i for i in bags}
    for a in sorted(bags):
        for b in bags:
            if a < b and weighted(bags[a], bags[b]) >= 0.8 and bags[a]:
                x, y = label[a], label[b]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    return label


def test_near_classes_against_brute_force(spark, docs, rows, empty):
    got = {r["doc_id"]: r["class_id"] for r in collected(bagminhash.near_classes(docs))}
    assert got == brute_classes(rows)
    assert bagminhash.near_classes(empty).count() == 0
    assert {r["doc_id"] for r in bagminhash.near_dedup(docs).collect()} == set(got.values())


def test_recall_of_queries_against_all_documents(spark):
    """Queries are the documents whose id 100 divides; brute force over all."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_classes(docs).collect()}
    rows = docs.collect()
    bags = {r["doc_id"]: bag(r["text"]) for r in rows}
    pairs = [(a, b) for a in bags if a % 100 == 0 for b in bags if a != b and bags[a] and weighted(bags[a], bags[b]) >= 0.8]
    assert all(got[a] == got[b] for a, b in pairs)


def test_buckets_with_repeated_members_are_told_apart(spark):
    """Two buckets that differ in a member that is there twice alone: both give their links."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    texts = spark.createDataFrame([(1, words(1)), (7, words(1)), (2, words(2)), (8, words(2))], "node long, text string")
    members = spark.createDataFrame([(b, 56, n) for b, twice in ((10, 7), (20, 8)) for n in (twice, twice, 1, 2)], "bucket long, size long, node long")
    labels = spark.createDataFrame([(n, n) for n in (1, 2, 7, 8)], "node long, label long")
    found = {tuple(sorted(r)) for r in bagminhash.links_across(members, labels, texts, 0.8).collect()}
    assert found == {(1, 7), (2, 8)}


def test_near_classes_at_a_similarity_of_one(spark):
    base = [f"w{i}" for i in range(600)]
    changed = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in range(590, 600)]
    rows = list(enumerate([*changed, changed[3], changed[3]]))
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), similarity=1.0).collect()}
    assert got == {**{k: k for k in range(10)}, 10: 3, 11: 3}


def test_near_classes_of_large_and_chained_groups(spark):
    base = text(11, 200)
    rows = [(i, changed(base, [(3 * i) % 200])) for i in range(40)]
    chain = text(12, 100)
    for k in range(12):
        chain = changed(chain, [8 * k])
        rows.append((100 + k, chain))
    rows += [(200 + i, text(300 + i, 60)) for i in range(60)] + [(None, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in collected(bagminhash.near_classes(df))}
    assert got.pop(None) is None
    assert got == brute_classes([(*r,) for r in rows if r[0] is not None])


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(2)
    keys = r.integers(1, 1 << 62, 200).astype(np.uint64)
    a, b = r.integers(1, 40, 200), r.integers(1, 40, 200)
    held = bagminhash.bag_minhash(np.concatenate([keys, keys]), np.concatenate([a, b]), np.repeat([0, 1], 200), 2, 8192)
    assert abs((held[0] == held[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.02
    alone = bagminhash.bag_minhash(keys, a, np.zeros(200, dtype=int), 1, 8192)
    assert np.array_equal(alone[0], held[0])


def test_words_of_long_texts(monkeypatch):
    t = text(4, 500)
    (whole,) = next(bagminhash.document_words([t]))[1]
    monkeypatch.setattr(bagminhash, "CHUNK", 300)
    (parts,) = next(bagminhash.document_words([t]))[1]
    assert np.array_equal(whole, parts) and len(whole) == 500


def test_components(spark):
    r = random.Random(8)
    links = [(i, i + 1) for i in range(0, 30)] + [(100, x) for x in range(101, 160)] + [(r.randint(200, 260), r.randint(261, 300)) for _ in range(40)]
    got = {x["node"]: x["label"] for x in bagminhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {x: x for e in links for x in e}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


# languages


def test_languages_held_out_accuracy(spark, empty):
    from pyspark.sql import functions as F

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    more = spark.createDataFrame([(-1, None, "en"), (-2, " 12 *** 34", "en"), (-3, "", None), (None, "the thing of the", None)], "doc_id long, text string, lang string")
    got = langid.languages(df.select("doc_id", "text", "lang").union(more)).join(df.select("doc_id", "lang"), "doc_id", "left").withColumn("right", F.col("lang") == F.col("lang_pred")).toPandas()
    assert got[got["held_out"] & (got["doc_id"] >= 0)]["right"].mean() > 0.99
    odd = got[got["doc_id"] < 0]
    assert (odd["lang_pred"] == "und").all() and (odd["score"] == 0).all() and odd["rejected"].all() and got["score"].between(0, 1).all()
    assert got[got["doc_id"] >= 0]["rejected"].mean() < 0.01
    assert langid.languages(empty).count() == 0


def test_language_rejection_of_noise_among_the_labelled_rows(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    n, r = docs.count(), random.Random(3)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(3, 9)))
    # 1 % noise in labelled rows, 1 % of a language that no label names, without label, and one mislabelled row, short and long; clean texts of a few words and of many
    noise = [(-1 - i, " ".join(word("abcdefghijklmnopqrstuvwxyz") for _ in range((8, 60, 900)[i % 3])), "en") for i in range(n // 100)]
    unseen = [(-1001 - i, " ".join(f"{word('бвгджзкл')}а" for _ in range((8, 60, 900)[i % 3])), None) for i in range(n // 100)] + [(-2001, " ".join(word("ωστυθλκαιε") for _ in range(60)), "fr")]
    first = docs.filter("lang = 'en'").limit(20).select((-F.col("doc_id") - 5_000_000).alias("doc_id"), F.array_join(F.slice(F.split("text", " "), 1, 12), " ").alias("text"), "lang")
    long = docs.filter("lang = 'de'").groupBy(F.expr("doc_id % 3 - 4000000").alias("doc_id")).agg(F.array_join(F.collect_list("text"), " ").alias("text"), F.lit("de").alias("lang"))
    kept = {x[0] for x in langid.keep_identified(docs.union(spark.createDataFrame(noise + unseen, docs.schema)).union(first).union(long)).select("doc_id").collect()}
    ids = lambda rows: {x[0] for x in rows.select("doc_id").collect()}
    assert not kept & {x[0] for x in noise + unseen}
    assert ids(long) <= kept and len(ids(first) - kept) <= 1 and len(ids(docs) - kept) < 0.005 * n


def test_language_bounds_come_from_all_rows(spark):
    """Exact medians of every row that the model has not seen, against numpy; a language of few rows takes those of all."""
    r = random.Random(5)
    rows = [(f"{r.choice(['aba', 'cad', 'bra', 'dab'])} " * r.randint(1, 40) + str(i), lang) for i in range(300) for lang in ("x", "y")] + [("aba cad", "z"), ("dab bra aba", "z")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    counts = langid.gathered(docs, "text", "lang", 4, 1, 10**6)
    part = langid.model_of(counts[counts["half"] == 0], 4)
    seen = langid.unseen_losses({0: part}, docs, "text", "lang")
    assert seen.count() == docs.filter(langid.half(F.col("text")) == 1).filter(F.col("lang").isin(part.langs)).count() > 200
    got, p = langid.calibrated({0: part}, seen)[0], seen.toPandas()
    bands = np.minimum(np.log2(p["n"]).astype(int), langid.LAST_BAND)
    for j, lang in enumerate(got.langs):
        of = p["lang"] == lang if (p["lang"] == lang).sum() >= langid.BAND_ROWS else p["n"] > 0
        own, whole = p["own"][of], np.median(p["own"][of])
        unit = 1.4826 * np.median(np.abs(own - whole) * np.sqrt(np.minimum(p["n"][of], 1 << langid.LAST_BAND)))
        for b in range(langid.LAST_BAND + 1):
            lot = own[bands[of] == b]
            middle, deviation = (whole, unit / 2 ** (b / 2)) if len(lot) < langid.BAND_ROWS else (np.median(lot), 1.4826 * np.median(np.abs(lot - np.median(lot))))
            assert got.limit[j, b] == pytest.approx(middle + langid.DEVIATIONS * max(deviation, langid.LEAST_DEVIATION * middle))
    fit = {s: np.logaddexp(0, (p["own"] - p["other"]) * np.minimum(p["n"], s)).mean() for s in (2.0, 5.0, 10.0, 20.0, 40.0)}
    assert got.strength == min(fit, key=fit.get)


def test_languages_of_few_rows_stay(spark):
    rows = [(1, "the thing of the other thing", "en"), (2, "das ding", "de"), (3, "12", "en"), (4, None, "en"), (5, "la chose", None)]
    kept = {x[0] for x in langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {1, 2} <= kept and not kept & {3, 4}


def test_kneser_ney_against_the_textbook():
    r = random.Random(4)
    texts = {k: ["".join(r.choice(a) for _ in range(r.randint(1, 6))) for _ in range(60)] for k, a in (("x", "abc"), ("y", "bcd"))}
    counts = {}
    for k, words in texts.items():
        keys = np.concatenate([langid.grams(at, lot, 3)[0] for at, lot in langid.pieces([" ".join(words)])])
        counts[k] = np.unique(keys, return_counts=True)
    model = langid.kneser_ney(counts, 3)

    def table_of(words):
        c = Counter()
        for w in words:
            s = ["\0", "\0", *w, "\0"]
            for i in range(2, len(s)):
                c[(s[i - 2] if s[i - 1] != "\0" else "\0", s[i - 1], s[i])] += 1
        two = Counter(g[1:] for g in c)
        return [Counter(g[1:] for g in two), two, c]

    alphabet = {g[0] for w in texts.values() for g in table_of(w)[0]}

    def p(levels, gram):
        if not gram:
            return 1 / (len(alphabet) + 1)
        level = levels[len(gram) - 1]
        n1, n2 = sum(v == 1 for v in level.values()), sum(v == 2 for v in level.values())
        d = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.05), 0.95)
        same = {g: v for g, v in level.items() if g[:-1] == gram[:-1]}
        if not same:
            return p(levels, gram[1:])
        total = sum(same.values())
        return max(level[gram] - d, 0) / total + d * len(same) / total * p(levels, gram[1:])

    for word in ("a", "abcd", "ddd", "bca"):
        keys = np.concatenate([langid.grams(at, lot, 3)[0] for at, lot in langid.pieces([word])])
        s = ["\0", "\0", *word, "\0"]
        for j, k in enumerate(model.langs):
            levels = table_of(texts[k])
            want = [-np.log(p(levels, (s[i - 2] if s[i - 1] != "\0" else "\0", s[i - 1], s[i]))) for i in range(2, len(s))]
            assert np.allclose(model.losses(keys)[:, j], want, atol=1e-4)


def test_language_pieces_do_not_matter():
    t = text(3, 3000)
    whole, parts = (np.concatenate([langid.grams(at, lot, 4)[0] for at, lot in langid.pieces([t], n)]) for n in (1 << 20, 500))
    assert np.array_equal(np.sort(whole), np.sort(parts))


# SentencePiece


def brute_unigram(pieces, data):
    """The best sum of scores, by dynamic programming over all substrings."""
    by = {t.encode(): i for i, t in enumerate(pieces.texts) if t}
    best = [0.0] + [-1e18] * len(data)
    for j in range(1, len(data) + 1):
        best[j] = best[j - 1] + pieces.scores[pieces.bytes_[0]]
        for i in range(max(0, j - 60), j):
            if data[i:j] in by:
                best[j] = max(best[j], best[i] + pieces.scores[by[data[i:j]]])
    return best[-1]


@pytest.fixture(scope="module")
def encoder():
    return unigram.Encoder(unigram.read_pieces())


def test_viterbi_against_brute_force_and_round_trip(encoder):
    odd = ["Hello  world", " lead", "tab\tnl\n", "日本語 \U0001f600 é", "", "a" * 300, "\x00\x7f", text(5, 50), "   ", "x y"]
    for t, ids in zip(odd, encoder.encode_all(odd)):
        assert encoder.decode(ids) == t
        got = sum(encoder.pieces.scores[i] for i in ids)
        assert not t or got == pytest.approx(brute_unigram(encoder.pieces, ("▁" + t.replace(" ", "▁")).encode()))


def test_stretches_without_spaces(encoder, monkeypatch):
    """Chinese, Base64, one letter many times and equal scores, as a plain search has them, and cut in small steps as in one."""
    import base64
    import time

    r = random.Random(6)
    chinese = "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(400)) + "。" + "的" * 80
    coded = base64.b64encode(bytes(r.randrange(256) for _ in range(900))).decode()
    texts = [chinese, coded, "a" * 700, "ab" * 300, "=" * 300 + "-" * 300, "internationalization" * 20, "x" * 5000]
    for t, ids in zip(texts, encoder.encode_all(texts)):
        data = ("▁" + t).encode()
        assert encoder.decode(ids) == t
        assert sum(encoder.pieces.scores[i] for i in ids) == pytest.approx(brute_unigram(encoder.pieces, data))
        assert b"".join(encoder.cut(data)) == data
    whole = [encoder.cut(t.encode()) for t in texts]
    monkeypatch.setattr(unigram, "STEP", 100)
    assert [encoder.cut(t.encode()) for t in texts] == whole
    for t in ("ab" * 300, "a" * 700):
        assert encoder.plain_viterbi(t.encode()) == encoder.viterbi([t.encode()])[0]
    began = time.time()
    assert encoder.decode(encoder.encode_all([coded * 800])[0]) == coded * 800
    assert time.time() - began < 60


def test_double_array_holds_each_piece():
    words = {b"a": 1, b"ab": 2, b"abc": 3, b"\xff\x00": 4, b"b": 5, bytes(range(1, 40)): 6}
    trie = unigram.DoubleArray(words)
    for word, i in words.items():
        node = 0
        for b in word:
            nxt = trie.base[node] + b + 1
            assert trie.check[nxt] == node
            node = nxt
        assert trie.value[node] == i


def test_encoded(spark, docs, rows, empty, encoder):
    got = {r["doc_id"]: r for r in collected(unigram.encoded(docs))}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        assert got[i]["n_pieces"] == (None if t is None else len(got[i]["ids"])) and got[i]["exact"] == (None if t is None else True)
    back = unigram.decoded(unigram.encoded(docs))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {r[0]: r[1] for r in rows}
    assert unigram.encoded(empty).count() == 0


# HTML


def test_main_text():
    page = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href="/">Home</a></nav><!-- x --><div class="ad">Buy now</div><article><h1>A &amp; B</h1><p><b>One\n  two<br>three<p>Four.</p></article><footer>&copy; me</footer></bo'
    assert html_blocks.main_text(page) == "A & B\nOne two three\nFour."
    assert html_blocks.main_text(None) == html_blocks.main_text("") == html_blocks.main_text("<nav>x</nav>") == ""
    words = " ".join(WORDS[:40])
    plain = f"<div id=menu><ul><li><a href=1>a</a><li><a href=2>b</a></ul></div><p>{words}</p><p>{words}</p><div class='sidebar'><p>{words}</p></div><section class=comments><p>{words}</p></section>"
    assert html_blocks.main_text(plain) == f"{words}\n{words}"
    assert html_blocks.main_text("<main><p>Text <a href='x>y'>link</a> on</p></main><form><p>q</p></form>") == "Text link on"
    assert html_blocks.main_text("<article><p>a <b") == "a"
    long = " ".join(f"word{i}" for i in range(60))
    article = f"<article><h1>Title here</h1><div class='byline'>By Ann</div><p>Buy {long} <span class='ad'>BUY <span>NOW</span></span>or <em hidden>secret</em>not<br>so.</p>{{}}</article>"
    kept = f"Title here\nBy Ann\nBuy {long} or not so."
    for after in (
        "", "<article class='comment'><p>Nice " + "story " * 30 + "</p></article>", "<article class='teaser'><h2>Other story</h2><p>" + "other " * 20 + "</p></article>",
        "<article><p>" + "someone else " * 12 + "</p></article>", "<section class='reader-discussion'><p>" + "I think " * 25 + "</p><p>So do I.</p></section>",
    ):
        assert html_blocks.main_text(article.format("") + after) == kept
        assert html_blocks.main_text(article.format(after)) == kept
    assert html_blocks.main_text("<article><p>One <b class='ad'>x</p><p>two</p></article>") == "One\ntwo"
    both = "<article><p>" + long + "</p></article>"
    assert html_blocks.main_text(both + both) == f"{long}\n{long}"
    assert html_blocks.main_text("<article><p>" + "<b" * 50_000).startswith("<b<b")


def test_names_that_wrap_a_page_are_not_boilerplate():
    words = " ".join(WORDS[:60])
    kept = f"Title words\n{words}\n{words}"
    body = f"<h1>Title words</h1><p>{words}</p><p>{words}</p>"
    menu = "<ul>" + "".join(f"<li><a href=/{i}>a{i}</a></li>" for i in range(6)) + "</ul>"
    for page in (
        f"<body class='home search'><nav>{menu}</nav>{body}<div class=comments><p>{words}</p></div></body>",
        f"<div id=page class=has-toc><div>{menu}</div>{body}</div>",
        f"<form id=aspnet><div>{menu}</div>{body}</form>",
        f"<article class='post has-social-links sponsored-no'>{body}<div class=share>Tell a friend</div></article>",
        f"<div class='wrap sidebar-left'><article>{body}</article><aside><p>{words}</p></aside></div>",
        f"<div>{menu}</div>{body}<h2>More</h2>{menu}",
    ):
        assert html_blocks.main_text(page) == kept
    assert html_blocks.main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p></article>") == "Let x=1 be."


def test_neighbours_carry_splits_and_names_are_not_the_root():
    used = []

    def walk(tree, depth=0):
        if tree.low is not None:
            used.append((depth, html_blocks.FEATURES[tree.feature]))
            walk(tree.low, depth + 1)
            walk(tree.high, depth + 1)

    walk(html_blocks.trained())
    assert (0, "hint") not in used and {"words", "link_density"} <= {f for _, f in used} and {f for _, f in used} & {"before_words", "before_density", "after_words", "after_density"}
    # on pages that the tree has not seen
    pages = [html_blocks.blocks(p) for p in html_blocks.labelled(seed=77)]
    right = [k == b.keep for p in pages for b, k in zip(p, html_blocks.trained().predict(html_blocks.features(p)))]
    assert np.mean(right) > 0.97


def test_extraction_of_odd_tables(spark):
    """Clashing names, repeated ids, nulls and a very long page."""
    long = "<article>" + "<p>one two three</p>" * 20_000 + "</article>"
    rows = [(1, "u", "<article><p>a</p></article>", "x", 7), (1, "u", "<article><p>a</p></article>", "x", 7), (None, None, None, None, None), (2, "v", long, "y", 8)]
    got = html_blocks.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 14 * 20_000 - 1)]


def test_tree_learns_its_table():
    pages = [html_blocks.blocks(p) for p in html_blocks.labelled()]
    right = [k == b.keep for p in pages for b, k in zip(p, html_blocks.trained().predict(html_blocks.features(p)))]
    assert np.mean(right) > 0.95


def test_extracted_pages_against_their_articles(spark):
    import html
    import re

    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = {r["page_id"]: r["html"] for r in df.collect()}
    got = collected(html_blocks.extracted(df))
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("</?b>", "", re.sub("<br>", " ", p))).split()) for p in re.split("</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])
    assert html_blocks.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# repeated rows, clashing names


@pytest.fixture(scope="module")
def repeats(spark):
    """Rows that repeat id and text, nulls in every column, a very long text, and extra columns with clashing names."""
    base, long = text(1, 18), text(2, 60_000)
    made = [(1, base, "en", "a")] * 5 + [(2, text(3, 30), "en", "b"), (2, text(4, 31), "en", "b"), (3, None, None, None), (4, long, "de", "b"), (None, None, None, None), (None, base, None, None)]
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "x", "y", 2, "z", 3.0) for r in made], DOCS + ", size long, id string, node string, repeats int, source_size string, score double")


def test_repeated_rows_and_clashing_names_in_each_operator(spark, repeats):
    n = repeats.count()
    for got in (
        exact_dedup.exact_groups(repeats), mixing.mixed(repeats), fingerprint.digests(repeats).select("doc_id", "n_chars", "fingerprint"), token_count.token_counts(repeats), bagminhash.near_classes(repeats),
        langid.languages(repeats), sharding.sharded(repeats, 3, 16), unigram.encoded(repeats),
    ):
        assert got.count() == n
        ones = [tuple(v for k, v in r.asDict().items() if k not in ("slot", "taken", "repeats")) for r in got.filter("doc_id = 1").collect()]
        assert len(ones) == 5 and len({str(x) for x in ones}) == 1


def test_mix_takes_repeated_rows_as_often_as_they_are_due(spark):
    base = text(1, 18)
    rows = [(1, base, "en", "a", 5)] * 5 + [(10 + i, text(i, 12), "en", "b", 5) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    plan = collected(mixing.mixed(docs))
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    ids = Counter(r["doc_id"] for r in got.collect())
    assert ids[1] == sum(r["repeats"] for r in plan if r["doc_id"] == 1) <= 15
    words = sum(r["taken"] for r in plan if r["doc_id"] == 1)
    assert words == 18 * ids[1] and abs(words - next(r["target"] for r in plan if r["doc_id"] == 1)) <= 18


def test_mix_ranks_a_length_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b", None, "s" if i % 3 else "t", 3) for i in range(900)], DOCS)
    many = {r["doc_id"]: r["repeats"] for r in mixing.mixed(docs).collect()}
    monkeypatch.setattr(mixing, "LEAST_BITS", 2)
    assert {r["doc_id"]: r["repeats"] for r in mixing.mixed(docs).collect()} == many


def test_language_model_is_refused_and_never_made_smaller(spark, docs):
    with pytest.raises(ValueError, match="n-grams"):
        langid.train(docs, model_rows=10)
    model = langid.train(docs, least_count=3)
    assert model.order == 4 and len(model.keys[3]) < len(langid.train(docs).keys[3])


# memory of Python workers


def test_texts_reach_python_in_batches_of_bounded_bytes(spark):
    """Each operator of the pipeline that hands texts to Python bounds the bytes of a batch, not only its rows; a smaller limit stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("lorem ip"), 500).alias("text"), F.lit("en").alias("lang"))

    def measured(batches):
        for batch in batches:
            yield batch.from_pydict({"n": [sum(len(t) for t in batch.column("text").to_pylist())]})

    before = spark.conf.get(name)
    try:
        for plan in (lambda: langid.count_grams(docs, "text", "lang", 4), lambda: bagminhash.signed(docs, "doc_id", "text", 2, 2), lambda: unigram.encoded(docs)):
            spark.conf.set(name, "64m")
            plan()
            sizes = [r["n"] for r in docs.mapInArrow(measured, "n long").collect()]
            assert sum(sizes) == 3000 * 4000 and max(sizes) <= common.BATCH_BYTES + 4000
        spark.conf.set(name, "100000b")
        unigram.encoded(docs)
        assert spark.conf.get(name) == "100000b"
    finally:
        spark.conf.set(name, before)


def test_stretches_are_segmented_in_small_tables(encoder):
    """The same ids in tables of any size, and no table of many times the stretches' bytes."""
    import tracemalloc

    words = [f"▁{i * 7919 % 1000003:x}nd{i}".encode() for i in range(60_000)]
    tracemalloc.start()
    encoder.learn_parts(found := {}, words)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6
    assert [found[w] for w in words[::600]] == encoder.viterbi(words[::600])


def test_counts_of_the_language_model_are_columns(spark, docs):
    """Languages come as a dictionary, not a string a row; one that a half lacks is in none of its models."""
    rows = docs.select("text", "lang").union(spark.createDataFrame([("das ding", "de")], "text string, lang string"))
    counts = langid.gathered(rows, "text", "lang", 4, 1, 10**6)
    assert counts.memory_usage(index=False, deep=True).sum() < 25 * len(counts) + 1000
    brute = Counter()
    for t, lang in rows.collect():
        for at, lot in langid.pieces([t]):
            brute.update((lang, int(k)) for k in langid.grams(at, lot, 4)[0])
    got = Counter()
    for lang, key, n in counts[["lang", "key", "n"]].itertuples(index=False):
        got[lang, key] += n
    assert got == brute
    assert sorted(len(langid.model_of(counts[counts["half"] == k], 4).langs) for k in (0, 1)) == [1, 2]


# pipeline


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    from slidelake.llm.common import table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    kept = {}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, sf)
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = common.written(docs, "test-stage")
        kept[k] = (before.toPandas(), docs.toPandas())
    assert len(kept[0][1]) >= 0.98 * len(kept[0][0])
    strip = lambda t: (t or "").translate({ord(c): None for c in common.SPACES})
    before, after = kept[1]
    assert len(after) == before["text"].map(strip).nunique() and after["text"].map(strip).is_unique
    before, after = kept[2]
    assert set(after["doc_id"]) == set(brute_classes(list(before[["doc_id", "text"]].itertuples(index=False))).values())
    assert kept[3][1]["doc_id"].value_counts().max() <= 3
    assert len(kept[4][1]) == len(kept[3][1]) and kept[4][1]["exact"].all()
    assert corpus_pipeline.run(spark, sf).count() == len(kept[4][1])
