"""SimHash, substring and suffix dedup against brute force on small fixtures."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import _exchange, components, simhash, substring_dedup, suffix_dedup


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    monkeypatch.setattr(_exchange, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(_exchange, "SHARD_BYTES", 20000)


def corpus(seed=1, n=60, vocabulary=400):
    r = random.Random(seed)
    say = lambda k: [f"w{r.randrange(vocabulary)}é" if r.random() < 0.1 else f"W{r.randrange(vocabulary)}" for _ in range(k)]
    passage, common = say(80), say(60)
    out = [None, "", " \n\t", "one", "one two", "a a " * 300]
    for i in range(n):
        w = say(r.randrange(5, 160))
        if i % 4 == 0:
            w[len(w) // 2 : len(w) // 2] = passage
        if i % 3 == 0:
            w = common + w
        if i % 5 == 0 and i:
            w = out[-1].split() if r.random() < 0.5 else [*out[-1].split()[:-1], "changed"]
        out.append((" " if i % 2 else "\r\n ").join(w))
    return out + [out[-1]]


def docs_of(spark, texts):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, texts[-1], "c", "c"), (7, texts[7], "c", "c")]
    r = random.Random(3)
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string, bucket string, fp string")


def brute_fp(t, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    grams = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def classes_of(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_simhash_matches_brute_force(spark):
    rows, docs = docs_of(spark, corpus())
    got = simhash.classes(docs).select("doc_id", simhash.as_hex(F.col("fp")), "component_id").collect()
    fps = [brute_fp(t) for _, t, *_ in rows]
    nodes = sorted(set(fps))
    of = classes_of([(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 3], nodes)
    least = defaultdict(list)
    for (i, *_), f in zip(rows, fps, strict=True):
        if i is not None:
            least[of[f]].append(i)
    want = sorted(((i, f"{f:016x}", min(least[of[f]])) for (i, *_), f in zip(rows, fps, strict=True)), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert len({c for _, _, c in want}) < len(nodes)


@pytest.mark.parametrize(("limit", "cell_rows"), [(1, 10**9), (3, 10**9), (3, 5), (5, 20)])
def test_grid_finds_all_links(spark, limit, cell_rows):
    r = random.Random(limit)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = {b for b in base} | {b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(7))) & (1 << 64) - 1 for b in base for _ in range(20)}
    fps = sorted({f & (1 << 64) - 1 for f in fps} | {0, (1 << 64) - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), limit, cell_rows)
    pairs = [tuple(x) for x in links.collect()]
    near = [(a, b) for a, x in zip(signed, fps, strict=True) for b, y in zip(signed, fps, strict=True) if a < b and (x ^ y).bit_count() <= limit]
    assert set(pairs) <= set(near)
    assert classes_of(pairs, signed) == classes_of(near, signed)


@pytest.mark.parametrize("tight", [False, True])
@pytest.mark.parametrize("words", [1, 2, 4])
def test_spanning_links_in_a_large_group(words, tight):
    r = np.random.default_rng(5)
    bits = r.choice(64, 16, replace=False)
    fps = np.unique(np.array([sum(1 << int(b) for b in bits if r.random() < (0.05 if tight else 0.5)) for _ in range(3000)], np.uint64))
    fps = np.concatenate([fps, np.bitwise_not(fps[:50])])
    u = np.stack([fps, *[fps ^ np.uint64(7)] * (words - 1)], 1)
    limit = 3 * words
    found = simhash.spanning_links(u, u[:5], limit)
    d = sum(np.bitwise_count(u[:, None, k] ^ u[None, :, k]).astype(int) for k in range(words))
    near = np.argwhere(np.triu(d <= limit, 1)).tolist() + [[i, len(u) + i] for i in range(5)]
    assert len(found) < len(u) + 5
    nodes = list(range(len(u) + 5))
    assert classes_of(found, nodes) == classes_of(near, nodes)


SHAPE = simhash.Bands()
M64 = (1 << 64) - 1


def scalar_mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * factor & M64
    return x ^ (x >> 31)


def brute_wide(text):
    """The 256 bits and the balance of each, one shingle after the other."""
    words = [xxhash.xxh3_128_intdigest(w.encode()) >> 64 for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))]
    words = [int.from_bytes(x.to_bytes(8, "big"), "little") for x in words]
    balance = [0] * 256
    for width in range(1, 6):
        for i in range(len(words) - width + 1):
            h = words[i]
            for x in words[i + 1 : i + width]:
                h = scalar_mix((h * 3 + x) & M64)
            for k in range(4):
                h = scalar_mix(h ^ k if k else h)
                for j in range(64):
                    balance[64 * k + j] += 1 if h >> j & 1 else -1
    return balance


def wide_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "_id long, _text string")
    return {r._id: r for r in simhash.wide_fingerprints(docs, "_text", SHAPE).collect()}


def test_wide_fingerprints_match_brute_force(spark):
    texts = [None, "", "one", "A b c", *corpus(n=6)[3:], "x y " * 9000]
    for i, row in wide_of(spark, texts).items():
        if len(texts[i] or "") < 20_000:
            balance = brute_wide(texts[i])
            bits = sum(1 << j for j in range(256) if balance[j] > 0)
            assert sum((row[n] & M64) << 64 * k for k, n in enumerate(simhash.fp_names(4))) == bits
            for part in range(SHAPE.parts):
                code = row[SHAPE.weak_names[part // SHAPE.per_long]] // 18 ** (4 * (part % SHAPE.per_long))
                margin = [abs(x) for x in balance[18 * part : 18 * part + 18]]
                assert [code // 18**j % 18 for j in range(4)] == sorted(range(18), key=lambda j: (margin[j], j))[:4]


def edited(words, rate, r):
    return [f"new{r.randrange(10**6)}" if r.random() < rate else w for w in words]


@pytest.mark.parametrize("cell_rows", [simhash.CELL_ROWS, 4])
def test_near_copies_are_found(spark, monkeypatch, cell_rows):
    """At least nine in ten of all classes that 256 bits tell, whether cells are dealt anew or not; nothing else goes."""
    monkeypatch.setattr(simhash.near_links, "__defaults__", (3, cell_rows, None))
    r = random.Random(8)
    texts = []
    for i in range(100):
        w = [f"w{r.randrange(5000)}" for _ in range(r.randrange(60, 400))]
        texts += [" ".join(w), *(" ".join(edited(w, 0.04, r)) for _ in range(2 if i % 3 == 0 else 0))]
    texts += [" ".join(edited([f"g{k}" for k in range(200)], 0.03, r)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {x.doc_id for x in simhash.one_of_each(docs).select("doc_id").collect()}
    fps = {i: [x[n] & M64 for n in simhash.fp_names(4)] for i, x in wide_of(spark, texts).items()}
    near = [(a, b) for a in fps for b in fps if a < b and sum((x ^ y).bit_count() for x, y in zip(fps[a], fps[b], strict=True)) <= SHAPE.limit(0.8)]
    of = classes_of(near, list(fps))
    go = {i for i in of if of[i] != i}
    assert len(go) > 100 and not go & {i for i in of if of[i] == i} and set(of.values()) <= kept
    assert len(go - kept) >= 0.95 * len(go)


def test_long_texts_of_one_vocabulary_stay(spark):
    """Frequent words do not make long texts near copies; edited copies of them still are."""
    r = random.Random(11)
    words, weights = [f"w{k}" for k in range(2000)], [1 / (k + 1) for k in range(2000)]
    texts = [r.choices(words, weights, k=n) for n in [60, 400, *[4000] * 12, 9000, 9000]]
    copies = [edited(t, 0.04, r) for t in (texts[1], texts[5], texts[-1])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([*texts, *copies])], "doc_id long, text string")
    kept = [x.doc_id for x in simhash.one_of_each(docs).select("doc_id").collect()]
    assert sorted(kept) == list(range(len(texts)))


def test_large_classes_have_a_grid(spark, monkeypatch):
    """The copies found in classes that are searched by a grid, against those found pair by pair."""
    r = random.Random(13)
    base = [f"g{k}" for k in range(300)]
    texts = [base, *(edited(base, 0.03, r) for _ in range(80)), *([f"w{r.randrange(5000)}" for _ in range(200)] for _ in range(20))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {x.doc_id for x in simhash.one_of_each(docs).collect()} == {0, *range(81, 101)}
    monkeypatch.setattr(simhash, "CLASS_ROWS", 4)
    kept = {x.doc_id for x in simhash.one_of_each(docs).collect()}
    assert {0, *range(81, 101)} <= kept and len(kept) <= 21 + 4


def test_distinct_shingles_match_brute_force(spark):
    """A text has the fingerprint of its words and pairs taken once each, whatever the pieces."""
    r = random.Random(12)
    texts = [None, "", "one", "a a " * 300, " ".join(f"w{r.randrange(40)}" for _ in range(20_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "_id long, _text string")
    for row in simhash.wide_fingerprints(docs, "_text", simhash.NEAR).collect():
        words = (texts[row._id] or "").split()
        hashes = {w: int.from_bytes((xxhash.xxh3_128_intdigest(w.encode()) >> 64).to_bytes(8, "big"), "little") for w in words}
        shingles = set(hashes.values()) | {scalar_mix((hashes[a] * 3 + hashes[b]) & M64) for a, b in zip(words, words[1:], strict=False)}
        balance = [0] * 256
        for h in shingles:
            for k in range(4):
                h = scalar_mix(h ^ k if k else h)
                for j in range(64):
                    balance[64 * k + j] += 1 if h >> j & 1 else -1
        assert sum((row[n] & M64) << 64 * k for k, n in enumerate(simhash.fp_names(4))) == sum(1 << j for j in range(256) if balance[j] > 0)


def test_rows_are_decided_not_ids(spark):
    r = random.Random(3)
    a, b, t = (" ".join(f"{c}{r.randrange(900)}" for _ in range(120)) for c in "abt")
    rows = [(3, b, "x"), (5, a, "x"), (5, b, "x"), (7, t, "x"), (7, t, "y"), (7, t, "x"), (8, None, "x"), (9, "", "x"), (None, a, "x"), (None, "only null ids here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _a string").withColumnRenamed("_a", "node")
    got = sorted(((x.doc_id, x.text) for x in simhash.one_of_each(docs).collect()), key=str)
    assert got == sorted([(3, b), (5, a), (7, t), (8, None), (None, "only null ids here")], key=str)
    assert simhash.one_of_each(docs.limit(0)).count() == 0
    strings = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert simhash.one_of_each(strings).count() == 5


def test_hot_join(spark):
    many = spark.createDataFrame([(i % 7 if i % 2 else 1, i) for i in range(1000)], "k long, v long")
    one = spark.createDataFrame([(k, 10 * k) for k in range(6)], "k long, w long")
    counts = many.groupBy("k").agg(F.count("*").alias("n"))
    want = sorted(map(tuple, many.join(one, ["k"]).collect()))
    for hot_rows in (10**6, 100, 0):
        assert sorted(map(tuple, components.hot_join(many, one, ["k"], counts, 1000, hot_rows).collect())) == want


def test_components_with_hot_centres(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_ROWS", 5)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 200 + i % 3) for i in range(40)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == classes_of(edges, list(range(60)) + list(range(100, 140)) + [200, 201, 202])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (100, 100), (103, 102), (None, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 102, 103: 102}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def sha(x):
    return hashlib.sha256(x).hexdigest()


def brute_words(rows, window):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in rows]
    low = lambda d: -1 if d is None else d
    least = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, 1 << 60), low(d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < low(d):
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode())))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [50, 20, 3])
def test_substrings_match_brute_force(spark, window):
    rows, docs = docs_of(spark, corpus(vocabulary=400 if window > 3 else 15))
    got = substring_dedup.remove_repeats(docs, window=window).select("doc_id", "n_words", F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute_words(rows, window)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def long_rows():
    """A text of many units that repeats in others, across the places where it is cut."""
    r = random.Random(9)
    book = [f"w{r.randrange(10**5)}" for _ in range(6000)]
    odd = ["x" * 3000, *book[100:180], "\u00e9" * 900, *book[2000:2100]]
    return [(5, "  ".join(book)), (2, " ".join(book[700:900] + book[3000:3070])), (9, "\n".join(book[2500:4500])), (9, " ".join(odd)), (7, " ".join(book[5900:])), (1, None)]


@pytest.mark.parametrize("unit", [700, 3001, 1 << 30])
def test_very_long_texts_in_pieces(spark, monkeypatch, unit):
    monkeypatch.setattr(_exchange, "UNIT_BYTES", unit)
    monkeypatch.setattr(_exchange, "BUCKET_BYTES", 20_000)
    rows = long_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.remove_repeats(docs).select("doc_id", "n_words", F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute_words(rows, 50)
    got = suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)"), F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute_bytes(rows, 200)


def test_short_texts_only(spark):
    rows = [(i, t) for i, t in enumerate(["a b c", "a b c", "", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.n_words, r.kept) for r in substring_dedup.remove_repeats(docs).collect()} == {(0, 3, "a b c"), (1, 3, "a b c"), (2, 0, ""), (3, 0, "")}
    assert {(r.doc_id, r.n_bytes, len(r.spans)) for r in suffix_dedup.remove_repeats(docs).collect()} == {(0, 5, 0), (1, 5, 0), (2, 0, 0), (3, 0, 0)}


def self_similar(n):
    """A word and its complement whose polynomials modulo 2 ** 64 are equal, whatever the base, if long enough."""
    word = "a"
    while len(word) < n:
        word += word.translate({97: "b", 98: "a"})
    return word, word.translate({97: "b", 98: "a"})


def test_self_similar_words_are_no_repeats(spark):
    x, y = self_similar(2048)
    w = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join([*w, x])), (2, " ".join([*w, y])), (3, " ".join([*w, x, "more"]))]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: sum(s.end - s.start for s in r.spans) for r in got} == {1: 0, 2: 0, 3: 50}
    rows = [(i, f"{a}{b}") for i, (a, b) in enumerate([(x, y), (y, x), ("q" * 70, x)])]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)"), F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute_bytes(rows, 200)


def test_equal_hashes_are_told_apart(monkeypatch):
    """With a hash that never tells anything, runs (of one window each then) are compared as bytes."""
    monkeypatch.setattr(suffix_dedup, "mix", lambda x: x * np.uint64(0))
    monkeypatch.setattr(suffix_dedup, "hashes", lambda raw, k: np.zeros(max(0, len(raw) - k + 1), np.uint64))
    raw = np.frombuffer(b"abcdefghij" * 3 + b"klmnopqrstu" * 3, np.uint8)
    unit = suffix_dedup.Unit(raw, np.array([0, 10, 20, 30, 41, 52, 63]), 0, 8, 4, 1)
    unit.many[:] = True
    first, group, size = (unit.runs(pa.table({"shard": pa.array([], pa.int32()), "bits": pa.array([], pa.binary())}), {}) and unit).equal_runs()
    got = [raw[unit.run_low[i] : unit.run_high[i] + 8].tobytes() for i in first]
    want = [t[i : i + 8] for t in (b"abcdefghij", b"klmnopqrstu") for i in range(len(t) - 7)]
    assert sorted(got) == want and size.tolist() == [3] * 7 and len(group) == 21


def test_rows_of_a_round_grow_as_the_text():
    rate = []
    for total in (1 << 35, 1 << 37, 1 << 40, 100 << 40):
        buckets, shards = _exchange.dealt(total)
        rate.append(buckets * shards / total)
    assert max(rate) < 1.1 * min(rate) + 1e-9


def brute_bytes(rows, window):
    raw = [(d, (t or "").encode()) for d, t, *_ in rows]
    n = defaultdict(int)
    for _, b in raw:
        for i in range(len(b) - window + 1):
            n[b[i : i + window]] += 1
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if n[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [200, 64, 9])
def test_suffixes_match_brute_force(spark, window):
    rows, docs = docs_of(spark, corpus(2))
    got = suffix_dedup.remove_repeats(docs, window=window).select("doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)"), F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute_bytes(rows, window)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_order_is_right():
    r = random.Random(4)
    raw = np.frombuffer(bytes(r.choice(b"ab") for _ in range(800)) + b"a" * 300 + bytes(r.choice(b"abc") for _ in range(500)), np.uint8)
    for window in (40, 100):
        starts = np.arange(len(raw) - window + 1)
        s = suffix_dedup.SuffixSort(raw, starts, window)
        keys = [raw[i : i + window].tobytes() for i in s.order()]
        assert keys == sorted(keys)
        all_ = [raw[i : i + window].tobytes() for i in starts]
        assert s.repeated().tolist() == [all_.count(k) > 1 for k in all_]
        assert s.repeated_by_bytes(np.lib.stride_tricks.sliding_window_view(raw, window)).tolist() == s.repeated().tolist()
