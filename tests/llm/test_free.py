"""Pseudonyms, decontamination, classifier, packing and WARC on small fixtures."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, packing, pii, quality_model, queries, warc

# --- pseudonyms


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(n):
    f = pii.Feistel(b"k", "t", n)
    out = [f.apply(x) for x in range(n)]
    assert sorted(out) == list(range(n))
    assert [f.undo(x) for x in out] == list(range(n))
    if n > 90:
        assert out != [pii.Feistel(b"other", "t", n).apply(x) for x in range(n)]


PRIVATE = [
    "card 4111 1111 1111 1111, again 4111111111111111.",
    "call +1 (243) 555-5526 or (243) 555-5526 or 243-555-5526",
    "host 161.17.88.162 and 10.0.0.1.",
    "born 1984-02-29, 31.12.1999, 12/31/1999, 31/12/1999",
    "ssn 078-05-1120 mail who.34@mail7.example.com",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" iban DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432',
]
PUBLIC = [None, "", "plain words", "4111111111111112 999.1.1.1 1984-02-30 000-12-3456 v1.2.3.4.5 a4111111111111111", "12 34 5678 and 3.14159 in 2024", "é" * 5000]


def test_pseudonyms_keep_formats_and_links(spark):
    texts = PRIVATE + PUBLIC + [PRIVATE[0]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kinds string")
    out = {r.doc_id: r for r in pii.pseudonymised(docs).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        if t in PUBLIC:
            assert out[i].text == t and out[i].n_replaced == 0
        else:
            new = out[i].text
            assert new != t and len(new) == len(t) or out[i].kinds.get("ip")
            for s in out[i].spans:
                assert t[s.start : s.end] not in new
    a = "".join(c for c in out[0].text if c.isdigit())
    assert a[:16] == a[16:] and pii.luhn(a[:16]) == 0 and out[len(texts) - 1].text == out[0].text
    assert [out[i].n_replaced for i in range(6)] == [2, 3, 2, 4, 2, 3]
    days = out[3].text.removeprefix("born ").split(", ")
    assert date.fromisoformat(days[0]) and days[1][2] == "." and days[2][2] == "/"
    assert pii.iban_rest(out[5].text.split("iban ")[1].split(" or ")[0].replace(" ", "")) == 1
    back = pii.pseudonymised(spark.createDataFrame([(r.doc_id, r.text) for r in out.values()], "doc_id long, text string"), back=True)
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(texts))
    assert pii.pseudonymised(docs.limit(0)).count() == 0


# --- decontamination


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_leaks_are_found_and_clean_documents_left(spark):
    r = random.Random(7)
    say = lambda k: [f"w{r.randrange(3000)}" for _ in range(k)]
    items = [say(r.randrange(15, 60)) for _ in range(20)]
    rows, want = [(1000, None), (1001, ""), (1002, "w1 w2"), (None, "x " * 30)], {}
    for i in range(200):
        w = say(r.randrange(20, 400))
        if i < 60:
            item = list(items[i % 20])
            if i >= 20:  # edited
                for k in r.sample(range(len(item)), len(item) // 6):
                    item[k] = r.choice(["edited", item[k] + " more", ""])
            at = r.randrange(len(w))
            w[at:at] = [x.upper() + "," for x in item]
            want[i] = i % 20
        rows.append((i, " ".join(w)))
    rows += [(2000 + k, rows[4][1]) for k in range(50)]  # a group of copies
    docs = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, score string")
    b = bench(spark, [(i, " ".join(t)) for i, t in enumerate(items)] + [(98, None), (99, "")])
    for block in (2000, 7):
        got = decontaminate.leaks(docs, b, block_words=block).collect()
        pairs = {(x.doc_id, x.item_id) for x in got}
        assert pairs == {*want.items(), *((2000 + k, 0) for k in range(50))}
        whole = next(x for x in got if x.doc_id == 0)
        assert whole.score == 1 and whole.end - whole.start == len(items[0])
    left = decontaminate.without_leaks(docs, b, block_words=150)
    assert left.columns == docs.columns
    assert sorted(x.doc_id or -1 for x in left.collect()) == sorted(i or -1 for i, _ in rows if i is None or (i not in want and i < 2000))
    assert decontaminate.leaks(docs, b.limit(0)).count() == decontaminate.leaks(docs.limit(0), b).count() == 0
    assert decontaminate.without_leaks(docs, b.limit(0)).count() == len(rows)


def test_a_short_item_is_its_own_seed(spark):
    docs = spark.createDataFrame([(1, "say hello world now"), (2, "hello there")], "doc_id long, text string")
    got = decontaminate.leaks(docs, bench(spark, [(5, "Hello, world!"), (6, "Hello, world!")])).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.end) for r in got) == [(1, 5, 1, 3), (1, 6, 1, 3)]


def brute_align(x, y):
    h = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x[i] == y[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def test_alignment_matches_the_plain_recurrence():
    r = np.random.default_rng(3)
    a = [r.integers(2, 6, r.integers(1, 12)).astype(np.uint64) for _ in range(60)]
    b = [r.integers(2, 6, r.integers(1, 20)).astype(np.uint64) for _ in range(60)]
    best, first, last = decontaminate.align(a, b)
    for k in range(60):
        assert best[k] == brute_align(a[k].tolist(), b[k].tolist())
        if best[k]:
            assert best[k] == brute_align(a[k].tolist(), b[k][first[k] : last[k] + 1].tolist())


# --- classifier


def walk(t, x):
    out = np.full(len(x), t.base)
    for i, row in enumerate(x):
        for k in range(len(t.leaf)):
            node = 0
            while node < t.statistic.shape[1]:
                node = 2 * node + 1 + int(row[t.statistic[k, node]] > t.threshold[k, node])
            out[i] += t.leaf[k, node - t.statistic.shape[1]]
    return out


def test_trees_learn_and_flat_traversal_is_right():
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = quality_model.fit(x[:1000], y[:1000])
    assert ((t.score(x[1000:]) >= 0.5) == y[1000:]).mean() > 0.95
    assert np.allclose(t.raw(x[:50]), walk(t, x[:50]))
    assert quality_model.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert quality_model.fit(x[:9], np.ones(9)).score(x[:1])[0] > 0.99


def test_held_out_rows_are_not_learned_from(spark):
    good, junk = "The plain text of an article, with words in it. ", "BUY | NOW ## $$$ BUY | NOW !! "
    rows = [(i, (good if i % 2 else junk) * 5 + f"n{i}") for i in range(300)] + [(None, good), (900, None), (901, ""), (902, good * 4000)]
    docs = spark.createDataFrame([(*r, "c", "c") for r in rows], "doc_id long, text string, label string, score string")
    held = {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1}
    # held-out labels are wrong on purpose
    labels = spark.createDataFrame([(i, (i % 2) ^ (i in held)) for i in range(300)] + [(None, 0), (4, None), (5, 7), (7, 1)], "doc_id long, quality int")
    model = quality_model.learn_from(docs, labels, sample_rows=150, trees=20)
    out = {r.doc_id: r for r in quality_model.scored(docs, model).collect()}
    assert {i for i, r in out.items() if r.held_out and i is not None and i < 300} == held
    assert all(out[i].predicted == i % 2 and 0 <= out[i].score <= 1 for i in range(300)) and len(out) == len(rows)
    assert quality_model.scored(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op4_quality_model(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9


# --- packing


def test_pieces_hold_all_ids_once(spark):
    from tokenizers import Tokenizer

    r = random.Random(2)
    odd = ["", "naïve ßtraße ’t it's we'LL 3½ ² Σς İ", "漢字 text", "<|endoftext|> a", "line\n\ttab\x0b x\x1cy"]
    texts = [None, *odd] + [" ".join(r.choice(["Word", "it's", "a", "12", "çé,", f"z{r.randrange(99)}"]) for _ in range(r.randrange(1, 900))) for _ in range(120)] + ["long words here " * 6000]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(3, texts[3], "c"), (None, "x", "c")], "doc_id long, text string, start string").repartition(3)
    path = queries.tokenizer_file()
    out = packing.pack(docs, path, batch=4, with_ids=True).collect()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    of, seq = defaultdict(list), defaultdict(list)
    for p in out:
        of[p.doc_id].append(p)
        seq[p.sequence_id].append(p)
        assert p.length == len(p.ids) > 0 and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    for i, x in enumerate(texts):
        want = t.encode(x or "", add_special_tokens=False).ids + [2]
        times = 2 if i == 3 else 1
        got = sorted((p.start, tuple(p.ids)) for p in of[i])
        assert sum(p.length for p in of[i]) == times * len(want) and all(p.doc_tokens == len(want) for p in of[i])
        if times == 1:
            assert [y for _, ids in got for y in ids] == want
            assert [s for s, _ in got] == np.cumsum([0, *(len(ids) for _, ids in got)])[:-1].tolist()
    for pieces in seq.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist()
        n = sum(p.length for p in pieces)
        assert n == 4096 or n < 4096 and n & (n - 1) == 0
    assert packing.pack(docs.limit(0), path).count() == 0


def test_costs_are_balanced():
    p = packing.Packer(0, capacity=100, batch=10)
    r = random.Random(1)
    out = [x for i in range(400) for x in p.add(i, np.zeros(r.randrange(1, 60), np.uint32))]
    out += p.finish()
    seqs = defaultdict(list)
    for _, _, ids, _, s, _ in out:
        seqs[s].append(len(ids))
    full = [sum(packing.cost(n, 0.01) for n in v) for v in seqs.values() if sum(v) == 100]
    assert max(full) < 1.6 * min(full)


# --- WARC


def test_archives_round_trip(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, f"http://h/{i}", f"<p>{r.randrange(40)}</p>" * r.randrange(1, 40)) for i in range(300)]
    rows += [(400, None, None), (401, "http://x/\r\nEvil: 1", ""), (402, "u", "é" * 90000), (None, "n", "only null"), (3, *rows[3][1:]), (500, "u", "WARC/1.1\r\n\r\nx\r\n\r\n")]
    pages = spark.createDataFrame([(*x, "c") for x in rows], "page_id long, url string, html string, digest string")
    index = warc.write_bundles(pages, folder=str(tmp_path / "w"), frame_bytes=2000, bundle_bytes=4000)
    out = warc.read_bundles(index).collect()
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(least.get(h or "", 1 << 60), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = least.get(h or "")
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first == i else "revisit", None if first == i else first))
    assert sorted(str(tuple(x)) for x in out if x.page_id is not None) == sorted(str(w) for w in want if w[0] is not None)
    null = [x for x in out if x.page_id is None]
    assert [(x.record_type, x.refers_to) for x in null] == [("response", None)]
    import zstandard

    for f in (tmp_path / "w").iterdir():
        assert f.name.endswith(".warc.zst")
        with f.open("rb") as h:
            table = warc.seek_table(h, f.stat().st_size)
            h.seek(0)
            whole = b"".join(zstandard.ZstdDecompressor().stream_reader(h, read_across_frames=True).read() for _ in range(1))
        assert len(whole) == sum(plain for _, _, plain in table) and whole.startswith(b"WARC/1.1\r\n")
    got = {x.page_id: x.payload for x in warc.fetch(index, spark.createDataFrame([(402,), (5,), (777,)], "page_id long")).collect()}
    assert bytes(got[402]) == ("é" * 90000).encode() and 777 not in got
    few = warc.write_bundles(pages, folder=str(tmp_path / "z"), min_revisit_bytes=1)
    assert {x.page_id: x.record_type for x in warc.read_bundles(few).collect()}[401] == "response"
    assert warc.read_bundles(warc.write_bundles(pages.limit(0), folder=str(tmp_path / "e"))).count() == 0
