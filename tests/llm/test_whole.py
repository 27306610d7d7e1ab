"""Cases that a shortened job would miss."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import decontaminate, packing, pii, queries

# --- decontamination


def found(docs, items, min_score=0.5, rarity=None):
    values, begin = split(docs)
    own = decontaminate.Items.of(list(range(len(items))), decontaminate.tokens_of(items), min_score, rarity)
    return {(d, i): score for d, i, score, _, _ in decontaminate.found_in(own, values, begin)}


def split(docs):
    texts = [t.encode() for t in docs]
    return decontaminate.tokens(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64))


def unseeded(docs, items, min_score=0.5):
    values, begin = split(docs)
    words, at = split(items)
    out = {}
    for d in range(len(docs)):
        for i in range(len(items)):
            x, y = words[at[i] : at[i + 1]], values[begin[d] : begin[d + 1]]
            if len(x) and len(y) and (score := decontaminate.align([x], [y])[0][0] / (2 * len(x))) >= (min_score if len(x) > 3 else 1):
                out[d, i] = score
    return out


@pytest.mark.parametrize("copies", [20, 21, 50, 1000])
def test_an_edited_item_in_many_documents(spark, copies):
    item = [f"w{k}" for k in range(40)]
    edited = " ".join("other" if k % 6 == 0 else w for k, w in enumerate(item))
    docs = spark.createDataFrame([(i, f"before {i} {edited} after") for i in range(copies)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert decontaminate.leaks(docs, benchmark).select("doc_id").distinct().count() == copies
    assert decontaminate.without_leaks(docs, benchmark).count() == 0


def test_passages_without_words_in_a_row():
    item = [f"w{k}" for k in range(15)]
    every = lambda n: " ".join("x" if k % n == n - 1 else w for k, w in enumerate(item))
    docs = ["a b " + every(4) + " c", "a b " + every(3) + " c", "d " + " x ".join(item) + " e", "w3 x " * 40]
    assert set(found(docs, [" ".join(item)])) == {(0, 0), (1, 0), (2, 0)}


@pytest.mark.parametrize("chunk", [1, 60, 1 << 20])
@pytest.mark.parametrize("min_score", [0.3, 0.5, 0.8])
def test_found_as_by_aligning_all(monkeypatch, chunk, min_score):
    monkeypatch.setattr(decontaminate, "CHUNK_HITS", chunk)
    r = random.Random(chunk)
    say = lambda k, n: [f"w{r.randrange(n)}" for _ in range(k)]
    items = [say(r.randrange(1, 30), 40) for _ in range(8)] + [[]]
    docs = []
    for _ in range(40):
        w = say(r.randrange(0, 80), 60)
        part = [y for x in r.choice(items) for y in r.choice([[x], [x], [x, "new"], ["other"], []])]
        at = r.randrange(len(w) + 1)
        docs.append(" ".join(w[:at] + part + w[at:]))
    texts = list(map(" ".join, items))
    want = unseeded(docs, texts, min_score)
    assert found(docs, texts, min_score) == want
    known = np.unique(np.concatenate(decontaminate.tokens_of(texts)))
    for counts in (np.arange(len(known)), -np.arange(len(known)), np.zeros(len(known), np.int64)):  # rare or not, the result is the same
        assert found(docs, texts, min_score, (known, counts)) == want
    assert want


def test_one_count_and_one_pass_for_ten_thousand_items(spark, monkeypatch):
    r = random.Random(6)
    items = [" ".join(f"w{r.randrange(30000)}" for _ in range(r.randrange(15, 60))) for _ in range(10_000)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(k, f"before {items[97 * k]} after", "x") for k in range(100)] + [(100, "w1 w2 w3 " * 50, "x")], "doc_id long, text string, score string")
    counted, count = [], decontaminate.word_counts
    monkeypatch.setattr(decontaminate, "word_counts", lambda *a: counted.append(1) or count(*a))
    out = decontaminate.leaks(docs, benchmark)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and counted == [1]
    assert {(x.doc_id, x.item_id) for x in out.collect() if x.score == 1} == {(k, 97 * k) for k in range(100)}
    left = decontaminate.without_leaks(docs, benchmark)
    assert left._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and [x.doc_id for x in left.collect()] == [100]


def test_a_very_long_item_and_a_very_long_text():
    r = random.Random(4)
    item = [f"w{r.randrange(50000)}" for _ in range(6000)]
    doc = [f"v{r.randrange(50000)}" for _ in range(30_000)]
    doc[7000:7000] = [w for w in item if r.random() > 0.1]
    got = found([" ".join(doc), "v1 v2"], [" ".join(item), "w1 w2 w3 w4 w5 w6"])
    assert set(got) == {(0, 0)} and got[0, 0] > 0.8


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("a", "one two three four five"), (None, "one two three four six")], "doc_id string, text string")
    benchmark = spark.createDataFrame([(None, "one two three four")], "item_id int, text string")
    assert sorted(map(str, decontaminate.leaks(docs, benchmark).select("doc_id", "item_id").collect())) == ["Row(doc_id='a', item_id=None)", "Row(doc_id=None, item_id=None)"]


# --- pipeline


@pytest.mark.parametrize("copies", [10, 1000])
def test_one_of_many_copies_stays(spark, copies):
    clean = "\n".join(" ".join(f"word{k}x{j}" for j in range(12)) for k in range(20))
    own = [(5000 + i, "\n".join([f"own{i} line {j}" for j in range(9)] + ["shared footer"])) for i in range(10)]
    rows = [(i, clean, "en", "s", len(clean)) for i in range(copies)] + [(i, t, "en", "s", len(t)) for i, t in own] + [(9000, " \n", "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lines = corpus_pipeline.lines(spark, docs, "")
    assert {r.text for r in lines.where("doc_id >= 5000").collect()} == {t.removesuffix("\nshared footer") for _, t in own}
    left = corpus_pipeline.near_duplicates(spark, lines, "").where("doc_id < 5000").collect()
    assert [(r.doc_id, r.text, r.n_chars) for r in left] == [(0, clean, len(clean))]


# --- packing


def test_literals_of_special_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["foo <|endoftext|> bar", "<|startoftext|>a<|endoftext|>", "x <|ENDOFTEXT|> y", "<|endoftext", "é <|endoftext|>", "plain words", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(queries.tokenizer_file())
    want = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in enumerate(texts)}
    whole = {r.doc_id: r for r in queries.op5_packing(spark, str(tmp_path)).where("length = doc_tokens").collect()}
    assert len(want[0]) == 4 and {0, 1} & set(whole)
    for i, r in whole.items():
        assert r.ids_crc32 == zlib.crc32(np.array(want[i], "<u4").tobytes())
    assert {r.doc_id: r.doc_tokens for r in queries.op5_packing(spark, str(tmp_path)).collect()} == {i: len(x) for i, x in want.items()}


# --- pseudonyms


def test_a_secret_of_letters_alone():
    names = pii.Pseudonyms()
    text = "password = \"correcthorsebattery\", TOKEN:'abcdefgh'"
    new, found = names.replace(text)
    assert [k for *_, k in found] == ["secret", "secret"] and "correcthorsebattery" not in new and "abcdefgh" not in new
    assert names.replace(text + " 7")[0] == new + " 7"
    assert pii.Pseudonyms(back=True).replace(new)[0] == text


def test_small_word_tables_give_the_same_ids():
    """Words leave a full table and come back."""
    from tokenizers import Tokenizer

    plain, small = Tokenizer.from_file(queries.tokenizer_file()), packing.Encoder(queries.tokenizer_file(), table_words=7, special_tokens=True)
    texts = [" ".join(f"word{(i * k) % 23} the" for i in range(12)) for k in range(40)] + ["", "the the"]
    for at in range(0, len(texts), 3):
        got = small.encode(texts[at : at + 3])
        assert [list(g) for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts[at : at + 3]]
