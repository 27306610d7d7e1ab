"""The pipeline's stages, each on its predecessor's output, against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, packing, quality_rules, queries, simhash

SF = "/root/testdata/sf0.001"
WS = " \t\n\x0b\x0c\r"


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage; the input has nulls, copies and leaks besides."""
    folder = str(tmp_path_factory.mktemp("stages"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    leak = " ".join(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(3).collect())
    base = docs.where("doc_id = 7").first().text
    more = [(5000, None), (5001, ""), (5002, base), (None, base.replace("the", "this", 1)), (5003, leak), (5004, base + "\nshared footer line")]
    more += [(6000 + i, docs.where(f"doc_id = {r}").first().text + "\nShared Footer line ") for i, r in enumerate((1, 2, 3, 4, 6, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17))]
    extra = spark.createDataFrame([(i, t, "en", None, 1) for i, t in more], docs.schema)
    docs.union(extra).write.parquet(f"{folder}/in")
    out = [spark.read.parquet(f"{folder}/in")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()), key=str)


def test_columns(stages):
    for df in stages[:-1]:
        assert tuple(df.columns) == corpus_pipeline.COLUMNS
    assert {"sequence_id", "offset", "length"} <= set(stages[-1].columns)


def test_rules(spark, stages):
    learned = quality_rules.learn_from(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    of = {k: {} for k in quality_rules.FEATURES}
    stats = stages[0].select("doc_id", "text", quality_rules.statistics(F.col("text")).alias("s")).select("doc_id", "text", *(c.alias(k) for k, c in quality_rules.features(F.col("s")).items()))
    of = {(r.doc_id, r.text): r for r in stats.collect()}

    def keep(row):
        w = words(row[1])
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)}
        if not w or 100 * len(covered) > 50 * len(w):
            return False
        f = of[row[0], row[1]]
        return not any(all((f[c.feature] > c.threshold) == c.above for c in rule) for rule in learned.rules)

    assert rows(stages[1]) == [r for r in rows(stages[0]) if keep(r)]
    assert 0 < stages[1].count() < stages[0].count()


def test_lines(stages):
    lower = lambda k: k.translate({i: i + 32 for i in range(65, 91)})
    key = lambda x: lower(x.strip(WS))
    before = rows(stages[1])
    n = Counter(k for r in set(before) for k in {key(x) for x in r[1].split("\n")})
    want = []
    for i, t, lang, source, _ in before:
        new = "\n".join(x for x in t.split("\n") if not key(x) or n[key(x)] < 10)
        if words(new):
            want.append((i, new, lang, source, len(new)))
    assert rows(stages[2]) == sorted(want, key=str)
    assert "shared footer line" in n and not any("ooter line" in r[1] for r in rows(stages[2]))


def test_near_duplicates(stages):
    """Rows that stay, against all pairs of the 256-bit fingerprints."""
    before = rows(stages[2])
    shape = simhash.Bands()
    wide = simhash.wide_fingerprints(stages[2].select("doc_id", "text", F.col("text").alias("_text")), "_text", shape).collect()
    fp = {(r.doc_id, r.text): np.array([r[n] for n in simhash.fp_names(4)]).view(np.uint64) for r in wide}
    fps = [fp[r[0], r[1]] for r in before]
    root = list(range(len(before)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(before)):
        for b in range(a):
            if np.bitwise_count(fps[a] ^ fps[b]).sum() <= shape.limit(0.8):
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(before):
        key = (r[0] is None, r[0])
        least[find(k)] = min(least.get(find(k), key), key)
    want = {r for k, r in enumerate(before) if least[find(k)] == (r[0] is None, r[0])}
    got = set(rows(stages[3]))
    assert want <= got < set(before)
    assert len(got) - len(want) <= 0.1 * (len(before) - len(want))


def test_leaks(spark, stages):
    items = decontaminate.tokens_of([r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    want = []
    for r in rows(stages[3]):
        raw = np.frombuffer(r[1].encode(), np.uint8)
        values, _ = decontaminate.tokens(raw, np.array([0, len(raw)]))
        best, _, _ = decontaminate.align(items, [values] * len(items))
        if max(s / (2 * len(w)) for s, w in zip(best.tolist(), items, strict=True)) < decontaminate.MIN_SCORE:
            want.append(r)
    assert rows(stages[4]) == want
    assert 5003 in {r[0] for r in rows(stages[3])} - {r[0] for r in want}


def test_sequences(stages):
    encoder = packing.Encoder(queries.tokenizer_file())
    want = {r[0]: len(encoder.encode([r[1]])[0]) + 1 for r in rows(stages[4])}
    got = stages[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == want
    assert stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").isEmpty()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
