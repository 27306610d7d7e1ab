"""The queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, packing, pii, quality_model, quality_rules, simhash, substring_dedup, suffix_dedup, warc
from ._common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.scored(docs, quality_model.learn_from(docs, table(spark, sf_dir, "labels")))


def tokenizer_file() -> str:
    """The vocabulary that packing counts tokens with."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(), special_tokens=True)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_bundles(warc.write_bundles(table(spark, sf_dir, "pages"), min_revisit_bytes=0))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(table(spark, sf_dir, "documents"), width=3, limit=3)
    return out.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def _removed(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", _removed("spans").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=200)
    return out.select("doc_id", "n_bytes", _removed("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.judge(docs, quality_rules.learn_from(docs, labels))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, min_docs=10, min_chars=1, keep_first=False)
    kept = F.sha2(line_dedup.kept_text(F.col("text"), F.col("keep_runs")), 256)
    return out.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_simhash": op2_simhash,
        "op3_decontaminate": op3_decontaminate,
        "op4_quality_model": op4_quality_model,
        "op5_packing": op5_packing,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_quality_rules": op8_quality_rules,
        "op9_warc": op9_warc,
        "op10_line_dedup": op10_line_dedup,
    }


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, body, min(page_id) OVER (PARTITION BY body) AS first_id,
    upper(sha1(body)) AS hex FROM p
), bits AS (
  SELECT page_id, payload_bytes, first_id,
    list_aggregate(list_transform(range(0, 40), lambda i: lpad(bin(instr('0123456789ABCDEF', hex[i + 1]) - 1), 4, '0')), 'string_agg', '') AS b
  FROM d
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    (16 * b[5 * i + 1]::INT + 8 * b[5 * i + 2]::INT + 4 * b[5 * i + 3]::INT + 2 * b[5 * i + 4]::INT + b[5 * i + 5]::INT + 1)]), 'string_agg', '') AS payload_digest,
  CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM bits
"""

OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + 50], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS i FROM w)
), gone AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM win) WHERE least < doc_id
), covered AS (
  SELECT DISTINCT doc_id, i + j AS p FROM gone, range(0, 50) AS r(j)
), words AS (
  SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) - 1 AS p FROM w
), kept AS (
  SELECT words.doc_id, count(c.p)::BIGINT AS n_removed,
    string_agg(x, ' ' ORDER BY words.p) FILTER (WHERE c.p IS NULL) AS t
  FROM words LEFT JOIN covered c ON c.doc_id = words.doc_id AND c.p = words.p GROUP BY words.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), win AS (
  SELECT doc_id, s, md5(b[s + 1:s + 200]) AS k FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 199)) AS s FROM d)
), twice AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1
), runs AS (
  SELECT doc_id, min(s) AS lo, max(s) + 200 AS hi FROM (
    SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (
      SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 200 THEN 0 ELSE 1 END AS fresh FROM twice))
  GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, lag(hi, 1, 0) OVER w AS lo, lo AS hi FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY lo)
  UNION ALL SELECT d.doc_id, coalesce(max(hi), 0), octet_length(any_value(b)) FROM d LEFT JOIN runs ON runs.doc_id = d.doc_id GROUP BY d.doc_id
), kept AS (
  SELECT d.doc_id, string_agg(hex(b[gaps.lo + 1:gaps.hi]), '' ORDER BY gaps.lo) AS t FROM d JOIN gaps ON gaps.doc_id = d.doc_id WHERE gaps.hi > gaps.lo GROUP BY d.doc_id
), gone AS (
  SELECT doc_id, sum(hi - lo) AS n, count(*) AS spans FROM runs GROUP BY doc_id
)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = d.doc_id
"""

OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines,
  count(*) FILTER (WHERE f.k IS NOT NULL)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.k = f.k
GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_substring_dedup": OP6_SQL, "op7_suffix_dedup": OP7_SQL, "op9_warc": OP9_SQL, "op10_line_dedup": OP10_SQL}
