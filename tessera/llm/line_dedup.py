"""Exact line deduplication by sorted hash ranges, native DataFrame code only.

Lines become rows (hash, check, bucket, document, position), once, in a table in the
shared folder. They are range-partitioned by hash and bucket and sorted within by
document and position, so one pass over the sorted rows streams the first occurrence
of a line in a bucket and counts its documents. Hash and check are XXH64 and Murmur3
of the line's key, 96 bits of two unrelated functions together. The bucket comes from
the document, so a line that a third of all rows share is dealt over many ranges;
only one row per bucket goes on to the sum by line. The result is no text but a
run-length coded keep bitmap for each document: lengths of alternating runs of kept
and dropped lines, beginning with a kept run that may be empty.

Defined cases: a null or empty text is one empty line; lines whose key is shorter
than min_chars always stay; a document is an id: rows with one id count once for a
line, whether their texts are equal or not, and each row has the bitmap of its own
text; a null id is one document like any other; the first of ties is the smallest id
(null first), then the text's hash, then the position; a very long text is as many
rows as it has lines; an empty table gives an empty result; other columns are carried
along, but for those named like a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WS_CHARS, ascii_lower, kept, let

#: Ranges that one very common line can be dealt over.
BUCKETS = 1024


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


#: What names a line.
KEY = ("_hash", "_check")


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """A row (hash, check, bucket, id, version, pos) for each line that can be dropped."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = F.transform(
        _lines(ascii_lower(text)),
        lambda x: let(F.btrim(x, F.lit(WS_CHARS)), lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("_hash"), F.hash(k).alias("_check")))),
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_version"), F.posexplode(keys).alias("_pos", "_key")).where(F.col("_key").isNotNull())
    return rows.select("_key.*", F.pmod(F.xxhash64("_id"), F.lit(buckets)).cast("int").alias("_bucket"), "_id", "_version", "_pos")


def _runs(dropped: Column, n: Column) -> Column:
    """Alternating kept and dropped run lengths from sorted dropped positions."""

    def build(p: Column) -> Column:
        starts = F.filter(p, lambda x, j: (j == 0) | (F.get(p, j - 1) != x - 1))
        ends = F.filter(p, lambda x, j: F.coalesce(F.get(p, j + 1) != x + 1, F.lit(True)))
        return let(
            F.struct(starts.alias("s"), ends.alias("e")),
            lambda r: F.concat(
                F.flatten(F.transform(r["s"], lambda s, k: F.array(s - F.when(k > 0, F.get(r["e"], k - 1) + 1).otherwise(F.lit(0)), F.get(r["e"], k) - s + 1))),
                F.array(n - F.coalesce(F.get(r["e"], F.size(r["e"]) - 1) + 1, F.lit(0))),
            ),
        )

    return let(dropped, build)


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 1, keep_first: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """(id, _version, dropped) for each document that loses lines; dropped: their sorted positions.

    Lines found in at least min_docs documents are dropped; with keep_first their
    first occurrence (smallest id, then position) stays.
    """
    rows = kept(line_rows(docs, id_col, text_col, min_chars, buckets), "lines")
    place = [*KEY, "_bucket"]
    ranged = rows.repartitionByRange(*place).sortWithinPartitions(*place, "_id", "_version", "_pos")
    group = Window.partitionBy(*place).orderBy("_id", "_version", "_pos")
    new = (F.row_number().over(group) == 1) | ~F.lag("_id").over(group).eqNullSafe(F.col("_id"))
    streamed = ranged.withColumn("_new", new.cast("long"))
    in_bucket = streamed.groupBy(*place).agg(F.sum("_new").alias("_docs"), F.min(F.struct("_id", "_version", "_pos")).alias("_first"))
    # a row for each bucket of a line: at most `buckets` of them meet here
    line = Window.partitionBy(*KEY)
    summed = in_bucket.select(*place, F.sum("_docs").over(line).alias("_docs"), F.min("_first").over(line).alias("_first"))
    frequent = summed.where(F.col("_docs") >= min_docs).drop("_docs")
    # a common line's rows come back by bucket too
    if keep_first:
        hit = rows.join(frequent, place).where(~F.struct("_id", "_version", "_pos").eqNullSafe(F.col("_first")))
    else:
        hit = rows.join(frequent.select(*place), place, "left_semi")
    return hit.groupBy("_id", "_version").agg(F.sort_array(F.collect_set("_pos")).alias("dropped")).withColumnRenamed("_id", id_col)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 1, keep_first: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """docs with n_lines, n_dropped and keep_runs, the compressed keep bitmap.

    Further columns of docs are carried along; one that is named like a result
    gives way to it.
    """
    made = ("n_lines", "n_dropped", "keep_runs")
    rest = [c for c in docs.columns if c not in (id_col, text_col, *made)]
    packed = docs.select(id_col, text_col, F.struct(*rest).alias("_rest") if rest else F.lit(None).alias("_rest"))
    marked = line_bitmaps(docs.select(id_col, text_col), id_col, text_col, min_docs, min_chars, keep_first, buckets).withColumnsRenamed({id_col: "_id", "_version": "_v", "dropped": "_dropped"})
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = packed.join(marked, packed[id_col].eqNullSafe(marked["_id"]) & (F.xxhash64(text) == marked["_v"]), "left")
    n, lost = F.size(_lines(text)), F.coalesce("_dropped", F.array().cast("array<int>"))
    runs = F.when(F.size(lost) == 0, F.array(n)).otherwise(_runs(lost, n))
    return joined.select(id_col, text_col, n.cast("long").alias("n_lines"), F.size(lost).cast("long").alias("n_dropped"), runs.alias("keep_runs"), *(F.col(f"_rest.`{c}`") for c in rest))


def kept_text(text: Column, runs: Column) -> Column:
    """The text without the lines that the bitmap drops."""
    text = F.coalesce(text, F.lit(""))
    bits = F.flatten(F.transform(runs, lambda r, j: F.array_repeat(j % 2 == 0, r)))
    return F.when(F.size(runs) == 1, text).otherwise(let(bits, lambda b: F.array_join(F.filter(_lines(text), lambda _, i: F.get(b, i)), "\n")))
