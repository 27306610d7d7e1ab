"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text (shares of kinds of characters, word, line and
repetition measures) are computed in one pass over each Arrow batch. Trees are
grown level by level on quantile-binned statistics: gradients and Hessians of the
logistic loss are summed by (node, statistic, bin) with one bincount, and a running
sum over bins gives every split's gain. A model is flattened into two arrays of
complete binary trees (statistic and threshold of each node) and one of leaf
values, so numpy walks all trees for all rows of a batch at once, one level a step.

The model is fit on the driver on at most `sample_rows` labelled documents, those
with the smallest hashes of their ids, never on held-out ones; only statistics and
labels are collected. Scoring has no shuffle and looks at every row.

Defined cases: null and empty texts have all statistics zero and get a score as
any other; labels other than 0 and 1, null labels and unknown ids teach nothing;
of several labels of one id the smaller counts, and of several texts the one with
the smallest hash is learned from; without labels of both kinds the
score is the share of label 1, or 0.5 with none; a null id is not held out and
never labelled; repeated rows get equal scores; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import sampled

#: At most so many labelled documents are fitted on.
SAMPLE_ROWS = 15_000

STATISTICS = ("n_words", "mean_word", "letters", "upper", "digits", "white", "stops", "shouts", "symbols", "quotes", "beyond_ascii", "line_words", "repeated_lines", "distinct_words", "top_word", "repeated_pairs", "long_words", "short_words")

#: A class for each byte: 0 other, 1 lower, 2 upper, 3 digit, 4 white, 5 .,;: 6 !? 7 #*$%&|<> 8 quotes and brackets, 9 beyond ASCII
KIND = np.zeros(256, np.intp)
for _kind, _bytes in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, b" \t\n\x0b\x0c\r"), (5, b".,;:"), (6, b"!?"), (7, b"#*$%&|<>"), (8, b"\"'()[]{}"), (9, range(128, 256))):
    KIND[list(_bytes)] = _kind


def statistics(text: str | None) -> np.ndarray:
    """STATISTICS of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return np.zeros(len(STATISTICS))
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(KIND, weights=by_byte, minlength=10)
    words = raw.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    shown = max(1.0, len(raw) - kinds[4])
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.array(
        [
            len(words),
            shown / n,
            (kinds[1] + kinds[2]) / shown,
            kinds[2] / shown,
            kinds[3] / shown,
            kinds[4] / len(raw),
            kinds[5] / n,
            kinds[6] / n,
            kinds[7] / n,
            kinds[8] / n,
            kinds[9] / shown,
            len(words) / max(1, len(lines)),
            1 - len(set(lines)) / len(lines) if lines else 0.0,
            len(counts) / n,
            max(counts.values(), default=0) / n,
            1 - pairs / (len(words) - 1) if len(words) > 1 else 0.0,
            (lengths > 15).sum() / n,
            (lengths < 4).sum() / n,
        ]
    )


@dataclass
class Trees:
    """Complete binary trees in arrays: nodes by level, then leaves."""

    statistic: np.ndarray  # (trees, 2 ** depth - 1)
    threshold: np.ndarray  # goes right if above
    leaf: np.ndarray  # (trees, 2 ** depth)
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.statistic.shape
        if not trees:
            return np.full(len(x), self.base)
        node = np.zeros((len(x), trees), np.intp)
        each, rows = np.arange(trees), np.arange(len(x))[:, None]
        while node.size and node[0, 0] < inner:
            node = 2 * node + 1 + (x[rows, self.statistic[each, node]] > self.threshold[each, node])
        return self.base + self.leaf[each, node - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, smoothing: float = 1.0, least: float = 1.0) -> Trees:
    """Boost on the logistic loss; y has 0 and 1."""
    none = Trees(np.zeros((0, 2**depth - 1), np.intp), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), 0.0)
    if not len(y):
        return none
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    none.base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return none
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    width = bins + 1
    out = Trees(np.zeros((trees, 2**depth - 1), np.intp), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)), none.base)
    f = np.full(n, none.base)
    columns = np.arange(k) * width
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.intp)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (k * width) + columns + binned).ravel()
            sums = [np.bincount(slot, np.repeat(v, k), many * k * width).reshape(many, k, width) for v in (g, h)]
            gl, hl = (s.cumsum(axis=2)[:, :, :-1] for s in sums)
            ga, ha = (s[:, 0].sum(axis=1)[:, None, None] for s in sums)
            gain = gl**2 / (hl + smoothing) + (ga - gl) ** 2 / (ha - hl + smoothing) - ga**2 / (ha + smoothing)
            gain[(hl < least) | (ha - hl < least)] = -1
            for m in range(many):
                j, b = np.unravel_index(gain[m].argmax(), gain[m].shape)
                if gain[m, j, b] > 1e-6 and b < len(cuts[j]):
                    out.statistic[t, first + m], out.threshold[t, first + m] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), out.statistic[t, node]] > out.threshold[t, node])
        leaf = node - (2**depth - 1)
        out.leaf[t] = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + smoothing)
        f += out.leaf[t, leaf]
    return out


def held_out(id_col: Column) -> Column:
    """True for documents that are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pa.array([statistics(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), rows, b.column(2)], names=[id_col, "x", "label"])

    return docs.select(id_col, text_col, "label").mapInArrow(run, f"`{id_col}` {kind}, x array<double>, label int")


def learn_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, **options) -> Trees:
    """Fit on a bounded sample of the labelled documents that are not held out."""
    usable = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)) & F.col(id_col).isNotNull())
    known = usable.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("label"))
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    texts = sampled(docs, some.withColumnRenamed("label", "_label"), id_col, text_col).withColumnRenamed("_label", "label")
    rows = measured(texts, "_id", "_text").collect()
    rows.sort(key=lambda r: str(r["_id"]))
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([r["label"] for r in rows], float), **options)


def scored(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack([statistics(t.as_py()) for t in b.column(1)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=[id_col, "score"])

    out = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
