"""Quality rules: base statistics and a learned decision list, native code only.

The statistics are built-in expressions over the whole text. A decision list is
learned by sequential covering: a rule grows by the threshold condition with the
best information gain on two thirds of a bounded labelled sample, is pruned
backwards on the other third, and is kept if it is precise enough there; what it
covers is taken away and the next rule grows. The list is emitted as one ordered
conditional expression (CASE WHEN ... THEN false ... ELSE true).

Defined cases: null and empty texts have zero words and fail the base rules;
texts of fewer than three words repeat none; labels that are null, unknown ids
and labels other than 0 and 1 teach nothing; of several labels of one id the
smaller counts, and of several texts the one with the smallest hash teaches; with
no usable labels the list is empty and only the base rules reject; repeated rows
are judged alike, each on its own; a value equal to a threshold is not above it; a
very long text is one array of words and one of hashes in memory; an empty table
gives an empty result and teaches nothing; other columns, also ones named like a
result, are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORDS, let

#: At most so many labelled documents are looked at to learn the list.
SAMPLE_ROWS = 12_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORDS, -1), lambda w: w != "")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more.

    Windows are 64-bit hashes. Sorted with their places, equal ones are neighbours.
    """

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            at = lambda j: F.get(s, j)["h"]
            twice = lambda x, j: ((j > 0) & (at(F.greatest(j - 1, F.lit(0))) == x["h"])) | F.coalesce(at(j + 1) == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))

        fresh = lambda p: _sum(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(placed, places), fresh))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashes, covered))


def statistics(text: Column) -> Column:
    """A struct of all statistics of a text."""
    text = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated(words).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.regexp_count(text, F.lit(r"[A-Z]")).cast("long").alias("n_upper"),
            F.regexp_count(text, F.lit(r"[0-9]")).cast("long").alias("n_digits"),
            F.regexp_count(text, F.lit(r"[!?]")).cast("long").alias("n_shouts"),
            F.regexp_count(text, F.lit(r"[.,;:]")).cast("long").alias("n_stops"),
        )

    return let(words_of(text), of)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: What the rules test: each a ratio of two statistics.
FEATURES = {
    "words": ("n_words", None),
    "mean_word": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeated": ("n_repeat_words", "n_words"),
    "distinct": ("n_distinct_words", "n_words"),
    "line_words": ("n_words", "n_lines"),
    "upper": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "shouts": ("n_shouts", "n_words"),
    "stops": ("n_stops", "n_words"),
}


def features(stats: Column) -> dict[str, Column]:
    return {k: (stats[a].cast("double") if b is None else stats[a].cast("double") / F.greatest(stats[b], F.lit(1))) for k, (a, b) in FEATURES.items()}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > self.threshold if self.above else of[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered conjunctions; a document that meets one is rejected."""

    rules: list[list[Condition]] = field(default_factory=list)

    def column(self, stats: Column) -> Column:
        """The verdict: false for the first rule met, else true."""
        of, out = features(stats), None
        for rule in self.rules:
            met = rule[0].column(of)
            for c in rule[1:]:
                met = met & c.column(of)
            out = F.when(met, F.lit(False)) if out is None else out.when(met, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join(f"if {' and '.join(map(str, r))} then reject" for r in self.rules) + "\nelse keep"


def learn(rows: list[dict], max_rules: int = 12, max_conditions: int = 4, cuts: int = 40, min_precision: float = 0.95, min_covered: int = 3) -> DecisionList:
    """Sequential covering over rows (FEATURES and 'bad'); sets of rows are the bits of integers."""
    if not rows or not any(r["bad"] for r in rows):
        return DecisionList()
    full = (1 << len(rows)) - 1
    bits = lambda test: int("".join("1" if test(r) else "0" for r in reversed(rows)), 2)
    bad = bits(lambda r: r["bad"])
    # every third row prunes; repeated three-bit pattern over all rows
    prune_set = int("100" * (len(rows) // 3 + 1), 2) & full if len(rows) >= 9 else full
    grow_set = full & ~prune_set if len(rows) >= 9 else full
    conditions: list[tuple[Condition, int]] = []
    for f in FEATURES:
        values = sorted({r[f] for r in rows})
        step = max(1, len(values) // cuts)
        for v in {*values[:: step], *values[-3:-1]}:
            above = bits(lambda r, f=f, v=v: r[f] > v)
            conditions += [(Condition(f, True, v), above), (Condition(f, False, v), full & ~above)]
    conditions = [(c, m) for c, m in conditions if m and m != full]

    def grow(pos: int, neg: int) -> list[tuple[Condition, int]]:
        rule: list[tuple[Condition, int]] = []
        while neg and len(rule) < max_conditions:
            p0, n0 = pos.bit_count(), neg.bit_count()
            best, gain = None, 1e-9
            for c, m in conditions:
                p = (pos & m).bit_count()
                if p and (g := p * (math.log2(p / (p + (neg & m).bit_count())) - math.log2(p0 / (p0 + n0)))) > gain:
                    best, gain = (c, m), g
            if best is None:
                break
            rule.append(best)
            pos, neg = pos & best[1], neg & best[1]
        return rule

    def cover(rule: list[tuple[Condition, int]]) -> int:
        out = full
        for _, m in rule:
            out &= m
        return out

    left, found = full, DecisionList()
    while len(found.rules) < max_rules and left & bad & grow_set:
        rule = grow(left & bad & grow_set, left & ~bad & grow_set)
        if not rule:
            break

        def worth(r: list[tuple[Condition, int]], within: int) -> tuple[float, int]:
            m = cover(r) & within
            p, n = (m & bad).bit_count(), (m & ~bad).bit_count()
            return (p / (p + n) if p + n else 0.0), p

        options = [rule[:k] for k in range(len(rule), 0, -1)]
        best = max(options, key=lambda r: (round((w := worth(r, left & prune_set))[0], 3), w[1], -len(r)))
        precision, covered = worth(best, left)
        if precision < min_precision or covered < min(min_covered, bad.bit_count()):
            break
        found.rules.append([c for c, _ in best])
        left &= ~cover(best)
    return found


def sampled(docs: DataFrame, some: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _label, _text): the texts of a bounded table (_id, _label), one row for each id."""
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(some), F.col("_doc") == F.col("_id"))
    return texts.groupBy("_id", "_label").agg(F.min(F.struct(F.xxhash64("_text"), F.col("_text").alias("_text"))).alias("_least")).select("_id", "_label", "_least._text")


def learn_from(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DecisionList:
    """Learn from at most sample_rows labelled documents, the same ones each time.

    The sample is the labelled ids with the smallest hashes; its size is the
    bound of the broadcast and of what the driver gets (numbers, no texts).
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = sampled(docs, some, id_col, text_col).select("_id", "_label", statistics(F.col("_text")).alias("_s"))
    table = rows.select("_id", (F.col("_label") == 0).alias("bad"), *(c.alias(k) for k, c in features(F.col("_s")).items()))
    rows = [r.asDict() for r in table.collect()]
    return learn(sorted(rows, key=lambda r: (str(r["_id"]), str(r))), **options)


def base_failed(stats: Column, min_words: int = 50) -> Column:
    return (stats["n_words"] < min_words) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def verdict(stats: Column, rules: DecisionList, min_words: int = 50) -> Column:
    """True for texts to keep: the base rules hold and no learned rule rejects."""
    return ~base_failed(stats, min_words) & rules.column(stats)


def judge(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base statistics, base_failed, kept) for every document."""
    s = F.col("_s")
    out = docs.select(F.col(id_col), statistics(F.col(text_col)).alias("_s"))
    return out.select(id_col, *(s[k].alias(k) for k in BASE), base_failed(s).alias("base_failed"), verdict(s, rules).alias("kept"))
