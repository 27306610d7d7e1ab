"""Benchmark decontamination: rare seeds and Smith-Waterman alignment.

A document's passages are aligned with an item by Smith-Waterman (match 2, mismatch
-1, gap -1) over words, with case and punctuation put aside, and items are reported
whose best local score reaches `min_score` of a full match. Such an alignment matches
at least that share of the item's words within a passage of bounded length. So it
matches some of the item's rarest words, however it was edited: with m words of
which k must match, any m - k + s of them hold s matches. The seeds of an item are
its m - k + s words that are rarest in the corpus, s a sixth of m; a passage is a
candidate if it holds s of them. Within it a running sum (2 for a word of the item,
-1 for another) bounds the score of all alignments that end at a word, and what can
reach the limit is aligned. The result is that of aligning every document with every
item, however edited a passage is and however many documents hold it.

Seeds are single words: insertions alone can leave no two words of an item in a row
at a score of 0.5, so longer n-grams would miss passages. Common words are no seeds,
so the work grows with the places of rare words, not with documents times items.

The benchmark is a stated query set. Its seeds are broadcast, BLOCK_WORDS words of
items at most, so their size has a bound for any benchmark: one pass over the corpus
counts the benchmark's words, and one pass for each such block (tens of thousands of
items) looks for passages. Texts never move, and a hot source or a group of copies
stays where it is read.

Defined cases: null and empty texts and items match nothing; an item of fewer than
four words matches only whole; equal items are reported each; repeated rows are
reported each; null ids are carried, and ids may have any type; very long texts are
looked at some million seeds at a time, and long passages aligned in overlapping
pieces; an empty benchmark or corpus gives an empty result; other columns are not
read by leaks and kept as they are by without_leaks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._exchange import layout, word_hashes

#: Words of benchmark items whose seeds are broadcast together.
BLOCK_WORDS = 2_000_000
MIN_SCORE = 0.5
#: Share of an item's words that a candidate holds among the rarest.
SEED_SHARE = 1 / 6
#: Items of fewer words match only whole.
SHORT_WORDS = 4
#: Seeds found that are looked at together, and cells of a row of alignments.
CHUNK_HITS = 1 << 20
CELLS = 1 << 19

#: Bytes that belong to words (ASCII letters and digits, all beyond ASCII), and lower case.
WORD = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each document's begin (one more at the end)."""
    n = len(raw)
    word = WORD[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (~np.r_[False, word[:-1]] | edge[:n]))
    ends = np.flatnonzero(word & (~np.r_[word[1:], False] | edge[1 : n + 1])) + 1
    values, _ = word_hashes(LOWER[raw[word]], ends - starts)
    return values, np.searchsorted(starts, offsets)


def tokens_of(texts: list[str | None]) -> list[np.ndarray]:
    """Word hashes of each text."""
    blobs = [(t or "").encode() for t in texts]
    values, begin = tokens(np.frombuffer(b"".join(blobs), np.uint8), np.r_[0, np.cumsum([len(t) for t in blobs])].astype(np.int64))
    return [values[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]


def span(words: int, min_score: float) -> int:
    """Words of a passage, at most, that aligns with an item of so many words and reaches min_score."""
    return int(np.ceil(words * (3 - 2 * min_score)))


@dataclass
class Items:
    """A block of benchmark items with its seeds."""

    ids: list
    words: list[np.ndarray]
    limits: np.ndarray  # the least score of each, as a share
    reach: np.ndarray  # the longest passage
    least: np.ndarray  # seeds that a candidate holds
    seeds: np.ndarray  # sorted, distinct
    owners: np.ndarray  # the items that have each seed, seed by seed
    times: np.ndarray  # how often each of these has it
    first: np.ndarray  # where each seed's begin
    count: np.ndarray  # and how many there are
    kept: dict = field(default_factory=dict)

    @classmethod
    def of(cls, ids: list, words: list[np.ndarray], min_score: float = MIN_SCORE, rarity: tuple[np.ndarray, np.ndarray] | None = None) -> Items:
        """rarity: sorted words and their counts in the corpus; without it words count as in the items."""
        limits = np.array([min_score if len(w) >= SHORT_WORDS else 1.0 for w in words])
        known, counts = rarity or np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]), return_counts=True)
        least, rare = np.zeros(len(words), np.int64), []
        for i, w in enumerate(words):
            m = len(w)
            need = int(np.ceil(m * limits[i] - 1e-9))
            least[i] = min(need, int(np.ceil(m * SEED_SHARE)))
            order = np.lexsort((w, counts[np.searchsorted(known, w)])) if m else np.zeros(0, np.int64)
            rare.append(w[order[: m - need + least[i]]])
        owner = np.repeat(np.arange(len(words)), [len(r) for r in rare])
        flat = np.concatenate([*rare, np.zeros(0, np.uint64)])
        order = np.lexsort((owner, flat))
        flat, owner = flat[order], owner[order]
        new = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])]) if len(flat) else np.zeros(0, np.int64)
        seeds, first, count = np.unique(flat[new], return_index=True, return_counts=True)
        reach = np.array([max(1, span(len(w), x)) for w, x in zip(words, limits, strict=True)], np.int64)
        return cls(ids, words, limits, reach, least, seeds, owner[new], np.diff(np.r_[new, len(flat)]), first, count)

    def own_words(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        """An item's distinct words, sorted, and how often it has each."""
        if item not in self.kept:
            self.kept[item] = np.unique(self.words[item], return_counts=True)
        return self.kept[item]

    def hits(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in values, seeds) of all seeds found."""
        if not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.searchsorted(self.seeds, values)
        k[k == len(self.seeds)] = 0
        at = np.flatnonzero(self.seeds[k] == values)
        return at, k[at]


def candidates(items: Items, values: np.ndarray, begin: np.ndarray) -> dict[tuple[int, int], list[list[int]]]:
    """(document, item): stretches of words, in order and apart, that hold all alignments which reach the limit."""
    where, which = items.hits(values)
    total = np.r_[0, np.cumsum(items.count[which])]
    longest = int(items.reach.max(initial=0))
    out: dict[tuple[int, int], list[list[int]]] = {}
    start = 0
    while start < len(where):
        # what ends in this chunk can begin before it
        a = int(np.searchsorted(where, where[start] - longest))
        b = max(start + 1, int(np.searchsorted(total, total[start] + CHUNK_HITS, side="right")) - 1)
        n = items.count[which[a:b]]
        entry = np.arange(n.sum()) + np.repeat(items.first[which[a:b]] - np.cumsum(n) + n, n)
        doc = np.searchsorted(begin, where[a:b], side="right") - 1
        pair = items.owners[entry] * len(begin) + np.repeat(doc, n)
        place = np.repeat(where[a:b], n)
        start = b
        by = np.argsort(pair, kind="stable")
        cuts = np.flatnonzero(np.r_[True, pair[by][1:] != pair[by][:-1]])
        sizes = np.diff(np.r_[cuts, len(by)])
        by = by[np.repeat(sizes >= items.least[pair[by[cuts]] // len(begin)], sizes)]
        if not len(by):
            continue
        entry, place, pair = entry[by], place[by], pair[by]
        item = pair // len(begin)
        group = np.cumsum(np.r_[False, pair[1:] != pair[:-1]])
        # an alignment lies in two neighbouring stretches of its longest length; a pair of them is named by the later one
        stretch = place // items.reach[item]
        width = int(stretch.max()) + 2
        keys, own = np.r_[group * width + stretch, group * width + stretch + 1], np.r_[entry, entry]
        order = np.lexsort((own, keys))
        keys, own = keys[order], own[order]
        cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])])
        counted = np.minimum(np.diff(np.r_[cuts, len(keys)]), items.times[own[cuts]])  # none more often than the item has it
        names, at = np.unique(keys[cuts], return_inverse=True)
        held = np.bincount(at, counted)
        leader = pair[np.flatnonzero(np.r_[True, group[1:] != group[:-1]])]
        for name in names[held >= items.least[leader[names // width] // len(begin)]].tolist():
            i, d = divmod(int(leader[name // width]), len(begin))
            r, later = int(items.reach[i]), name % width
            low, high = max(int(begin[d]), (later - 1) * r), min(int(begin[d + 1]), (later + 1) * r)
            own_ = out.setdefault((d, i), [])
            if own_ and low <= own_[-1][1]:
                own_[-1][1] = max(high, own_[-1][1])
            else:
                own_.append([low, high])
    return out


def passages(items: Items, values: np.ndarray, low: int, high: int, item: int) -> Iterator[tuple[int, int]]:
    """Parts of a stretch in which an alignment can reach the limit: overlapping ones of bounded length."""
    words, times = items.own_words(item)
    at = np.searchsorted(words, values[low:high])
    at[at == len(words)] = 0
    shared = words[at] == values[low:high]
    level = np.cumsum(np.where(shared, 2, -1))
    most = level - np.minimum.accumulate(np.r_[0, level[:-1]])
    m, r = len(items.words[item]), int(items.reach[item])
    ends = np.flatnonzero(shared & (most >= 2 * m * items.limits[item] - 1e-9))
    if not len(ends):
        return
    parts = np.split(ends, np.flatnonzero(np.diff(ends) > r) + 1)
    for part in parts:
        first, last = max(0, int(part[0]) + 1 - r), int(part[-1]) + 1
        for a in range(first, max(first + 1, last - r), 3 * r):
            b = min(last, a + 4 * r)
            held = np.bincount(at[a:b][shared[a:b]], minlength=len(words))
            if np.minimum(held, times).sum() >= m * items.limits[item] - 1e-9:
                yield low + a, low + b


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local score, and first and last word of it in the passage, for each pair; all pairs at once, row by row."""
    c, m, w = len(items), max(map(len, items)), max(map(len, passages))
    a, b = np.zeros((c, m), np.uint64), np.ones((c, w), np.uint64)
    for k, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[k, : len(x)] = x
        b[k, : len(y)] = y
    steps = np.arange(w, dtype=np.int32)
    row, began = np.zeros((c, w + 1), np.int32), np.tile(np.arange(w + 1, dtype=np.int32), (c, 1))
    best, last, first = (np.zeros(c, np.int32) for _ in range(3))
    lines = np.arange(c)
    for i in range(m):
        diagonal = row[:, :-1] + np.where(a[:, i : i + 1] == b, 2, -1).astype(np.int32)
        up = row[:, 1:] - 1
        cell = np.maximum(diagonal, up)
        start = np.where(diagonal >= up, began[:, :-1], began[:, 1:])
        fresh = cell <= 0
        cell[fresh] = 0
        start[fresh] = np.broadcast_to(steps + 1, cell.shape)[fresh]
        # gaps along the passage: the running maximum of cell + place, less the place
        lifted = cell + steps
        top = np.maximum.accumulate(lifted, axis=1)
        source = np.maximum.accumulate(np.where(lifted == top, steps, 0), axis=1)
        cell = top - steps
        start = np.take_along_axis(start, source, axis=1)
        row[:, 1:], began[:, 1:] = cell, start
        k = cell.argmax(axis=1)
        better = cell[lines, k] > best
        best[better], last[better], first[better] = cell[lines, k][better], k[better], start[lines, k][better]
    return best, first, last


def _columns(b: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    t = pa.table({"id": pa.nulls(b.num_rows, pa.int64()), "text": pc.fill_null(b.column(1), "")})
    raw, offsets, _, _ = layout(t)
    return b.column(0), *tokens(raw, offsets)


def _pieces(batches: Iterator[pa.RecordBatch], text: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Rows together that have so many bytes of text, or one row."""
    for b in batches:
        sums = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(sums, (sums[i - 1] if i else 0) + size, side="right")))
            yield b.slice(i, j - i)
            i = j


def found_in(items: Items, values: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
    """(document, item, score, first word, end) of the aligned passages of a batch, the best for each pair."""
    todo = [(d, i, lo, hi) for (d, i), parts in candidates(items, values, begin).items() for low, high in parts for lo, hi in passages(items, values, low, high, i)]
    # alike lengths together, as all pairs of a batch take the steps of the longest
    todo.sort(key=lambda x: (len(items.words[x[1]]).bit_length(), x[3] - x[2], x))
    out: dict[tuple[int, int], tuple[float, int, int]] = {}
    k = 0
    while k < len(todo):
        n = 1
        while k + n < len(todo) and (n + 1) * max(len(items.words[todo[k + n][1]]), todo[k + n][3] - todo[k + n][2]) <= CELLS and len(items.words[todo[k + n][1]]).bit_length() == len(items.words[todo[k][1]]).bit_length():
            n += 1
        part = todo[k : k + n]
        k += n
        best, first, last = align([items.words[i] for _, i, _, _ in part], [values[lo:hi] for _, _, lo, hi in part])
        for (d, i, lo, _), s, a, z in zip(part, best.tolist(), first.tolist(), last.tolist(), strict=True):
            score = s / (2 * len(items.words[i]))
            at = (lo + a - int(begin[d]), lo + z + 1 - int(begin[d]))
            had = out.get((d, i), (0.0, 0, 0))
            if score >= items.limits[i] and (score > had[0] or score == had[0] and at < had[1:]):
                out[d, i] = (score, *at)
    for (d, i), x in sorted(out.items()):
        yield d, i, *x


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, block_words: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """The items, some at a time: their ids and words."""
    ids, words, size = [], [], 0
    for r in benchmark.select(item_col, item_text).toLocalIterator():
        w = tokens_of([r[1]])[0]
        if ids and size + len(w) > block_words:
            yield ids, words
            ids, words, size = [], [], 0
        ids.append(r[0])
        words.append(w)
        size += len(w)
    if ids:
        yield ids, words


def word_counts(docs: DataFrame, text_col: str, words: np.ndarray) -> np.ndarray:
    """How often the corpus has each of these sorted words; a task sends one row for each word it has."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counts = np.zeros(len(known), np.int64)
        for b in _pieces(batches, 0):
            values = _columns(b.select([text_col, text_col]))[1]
            k = np.searchsorted(known, values)
            k[k == len(known)] = 0
            counts += np.bincount(k[known[k] == values], minlength=len(known))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])

    out = np.zeros(len(words), np.int64)
    if len(words):
        found = docs.select(text_col).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out


def _passes(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, min_score: float, block_words: int) -> Iterator[Items]:
    """The items with their seeds, block by block."""
    for ids, words in _blocks(benchmark, item_col, item_text, block_words):
        known = np.unique(np.concatenate(words))
        yield Items.of(ids, words, min_score, (known, word_counts(docs, text_col, known)))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, item, score, start, end): documents that hold an item, and where (words, end exclusive)."""
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, score double, start long, end long"
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for items in _passes(docs, benchmark, text_col, item_col, item_text, min_score, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            names = pa.array(items.ids, item_type)
            for b in _pieces(batches, 1):
                ids, values, begin = _columns(b)
                rows = list(found_in(items, values, begin))
                columns = [x.take(pa.array([r[k] for r in rows], pa.int64())) for k, x in enumerate((ids, names))]
                columns += [pa.array([r[k] for r in rows], t) for k, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, item_col, "score", "start", "end"])

        found = docs.select(id_col, text_col).mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, all columns, that hold no item. Each block of items filters where the rows are read."""
    place = docs.columns.index(text_col)
    whole = docs
    for items in _passes(whole, benchmark, text_col, item_col, item_text, min_score, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in _pieces(batches, place):
                _, values, begin = _columns(pa.RecordBatch.from_arrays([b.column(place)] * 2, names=["id", "text"]))
                keep = np.ones(b.num_rows, bool)
                keep[[r[0] for r in found_in(shared.value, values, begin)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
