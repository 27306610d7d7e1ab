"""Repeated word passages by fixed-block anchors.

A passage of `window` words holds a whole block of `window / 2` words that starts
at a multiple of that length in its document. These non-overlapping blocks are
the index; every rolling window of a block's length probes it, by polynomials over
hashes of the words' bytes. A hit that another document has too is extended: all
windows of full length that hold it are candidates, and these are compared by
XXH3-128 of their very words, joined by one space, over all documents: a window is
removed where a document with a smaller id has it. Runs of such windows are the
maximal exact repeats.

Index, probes and candidate windows go through the bucketed exchange, so copies
and common passages make no large groups, and no pairs of documents are formed.

Defined cases: null and empty texts have no words; documents shorter than a
window lose nothing; rows with one id are one document, so they take nothing from
each other; ids are whole numbers (others are cast, as they must have an order),
and a null id counts as the smallest; ties cannot matter, as only ids are compared;
a very long text is worked on in overlapping pieces; an empty table gives an empty
result; other columns, also ones named like a result, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _exchange
from ._exchange import ANSWER, answered, bucketed, by_shard, combined, gathered, groups, handed_on, layout, onward, pieces, prefix, replies, rolling, told, whole_units, word_bounds, word_hashes

WINDOW = 50

RESULT = "id long, n_words long, spans array<struct<start:long,end:long>>, kept string"


def units(t: pa.Table, window: int, shards: int) -> Iterator[Unit]:
    """The documents of a bucket, some at a time; a very long one in pieces that end with the words of a window's rest."""
    raw, offsets, ids, _ = layout(t)
    for d, e in whole_units(offsets):
        lo, hi = int(offsets[d]), int(offsets[e])
        if hi - lo <= _exchange.UNIT_BYTES:
            yield Unit(raw[lo:hi], offsets[d : e + 1] - lo, ids[d:e], d, window, shards)
            continue
        base = 0
        while lo < hi:
            cut = _word_end(raw, min(lo + _exchange.UNIT_BYTES, hi), hi)
            unit = Unit(raw[lo : _words_on(raw, cut, hi, window - 1)], None, ids[d:e], d, window, shards, base, cut - lo)
            yield unit
            base, lo = base + unit.own, cut


def _white(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def _word_end(raw: np.ndarray, at: int, end: int) -> int:
    """The first white space from here on, or the end."""
    while at < end:
        found = np.flatnonzero(_white(raw[at : min(end, at + 65536)]))
        if len(found):
            return at + int(found[0])
        at = min(end, at + 65536)
    return end


def _words_on(raw: np.ndarray, at: int, end: int, words: int) -> int:
    """Where so many further words end."""
    for _ in range(words):
        while at < end and _white(raw[at : at + 1])[0]:
            at += 1
        at = _word_end(raw, at, end)
    return at


class Unit:
    """Words of some documents, or of a piece of one, and their probes of the index.

    first: the place of its first document in the bucket; base: words of that document
    in earlier pieces; own_bytes: where the next piece begins.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray | None, ids: np.ndarray, first: int, window: int, shards: int, base: int = 0, own_bytes: int | None = None) -> None:
        self.raw, self.ids, self.first, self.base, self.window, self.shards = raw, ids, first, base, window, shards
        self.offsets = np.array([0, len(raw)]) if offsets is None else offsets
        self.starts, self.ends, self.doc = word_bounds(raw, self.offsets)
        self.own = len(self.starts) if own_bytes is None else int(np.searchsorted(self.starts, own_bytes))
        self.pieced, block = own_bytes is not None, window // 2
        self.letters = raw[~_white(raw)]
        values, _ = word_hashes(self.letters, self.ends - self.starts)
        self.id_of = self.ids[self.doc] if len(self.doc) else np.zeros(0, np.int64)
        n = self.n = len(values)
        probe = rolling(prefix(values), block)
        ok = self.doc[: len(probe)] == self.doc[block - 1 :][: len(probe)]
        self.at = np.flatnonzero(ok)
        begins = np.searchsorted(self.doc, np.arange(len(self.offsets) - 1))
        aligned = (np.arange(n) + base - begins[self.doc]) % block == 0 if n else np.zeros(0, bool)
        probe = probe[self.at]
        order, begin = groups(probe)
        self.keys = probe[order[begin]] if len(order) else probe
        self.group = np.zeros(len(order), np.int64)
        self.group[order] = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(order)]))
        if len(order):
            ids = self.id_of[self.at][order]
            self.many = np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin)
            self.aligned = np.logical_or.reduceat(aligned[self.at][order], begin)
        else:
            self.many = self.aligned = np.zeros(0, bool)
        self.cut = pieces(*by_shard(self.keys, shards))

    def probes(self, bucket: int) -> pa.Table:
        return pa.table(
            {
                "shard": pa.array([s for s, _ in self.cut], pa.int32()),
                "bucket": pa.array([bucket] * len(self.cut), pa.int32()),
                "keys": pa.array([(self.keys[p] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() for _, p in self.cut], pa.binary()),
                "aligned": pa.array([self.aligned[p].tobytes() for _, p in self.cut], pa.binary()),
            }
        )

    def candidates(self, reply: pa.Table, taken: dict[int, int]) -> Unit:
        """Extend the hits: all full windows that hold one and begin in the unit's own words."""
        hit = (self.many & self.aligned) | answered(len(self.keys), self.cut, reply, taken)
        n, w = self.n, self.window
        here = np.zeros(n + 1, np.int64)
        here[self.at[hit[self.group]] + 1] = 1
        seen = np.cumsum(here)
        m = min(self.own, max(0, n - w + 1))
        span = seen[w - w // 2 + 1 :][:m] - seen[:m]
        self.windows = np.flatnonzero((span > 0) & (self.doc[:m] == self.doc[w - 1 :][:m])) if m else np.zeros(0, np.int64)
        whole = self.digests()
        order, begin = groups(whole[:, 1], whole[:, 0])
        self.a, self.b = (whole[order[begin], k] if len(order) else whole[:, k] for k in (0, 1))
        self.window_group = np.zeros(len(order), np.int64)
        self.window_group[order] = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(order)]))
        self.least = np.minimum.reduceat(self.id_of[self.windows][order], begin) if len(order) else np.zeros(0, np.int64)
        self.window_cut = pieces(*by_shard(self.a, self.shards))
        return self

    def digests(self) -> np.ndarray:
        """XXH3-128 of each candidate window's words, joined by one space."""
        import xxhash

        if not len(self.windows):
            return np.zeros((0, 2), np.uint64)
        lengths = self.ends - self.starts
        spaced = np.full(len(self.letters) + self.n, 32, np.uint8)
        spaced[np.arange(len(self.letters)) + np.repeat(np.arange(self.n), lengths)] = self.letters
        ends = np.cumsum(lengths + 1) - 1
        begins, data, h = ends - lengths, memoryview(spaced), xxhash.xxh3_128_digest
        lo, hi = begins[self.windows].tolist(), ends[self.windows + self.window - 1].tolist()
        return np.frombuffer(b"".join([h(data[a:b]) for a, b in zip(lo, hi, strict=True)]), "<u8").reshape(-1, 2)

    def windows_sent(self, bucket: int) -> pa.Table:
        cut = self.window_cut
        blob = lambda x: pa.array([x[p].tobytes() for _, p in cut], pa.binary())
        return pa.table({"shard": pa.array([s for s, _ in cut], pa.int32()), "bucket": pa.array([bucket] * len(cut), pa.int32()), "a": blob(self.a), "b": blob(self.b), "least": blob(self.least)})

    def removed(self, reply: pa.Table, taken: dict[int, int]) -> np.ndarray:
        """For each word of the unit, those after its own too: is it in a window that goes?"""
        smaller = answered(len(self.a), self.window_cut, reply, taken)
        gone = smaller[self.window_group] | (self.id_of[self.windows] > self.least[self.window_group])
        at = self.windows[gone]
        step = np.zeros(self.n + 1, np.int64)
        step[at] += 1
        step[at + self.window] -= 1
        return np.cumsum(step[:-1]) > 0


class Texts:
    """What is left of a bucket's documents, unit by unit."""

    def __init__(self, names: list) -> None:
        self.names = names
        self.n_words, self.spans, self.parts = ([make() for _ in names] for make in (int, list, list))
        self.carry = np.zeros(0, bool)

    def add(self, unit: Unit, removed: np.ndarray) -> None:
        if unit.base == 0:
            self.carry = np.zeros(0, bool)
        removed[: len(self.carry)] |= self.carry[: len(removed)]
        self.carry = removed[unit.own :] if unit.pieced else np.zeros(0, bool)
        bounds = np.searchsorted(unit.doc[: unit.own], np.arange(len(unit.offsets)))
        data = unit.raw.tobytes()
        for k in range(len(unit.offsets) - 1):
            i, j, d = bounds[k], bounds[k + 1], unit.first + k
            self.n_words[d] += int(j - i)
            r = removed[i:j]
            if r.any():
                flips = np.flatnonzero(np.diff(np.r_[False, r, False].astype(np.int8)))
                for x, y in (flips.reshape(-1, 2) + unit.base).tolist():
                    if self.spans[d] and self.spans[d][-1]["end"] == x:
                        self.spans[d][-1]["end"] = y
                    else:
                        self.spans[d].append({"start": x, "end": y})
                stay = np.flatnonzero(~r) + i
                words = [data[x:y] for x, y in zip(unit.starts[stay].tolist(), unit.ends[stay].tolist(), strict=True)]
            elif j > i:
                words = data[unit.starts[i] : unit.ends[j - 1]].split()
            else:
                words = []
            if words:
                self.parts[d].append(b" ".join(words))

    def table(self) -> pa.Table:
        return pa.table(
            {
                "id": pa.array(self.names, pa.int64()),
                "n_words": pa.array(self.n_words, pa.int64()),
                "spans": pa.array(self.spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept": pa.array([b" ".join(p) for p in self.parts], pa.binary()).cast(pa.string()),
            }
        )


def _shared_blocks(t: pa.Table) -> pa.Table:
    """Entries whose hash is in the index and in another bucket."""
    keys, at = gathered(t, "keys", np.uint32)
    aligned, _ = gathered(t, "aligned", np.bool_)
    order, begin = groups(keys)
    bits = np.zeros(len(keys), bool)
    if len(order):
        size = np.diff(np.r_[begin, len(order)])
        bits[order] = np.repeat((size > 1) & np.logical_or.reduceat(aligned[order], begin), size)
    return replies(t, bits, at)


def _smaller_elsewhere(t: pa.Table) -> pa.Table:
    """Entries whose window a document of another bucket with a smaller id has."""
    if (passed := handed_on(t)) is not None:
        return passed
    a, at = gathered(t, "a", np.uint64)
    b, _ = gathered(t, "b", np.uint64)
    least, _ = gathered(t, "least", np.int64)
    order, begin = groups(b, a)
    bits = np.zeros(len(a), bool)
    if len(order):
        size = np.diff(np.r_[begin, len(order)])
        bits[order] = np.repeat(np.minimum.reduceat(least[order], begin), size) < least[order]
    return replies(t, bits, at)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, spans, kept) for each row: removed word spans, half-open, and the kept words.

    A word goes if it is in a run of `window` words that also starts in a document
    with a smaller id, judged on the input.
    """
    rows, shards = bucketed(docs, id_col, text_col)

    def probe(key: tuple, t: pa.Table) -> pa.Table:
        return combined([u.probes(key[0].as_py()) for u in units(t, window, shards)])

    def extend(key: tuple, t: pa.Table, reply: pa.Table) -> pa.Table:
        taken: dict[int, int] = {}
        sent = combined([u.candidates(reply, taken).windows_sent(key[0].as_py()) for u in units(t, window, shards)])
        return pa.concat_tables([sent, onward(key[0].as_py(), reply)])

    def finish(key: tuple, t: pa.Table, reply: pa.Table) -> pa.Table:
        first, second = told(reply)
        taken, taken_windows = {}, {}
        texts = Texts(t.column("id").to_pylist())
        for u in units(t, window, shards):
            texts.add(u, u.candidates(first, taken).removed(second, taken_windows))
        return texts.table()

    by_bucket = rows.groupBy("bucket")
    hits = by_bucket.applyInArrow(probe, "shard int, bucket int, keys binary, aligned binary").groupBy("shard").applyInArrow(_shared_blocks, ANSWER)
    sent = by_bucket.cogroup(hits.groupBy("bucket")).applyInArrow(extend, "shard int, bucket int, a binary, b binary, least binary")
    verdicts = sent.groupBy("shard").applyInArrow(_smaller_elsewhere, ANSWER)
    return by_bucket.cogroup(verdicts.groupBy("bucket")).applyInArrow(finish, RESULT).withColumnRenamed("id", id_col)
