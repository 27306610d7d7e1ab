"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A fingerprint has 64 bits: bit j is set if over half of the shingles' XXH64
values (seed 42) have it. Cut into 2-bit segments, a fingerprint maps to its
segments' bit counts; the Manhattan distance of two such vectors is at most the
Hamming distance of the fingerprints. At a distance of at most 3, one half of the
vector (16 segments) is at most 1 apart. So every distinct fingerprint enters,
for each half, the grid cell of its own counts as a point, and the cells with
one count raised by one as a visitor; a cell compares its points with all that
it holds, first by the Manhattan bound over all segments, then by the exact
Hamming distance. Larger limits use more parts of the vector, so that one part is
at most 1 apart: the grid finds every link within its limit.

Near copies in a corpus (one_of_each) are further apart than any such grid can
hold, so their fingerprints are made for it (Bands): four words of 64 bits over
all shingles of one to five words. The share of differing bits estimates the angle
between two documents' shingle counts; the limit is the angle of a similarity
(cosine) of 0.8. Counts alone make all long texts of a language alike, by their
frequent words. So a second fingerprint (NEAR) takes each word and each pair of words
of a text once; it goes through the grid first, with a limit of 0.7, and near copies
are looked for within its classes: pair by pair, in large classes by a grid of the
counts' fingerprints. Segments of the grid have one bit there, as counts of wider ones
make cells coarser; a part has 18 of them. Bits flip where a document's shingles
are nearly balanced, so a document visits the cells that its four least certain
bits of a part lead to, instead of all neighbours. What meets is compared over all
256 bits. Recall is measured, not certain; see the README.

Equal texts share a fingerprint and are one node. A cell emits links that span
its linked sets, not all pairs. Cells above a size are dealt into chunks, and each
pair of chunks is a cell of its own, so no task gets an unbounded cell and every
pair still meets. Joins on keys that may hold most rows go through hot_join.

Defined cases: null and empty texts and texts of white space have fingerprint
zero and are linked like any other; texts of fewer words than a shingle are one
shingle; very long texts are taken whole, some thousand shingles at a time, and where
repeats count once, with a list of all their shingles' hashes;
repeated rows are in one class, each is returned by classes, and one stays in
one_of_each; a null id takes part and never names a class unless all its members
are null; ids may have any type that has an order; an empty table gives an empty
result; other columns are not read, and those of one_of_each may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import cut
from ._exchange import layout, mix, word_bounds, word_hashes
from .components import components, hot_join

#: A cell with more rows is dealt into chunks of so many.
CELL_ROWS = 50_000
#: A class of alike texts with more fingerprints is searched by a grid of its own, a smaller one pair by pair.
CLASS_ROWS = 2_000
#: Of near copies: cosine of their shingles, at least.
SIMILARITY = 0.8
#: Of alike texts, among which near copies are looked for: cosine of what they hold, at least.
ALIKE = 0.7


@dataclass(frozen=True)
class Bands:
    """Fingerprints of near copies: words of 64 bits, widths of shingles, parts of the grid, their bits, uncertain bits kept of each, and whether repeats of a shingle count once."""

    words: int = 4
    widths: tuple[int, ...] = (1, 2, 3, 4, 5)
    parts: int = 14
    bits: int = 18
    weak: int = 4
    distinct: bool = False

    def limit(self, similarity: float) -> int:
        return int(64 * self.words * math.acos(similarity) / math.pi)

    @property
    def per_long(self) -> int:
        """Parts whose uncertain bits fit one long."""
        return 1 if self.bits < 2 else int(62 // (self.weak * math.log2(self.bits)))

    @property
    def weak_names(self) -> list[str]:
        return [f"weak{k}" for k in range(-(-self.parts // self.per_long))]


#: Fingerprints of the words and pairs of words that a text has, each once; near copies must agree on them too.
NEAR = Bands(widths=(1, 2), distinct=True)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint of the whole text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    if n == 1:
        return h(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        values = np.array([h(joined[a:b], 42) for a, b in zip(starts[i : min(n, i + 8192)].tolist(), ends[i + width - 1 : i + width - 1 + 8192].tolist(), strict=True)], np.uint64)
        counts += bit_counts(values[:, None])
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def bit_counts(values: np.ndarray) -> np.ndarray:
    """How many rows have each bit; values has a column for each word."""
    n = len(values)
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    whole = n - n % 255  # sums of 255 bits fit a byte
    out = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        out += bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long, for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def balance(words: np.ndarray, shape: Bands) -> tuple[np.ndarray, int]:
    """For each bit how many shingles have it, and the number of shingles, of all widths; words are hashes."""
    counts, total = np.zeros(64 * shape.words, np.int64), 0
    pieces = shingles(words, shape.widths)
    if shape.distinct:  # over the whole text
        every = np.unique(np.concatenate([words[:0], *pieces]))
        pieces = (every[i : i + 32768] for i in range(0, len(every), 32768))
    for piece in pieces:
        values = np.empty((len(piece), shape.words), np.uint64)
        values[:, 0] = mix(piece)
        for k in range(1, shape.words):
            values[:, k] = mix(values[:, k - 1] ^ np.uint64(k))
        counts += bit_counts(values)
        total += len(values)
    return counts, total


def shingles(words: np.ndarray, widths: tuple[int, ...], step: int = 8192) -> Iterator[np.ndarray]:
    """Hashes of all shingles of these widths, those that start in some thousand words at a time."""
    longest = max(widths)
    for i in range(0, len(words), step):
        part = words[i : i + step + longest - 1]
        h, found = part, []
        for width in range(1, longest + 1):
            if width in widths:
                found.append(h[:step])
            h = mix(h[:-1] * np.uint64(3) + part[width:])
        yield np.concatenate(found)


def wide_fingerprint(words: np.ndarray, shape: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Words of the fingerprint, and the least certain bits of each part, packed."""
    counts, total = balance(words, shape)
    margin = np.abs(2 * counts - total)[: shape.parts * shape.bits].reshape(shape.parts, shape.bits)
    weakest = np.argsort(margin, axis=1, kind="stable")[:, : shape.weak]
    codes = weakest @ (shape.bits ** np.arange(shape.weak))
    longs = np.zeros(len(shape.weak_names) * shape.per_long, np.int64)
    longs[: shape.parts] = codes
    packed = longs.reshape(-1, shape.per_long) @ (shape.bits ** (shape.weak * np.arange(shape.per_long)))
    return np.packbits(2 * counts > total, bitorder="little").view(np.uint64), packed


def wide_fingerprints(docs: DataFrame, text_col: str, *shapes: Bands) -> DataFrame:
    """The columns of docs without the text, the fingerprint's words, a long that names it, and its uncertain bits.

    Names of the columns of a second shape begin with s_.
    """
    rest = [c for c in docs.columns if c != text_col]
    names = [p + n for p, shape in zip(("", "s_"), shapes, strict=False) for n in [*fp_names(shape.words), "node", *shape.weak_names]]
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest] + [f"{n} long" for n in names]
    lower = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                raw, offsets, _, _ = layout(pa.table({"id": pa.nulls(b.num_rows, pa.int64()), "text": pc.fill_null(b.column(0), "")}))
                raw = lower[raw]
                starts, ends, doc = word_bounds(raw, offsets)
                words, _ = word_hashes(raw[~((raw == 32) | ((raw >= 9) & (raw <= 13)))], ends - starts)
                at = np.searchsorted(doc, np.arange(b.num_rows + 1))
                columns = []
                for shape in shapes:
                    fps, weak = zip(*(wide_fingerprint(words[x:y], shape) for x, y in zip(at[:-1], at[1:], strict=True)), strict=True)
                    fps, weak = np.stack(fps), np.stack(weak)
                    columns += [*(pa.array(fps[:, k].view(np.int64)) for k in range(shape.words)), pa.array(names_of(fps).view(np.int64)), *(pa.array(weak[:, k]) for k in range(weak.shape[1]))]
                yield pa.RecordBatch.from_arrays([*(b.column(1 + k) for k in range(len(rest))), *columns], names=[*rest, *names])

    return docs.select(text_col, *rest).mapInArrow(run, ", ".join(kinds))


def names_of(fps: np.ndarray) -> np.ndarray:
    """A number for each fingerprint: its word, or a hash of its words."""
    out = fps[:, 0]
    for k in range(1, fps.shape[1]):
        out = mix(out * np.uint64(5) + fps[:, k])
    return np.ascontiguousarray(out)


def named(df: DataFrame, words: list[str]) -> DataFrame:
    """df with names_of its words as node."""
    kind = StructType([*df.schema.fields, StructField("node", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(w).to_numpy(zero_copy_only=False) for w in words], 1).view(np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names_of(x).view(np.int64))], names=[*b.schema.names, "node"])

    return df.mapInArrow(run, kind)


def fp_names(words: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, words))]


def _counts(x: np.ndarray) -> np.ndarray:
    """Bit counts of the 2-bit segments, packed in the same places."""
    return x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of the segments' counts of two fingerprints' words."""
    # a count in unary (0, 01, 11) turns the distance into a number of bits
    unary = lambda c: c | ((c >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return np.bitwise_count(unary(_counts(a)) ^ unary(_counts(b)))


def parts_of(limit: int) -> int:
    """Parts of the vector, so that one of them is at most 1 apart."""
    parts = 1
    while limit // parts > 1:
        parts *= 2
    return parts


def grid_rows(fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and the rows of the fingerprints in them; the lowest bit of a cell tells visitors."""
    x = fps.view(np.uint64).reshape(-1)
    parts = parts_of(limit)
    bits = 64 // parts
    mask = np.uint64((1 << bits) - 1)
    cells, rows = [], []
    every = np.arange(len(x))
    counts = _counts(x)
    for part in range(parts):
        v = (counts >> np.uint64(part * bits)) & mask
        cells.append(_cell(v, part, False))
        rows.append(every)
        for j in range(0, bits, 2):
            up = np.flatnonzero(((v >> np.uint64(j)) & np.uint64(3)) < 2)
            cells.append(_cell(v[up] + (np.uint64(1) << np.uint64(j)), part, True))
            rows.append(up)
    return np.concatenate(cells), np.concatenate(rows)


def band_rows(fps: np.ndarray, weak: np.ndarray, shape: Bands) -> tuple[np.ndarray, np.ndarray]:
    """As grid_rows, for parts of one-bit segments: a row's own cell, one for each uncertain bit, and one for the two least certain together."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), 8 * fps.shape[1]), axis=1, bitorder="little")
    places = np.uint64(1) << np.arange(shape.bits, dtype=np.uint64)
    cells = []
    for part in range(shape.parts):
        v = bits[:, part * shape.bits : (part + 1) * shape.bits].astype(np.uint64) @ places
        code = weak[:, part // shape.per_long] // shape.bits ** (shape.weak * (part % shape.per_long))
        flips = [places[code // shape.bits**j % shape.bits] for j in range(shape.weak)]
        cells.append(_cell(v, part, False))
        cells += [_cell(v ^ f, part, True) for f in [*flips, flips[0] ^ flips[1]]]
    return np.concatenate(cells), np.tile(np.arange(len(fps)), len(cells))


def class_rows(fps: np.ndarray, weak: np.ndarray, large: np.ndarray, shape: Bands) -> tuple[np.ndarray, np.ndarray]:
    """As band_rows, for fingerprints whose last word is a class: a cell for each class, a grid in each large one."""
    few, many = np.flatnonzero(~large), np.flatnonzero(large)
    name = fps.view(np.uint64)[:, -1]
    cell, row = band_rows(np.ascontiguousarray(fps[many, :-1]), weak[many], shape)
    grid = (mix(cell.view(np.uint64) >> np.uint64(1) ^ mix(name[many[row]])) & ~np.uint64(1)) | (cell & 1).view(np.uint64)
    return np.concatenate([_cell(name[few], shape.parts, False), grid.view(np.int64)]), np.concatenate([few, many[row]])


def _cell(v: np.ndarray, part: int, visitor: bool) -> np.ndarray:
    name = np.uint64((part + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return ((mix(v ^ name) & ~np.uint64(1)) | np.uint64(visitor)).view(np.int64)


def _near(x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Pairs within the limit: x and y broadcast against each other, words last. The bound first, then the distance."""
    total = lambda f: sum(f(x[..., k], y[..., k]).astype(np.int16) for k in range(x.shape[-1]))
    near = total(_manhattan) <= limit
    if near.any():
        near &= total(lambda a, b: np.bitwise_count(a ^ b)) <= limit
    return near


def spanning_links(points: np.ndarray, others: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Places (of points, then others) of links within the limit between points and all, thinned to a forest.

    Both are unsigned, a column for each word; equal fingerprints are linked too.
    """
    x = np.concatenate([points, others])
    n, m = len(x), len(points)
    label, out = np.arange(n), []

    def join(me: int, hit: np.ndarray) -> None:
        _, first = np.unique(label[hit], return_index=True)
        for other in hit[first].tolist():
            low, high = sorted((int(label[other]), int(label[me])))
            if low != high:
                out.append((me, other))
                label[label == high] = low

    def block(p: np.ndarray, q: np.ndarray) -> None:
        step = max(1, (1 << 20) // max(1, len(q)))
        for i in range(0, len(p), step):
            near = _near(x[p[i : i + step]][:, None, :], x[q][None, :, :], limit)
            for r in np.flatnonzero(near.any(axis=1)):
                join(int(p[i + r]), q[near[r]])

    def meet(p: np.ndarray, q: np.ndarray, used: np.uint64) -> None:
        """One word: go on by sets of the bits that vary; pairs within the limit agree on one of limit + 1 sets."""
        if len(p) * len(q) <= 1 << 22:
            return block(p, q)
        w = x[q][:, 0]
        vary = (np.bitwise_or.reduce(w) ^ np.bitwise_and.reduce(w)) & ~used
        bits = [j for j in range(64) if int(vary) >> j & 1]
        if len(bits) < 2 * (limit + 1):
            return block(p, q)
        inside = np.isin(q, p)
        for k in range(limit + 1):
            mask = np.uint64(sum(1 << j for j in bits[k :: limit + 1]))
            order = np.argsort(w & mask, kind="stable")
            starts = np.flatnonzero(np.diff((w & mask)[order]) != 0) + 1
            for g in np.split(order, starts):
                pg = q[g][inside[g]]
                if len(pg) and len(g) > 1:
                    meet(pg, q[g], used | mask) if len(g) < len(q) else block(pg, q[g])
        return None

    every = np.arange(n)
    rest = every[:m]
    if n > 1024:  # pivots first: what is near one of them needs no comparison with the rest of its group
        for _ in range(32):
            pivot = int(rest[0])
            join(pivot, np.flatnonzero(_near(x[pivot : pivot + 1], x, limit)))
            values, sizes = np.unique(label, return_counts=True)
            large = values[sizes.argmax()]
            rest = np.setdiff1d(every[label != large], [pivot])
            if len(rest) < 64 or sizes.max() == 1:
                break
    if points.shape[1] > 1 or n <= 1024:
        block(rest, every)
    else:
        meet(rest, every, np.uint64(0))
    return out


def _cell_links(limit: int, words: int, rows: int = 1 << 17):
    """mapInArrow over rows (cell, words ...), clustered and sorted by cell: points first, then visitors."""

    def links(cell: np.ndarray, *fps: np.ndarray) -> pa.RecordBatch:
        x = np.stack(fps, 1).view(np.uint64)
        node, visitor, cell = names_of(x).view(np.int64), (cell & 1).astype(bool), cell >> 1
        none = np.zeros(0, np.int64)
        a, b = [none], [none]
        new = np.r_[True, cell[1:] != cell[:-1]]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(cell)])
        group = np.cumsum(new) - 1
        at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= 8), sizes))
        for s in range(1, 8):  # groups of up to eight: all at once, by shifts
            i, j = at[: max(0, len(at) - s)], at[s:]
            same = (group[i] == group[j]) & ~visitor[i] & (node[i] != node[j])
            i, j = i[same], j[same]
            near = _near(x[i], x[j], limit)
            a.append(node[i[near]])
            b.append(node[j[near]])
        for g in np.flatnonzero((sizes > 8) & ~visitor[starts]):
            own = np.arange(starts[g], starts[g] + sizes[g])
            m = int((~visitor[own]).sum())
            found = np.array(spanning_links(x[own[:m]], x[own[m:]], limit), np.int64).reshape(-1, 2)
            a.append(node[own[found[:, 0]]])
            b.append(node[own[found[:, 1]]])
        one, two = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)], 1)[one != two], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n >= rows:
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                last = np.flatnonzero(cols[0] >> 1 != cols[0][-1] >> 1)
                split = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
                if split:
                    yield links(*(c[:split] for c in cols))
                held, n = [[c[split:] for c in cols]], 0
        if held and len((cols := [np.concatenate(c) for c in zip(*held, strict=True)])[0]):
            yield links(*cols)

    return run


def near_links(fps: DataFrame, limit: int = 3, cell_rows: int = CELL_ROWS, shape: Bands | None = None, *, classed: bool = False) -> DataFrame:
    """(a, b), a < b: links of nodes that connect what chains of distances <= limit connect.

    fps has the words of distinct fingerprints, and with a shape their uncertain bits.
    A node is a fingerprint's one word, or names_of its words. If classed, a word more is
    a class and large tells of large ones; links are within classes.
    """
    words = shape.words + classed if shape else 1
    names, weak_names = fp_names(words), shape.weak_names if shape else []
    more = ["large"] if classed else []

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                columns = [c.to_numpy(zero_copy_only=False) for c in part.columns]
                x = np.stack(columns[:words], 1)
                if classed:
                    cell, row = class_rows(x, np.stack(columns[words:-1], 1), columns[-1].astype(bool), shape)
                else:
                    cell, row = band_rows(x, np.stack(columns[words:], 1), shape) if shape else grid_rows(x, limit)
                yield pa.RecordBatch.from_arrays([pa.array(cell), *(pa.array(x[row, k]) for k in range(words))], names=["cell", *names])

    columns = ", ".join(f"{n} long" for n in names)
    rows = fps.select(*names, *weak_names, *more).mapInArrow(emit, f"cell long, {columns}")
    place = F.call_function("shiftright", "cell", F.lit(1))
    hot = cut(rows.groupBy(place.alias("_place")).count().where(F.col("count") > cell_rows).select("_place", F.ceil(F.col("count") / cell_rows).cast("int").alias("_chunks")))
    if not hot.isEmpty():
        # every pair of chunks is a cell of its own; a row is in the pairs of its chunk
        chunk, n = F.pmod(F.xxhash64(*names), F.col("_chunks")).cast("int"), F.col("_chunks")
        pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.xxhash64(place, F.least(o, chunk), F.greatest(o, chunk)))
        marked = rows.withColumn("_place", place).join(hot, "_place", "left")
        named = marked.withColumn("_cell", F.explode(F.when(n.isNotNull(), pairs).otherwise(F.array(F.col("cell")))))
        even = F.col("_cell").bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(F.col("cell").bitwiseAND(F.lit(1).cast("long")))
        rows = named.select(even.alias("cell"), *names)
    return rows.repartition(place).sortWithinPartitions("cell").mapInArrow(_cell_links(limit, words), "a long, b long").distinct()


def _least(id_col: str, *more: str) -> Column:
    """Orders rows by id, null ids last."""
    return F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), *more))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, limit: int = 3) -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the smallest id of the class."""
    marked = cut(fingerprints(docs, id_col, text_col, width))
    nodes = cut(marked.groupBy("fp").agg(_least(id_col).alias("_least"), F.count("*").alias("n")))
    total, distinct = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    roots = components(near_links(nodes, limit)).withColumnRenamed("node", "fp")
    named = cut(nodes.join(roots, "fp", "left").withColumn("_root", F.coalesce("root", "fp")))
    least = named.groupBy("_root").agg(F.min("_least").alias("_first"), F.count("*").alias("n"))
    by_fp = hot_join(named.select("fp", "_root"), least.select("_root", "_first"), ["_root"], least, distinct).select("fp", F.col("_first.id").alias("component_id"))
    return hot_join(marked, by_fp, ["fp"], nodes, total).select(id_col, "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shape: Bands | None = None) -> DataFrame:
    """The rows of docs, all columns: of each class of near copies the one with the smallest id.

    Rows, not ids, are decided on: two texts of one id are two documents. Of rows with
    the same id and text one stays, whatever else differs.
    """
    shape = shape or Bands()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    names = [F.xxhash64(F.lit(k), F.col(id_col), F.col(text_col)) for k in (1, 2)]
    rows = docs.select(row, names[0].alias("_a"), names[1].alias("_b"))
    words, set_words = fp_names(shape.words), [f"s_{n}" for n in fp_names(NEAR.words)]
    texts = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("_id"), names[0].alias("_a"), names[1].alias("_b"))
    marked = cut(wide_fingerprints(texts, "_text", shape, NEAR))
    weak, set_weak = F.min(F.struct(*shape.weak_names)).alias("_weak"), F.min(F.struct(*(f"s_{n}" for n in NEAR.weak_names))).alias("_set_weak")
    grouped = marked.groupBy(*words, "s_node", *set_words).agg(_least("_id", "_a", "_b").alias("_least"), weak, set_weak)
    nodes = cut(grouped.select(*words, "s_node", *set_words, "_least", "_weak", "_set_weak.*"))
    # classes of texts that hold the same words and pairs, then near copies by counts within each
    sets = nodes.groupBy("s_node", *set_words).agg(set_weak).select("s_node", *set_words, "_set_weak.*")
    sets = sets.toDF(*(c.removeprefix("s_") for c in sets.columns))
    alike = components(near_links(sets, NEAR.limit(min(ALIKE, similarity)), shape=NEAR)).withColumnRenamed("node", "s_node")
    *_, class_ = keys = fp_names(shape.words + 1)
    of_class = nodes.join(alike, "s_node", "left").withColumn(class_, F.coalesce("root", "s_node"))
    once = of_class.groupBy(*keys).agg(F.min("_least").alias("_least"), F.min("_weak").alias("_weak"))
    classed = cut(named(once.select(*keys, "_least", "_weak.*"), keys))
    sizes = classed.groupBy(class_).agg(F.count("*").alias("n")).where("n > 1").select(class_, (F.col("n") > CLASS_ROWS).alias("large"))
    roots = components(near_links(classed.join(sizes, class_), shape.limit(similarity), shape=shape, classed=True))
    classes_ = classed.select("node", "_least").join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("_least").alias("_least"))
    stay = classes_.select("_least._a", "_least._b", F.lit(True).alias("stays"))
    same = marked.groupBy("_a", "_b").agg(F.count("*").alias("n"))
    # what is to be done is little: rows that go, and repeated rows of which one stays
    work = cut(same.join(stay, ["_a", "_b"], "left").where("stays IS NULL OR n > 1").select("_a", "_b", "stays"))
    plain = rows.join(work, ["_a", "_b"], "left_anti")
    once = rows.join(work.where("stays"), ["_a", "_b"], "left_semi").dropDuplicates(["_a", "_b"])
    return plain.unionByName(once).select("_row.*")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
