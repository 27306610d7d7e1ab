"""Bucketed questions and answers: whole-corpus lookups in bounded, even tasks.

Documents are dealt into buckets of a few MB by their ids. A bucket condenses what
it wants to know into one sorted list of distinct hashes for each shard of the
hash space, however often a hash occurs in it; a shard sees at most one entry for
each bucket and hash, and answers with one bit for each entry. So neither a
passage that a third of all documents share nor a large group of copies makes a
large group: an entry for each bucket is the most. The bucketed documents are one
exchange that all rounds of a plan reuse, and a lost executor costs only the
recomputation of its buckets, which give the same lists again.

A bucket is worked on in units of some MB: documents, or pieces of one very long
text that overlap by a window, so arrays beside the text have a bound. Every bucket
sends a row to every shard; up to LINEAR_BYTES of text that is little, and beyond it
buckets and shards both grow with the square root of the text, so the rows of a round
grow as the text does (one for each BUCKET_BYTES * SHARD_BYTES / LINEAR_BYTES of it).
"""

from __future__ import annotations

import math
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a bucket and, for each shard, in all, up to LINEAR_BYTES of text.
BUCKET_BYTES = 4 << 20
SHARD_BYTES = 12 << 20
LINEAR_BYTES = 32 << 30
#: Bytes of text that a bucket works on at once.
UNIT_BYTES = 8 << 20

ANSWER = "bucket int, shard int, bits binary"

_BASE, _BASE2 = 0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F | 5


def powers(n: int, base: int = _BASE, inverse: bool = False) -> np.ndarray:
    """base ** i (or its inverse) modulo 2 ** 64 for i < n.

    The tables belong to the process, in a module of their own: globals of functions
    that came by value would be made anew for each task and linger until the garbage
    collector finds them.
    """
    tables = sys.modules.setdefault("tessera_llm_kept", types.ModuleType("tessera_llm_kept")).__dict__.setdefault("powers", {})
    found = tables.get((base, inverse))
    if found is None or len(found) < n:
        b = np.full(max(n, 1 << 16), pow(base, -1, 1 << 64) if inverse else base, np.uint64)
        b[0] = 1
        found = tables[base, inverse] = np.cumprod(b, out=b)
    return found[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A value for each byte, from the rule mix(i + 1).
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def prefix(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Prefix sums of values[i] * base ** i; one longer than values."""
    return summed(np.array(values, np.uint64), base)


def summed(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """prefix(), in one array of its own size besides the values, which it overwrites."""
    values *= powers(len(values), base)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def rolling(sums: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """The polynomial hash of each window of k values."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = sums[k:] - sums[:-k]
    out *= powers(n, base, True)
    return mix(out)


def dealt(total: int, shard_share: int = 1) -> tuple[int, int]:
    """How many buckets and shards so many bytes of text have."""
    growth = max(1.0, math.sqrt(total / LINEAR_BYTES))
    buckets, shards = (max(1, math.ceil(total / (growth * x))) for x in (BUCKET_BYTES, SHARD_BYTES / shard_share))
    return buckets, shards


def bucketed(docs: DataFrame, id_col: str, text_col: str, shard_share: int = 1) -> tuple[DataFrame, int]:
    """(id long, text string, bucket int) and the number of shards, shard_share times the usual; all from the size of the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets, shards = dealt(total, shard_share)
    bucket = F.pmod(F.xxhash64(F.col(id_col), F.octet_length(text)), F.lit(buckets)).cast("int")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), bucket.alias("bucket")), shards


def layout(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """All bytes of a bucket, the documents' offsets, ids for comparison (null: the smallest), and ids."""
    text = t.column("text").combine_chunks()
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
    large = pa.types.is_large_string(text.type)
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    ids = t.column("id").to_pylist()
    return raw, offsets - offsets[0], np.array([-(1 << 63) if i is None else i for i in ids], np.int64), ids


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the place of each one's document."""
    n = len(raw)
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.r_[False, word[:-1]], np.r_[word[1:], False]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    ends = np.flatnonzero(word & (~after | edge[1 : n + 1])) + 1
    return starts, ends, np.searchsorted(offsets[:-1], starts, side="right") - 1


def word_hashes(letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word, the halves of XXH3-128 of its bytes.

    letters: the bytes of all words, one after the other. Distinct words are hashed once.
    """
    import xxhash

    if not len(lengths):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))]).dictionary_encode()
    own = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_pylist())), "<u8").reshape(-1, 2)
    at = coded.indices.to_numpy()
    return own[at, 0], own[at, 1]


def by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each of these sorted distinct hashes, and their order by shard."""
    shard = ((keys >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
    return shard, np.argsort(shard, kind="stable")


def pieces(shard: np.ndarray, order: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(shard, places) for each shard that has any."""
    s = shard[order]
    if not len(s):
        return []
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    return [(int(s[a]), order[a:b]) for a, b in zip(starts, np.r_[starts[1:], len(s)], strict=True)]


def answered(n: int, cut: list[tuple[int, np.ndarray]], reply: pa.Table, taken: dict[int, int]) -> np.ndarray:
    """The answers' bits, in the order of a unit's own list; taken: bits of each shard that earlier units had."""
    out = np.zeros(n, bool)
    got = dict(zip(reply.column("shard").to_pylist(), reply.column("bits").to_pylist(), strict=True))
    for shard, places in cut:
        begin = taken.get(shard, 0)
        taken[shard] = begin + len(places)
        if (bits := got.get(shard)) is not None:
            out[places] = bits_of(bits, begin, len(places))
    return out


def bits_of(bits: bytes, begin: int, n: int) -> np.ndarray:
    some = np.frombuffer(bits, np.uint8)[begin // 8 : -(-(begin + n) // 8)]
    return np.unpackbits(some, count=begin % 8 + n)[begin % 8 :].astype(bool)


def combined(tables: list[pa.Table]) -> pa.Table:
    """What the units of a bucket send, as one row for each shard."""
    if len(tables) == 1:
        return tables[0]
    blobs = [c for c in tables[0].column_names if c not in ("shard", "bucket")]
    rows: dict[int, list[list[bytes]]] = {}
    for t in tables:
        columns = [t.column(c).to_pylist() for c in blobs]
        for k, shard in enumerate(t.column("shard").to_pylist()):
            for to, column in zip(rows.setdefault(shard, [[] for _ in blobs]), columns, strict=True):
                to.append(column[k])
    bucket = next((t.column("bucket")[0].as_py() for t in tables if t.num_rows), 0)
    made = {"shard": pa.array(rows, pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32())}
    return pa.table(made | {c: pa.array([b"".join(r[k]) for r in rows.values()], pa.binary()) for k, c in enumerate(blobs)})


def whole_units(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Runs of documents of UNIT_BYTES at most, or of one document."""
    out, d = [], 0
    while d < len(offsets) - 1:
        e = max(d + 1, int(np.searchsorted(offsets, offsets[d] + UNIT_BYTES, side="right")) - 1)
        out.append((d, e))
        d = e
    return out


def gathered(t: pa.Table, column: str, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """What all buckets sent in a column, as one array, and where each begins."""
    blobs = t.column(column).to_pylist()
    sizes = np.array([len(b) // np.dtype(dtype).itemsize for b in blobs], np.int64)
    return np.frombuffer(b"".join(blobs), dtype), np.r_[0, np.cumsum(sizes)]


def replies(t: pa.Table, bits: np.ndarray, at: np.ndarray) -> pa.Table:
    """One row of ANSWER for each bucket with an answer that is true."""
    rows = [(b, s, np.packbits(bits[i:j]).tobytes()) for b, s, i, j in zip(t.column("bucket").to_pylist(), t.column("shard").to_pylist(), at[:-1], at[1:], strict=True) if bits[i:j].any()]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "shard": pa.array([r[1] for r in rows], pa.int32()), "bits": pa.array([r[2] for r in rows], pa.binary())})


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal keys together, and the starts of their groups."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def onward(bucket: int, reply: pa.Table, columns: tuple[str, ...] = ("a", "b", "least")) -> pa.Table:
    """A row that hands a bucket's first answers on to its last round, past the shards."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, reply.schema) as out:
        out.write_table(reply)
    blobs = [sink.getvalue().to_pybytes(), *[b""] * (len(columns) - 1)]
    return pa.table({"shard": pa.array([-1 - bucket], pa.int32()), "bucket": pa.array([bucket], pa.int32())} | {c: pa.array([b], pa.binary()) for c, b in zip(columns, blobs, strict=True)})


def handed_on(t: pa.Table, column: str = "a") -> pa.Table | None:
    """In a shard's place: such a row as an answer, or None for a real shard."""
    if t.num_rows != 1 or t.column("shard")[0].as_py() >= 0:
        return None
    return pa.table({"bucket": t.column("bucket"), "shard": t.column("shard"), "bits": t.column(column)})


def told(reply: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The answers of the first round and those of the second."""
    first = [b for s, b in zip(reply.column("shard").to_pylist(), reply.column("bits").to_pylist(), strict=True) if s < 0]
    return pa.ipc.open_stream(first[0]).read_all(), reply.filter(pa.array([s >= 0 for s in reply.column("shard").to_pylist()], pa.bool_()))
