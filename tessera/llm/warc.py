"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of a group of records,
and at its end the seek table of the seekable format: a skippable frame with the
compressed and plain size of each frame. The index maps a page to its bundle,
frame and place in the frame, so one record is read by two small reads and the
decompression of one frame; tools that know only plain Zstandard read the whole.

Of pages with equal payloads, the one with the smallest id is a response record,
the others revisit it and carry no payload. Payloads count as equal by their SHA-256
(records show SHA-1, as the format has it, for which collisions are known). Digests
meet in a partial aggregation first, and only ids and digests are joined, by hot_join
where one payload has most pages, so a payload that a third of all pages share moves
no text. Bundles are written under a name of their own for each
attempt and moved into place when whole, in the folder that driver and executors
share; the index names only those of tasks that succeeded, so a lost executor
leaves at most an unused file.

Defined cases: a null html is an empty payload; payloads under min_revisit_bytes
are all responses; rows that repeat the response's id and payload are responses
too; null ids are carried and never referred to unless all equal pages lack one; a
null url has no target header, control characters in a url are percent-coded; page
ids are whole numbers (others are cast); a very long page is a frame of its own; an
empty table gives no bundles; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, fresh_dir
from .components import hot_join

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20

#: Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "page_id long, bundle string, frame int, frame_at long, frame_bytes long, at long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _name(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "null" else int(number)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has the response's HTTP header as its block."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    head += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower-case names) and block of the record at a place, and the place after it."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = end + 4
    n = int(head["content-length"])
    if data[block + n : block + n + 4] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return head, data[block : block + n], block + n + 4


def _filesystem(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class BundleWriter:
    """Writes frames to one file; what add() is given may be read once close() returns."""

    def __init__(self, folder: str, name: str, frame_bytes: int, level: int) -> None:
        import zstandard

        self.path = f"{folder}/{name}"
        self.fs, self.at_fs = _filesystem(self.path)
        self.out = self.fs.open_output_stream(self.at_fs + ".part")
        self.packer, self.frame_bytes = zstandard.ZstdCompressor(level=level, write_content_size=True), frame_bytes
        self.frames: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.size = self.written = 0
        self.index: list[tuple] = []
        self.pending: list[tuple] = []

    def add(self, page: int | None, data: bytes) -> None:
        if self.open and self.size + len(data) > self.frame_bytes:
            self.flush()
        self.pending.append((page, self.size, len(data)))
        self.open.append(data)
        self.size += len(data)

    def flush(self) -> None:
        if self.open:
            packed = self.packer.compress(b"".join(self.open))
            self.out.write(packed)
            self.index += [(page, self.path, len(self.frames), self.written, len(packed), at, n) for page, at, n in self.pending]
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.open, self.pending, self.size = [], [], 0

    def close(self) -> list[tuple]:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.fs.move(self.at_fs + ".part", self.at_fs)
        return self.index


def seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(place, compressed size, plain size) of each frame of an open bundle."""
    f.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    entry = 12 if flags & 0x80 else 8
    f.seek(size - 9 - n * entry)
    table, out, at = f.read(n * entry), [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", table, k * entry)
        out.append((at, packed, plain))
        at += packed
    return out


def classified(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to, revisit): which pages revisit which."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.unhex(F.sha2("html", 256))
    keys = own.where(F.octet_length("html") >= min_revisit_bytes).select("page_id", digest.alias("digest"))
    firsts = cut(keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = hot_join(keys, firsts.select("digest", "first"), ["digest"], firsts, total)
    again = found.where(~F.col("page_id").eqNullSafe(F.col("first"))).groupBy("page_id", "digest").agg(F.first("first").alias("refers_to"))
    again = again.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to", F.lit(True).alias("revisit"))
    same = own["page_id"].eqNullSafe(again["_page"]) & (F.unhex(F.sha2(own["html"], 256)) == again["_digest"])
    return own.join(again, same, "left").select("page_id", "url", "html", "refers_to", F.coalesce("revisit", F.lit(False)).alias("revisit"))


def write_bundles(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 3, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each page and return the index, fixed by a checkpoint.

    folder must be one that driver and executors share; the session's is the default.
    """
    folder = folder or fresh_dir(pages.sparkSession, "warc")
    names = [x.split()[0] for x in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, at = _filesystem(folder)
        fs.create_dir(at, recursive=True)
        part, out = TaskContext.get().partitionId(), None
        types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        done = lambda w: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*w.close(), strict=True), types, strict=True)], names=names)
        for b in batches:
            for page, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out = out or BundleWriter(folder, f"part-{part:05d}-{uuid.uuid4().hex}.warc.zst", frame_bytes, level)
                payload = html.encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                out.add(page, record(page, url, payload, digest, refers_to, revisit, date))
                if out.written >= bundle_bytes:
                    yield done(out)
                    out = None
        if out:
            yield done(out)

    return cut(classified(pages, min_revisit_bytes).mapInArrow(run, INDEX))


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the bundles that an index names, read back from the files and checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = _filesystem(path)
                with fs.open_input_file(at) as f:
                    for place, packed, plain in seek_table(f, f.size()):
                        f.seek(place)
                        data, k, rows = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=plain), 0, []
                        while k < len(data):
                            head, block, k = parse(data, k)
                            http, _, payload = block.partition(b"\r\n\r\n")
                            n = int(http.rpartition(b"Content-Length: ")[2])
                            kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                            if kind == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                                raise ValueError(f"{path}: the payload of {head['warc-record-id']} is damaged")
                            refers_to = head.get("warc-refers-to")
                            rows.append((_page(head["warc-record-id"]), n, digest, kind, refers_to and _page(refers_to)))
                        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    bundles = index.select("bundle").distinct()
    return bundles.repartition("bundle").mapInArrow(run, RECORD)


def fetch(index: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, payload) of some pages' own records by random access; revisits have a null payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in batches:
            rows = []
            for page, path, _, place, packed, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, name = _filesystem(path)
                with fs.open_input_file(name) as f:
                    f.seek(place)
                    data = zstandard.ZstdDecompressor().decompress(f.read(packed))
                head, block, _ = parse(data[at : at + n])
                rows.append((page, block.partition(b"\r\n\r\n")[2] if head["warc-type"] == "response" else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["page_id", "payload"])

    wanted = pages.select(F.col("page_id").cast("long").alias("page_id")).distinct()
    return index.join(wanted, "page_id", "left_semi").select(*[x.split()[0] for x in INDEX.split(", ")]).mapInArrow(run, "page_id long, payload binary")
