"""Cost-balanced packing of tokenised documents into training sequences.

A document's cost in a sequence is a linear part and a quadratic one, as attention
has. Whole sequences are cut from long documents first. What remains is gathered
until it fills some hundred sequences, sorted by descending cost, and each piece
goes to the sequence with the lowest cost so far that has capacity left; what does
not fit there goes on to the next one. As pieces may be cut, all sequences of a
batch fill up, and the last tokens wait for the next batch. What remains at the
end of a partition is cut into sequences of powers of two, which need no padding.

Each partition of the input packs its own documents, so nothing is shuffled, and
memory holds one batch. A sequence's id is the partition's number and a counter.

Tokens: a document's ids are those of the tokenizer, without special tokens, and
an end id. The BPE vocabulary splits text at white space into words and words into
pre-tokens that are independent of each other, so ids are kept by word, as many as
a bounded table holds. Texts with characters outside a set whose lower case and
normal form are plain go through the tokenizer as they are. The literals of special
tokens are text like any other, or, with special_tokens, get the tokens' own ids as
tokenizer.encode gives them; texts with one go through the tokenizer then.

Defined cases: a null text is empty and has the end id only; repeated rows are
packed each; null ids are carried; texts of any length are cut; an empty table
gives no pieces; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CAPACITY = 4096
END_ID = 2
BATCH_SEQUENCES = 256
QUADRATIC = 1 / 4096

RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Characters whose lower case and NFC form are themselves or one plain character.
ODD = re.compile("[^\t\n\r -~¡¿§«»À-ÖØ-öø-ÿĀ-įıĴ-ňŊ-ž‐-‧]")
#: The tokenizer's pre-tokens within a word of such characters.
PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w]|_)+")
#: How the byte-level alphabet writes a byte: printable ones as they are, the others from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: 256 + n for n, b in enumerate(x for x in range(256) if x not in PRINTABLE)}
#: Words kept in the table at most.
TABLE_WORDS = 300_000


class Encoder:
    """Ids of texts, by word."""

    def __init__(self, path: str, table_words: int = TABLE_WORDS, special_tokens: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special_tokens
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()] if special_tokens else []
        self.added = re.compile("|".join(added), re.IGNORECASE) if added else None
        self.model = self.tokenizer.model
        self.table_words = table_words
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.parts: dict[str, list[int]] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.begin, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def shrink(self) -> None:
        """Keep the half that was learned first: frequent words are met early."""
        keep = len(self.words) // 2
        self.words, self.parts = dict(islice(self.words.items(), keep)), {}
        self.used = int(self.begin[keep - 1] + self.count[keep - 1]) if keep else 0

    def places(self, words: list[str]) -> np.ndarray:
        """Places in the table, -1 for words that are not in it."""
        return np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))

    def learn(self, new: list[str]) -> None:
        split = [PRE.findall(w) for w in new]
        parts, tokenize = self.parts, self.model.tokenize
        for p in {p for s in split for p in s}.difference(parts):
            plain = p if p.isascii() else p.encode().decode("latin-1").translate(BYTE_LEVEL)
            parts[p] = [t.id for t in tokenize(plain)]
        ids = [[i for p in s for i in parts[p]] if len(s) > 1 else parts[s[0]] for s in split]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        first, total = len(self.words), int(counts.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        while first + len(new) > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.begin, self.count))
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.begin[first : first + len(new)] = self.used + np.cumsum(counts) - counts
        self.count[first : first + len(new)] = counts
        self.words.update(zip(new, range(first, first + len(new)), strict=True))
        self.used += total

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Many short texts at once are cheaper than one by one."""
        odd = [bool(ODD.search(t) or self.added and self.added.search(t)) for t in texts]
        words = [[] if o else t.lower().split() for t, o in zip(texts, odd, strict=True)]
        flat = list(chain.from_iterable(words))
        at = self.places(flat)
        if len(unknown := np.flatnonzero(at < 0)):
            new = {flat[i] for i in unknown.tolist()}
            if len(self.words) + len(new) > self.table_words:
                self.shrink()
                new, unknown = set(flat).difference(self.words), np.arange(len(flat))
            self.learn(list(new))
            at[unknown] = self.places([flat[i] for i in unknown.tolist()])
        counts = self.count[at]
        ends = np.cumsum(counts)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[at] - ends + counts, counts)]
        cuts = np.r_[0, ends][np.cumsum([0, *map(len, words)])]
        out = [ids[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        for k in (k for k, o in enumerate(odd) if o):
            out[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, np.uint32)
        return out


def encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder, chars: int = 1 << 18) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, token ids) of every row; texts are encoded some at a time."""
    docs, texts, size = [], [], 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            docs.append(doc)
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= chars:
                yield from zip(docs, encoder.encode(texts), strict=True)
                docs, texts, size = [], [], 0
    yield from zip(docs, encoder.encode(texts), strict=True)


def cost(n: int, quadratic: float = QUADRATIC) -> float:
    return n + quadratic * n * n


class Packer:
    """Packs the documents of a partition; pieces are (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, first: int, capacity: int = CAPACITY, batch: int = BATCH_SEQUENCES, quadratic: float = QUADRATIC) -> None:
        self.next, self.capacity, self.batch, self.quadratic = first, capacity, batch, quadratic
        self.waiting: list[tuple] = []
        self.tokens = 0

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        n, c = len(ids), self.capacity
        for start in range(0, n - c + 1, c):
            yield doc, start, ids[start : start + c], n, self.next, 0
            self.next += 1
        if rest := n % c:
            self.waiting.append((doc, n - rest, ids[n - rest :].copy() if n > c else ids, n))
            self.tokens += rest
            if self.tokens >= self.batch * c:
                yield from self.pack([c] * (self.tokens // c))

    def finish(self) -> Iterator[tuple]:
        if self.tokens >= self.capacity:
            yield from self.pack([self.capacity] * (self.tokens // self.capacity))
        if self.tokens:
            yield from self.pack([1 << k for k in range(self.tokens.bit_length() - 1, -1, -1) if self.tokens >> k & 1])

    def pack(self, capacities: list[int]) -> Iterator[tuple]:
        """Fill sequences of these capacities; what is left over goes on waiting."""
        open_ = [(0.0, self.next + k) for k in range(len(capacities))]
        left, filled = dict(zip((s for _, s in open_), capacities, strict=True)), dict.fromkeys((s for _, s in open_), 0)
        self.next += len(capacities)
        pieces, self.waiting, self.tokens = sorted(self.waiting, key=lambda p: -len(p[2])), [], 0
        for doc, start, ids, n in pieces:
            while len(ids) and open_:
                spent, s = heapq.heappop(open_)
                part = ids[: left[s]]
                yield doc, start, part, n, s, filled[s]
                filled[s] += len(part)
                left[s] -= len(part)
                start, ids = start + len(part), ids[len(part) :]
                if left[s]:
                    heapq.heappush(open_, (spent + cost(len(part), self.quadratic), s))
            if len(ids):
                self.waiting.append((doc, start, ids, n))
                self.tokens += len(ids)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, capacity: int = CAPACITY, batch: int = BATCH_SEQUENCES, quadratic: float = QUADRATIC, with_ids: bool = False, special_tokens: bool = False) -> DataFrame:
    """A row for each piece, RESULT; with_ids adds the ids themselves.

    tokenizer: path of the tokenizer's file. It is read here and sent along, so
    executors need no copy of it.
    """
    with open(tokenizer, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    name = f"encoder-{zlib.crc32(shared.value)}-{len(shared.value)}-{special_tokens}"
    schema = RESULT.replace("doc_id", f"`{id_col}`", 1) + (", ids array<long>" if with_ids else "")

    def rows(found: list[tuple]) -> pa.RecordBatch:
        docs_, starts, ids, totals, sequences, offsets = zip(*found, strict=True)
        columns = [
            pa.array(docs_, pa.int64()),
            pa.array(starts, pa.int64()),
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
            pa.array(totals, pa.int64()),
            pa.array(sequences, pa.int64()),
            pa.array(offsets, pa.int64()),
        ]
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            columns.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import sys
        import tempfile
        import types

        from pyspark import TaskContext

        # one table of words for all tasks of a worker
        kept = sys.modules.setdefault("tessera_llm_kept", types.ModuleType("tessera_llm_kept")).__dict__
        encoder = kept.get(name)
        if encoder is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            with tempfile.NamedTemporaryFile(suffix=".json") as copy:  # the library reads only files; gone at once
                copy.write(shared.value)
                copy.flush()
                encoder = kept[name] = Encoder(copy.name, special_tokens=special_tokens)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, batch, quadratic)
        end, found = np.array([end_id], np.uint32), []
        for doc, ids in encoded(batches, encoder):
            found += packer.add(doc, np.concatenate([ids, end]))
            if len(found) >= 4096:
                yield rows(found)
                found = []
        if found := [*found, *packer.finish()]:
            yield rows(found)

    return docs.select(docs[id_col].cast("long").alias(id_col), text_col).mapInArrow(run, schema)
