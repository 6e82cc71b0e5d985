"""Packing of documents into token windows by lexical retrieval.

Documents are brought into the order of their strongest terms over the whole table
(``routed``), so that related ones of all input splits meet. Every task cuts its range
of that order into index shards of a bounded number of tokens and
builds a BM25 inverted index over each shard's token ids. The first unused
document of a shard is the seed of a window; the index returns the unused
documents that score best for all terms the seed shares, and they fill the
window in that order. What does not fit is cut, and its rest opens the next
window, so windows are always full. When retrieval finds nothing more, the
next unused document follows. The last window of a task is cut into power-of-two
lengths, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .store import bounded_batches, stored
from .words import buffers, slices

WINDOW = 2048
SHARD_TOKENS = 1 << 20  # tokens indexed at once inside a task
ROUTE_TERMS = 4         # strongest terms of a document, in order, that place it
K1, B = 1.2, 0.75       # BM25 constants
COMMON = 16             # a term that a 16th of a shard's documents have is a row of a matrix
FEW = 24                # neighbours sorted at once


def by_term(ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and count of every distinct term of a document, by term and then by document (ids of 16 bits are
    sorted digit by digit)."""
    order = np.argsort(ids, kind="stable")
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))[order]
    term = ids[order]
    head = np.ones(len(term), bool)
    if len(term):
        head[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    return doc[at], term[at].astype(np.int32), np.diff(np.append(at, len(term)))


def by_document(ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same by document and then by term."""
    both, n = np.unique(np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(off)) << 32 | ids, return_counts=True)
    return both >> 32, both & 0xFFFFFFFF, n


class Bm25Index:
    """BM25 postings over the token ids of a shard's documents."""

    def __init__(self, ids: np.ndarray, off: np.ndarray):
        n = len(off) - 1
        size = np.diff(off)
        doc, term, tf = by_term(ids, off)
        tf = tf.astype(np.float32)
        terms = int(term[-1]) + 1 if len(term) else 0
        self.to = np.searchsorted(term, np.arange(terms + 1))
        df = np.diff(self.to)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32)
        norm = (K1 * (1 - B + B * size / max(1.0, size.mean() if n else 1.0))).astype(np.float32)
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        self.doc, self.weight = doc, weight.astype(np.float64)  # as bincount takes them
        # terms of many documents also stand as rows of a matrix
        common = np.flatnonzero(df * COMMON > n) if n else np.zeros(0, np.int64)
        self.row = np.full(terms, -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), n), np.float32)
        wide = self.row[term]
        self.matrix[wide[wide >= 0], doc[wide >= 0]] = weight[wide >= 0]
        # the terms each document shares with others
        shared = np.flatnonzero(df[term] > 1)
        shared = shared[np.argsort(doc[shared], kind="stable")]
        self.query_to = np.searchsorted(doc[shared], np.arange(n + 1))
        self.query_term = term[shared]

    def scores(self, seed: int, n: int) -> np.ndarray:
        """Score of every document for all terms the seed shares."""
        q = self.query_term[self.query_to[seed]:self.query_to[seed + 1]]
        if not len(q):
            return np.zeros(n)
        row = self.row[q]
        asked = np.zeros(len(self.matrix), np.float32)
        asked[row[row >= 0]] = 1
        score = (asked @ self.matrix).astype(np.float64) if len(asked) else np.zeros(n)
        q = q[row < 0]
        runs = list(zip(self.to[q].tolist(), self.to[q + 1].tolist()))
        if runs:
            score += np.bincount(np.concatenate([self.doc[a:b] for a, b in runs]),
                                 np.concatenate([self.weight[a:b] for a, b in runs]), n)
        return score

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents by falling score for all terms the seed shares (ties: earlier first). The best few are
        sorted out first and the others only when they are asked for."""
        score = self.scores(seed, len(unused))
        found = np.flatnonzero((score > 0) & unused)
        score = score[found]
        if len(found) > 4 * FEW:
            cut = np.partition(score, len(score) - FEW)[len(score) - FEW]
            first = score >= cut
            near = found[first]
            yield from near[np.argsort(-score[first], kind="stable")].tolist()
            found, score = found[~first], score[~first]
        yield from found[np.argsort(-score, kind="stable")].tolist()


class Packer:
    """Fills windows one after another; ``pieces`` has (document, start, end, window, offset)."""

    def __init__(self, window: int = WINDOW):
        self.window, self.seq, self.fill = window, 0, 0

    def shard(self, ids: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        n = len(off) - 1
        size = np.diff(off).tolist()
        index = Bm25Index(ids, off)
        unused = np.ones(n, bool)
        pieces, at = [], 0
        seed, queue = -1, iter(())  # the window's seed and the neighbours it still has
        while True:
            d = next((x for x in queue if unused[x]), -1)
            if d < 0:
                while at < n and not unused[at]:
                    at += 1
                if at == n:
                    return pieces
                d, seed = at, at
            unused[d] = False
            start, opened = 0, False
            while start < size[d]:
                take = min(self.window - self.fill, size[d] - start)
                pieces.append((d, start, start + take, self.seq, self.fill))
                self.fill += take
                start += take
                if self.fill == self.window:
                    self.seq, self.fill, opened = self.seq + 1, 0, True
            if opened:  # the rest of this document leads the next window
                seed = d
            if seed == d:
                queue = index.neighbours(d, unused)


def power_cuts(pieces: list, first: int, window: int) -> list:
    """Pieces of one unfinished window, cut and renumbered into windows of power-of-two lengths from ``first``."""
    left = sum(e - s for _, s, e, _, _ in pieces)
    out, seq, offset, room = [], first, 0, 1 << (left.bit_length() - 1) if left else 0
    if left == 0:
        return out
    for d, s, e, _, _ in pieces:
        while s < e:
            take = min(room - offset, e - s)
            out.append((d, s, s + take, seq, offset))
            s, offset, left = s + take, offset + take, left - take
            if offset == room and left:
                seq, offset, room = seq + 1, 0, 1 << (left.bit_length() - 1)
    return out


def _strongest(ids: np.ndarray, off: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """The ``ROUTE_TERMS`` terms of greatest BM25 weight of every document, a row each (-1: none)."""
    n = len(off) - 1
    doc, term, tf = by_document(ids, off)
    weight = idf[term] * tf / (tf + K1 * (1 - B + B * np.diff(off)[doc] / mean))
    out = np.full((n, ROUTE_TERMS), -1, np.int64)
    if not len(doc):
        return out
    head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))  # of each document that has a term
    size = np.diff(np.append(head, len(doc)))
    for k in range(ROUTE_TERMS):  # the heaviest term that is left; among equal ones the smallest
        top = np.maximum.reduceat(weight, head)
        at = np.flatnonzero((weight == np.repeat(top, size)) & (weight > 0))
        if not len(at):
            break
        at = at[np.append(True, doc[at[1:]] != doc[at[:-1]])]
        out[doc[at], k] = term[at]
        weight[at] = 0
    return out


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of a batch of binary columns, and document offsets into them."""
    raw, off = buffers(b.column("ids"))
    kind = np.dtype("<u2") if not b.num_rows or b.column("width")[0].as_py() == 2 else np.dtype("<u4")
    return np.frombuffer(raw.tobytes(), kind), off // kind.itemsize


def routed(docs: DataFrame) -> DataFrame:
    """``id, ids, width`` rows, range-partitioned and sorted by their strongest terms.

    A term's strength counts its documents in the whole table; terms of one document
    bring nothing together and do not count. Documents with the same strongest terms are
    dealt by a hash, so a range of any size can be cut.
    """
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, size = np.zeros(0, np.int64), 0, 0
        for b in slices(batches, "ids"):
            ids, off = _arrays(b)
            own = np.bincount(by_document(ids, off)[1], minlength=len(total))
            own[:len(total)] += total
            total, rows, size = own, rows + b.num_rows, size + len(ids)
        t = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(t, [-1, -2])), pa.array(np.append(total[t], [rows, size]))],
                                         names=["term", "n"])

    count = docs.mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    by = dict(zip(count["term"], count["n"]))  # at most the tokenizer's vocabulary
    rows, size = int(by.pop(-1, 0)), int(by.pop(-2, 0))
    idf = np.zeros(max(by, default=0) + 1)
    for t, n in by.items():
        idf[t] = np.log(1 + (rows - n + 0.5) / (n + 0.5)) if n > 1 else 0
    shipped = docs.sparkSession.sparkContext.broadcast((idf, max(1.0, size / max(1, rows))))
    keys = [f"k{i}" for i in range(ROUTE_TERMS)]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "ids"):
            k = _strongest(*_arrays(b), *shipped.value)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(k[:, i]) for i in range(ROUTE_TERMS))],
                                             names=[*b.schema.names, *keys])

    schema = "id long, ids binary, width int, " + ", ".join(f"{k} long" for k in keys)
    out = docs.mapInArrow(placed, schema).withColumn("salt", F.xxhash64("id", "ids"))
    return out.repartitionByRange(*keys, "salt").sortWithinPartitions(*keys, "salt").select("id", "ids", "width")


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every whole text (a null one: empty) with ``end_id`` behind it.

    Returns one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``. Rows that share an id are packed as documents of
    their own; an empty table gives no piece; a very long text is encoded alone and cut into as many windows as it fills. The token ids are stored once and shuffled
    once, by content; a sequence id holds the partition number in its
    upper bits, so ids are unique without a second pass.
    """
    schema = pa.schema([(c, pa.int64()) for c in
                        ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer)
        for b in slices(batches):
            ids, off = encode(b.column("text"))
            kind = ids.dtype if end_id <= np.iinfo(ids.dtype).max else np.dtype(np.uint32)
            data = np.insert(ids.astype(kind, copy=False), off[1:], end_id)
            off = (off + np.arange(len(off))) * kind.itemsize
            col = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([b.column("id"), col, pa.array(np.full(b.num_rows, kind.itemsize, np.int32))],
                                             names=["id", "ids", "width"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() << 33
        packer, tail, held, total = Packer(window), [], [], 0

        def emit(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal tail, held, total
            flat = np.concatenate([h[0] for h in held])
            size = np.concatenate([np.diff(h[1]) for h in held])
            names = [x for h in held for x in h[2]]
            off = np.zeros(len(size) + 1, np.int64)
            np.cumsum(size, out=off[1:])
            held, total = [], 0
            rows = []
            for d, s, e, seq, at in packer.shard(flat, off):
                crc = zlib.crc32(flat[off[d] + s:off[d] + e].astype("<u4").tobytes())
                rows.append(((names[d], s, e, seq, at), crc, int(size[d]), flat[off[d] + s:off[d] + e]))
            rows = tail + rows
            open_ = [r for r in rows if r[0][3] == packer.seq]  # of the window still being filled
            tail = [(r[0], r[1], r[2], r[3].copy()) for r in open_]
            yield emit([row(r) for r in rows[:len(rows) - len(open_)]])

        def row(r) -> tuple:
            (name, s, e, seq, at), crc, doc_tokens, _ = r
            return name, s, e - s, crc, doc_tokens, base + seq, at

        for b in slices(batches, "ids"):
            held.append((*_arrays(b), b.column("id").to_pylist()))
            total += len(held[-1][0])
            if total >= shard_tokens:
                yield from flush()
        if held:
            yield from flush()
        if tail:
            # the last window, cut into lengths that need no padding
            by = {i: r for i, r in enumerate(tail)}
            last = []
            for i, s, e, seq, at in power_cuts([(i, r[0][1], r[0][2], 0, 0) for i, r in by.items()], packer.seq, window):
                r = by[i]
                part = r[3][s - r[0][1]:e - r[0][1]]
                last.append((r[0][0], s, e - s, zlib.crc32(part.astype("<u4").tobytes()), r[2], base + seq, at))
            yield emit(last)

    texts = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    held_ids = stored(texts.mapInArrow(encoded, "id long, ids binary, width int"), "packing-ids")
    return routed(held_ids).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                            "sequence_id long, offset long")
