"""Exact substring dedup by suffix automata.

A window is ``WINDOW`` consecutive words of one document. A word goes when a
window that covers it also stands in a document with a smaller id.

1. Anchors. Every window has one minimiser: its word 8-gram with the smallest
   hash. Equal windows have equal minimisers, so only windows whose minimiser occurs
   in two documents can repeat. This finds the documents and places that matter, at a
   cost of about one anchor per 22 words.
2. Reference. The hashes of those windows are counted; a repeated window's first
   document is its reference. Aggregation on the hash copes with a passage that
   a third of all documents share: equal windows collapse before the shuffle.
   Runs of reference windows are cut out of their documents: every repeated
   passage is kept once.
3. Suffix automata. The reference text is dealt into shards, and documents go only to
   the shards that hold a reference of theirs (an automaton broadcast to all
   documents would make the work grow with the square of the corpus). A shard's
   automaton is built over its words; each state knows the smallest document its
   strings come from. A document's words are streamed through it; where the matching
   statistic reaches the window length with a string from a smaller document, the
   window's words go. Words themselves are compared here, not hashes. A shard that
   very many documents go to is copied, and its documents are dealt over the copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .store import bounded_batches, stored
from .words import Words, ranged, slices

WINDOW = 50
GRAM = 8
SHARD_WORDS = 60_000      # reference windows of an automaton, about
HOT_WINDOWS, HOT_KEYS = 20_000, 10_000  # occurrences of a window in one part, at least; windows that may be split
STREAM_WINDOWS = 400_000  # windows streamed through one copy of it, about


def minimisers(h: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows inside one text, the place of each one's minimiser, and the hashes of the grams."""
    n = len(h)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - gram + 1)
    g = ranged(h, at, at + gram)
    low = np.uint64((1 << max(24, n.bit_length())) - 1)
    m = (g & ~low) | at.astype(np.uint64)  # the earliest of equal ones
    width, span = 1, window - gram + 1
    while 2 * width <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < span:
        m = np.minimum(m[:len(m) - (span - width)], m[span - width:])
    start = np.arange(len(m))
    end = np.repeat(first[1:], np.diff(first))[:len(m)]
    ok = start + window <= end
    return start[ok], (m[ok] & low).astype(np.int64), g


class Automaton:
    """Suffix automaton over word sequences added in ascending document order."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]
        self.doc = [0]  # smallest document of a state's strings
        self.codes: dict[bytes, int] = {}

    def add(self, words: list[bytes], doc: int) -> None:
        nxt, link, length, docs, codes = self.next, self.link, self.len, self.doc, self.codes
        symbols = [codes.setdefault(w, len(codes)) for w in words]
        last = 0  # a separator: a sequence starts anew
        for c in symbols:
            if c in nxt[last]:
                q = nxt[last][c]
                if length[q] == length[last] + 1:
                    last = q
                    continue
                cur = self._clone(last, q, c)
                last = cur
                continue
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            docs.append(doc)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        self.doc.append(self.doc[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def covered(self, words: list[bytes], doc: int, window: int) -> list[tuple[int, int]]:
        """Maximal spans of ``words`` covered by windows that a smaller document holds."""
        nxt, link, length, docs, codes = self.next, self.link, self.len, self.doc, self.codes
        spans: list[tuple[int, int]] = []
        v = n = 0
        for i, w in enumerate(words):
            c = codes.get(w, -1)
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
            else:
                v = n = 0
            if n >= window:
                n = window  # only the last ``window`` words matter
                while length[link[v]] >= window:
                    v = link[v]
                if docs[v] < doc:
                    lo = i - window + 1
                    if spans and lo <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], i + 1)
                    else:
                        spans.append((lo, i + 1))
        return spans


def _runs(at: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    at = np.unique(at)
    cut = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.append(0, cut + 1)].tolist(), at[np.append(cut, len(at) - 1)].tolist())) if len(at) else []


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, k, spans`` (array<struct<a, b>>, words a to b - 1) of the documents that lose words;
    ``docs`` has ``doc_id, text, k``, ``k`` a hash of both."""
    known = docs.filter("doc_id is not null")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = Words(b.column("text"))
            _, at, g = minimisers(w.hashes(), w.first, window)
            at = np.unique(at)
            d = np.searchsorted(w.first, at, "right") - 1
            idx = pa.array(d)
            yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), b.column("doc_id").take(idx), b.column("k").take(idx),
                                              pa.array((at - w.first[d]).astype(np.int32))], names=["a", "doc_id", "k", "pos"])

    anchors = stored(known.select("doc_id", "k", "text").mapInArrow(find, "a long, doc_id long, k long, pos int"), "anchors")
    shared = (anchors.groupBy("a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
              .filter("lo < hi").select("a"))
    marks = stored(anchors.join(shared, "a").groupBy("doc_id", "k").agg(F.collect_list("pos").alias("pos")), "marks")
    members = docs.sparkSession.sparkContext.broadcast(bitmap.bitmap(marks, "k"))
    candidates = stored(may_hold(known, members, True).join(marks, ["doc_id", "k"]), "candidates")

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = Words(b.column("text"))
            h = w.hashes()
            start, at, _ = minimisers(h, w.first, window)
            mark = np.zeros(len(h) + 1, bool)
            pos = b.column("pos")
            d = np.repeat(np.arange(b.num_rows), pos.value_lengths().to_numpy())
            mark[pos.flatten().to_numpy() + w.first[d]] = True
            start = start[mark[at]]
            d = np.searchsorted(w.first, start, "right") - 1
            idx = pa.array(d)
            yield pa.RecordBatch.from_arrays([pa.array(ranged(h, start, start + window).view(np.int64)), b.column("doc_id").take(idx),
                                              b.column("k").take(idx), pa.array((start - w.first[d]).astype(np.int32))],
                                             names=["w", "doc_id", "k", "at"])

    windows = candidates.select("doc_id", "k", "text", "pos").mapInArrow(cut_windows, "w long, doc_id long, k long, at int")
    firsts = stored(windows.groupBy("w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
                    .filter("first < hi").drop("hi"), "firsts")
    # the occurrences of a window that stands in very many places are dealt over parts, each with the window's row
    total = firsts.agg(F.sum("n")).first()[0] or 0
    share = max(HOT_WINDOWS, -(-total // HOT_KEYS))  # so at most HOT_KEYS windows are split, and their keys are broadcast
    parts = F.ceil(F.col("n") / share).cast("int")
    hot = F.broadcast(firsts.filter(F.col("n") > share).select("w", parts.alias("parts")))
    dealt_windows = (windows.join(hot, "w", "left")
                     .withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "at"), F.col("parts").cast("long")).cast("int"))))
    spread = firsts.select("w", "first", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    placed = dealt_windows.join(spread, ["w", "part"]).select("doc_id", "k", "at", "first", (F.col("doc_id") == F.col("first")).alias("ref"))
    places = stored(placed.groupBy("doc_id", "k", "first", "ref").agg(F.collect_list("at").alias("at")), "places")

    total = places.filter("ref").agg(F.sum(F.size("at"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    dealt = (places.withColumn("shard", F.pmod(F.xxhash64("first"), F.lit(shards)))
             .groupBy("doc_id", "k", "shard", "ref").agg(F.flatten(F.collect_list("at")).alias("at")))

    def cut_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = {"shard": [], "ref": [], "doc_id": [], "k": [], "start": [], "n": [], "piece": []}
            ids, ks, shard, ref, at = (b.column(c).to_pylist() for c in ("doc_id", "k", "shard", "ref", "at"))
            w = Words(b.column("text"))
            for r in range(b.num_rows):
                words = w.of(r)
                for a, e in _runs(np.array(at[r], np.int64)):
                    for c, v in (("shard", shard[r]), ("ref", ref[r]), ("doc_id", ids[r]), ("k", ks[r]), ("start", a),
                                 ("n", e - a + 1), ("piece", b" ".join(words[a:e + window]))):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in kinds], names=[c for c, _ in kinds])

    kinds = [("shard", pa.int64()), ("ref", pa.bool_()), ("doc_id", pa.int64()), ("k", pa.int64()), ("start", pa.int64()),
             ("n", pa.int64()), ("piece", pa.binary())]
    pieces = stored(candidates.select("doc_id", "k", "text").distinct().join(dealt, ["doc_id", "k"]).mapInArrow(
        cut_text, "shard long, ref boolean, doc_id long, k long, start long, n long, piece binary"), "pieces")
    copies = (pieces.filter("not ref").groupBy("shard").agg(F.sum("n").alias("n"))
              .select("shard", F.ceil(F.col("n") / STREAM_WINDOWS).cast("int").alias("copies")))
    stream = (pieces.filter("not ref").join(copies, "shard")
              .select("shard", F.pmod(F.xxhash64("doc_id", "start"), F.col("copies")).cast("int").alias("copy"), "doc_id", "k", "start", "piece"))
    reference = (pieces.filter("ref").join(copies, "shard")
                 .select(F.col("shard").alias("r_shard"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("r_copy"),
                         F.col("doc_id").alias("r_doc"), F.col("start").alias("r_start"), F.col("piece").alias("r_piece")))

    def match(text: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        machine = Automaton()
        for doc, piece in refs.sort_values(["r_doc", "r_start"])[["r_doc", "r_piece"]].itertuples(index=False):
            machine.add(piece.split(), doc)
        out = []
        for doc, k, start, piece in text[["doc_id", "k", "start", "piece"]].itertuples(index=False):
            out += [(doc, k, start + a, start + e) for a, e in machine.covered(piece.split(), doc, window)]
        return pd.DataFrame(out, columns=["doc_id", "k", "a", "b"]).astype("int64")

    spans = (stream.groupBy("shard", "copy").cogroup(reference.groupBy("r_shard", "r_copy"))
             .applyInPandas(match, "doc_id long, k long, a long, b long"))
    return spans.groupBy("doc_id", "k").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))


def may_hold(docs: DataFrame, members, wanted: bool) -> DataFrame:
    """The rows whose ``k`` may be in the broadcast bit set, or (``wanted`` false) surely is not."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            on = bitmap.contained(members.value, b.column("k").to_numpy().view(np.uint64))
            yield b.filter(pa.array(on if wanted else ~on))

    return docs.mapInArrow(keep, docs.schema)


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row.

    Whole texts, words as they stand; a null or empty text has no words (and the
    hash of nothing). Texts of fewer words than the window lose none. Rows that share
    an id never count as earlier than one another; a row with a null id neither loses
    words nor makes others lose any. An empty table gives no row.
    """
    spark = bounded_batches(docs).sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
                       F.xxhash64(F.col(id_col).cast("long"), text).alias("k"))
    spans = stored(repeated_spans(rows, window), "spans")
    members = spark.sparkContext.broadcast(bitmap.bitmap(spans, "k"))
    touched = may_hold(rows, members, True).join(spans, ["doc_id", "k"], "left").select("doc_id", "text", "spans")
    whole = may_hold(rows, members, False).select("doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            gone = b.column("spans").to_pylist() if "spans" in b.schema.names else [None] * b.num_rows
            n_words, n_removed, sha = [], [], []
            for t, cut in zip(b.column("text").cast(pa.binary()).to_pylist(), gone):
                words = t.split()
                n_words.append(len(words))
                if cut:
                    keep = np.ones(len(words), bool)
                    for s in cut:
                        keep[s["a"]:s["b"]] = False
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                n_removed.append(n_words[-1] - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha)], schema=schema)

    out = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return whole.mapInArrow(digest, out).unionByName(touched.mapInArrow(digest, out))
