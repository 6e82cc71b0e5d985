"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: the hash of a window takes the
words at the mask's ones and ignores the others. Benchmark items and documents
are hashed with the same masks; equal hashes place an item on a diagonal of a
document. On each such diagonal the words around the hit are compared one by one,
and an overlap counts when a stretch of ``OVERLAP`` aligned words (the whole item
if it is shorter) agrees in at least ``SIMILARITY`` of them. The masks are chosen so
that every stretch of that kind, wherever its substitutions fall, has a hit.

Words are compared lower-cased and without the signs around them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .store import bounded_batches, stored
from .words import Words, folded, mix, slices

MASKS = ("11111", "111011", "11001011")           # for items of LONG_WORDS words or more
SHORT_MASKS = ("1111", "11101", "10111", "11011")  # for shorter ones; unused while there are none
LONG_WORDS = 8
OVERLAP = 15
SIMILARITY = 0.8
MIN_WORDS = 5            # shorter items allow no substitution: they are found by the hash of all their words


def seed_hashes(h: np.ndarray, first: np.ndarray, masks: tuple[str, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each mask the start words of its windows (inside one text) and their hashes."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = []
    for mask in masks:
        n = len(h) - len(mask) + 1
        if n <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.uint64)))
            continue
        ok = doc[:n] == doc[len(mask) - 1:]
        value = np.full(n, np.uint64(int(mask, 2)))
        for o, bit in enumerate(mask):
            if bit == "1":
                value = value * np.uint64(0x9E3779B97F4A7C15) + h[o:o + n]
        at = np.flatnonzero(ok)
        out.append((at, mix(value[at])))
    return out


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = Words(folded(col))
    w.strip_signs()
    return w.hashes(), w.first


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, overlap: int = OVERLAP,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, doc_word, item_word, n_words, n_equal`` for every document and
    benchmark item that overlap: the best aligned stretch (most equal words, then the
    earliest). Words count from 0 among the words that hold a letter or digit.

    Null texts hold no word. Rows that share an id are searched each and
    reported together, as are items that share an id. Items of fewer than
    ``MIN_WORDS`` words are found where all their words stand, the first such place; items without a word are not. Null ids are reported as null. An empty
    table on either side gives no row. A very long text is searched whole, alone in its batch.
    """
    spark = bounded_batches(docs).sparkSession

    def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        key = TaskContext.get().partitionId() << 33
        for b in slices(batches):
            h, first = _words(b.column("text"))
            h = h.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key + np.arange(b.num_rows)), b.column("id"), pa.array([h[a:e] for a, e in zip(first[:-1], first[1:])], pa.list_(pa.int64()))],
                names=["item", "item_id", "item_words"])
            key += b.num_rows

    every = stored(benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text"))
                   .mapInArrow(item_rows, "item long, item_id long, item_words array<long>")
                   .filter(F.size("item_words") > 0), "benchmark")
    items = every.filter(F.size("item_words") >= MIN_WORDS)

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("item_words")
            h = col.flatten().to_numpy().view(np.uint64)
            first = np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy())])
            key = b.column("item").to_numpy()
            long = np.diff(first) >= LONG_WORDS
            for masks, own in ((MASKS, long), (SHORT_MASKS, ~long)):
                for at, value in seed_hashes(h, first, masks):
                    d = np.searchsorted(first, at, "right") - 1
                    at, value, d = at[own[d]], value[own[d]], d[own[d]]
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(key[d]), pa.array((at - first[d]).astype(np.int32))],
                                                     names=["h", "item", "item_at"])

    seeds = stored(items.select("item", "item_words").mapInArrow(item_seeds, "h long, item long, item_at int"), "seeds")
    members = spark.sparkContext.broadcast(bitmap.bitmap(seeds))
    reach = overlap
    short = items.filter(F.size("item_words") < LONG_WORDS).limit(1).count()
    masks = MASKS + SHORT_MASKS if short else MASKS

    hit_type = pa.struct([("h", pa.int64()), ("at", pa.int32())])

    def doc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        key = TaskContext.get().partitionId() << 33
        bits = members.value
        for b in slices(batches):
            h, first = _words(b.column("text"))
            ats, values = [], []
            for at, value in seed_hashes(h, first, masks):
                on = bitmap.contained(bits, value)
                ats.append(at[on])
                values.append(value[on])
            at, value = np.concatenate(ats), np.concatenate(values).view(np.int64)
            if len(at):
                order = np.argsort(at, kind="stable")
                at, value = at[order], value[order]
                doc = np.searchsorted(first, at, "right") - 1
                # a region: hits whose surroundings touch, with the words within reach of them
                new = np.ones(len(at), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > 2 * reach)
                cut = np.flatnonzero(new)
                end = np.append(cut[1:], len(at))
                d = doc[cut]
                lo = np.maximum(at[cut] - reach, first[d])
                hi = np.minimum(at[end - 1] + reach + 8, first[d + 1])
                region = np.repeat(np.arange(len(cut)), end - cut)
                own = pa.StructArray.from_arrays([pa.array(value), pa.array((at - lo[region]).astype(np.int32))], fields=list(hit_type))
                ids = b.column("id").take(pa.array(d))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key + np.arange(len(cut))), ids, pa.array((lo - first[d]).astype(np.int64)),
                     pa.array([h[a:e].view(np.int64) for a, e in zip(lo, hi)], pa.list_(pa.int64())),
                     pa.ListArray.from_arrays(pa.array(np.append(cut, len(at)), pa.int32()), own)],
                    names=["region", "doc_id", "start", "words", "hits"])
                key += len(cut)

    regions = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        doc_rows, "region long, doc_id long, start long, words array<long>, hits array<struct<h:long,at:int>>"), "regions")
    diagonals = (regions.select("region", F.explode("hits").alias("hit"))
                 .join(seeds, F.col("hit.h") == F.col("h"))
                 .select("region", "item", (F.col("hit.at") - F.col("item_at")).alias("diagonal")).distinct())
    pairs = (diagonals.join(regions.drop("hits"), "region").join(items, "item")
             .select("doc_id", "item_id", "start", "diagonal", "words", "item_words"))

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                w, t = np.asarray(r.words), np.asarray(r.item_words)
                need = min(overlap, len(t))
                a, e = max(0, -r.diagonal), min(len(t), len(w) - r.diagonal)  # item words that have a partner
                if e - a < need:
                    continue
                same = np.concatenate([[0], np.cumsum(w[r.diagonal + a:r.diagonal + e] == t[a:e])])
                score = same[need:] - same[:-need]
                k = int(score.argmax())
                if score[k] >= similarity * need - 1e-9:
                    out.append((r.doc_id, r.item_id, r.start + r.diagonal + a + k, a + k, need, int(score[k])))
            yield pd.DataFrame(out, columns=cols).astype({"doc_id": "Int64", "item_id": "Int64"})

    cols = ["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_equal"]
    found = pairs.mapInPandas(verified, "doc_id long, item_id long, doc_word long, item_word long, n_words long, n_equal long")
    few = every.filter(F.size("item_words") < MIN_WORDS)
    sizes = [r[0] for r in few.select(F.size("item_words")).distinct().collect()]
    if sizes:
        found = found.unionByName(_found_whole(docs, few, sorted(sizes), id_col, text_col))
    best = F.min(F.struct((-F.col("n_equal")).alias("o"), "doc_word", "item_word", "n_words", "n_equal"))
    return (found.groupBy("doc_id", "item_id").agg(best.alias("b"))
            .select("doc_id", "item_id", "b.doc_word", "b.item_word", "b.n_words", "b.n_equal"))


def _found_whole(docs: DataFrame, few: DataFrame, sizes: list[int], id_col: str, text_col: str) -> DataFrame:
    """The first place of each text at which all words of an item of few words stand: texts and items meet by
    the hash of those words, one row for a text and hash however often it occurs, and the words decide."""
    def item_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.asarray(w, np.int64).view(np.uint64) for w in b.column("item_words").to_pylist()]
            h = [int(seed_hashes(w, np.array([0, len(w)]), ("1" * len(w),))[0][1][0].astype(np.int64)) for w in rows]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), b.column("item_id"), b.column("item_words")], names=["h", "item_id", "item_words"])

    seeds = stored(few.select("item_id", "item_words").mapInArrow(item_hashes, "h long, item_id long, item_words array<long>"), "short-seeds")
    members = docs.sparkSession.sparkContext.broadcast(bitmap.bitmap(seeds))

    def doc_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, first = _words(b.column("text"))
            for n, (at, value) in zip(sizes, seed_hashes(h, first, tuple("1" * n for n in sizes))):
                on = bitmap.contained(members.value, value)
                at, value = at[on], value[on]
                doc = np.searchsorted(first, at, "right") - 1
                order = np.lexsort((at, value, doc))  # the first place of each hash in each text
                at, value, doc = at[order], value[order], doc[order]
                keep = np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]))[:len(at)]
                at, value, doc = at[keep], value[keep], doc[keep]
                words = h[at[:, None] + np.arange(n)].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), b.column("id").take(pa.array(doc)), pa.array(at - first[doc]),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * n, pa.int32()), pa.array(words.ravel()))],
                    names=["h", "doc_id", "doc_word", "words"])

    hits = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(doc_hits, "h long, doc_id long, doc_word long, words array<long>"))
    n = F.size("item_words").cast("long")
    return (hits.join(seeds, "h").filter(F.col("words") == F.col("item_words"))
            .select("doc_id", "item_id", "doc_word", F.lit(0).cast("long").alias("item_word"), n.alias("n_words"), n.alias("n_equal")))
