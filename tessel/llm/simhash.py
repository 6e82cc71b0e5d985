"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are put in the order of their Gray rank, where neighbours share
long bit patterns. The order is cut into ranges of about equal size; each range
is a leaf of the upper tree. A node of the tree keeps only the bits on which all
its fingerprints agree and which its parent does not fix already (a mask and a
pattern). A fingerprint is compared with the tree from the top: the differing
bits in the masks met so far are accumulated, and a node is left with its whole
group once they exceed the allowed distance. So a fingerprint is sent only to
the ranges that may hold a neighbour, and inside a range the same kind of
index, built over its sorted fingerprints, finds the pairs. The upper tree has at
most ``MAX_RANGES`` leaves whatever the input; it is what tasks receive.

A range returns its links as a forest (each fingerprint with one linked earlier
one), so dense groups of near copies do not produce all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import bounded_batches, boxed, stored, unboxed
from .words import Words, slices

SHINGLE = 3
DISTANCE = 2
SEED = 42
RANGE_SIZE = 65_536   # fingerprints in a range
MAX_RANGES = 32_768   # leaves of the upper tree
HISTOGRAM_BITS = 20   # leading bits of the Gray rank whose counts place the range cuts
FAN_OUT = 8           # children of a node
QUERY_BLOCK = 32_768  # fingerprints whose pairs are held together
FRONTIER = 1 << 17     # (query, node) pairs that go to their children together

_ONE = np.uint64(1)


# ---------------------------------------------------------------- fingerprints

def fingerprints(col: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of every text: bit set where over half of the shingles' XXH64 have it."""
    from xxhash import xxh64_intdigest
    w = Words(col, lower=True)
    out = np.zeros(len(col), np.uint64)
    n_words = w.counts()
    has = np.flatnonzero(n_words)
    if not len(has):
        return out
    # all words, single spaces between them
    size = w.end - w.start
    at = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int(at[-1] + size[-1]), 32, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = w.data[
        np.repeat(w.start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    text = joined.tobytes()
    n_sh = np.maximum(1, n_words[has] - shingle + 1)
    to = np.cumsum(n_sh)
    word = np.arange(int(to[-1])) + np.repeat(w.first[:-1][has] - (to - n_sh), n_sh)
    last = word + np.repeat(np.minimum(shingle, n_words[has]), n_sh) - 1
    lo, hi = at[word].tolist(), (at[last] + size[last]).tolist()
    h = np.array([xxh64_intdigest(text[a:b], SEED) for a, b in zip(lo, hi)], np.uint64)
    for d, (a, b) in enumerate(zip((to - n_sh).tolist(), to.tolist())):
        ones = np.zeros(64, np.int64)
        for i in range(a, b, 1 << 16):
            bits = np.unpackbits(h[i:min(b, i + (1 << 16))].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        out[has[d]] = np.packbits(2 * ones > b - a, bitorder="little").view(np.uint64)[0]
    return out


def fingerprint_table(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, k, fp`` of every row: ``k`` hashes the text, ``fp`` has the 64 bits as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = fingerprints(b.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("k"), pa.array(fp.view(np.int64))], schema=schema)

    return (bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("k"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, k long, fp long"))


# ------------------------------------------------------------------------ tree

def gray_rank(code: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected Gray sequence."""
    r = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def signed_rank(fp: np.ndarray) -> np.ndarray:
    """Gray ranks of fingerprints as signed longs in unsigned order."""
    return (gray_rank(fp.view(np.uint64)) ^ np.uint64(1 << 63)).view(np.int64)


class GrayTree:
    """Hierarchy over groups in Gray order, given the AND and OR of each group's codes.

    ``levels[0]`` are the groups; a node of a higher level covers ``FAN_OUT`` of
    the next lower one. ``mask`` has the bits fixed in a node but not in its parent.
    """

    def __init__(self, all_and: np.ndarray, all_or: np.ndarray):
        fixed, pattern = [], []
        a, o = all_and, all_or
        while True:
            fixed.append(~(a ^ o))
            pattern.append(a)
            if len(a) <= 1:
                break
            cut = np.arange(0, len(a), FAN_OUT)
            a, o = np.bitwise_and.reduceat(a, cut), np.bitwise_or.reduceat(o, cut)
        self.pattern = pattern
        self.mask = [f & ~np.repeat(fixed[k + 1], FAN_OUT)[:len(f)] if k + 1 < len(fixed) else f
                     for k, f in enumerate(fixed)]

    def search(self, code: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, group) whose accumulated differences stay within ``distance``, and those differences."""
        top = len(self.mask) - 1
        query = np.arange(len(code), dtype=np.int64)
        todo = [(top + 1, query, np.zeros(len(code), np.int64), np.zeros(len(code), np.uint8))]
        found = []
        while todo:
            k, query, node, gone = todo.pop()
            if k == 0:
                found.append((query, node, gone))
                continue
            if len(query) > FRONTIER:  # piece by piece, so memory does not grow with the tree or the queries
                todo += [(k, query[i:i + FRONTIER], node[i:i + FRONTIER], gone[i:i + FRONTIER])
                         for i in range(0, len(query), FRONTIER)]
                continue
            k -= 1
            if k < top:  # to the children
                query, gone = np.repeat(query, FAN_OUT), np.repeat(gone, FAN_OUT)
                node = (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                real = node < len(self.mask[k])
                query, gone, node = query[real], gone[real], node[real]
            gone = gone + np.bitwise_count((code[query] ^ self.pattern[k][node]) & self.mask[k][node])
            near = gone <= distance
            todo.append((k, query[near], node[near], gone[near]))
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest label reachable over the links ``a``-``b``, starting from earlier ``label`` values."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        new = new[label]
        if (new == label).all():
            return label
        label = new


# ------------------------------------------------------------------- operators

def links(codes: DataFrame, distance: int = DISTANCE, range_size: int = RANGE_SIZE,
          max_ranges: int = MAX_RANGES) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (column ``fp``) whose connected
    components are those of all pairs within ``distance`` differing bits."""
    spark = codes.sparkSession

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy()
            yield pa.RecordBatch.from_pydict({"fp": fp, "rank": signed_rank(fp)})

    # every step reads the codes themselves and ranks them anew: one Python step a task, not one worker for each of a chain
    ordered = codes.mapInArrow(ranked, "fp long, rank long")
    # counts of equal leading bits of the rank: cut points stand where the counts fill a range
    step = 64 - HISTOGRAM_BITS
    filled = (ordered.groupBy(F.shiftright("rank", step).alias("b")).agg(F.count(F.lit(1)).alias("n")).toPandas()
              .sort_values("b"))  # at most 2**HISTOGRAM_BITS rows
    total = np.cumsum(filled["n"].to_numpy(np.int64))
    size = max(range_size, -(-int(total[-1]) // max_ranges)) if len(total) else 1
    cut = np.flatnonzero(np.diff(total // size)) if len(total) else np.zeros(0, np.int64)
    edges = (filled["b"].to_numpy(np.int64)[cut] + 1) << step

    def part_of(fp: np.ndarray) -> np.ndarray:
        return np.searchsorted(edges, signed_rank(fp), "right").astype(np.int32)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy()
            yield pa.RecordBatch.from_pydict({"fp": b.column("fp"), "part": pa.array(part_of(fp))})

    top = (codes.mapInArrow(numbered, "fp long, part int")
           .groupBy("part").agg(F.bit_and("fp").alias("a"), F.bit_or("fp").alias("o"))
           .orderBy("part").collect())  # one row per range
    if not top:
        return spark.createDataFrame([], "a long, b long")
    of = np.array([r["part"] for r in top], np.int32)
    tree = GrayTree(np.array([r["a"] for r in top], np.int64).view(np.uint64),
                    np.array([r["o"] for r in top], np.int64).view(np.uint64))
    shipped = spark.sparkContext.broadcast((of, tree))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, tree = shipped.value
        for b in batches:
            fp = b.column("fp").to_numpy()
            own = part_of(fp)
            for i in range(0, len(fp), QUERY_BLOCK):
                f, o = fp[i:i + QUERY_BLOCK], own[i:i + QUERY_BLOCK]
                q, leaf, _ = tree.search(f.view(np.uint64), distance)
                to = of[leaf]
                once = to >= o[q]  # each pair of ranges meets in the later one
                yield pa.RecordBatch.from_pydict({"part": pa.array(to[once]), "fp": pa.array(f[q[once]]),
                                                  "member": pa.array((to == o[q])[once])})

    def inside(group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy().view(np.uint64)
        member = group["member"].to_numpy()
        order = np.argsort(gray_rank(fp[member]))
        codes = np.concatenate([fp[member][order], fp[~member]])
        m = int(member.sum())
        tree = GrayTree(codes[:m], codes[:m])
        label = np.arange(len(codes))
        for i in range(0, len(codes), QUERY_BLOCK):
            q, hit, _ = tree.search(codes[i:i + QUERY_BLOCK], distance)
            q = q + i
            pair = q > hit
            label = forest(len(codes), q[pair], hit[pair], label)
        linked = label != np.arange(len(codes))
        return pd.DataFrame({"a": codes[linked].view(np.int64), "b": codes[label[linked]].view(np.int64)})

    return codes.mapInArrow(routed, "part int, fp long, member boolean").groupBy("part").applyInPandas(inside, "a long, b long")


def _classes(docs: DataFrame, shingle: int, distance: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and ``fp, root`` of every distinct one: equal ``root``, one component."""
    rows = stored(fingerprint_table(docs, shingle, id_col, text_col), "fingerprints")
    codes = stored(rows.select("fp").distinct(), "codes")
    found = stored(components(links(codes, distance), "simhash"), "roots")
    return rows, codes.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Texts link at ``distance`` or fewer differing fingerprint bits; a component's
    id is the smallest ``doc_id`` reachable. A null text counts as empty; a text
    without words has fingerprint zero. Equal fingerprints (exact copies, empty
    texts) form one class before anything is compared. Rows that share an id keep
    a row each; null ids never name a component (null if it has no other). An
    empty table gives no row. A very long text is hashed whole, alone in its batch.
    """
    rows, roots = _classes(docs, shingle, distance, id_col, text_col)
    of_class = roots.join(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp")
    least = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of_class.join(least, "root").select("fp", "component_id")
    # a fingerprint shared by very many rows is a hot key of this join: Spark splits it
    return (rows.join(named, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def representatives(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (a null
    id only if there is no other), of rows sharing that id the one with the smallest text hash.
    Columns as before."""
    rows, roots = _classes(docs, shingle, distance, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("k").alias("k"))
    kept = (roots.join(rows.groupBy("fp").agg(F.min(order).alias("first")), "fp")
            .groupBy("root").agg(F.min("first").alias("first")).select("first.i", "first.k"))
    keyed = boxed(docs, i=F.col(id_col).cast("long"), k=F.xxhash64(text_col))
    return unboxed(keyed.alias("d").join(kept.alias("x"), F.col("d.i").eqNullSafe(F.col("x.i")) & (F.col("d.k") == F.col("x.k")), "left_semi")
                   .dropDuplicates(["i", "k"]), docs.columns)
