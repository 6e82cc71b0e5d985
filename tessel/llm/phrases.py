"""Collocations of two to four words from a weighted de Bruijn graph, per language.

Texts are cut into pieces and words. Every word starts one window: itself and up to
three following words of its piece. A full window is an edge of the graph, from the node
of its first three words to the node of its last three, and windows are counted
once, as the longest grams. A window that its piece's end cuts short is the end
correction of a node: the flow out of a node (edges, with their weights) and its
corrections together are the count of its words, so the counts of three words, two words
and one word come from the sorted windows by adding up, without another pass over the texts.

* A first pass counts words. A word rarer than the smallest count of interest cannot stand in any candidate or in a
  part of one, so it ends a piece for the second pass; this changes no count that is used.
* Windows travel as packed arrays of word codes to buckets by their first word, so a node's whole flow
  meets in one bucket. Windows of frequent words are split further by the second, third and fourth word; what
  is then only a part of a count is added up by Spark afterwards.
* On the edges that are frequent enough, unary nodes (all flow comes in by one edge and leaves by one)
  are compacted into paths, by pointer doubling; along a path each shorter phrase is handed on once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitmap import bitmap, contained
from .store import bounded_batches, stored
from .words import _ASCII_LOWER, _BYTE, buffers, mix, ranged, slices

MIN_COUNT = 30
TOP = 2000
SHARE = 80               # a candidate goes if a longer one has at least this many hundredths of its count
DICTIONARY = 1 << 20     # words with a short code; all others travel as their hash
HOT = 1 << 20            # occurrences of a word from which its windows are split further
BUCKET_WINDOWS = 1 << 19  # windows of a bucket, about
FLUSH_WINDOWS = 1 << 19  # windows that a task counts before it sends them
FLUSH_WORDS = 1 << 20    # words that a task counts before it sends them
UNKNOWN = "und"
_TOP_BIT = np.uint64(1 << 63)

_PIECE_END = np.zeros(256, bool)
_PIECE_END[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _PIECE_END.copy()
_GAP[[0x20, 0x09]] = True


def language_key(lang: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8, key=seed.to_bytes(4, "little")).digest(), "little")


class Pieces:
    """Words of a text column in lower case (A-Z), and which of them start a piece."""

    def __init__(self, text: pa.Array, lang: pa.Array, seed: int):
        data, off = buffers(text)
        self.data = _ASCII_LOWER[data]
        inside = ~_GAP[self.data]
        edge = off[(off > 0) & (off < len(data))]
        before, after = np.append(False, inside[:-1])[:len(data)], np.append(inside[1:], False)[:len(data)]
        before[edge] = False
        after[edge - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        ends = np.cumsum(_PIECE_END[self.data])
        piece = ends[self.start]
        self.first = np.append(True, piece[1:] != piece[:-1])[:len(piece)]
        bound = np.searchsorted(self.start, off)
        self.first[bound[:-1][bound[:-1] < len(piece)]] = True
        # one key for a word in a language; its top bit is set, which tells it from a short code
        coded = lang.dictionary_encode()
        own = np.array([language_key(v, seed) for v in coded.dictionary.to_pylist()], np.uint64)
        self.langs = coded.dictionary.to_pylist()
        self.lang = np.repeat(coded.indices.to_numpy(zero_copy_only=False), np.diff(bound))
        base = ranged(_BYTE[self.data], self.start, self.end)
        self.key = mix(base ^ own[self.lang]) | _TOP_BIT if len(base) else np.zeros(0, np.uint64)


def _prepared(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return bounded_batches(docs).select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
                                        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"))


def _word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """``key, lang, word, c``: what each task counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(kept)
            key = t["key"].to_numpy()
            u, one, back = np.unique(key, return_index=True, return_inverse=True)
            c = np.bincount(back, t["c"].to_numpy(), len(u)).astype(np.int64)
            yield from t.take(pa.array(one)).set_column(3, "c", pa.array(c)).combine_chunks().to_batches(65_536)
            kept.clear()

        for b in slices(batches):
            p = Pieces(b.column("text"), b.column("lang"), seed)
            u, one, c = np.unique(p.key, return_index=True, return_counts=True)
            if not len(u):
                continue
            raw = p.data.tobytes()
            kept.append(pa.table({"key": pa.array(u.view(np.int64)), "lang": pa.array([p.langs[i] for i in p.lang[one]], pa.string()),
                                  "word": pa.array([raw[a:z].decode("utf-8") for a, z in zip(p.start[one], p.end[one])], pa.string()),
                                  "c": pa.array(c.astype(np.int64))}))
            size += len(u)
            if size > FLUSH_WORDS:
                yield from flush()
                size = 0
        if kept:
            yield from flush()

    return texts.mapInArrow(run, "key long, lang string, word string, c long")


def vocabulary(texts: DataFrame) -> tuple[DataFrame, int]:
    """All words with their counts, and the seed for which no two of them share a key."""
    for seed in range(100):
        found = stored(_word_counts(texts, seed).groupBy("key").agg(
            F.min("lang").alias("lang"), F.min("word").alias("word"), F.sum("c").alias("c"),
            ((F.min("lang") != F.max("lang")) | (F.min("word") != F.max("word"))).alias("shared")), "words")
        if not found.filter("shared").limit(1).count():
            return found.drop("shared"), seed
    raise RuntimeError("words share keys under every seed")


class Codes:
    """Short codes, by falling count, of up to ``DICTIONARY`` words; the other frequent words keep their key."""

    def __init__(self, frequent: DataFrame, limit: int, hot: int):
        step = F.floor(F.log2("c") * 16)
        sizes = frequent.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.desc("s")).collect()
        total, least = 0, None
        for r in sizes:
            if total + r["n"] > limit:
                break
            total, least = total + r["n"], r["c"]
        best = frequent.filter(F.col("c") >= (least or 1 << 62)).select("key", "c").toPandas()  # at most ``limit`` rows of 16 bytes
        key, c = best["key"].to_numpy(np.int64).view(np.uint64), best["c"].to_numpy(np.int64)
        rank = np.lexsort((key, -c))
        self.count = np.append(np.int64(0), c[rank])          # by code
        self.hot_codes = int((c > hot).sum())                 # codes 1 to here are hot
        order = np.argsort(key[rank])
        self.keys, self.codes = key[rank][order], order.astype(np.uint64) + np.uint64(1)
        self.rest = None if total == sum(r["n"] for r in sizes) else bitmap(frequent.withColumnRenamed("key", "h"))

    def of(self, key: np.ndarray) -> np.ndarray:
        """Code of each key: short, the key itself, or 0 for a word that is not frequent (the bitmap lets some of these pass)."""
        at = np.searchsorted(self.keys, key)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == key[hit]
        out = np.zeros(len(key), np.uint64)
        out[hit] = self.codes[at[hit]]
        if self.rest is not None:
            more = ~hit
            more[more] = contained(self.rest, key[more])
            out[more] = key[more]
        return out


def windows(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Four columns: each word with a code, and the up to three words behind it; zeros behind the piece's end."""
    n = len(code)
    pad = np.zeros((4, n + 3), np.uint64)
    pad[0, :n] = code
    pad[1, :n - 1] = np.where(first[1:], 0, code[1:]) if n else 0
    pad[2, :n] = np.where(pad[1, :n] > 0, pad[1, 1:n + 1], 0)
    pad[3, :n] = np.where(pad[2, :n] > 0, pad[1, 2:n + 2], 0)
    return pad[:, :n][:, code > 0]


def _bucket(w: np.ndarray, buckets: int, hot_codes: int, count: np.ndarray, hot: int) -> np.ndarray:
    is_hot = (w[:3] > 0) & (w[:3] <= np.uint64(hot_codes))
    one = is_hot[0]
    two = one & is_hot[1]
    key = mix(w[0] + np.uint64(1))
    key = np.where(one, mix(key + w[1]), key)
    at = np.flatnonzero(two)
    if len(at):
        x = w[:, at]
        parts = -(-np.minimum(count[x[0].astype(np.int64)], count[x[1].astype(np.int64)]) // hot)
        salt = np.where(is_hot[2, at], mix(mix(x[2]) + x[3]), mix(x[2])) % parts.astype(np.uint64)
        key[at] = mix(key[at] + salt)
    return (key % np.uint64(buckets)).astype(np.int64)


def _counted(w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of ``w`` in order with their added counts."""
    order = np.lexsort((w[3], w[2], w[1], w[0]))
    w = w[:, order]
    at = np.flatnonzero(np.append(True, (w[:, 1:] != w[:, :-1]).any(axis=0))[:w.shape[1]])
    return w[:, at], np.add.reduceat(n[order], at) if len(at) else n[:0]


def _pack(w: np.ndarray, n: np.ndarray) -> bytes:
    kind = "<u4" if not len(n) or max(int(w.max()), int(n.max())) < 1 << 32 else "<u8"
    flat = np.ascontiguousarray(np.concatenate([w, n[None, :].astype(np.uint64)]), kind)
    size = flat.dtype.itemsize
    return bytes([size]) + np.ascontiguousarray(flat.view(np.uint8).reshape(5, -1, size).transpose(0, 2, 1)).tobytes()  # alike bytes side by side


def _unpack(blob: bytes) -> np.ndarray:
    size = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(5, size, -1).transpose(0, 2, 1)
    return np.ascontiguousarray(raw).reshape(5, -1).view(f"<u{size}").astype(np.uint64)


def edge_weights(texts: DataFrame, seed: int, codes: Codes, buckets: int, hot: int = HOT) -> DataFrame:
    """``bucket, windows``: packed windows with counts, as each task counted them."""
    shared = texts.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        kept: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            w = np.concatenate(kept, axis=1)
            kept.clear()
            b = _bucket(w, buckets, c.hot_codes, c.count, hot)
            h = mix(mix(mix(w[0] + mix(w[1])) + mix(w[2] + np.uint64(7))) + w[3])
            order = np.lexsort((h, b))
            w, b = w[:, order], b[order]
            # equal windows stand together; two that share a hash may stand apart, which only leaves them to the bucket
            new = np.append(True, (w[:, 1:] != w[:, :-1]).any(axis=0) | (b[1:] != b[:-1]))[:len(b)]
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(b)))
            w, b = w[:, at], b[at]
            cut = np.flatnonzero(np.append(True, b[1:] != b[:-1])[:len(b)])
            to = np.append(cut[1:], len(b))
            for k in range(0, len(cut), 256):
                rows = list(zip(cut[k:k + 256], to[k:k + 256]))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(b[cut[k:k + 256]], pa.int64()),
                                                  "windows": pa.array([_pack(w[:, i:j], n[i:j]) for i, j in rows], pa.binary())})

        size = 0
        for b in slices(batches):
            p = Pieces(b.column("text"), b.column("lang"), seed)
            u, back = np.unique(p.key, return_inverse=True)
            w = windows(c.of(u)[back], p.first)
            if not w.shape[1]:
                continue
            kept.append(w)
            size += w.shape[1]
            if size >= FLUSH_WINDOWS:
                yield from flush()
                size = 0
        if kept:
            yield from flush()

    return texts.mapInArrow(run, "bucket long, windows binary")


GRAM = "c1 long, c2 long, c3 long, c4 long, f long, whole boolean"


def node_flow(w: np.ndarray, n: np.ndarray, hot_codes: int, least: int) -> dict[str, np.ndarray]:
    """Counts of one to four words of a bucket from its distinct windows ``w`` (in order) with weights ``n``.

    The count of a shorter phrase is the weight of all windows that begin with it: the edges that leave
    its node and the windows that the end of a piece cuts short. ``whole`` is false where other buckets hold another part.
    """
    is_hot = (w[:3] > 0) & (w[:3] <= np.uint64(hot_codes))
    part = ~is_hot[0], ~(is_hot[0] & is_hot[1]), ~is_hot.all(axis=0), np.ones(w.shape[1], bool)
    out: dict[str, list[np.ndarray]] = {"c1": [], "c2": [], "c3": [], "c4": [], "f": [], "whole": []}
    for k in range(4):
        full = np.flatnonzero(w[k] > 0)
        if not len(full):
            continue
        x = w[:k + 1, full]
        at = np.flatnonzero(np.append(True, (x[:, 1:] != x[:, :-1]).any(axis=0)))
        f = np.add.reduceat(n[full], at)
        whole = part[k][full[at]]
        keep = (f >= least) | ~whole
        for j in range(4):
            out[f"c{j + 1}"].append(x[j, at][keep].view(np.int64) if j <= k else np.zeros(int(keep.sum()), np.int64))
        out["f"].append(f[keep])
        out["whole"].append(whole[keep])
    return {c: np.concatenate(v) if v else np.zeros(0, bool if c == "whole" else np.int64) for c, v in out.items()}


def phrase_counts(texts: DataFrame, seed: int, codes: Codes, occurrences: int, least: int, hot: int = HOT,
                  bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """``gram`` (array<long> of codes), ``f``: all phrases of one to four words that occur at least ``least`` times."""
    spark = texts.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-occurrences // bucket_windows))
    hot_codes = codes.hot_codes

    def count(_: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, n, fresh, size = np.zeros((4, 0), np.uint64), np.zeros(0, np.int64), [], 0
        for b in batches:
            for blob in b.column("windows"):
                fresh.append(_unpack(blob.as_py()))
                size += fresh[-1].shape[1]
            if size > max(FLUSH_WINDOWS, w.shape[1]):  # added up in between, so that repeats do not pile up
                both = np.concatenate([*fresh, np.concatenate([w, n[None].astype(np.uint64)])], axis=1)
                (w, n), fresh, size = _counted(both[:4], both[4].astype(np.int64)), [], 0
        both = np.concatenate([*fresh, np.concatenate([w, n[None].astype(np.uint64)])], axis=1)
        w, n = _counted(both[:4], both[4].astype(np.int64))
        yield from pa.Table.from_pydict(node_flow(w, n, hot_codes, least)).to_batches(65_536)

    found = stored(edge_weights(texts, seed, codes, buckets, hot).groupBy("bucket").applyInArrow(count, GRAM), "flow")
    c = ["c1", "c2", "c3", "c4"]
    rest = found.filter(~F.col("whole")).groupBy(*c).agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return stored(found.filter("whole").select(*c, "f").unionByName(rest.select(*c, "f"))
                  .select(F.filter(F.array(*c), lambda x: x != 0).alias("gram"), "f"), "grams")


def paths(grams: DataFrame) -> DataFrame:
    """``gram, f, head, place``: edges (four words) with the first edge of the path they lie on and their place in it.

    A path goes on from an edge to the next where all occurrences of the node between them come in by the one and
    leave by the other, so the weight is the same along it. Every round of pointer doubling doubles the steps known;
    a path cannot close to a ring, since a piece must enter the ring somewhere.
    """
    edges = grams.filter(F.size("gram") == 4)
    nodes = grams.filter(F.size("gram") == 3).select(F.col("gram").alias("node"), F.col("f").alias("nf"))
    into = edges.select(F.slice("gram", 2, 3).alias("node"), F.col("gram").alias("before"), F.col("f").alias("fi"))
    out = edges.select(F.slice("gram", 1, 3).alias("node"), F.col("gram"), F.col("f").alias("fo"))
    links = (into.join(nodes, "node").filter("fi = nf").join(out, "node").filter("fo = nf").select("gram", "before"))
    cur = stored(edges.join(links, "gram", "left")
                 .select("gram", "f", F.coalesce("before", "gram").alias("head"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("place")), "paths")
    steps = -1
    while True:
        now = cur.agg(F.sum("place")).first()[0] or 0
        if now == steps:
            return cur
        steps = now
        far = cur.filter("place > 0").select(F.col("gram").alias("head"), F.col("head").alias("further"), F.col("place").alias("more"))
        cur = stored(cur.join(far, "head", "left").select(
            "gram", "f", F.coalesce("further", "head").alias("head"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")), "paths")


def _held(grams: DataFrame, edges: DataFrame) -> DataFrame:
    """``gram, held``: the largest count of a longer candidate that holds a phrase of two or three words.
    An edge in a path after its first leaves out the phrases that the edge before has handed on with the same count."""
    head = F.col("place") == 0
    g = F.col("gram")
    last = F.array(F.slice(g, 2, 3), F.slice(g, 3, 2))
    every = F.array(F.slice(g, 1, 3), F.slice(g, 2, 3), F.slice(g, 1, 2), F.slice(g, 2, 2), F.slice(g, 3, 2))
    four = edges.select(F.explode(F.when(head, every).otherwise(last)).alias("gram"), "f")
    three = grams.filter(F.size("gram") == 3).select(F.explode(F.array(F.slice(g, 1, 2), F.slice(g, 2, 2))).alias("gram"), "f")
    return four.unionByName(three).groupBy("gram").agg(F.max("f").alias("held"))


def _decimal(c):
    return c.cast("decimal(38,0)")


RESULT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, share: int = SHARE, text_col: str = "text",
                 lang_col: str = "lang", hot: int = HOT, dictionary: int = DICTIONARY, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of two to four words.

    ``a`` is the phrase's count (at least ``least``), ``l`` and ``r`` the counts of its parts at the cut with the lowest
    ``floor(2000000 * a / (l + r))``, ``n`` all words of the language. A phrase inside a longer one with at least
    ``share`` hundredths of its count is left out. Order: score, then ``a``, falling, then phrase.

    A null text is empty; a null language is ``und``, together with rows that say so; ids are not read, so
    repeated rows count as often as they stand. An empty table, or one without a phrase of ``least``
    occurrences, gives no row. Phrases never cross the end of a piece or of a text; a very long text is worked on alone,
    a language with most of the rows is split by words. Extra columns are not read.
    """
    spark = docs.sparkSession
    texts = _prepared(docs, text_col, lang_col)
    words, seed = vocabulary(texts)
    frequent = words.filter(F.col("c") >= least)
    occurrences = frequent.agg(F.sum("c")).first()[0]
    if not occurrences:
        return spark.createDataFrame([], RESULT)
    codes = Codes(frequent, dictionary, hot)
    shared = spark.sparkContext.broadcast(codes)
    grams = phrase_counts(texts, seed, codes, occurrences, least, hot, bucket_windows)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = shared.value.of(b.column("key").to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), b.column("lang"), b.column("word")], names=["code", "lang", "word"])

    lexicon = frequent.select("key", "lang", "word").mapInArrow(coded, "code long, lang string, word string")
    candidates = grams.filter(F.size("gram") > 1)
    kept = (candidates.join(_held(grams, paths(grams)), "gram", "left")
            .filter(F.col("held").isNull() | (_decimal(F.col("held")) * 100 < _decimal(F.col("f")) * share))
            .select("gram", F.col("f").alias("a")))
    size = F.size("gram")
    cuts = kept.select("gram", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("gram", "a", "k", F.slice("gram", F.lit(1), F.col("k")).alias("left"), F.expr("slice(gram, k + 1, size(gram) - k)").alias("right"))
    scored = (cuts.join(grams.select(F.col("gram").alias("left"), F.col("f").alias("l")), "left")
              .join(grams.select(F.col("gram").alias("right"), F.col("f").alias("r")), "right")
              .withColumn("score", F.expr("cast((cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")))
    best = scored.groupBy("gram", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    named = (best.select("gram", "a", "b", F.posexplode("gram").alias("p", "code")).join(lexicon, "code")
             .groupBy("gram", "a", "b").agg(F.min("lang").alias("lang"), F.array_join(F.transform(
                 F.array_sort(F.collect_list(F.struct("p", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    # a language's phrases are first cut in parts, so that no task sorts them all
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.desc("score"), F.desc("a"), "phrase"
    ranked = named.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    for by in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("c").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
