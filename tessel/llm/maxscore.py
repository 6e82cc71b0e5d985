"""Exact top-k search by inner product with MaxScore.

A vector's components are its terms: each shard of vectors holds, for every
dimension, the postings (the component of every vector of the shard) in blocks of vectors by falling length, with the
largest and smallest value of each block. For a query a term's bound is the largest product
any vector of the block can have with it. The last terms whose bounds alone stay under the query's threshold are
non-essential: the essential ones are traversed for the whole block, the others are
probed, a few terms at a time, only for vectors that are still competitive. The threshold
is the k-th best score found so far; it starts from a small sample of all
vectors and rises with every block. The shards' lists are merged.

Components are whole numbers, so scores are exact. All numbers stay below 2**53
in float64 arithmetic, which is checked; beyond that, Python integers are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

TOP_K = 20
SCALE = 64.0
SHARD_ROWS = 32_768   # vectors of a shard
QUERY_ROWS = 8_192    # queries of a block
SEED_ROWS = 1_024     # sampled vectors that give every query its first threshold
STEP = 4              # non-essential terms probed between two looks at the bounds
BLOCK = 8_192         # vectors of a block, after which the threshold rises
SAFE = float(1 << 53)


def quantised(vectors: DataFrame, scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, vec`` (array<long>, each component ``floor(scale * x)`` with x as
    double). Vectors null, or holding null or non-finite components, and null ids are left out."""
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
            .select(F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(x, lambda v: F.floor(F.lit(scale) * v)).alias("vec")))


def _matrix(col: pd.Series, width: int) -> np.ndarray:
    """Rows as float64 of the given width; missing components count as zero."""
    if len(col) and all(len(v) == width for v in col):
        return np.stack(col.to_numpy()).astype(np.float64)
    out = np.zeros((len(col), width))
    for i, v in enumerate(col):
        out[i, :len(v)] = v
    return out


class Shard:
    """Postings of a set of vectors by dimension, in blocks by falling length, with each block's bounds."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray):
        order = np.lexsort((ids, -(vecs * vecs).sum(axis=1)))  # long vectors first: they raise the threshold
        self.ids, self.rows = ids[order], vecs[order]
        self.postings = np.ascontiguousarray(self.rows.T)
        self.products = 0  # multiplications done so far
        self.blocks = []
        for a in range(0, len(ids), BLOCK):
            part = self.postings[:, a:a + BLOCK]
            self.blocks.append((a, min(a + BLOCK, len(ids)), part.max(axis=1), part.min(axis=1)))

    def search(self, own: int, q: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best with score at or above ``threshold``, without id ``own``; ties to smaller ids.

        Terms are taken by falling range of what they can add. The non-essential ones are the last terms whose bounds together stay under the
        threshold: the essential ones are traversed for a whole block, the others probed only for vectors
        that can still reach it. After a block the threshold is the k-th best score so far.
        """
        ids, best, d = self.ids[:0], np.zeros(0), len(q)
        for start, end, high, low in self.blocks:
            a, z = q * high, q * low
            bound = np.maximum(a, z)  # of each term, over the block
            terms = np.argsort(-np.abs(a - z), kind="stable")
            rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0.0)  # what terms i.. can add at most
            if rest[0] < threshold:
                continue
            under = np.flatnonzero(rest < threshold)
            split = int(under[0]) if len(under) else d  # the first non-essential term
            essential = terms[:split]
            score = q[essential] @ self.postings[essential, start:end]
            self.products += split * (end - start)
            alive = np.flatnonzero(score + rest[split] >= threshold)
            score, alive, i = score[alive], alive + start, split
            while i < d and len(alive):
                step = terms[i:i + STEP]
                score = score + self.rows[alive[:, None], step] @ q[step]
                self.products += len(alive) * len(step)
                i += len(step)
                keep = score + rest[i] >= threshold
                score, alive = score[keep], alive[keep]
            keep = self.ids[alive] != own
            ids, best = np.append(ids, self.ids[alive[keep]]), np.append(best, score[keep])
            if len(ids) > k:
                kth = np.partition(best, len(best) - k)[len(best) - k]
                ids, best = ids[best >= kth], best[best >= kth]  # ties stay until the end
            if len(ids) >= k:
                threshold = max(threshold, float(best.min()))
        order = np.lexsort((ids, -best))[:k]
        return ids[order], best[order]


def _exact(q: np.ndarray, vecs: np.ndarray) -> list[int]:
    return [sum(int(a) * int(b) for a, b in zip(q, v)) for v in vecs]


def top_k(vectors: DataFrame, every: int = 20, k: int = TOP_K, scale: float = SCALE, shard_rows: int = SHARD_ROWS,
          query_rows: int = QUERY_ROWS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose id is divisible by
    ``every``, the ``k`` rows with the largest inner product.

    Candidates are all rows but those with the query's own id; ties go to the smaller id.
    Rows that share an id are each a candidate; as queries they count once (the smallest vector).
    Vectors of different lengths meet as if filled up with zeros. Fewer candidates than ``k`` give them
    all; an empty table gives no row. Shards and query blocks have bounded sizes
    and meet pair by pair; nothing of them passes through the driver.
    """
    spark = vectors.sparkSession
    vecs = stored(quantised(vectors, scale, id_col, vec_col), "vectors")
    stats = vecs.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width"),
                     F.max(F.array_max(F.transform("vec", lambda v: F.abs(v.cast("double"))))).alias("top"),
                     F.sum((F.col("vec_id") % every == 0).cast("long")).alias("queries")).first()
    result = "query_id long, vec_id long, score long"
    if not stats["n"] or not stats["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = stats["width"]
    safe = (stats["top"] or 0.0) ** 2 * max(1, width) < SAFE
    shards = -(-stats["n"] // shard_rows)
    blocks = -(-stats["queries"] // query_rows)
    queries = (vecs.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))
               .select(F.col("vec_id").alias("query_id"), "vec"))

    # first thresholds: the k-th best of a small sample, the smallest hashes of all ids
    sample = vecs.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(SEED_ROWS).toPandas()
    seeds = spark.sparkContext.broadcast((sample["vec_id"].to_numpy(np.int64), _matrix(sample["vec"], width)))

    def with_threshold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rows = seeds.value
        for pdf in batches:
            own = pdf["query_id"].to_numpy()
            out = np.full(len(pdf), -np.inf)
            if safe:
                score = _matrix(pdf["vec"], width) @ rows.T
                score[own[:, None] == ids[None, :]] = -np.inf
                if score.shape[1] >= k:
                    out = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
            yield pdf.assign(threshold=out)

    asked = stored(queries.mapInPandas(with_threshold, "query_id long, vec array<long>, threshold double"), "queries")
    left = (asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    right = (vecs.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(shards)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))

    def search(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if not len(ask) or not len(have):
            return pd.DataFrame(out).astype("int64")
        if safe:
            shard = Shard(have["vec_id"].to_numpy(np.int64), _matrix(have["vec"], width))
            rows = _matrix(ask["vec"], width)
        for i, (own, threshold) in enumerate(zip(ask["query_id"], ask["threshold"])):
            if safe:
                ids, score = shard.search(own, rows[i], k, threshold)
            else:  # numbers beyond exact floating point: Python integers, cut to 64 bits at the end
                pairs = sorted((-s, v) for s, v in zip(_exact(ask["vec"].iloc[i], have["vec"]), have["vec_id"]) if v != own)[:k]
                ids = np.array([v for _, v in pairs], np.int64)
                score = np.array([max(-(1 << 63), min((1 << 63) - 1, -s)) for s, _ in pairs], np.int64)
            out["query_id"].append(np.full(len(ids), own))
            out["vec_id"].append(ids)
            out["score"].append(score)
        return pd.DataFrame({c: np.concatenate(v).astype(np.int64) for c, v in out.items()})

    found = (left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, result))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
