"""Vector operators: keyed attach, cosine, block all-pairs, min-max, 3-sigma
trim, PCA projection, exact k-NN, neighbour graph, density grid, shape.

Scale notes
* One-row statistics (min/max, mean/std, a query vector) are computed by a
  Spark aggregate and read back as a handful of scalars; nothing row-sized
  passes through the driver.
* Dense all-pairs work (cosine matrix, neighbour graph) is done by blocks:
  every row is hashed into one of B blocks, each (block, block) pair is one
  cogroup task that runs a numpy matrix product and emits only what survives
  (a threshold or a per-query top-k). No pair rows are materialised, and B
  is derived from the row count so a block always fits one task.
* k-NN for a bounded query set ships the (size-checked) query matrix to every
  task, keeps a per-partition top-k, and merges with a windowed top-k whose
  groups hold at most k x partitions rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..session import checkpoint

# Largest query matrix (rows x dims) shipped with the task closure by ``knn``
# (~32 MB of doubles); beyond it the exact block plan is used instead.
MAX_QUERY_CELLS = 4_000_000
MAX_BROADCAST_IDS = 1_000_000  # ids (8 to a few dozen bytes each) that may be broadcast


def matched_join(left: DataFrame, right: DataFrame, key: str, missing: str = "keep") -> DataFrame:
    """``left`` with the columns of ``right`` by key. Left rows without a partner stay with
    nulls and ``matched`` false (``keep``), raise (``error``; one pass counts them) or go (``drop``)."""
    if missing == "drop":
        return left.join(right, key, "inner")
    out = left.join(right.withColumn("matched", F.lit(True)), key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    if missing == "error":
        n = out.filter(~F.col("matched")).count()
        if n:
            raise ValueError(f"{n} rows have no partner by {key}")
        out = out.drop("matched")
    return out


def attach_vectors(rows: DataFrame, vecs: DataFrame, key: str = "uid", missing: str = "keep") -> DataFrame:
    """Keyed join of text rows and vectors (replaces attach-by-position); rows
    without a vector stay, flagged by ``matched``, unless ``missing`` says otherwise."""
    return matched_join(rows, vecs, key, missing)


def shape(df: DataFrame, vec_col: str = "vec") -> DataFrame:
    """``rows, width`` (widest vector)."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(vec_col)).alias("width"))


def cosine_to(df: DataFrame, query_vec: list[float], vec_col: str = "vec", out_col: str = "cos") -> DataFrame:
    """V2: cosine of every row against one vector (zero vector -> 0.0)."""
    q = F.array(*[F.lit(float(x)) for x in query_vec])
    return df.withColumn(out_col, V.cosine(F.col(vec_col), q))


def vector_of(df: DataFrame, id_col: str, id_value, vec_col: str = "vec") -> list[float]:
    row = df.filter(F.col(id_col) == F.lit(id_value)).select(vec_col).first()
    if row is None:
        raise KeyError(id_value)
    return list(row[0])


def filter_dim(df: DataFrame, d: int, vec_col: str = "vec") -> DataFrame:
    """Vectors of width ``d`` only."""
    return df.filter(F.size(vec_col) == d)


def axis_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """A3: one row with min, max, mean and population std of each column."""
    aggs = [e for c in cols for e in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"),
                                      F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"))]
    return df.agg(*aggs)


def minmax(df: DataFrame, cols: list[str], eps: float = 1e-6) -> DataFrame:
    """V4: ``(x - min + eps) / (max - min + eps)`` per column; range (0, 1]."""
    aggs = [e for c in cols for e in (F.min(c).alias(f"mn_{c}"), F.max(c).alias(f"mx_{c}"))]
    st = df.agg(*aggs).first()
    out = df
    for c in cols:
        mn, mx = st[f"mn_{c}"], st[f"mx_{c}"]
        out = out.withColumn(c, (F.col(c) - F.lit(mn) + F.lit(eps)) / (F.lit(mx) - F.lit(mn) + F.lit(eps)))
    return out


def trim_outliers(df: DataFrame, cols: list[str], k: float = 3.0) -> DataFrame:
    """V5: keep rows strictly within mean +- k * population std on every column
    (statistics of the untrimmed set, computed once)."""
    aggs = [e for c in cols for e in (F.avg(c).alias(f"mu_{c}"), F.stddev_pop(c).alias(f"sd_{c}"))]
    st = df.agg(*aggs).first()
    cond = None
    for c in cols:
        mu, sd = st[f"mu_{c}"], st[f"sd_{c}"]
        ok = (F.col(c) < F.lit(mu) + F.lit(k) * F.lit(sd)) & (F.col(c) > F.lit(mu) - F.lit(k) * F.lit(sd))
        cond = ok if cond is None else cond & ok
    return df.filter(cond)


def density_grid(df: DataFrame, x: str = "x", y: str = "y", bins: int = 10) -> DataFrame:
    """Counts per cell of a bins x bins grid over [0, 1]; 1.0 goes to the last bin."""
    def cell(c):
        return F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(cell(x).alias("bx"), cell(y).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def project_2d(df: DataFrame, id_col: str = "uid", vec_col: str = "vec") -> DataFrame:
    """V6: two principal components (Spark ML PCA), sign fixed so each
    component's largest-magnitude loading is positive. ``id_col, x, y``."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    feats = df.select(id_col, array_to_vector(F.col(vec_col)).alias("f"))
    model = PCA(k=2, inputCol="f", outputCol="p").fit(feats)
    pc = model.pc.toArray()
    signs = [1.0 if pc[np.argmax(np.abs(pc[:, j])), j] >= 0 else -1.0 for j in range(2)]
    arr = vector_to_array(F.col("p"))
    return model.transform(feats).select(id_col, (arr[0] * signs[0]).alias("x"), (arr[1] * signs[1]).alias("y"))


# ---------------------------------------------------------------- block helpers

# Bytes of vectors per block: a (block, block) task holds two blocks.
BLOCK_BYTES = 64 << 20
# Cells (queries x points x dims) of one difference tensor: ~32 MB of doubles.
DIFF_CELLS = 4_000_000
# Cells (queries x points) of one distance matrix inside a task.
DIST_CELLS = 4_000_000
# Blocks of a side that all-pairs work is spread over, where they get at least so many rows.
SPREAD_BLOCKS = 16
SPREAD_ROWS = 4096
# Pairs one cosine-matrix task may return (its output is one pandas frame).
MAX_TASK_PAIRS = 10_000_000


def block_rows_for(dim: int, block_rows: int | None = None) -> int:
    """Rows per block: explicit, or as many as fit ``BLOCK_BYTES`` of doubles.
    Bigger blocks mean fewer copies of each row in the shuffle (a row is
    copied once per block of the other side)."""
    return block_rows or max(256, BLOCK_BYTES // (8 * max(1, dim)))


def _blocks_for(n: int, block_rows: int) -> int:
    return max(1, math.ceil(n / max(1, block_rows)))


def _graph_blocks(n: int, dim: int, block_rows: int | None = None) -> int:
    """Blocks of one side of all-pairs work: as many as memory asks for, and so many
    more that a table of a few blocks' size still has its pairs spread over up to ``SPREAD_BLOCKS``^2 tasks."""
    if block_rows:
        return _blocks_for(n, block_rows)
    return max(_blocks_for(n, block_rows_for(dim)), min(SPREAD_BLOCKS, _blocks_for(n, SPREAD_ROWS)))


def _with_block(df: DataFrame, id_col: str, b: int) -> DataFrame:
    return df.withColumn("_b", F.pmod(F.xxhash64(F.col(id_col)), F.lit(b)).cast("int"))


def _sq_dists(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact squared distances (differences, not the expanded dot form, which
    loses digits to cancellation), computed in chunks of bounded memory."""
    nq, dim = q.shape[0], max(1, q.shape[1] if q.ndim == 2 else 1)
    out = np.empty((nq, p.shape[0]), dtype=np.float64)
    qc = max(1, min(nq, DIFF_CELLS // dim))
    pc = max(1, DIFF_CELLS // (qc * dim))
    for a in range(0, nq, qc):
        for b in range(0, p.shape[0], pc):
            d = q[a:a + qc, None, :] - p[None, b:b + pc, :]
            out[a:a + qc, b:b + pc] = np.einsum("ijk,ijk->ij", d, d)
    return out


def _id_key(ids: np.ndarray) -> np.ndarray:
    """Sortable stand-in for an id array (numbers as is, others by rank)."""
    if ids.dtype.kind in "iuf":
        return ids
    _, inv = np.unique(ids, return_inverse=True)
    return inv.reshape(ids.shape)


class _TopK:
    """Running k smallest (distance, id) per query over chunks of points.

    A matrix product gives every distance up to a bound on its rounding error; only points that may
    be among the k nearest by it get their exact distance, so the answer is that of ``_sq_dists`` on all pairs.
    Memory stays O(query chunk x (k + point chunk)) whatever the block size;
    ties are broken by id, so the answer is the same for any chunking."""

    def __init__(self, qids, k: int, include_self: bool):
        self.qids = np.asarray(qids)
        self.k = k
        self.include_self = include_self
        self.bd = np.full((len(self.qids), k), np.nan)  # sorted by distance and id, NaN: no such neighbour
        self.bi = None

    def add(self, qm: np.ndarray, pids, pm: np.ndarray) -> None:
        pids = np.asarray(pids)
        if len(pids) == 0 or len(self.qids) == 0:
            return
        if self.bi is None:
            self.bi = np.full((len(self.qids), self.k), pids[0], dtype=pids.dtype)
        elif self.bi.dtype != pids.dtype:
            self.bi = self.bi.astype(np.promote_types(self.bi.dtype, pids.dtype))
        nq = len(self.qids)
        qc = max(1, min(nq, 512, DIST_CELLS))
        pc = max(1, min(4096, DIST_CELLS // qc))
        # near the data's middle products lose the fewest digits
        with np.errstate(invalid="ignore", over="ignore"):
            middle = pm.mean(axis=0)
            middle = np.where(np.isfinite(middle), middle, 0.0)
            qs, ps = qm - middle, pm - middle
            q2, p2 = np.einsum("ij,ij->i", qs, qs), np.einsum("ij,ij->i", ps, ps)
        for a in range(0, nq, qc):
            for b in range(0, len(pids), pc):
                self._chunk(slice(a, min(nq, a + qc)), qm, qs, q2, pids[b:b + pc], pm[b:b + pc], ps[b:b + pc], p2[b:b + pc])

    def _chunk(self, rows: slice, qm, qs, q2, pi, pm, ps, p2) -> None:
        """Merge one chunk of points into the neighbours of one chunk of queries."""
        qi, k = self.qids[rows], self.k
        with np.errstate(invalid="ignore", over="ignore"):
            near = qs[rows] @ ps.T
            near *= -2.0
            near += q2[rows, None]
            near += p2[None, :]
            # rounding of the product form and of the exact one, with the shift to the middle
            slack = (16 + 4 * qm.shape[1]) * np.finfo(np.float64).eps * (q2[rows, None] + p2.max(initial=0.0))
            shift = np.abs(qm[rows]).max(axis=1, initial=0.0) + (np.abs(pm).max(initial=0.0))
            slack = slack + 16 * qm.shape[1] * (np.finfo(np.float64).eps * shift[:, None]) ** 2 + 8 * np.finfo(np.float64).eps * (shift * np.sqrt(qm.shape[1]))[:, None] * (np.sqrt(q2[rows, None]) + np.sqrt(p2.max(initial=0.0)))
        unsure = not (np.isfinite(slack).all() and np.isfinite(near).all())
        if unsure:  # components that are not finite, or squares beyond double: compared exactly
            near[:] = 0.0
            slack = np.full((len(qi), 1), np.inf)
        if not self.include_self:
            near[qi[:, None] == pi[None, :]] = np.nan  # never a neighbour
        kth = self.bd[rows, k - 1]
        limit = np.where(np.isnan(kth), np.inf, kth)[:, None] + slack
        if not unsure and near.shape[1] > k:
            # k points of this chunk lie within this distance (NaN is sorted behind all)
            own = np.partition(near, k - 1, axis=1)[:, k - 1, None] if np.isinf(limit).any() else np.inf
            limit = np.fmin(limit, own + 2 * slack)
        r, c = np.nonzero(near <= limit)
        if not len(r):
            return
        start = rows.start
        step = max(1, DIFF_CELLS // max(1, qm.shape[1]))
        d = np.empty(len(r))
        for i in range(0, len(r), step):
            with np.errstate(invalid="ignore", over="ignore"):
                x = qm[start + r[i:i + step]] - pm[c[i:i + step]]
                d[i:i + step] = np.einsum("ij,ij->i", x, x)
        d[~np.isfinite(d)] = np.inf  # a point with a non-finite component comes last, but is there
        some = np.unique(r)
        old_r, old_c = np.nonzero(~np.isnan(self.bd[start + some]))
        all_r = np.concatenate([some[old_r], r])
        all_d = np.concatenate([self.bd[start + some[old_r], old_c], d])
        all_i = np.concatenate([self.bi[start + some[old_r], old_c], pi[c]])
        order = np.lexsort((_id_key(all_i), all_d, all_r))
        all_r, all_d, all_i = all_r[order], all_d[order], all_i[order]
        first = np.flatnonzero(np.append(True, all_r[1:] != all_r[:-1]))
        place = np.arange(len(all_r)) - np.repeat(first, np.diff(np.append(first, len(all_r))))
        keep = place < k
        self.bd[start + all_r[keep], place[keep]] = all_d[keep]
        self.bi[start + all_r[keep], place[keep]] = all_i[keep]

    def frame(self) -> pd.DataFrame:
        if self.bi is None:
            return pd.DataFrame({"q_uid": [], "uid": [], "dist": []})
        r, c = np.nonzero(~np.isnan(self.bd))
        return pd.DataFrame({"q_uid": self.qids[r], "uid": self.bi[r, c], "dist": self.bd[r, c]})


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors])


def _final_topk(cands: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q_uid").orderBy(F.col("dist"), F.col("uid"))
    return (cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumn("rank", (F.col("rank") - 1).cast("int")))


def knn(queries: DataFrame, points: DataFrame, k: int, include_self: bool = True,
        id_col: str = "uid", vec_col: str = "vec") -> DataFrame:
    """V7/V8: exact k nearest points (squared L2) for a bounded query set.

    Output ``q_uid, rank (0-based), uid, dist``; ties by ``uid``. With
    ``include_self=False`` the query's own id is excluded. Each task streams
    its partition's Arrow batches through a running top-k and emits at most
    queries x k rows.
    """
    queries = checkpoint(queries.select(id_col, vec_col))  # evaluated once
    st = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("d")).first()
    if not st["n"]:
        raise ValueError("knn: no queries")
    if st["n"] * st["d"] > MAX_QUERY_CELLS:  # size checked before anything reaches the driver
        return knn_blocks(queries, points, k, include_self, id_col, vec_col)
    q = queries.collect()
    shipped = points.sparkSession.sparkContext.broadcast(([r[0] for r in q], _matrix(r[1] for r in q)))
    id_type = points.schema[id_col].dataType.simpleString()

    def part_topk(batches):
        qids, qm = shipped.value
        top = _TopK(qids, k, include_self)
        for pdf in batches:
            if not pdf.empty:
                top.add(qm, pdf[id_col].to_numpy(), _matrix(pdf[vec_col]))
        yield top.frame()

    schema = f"q_uid {id_type}, uid {id_type}, dist double"
    cands = points.select(id_col, vec_col).mapInPandas(part_topk, schema)
    return _final_topk(cands, k).select("q_uid", "rank", "uid", "dist")


def knn_blocks(queries: DataFrame, points: DataFrame, k: int, include_self: bool = False,
               id_col: str = "uid", vec_col: str = "vec", block_rows: int | None = None) -> DataFrame:
    """V9 engine: exact k-NN for any number of queries by (query block, point block)
    cogroups; each task keeps its local top-k, a windowed top-k merges them."""
    sq = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("d")).first()
    sp = points.agg(F.count(F.lit(1)).alias("n")).first()
    bq, bp = _graph_blocks(sq["n"], sq["d"] or 1, block_rows), _graph_blocks(sp["n"], sq["d"] or 1, block_rows)
    id_type = points.schema[id_col].dataType.simpleString()
    qs = _with_block(queries.select(F.col(id_col).alias("qid"), F.col(vec_col).alias("qv")), "qid", bq)
    ps = _with_block(points.select(F.col(id_col).alias("pid"), F.col(vec_col).alias("pv")), "pid", bp)
    # every query block meets every point block
    qs = qs.select("qid", "qv", F.col("_b").alias("bq"), F.explode(F.sequence(F.lit(0), F.lit(bp - 1))).alias("bp"))
    ps = ps.select("pid", "pv", F.col("_b").alias("bp"), F.explode(F.sequence(F.lit(0), F.lit(bq - 1))).alias("bq"))

    def pair_topk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"q_uid": [], "uid": [], "dist": []})
        top = _TopK(left["qid"].to_numpy(), k, include_self)
        top.add(_matrix(left["qv"]), right["pid"].to_numpy(), _matrix(right["pv"]))
        return top.frame()

    # a partition per block pair, about: by bytes few would hold all, and a pair's work is the product of its blocks
    tasks = max(1, min(bq * bp, 4096))
    qs, ps = qs.repartition(tasks, "bq", "bp"), ps.repartition(tasks, "bq", "bp")
    schema = f"q_uid {id_type}, uid {id_type}, dist double"
    cands = (qs.groupBy("bq", "bp").cogroup(ps.groupBy("bq", "bp")).applyInPandas(pair_topk, schema))
    return _final_topk(cands, k).select("q_uid", "rank", "uid", "dist")


def knn_graph(points: DataFrame, ks=(5, 10, 15, 20), id_col: str = "uid", vec_col: str = "vec",
              block_rows: int | None = None) -> DataFrame:
    """V9: neighbour graph for the largest k (self excluded); smaller k are a
    filter on ``rank`` (see ``graph_for_k``)."""
    return knn_blocks(points, points, max(ks), False, id_col, vec_col, block_rows)


def graph_for_k(graph: DataFrame, k: int) -> DataFrame:
    return graph.filter(F.col("rank") < k)


def cosine_block_rows(dim: int) -> int:
    """Rows per block of ``cosine_matrix``."""
    return min(block_rows_for(dim), int(math.isqrt(MAX_TASK_PAIRS)))


def cosine_matrix(df: DataFrame, threshold: float | None = None, id_col: str = "uid",
                  vec_col: str = "vec", block_rows: int | None = None) -> DataFrame:
    """V3: pairwise cosine similarity ``i <= j`` (diagonal included), unrounded;
    with ``threshold`` only pairs with a similarity >= it. Without one all n(n + 1)/2 pairs
    are asked for: meant for a set of sampled rows.
    Inside a block pair the product is taken in chunks of bounded memory."""
    st = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("d")).first()
    # a task returns its pairs as one frame: blocks also small enough that even
    # a full block pair (no threshold) stays within MAX_TASK_PAIRS
    b = _blocks_for(st["n"], block_rows or cosine_block_rows(st["d"] or 1))
    id_type = df.schema[id_col].dataType.simpleString()
    base = _with_block(df.select(F.col(id_col).alias("k"), F.col(vec_col).alias("v")), "k", b)
    # block pair (bi, bj) with bi <= bj: left rows of bi, right rows of bj
    left = base.select(F.col("k").alias("lid"), F.col("v").alias("lv"), F.col("_b").alias("bi"),
                       F.explode(F.sequence(F.col("_b"), F.lit(b - 1))).alias("bj"))
    right = base.select(F.col("k").alias("rid"), F.col("v").alias("rv"), F.col("_b").alias("bj"),
                        F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("bi"))
    return block_cosines(left, right, threshold, id_type)


def block_cosines(left: DataFrame, right: DataFrame, thr: float | None, id_type: str) -> DataFrame:
    """``i, j, sim`` of ``left`` (``lid, lv, bi, bj``) and ``right`` (``rid, rv, bi, bj``) rows that meet in a block pair;
    rows of one block (``bi`` = ``bj``) meet once."""
    def block_cos(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if lp.empty or rp.empty:
            return pd.DataFrame({"i": [], "j": [], "sim": []})
        a, c = _matrix(lp["lv"]), _matrix(rp["rv"])
        na, nc = np.linalg.norm(a, axis=1), np.linalg.norm(c, axis=1)
        li, ri = lp["lid"].to_numpy(), rp["rid"].to_numpy()
        same_block = lp["bi"].iloc[0] == rp["bj"].iloc[0]
        step = max(1, DIST_CELLS // max(1, len(ri)))
        parts = []
        for s0 in range(0, len(li), step):
            den = np.outer(na[s0:s0 + step], nc)
            raw = a[s0:s0 + step] @ c.T
            with np.errstate(invalid="ignore", divide="ignore"):
                sim = np.where(den == 0, 0.0, raw / np.where(den == 0, 1.0, den))
            mask = np.ones_like(sim, dtype=bool)
            if same_block:
                mask &= li[s0:s0 + step, None] <= ri[None, :]
            if thr is not None:
                mask &= sim >= thr
            ii, jj = np.nonzero(mask)
            lo, hi = li[s0:s0 + step][ii], ri[jj]
            parts.append(pd.DataFrame({"i": np.where(lo <= hi, lo, hi), "j": np.where(lo <= hi, hi, lo),
                                       "sim": sim[ii, jj]}))
        return pd.concat(parts, ignore_index=True)

    schema = f"i {id_type}, j {id_type}, sim double"
    return left.groupBy("bi", "bj").cogroup(right.groupBy("bi", "bj")).applyInPandas(block_cos, schema)


def texts_of(ids: DataFrame, texts: DataFrame, id_col: str = "uid") -> DataFrame:
    """The text rows of a few ids: the ids go to the texts, not the texts through a shuffle."""
    few = ids.select(id_col).distinct()
    return texts.join(F.broadcast(few) if few.count() <= MAX_BROADCAST_IDS else few, id_col, "left_semi")


def neighbour_report(nn: DataFrame, texts: DataFrame, id_col: str = "uid", text_col: str = "text",
                     sep: str = "\n") -> DataFrame:
    """Per query, its neighbours' texts in rank order joined by ``sep``; a
    neighbour without a text keeps its place with an empty one. Groups hold k rows
    (bounded by the k-NN)."""
    nn = checkpoint(nn.select("q_uid", "rank", "uid"))
    t = texts_of(nn, texts.select(F.col(id_col).alias("uid"), F.coalesce(text_col, F.lit("")).alias("_t")))
    j = nn.join(t, "uid", "left")
    g = j.groupBy("q_uid").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("_t", F.lit("")).alias("t")))).alias("_l"))
    return g.select("q_uid", F.array_join(F.transform("_l", lambda x: x["t"]), sep).alias("report"))
