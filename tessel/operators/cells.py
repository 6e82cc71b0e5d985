"""Cells around pivots: exact neighbour search and cosine joins that skip what bounds rule out.

Points go to the cell of their nearest pivot. Pivots come from a bounded sample, so
their number is bounded (``MAX_PIVOTS``) and they travel to every task; a cell's
points do not, they are cut into blocks of at most ``BLOCK_ROWS`` rows, so a vector that fills
a third of the table is spread over many tasks.

For a query ``q``, no point of cell ``B`` (pivot ``p``, distances to it between ``inner`` and
``radius``) is nearer than

* ``d(q, p) - radius`` and ``inner - d(q, p)`` (triangle inequality), and
* ``(d(q, p)^2 - d(q, a)^2) / (2 d(a, p))`` for the pivot ``a`` of the query's own cell, since
  the points of ``B`` lie on the other side of the plane half-way between the pivots.

An upper bound for the k-th distance comes from the query's own block and from the cells' radii. Both
bounds are widened by ``SLACK`` for rounding, so results are exact. In few dimensions or clustered
data most cells fall out; where they do not, ``neighbour_graph`` counts the copies it would make and takes the block
plan of ``vectors.knn_blocks`` if that makes fewer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint
from .vectors import MAX_QUERY_CELLS, _blocks_for, _final_topk, _graph_blocks, _matrix, _sq_dists, _TopK, block_cosines, block_rows_for, cosine_block_rows, cosine_matrix, knn, knn_blocks

MAX_PIVOTS = 2048
SAMPLE_CELLS = 4_000_000   # numbers (rows x dims) of the sample that pivots come from, 32 MB
CELL_ROWS = 512            # points wanted in a cell while there are pivots left
BLOCK_ROWS = 4096          # points of a cell that a task compares at once
QUERY_ROWS = 16_384        # queries sent to one block at once
FILE_ROWS = 65_536         # points of a cell in one file of a stored index
LLOYD_STEPS = 4
COPIES = 64                # copies of a point up to which cells are taken in any case
SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(_sq_dists(a, b))


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest pivot (the first of equally near ones) and the distance to it."""
    top = _TopK(np.arange(len(x)), 1, True)
    top.add(x, np.arange(len(pivots), dtype=np.int32), pivots)
    return top.bi[:, 0], np.sqrt(top.bd[:, 0])


def choose_pivots(points: DataFrame, n: int, dim: int, id_col: str, vec_col: str, cell_rows: int = CELL_ROWS,
                  max_pivots: int = MAX_PIVOTS) -> np.ndarray:
    """Centres of a bounded hash-ordered sample after a few Lloyd steps; at most ``max_pivots``."""
    m = max(1, min(max_pivots, SAMPLE_CELLS // max(1, dim), math.ceil(n / cell_rows)))
    rows = max(m, min(n, 16 * m, SAMPLE_CELLS // max(1, dim)))
    key = F.md5(F.concat(F.lit("pivot:"), F.col(id_col).cast("string")))
    got = points.select(vec_col, key.alias("_k"), id_col).orderBy("_k", id_col).limit(rows).select(vec_col).collect()
    x = _matrix(r[0] for r in got)
    c = np.unique(x[:m], axis=0)
    for _ in range(LLOYD_STEPS):
        near = nearest(x, c)[0]
        size = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return np.unique(c, axis=0)


class Cells:
    """Pivots with the number of points, radius and inner radius of their cells."""

    def __init__(self, pivots: np.ndarray, count: np.ndarray, radius: np.ndarray, inner: np.ndarray):
        self.pivots, self.count, self.radius, self.inner = pivots, count, radius, inner
        self.blocks = np.maximum(1, -(-count // BLOCK_ROWS))

    def lower(self, to: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Smallest possible distance from queries to the points of each cell; ``to`` are the distances to all
        pivots, ``own`` each query's own cell."""
        some, at = np.unique(own, return_inverse=True)
        gap = distances(self.pivots[some], self.pivots)[at]
        mine = np.take_along_axis(to, own[:, None], axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(gap > 0, (to * to - mine * mine) / (2 * gap), 0.0)
        best = np.maximum(np.maximum(to - self.radius, self.inner - to), plane)
        best = np.maximum(best - SLACK * (1 + to), 0.0)
        best[:, self.count == 0] = np.inf
        return best

    def upper(self, to: np.ndarray, k: int) -> np.ndarray:
        """A distance within which ``k`` points must lie."""
        far = to + self.radius
        far[:, self.count == 0] = np.inf
        order = np.argsort(far, axis=1)
        have = np.cumsum(self.count[order], axis=1)
        at = (have < k).sum(axis=1)
        far = np.take_along_axis(far, order, axis=1)
        out = np.where(at < far.shape[1], np.take_along_axis(far, np.minimum(at, far.shape[1] - 1)[:, None], axis=1)[:, 0], np.inf)
        return out + SLACK * (1 + out)


def assign(points: DataFrame, pivots: np.ndarray, id_col: str = "uid", vec_col: str = "vec", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, vec, cell, away`` (distance to the cell's pivot) of finite vectors, and the columns to ``keep``; equally near pivots: the first."""
    shared = points.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), BLOCK_ROWS):
                part = pdf.iloc[k:k + BLOCK_ROWS]
                cell, away = nearest(_matrix(part[vec_col]), shared.value)
                yield part.assign(cell=cell, away=away)

    rows = points.select(id_col, F.col(vec_col).cast("array<double>").alias(vec_col), *keep)
    return rows.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", cell int, away double")


def measure(assigned: DataFrame, pivots: np.ndarray) -> Cells:
    """Cell statistics; one row per pivot reaches the driver."""
    rows = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r"), F.min("away").alias("i")).collect()
    count, radius, inner = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    for c, n, r, i in rows:
        count[c], radius[c], inner[c] = n, r, i
    return Cells(pivots, count, radius, inner)


def is_finite(vec):
    return F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _block_of(cells: Cells, id_col: str):
    """Block of a point inside its cell, by a hash of its id."""
    sizes = F.array(*[F.lit(int(b)) for b in cells.blocks]) if (cells.blocks > 1).any() else None
    return F.lit(0) if sizes is None else F.pmod(F.xxhash64(id_col), F.element_at(sizes, F.col("cell") + 1).cast("long")).cast("int")


class NeighbourCells:
    """Points in cells, ready for the neighbour graph of any ``k``."""

    def __init__(self, points: DataFrame, id_col: str = "uid", vec_col: str = "vec", cell_rows: int = CELL_ROWS, max_pivots: int = MAX_PIVOTS):
        self.id_col, self.vec_col = id_col, vec_col
        rows = points.select(F.col(id_col).alias("uid"), F.col(vec_col).cast("array<double>").alias("vec"))
        self.all = rows
        finite = rows.filter(is_finite(F.col("vec")))
        st = finite.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
        self.n, self.dim = st["n"], st["d"] or 1
        self.odd = rows.filter(~is_finite(F.col("vec")) | F.col("vec").isNull()).select("uid")
        self.kind = rows.schema["uid"].dataType.simpleString()
        if self.n:
            pivots = choose_pivots(finite, self.n, self.dim, "uid", "vec", cell_rows, max_pivots)
            placed = checkpoint(assign(finite, pivots))
            self.cells = measure(placed, pivots)
            self.points = placed.withColumn("block", _block_of(self.cells, "uid"))

    def routes(self, k: int, probes: int | None = None) -> DataFrame:
        """One row per point: ``uid, vec, cell, block, bound`` (squared distance that holds ``k`` neighbours),
        ``near``, ``dists`` (neighbours in its own block) and ``reach`` (cells that may hold nearer ones; with ``probes`` at most so many)."""
        shared = self.points.sparkSession.sparkContext.broadcast(self.cells)

        def own_block(pdf: pd.DataFrame) -> pd.DataFrame:
            cells = shared.value
            ids, x = pdf["uid"].to_numpy(), _matrix(pdf["vec"])
            here = int(pdf["cell"].iloc[0])
            top = _TopK(ids, k, False)
            top.add(x, ids, x)
            bd, bi = top.bd, top.bi
            real = ~np.isnan(bd)
            kth = np.where(real.sum(axis=1) >= k, bd[:, min(k, bd.shape[1]) - 1] if bd.shape[1] else np.inf, np.inf)
            reach, bound = [], np.empty(len(ids))
            for a in range(0, len(ids), 256):
                to = distances(x[a:a + 256], cells.pivots)
                own = np.full(len(to), here)
                limit = np.minimum(cells.upper(to, k + 1), np.sqrt(kth[a:a + 256]))
                bound[a:a + 256] = np.square(limit) * (1 + SLACK) + SLACK
                low = cells.lower(to, own)
                open_ = low <= limit[:, None] * (1 + SLACK) + SLACK
                if cells.blocks[here] == 1:
                    open_[:, here] = False  # all of it is compared here
                for i in range(len(to)):
                    hit = np.flatnonzero(open_[i])
                    if probes is not None and len(hit) > probes:
                        hit = hit[np.argsort(low[i, hit] + 1e-6 * to[i, hit], kind="stable")[:probes]]
                    reach.append(hit.astype(np.int32))
            return pd.DataFrame({"uid": ids, "vec": pdf["vec"], "cell": pdf["cell"], "block": pdf["block"], "bound": bound, "reach": reach,
                                 "near": [bi[i][real[i]] for i in range(len(ids))], "dists": [bd[i][real[i]] for i in range(len(ids))]})

        schema = f"uid {self.kind}, vec array<double>, cell int, block int, bound double, reach array<int>, near array<{self.kind}>, dists array<double>"
        return checkpoint(self.points.select("uid", "vec", "cell", "block").groupBy("cell", "block").applyInPandas(own_block, schema))

    def computed_pairs(self, routes: DataFrame) -> int:
        """Distances that the plan computes: inside blocks, and from routed points to the blocks they reach."""
        inside = self.points.groupBy("cell", "block").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
        sizes = F.array(*[F.lit(int(c)) for c in self.cells.count])
        routed = routes.select(F.explode("reach").alias("c")).agg(F.sum(F.element_at(sizes, F.col("c") + 1).cast("long"))).first()[0] or 0
        return int(inside) + int(routed)

    def _found(self, routes: DataFrame, k: int) -> DataFrame:
        blocks = F.array(*[F.lit(int(b)) for b in self.cells.blocks])
        asked = routes.select("uid", "vec", "bound", F.col("cell").alias("own"), F.col("block").alias("own_block"), F.explode("reach").alias("cell"))
        load = {r[0]: r[1] for r in asked.groupBy("cell").count().collect()}  # one row per cell
        salts = np.array([max(1, -(-load.get(c, 0) // QUERY_ROWS)) for c in range(len(self.cells.pivots))])
        salt = F.array(*[F.lit(int(s)) for s in salts])
        at = F.col("cell") + 1
        ask = (asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(blocks, at) - 1)))
               .filter("cell <> own or block <> own_block")
               .select(F.col("uid").alias("qid"), F.col("vec").alias("qv"), "bound", "cell", "block",
                       F.pmod(F.xxhash64("uid"), F.element_at(salt, at).cast("long")).cast("int").alias("salt")))
        have = (self.points.select(F.col("uid").alias("pid"), F.col("vec").alias("pv"), "cell", "block",
                                   F.explode(F.sequence(F.lit(0), F.element_at(salt, at) - 1)).alias("salt")))

        def search(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            if q.empty or p.empty:
                return pd.DataFrame({"q_uid": [], "uid": [], "dist": []})
            top = _TopK(q["qid"].to_numpy(), k, False)
            top.add(_matrix(q["qv"]), p["pid"].to_numpy(), _matrix(p["pv"]))
            out = top.frame()
            bound = dict(zip(q["qid"], q["bound"]))
            return out[out["dist"].to_numpy() <= out["q_uid"].map(bound).to_numpy()]

        schema = f"q_uid {self.kind}, uid {self.kind}, dist double"
        return ask.groupBy("cell", "block", "salt").cogroup(have.groupBy("cell", "block", "salt")).applyInPandas(search, schema)

    def graph(self, k: int, probes: int | None = None, routes: DataFrame | None = None) -> DataFrame:
        """``q_uid, rank, uid, dist`` like ``vectors.knn_graph``: exact, or with ``probes`` the best of so many cells per point."""
        spark = self.all.sparkSession
        out = spark.createDataFrame([], f"q_uid {self.kind}, uid {self.kind}, dist double")
        if self.n:
            routes = routes if routes is not None else self.routes(k, probes)
            near = routes.select(F.col("uid").alias("q_uid"), F.explode(F.arrays_zip("near", "dists")).alias("x")).select("q_uid", F.col("x.near").alias("uid"), F.col("x.dists").alias("dist"))
            out = near.unionByName(self._found(routes, k))
        # points with a non-finite component are infinitely far from all: their neighbours are the smallest ids,
        # and they are neighbours only where finite points do not suffice
        inf = F.lit(float("inf"))
        first = checkpoint(self.all.select("uid").orderBy("uid").limit(k + 1))
        far = self.odd.select(F.col("uid").alias("q_uid")).join(F.broadcast(first)).filter("q_uid <> uid").select("q_uid", "uid", inf.alias("dist"))
        out = out.unionByName(far)
        if self.n <= k:
            last = checkpoint(self.odd.orderBy("uid").limit(k))
            out = out.unionByName(self.all.filter(is_finite(F.col("vec"))).select(F.col("uid").alias("q_uid")).join(F.broadcast(last)).select("q_uid", "uid", inf.alias("dist")))
        return _final_topk(out, k).select("q_uid", "rank", "uid", "dist")


def neighbour_graph(points: DataFrame, ks=(5, 10, 15, 20), id_col: str = "uid", vec_col: str = "vec",
                    cell_rows: int = CELL_ROWS, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """V9 with pruning: the rows of ``vectors.knn_graph``, exact. Points meet only the cells that may hold a neighbour;
    if that makes more copies of points than the block plan, the block plan is taken."""
    k = max(ks)
    placed = NeighbourCells(points, id_col, vec_col, cell_rows, max_pivots)
    if not placed.n:
        return placed.graph(k)
    routes = placed.routes(k)
    copies = routes.agg(F.sum(F.size("reach"))).first()[0] or 0
    plain = 2 * placed.n * _graph_blocks(placed.n, placed.dim)
    if copies > max(plain, COPIES * placed.n):
        return knn_blocks(points, points, k, False, id_col, vec_col)
    return placed.graph(k, routes=routes)


def recall(graph: DataFrame, points: DataFrame, k: int, sample: int = 100, id_col: str = "uid", vec_col: str = "vec") -> float:
    """Share of the exact ``k`` nearest neighbours of ``sample`` hash-chosen points that the graph has."""
    key = F.md5(F.concat(F.lit("recall:"), F.col(id_col).cast("string")))
    asked = checkpoint(points.orderBy(key, id_col).limit(sample).select(id_col, vec_col))
    exact = knn(asked, points, k, False, id_col, vec_col).select("q_uid", "uid")
    found = graph.filter(F.col("rank") < k).join(exact, ["q_uid", "uid"], "left_semi").count()
    return found / max(1, exact.count())


def approximate_graph(points: DataFrame, k: int, target: float = 0.9, id_col: str = "uid", vec_col: str = "vec",
                      cell_rows: int = CELL_ROWS, max_pivots: int = MAX_PIVOTS) -> tuple[DataFrame, float]:
    """V9 approximate: each point asks its nearest cells only, twice as many each time until the recall
    measured on sampled points reaches ``target``. Returns the graph and that recall; if all cells are asked, it is exact.
    Nothing is dropped from a cell, however many points it holds."""
    placed = NeighbourCells(points, id_col, vec_col, cell_rows, max_pivots)
    probes = 2
    while True:
        graph = checkpoint(placed.graph(k, probes if placed.n and probes < len(placed.cells.pivots) else None))
        got = recall(graph, points, k, id_col=id_col, vec_col=vec_col)
        if got >= target or not placed.n or probes >= len(placed.cells.pivots):
            return graph, got
        probes *= 2


# ------------------------------------------------------------- stored index

def build_index(points: DataFrame, path: str, id_col: str = "uid", vec_col: str = "vec", cell_rows: int = CELL_ROWS,
                max_pivots: int = MAX_PIVOTS) -> None:
    """Write an index: ``path/points`` partitioned by cell, ``path/centres`` with the pivots and
    ``path/cells`` with one row per cell and batch (number, radius, inner radius). Points with a non-finite component are not indexed."""
    finite = points.filter(is_finite(F.col(vec_col)))
    st = finite.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("d")).first()
    if not st["n"]:
        raise ValueError("build_index: no points")
    pivots = choose_pivots(finite, st["n"], st["d"], id_col, vec_col, cell_rows, max_pivots)
    spark = points.sparkSession
    (spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "cell int, pivot array<double>").coalesce(1)
     .write.mode("error").parquet(f"{path}/centres"))
    append_index(points, path, id_col, vec_col)


def read_pivots(spark: SparkSession, path: str) -> np.ndarray:
    return _matrix(r[0] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").select("pivot").collect())


def append_index(points: DataFrame, path: str, id_col: str = "uid", vec_col: str = "vec") -> None:
    """Add a batch of points to an index: the pivots stay, the cells' statistics get a row per batch.
    Statistics are written first: a cell may then seem larger than it is, never smaller."""
    spark = points.sparkSession
    placed = checkpoint(assign(points.filter(is_finite(F.col(vec_col))), read_pivots(spark, path), id_col, vec_col))
    stats = checkpoint(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"), F.min("away").alias("inner")))
    stats.coalesce(1).write.mode("append").parquet(f"{path}/cells")
    # a cell's folder gets a file per FILE_ROWS points: dealt by more than its size asks, a table becomes files of single points
    files = stats.select("cell", F.ceil(F.col("n") / FILE_ROWS).cast("long").alias("_f")).filter("_f > 1")
    many = dict(map(tuple, files.collect()))  # one row per large cell
    deal = F.lit(0).cast("long")
    if many:
        count = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])
        deal = F.pmod(F.xxhash64(id_col), F.coalesce(F.try_element_at(count, F.col("cell")), F.lit(1).cast("long")))
    (placed.select(F.col(id_col).alias("uid"), F.col(vec_col).alias("vec"), "cell").repartition("cell", deal)
     .write.mode("append").partitionBy("cell").parquet(f"{path}/points"))


def index_cells(spark: SparkSession, path: str) -> Cells:
    pivots = read_pivots(spark, path)
    count, radius, inner = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.full(len(pivots), np.inf)
    for r in spark.read.parquet(f"{path}/cells").groupBy("cell").agg(F.sum("n"), F.max("radius"), F.min("inner")).collect():
        count[r[0]], radius[r[0]], inner[r[0]] = r[1], r[2], r[3]
    return Cells(pivots, count, radius, np.where(count > 0, inner, 0.0))


def cell_rows_of(spark: SparkSession, path: str, cells: list[int]) -> DataFrame:
    """Points of some cells: only their folders are read (partition filter)."""
    return spark.read.parquet(f"{path}/points").filter(F.col("cell").isin([int(c) for c in cells]))


def search_index(queries: DataFrame, path: str, k: int, include_self: bool = True, id_col: str = "uid", vec_col: str = "vec") -> DataFrame:
    """V7/V8 on a stored index: the rows of ``vectors.knn``, exact, for a bounded set of queries with finite vectors.

    The cells nearest to each query that together hold enough points are read first; their k-th distances
    rule out most others, and only the cells that are left are read after.
    """
    spark = queries.sparkSession
    asked = checkpoint(queries.select(id_col, F.col(vec_col).cast("array<double>").alias(vec_col)))
    st = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("d")).first()
    if not st["n"]:
        raise ValueError("search_index: no queries")
    if st["n"] * st["d"] > MAX_QUERY_CELLS:
        raise ValueError("search_index: too many queries; use vectors.knn_blocks")
    q = asked.collect()
    x = _matrix(r[1] for r in q)
    if not np.isfinite(x).all():
        raise ValueError("search_index: a query has a non-finite component")
    cells = index_cells(spark, path)
    to = distances(x, cells.pivots)
    low = cells.lower(to, to.argmin(axis=1))
    order = np.argsort(np.where(cells.count > 0, to, np.inf), axis=1)
    have = np.cumsum(cells.count[order], axis=1)
    need = k + (0 if include_self else 1)
    first = sorted({int(c) for i in range(len(x)) for c in order[i, :int((have[i] < need).sum()) + 1] if cells.count[c]})
    one = checkpoint(knn(asked, cell_rows_of(spark, path, first), k, include_self, id_col, vec_col))
    worst = {r[0]: (r[1], r[2]) for r in one.groupBy("q_uid").agg(F.count(F.lit(1)), F.max("dist")).collect()}  # a row per query
    limit = np.array([np.sqrt(worst[r[0]][1]) if worst.get(r[0], (0, 0))[0] >= k else np.inf for r in q])
    limit = np.minimum(limit, cells.upper(to, need))
    more = sorted({int(c) for c in np.flatnonzero((low <= limit[:, None] * (1 + SLACK) + SLACK).any(axis=0)) if cells.count[c]} - set(first))
    found = one.select("q_uid", "uid", "dist")
    if more:
        found = found.unionByName(knn(asked, cell_rows_of(spark, path, more), k, include_self, id_col, vec_col).select("q_uid", "uid", "dist"))
    return _final_topk(found, k).select("q_uid", "rank", "uid", "dist")


# ------------------------------------------------------------- thresholded cosine (V3)

def cosine_pairs(df: DataFrame, threshold: float, id_col: str = "uid", vec_col: str = "vec", cell_rows: int = CELL_ROWS,
                 max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """V3 with a positive threshold: the rows of ``vectors.cosine_matrix(df, threshold)``. Unit vectors go to cells; each cell has a mean
    direction and an angular radius, and cells whose best possible cosine is under the threshold never meet.
    If that makes more copies of rows than the block plan of ``vectors.cosine_matrix``, the block plan is taken."""
    return _cosine(df, threshold, id_col, vec_col, cell_rows, max_pivots)[0]


def _cosine(df, threshold, id_col="uid", vec_col="vec", cell_rows=CELL_ROWS, max_pivots=MAX_PIVOTS) -> tuple[DataFrame, int, int]:
    """The pairs, the number of block pairs that meet, and of all block pairs."""
    if not threshold > 0:
        raise ValueError("cosine_pairs needs a threshold above 0; vectors.cosine_matrix takes any")
    rows = df.select(F.col(id_col).alias("k"), F.col(vec_col).cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.withColumn("norm", norm).filter("norm > 0 and norm < double('infinity')")  # a zero vector has cosine 0 with all
    unit = rows.select("k", "v", F.transform("v", lambda x: x / F.col("norm")).alias("u"))
    st = unit.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("u")).alias("d")).first()
    kind = df.schema[id_col].dataType.simpleString()
    if not st["n"]:
        return df.sparkSession.createDataFrame([], f"i {kind}, j {kind}, sim double"), 0, 0
    pivots = choose_pivots(unit, st["n"], st["d"], "k", "u", cell_rows, max_pivots)
    placed = checkpoint(assign(unit, pivots, "k", "u", ("v",)))
    cells = measure(placed, pivots)
    # direction of the pivot and the largest angle to it: |u - p|^2 = 1 + |p|^2 - 2 u.p
    size = np.linalg.norm(pivots, axis=1)
    ok = (size > 1e-12) & (cells.count > 0)
    lean = np.where(ok, (1 + size ** 2 - (cells.radius + SLACK) ** 2) / (2 * np.maximum(size, 1e-12)), -1.0)
    angle = np.arccos(np.clip(lean, -1, 1)) + SLACK
    unit_p = pivots / np.maximum(size, 1e-12)[:, None]
    apart = np.arccos(np.clip(unit_p @ unit_p.T, -1, 1))
    best = np.cos(np.clip(apart - angle[:, None] - angle[None, :], 0, np.pi))
    best[~ok, :] = best[:, ~ok] = 1.0
    meet = np.triu((best >= threshold - 1e-7) & (cells.count > 0)[:, None] & (cells.count > 0)[None, :])
    np.fill_diagonal(meet, cells.count > 0)
    # blocks in a row over all cells, numbered so that the left one of a pair has the smaller number
    rows_each = min(block_rows_for(st["d"]), BLOCK_ROWS)
    blocks = np.maximum(1, -(-cells.count // rows_each))
    base = np.append(0, np.cumsum(blocks))
    total, copies = int(blocks.sum()), int((cells.count * ((meet * blocks).sum(axis=1) + (meet * blocks[:, None]).sum(axis=0))).sum())
    plain = cells.count.sum() * (_blocks_for(st["n"], cosine_block_rows(st["d"])) + 1)
    if copies > max(plain, COPIES * int(cells.count.sum())):
        # bounds rule out too little: the block plan moves fewer copies and compares all
        return cosine_matrix(placed.select("k", "v"), threshold, "k", "v"), total * (total + 1) // 2, total * (total + 1) // 2
    partners = [[int(b) for c in np.flatnonzero(meet[a]) for b in range(base[c], base[c + 1])] for a in range(len(pivots))]
    back = [[int(b) for c in np.flatnonzero(meet[:, a]) for b in range(base[c], base[c + 1])] for a in range(len(pivots))]
    shared = df.sparkSession.sparkContext.broadcast((partners, back))

    @F.udf("array<int>")
    def right_of(cell, block):
        return [b for b in shared.value[0][cell] if b >= block]

    @F.udf("array<int>")
    def left_of(cell, block):
        return [b for b in shared.value[1][cell] if b <= block]

    starts, sizes = (F.array(*[F.lit(int(x)) for x in v]) for v in (base[:-1], blocks))
    at = F.col("cell") + 1
    block = (F.element_at(starts, at) + F.pmod(F.xxhash64("k"), F.element_at(sizes, at).cast("long"))).cast("int")
    placed = placed.withColumn("_b", block)
    left = placed.select(F.col("k").alias("lid"), F.col("v").alias("lv"), F.col("_b").alias("bi"), F.explode(right_of("cell", "_b")).alias("bj"))
    right = placed.select(F.col("k").alias("rid"), F.col("v").alias("rv"), F.col("_b").alias("bj"), F.explode(left_of("cell", "_b")).alias("bi"))
    met = sum(int(meet[a, c]) * (int(blocks[a]) * int(blocks[c]) if a != c else int(blocks[a]) * (int(blocks[a]) + 1) // 2)
              for a in range(len(pivots)) for c in range(a, len(pivots)))
    return block_cosines(left, right, threshold, kind), met, total * (total + 1) // 2
