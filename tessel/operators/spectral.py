"""V6: a 2-D map that follows the neighbour graph, by block power iteration on its normalised adjacency.

Edges are made symmetric, ``N = D^-1/2 W D^-1/2``, and the map is the second and third eigenvector of ``N``
(the first is ``D^1/2 1``, known beforehand and projected out; each component of a graph in several pieces counts
with an eigenvector of its own). Nodes are dealt by hash into blocks of at most about ``BLOCK_ROWS``, a block's numbers lie in one
matrix of ``BLOCK`` columns, and the edges that end in a block are packed once. A step is one job of a task a block, without a
shuffle: the task reads the matrices of all blocks one after the other, adds up what the edges bring from each and writes its own for the next
step. The matrices are files in the shared folder, and those of earlier steps are deleted: what a map has on disk is its edges and a few vectors,
however many steps it takes.
Between two orthogonalisations the block is multiplied by a Chebyshev polynomial of
``N`` that is small on the part of the spectrum below the block's smallest Ritz value, which takes a fraction of
the steps that powers of ``N`` would. Only ``BLOCK`` x ``BLOCK`` sums of each block reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, free_shuffles, shared_path
from .blockfiles import Folder

BLOCK = 16        # vectors iterated for the two that are wanted
BLOCK_ROWS = 1 << 16  # nodes of a block, about
SPREAD_BLOCKS = 16    # blocks a graph is spread over, where they get at least so many nodes
SPREAD_ROWS = 4096
DEGREE = 10       # steps between two orthogonalisations
ROUNDS = 30       # orthogonalisations at most
TOLERANCE = 1e-4
EDGES_AT_ONCE = 1 << 17  # edges whose rows are gathered at a time, about
LAYERS = 16       # edges of a node that are added one at a time, for all nodes at once


def adjacency(graph: DataFrame, k: int) -> DataFrame:
    """``src, dst``: an edge wherever one node is among the ``k`` nearest of the other, in both directions.
    An edge found from both sides counts once."""
    e = graph.filter(F.col("rank") < k).select(F.col("q_uid").alias("src"), F.col("uid").alias("dst")).filter("src <> dst")
    return checkpoint(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())


def _numbered(degree: DataFrame, blocks: int) -> DataFrame:
    """``uid, deg, block, at``: the hash of the id deals nodes, so that nodes with very many edges lie apart."""
    of = degree.withColumn("block", F.pmod(F.xxhash64(F.col("uid").cast("string")), F.lit(blocks)).cast("int"))
    return checkpoint(of.withColumn("at", F.row_number().over(Window.partitionBy("block").orderBy("uid")) - 1))


def _pack_edges(at: Folder) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The edges that end in a block, in order of the blocks they leave and of their ends: for each such block its number, how many
    nodes they end in and how many they are; then these nodes, the edges of each, and where they leave."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        block = int(rows["to_block"].iloc[0])
        source, to_at, leave = (rows[c].to_numpy(np.int32) for c in ("block", "to_at", "at"))
        order = np.lexsort((leave, to_at, source))
        source, to_at, leave = source[order], to_at[order], leave[order]
        cut = np.append(np.flatnonzero(np.diff(source, prepend=-1)), len(source))
        head, parts = [], []
        for a, b in zip(cut[:-1], cut[1:]):
            new = np.flatnonzero(np.diff(to_at[a:b], prepend=-1))
            head += [source[a], len(new), b - a]
            parts += [to_at[a:b][new], np.diff(np.append(new, b - a)).astype(np.int32), leave[a:b]]
        at.write(f"edges-{block}", np.array([len(cut) - 1, *head], np.int64), *parts)
        return pd.DataFrame({"block": [block]})
    return run


def _pack_nodes(at: Folder) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, block = rows.sort_values("at"), int(rows["block"].iloc[0])
        at.write(f"root-{block}", np.sqrt(rows["deg"].to_numpy(float)))
        at.write(f"x0-{block}", np.array([np.asarray(v) for v in rows["x"]]))
        return pd.DataFrame({"block": [block]})
    return run


def _root(at: Folder, block: int) -> np.ndarray:
    return np.frombuffer(at.read(f"root-{block}"))


def _matrix(at: Folder, name: str, block: int) -> np.ndarray:
    return np.frombuffer(at.read(f"{name}-{block}")).reshape(-1, BLOCK)


def _carried(y: np.ndarray, leave: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each end the sum of its rows of ``y``: ``size`` numbers of ``leave`` from ``begin``. Most have few."""
    sums = y.take(leave[begin], 0)
    more, n = np.flatnonzero(size > 1), 1
    while len(more) and n < LAYERS:
        sums[more] += y.take(leave[begin[more] + n], 0)
        n += 1
        more = more[size[more] > n]
    if len(more):
        left = size[more].astype(np.int64) - n
        first = np.cumsum(left) - left
        sums[more] += np.add.reduceat(y.take(leave[np.arange(left.sum()) + np.repeat(begin[more] + n - first, left)], 0), first, axis=0)
    return sums


def _product(at: Folder, name: str, block: int) -> np.ndarray:
    """``N`` times the matrix ``name``, the rows of a block; sums are added in order of the blocks they come from."""
    packed, root = at.read(f"edges-{block}"), _root(at, block)
    v = np.zeros((len(root), BLOCK))
    n = int(np.frombuffer(packed, np.int64, 1)[0])
    head = np.frombuffer(packed, np.int64, 3 * n, 8).reshape(n, 3)
    here = 8 + 24 * n
    for source, n_ends, n_edges in head.tolist():
        ends, size, leave = (np.frombuffer(packed, np.int32, many, here + 4 * before) for many, before in ((n_ends, 0), (n_ends, n_ends), (n_edges, 2 * n_ends)))
        here += 4 * (2 * n_ends + n_edges)
        y = _matrix(at, name, source) / _root(at, source)[:, None]
        begin = np.append(0, np.cumsum(size, dtype=np.int64))  # one more than ends
        i = 0
        while i < n_ends:  # whole ends, so that a node's sum from a block is one sum
            j = max(i + 1, int(np.searchsorted(begin, begin[i] + EDGES_AT_ONCE, "right")) - 1)
            v[ends[i:j]] += _carried(y, leave, begin[i:j], size[i:j])
            i = j
    return v / root[:, None]


def _turned(at: Folder, step: int, along: np.ndarray, turn: np.ndarray, mid: float, half: float) -> Callable[[int], bytes]:
    """The kept block without ``root``, times ``turn``, and one step of the polynomial: its product with ``N`` is known."""
    def run(block: int) -> bytes:
        less = np.outer(_root(at, block), along)
        x, v = ((_matrix(at, name, block) - less) @ turn for name in (f"x{step}", f"v{step}"))
        at.write(f"x{step + 1}-{block}", x)
        at.write(f"x{step + 2}-{block}", (v - mid * x) / half)
        return b""
    return run


def _next(at: Folder, step: int, mid: float, half: float) -> Callable[[int], bytes]:
    """A later step: Chebyshev recurrence."""
    def run(block: int) -> bytes:
        v = _product(at, f"x{step}", block)
        at.write(f"x{step + 1}-{block}", 2 * ((v - mid * _matrix(at, f"x{step}", block)) / half) - _matrix(at, f"x{step - 1}", block))
        return b""
    return run


def _last(at: Folder, step: int) -> Callable[[int], bytes]:
    """``N`` times the block is kept beside it; ``x'x``, ``x'v``, ``v'v`` and ``root'x`` of its nodes."""
    def run(block: int) -> bytes:
        x, v = _matrix(at, f"x{step}", block), _product(at, f"x{step}", block)
        at.write(f"v{step}-{block}", v)
        return np.concatenate([(x.T @ x).ravel(), (x.T @ v).ravel(), (v.T @ v).ravel(), _root(at, block) @ x]).tobytes()
    return run


def _each(blocks: DataFrame, run: Callable[[int], bytes]) -> DataFrame:
    """``block, sums``: what ``run`` gives for each block."""
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block in pdf["block"].tolist():
                yield pd.DataFrame({"block": [block], "sums": [run(block)]})

    return blocks.mapInPandas(part, "block int, sums binary")


def _rows(blocks: DataFrame, at: Folder, step: int, along: np.ndarray, turn: np.ndarray) -> DataFrame:
    """``block, at, x, y``: the first two vectors of the block without ``root``, times ``turn``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block in pdf["block"].tolist():
                two = ((_matrix(at, f"x{step}", block) - np.outer(_root(at, block), along)) @ turn)[:, :2]
                yield pd.DataFrame({"block": block, "at": np.arange(len(two)), "x": two[:, 0], "y": two[:, 1]})

    return blocks.mapInPandas(run, "block int, at int, x double, y double")


def spectral_map(graph: DataFrame, k: int, rounds: int = ROUNDS, tolerance: float = TOLERANCE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``uid, x, y, value_x, value_y, residual`` for the nodes of a neighbour graph (``q_uid, rank, uid``) cut at ``k``.

    ``x`` and ``y`` have unit length over all nodes; of each, the entry of largest size (the smallest id among equals) is
    positive. ``value_*`` are the eigenvalues; ``residual`` is the larger norm of ``N v - value v``,
    the convergence figure: at most ``tolerance`` unless ``rounds`` ended first. Equal eigenvalues have any orthogonal vectors of their space.
    A graph of fewer than three nodes has no map (no rows). Any id type; graphs without an edge give no rows.
    """
    both = adjacency(graph, k)
    free_shuffles(graph.sparkSession)
    degree = both.groupBy(F.col("src").alias("uid")).agg(F.count(F.lit(1)).alias("deg"))
    n, total = degree.agg(F.count(F.lit(1)), F.sum("deg").cast("double")).first()  # the squared norm of ``root``
    kind = both.schema["src"].dataType.simpleString()
    if n < 3:
        return graph.sparkSession.createDataFrame([], f"uid {kind}, x double, y double, value_x double, value_y double, residual double")
    blocks = max(-(-n // block_rows), min(SPREAD_BLOCKS, -(-n // SPREAD_ROWS)))
    at = Folder(shared_path(graph.sparkSession, "map")).create()
    try:
        return _iterated(at, both, _numbered(degree, blocks), blocks, total, rounds, tolerance)
    finally:
        at.delete()


def _iterated(at: Folder, both: DataFrame, nodes: DataFrame, blocks: int, total: float, rounds: int, tolerance: float) -> DataFrame:
    leave = nodes.select(F.col("uid").alias("src"), "block", "at")
    enter = nodes.select(F.col("uid").alias("dst"), F.col("block").alias("to_block"), F.col("at").alias("to_at"))
    both.join(leave, "src").join(enter, "dst").select("block", "at", "to_block", "to_at").groupBy("to_block") \
        .applyInPandas(_pack_edges(at), "block int").collect()
    start = F.array(*[F.pmod(F.xxhash64(F.lit(i), F.col("uid").cast("string")), F.lit(1 << 20)) / float(1 << 19) - 1.0 for i in range(BLOCK)])
    nodes.withColumn("x", start).select("block", "at", "deg", "x").groupBy("block").applyInPandas(_pack_nodes(at), "block int").collect()
    free_shuffles(nodes.sparkSession)  # of the edges; the steps make none
    every = nodes.sparkSession.range(0, blocks, 1, blocks).select(F.col("id").cast("int").alias("block"))
    full = [r["block"] for r in nodes.select("block").distinct().collect()]  # a block may have got no node
    every = every.filter(F.col("block").isin(full)) if len(full) < blocks else every

    def over(step: int, *kinds: str) -> None:
        at.delete([f"{kind}{step}-{b}" for kind in kinds for b in full])

    along, turn, low, now = np.zeros(BLOCK), np.eye(BLOCK), 0.0, 0
    for step in range(rounds):
        # Chebyshev recurrence on [-1, low], which it damps
        mid, half = (low - 1) / 2, (low + 1) / 2
        if step:
            _each(every, _turned(at, now, along, turn, mid, half)).collect()
            over(now, "x", "v")
            now += 2
        for _ in range(DEGREE - 1 if step else 0):
            _each(every, _next(at, now, mid, half)).collect()
            over(now - 1, "x")
            now += 1
        sums = checkpoint(_each(every, _last(at, now))).collect()
        over(now - 1, "x")
        flat = np.sum([np.frombuffer(r["sums"]) for r in sorted(sums, key=lambda r: r["block"])], axis=0)
        (gram, ritz, square), at_root = flat[:-BLOCK].reshape(3, BLOCK, BLOCK), flat[-BLOCK:]
        # without the known eigenvector: N times it is itself, so one correction serves all three
        along = at_root / total
        gram, ritz, square = (m - total * np.outer(along, along) for m in (gram, ritz, square))
        # orthonormal block, Ritz values and vectors
        size = np.sqrt(np.maximum(np.diag(gram), 1e-300))
        e, u = np.linalg.eigh(gram / np.outer(size, size))
        keep = e > e.max() * 1e-12
        basis = np.zeros((BLOCK, BLOCK))
        basis[:, :keep.sum()] = (u[:, keep] / np.sqrt(e[keep])) / size[:, None]
        ritz, square = basis.T @ ritz @ basis, basis.T @ square @ basis
        r = int(keep.sum())
        values, turn = np.linalg.eigh((ritz[:r, :r] + ritz[:r, :r].T) / 2)
        order = np.argsort(-values)
        values, turn = values[order], np.pad(turn[:, order], ((0, BLOCK - r), (0, BLOCK - r)))
        # |N v - value v|^2 = v'N'N v - value^2 for unit v
        spread = np.einsum("ij,ik,kj->j", turn, square, turn)[:r] - values ** 2
        residual = float(np.sqrt(max(0.0, spread[:2].max()))) if r >= 2 else float("inf")
        low = min(float(values[-1]), float(values[min(2, r - 1)]) - 1e-9)
        low = max(low, -0.9)
        turn = basis @ turn
        if residual <= tolerance or r < 2:
            break
    found = checkpoint(_rows(every, at, now, along, turn).join(nodes, ["block", "at"]).select("uid", "x", "y"))
    # among equal sizes the smallest id decides
    big = found.agg(*[F.max(F.round(F.abs(c), 9)).alias(c) for c in ("x", "y")]).first()
    sign = [found.filter(F.round(F.abs(c), 9) == F.lit(big[c])).orderBy("uid").select(F.signum(c)).first()[0] for c in ("x", "y")]
    second = float(values[1]) if r > 1 else float("nan")
    return found.select("uid", (F.col("x") * sign[0]).alias("x"), (F.col("y") * sign[1]).alias("y"),
                        F.lit(float(values[0])).alias("value_x"), F.lit(second).alias("value_y"), F.lit(residual).alias("residual"))
