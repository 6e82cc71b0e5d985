"""Whitening of embedding vectors by pivoted Cholesky and one-sided Jacobi.

The centred scatter of the distinct vectors is summed by Spark in whole numbers:
components are integers ``x``, so ``x - c`` with ``c`` the integer next to the
mean is exact, products of it add up without rounding, and the rest of the
centring (``S/n - c``, below one half) is taken off in whole numbers, too. Every
entry of the covariance is therefore rounded once, whatever the partitioning.
The driver holds ``width**2`` numbers: pivoted Cholesky gives the triangular factor
``L`` with ``V = L L'``, one-sided Jacobi rotates the columns of ``L`` until they
are orthogonal, and then the squared column norms are the eigenvalues of ``V`` and
the normalised columns its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, stored

SCALE = 256.0
COMPONENTS = 4
SAFE = 1 << 53           # whole numbers up to here are exact in float64
LONG = (1 << 63) - 1
ROWS = 4_096             # vectors multiplied at once in a task
RANK = 1e-13             # pivots below this share of the largest end the factor


def quantised(vectors: DataFrame, scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, x`` (array<long>): each component ``floor(scale * c) + 0`` with ``c`` as double.

    Vectors null or holding null or non-finite components are left out, and so are those with
    an ``x`` that no long holds. Rows without an id and repeated rows stay.
    """
    c = F.col(f"`{vec_col}`").cast("array<double>")
    y = F.transform(c, lambda v: F.lit(scale) * v)
    fits = F.forall(y, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float(1 << 61))))
    return (vectors.filter(c.isNotNull() & fits)
            .select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(y, lambda v: F.floor(v).cast("long")).alias("x")))


def _rows(col: pa.Array, width: int) -> np.ndarray:
    """Lists of longs as an int64 matrix; a shorter list is filled up with zeros."""
    off = np.diff(col.offsets.to_numpy())
    flat = col.values.to_numpy(zero_copy_only=False)[col.offsets[0].as_py():col.offsets[-1].as_py()] if len(col) else np.zeros(0, np.int64)
    if len(off) and (off == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(off), width), np.int64)
    out[np.arange(width) < off[:, None]] = flat
    return out


def _sums(x: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each component; the driver gets ``width`` rows."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros(width, object)
        for b in batches:
            m = _rows(b.column(0), width)
            n += len(m)
            if len(m):
                s = s + (m.sum(axis=0) if abs(m).max() < (1 << 62) // len(m) else m.astype(object).sum(axis=0))
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(width + 1), pa.int32()),
                                              "s": pa.array([str(v) for v in [*s, n]], pa.string())})

    got = {r["i"]: int(r["s"]) for r in x.mapInArrow(part, "i int, s string").groupBy("i")
           .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return got[width], [got[i] for i in range(width)]


def _scatter(x: DataFrame, width: int, centre: np.ndarray) -> list[list[int]]:
    """Exact ``sum (x - c)(x - c)'``: whole numbers, added up by Spark cell by cell."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), object)
        for b in batches:
            m = _rows(b.column(0), width)
            for k in range(0, len(m), ROWS):
                y = m[k:k + ROWS]
                top = int(abs(y).max()) + int(abs(centre).max())
                if top * top * len(y) < SAFE:
                    z = (y - centre).astype(np.float64)
                    total += (z.T @ z).astype(np.int64)  # every partial sum is a whole number below 2**53
                else:
                    z = y.astype(object) - centre.astype(object)
                    total += z.T @ z
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
                                          "s": pa.array([str(v) for v in total[i, j]], pa.string())})

    out = [[0] * width for _ in range(width)]
    for r in (x.mapInArrow(part, "i int, j int, s string").groupBy("i", "j")
              .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()):
        out[r["i"]][r["j"]] = out[r["j"]][r["i"]] = int(r["s"])
    return out


def covariance(n: int, sums: list[int], centre: list[int], scatter: list[list[int]]) -> np.ndarray:
    """Divisor ``n``; each entry rounded once from ``(n * M - d d') / n**2``, ``d = S - n * c``."""
    d = [s - n * c for s, c in zip(sums, centre)]
    out = np.zeros((len(d), len(d)))
    for i in range(len(d)):
        for j in range(i + 1):
            out[i, j] = out[j, i] = float(Fraction(n * scatter[i][j] - d[i] * d[j], n * n))
    return out


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """``L`` (rows in the order of ``v``) with ``v = L L'``: the largest remaining diagonal
    entry is the next pivot; columns end where nothing but rounding is left."""
    a, width = v.copy(), len(v)
    cols: list[np.ndarray] = []
    first = a.diagonal().max() if width else 0.0
    free = np.ones(width, bool)
    while free.any():
        p = int(np.argmax(np.where(free, a.diagonal(), -np.inf)))
        if not a[p, p] > first * RANK:
            break
        c = np.where(free, a[:, p], 0.0) / np.sqrt(a[p, p])
        cols.append(c)
        a -= np.outer(c, c)
        free[p] = False
    return np.stack(cols, axis=1) if cols else np.zeros((width, 0))


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms and normalised columns of ``factor`` after rotations that make its columns
    orthogonal, by falling norm: eigenvalues and eigenvectors of ``factor factor'``.

    A sweep takes every pair of columns once, in rounds of disjoint pairs that are rotated together.
    """
    a = factor.copy()
    r = a.shape[1]
    if r > 1:
        size = r + r % 2
        ring = np.arange(size)
        for _ in range(sweeps):
            worst = 0.0
            for _ in range(size - 1):
                p, q = ring[:size // 2], ring[size // 2:][::-1]
                real = (p < r) & (q < r)
                p, q = p[real], q[real]
                x, y = a[:, p], a[:, q]
                aa, bb, ab = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
                size_ab = np.sqrt(aa * bb)
                cos = np.divide(abs(ab), size_ab, out=np.zeros_like(ab), where=size_ab > 0)
                worst = max(worst, float(cos.max(initial=0.0)))
                go = cos > 1e-16
                zeta = np.divide(bb - aa, 2 * ab, out=np.zeros_like(ab), where=go)
                t = np.where(zeta >= 0, 1.0, -1.0) / (abs(zeta) + np.sqrt(1 + zeta * zeta))
                t = np.where(go, t, 0.0)
                c = 1 / np.sqrt(1 + t * t)
                s = c * t
                a[:, p], a[:, q] = c * x - s * y, s * x + c * y
                ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
            if worst < 1e-15:
                break
    e = (a * a).sum(axis=0)
    order = np.argsort(-e, kind="stable")
    e, a = e[order], a[:, order]
    u = a / np.sqrt(e)
    if r:  # a sign that does not depend on the rotations
        lead = u[np.argmax(abs(u), axis=0), np.arange(r)]
        u = u * np.where(lead < 0, -1.0, 1.0)
    return e, u


class Model:
    """``n``, exact sums, covariance and the leading components of a set of distinct vectors."""

    def __init__(self, n: int, sums: list[int], cov: np.ndarray, components: int):
        self.n, self.sums, self.cov = n, sums, cov
        e, u = one_sided_jacobi(pivoted_cholesky(cov))
        self.trace = float(cov.trace())
        self.values, self.vectors = e[:components], u[:, :components]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """``x - S/n`` projected on each component, over the root of its eigenvalue."""
        mean = np.array([s // self.n for s in self.sums])  # whole part first, so that the difference keeps its digits
        rest = np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])
        return ((x - mean).astype(np.float64) - rest) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of ``(n * x - S)**2`` over the components; none where a long does not hold it."""
        top = self.n * int(abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if top * top * max(1, x.shape[1]) <= LONG:
            y = self.n * x - np.array(self.sums, np.int64)
            return (y * y).sum(axis=1).tolist()
        y = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v <= LONG else None for v in (y * y).sum(axis=1).tolist()]


def fit(x: DataFrame, width: int, components: int = COMPONENTS) -> Model:
    """The model of distinct vectors in a column ``x`` (array<long>)."""
    n, sums = _sums(x, width)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    return Model(n, sums, covariance(n, sums, centre, _scatter(x, width, np.array(centre, np.int64))), components)


def identity_error(x: DataFrame, width: int, model: Model) -> float:
    """Largest absolute entry of (covariance of the whitened vectors - identity), measured over the vectors."""
    k = len(model.values)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, m = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:  # means and squares of the parts join as in a pairwise variance
            z = model.whiten(_rows(b.column(0), width))
            if not len(z):
                continue
            mean = z.mean(axis=0)
            y, gap, total = z - mean, mean - s, n + len(z)
            m += y.T @ y + np.outer(gap, gap) * (n * len(z) / total)
            s, n = s + gap * (len(z) / total), total
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "s": pa.array([s.tolist()], pa.list_(pa.float64())),
                                              "m": pa.array([m.ravel().tolist()], pa.list_(pa.float64()))})

    parts = x.mapInArrow(part, "n long, s array<double>, m array<double>")
    total = parts.agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col("s")[i]).alias(f"s{i}") for i in range(k)]).first()
    mean = [total[f"s{i}"] / total["n"] for i in range(k)]
    cells = parts.agg(*[F.sum(F.col("m")[i * k + j] + F.col("n") * (F.col("s")[i] - mean[i]) * (F.col("s")[j] - mean[j]))
                        .alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
    return max(abs(cells[f"m{i}_{j}"] / total["n"] - (i == j)) for i in range(k) for j in range(k))


COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: float = SCALE,
             id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector and component: ``vec_id, component`` (from 1 by falling eigenvalue), ``n``
    (distinct vectors), ``deviation``, ``whitened``, ``explained`` (share of the trace), ``identity_error``.

    Vectors null or with null, non-finite or unstorable components are left out; rows without an id and repeated rows
    each have their rows, with equal values; they count once in the model. Shorter vectors count as filled up with
    zeros. A component without variance cannot be whitened, so vectors that span fewer directions than
    ``components`` have fewer rows; one distinct vector or an empty table gives none. Equal eigenvalues
    have any orthogonal components of their space. Extra columns are not read. Driver: ``width**2`` numbers.
    """
    spark = bounded_batches(vectors).sparkSession
    rows = stored(quantised(vectors, scale, id_col, vec_col), "quantised")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        return spark.createDataFrame([], COLUMNS)
    pad = F.when(F.size("x") < width, F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))).otherwise(F.col("x"))
    once = stored(rows.select(pad.alias("x")).distinct(), "distinct")  # equal vectors meet before and after the shuffle
    model = fit(once, width, components)
    if not len(model.values):
        return spark.createDataFrame([], COLUMNS)
    error = identity_error(once, width, model)
    k, share = len(model.values), (model.values / model.trace).tolist()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rows(b.column("x"), width)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.full(len(x) * k, model.n), pa.int64()), pa.array(model.deviation(x), pa.int64()).take(at),
                pa.array(model.whiten(x).ravel(), pa.float64()), pa.array(np.tile(share, len(x)), pa.float64()),
                pa.array(np.full(len(x) * k, error), pa.float64())], names=[c.split()[0] for c in COLUMNS.split(", ")])

    return rows.mapInArrow(project, COLUMNS)
