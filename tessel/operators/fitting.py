"""M12 with M10 and M11: a mini-batch fit of the pair classifier that keeps a log.

Rows are put in mini-batches (E4) in a seeded random order (R3) and written by batch, packed into matrices of up to
``PACKED_BYTES``, so a step reads the folder of its batch only and no row by itself. A step is one job: each task adds up the gradient of its rows, Spark adds up the tasks'
sums cell by cell, and the driver moves ``classes x (width + 1)`` weights. Every ``eval_steps`` steps the loss over the validation
rows goes into the log; after ``patience`` evaluations in a row without a new best the fit stops, and the weights of the
best evaluation are the model's. Epochs take the batches in an order of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path
from .encode import assign_batches
from .sampling import hash_key

MAX_BATCHES = 10_000  # folders of a run
PACKED_BYTES = 4 << 20  # features of a packed row
DEAL_BYTES = 128 << 20  # features of a partition that is put in order


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """Summed gradient of the cross-entropy at weights ``w`` (classes x (width + 1), the last for the bias), and the summed loss."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    p = softmax(x1 @ w.T)
    loss = float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum())
    p[np.arange(len(y)), y] -= 1
    return p.T @ x1, loss


def batch_order(batches: int, seed: int, epoch: int) -> list[int]:
    """The batches of an epoch in hash order."""
    return sorted(range(batches), key=lambda b: hashlib.md5(f"{seed}:{epoch}:{b}".encode()).hexdigest())


class Fitted:
    """Weights of the best evaluation, the log as rows ``(step, eval_loss)``, and where the fit stopped."""

    def __init__(self, weights: np.ndarray, log: list[tuple[int, float]], best_step: int, stop_step: int, stopped: bool):
        self.weights, self.rows, self.best_step, self.stop_step, self.stopped = weights, log, best_step, stop_step, stopped

    def log(self, spark, run_id: int = 0) -> DataFrame:
        """``run_id, step, eval_loss``: the input of ``best_checkpoint`` and ``early_stop``."""
        return spark.createDataFrame([(run_id, s, x) for s, x in self.rows], "run_id long, step long, eval_loss double")

    def predict(self, df: DataFrame, features: str = "features", out: str = "probs") -> DataFrame:
        """The rows with a distribution over the classes."""
        w = self.weights

        @F.pandas_udf("array<double>")
        def probs(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            m = np.array([np.asarray(v, dtype=float) for v in x])
            return pd.Series(list(softmax(m @ w[:, :-1].T + w[:, -1])))

        return df.withColumn(out, probs(features))


def _matrix(lists: pa.Array) -> np.ndarray:
    """The rows of a list column as a matrix; they are equally long."""
    size = np.unique(np.diff(lists.offsets.to_numpy()))
    if len(size) != 1 or lists.null_count:
        raise ValueError(f"fit_with_log: features of {', '.join(map(str, size))} numbers, {lists.null_count} without")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(lists), -1)


def _packed(df: DataFrame) -> DataFrame:
    """``batch, features, label`` with many rows in one: their numbers as bytes. Rows of a batch that follow each other stay together."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            if rows.column("label").null_count:
                raise ValueError("fit_with_log: rows without a label")
            batch, label = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("batch", "label"))
            x = _matrix(rows.column("features"))
            most = max(1, PACKED_BYTES // (8 * max(1, x.shape[1])))
            cut = np.append(np.flatnonzero(np.diff(batch, prepend=batch[0] - 1)), len(batch))
            parts = [slice(i, min(i + most, hi)) for lo, hi in zip(cut[:-1], cut[1:]) for i in range(lo, hi, most)]
            for p in parts:
                yield pa.RecordBatch.from_arrays([pa.array(batch[p][:1], pa.int64()), pa.array([x[p].tobytes()], pa.binary()),
                                                  pa.array([label[p].astype(np.int32).tobytes()], pa.binary())], ["batch", "features", "label"])

    return df.select("batch", "features", "label").mapInArrow(pack, "batch long, features binary, label binary")


def _sums(df: DataFrame, w: np.ndarray, with_gradient: bool) -> tuple[np.ndarray | None, float, int]:
    """Gradient, loss and number of rows of a packed frame ``features, label``."""
    shape = w.shape

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, loss, n = np.zeros(shape), 0.0, 0
        for pdf in batches:
            for features, label in zip(pdf["features"], pdf["label"]):
                y = np.frombuffer(label, np.int32)
                dg, dl = gradient(np.frombuffer(features).reshape(len(y), -1), y, w)
                g, loss, n = g + dg, loss + dl, n + len(y)
        if n:
            cells = g.ravel() if with_gradient else np.zeros(0)
            yield pd.DataFrame({"i": np.arange(-2, len(cells)), "s": np.concatenate([[float(n), loss], cells])})

    got = df.select("features", "label").mapInPandas(part, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).toPandas().sort_values("i")
    if not len(got):
        return None, 0.0, 0
    s = got["s"].to_numpy()
    return (s[2:].reshape(shape) if with_gradient else None), float(s[1]), int(s[0])


def fit_with_log(train: DataFrame, valid: DataFrame, key: str = "pair_id", features: str = "features", label: str = "label",
                 classes: int = 3, batch_size: int = 64, epochs: int = 10, eval_steps: int = 100, patience: int = 3,
                 rate: float = 1.0, seed: int = 123) -> Fitted:
    """Fit on ``train``, evaluate on ``valid``; ``features`` is an array<double> column.

    The step size falls with the root of the step's number. The last step is evaluated, too. Without training or
    validation rows a ValueError is raised; so for more than ``MAX_BATCHES`` batches: take a larger ``batch_size``.
    """
    spark = train.sparkSession
    rows = train.select(F.col(key).alias("k"), F.col(features).alias("features"), F.col(label).cast("int").alias("label"))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    batches = -(-n // batch_size)
    if not n or batches > MAX_BATCHES:
        raise ValueError(f"fit_with_log: {n} rows make {batches} batches of {batch_size} (1 to {MAX_BATCHES} are possible)")
    # by the rows there are: what the optimizer believes of joined or checkpointed rows may be far too much
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * 8 * width // DEAL_BYTES))
    path = shared_path(spark, "batches")
    dealt = assign_batches(rows.withColumn("o", hash_key(seed, F.col("k"))), batch_size, ["o", "k"], partitions=partitions)
    _packed(dealt).write.partitionBy("batch").parquet(path)
    held = shared_path(spark, "held")
    _packed(valid.select(F.lit(0).cast("long").alias("batch"), F.col(features).alias("features"), F.col(label).cast("int").alias("label"))).drop("batch").write.parquet(held)
    data, held_out = (spark.read.schema("features binary, label binary" + of).parquet(p) for p, of in ((path, ", batch long"), (held, "")))
    w = np.zeros((classes, width + 1))
    log: list[tuple[int, float]] = []
    best, best_w, best_step, step, last = float("inf"), w, 0, 0, epochs * batches
    for epoch in range(epochs):
        for b in batch_order(batches, seed, epoch):
            g, _, m = _sums(data.filter(F.col("batch") == b), w, True)  # one folder
            step += 1
            w = w - rate / np.sqrt(step) * g / m
            if step % eval_steps and step != last:
                continue
            _, loss, m = _sums(held_out, w, False)
            if not m:
                raise ValueError("fit_with_log: no validation rows")
            log.append((step, loss / m))
            if loss / m < best:
                best, best_w, best_step = loss / m, w, step
            seen = [x for _, x in log]
            if len(seen) > patience and min(seen[-patience:]) >= min(seen[:-patience]):
                return Fitted(best_w, log, best_step, step, True)
    return Fitted(best_w, log, best_step, step, False)
