"""Quality scores: logistic regression over hashed word n-grams, learnt with
follow-the-regularised-leader updates, applied as sparse dot products.

Features of a text are hashed n-grams of two word streams: the lower-cased words
(one and two words) and the words' shapes (one to three): capitals, digits,
signs, last sign, whether the word repeats the one before it. A feature's value is
its count over the number of words, so the score does not depend on length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import training
from .store import bounded_batches, stored
from .words import Words, mix, slices

BITS = 18          # feature table of 2**18 weights
SCALE = 8.0        # value of a feature that stands at every word
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5  # follow-the-regularised-leader constants
EPOCHS = 4
THRESHOLD = 0.7

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = True
_SIGN &= ~(_UPPER | _LOWER | _DIGIT)


def _count(flag: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    s = np.zeros(len(flag) + 1, np.int32)
    np.cumsum(flag, out=s[1:])
    return s[end] - s[start]


def features(col: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, a row per n-gram stream (-1: none) and a column per word, and word offsets of the texts."""
    raw, low = Words(col), Words(col, lower=True)
    h, n = low.hashes(), len(low)
    size = raw.end - raw.start
    up, lo, dg, sg = (_count(t[raw.data], raw.start, raw.end) for t in (_UPPER, _LOWER, _DIGIT, _SIGN))
    new = np.zeros(n, bool)
    new[raw.first[:-1][raw.first[:-1] < n]] = True  # first word of a text
    same = np.zeros(n, bool)
    if n:
        same[1:] = h[1:] == h[:-1]
        same &= ~new
    last = np.where(sg > 0, raw.data[raw.end - 1] if n else 0, 0).astype(np.uint64)
    last = np.where(_SIGN[last.astype(np.uint8)], last, 0).astype(np.uint64)
    shape = (np.minimum(up, 2) + 3 * np.minimum(lo, 1) + 6 * np.minimum(dg, 2) + 18 * np.minimum(sg, 4)
             + 90 * (sg == size) + 180 * same + 360 * np.minimum(size // 6, 4)).astype(np.uint64)
    shape = mix(shape * np.uint64(256) + last + np.uint64(1))
    out = np.full((5, n), -1, np.int64)
    mask = np.uint64((1 << bits) - 1)

    def back(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Values k words earlier, and where they belong to the same text."""
        at = np.arange(n) - k
        begin = np.repeat(raw.first[:-1], raw.counts())
        ok = at >= begin
        return x[np.maximum(at, 0)], ok

    out[0] = mix(h ^ np.uint64(0x11)) & mask
    prev, ok = back(h, 1)
    out[1][ok] = (mix(h + mix(prev) * np.uint64(3)) & mask)[ok]
    out[2] = mix(shape ^ np.uint64(0x22)) & mask
    s1, ok1 = back(shape, 1)
    two = mix(shape + mix(s1) * np.uint64(5))
    out[3][ok1] = (two & mask)[ok1]
    s2, ok2 = back(shape, 2)
    out[4][ok2] = (mix(two + mix(s2) * np.uint64(7)) & mask)[ok2]
    return out, raw.first


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights from the leader's state: zero inside the L1 ball."""
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, w)


def _train(state: training.State, rows: pd.DataFrame) -> training.State:
    """One pass of per-coordinate FTRL-proximal over the rows; coordinate ``2**BITS`` is the bias."""
    z, n = state["z"].astype(np.float64), state["n"].astype(np.float64)
    for idx, val, y in zip(rows["idx"], rows["val"], rows["y"]):
        i, x = np.asarray(idx), np.asarray(val, np.float64)
        w = weights(z[i], n[i])
        g = (training.sigmoid(np.array([w @ x]))[0] - y) * x
        sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
        z[i] += g - sigma * w
        n[i] += g * g
    return {"z": z.astype(np.float32), "n": n.astype(np.float32)}


def fit(sample: DataFrame, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (bias last) learnt from ``id, text, y`` rows."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            f, first = features(b.column("text"), bits)
            idx, val = [], []
            for d in range(b.num_rows):
                a, e = first[d], first[d + 1]
                own = f[:, a:e].ravel()
                k, c = np.unique(own[own >= 0], return_counts=True)
                idx.append(np.append(k, 1 << bits).astype(np.int32))
                val.append(np.append(c * (SCALE / max(1, e - a)), 1.0).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(idx, pa.list_(pa.int32())),
                                              pa.array(val, pa.list_(pa.float32()))], names=["id", "y", "idx", "val"])

    table = stored(bounded_batches(sample).mapInArrow(rows, "id long, y int, idx array<int>, val array<float>"), "quality-sample")
    size = (1 << bits) + 1
    state = training.mix_epochs(table, {"z": np.zeros(size, np.float32), "n": np.zeros(size, np.float32)}, _train, epochs)
    return weights(state["z"], state["n"]).astype(np.float32)


def score(docs: DataFrame, weight: np.ndarray, out_col: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with a score in 0..1 from the whole text; empty and null texts get the bias alone."""
    shipped = bounded_batches(docs).sparkSession.sparkContext.broadcast(weight)
    bits = int(len(weight) - 1).bit_length() - 1

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = shipped.value
        table = np.append(w[:-1], np.float32(0)).astype(np.float64)  # feature -1: nothing
        for t in texts:
            out = [np.zeros(0)]
            for b in slices([pa.RecordBatch.from_arrays([t], ["text"])]):
                f, first = features(b.column("text"), bits)
                total = np.zeros(f.shape[1] + 1)
                np.cumsum(table[f].sum(axis=0), out=total[1:])
                n = np.diff(first)
                out.append(w[-1] + (total[first[1:]] - total[first[:-1]]) * (SCALE / np.maximum(n, 1)))
            yield pa.array(training.sigmoid(np.concatenate(out)))

    return docs.withColumn(out_col, scored(F.col(text_col)))


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = training.SAMPLE_ROWS,
                   threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Learns from labelled ids whose remainder (crc32 of the id as text, modulo 4)
    is not 2. A null id is scored and counts as not held out; repeated rows get
    equal scores; without labelled rows every score is 0.5; an empty table gives no row. A very long text is
    scored whole, alone in its batch.
    """
    held = training.id_remainder(id_col, 4) == 2
    model = fit(training.labelled_sample(docs, labels, "quality", ~held, sample_rows, id_col, text_col))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("_text"))
    return (score(base, model, "score", "_text")
            .select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
