"""Toxicity scores: a factorization machine over hashed terms.

Terms are lower-cased words without the signs around them and the words' stems,
hashed into a table of parameters. Every slot of the table has a weight and a short vector, so
rare terms are learnt like frequent ones; the score adds the weights of a text's distinct terms
and the inner products of all pairs of their vectors, so two words that mean harm
only together are learnt as a pair. A pairwise sum costs one pass: half of
(sum of vectors) squared minus the sum of squares.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import training
from .store import bounded_batches, stored
from .words import Words, folded, mix, slices

FACTORS = 8
STEMS = (4, 6)        # leading bytes of a word that are terms of their own: inflected words share them
BITS = 18             # parameter table of 2**18 slots; every term has one
SCALE = 8.0           # value of a text's terms together (as a length); at most 1 for each
BLOCKS = 16           # pieces of the table in which Spark adds the shards' states
RATE, SPARSE = 0.5, 0.02  # step size of weights; their L1 penalty, which sets those of uninformative terms to zero
RATE_V, DECAY = 0.05, 0.001  # step size and L2 penalty of vectors: an L1 penalty would end every pair before it has begun
START = 0.1           # vectors start within this distance of zero, by a hash of the slot
RARITY = 4.0          # a toxic text weighs as many times as they are rarer than others, up to this
EPOCHS = 8
THRESHOLD = 0.5


def term_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of every text, and term offsets of the texts: each word
    without the signs around it, and its first bytes (``STEMS``) where it is longer."""
    w = Words(folded(col))
    w.strip_signs()
    start, end = w.start, w.end
    lo, hi, of = [start], [end], [np.arange(len(start))]
    for k in STEMS:
        long = np.flatnonzero(end - start > k)
        lo.append(start[long])
        hi.append(start[long] + k)
        of.append(long)
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    w.start, w.end = np.concatenate(lo)[order], np.concatenate(hi)[order]
    return w.hashes(), np.searchsorted(of[order], w.first)


def slots(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of every text's terms in a table of ``size`` (a power of two): text
    numbers and slots, by text."""
    h, first = term_hashes(col)
    doc = np.repeat(np.arange(len(col)), np.diff(first))
    both = np.unique(doc * np.int64(size) + (h & np.uint64(size - 1)).astype(np.int64))
    return both // size, both % size


def values(n: np.ndarray) -> np.ndarray:
    """Value of each term of texts with ``n`` distinct terms: a step on a long text, where
    thousands of terms move at once, does not overshoot."""
    return np.minimum(1.0, SCALE / np.sqrt(np.maximum(n, 1)))


def machine(w0: float, w: np.ndarray, v: np.ndarray, doc: np.ndarray, term: np.ndarray, n: int,
            value: np.ndarray | float = 1.0) -> np.ndarray:
    """Raw score of ``n`` texts from their distinct terms, whose value in each text is ``value``."""
    add = np.bincount(doc, w[term], n)
    pair = np.zeros(n)
    for f in range(v.shape[1]):
        x = v[term, f]
        pair += np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n)
    return w0 + value * add + 0.5 * value ** 2 * pair


def _shrunk(x: np.ndarray, gradient, rate: np.ndarray) -> np.ndarray:
    """A gradient step and the proximal step of the L1 penalty."""
    x = x - rate * gradient
    return np.sign(x) * np.maximum(0.0, np.abs(x) - rate * SPARSE)


def _train(state: training.State, rows: pd.DataFrame, weight: float = 1.0) -> training.State:
    """One pass of per-coordinate adaptive gradient steps on the logistic loss; ``weight`` counts a toxic text."""
    w0, w, v, g0, gw, gv = (state[k] for k in ("w0", "w", "v", "g0", "gw", "gv"))
    for idx, y in zip(rows["idx"], rows["y"]):
        i = np.asarray(idx, np.int64)
        x = float(values(len(i)))
        vi = v[i]
        s = vi.sum(axis=0)
        raw = w0[0] + x * w[i].sum() + 0.5 * x * x * float((s * s).sum() - (vi * vi).sum())
        e = (float(training.sigmoid(np.array([raw]))[0]) - y) * (weight if y else 1.0)
        g0[0] += e * e
        w0[0] -= RATE * e / np.sqrt(g0[0])
        dw = e * x
        gw[i] += dw * dw
        w[i] = _shrunk(w[i], dw, RATE / np.sqrt(gw[i]))
        dv = dw * x * (s - vi) + DECAY * vi
        gv[i] += dv * dv
        v[i] = vi - RATE_V / np.sqrt(gv[i]) * dv
    return {"w0": w0, "w": w, "v": v, "g0": g0, "gw": gw, "gv": gv}


def fit(sample: DataFrame, factors: int = FACTORS, epochs: int = EPOCHS, bits: int = BITS) -> dict[str, np.ndarray]:
    """Bias, weights and vectors of the slots learnt from ``id, text, y`` rows."""
    m = 1 << bits

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            doc, slot = slots(b.column("text"), m)
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("y"),
                 pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(slot, pa.int32()))], names=["id", "y", "idx"])

    table = stored(bounded_batches(sample).mapInArrow(rows, "id long, y int, idx array<int>"), "toxicity-sample")
    # small deterministic vectors: the same start in every shard
    noise = (mix(np.arange(1, m * factors + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / (1 << 53) - 0.5
    kind = np.float32  # what shards and driver exchange stays small
    start = {"w0": np.zeros(1, kind), "w": np.zeros(m, kind), "v": (noise.reshape(m, factors) * 2 * START).astype(kind),
             "g0": np.ones(1, kind), "gw": np.ones(m, kind), "gv": np.ones((m, factors), kind)}
    count = table.agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    weight = min(RARITY, max(1.0, (count["n"] - count["toxic"]) / count["toxic"])) if count["toxic"] else 1.0
    state = training.mix_epochs(table, start, partial(_train, weight=weight), epochs, blocks=BLOCKS)
    state["v"][state["gw"] == 1] = 0  # slots no document of the sample has add nothing
    return {k: state[k] for k in ("w0", "w", "v")}


def score(docs: DataFrame, model: dict[str, np.ndarray], out_col: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with a score in 0..1 from the whole text; a text without terms gets the bias alone."""
    shipped = bounded_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shipped.value
        w0, w, v = float(m["w0"][0]), m["w"].astype(np.float64), m["v"].astype(np.float64)
        live = (w != 0) | (v != 0).any(axis=1)  # all other slots add nothing
        for t in texts:
            out = [np.zeros(0)]
            for b in slices([pa.RecordBatch.from_arrays([t], ["text"])]):
                doc, slot = slots(b.column("text"), len(w))
                value = values(np.bincount(doc, minlength=b.num_rows))
                doc, slot = doc[live[slot]], slot[live[slot]]
                out.append(training.sigmoid(machine(w0, w, v, doc, slot, b.num_rows, value)))
            yield pa.array(np.concatenate(out))

    return docs.withColumn(out_col, scored(F.col(text_col)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = training.SAMPLE_ROWS,
                    threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Learns from labelled ids whose remainder (crc32 of the id as text, modulo 5)
    is not 0. A null id is scored and counts as held out; repeated rows get equal
    scores; without labelled rows every score is 0.5; an empty table gives no row. A very long text is
    scored whole, alone in its batch.
    """
    held = training.id_remainder(id_col, 5) == 0
    model = fit(training.labelled_sample(docs, labels, "toxic", ~held, sample_rows, id_col, text_col))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("_text"))
    return (score(base, model, "score", "_text")
            .select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
