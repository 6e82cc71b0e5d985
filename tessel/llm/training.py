"""Bounded labelled samples and iterative parameter mixing for the trained scorers.

A model is learnt from at most ``SAMPLE_ROWS`` labelled documents, chosen by a
hash of their id, so the same rows are taken whatever the partitioning. The
sample lies in ``SHARDS`` shards; in every epoch each shard trains one pass from
the current parameters in a task of its own, and the parameters are averaged.
What the driver holds is the parameter vector, never documents.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 24_000
SHARDS = 12

State = dict[str, np.ndarray]


def id_remainder(id_col: str, modulus: int) -> Column:
    """``crc32`` of the id as text, modulo ``modulus``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int = SAMPLE_ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, y`` of at most ``rows`` labelled ids for which ``usable`` (an
    expression over the label table) holds. Repeated label rows count once;
    null ids and labels are left out. The chosen ids are few and are broadcast,
    so the documents are read once and not shuffled."""
    ids = (labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & usable)
           .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
           .orderBy(F.xxhash64("id"), "id").limit(rows))
    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .join(F.broadcast(ids), "id"))


def _packed(state: State) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **state)  # mostly zeros
    return out.getvalue()


def _unpacked(data: bytes) -> State:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def _trainer(step: Callable, shipped) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", key=lambda s: s * np.int64(-7046029254386353131), kind="stable")
        return pd.DataFrame({"state": [_packed(step(_unpacked(shipped.value), rows))]})
    return train


def _saved(arrays: State) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _block_trainer(step: Callable, shipped, blocks: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Trains a shard and returns, by block, the coordinates it changed and by how much."""
    def train(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["_shard"].iloc[0])
        rows = rows.sort_values("id", key=lambda s: s * np.int64(-7046029254386353131), kind="stable")
        old = shipped.value
        new = step({k: v.copy() for k, v in old.items()}, rows)
        out = [{} for _ in range(blocks)]
        for k, v in new.items():
            change = v - old[k]
            at = np.flatnonzero(change.reshape(len(v), -1).any(axis=1))
            cut = np.searchsorted(at, np.arange(blocks + 1) * -(-len(v) // blocks))
            for b in range(blocks):
                own = at[cut[b]:cut[b + 1]]
                out[b] |= {f"{k}.at": own, k: change[own]}
        return pd.DataFrame({"block": range(blocks), "shard": shard, "change": [_saved(o) for o in out]})
    return train


def _block_sum(rows: pd.DataFrame) -> pd.DataFrame:
    """The sum of all shards' changes in one block, added in the order of the shards."""
    parts = [_unpacked(data) for data in rows.sort_values("shard")["change"]]
    out = {}
    for k in [k for k in parts[0] if not k.endswith(".at")]:
        at, back = np.unique(np.concatenate([p[f"{k}.at"] for p in parts]), return_inverse=True)
        each = np.concatenate([p[k] for p in parts])
        total = np.zeros((len(at), *each.shape[1:]))
        np.add.at(total, back, each)
        out |= {f"{k}.at": at, k: total.astype(each.dtype)}
    return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "shards": [len(rows)], "change": [_saved(out)]})


def mix_epochs(features: DataFrame, start: State, step: Callable[[State, pd.DataFrame], State],
               epochs: int, shards: int = SHARDS, blocks: int = 0) -> State:
    """Train ``epochs`` passes: ``step(state, rows)`` per shard, then the mean of the shards' states.

    ``features`` has ``id``; a shard sees its rows in hash order of the id. An
    empty table leaves the start state as it is. With ``blocks``, shards return what
    they changed, Spark adds it, each block of the coordinates in a task of its own, and the
    driver never holds more than one sum beside the state; without, the driver adds the shards' states.
    """
    spark = features.sparkSession
    keyed = features.withColumn("_shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    state = start
    for _ in range(epochs):
        if blocks:
            shipped = spark.sparkContext.broadcast(state)
            sums = (keyed.groupBy("_shard").applyInPandas(_block_trainer(step, shipped, blocks), "block int, shard int, change binary")
                    .groupBy("block").applyInPandas(_block_sum, "block int, shards int, change binary").collect())
            state = {k: v.copy() for k, v in state.items()}
            for r in sums:
                change = _unpacked(bytes(r["change"]))
                for k, v in state.items():
                    v[change[f"{k}.at"]] += change[k] / r["shards"]
            shipped.destroy()
            continue
        shipped = spark.sparkContext.broadcast(_packed(state))

        parts = keyed.groupBy("_shard").applyInPandas(_trainer(step, shipped), "state binary").collect()
        if not parts:
            return state
        total = {k: np.zeros(v.shape) for k, v in state.items()}
        for r in parts:
            for k, v in _unpacked(bytes(r["state"])).items():
                total[k] += v
        state = {k: (total[k] / len(parts)).astype(v.dtype) for k, v in state.items()}
        shipped.unpersist()
    return state


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
