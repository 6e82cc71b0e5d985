"""Encoders whose weights are files, vectors of binary columns by bytes, and a store of vectors already computed.

* A weights file (``.npz`` with an entry ``kind``) is shipped to every executor once (``SparkContext.addFile``), whatever
  file system it lies on, and loaded once per Python worker. ``KINDS`` names what can be built from one; ``register_kind`` adds to it.
* Binary columns go to Python in batches of bounded bytes, and to the model in groups of bounded bytes.
* ``embed_cached`` encodes each distinct text once: vectors are kept by text hash and encoder name, only texts without
  one are encoded, and their vectors are appended under a manifest, so what an interrupted job left behind is never read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint
from .encode import _cells, embed

BATCH_BYTES = 16 << 20  # bytes of a binary column between the JVM and Python, and in one call of a model

Predict = Callable[[np.ndarray], np.ndarray]
KINDS: dict[str, Callable[[dict[str, np.ndarray]], Predict]] = {}


def register_kind(name: str):
    def deco(build):
        KINDS[name] = build
        return build
    return deco


@register_kind("hashed_words")
def hashed_words(weights: dict[str, np.ndarray]) -> Predict:
    """Mean of the ``table`` rows of a text's word tokens (bucket by md5); no token or no text: zeros."""
    import regex
    tok, table = regex.compile(r"[\p{L}\p{N}]+"), weights["table"]
    known: dict[str, int] = {}

    def predict(texts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), table.shape[1]))
        for r, t in enumerate(texts):
            words = tok.findall(str(t).lower()) if t is not None else []
            new = [w for w in dict.fromkeys(words) if w not in known]
            if len(known) > 1_000_000:
                known.clear()
                new = list(dict.fromkeys(words))
            known.update(zip(new, _cells(new, len(table))[0].tolist()))
            if words:
                out[r] = table[[known[w] for w in words]].mean(axis=0)
        return out
    return predict


@register_kind("byte_histogram")
def byte_histogram(weights: dict[str, np.ndarray]) -> Predict:
    """Share of each byte value times ``table`` (256 rows); nothing or an empty file: zeros."""
    table = weights["table"]

    def predict(blobs: np.ndarray) -> np.ndarray:
        out = np.zeros((len(blobs), table.shape[1]))
        for r, b in enumerate(blobs):
            if b is not None and len(b):
                out[r] = np.bincount(np.frombuffer(bytes(b), np.uint8), minlength=256) / len(b) @ table
        return out
    return predict


def encoder_from_file(spark: SparkSession, path: str) -> Callable[[], Predict]:
    """An encoder factory (as ``encode.embed`` takes one) from a weights file at any path Spark can read."""
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    def make() -> Predict:
        from pyspark import SparkFiles
        with np.load(SparkFiles.get(name), allow_pickle=False) as f:
            weights = {k: f[k] for k in f.files}
        return KINDS[str(weights["kind"])](weights)
    return make


def embed_binary(df: DataFrame, col: str, encoder: Callable[[], Predict], out_col: str = "vec", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """E5 for binary columns: the model gets as many rows at a time as have ``batch_bytes`` together (or one).

    The session cuts Arrow batches at that size from now on.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))

    @F.pandas_udf("array<double>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = encoder()
        for blobs in batches:
            size = np.cumsum([0 if b is None else len(b) for b in blobs])
            out, a = [], 0
            while a < len(blobs):
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + batch_bytes, "right")))
                out += list(predict(blobs.to_numpy()[a:b]))
                a = b
            yield pd.Series(out, dtype=object)

    return df.withColumn(out_col, encoded(col))


def embed_pairs_from_files(df: DataFrame, image_weights: str, text_weights: str, image_col: str = "content",
                           caption_col: str = "caption", batch_size: int = 32) -> DataFrame:
    """``img_vec``, ``txt_vec`` and ``joint`` of each row, by two weights files."""
    spark = df.sparkSession
    out = embed_binary(df, image_col, encoder_from_file(spark, image_weights), "img_vec")
    out = embed(out, caption_col, encoder_from_file(spark, text_weights), batch_size, "txt_vec")
    return out.withColumn("joint", F.concat("img_vec", "txt_vec"))


# ------------------------------------------------------------- vectors kept

def text_key(col: str):
    """Key of a text in the store; a missing text has a key of its own."""
    return F.coalesce(F.concat(F.md5(F.col(col)), F.hex(F.xxhash64(F.col(col)))), F.lit("missing"))


def stored_batches(spark: SparkSession, path: str, name: str) -> list[str]:
    """The batches of an encoder that were completed: a row per run of ``embed_cached``."""
    from pyspark.errors import AnalysisException
    try:
        rows = spark.read.schema("encoder string, batch string, rows long").json(f"{path}/manifest").filter(F.col("encoder") == name).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return sorted(r["batch"] for r in rows)


def stored_vectors(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``key, vec`` of an encoder."""
    batches = stored_batches(spark, path, name)
    if not batches:
        return spark.createDataFrame([], "key string, vec array<double>")
    return spark.read.schema("key string, vec array<double>").parquet(*[f"{path}/vectors/{b}" for b in batches])


def embed_cached(df: DataFrame, path: str, name: str, encoder=None, text_col: str = "text", batch_size: int = 64,
                 out_col: str = "vec") -> DataFrame:
    """The rows with a vector each, like ``encode.embed``; only texts that the store at ``path`` does not have for the
    encoder ``name`` are encoded, once each however often they stand in the rows.

    Two jobs at a time may encode a text twice; the vectors are equal, and one is taken.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_key", text_key(text_col))
    have = stored_vectors(spark, path, name)
    new = (keyed.groupBy(F.col("_key").alias("key")).agg(F.first(text_col).alias("text"))  # collapsed before the shuffle
           .join(have.select("key"), "key", "left_anti"))
    batch = uuid.uuid4().hex
    embed(new, "text", encoder, batch_size, "vec").select("key", "vec").write.parquet(f"{path}/vectors/{batch}")
    rows = spark.read.schema("key string").parquet(f"{path}/vectors/{batch}").count()
    entry = spark.createDataFrame([(name, batch, rows)], "encoder string, batch string, rows long")
    checkpoint(entry).write.mode("append").json(f"{path}/manifest")
    vecs = stored_vectors(spark, path, name).groupBy(F.col("key").alias("_key")).agg(F.first("vec").alias(out_col))
    return keyed.join(vecs, "_key", "left").drop("_key")
