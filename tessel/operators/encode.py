"""Sequences and encoders: vocabulary, fixed-length (pair) encoding, batch
assignment, signed feature hashing, and batch inference (E1-E8).

Sequences and hashes are made inside the row: tokens come from a native regex,
an Arrow batch looks every distinct token up once (in the size-checked,
broadcast vocabulary, or by hashing it) and the row keeps its place. One output row
per input row, whatever the keys; no explode and no shuffle. Only a vocabulary
beyond the broadcast bound is joined by shuffle, keyed by a generated row id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..session import checkpoint
from . import sampling

# Reserved ids of the vocabulary.
PAD, UNK, CLS, SEP = 0, 1, 2, 3
RESERVED = [("[PAD]", PAD), ("[UNK]", UNK), ("[CLS]", CLS), ("[SEP]", SEP)]
MAX_BROADCAST_VOCAB = 2_000_000  # rows of (token, id) that may be broadcast
JOIN_SALTS = 16  # copies of a larger vocabulary in the join, so a hot token is split


def fit_vocab(df: DataFrame, text_col: str = "text", max_size: int = 30_000) -> DataFrame:
    """``token, id, n``: the ``max_size`` most frequent tokens (ties by
    token), ids after the reserved ones. Counting is a partial aggregate; tokens
    below the count that ``max_size`` tokens reach are left out before the ranking, so only
    about that many rows are merged. The result is checkpointed: the corpus is
    counted once however often the vocabulary is used."""
    counts = checkpoint(df.select(F.explode(word_tokens(F.col(text_col))).alias("token"))
                        .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    # the largest count that at least max_size tokens reach, from the counts of counts
    hist = counts.groupBy("n").agg(F.count(F.lit(1)).alias("tokens"))
    reach = hist.select("n", F.sum("tokens").over(Window.orderBy(F.desc("n"))).alias("at"))  # a row per distinct count
    least = reach.filter(F.col("at") >= max_size).agg(F.max("n")).first()[0] or 0
    top = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), F.col("token")).limit(max_size)
    w = Window.orderBy(F.desc("n"), F.col("token"))  # over <= max_size rows
    return checkpoint(top.select("token", (F.row_number().over(w) + len(RESERVED) - 1).cast("int").alias("id"), "n"))


def distinct_tokens(column: pa.ListArray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Token lists of an Arrow batch: number of each token's distinct form, the
    forms, and list lengths. Only distinct tokens become Python strings."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = column.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), size


def list_column(flat: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat))


def token_ids(df: DataFrame, vocab: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with a column of token ids (``UNK`` for unknown tokens) for every given
    column of token lists; an empty or null list gives an empty one."""
    if vocab.count() > MAX_BROADCAST_VOCAB:
        return _token_ids_by_join(df, vocab, columns)
    known = vocab.select("token", "id").toPandas()  # size checked
    shipped = df.sparkSession.sparkContext.broadcast(dict(zip(known["token"], known["id"].astype(int))))

    @F.arrow_udf("array<int>")
    def look(column: pa.Array) -> pa.Array:
        ids = shipped.value
        code, seen, size = distinct_tokens(column)
        return list_column(np.array([ids.get(t, UNK) for t in seen], np.int32)[code] if len(code) else np.zeros(0, np.int32), size)

    return df.select("*", *[look(c).alias(name) for name, c in columns.items()])


def _token_ids_by_join(df: DataFrame, vocab: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The same for a vocabulary too large to broadcast. The token of a hot word is salted by its row."""
    rows = checkpoint(df.select("*", *[c.alias(name) for name, c in columns.items()])
                      .withColumn("_rid", F.monotonically_increasing_id()))
    salt = F.pmod(F.xxhash64("_rid"), F.lit(JOIN_SALTS)).cast("int")
    parts = [rows.select("_rid", F.lit(name).alias("_col"), F.posexplode(name).alias("pos", "_tok")) for name in columns]
    ex = parts[0]
    for p in parts[1:]:
        ex = ex.unionByName(p)
    v = vocab.select(F.col("token").alias("_tok"), F.col("id").alias("_id")).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))
    tid = F.coalesce("_id", F.lit(UNK))
    got = (ex.withColumn("_salt", salt).join(v, ["_tok", "_salt"], "left")
           .groupBy("_rid").pivot("_col", list(columns))
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", tid.alias("t")))), lambda x: x["t"])))
    out = rows.drop(*columns).join(got, "_rid", "left").drop("_rid")
    return out.withColumns({c: F.coalesce(F.col(c), F.array().cast("array<int>")) for c in columns})


def _pad(arr: Column, max_len: int, value: int = PAD) -> Column:
    return F.concat(arr, F.array_repeat(F.lit(value), F.lit(max_len) - F.size(arr)))


def encode(df: DataFrame, vocab: DataFrame, key: list[str], text_col: str = "text", max_len: int = 32) -> DataFrame:
    """``key..., ids, mask`` of length ``max_len``: [CLS] tokens [SEP],
    truncated, padded. One row per input row, also where keys repeat."""
    toks = F.slice(F.coalesce(word_tokens(F.col(text_col)), F.array().cast("array<string>")), 1, max_len - 2)
    rows = token_ids(df.select(*key, text_col), vocab, {"_body": toks})
    ids = F.concat(F.array(F.lit(CLS)), F.col("_body"), F.array(F.lit(SEP)))
    return rows.select(*key, _pad(ids, max_len).alias("ids"),
                       _pad(F.array_repeat(F.lit(1), F.size("_body") + 2), max_len).alias("mask"))


def pair_budget(la: Column, lb: Column, budget: int):
    """Longest-first truncation of a pair to ``budget`` tokens (ties cut the
    second side): kept lengths of side a and side b."""
    half_up, half_down = (budget + 1) // 2, budget // 2
    ka = F.least(la, F.greatest(F.lit(half_up), F.lit(budget) - lb))
    kb = F.least(lb, F.greatest(F.lit(half_down), F.lit(budget) - la))
    return ka, kb


def encode_pairs(df: DataFrame, vocab: DataFrame, key: list[str], a_col: str = "premise",
                 b_col: str = "hypothesis", max_len: int = 64) -> DataFrame:
    """``key..., ids, type_ids, mask``: [CLS] a [SEP] b [SEP], longest-first
    truncation. One row per input row, also where keys repeat."""
    none = F.array().cast("array<string>")
    base = df.select(*key, F.coalesce(word_tokens(F.col(a_col)), none).alias("_ta"),
                     F.coalesce(word_tokens(F.col(b_col)), none).alias("_tb"))
    ka, kb = pair_budget(F.size("_ta"), F.size("_tb"), max_len - 3)
    rows = token_ids(base, vocab, {"_a": F.slice("_ta", 1, ka), "_b": F.slice("_tb", 1, kb)})
    ids = F.concat(F.array(F.lit(CLS)), F.col("_a"), F.array(F.lit(SEP)), F.col("_b"), F.array(F.lit(SEP)))
    types = F.concat(F.array_repeat(F.lit(0), F.size("_a") + 2), F.array_repeat(F.lit(1), F.size("_b") + 1))
    n = F.size("_a") + F.size("_b") + 3
    return rows.select(*key, _pad(ids, max_len).alias("ids"), _pad(types, max_len).alias("type_ids"),
                       _pad(F.array_repeat(F.lit(1), n), max_len).alias("mask"))


def assign_batches(df: DataFrame, size: int, order_by: list[str], drop_last: bool = False, partitions: int | None = None) -> DataFrame:
    """0-based ``batch`` = position // size in ``order_by`` order; the last
    batch may be short, or is dropped with ``drop_last``. ``partitions``: of the numbering, where the optimizer can't tell the size."""
    numbered = sampling.number_rows(df, order_by, partitions)
    out = numbered.withColumn("batch", F.floor(F.col("idx") / size).cast("long"))
    if drop_last:
        total = numbered.count()
        out = out.filter(F.col("idx") < F.lit((total // size) * size))
    return out.drop("idx")


def _cells(tokens, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of tokens: the first 32 bits of the md5, and its next hex digit's parity."""
    digests = [hashlib.md5(t.encode("utf-8")).hexdigest() for t in tokens]
    return (np.array([int(d[:8], 16) % dim for d in digests], np.int64),
            np.array([1.0 if int(d[8], 16) % 2 == 0 else -1.0 for d in digests]))


def hash_vector(tokens: Column, dim: int = 64) -> Column:
    """E6 as a column: signed feature hashing of token lists, L2-normalised, no tokens -> zero vector."""
    @F.arrow_udf("array<double>")
    def hashed(column: pa.Array) -> pa.Array:
        code, seen, size = distinct_tokens(column)
        bucket, sign = _cells(seen, dim)
        out = [np.zeros(0)]
        for a in range(0, len(size), rows := max(1, (4 << 20) // dim)):
            part = size[a:a + rows]
            lo = int(size[:a].sum())
            own = code[lo:lo + int(part.sum())]
            cell = np.repeat(np.arange(len(part)), part) * dim + (bucket[own] if len(own) else 0)
            v = np.bincount(cell, sign[own] if len(own) else None, len(part) * dim).reshape(len(part), dim).astype(float)
            n = np.sqrt((v * v).sum(axis=1, keepdims=True))
            out.append(np.divide(v, n, out=v, where=n > 0).ravel())
        return list_column(np.concatenate(out), np.full(len(size), dim))

    return hashed(tokens)


def hash_encode(df: DataFrame, key, text_col: str = "text", dim: int = 64, out_col: str = "vec") -> DataFrame:
    """``key..., vec``: signed feature hashing of word tokens into ``dim``
    buckets (md5-based, identical in SQL), L2-normalised; no tokens -> zero vector.
    One row per input row, also where keys repeat."""
    key = [key] if isinstance(key, str) else list(key)
    return df.select(*key, hash_vector(word_tokens(F.col(text_col)), dim).alias(out_col))


# ------------------------------------------------------------- batch inference

def numpy_text_encoder(dim: int = 64) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """Stand-in encoder factory (no model files ship here): the same signed
    md5 feature hashing as ``hash_encode``, done in numpy per batch, so the
    batch-inference plumbing can be checked against SQL. Any factory with the
    same shape (load once, then ``texts -> [batch, dim]``) plugs into ``embed``;
    a real model goes here."""
    def make():
        import regex
        tok = regex.compile(r"[\p{L}\p{N}]+")

        def cell(w: str) -> tuple[int, float]:
            b, sgn = _cells([w], dim)
            return int(b[0]), float(sgn[0])

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float64)
            for r, t in enumerate(texts):
                if t is None:
                    continue
                for w in tok.findall(str(t).lower()):
                    b, sgn = cell(w)
                    out[r, b] += sgn
            n = np.sqrt(np.sum(out * out, axis=1, keepdims=True))
            return np.divide(out, n, out=np.zeros_like(out), where=n > 0)
        return predict
    return make


def embed(df: DataFrame, text_col: str = "text", encoder=None, batch_size: int = 64,
          out_col: str = "vec") -> DataFrame:
    """Arrow-batched inference with ``predict_batch_udf``; the model is
    built once per Python worker and fed ``batch_size`` rows at a time."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType
    encoder = encoder or numpy_text_encoder()
    udf = predict_batch_udf(encoder, return_type=ArrayType(DoubleType()), batch_size=batch_size)
    return df.withColumn(out_col, udf(F.col(text_col)))


def mean_embedding_encoder(vocab_size: int, dim: int = 16):
    """Stand-in sequence encoder factory: a fixed table of token vectors
    (``sin(id * (j + 1))``), averaged where the mask is 1. A model that reads ids and
    a mask has the same shape."""
    def make():
        table = np.sin(np.arange(vocab_size)[:, None] * (np.arange(dim)[None, :] + 1.0))

        def predict(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
            m = mask.astype(float)
            total = np.einsum("bs,bsd->bd", m, table[ids.astype(np.int64)])
            return total / np.maximum(m.sum(axis=1, keepdims=True), 1.0)
        return predict
    return make


def embed_encoded(df: DataFrame, encoder, max_len: int, batch_size: int = 64, ids_col: str = "ids",
                  mask_col: str = "mask", out_col: str = "vec") -> DataFrame:
    """E5/E8 on encoded rows (the output of ``encode``): the model gets an id
    matrix and a mask of ``max_len`` columns."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType
    udf = predict_batch_udf(encoder, return_type=ArrayType(DoubleType()), batch_size=batch_size,
                            input_tensor_shapes=[[max_len], [max_len]])
    return df.withColumn(out_col, udf(F.col(ids_col), F.col(mask_col)))


def image_encoder(dim: int = 64):
    """Stand-in image encoder factory: byte histogram folded to ``dim`` bins."""
    def make():
        def predict(blobs: np.ndarray) -> np.ndarray:
            out = np.zeros((len(blobs), dim), dtype=np.float32)
            for r, b in enumerate(blobs):
                if b is None:
                    continue
                arr = np.frombuffer(bytes(b), dtype=np.uint8)
                out[r] = np.bincount(arr % dim, minlength=dim)[:dim]
            n = np.linalg.norm(out, axis=1, keepdims=True)
            return np.divide(out, n, out=np.zeros_like(out), where=n > 0)
        return predict
    return make


def embed_pairs(df: DataFrame, image_col: str = "content", caption_col: str = "caption",
                img_encoder=None, txt_encoder=None, batch_size: int = 32) -> DataFrame:
    """Image vector and caption vector per row, and their concatenation."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType
    img = predict_batch_udf(img_encoder or image_encoder(), return_type=ArrayType(FloatType()), batch_size=batch_size)
    out = df.withColumn("img_vec", img(F.col(image_col)))
    out = embed(out, caption_col, txt_encoder, batch_size, "txt_vec")
    return out.withColumn("joint", F.concat("img_vec", "txt_vec"))
