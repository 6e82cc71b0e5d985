"""Encoders from files, binary batches by bytes and the store of vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import encode, encoders


@pytest.fixture()
def weights(tmp_path):
    rng = np.random.default_rng(1)
    words, images = str(tmp_path / f"words-{id(tmp_path)}.npz"), str(tmp_path / f"images-{id(tmp_path)}.npz")
    np.savez(words, kind="hashed_words", table=rng.normal(size=(50, 3)))
    np.savez(images, kind="byte_histogram", table=rng.normal(size=(256, 2)))
    return words, images


def test_vectors_come_from_the_files(spark, weights):
    words, images = weights
    rows = [(1, b"\x00\x01\x01", "A b a"), (2, b"", ""), (3, None, None), (4, bytes(range(256)), "ü 9")]
    df = spark.createDataFrame(rows, "uid long, content binary, caption string").repartition(2)
    got = {r["uid"]: r for r in encoders.embed_pairs_from_files(df, images, words).collect()}
    t, g = np.load(words)["table"], np.load(images)["table"]
    cell = lambda w: encode._cells([w], 50)[0][0]
    assert np.allclose(got[1]["joint"], [*((g[0] + 2 * g[1]) / 3), *((2 * t[cell("a")] + t[cell("b")]) / 3)])
    assert got[2]["joint"] == [0.0] * 5 == got[3]["joint"]
    assert np.allclose(got[4]["img_vec"], g.mean(axis=0)) and np.allclose(got[4]["txt_vec"], (t[cell("ü")] + t[cell("9")]) / 2)


def test_binary_batches_are_cut_by_bytes(spark):
    def make():
        def predict(blobs):
            total = sum(len(b) for b in blobs if b is not None)
            assert total <= 1000 or len(blobs) == 1
            return np.array([[len(b) if b is not None else -1, len(blobs)] for b in blobs], float)
        return predict

    sizes = [10, 990, 1, 3000, 0, 500, 500, 1, 999, 2]
    df = spark.createDataFrame([(i, b"x" * n) for i, n in enumerate(sizes)] + [(99, None)], "i int, content binary").coalesce(1)
    try:
        got = {r["i"]: r["vec"] for r in encoders.embed_binary(df, "content", make, batch_bytes=1000).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert [got[i][0] for i in range(10)] == sizes and got[99][0] == -1 and max(v[1] for v in got.values()) > 1


def test_only_new_texts_are_encoded(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def make():
        inner = encode.numpy_text_encoder(8)()

        def predict(texts):
            seen.add(len(texts))
            return inner(texts)
        return predict

    path = str(tmp_path / "store")
    old = spark.createDataFrame([(i, f"text {i % 7}") for i in range(30)] + [(90, None), (91, "")], "uid long, text string").repartition(4)
    more = old.unionByName(spark.createDataFrame([(100, "text 3"), (101, "new one"), (102, "new one"), (103, None)], "uid long, text string"))

    def rows(df):
        return sorted((r["uid"], r["vec"]) for r in df.collect())

    first = encoders.embed_cached(old, path, "numpy-8", make)
    assert rows(first) == rows(encode.embed(old, "text", encode.numpy_text_encoder(8)))
    assert seen.value == 9  # seven texts, the empty one and the missing one
    second = encoders.embed_cached(more, path, "numpy-8", make)
    assert rows(second) == rows(encode.embed(more, "text", encode.numpy_text_encoder(8)))
    assert seen.value == 10
    assert encoders.stored_vectors(spark, path, "numpy-8").count() == 10
    # another encoder has vectors of its own; a batch that was never entered is not read
    encoders.stored_vectors(spark, path, "numpy-8").withColumn("vec", F.array(F.lit(0.0))).write.parquet(f"{path}/vectors/lost")
    other = encoders.embed_cached(old, path, "numpy-4", encode.numpy_text_encoder(4))
    assert rows(other) == rows(encode.embed(old, "text", encode.numpy_text_encoder(4)))
    assert rows(encoders.embed_cached(more, path, "numpy-8", make)) == rows(second) and seen.value == 10
