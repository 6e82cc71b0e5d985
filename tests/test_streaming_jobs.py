"""File-stream text preparation equals the batch plan; batch jobs write their outputs."""

import tempfile

from tessel.operators import text as ops
from tessel.plans import fixtures as fx
from tessel.plans import jobs
from tessel.streaming import clean_stream

from conftest import SF_SMALL


def test_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="tessel-stream-", dir="/tmp")
    posts = fx.posts(spark, SF_SMALL)
    posts.repartition(3).write.parquet(d + "/in")
    stream = clean_stream.read_post_stream(spark, d + "/in", max_files=1)
    q = clean_stream.start_clean_stream(stream, d + "/out", d + "/ckpt", keep_language="de", available_now=True)
    q.awaitTermination(300)
    got = spark.read.parquet(d + "/out/clean").drop("batch")
    want = ops.clean_posts(posts, keep_language="de")
    assert sorted(got.collect()) == sorted(want.collect())


def test_prepare_posts_job(spark):
    d = tempfile.mkdtemp(prefix="tessel-job-", dir="/tmp")
    posts = fx.posts(spark, SF_SMALL)
    paths = jobs.prepare_posts(spark, posts, d, keep_language=None)
    n_clean = spark.read.parquet(paths["clean"]).count()
    n_rej = sum(r.n for r in spark.read.json(paths["rejects"]).collect())
    assert n_clean + n_rej == posts.count()
    assert spark.read.text(paths["corpus"]).count() == n_clean


def test_vector_analysis_job(spark):
    from pyspark.sql import functions as F
    clean = ops.clean_posts(fx.posts(spark, SF_SMALL))
    vecs = fx.vectors(spark, SF_SMALL).select(F.concat(F.lit("p"), F.col("uid").cast("string")).alias("uid"), "vec")
    report = jobs.vector_analysis(spark, clean, vecs, n_queries=5, k=3)
    rows = report.collect()
    assert len(rows) == 5 and all(r.report.count("\n") <= 2 for r in rows)


def test_map_2d_job(spark):
    norm, grid = jobs.map_2d(spark, fx.vectors(spark, SF_SMALL), bins=4)
    xs = norm.collect()
    assert all(0 < r.x <= 1 and 0 < r.y <= 1 for r in xs)
    assert sum(r.n for r in grid.collect()) == len(xs)


def test_evaluate_models_job(spark):
    from pyspark.sql import functions as F
    from tessel.session import load
    d = tempfile.mkdtemp(prefix="tessel-eval-", dir="/tmp")
    preds = fx.predictions(spark, SF_SMALL)
    examples = load(spark, SF_SMALL, "documents").select(
        F.col("doc_id").alias("pair_id"), F.col("text").alias("premise"), F.col("source").alias("hypothesis"))
    paths = jobs.evaluate_models(spark, preds, examples, d)
    lb = spark.read.parquet(paths["leaderboard"]).collect()
    assert {(r.model, r.split) for r in lb} == {(m, s) for m in ("m1", "m2") for s in ("test_lay", "test_expert")}
    back = spark.read.option("header", True).option("multiLine", True).option("escape", "\"").csv(paths["predictions"])
    assert back.count() == preds.count()
    assert spark.read.json(paths["metrics"]).count() == 4


def test_csv_stream_with_detected_language(spark):
    from pyspark.sql import functions as F
    from tessel.operators import lang as L
    from tessel.session import load
    d = tempfile.mkdtemp(prefix="tessel-csvstream-", dir="/tmp")
    posts = fx.posts(spark, SF_SMALL).drop("lang")
    posts.repartition(2).write.option("header", True).option("escape", '"').csv(d + "/in")
    prof = L.fit_language_profile(load(spark, SF_SMALL, "documents").select("text", "lang"))
    stream = clean_stream.read_post_stream(spark, d + "/in", fmt="csv", max_files=1)
    q = clean_stream.start_clean_stream(stream, d + "/out", d + "/ckpt", keep_language="de", profile=prof,
                                        available_now=True)
    q.awaitTermination(300)
    got = spark.read.parquet(d + "/out/clean").drop("batch")
    batch = clean_stream.clean_batch(spark.read.option("header", True).option("multiLine", True)
                                     .option("escape", '"').csv(d + "/in"), "de", prof)
    want = ops.clean_table(batch)
    assert got.count() > 0
    assert sorted(got.collect()) == sorted(want.collect())


def test_embed_and_map_job(spark):
    d = tempfile.mkdtemp(prefix="tessel-embed-", dir="/tmp")
    clean = ops.clean_posts(fx.posts(spark, SF_SMALL))
    paths = jobs.embed_and_map(spark, clean, d, batch_size=16, bins=5)
    n_rows = ops.drop_incomplete(clean).count()
    assert spark.read.parquet(paths["vectors"]).count() == n_rows
    m = spark.read.parquet(paths["map"])
    assert m.count() <= n_rows and set(m.columns) >= {"uid", "text", "x", "y", "vec"}
    assert sum(r.n for r in spark.read.parquet(paths["grid"]).collect()) == m.count()
