"""Queries that write tables into the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import evaluate as ev
from ..operators import text as ops
from ..session import checkpoint, shared_path, size_estimate
from ..sources import ranges, readers, schemas, writers
from . import fixtures as fx
from . import q_eval, q_sampling, q_text
from . import sqlbits as S
from .registry import register, with_ctes

RANGES = 64  # byte ranges wanted of a small fixture; a large one has ranges of 128 MB
POSTS_RAW = ", ".join(f"{S.na(c)} as {c}" for c in schemas.POSTS.names)


@register("read_posts_ranges", with_ctes(fx.POSTS_CTE) + f"select {POSTS_RAW} from posts")
def read_posts_ranges(spark, sf_dir):
    """The posts as CSV with quoted line breaks, read in byte ranges."""
    path = shared_path(spark, "posts-csv")
    posts = fx.posts(spark, sf_dir).select(*schemas.POSTS.names)
    posts.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    size = size_estimate(spark.read.text(path))
    with ranges.split_bytes(spark, 128 << 20 if size is None else max(1 << 14, min(128 << 20, size // RANGES))):
        return checkpoint(readers.read_posts_ranges(spark, path))


@register("clean_table_csv", q_text._TAGGED + f", c as ({S.clean_select()}) select uid, {S.na('text')} as text, img_dir, {S.na('img_fname')} as img_fname from c")
def clean_table_csv(spark, sf_dir):
    """The clean table as CSV and back; an empty cell is a missing value there."""
    path = shared_path(spark, "clean-csv")
    writers.write_clean(ops.clean_posts(fx.posts(spark, sf_dir)), path, fmt="csv")
    return readers.read_clean(spark, path, fmt="csv")


@register("corpus_text", q_text._TAGGED + f"select {S.clean('text')} as value from tagged where reason is null")
def corpus_text(spark, sf_dir):
    """The corpus as text lines and back."""
    path = shared_path(spark, "corpus")
    writers.write_corpus(ops.clean_posts(fx.posts(spark, sf_dir)), path)
    return spark.read.option("lineSep", "\n").text(path)


@register("read_pair_split", with_ctes(fx.PAIRS_CTE) + "select pair_id, premise, hypothesis, label, split from pairs where split in ('test_lay', 'validation')")
def read_pair_split(spark, sf_dir):
    """S3: labelled pairs by split folder, two of the four splits read."""
    path = shared_path(spark, "pairs")
    fx.pairs(spark, sf_dir).write.partitionBy("split").parquet(path)
    return readers.read_pairs(spark, path, ["test_lay", "validation"]).select("pair_id", "premise", "hypothesis", "label", "split")


@register("vector_table", with_ctes(fx.VECTORS_CTE) + "select uid, vec from vectors")
def vector_table(spark, sf_dir):
    """Vectors as 32-bit Parquet and back."""
    path = shared_path(spark, "vectors")
    writers.write_vectors(fx.vectors(spark, sf_dir).select("uid", F.col("vec").cast("array<float>").alias("vec")), path)
    return readers.read_vectors(spark, path)


@register("map_csv", with_ctes(fx.MAP2D_CTE) + """select cast(uid as varchar) as uid, 'point, ' || cast(uid as varchar) as text,
  round(x, 6) as x, round(y, 6) as y from map2d""")
def map_csv(spark, sf_dir):
    """The 2-D map as CSV with printed vectors and back."""
    path = shared_path(spark, "map")
    m = fx.map2d(spark, sf_dir).select("uid", F.concat(F.lit("point, "), F.col("uid").cast("string")).alias("text"), F.array("x", "y").alias("vec"))
    writers.write_map(m, path, fmt="csv")
    return readers.read_map_csv(spark, path).select("uid", "text", F.round(F.col("vec")[0], 6).alias("x"), F.round(F.col("vec")[1], 6).alias("y"))


@register("set_records", with_ctes(fx.MAP2D_CTE, *q_sampling._odd_ctes("map2d"), f"r as ({q_sampling._SETS})") + 'select "index", uid, text, label from r')
def set_records(spark, sf_dir):
    """The odd-one-out records as JSON lines and back."""
    path = shared_path(spark, "sets")
    writers.write_sets(q_sampling.odd_one_out(spark, sf_dir), path)
    return spark.read.schema("index int, uid long, text string, label int").json(path)


_TABLES = with_ctes(fx.PREDICTIONS_CTE, """t as (select split, cast(pair_id as varchar) as premise, concat('h, ', label) as hypothesis, probs[3] as pred, label
  from predictions where model = 'm1')""")


@register("prediction_tables", _TABLES + "select split, premise, hypothesis, round(pred, 6) as pred, label from t")
def prediction_tables(spark, sf_dir):
    """The prediction tables of two splits, written by two jobs, one of them twice."""
    path = shared_path(spark, "predictions")
    scored = fx.predictions(spark, sf_dir).filter("model = 'm1'").select(
        "split", F.col("pair_id").cast("string").alias("premise"), F.concat(F.lit("h, "), F.col("label").cast("string")).alias("hypothesis"),
        V.class_score(F.col("probs"), 2).alias("pred"), "label")
    writers.write_predictions(scored, path)
    writers.write_predictions(scored.filter("split = 'test_lay'"), path)
    return readers.read_predictions(spark, path).select("split", "premise", "hypothesis", F.round("pred", 6).alias("pred"), "label")


@register("metric_files", q_eval._PRED + "select model, accuracy, f1, precision, recall, split from metrics")
def metric_files(spark, sf_dir):
    """Metrics per split, each split written by its own job."""
    path = shared_path(spark, "metrics")
    metrics = checkpoint(ev.nli_metrics(q_eval._scored(spark, sf_dir), q_eval.BY))
    for split in ("test_lay", "test_expert"):
        writers.write_metrics(metrics.filter(F.col("split") == split), path)
    back = spark.read.schema("model string, accuracy double, f1 double, precision double, recall double, split string").json(path)
    return q_eval._rounded(back, "accuracy", "f1", "precision", "recall")
