"""End-to-end batch jobs built from the operators (the reference's entry points).

Each job writes its outputs with the DataFrame writer; shared intermediate
results are materialised once (to the output folder or the checkpoint
folder), so a lost executor re-runs tasks, not the whole lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lang as L
from ..operators import text as text_ops
from ..operators import vectors as vec_ops
from ..operators import sampling
from ..session import checkpoint
from ..sources import readers, writers


def prepare_posts(spark: SparkSession, posts: DataFrame, out_dir: str, keep_language: str | None = None,
                  profile: L.LanguageProfile | None = None, min_tokens: int = 5) -> dict[str, str]:
    """Entry 1: raw posts -> clean table, corpus, language counts, reject counts.

    Rows are tagged once (text choice, length test, language, reason) and the
    tagged frame is written as Parquet; the four outputs are projections of it.
    With ``profile`` the language is detected, else the ``lang`` column is used.
    """
    pre = text_ops.choose_text(posts, min_tokens)
    if profile is not None:
        pre = L.with_language(pre.drop("lang") if "lang" in pre.columns else pre, profile, where=F.col("reason").isNull())
    tagged = text_ops.tag_language(pre, keep_language)
    paths = {k: f"{out_dir.rstrip('/')}/{k}" for k in ("tagged", "clean", "corpus", "counts", "rejects")}
    tagged.write.mode("overwrite").parquet(paths["tagged"])
    tagged = spark.read.parquet(paths["tagged"])
    clean = text_ops.clean_table(tagged)
    writers.write_clean(clean, paths["clean"])
    writers.write_corpus(spark.read.parquet(paths["clean"]), paths["corpus"])
    writers.write_counts(text_ops.language_counts(tagged), paths["counts"])
    text_ops.reject_counts(tagged).write.mode("overwrite").json(paths["rejects"])
    return paths


def vector_analysis(spark: SparkSession, clean: DataFrame, vectors: DataFrame, n_queries: int = 10, k: int = 4,
                    seed: int = 123) -> DataFrame:
    """Entry 3b: attach vectors by key, drop incomplete rows and duplicate
    texts (first kept), then exact k-NN of sampled queries with a text report."""
    rows = text_ops.drop_incomplete(clean)
    rows = text_ops.dedup_text(rows.withColumn("_o", F.col("uid")), "text", "_o").drop("_o")
    att = vec_ops.attach_vectors(rows, vectors, "uid", missing="drop")  # only rows with a vector can be searched
    pts = checkpoint(att.select("uid", "vec"))
    nn = vec_ops.knn(sampling.sample_seeded(pts, n_queries, seed), pts, k, include_self=True)
    return vec_ops.neighbour_report(nn, rows.select("uid", "text"))


def map_2d(spark: SparkSession, vectors: DataFrame, bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """Entry 2 (active part): vectors -> 2-D projection -> 3-sigma trim ->
    min-max -> density grid (the plot, as counts)."""
    proj = checkpoint(vec_ops.project_2d(vectors))  # the trim, the scaling, the map and the grid read it
    norm = checkpoint(vec_ops.minmax(vec_ops.trim_outliers(proj, ["x", "y"]), ["x", "y"]))
    return norm, vec_ops.density_grid(norm, bins=bins)


def evaluate_models(spark: SparkSession, predictions: DataFrame, examples: DataFrame, out_dir: str,
                    key: str = "pair_id") -> dict[str, str]:
    """Entry 4 (evaluation side): for every model and held-out split in one job,
    metrics (JSON per split), the class report, prediction tables with the
    contradiction score (CSV per split) and the model leaderboard."""
    from ..operators import evaluate as ev
    paths = {k: f"{out_dir.rstrip('/')}/{k}" for k in ("metrics", "report", "predictions", "leaderboard")}
    scored = ev.with_pred(predictions)
    metrics = checkpoint(ev.nli_metrics(scored, ["model", "split"]).join(
        ev.cross_entropy(scored, ["model", "split"]), ["model", "split"]))
    writers.write_metrics(metrics, paths["metrics"])
    ev.class_report(scored, ["model", "split"]).write.mode("overwrite").parquet(paths["report"])
    table = ev.prediction_table(scored, examples, key, missing="keep")
    (table.orderBy("model", "split", F.desc("pred"), key)
     .select("model", "split", "premise", "hypothesis", "pred", "label").write.mode("overwrite")
     .partitionBy("model", "split").option("header", True).option("escape", '"').csv(paths["predictions"]))
    ev.leaderboard(metrics).write.mode("overwrite").parquet(paths["leaderboard"])
    return paths


def embed_and_map(spark: SparkSession, clean: DataFrame, out_dir: str, encoder=None, batch_size: int = 32,
                  bins: int = 10) -> dict[str, str]:
    """Entry 2: clean table -> drop incomplete rows -> batch-encode text ->
    vectors (typed Parquet, keyed by uid) -> 2-D map with text -> density grid."""
    from ..operators import encode as enc
    paths = {k: f"{out_dir.rstrip('/')}/{k}" for k in ("vectors", "map", "grid")}
    rows = text_ops.drop_incomplete(clean)
    writers.write_vectors(enc.embed(rows, "text", encoder, batch_size).select("uid", "vec"), paths["vectors"])
    vecs = readers.read_vectors(spark, paths["vectors"])
    norm, grid = map_2d(spark, vecs, bins)
    writers.write_map(norm.join(rows.select("uid", "text"), "uid").withColumn("vec", F.array("x", "y")),
                      paths["map"])
    grid.write.mode("overwrite").parquet(paths["grid"])
    return paths
