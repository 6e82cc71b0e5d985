"""Text preparation over a file stream (new post files arriving in a folder).

Row-level steps (P1-P11) are stateless; language detection needs a per-document
aggregate, so each micro-batch is handed to ``foreachBatch`` and runs the same
batch plan as ``operators.text`` / ``operators.lang``. Output is written per
batch id (overwrite of that batch's folder), so a replayed batch after a
failure replaces its own output: exactly-once files with the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lang as L
from ..operators import text as text_ops
from ..sources import schemas


def read_post_stream(spark: SparkSession, src_dir: str, fmt: str = "parquet", max_files: int = 100) -> DataFrame:
    """Posts arriving in a folder. CSV columns go by header name: the layout is the
    header of the files already there, all of which must have one layout (a file with
    another header fails the batch); a missing column raises at the start."""
    r = spark.readStream.option("maxFilesPerTrigger", max_files)
    if fmt != "csv":
        return r.schema(_posts_with_lang()).parquet(src_dir)
    head = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(src_dir).schema
    missing = [c for c in schemas.POSTS.names if c not in head.names]
    if missing:
        raise ValueError(f"{src_dir}: no column {', '.join(missing)} in the header")
    return (r.schema(head).option("header", True).option("enforceSchema", False).option("multiLine", True)
            .option("escape", '"').csv(src_dir).select(*schemas.POSTS.names))


def _posts_with_lang():
    from pyspark.sql import types as T
    return T.StructType(schemas.POSTS.fields + [T.StructField("lang", T.StringType())])


def clean_batch(batch: DataFrame, keep_language: str | None, profile: L.LanguageProfile | None) -> DataFrame:
    pre = text_ops.choose_text(batch)
    if profile is not None:
        pre = L.with_language(pre.drop("lang") if "lang" in pre.columns else pre, profile, where=F.col("reason").isNull())
    return text_ops.tag_language(pre, keep_language)


def start_clean_stream(stream: DataFrame, out_dir: str, checkpoint_dir: str, keep_language: str | None = None,
                       profile: L.LanguageProfile | None = None, available_now: bool = False):
    """Start the query; writes ``out_dir/clean/batch=<id>`` and ``out_dir/rejects/batch=<id>``."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        tagged = clean_batch(batch, keep_language, profile).cache()
        text_ops.clean_table(tagged).write.mode("overwrite").parquet(f"{out_dir}/clean/batch={batch_id}")
        text_ops.reject_counts(tagged).write.mode("overwrite").parquet(f"{out_dir}/rejects/batch={batch_id}")
        tagged.unpersist()

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
