"""Five-stage preparation of ``documents`` for language-model training.

``STAGES`` lists the stages in order. Each function takes ``(spark, docs,
sf_dir)`` and returns a frame that is written as Parquet and read again as the
next one's ``docs``; all but the last return the columns they got.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import decontam, packing, quality, secrets, simhash, tokens, training
from tessel.llm.store import stored
from tessel.session import ensure_checkpoint_dir, load


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality model predicts to be good (operator 3). Without
    labelled documents nothing can be learnt, and nothing is rejected. Null and empty texts get the bias alone and stay or go
    by it; repeated rows and null ids are judged row by row; a very long text is scored whole; an empty table stays empty."""
    labels = load(spark, sf_dir, "labels")
    usable = training.id_remainder("doc_id", 4) != 2
    model = quality.fit(training.labelled_sample(docs, labels, "quality", usable))
    if not model.any():
        return docs
    name = f"score_{uuid.uuid4().hex}"  # a name no table has
    return quality.score(docs, model, name).filter(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (operator 1), the one with the smallest id. Null and empty texts
    are one group; of repeated rows one stays; a very long text is hashed whole; an empty table stays empty."""
    return simhash.representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose id has no overlap with a benchmark item (operator 4); rows without an id stay.
    Null and empty texts overlap with nothing; repeated rows go or stay together; a very long text is searched whole; an empty table, or no benchmark, changes nothing."""
    found = stored(decontam.contaminated(docs, load(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts replaced by a mark (operator 7); ``n_chars`` follows the text.
    Null texts stay null; repeated rows and null ids are kept row by row; a very long text is scanned whole; an empty table stays empty."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def bm25_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of all documents, one row per piece (operator 8). A null or empty text is its end id
    alone; repeated rows are documents of their own; a very long text fills as many windows as it needs; an empty table gives no piece."""
    return packing.pack(docs, tokens.tokenizer_path(), end_id=1)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("bm25_packing", bm25_packing),
]

#: Trained scores, components and packing have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written in the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
