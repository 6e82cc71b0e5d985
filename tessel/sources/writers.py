"""Writers (S7-S15). All go through the DataFrame writer (atomic job commit),
so a lost executor only re-runs its tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V


REPORT_LINE = "*" * 200  # fixed value of the report format: the line behind each query


def write_clean(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Clean table, no index column."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        w.parquet(path)


def write_corpus(clean: DataFrame, path: str, text_col: str = "text", mode: str = "overwrite") -> None:
    """One document per line. Newlines/tabs were removed by P5; a '\\r'
    that survives is written as is, like the source."""
    clean.select(F.col(text_col).alias("value")).write.mode(mode).text(path)


def counts_json(counts: DataFrame, key: str = "lang", n: str = "n") -> DataFrame:
    """S9 body: the counts as one JSON object (one row; #keys is bounded by the language set)."""
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col(n)))))
    return counts.agg(F.to_json(m).alias("value"))


def write_counts(counts: DataFrame, path: str, key: str = "lang", n: str = "n", mode: str = "overwrite") -> None:
    """Language counts as one JSON object in one text file."""
    counts_json(counts, key, n).coalesce(1).write.mode(mode).text(path)


def write_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``uid, vec`` typed Parquet (replaces a pickled object array)."""
    df.write.mode(mode).parquet(path)


def write_map(df: DataFrame, path: str, fmt: str = "parquet", vec_col: str = "vec", mode: str = "overwrite") -> None:
    """The 2-D map with its text columns; the CSV form prints the vector."""
    if fmt == "csv":
        (df.withColumn(vec_col, V.format_vector(F.col(vec_col))).write.mode(mode)
         .options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path))
    else:
        df.write.mode(mode).parquet(path)


def write_sets(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Odd-one-out records ``index, uid, text, label`` as JSON lines."""
    df.orderBy("index", "pos").select("index", "uid", "text", "label").write.mode(mode).json(path)


def write_report(report: DataFrame, path: str, sep: str = REPORT_LINE, mode: str = "overwrite") -> None:
    """Neighbour report as text, one block per query followed by a separator line."""
    body = F.concat(F.lit("indexes "), F.col("q_uid").cast("string"), F.lit("\n"), F.col("report"),
                    F.lit("\n"), F.lit(sep))
    report.select(body.alias("value")).write.mode(mode).text(path)


def write_splits(df: DataFrame, path: str, fmt: str, note: str, by: str = "split", **options) -> list[str]:
    """Write the splits that ``df`` holds below ``path`` and leave all others as they are.

    A split's files are replaced as a whole (dynamic partition overwrite: the new ones are moved in when the job
    commits). The folder ``path`` + ``-manifest`` beside it gets one row per split and write: ``split, rows, note, written``; the last
    one counts (``written_splits``). A frame without rows writes nothing. Returns the splits written.
    """
    from ..session import checkpoint
    df = checkpoint(df)  # the rows counted are the rows written
    counts = df.groupBy(F.col(by).cast("string").alias("split")).agg(F.count(F.lit(1)).alias("rows"))
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by)
    for k, v in options.items():
        w = w.option(k, v)
    w.format(fmt).save(path)
    entries = checkpoint(counts.select("split", "rows", F.lit(note).alias("note"), F.current_timestamp().alias("written")))
    entries.write.mode("append").json(manifest_path(path))
    return sorted(r["split"] for r in entries.select("split").collect())


def manifest_path(path: str) -> str:
    return f"{path.rstrip('/')}-manifest"


def written_splits(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's last row of each split: ``split, rows, note, written``."""
    m = spark.read.schema("split string, rows long, note string, written timestamp").json(manifest_path(path))
    return (m.groupBy("split").agg(F.max(F.struct("written", "rows", "note")).alias("m"))
            .select("split", "m.rows", "m.note", "m.written"))


def write_predictions(df: DataFrame, path: str) -> list[str]:
    """Per split, ``premise, hypothesis, pred, label`` in that order, sorted by
    pred (ties by ``pair_id`` where there is one). Splits that ``df`` does not hold stay."""
    ties = ["pair_id"] if "pair_id" in df.columns else []
    table = (df.orderBy("split", F.desc("pred"), *ties)  # range-partitioned: a large split spans many tasks
             .select("split", "premise", "hypothesis", "pred", "label"))
    return write_splits(table, path, "csv", "predictions", header=True, escape='"',
                        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_metrics(df: DataFrame, path: str) -> list[str]:
    """Metrics per split as JSON. Splits that ``df`` does not hold stay."""
    return write_splits(df, path, "json", "metrics")
