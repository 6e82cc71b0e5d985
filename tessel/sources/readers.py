"""Readers (S1-S6). Spark's own reader takes a CSV file with quoted newlines as one task;
``read_posts_ranges`` reads it in byte ranges. A job converts it to Parquet once
(``csv_to_parquet``) and reads Parquet after."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators.text import na_to_null
from . import schemas


def csv_by_name(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Named string columns of a CSV with a header, wherever they stand and whatever
    else the file holds; a name that is missing raises. Quoted fields may span lines,
    quotes are doubled, rows end in '\\n' ('\\r' stays in the field), and NA words
    become NULL (P1)."""
    df = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
          .option("lineSep", "\n").option("mode", "PERMISSIVE")
          .option("emptyValue", "").csv(path))
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header ({', '.join(df.columns)})")
    return na_to_null(df.select(*[F.col(f"`{c}`") for c in columns]))


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Raw posts CSV, columns by header name, one task per file (see ``read_posts_ranges``)."""
    return csv_by_name(spark, path, schemas.POSTS.names)


def read_posts_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Raw posts CSV, columns by header name, one task per byte range of a file."""
    from .ranges import read_csv_ranges
    return read_csv_ranges(spark, path, schemas.POSTS.names)


def csv_to_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def read_clean(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The clean table (``uid, text, img_dir, img_fname``)."""
    if fmt == "csv":
        return csv_by_name(spark, path, schemas.CLEAN.names)
    return spark.read.schema(schemas.CLEAN).parquet(path)


def read_pairs(spark: SparkSession, root: str, splits: list[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """S3: labelled pairs stored as ``root/split=<name>/``; a split filter is a
    partition filter, so unneeded splits are never listed or read."""
    reader = spark.read.option("basePath", root)
    df = reader.parquet(root) if fmt == "parquet" else reader.schema(schemas.PAIRS_WITH_SPLIT).json(root)
    if splits:
        df = df.filter(F.col("split").isin(splits))
    return df


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``uid, vec array<float>`` Parquet; math is done in double."""
    return spark.read.parquet(path).select("uid", F.col("vec").cast("array<double>").alias("vec"))


def read_map_csv(spark: SparkSession, path: str, dim: int = 2) -> DataFrame:
    """Map CSV with at least ``uid, text, vec`` (an index column without a name
    and image columns may stand beside them) whose ``vec`` cell holds a printed
    vector ``[x  y]``; parsed fully (P14), then only vectors of width ``dim`` kept (P15)."""
    df = csv_by_name(spark, path, schemas.MAP_CSV.names)
    return df.withColumn("vec", V.parse_vector("vec")).filter(F.size("vec") == dim)


def read_predictions(spark: SparkSession, path: str, splits: list[str] | None = None) -> DataFrame:
    """The tables of ``writers.write_predictions``; a split filter is a partition filter."""
    df = (spark.read.schema("premise string, hypothesis string, pred double, label int, split string")
          .options(header=True, multiLine=True, quote='"', escape='"', lineSep="\n").csv(path))
    return df.filter(F.col("split").isin(splits)) if splits else df


def list_images(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """The image files under ``root`` as ``path`` (no bytes are read)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob).load(root).select("path"))


def read_images(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Image files under ``root`` as ``path, content`` (binary)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob).load(root).select("path", "content"))


def _stem(path, root: str):
    """Path below ``root`` without scheme and host, and its file name only up to the first dot."""
    plain = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    at = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    below = F.when(F.startswith(plain, F.lit(at)), F.substr(plain, F.lit(len(at) + 1))).otherwise(plain)
    return F.concat(F.regexp_extract(below, "^(.*/)?", 0), F.substring_index(F.substring_index(below, "/", -1), ".", 1))


def attach_images(captions: DataFrame, root: str, path_col: str = "img_fpath", glob: str = "*") -> DataFrame:
    """Caption rows with the image file of their path: ``image_path, content, has_image``.

    Caption paths may be relative to ``root`` or absolute, with any scheme or
    none, with or without an extension (the clean table keeps none). Of several
    files that differ in the extension only, the first by name is taken. Only paths
    are joined; the bytes of the files found are loaded after the join.
    """
    files = list_images(captions.sparkSession, root, glob)
    names = files.groupBy(_stem(F.col("path"), root).alias("_stem")).agg(F.min("path").alias("image_path"))
    found = captions.withColumn("_stem", _stem(F.col(path_col), root)).join(names, "_stem", "left").drop("_stem")

    @F.pandas_udf("binary")
    def load(paths: pd.Series) -> pd.Series:
        from pyarrow import fs
        out = []
        for p in paths:
            if p is None:
                out.append(None)
                continue
            system, at = fs.FileSystem.from_uri(p if "://" in p else p.replace(":/", ":///", 1))
            with system.open_input_file(at) as f:
                out.append(f.read())
        return pd.Series(out)

    return found.withColumn("content", load("image_path")).withColumn("has_image", F.col("image_path").isNotNull())
