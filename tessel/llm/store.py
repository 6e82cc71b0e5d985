"""Tables written once in the shared folder the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


BATCH_BYTES = 4 << 20  # bytes of an Arrow batch between the JVM and Python


def bounded_batches(df: DataFrame) -> DataFrame:
    """The frame; its session cuts Arrow batches at ``BATCH_BYTES`` from now on, so that
    a batch of long texts stays small on both sides."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the frame as Parquet in the shared folder and read it back: computed
    once, lineage cut, readable from any executor. The folder stays until the
    job's shared folder is cleared."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boxed(df: DataFrame, **columns: Column) -> DataFrame:
    """Whole rows in one column ``row`` beside the given ones, whose names so never clash with the rows' own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[e.alias(c) for c, e in columns.items()])


def unboxed(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The rows of a boxed frame again, some columns replaced."""
    return df.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in columns])
