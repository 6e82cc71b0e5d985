"""Session construction, checkpoint directory and table loading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

SPREAD_BELOW = 16  # inputs of at least so many splits are never dealt anew


def get_spark(master: str | None = None, app: str = "tessel",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    On a cluster the master and resources come from spark-submit; ``master`` is
    only for local runs and tests.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         # post-shuffle partitions of ~128 MB; AQE coalesces small ones and splits skewed joins
         .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(128 << 20))
         # checkpoint files are deleted once their DataFrame is garbage-collected,
         # so the shared checkpoint folder does not grow job after job
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; invent one only locally.

    A machine-local folder is only acceptable when the whole job runs in one
    JVM (``local[...]`` master), i.e. in tests and benchmarks.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns spark.checkpoint.dir
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
    elif sc.master.startswith("local"):
        local_dir = tempfile.mkdtemp(prefix="tessel-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", local_dir)
        sc.setCheckpointDir(local_dir)
    else:
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    return sc.getCheckpointDir()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Deal the (already projected) rows of a small input to more tasks.

    A file that is a single row group is one input split, and all heavy work per
    row (regex, explode) would run in one task. The number of partitions is only
    ever raised, to the session's shuffle partitions; inputs with as many splits
    keep them, without a shuffle. Nothing is cached.
    """
    want = min_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    try:
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (Spark Connect): leave the plan as is
        return df
    return df.repartition(want) if have < min(want, SPREAD_BELOW) else df


def size_estimate(df: DataFrame) -> int | None:
    """Bytes of the rows by the optimizer's estimate, if there is one."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # py4j gives an int or a BigInt object
    except Exception:  # noqa: BLE001 - no estimate (Spark Connect)
        return None


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def partitions_for(df: DataFrame, bytes_each: int = 128 << 20) -> int:
    """Partitions of about ``bytes_each`` by the optimizer's size estimate, at least the session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = size_estimate(df)
    return least if size is None else max(least, min(size // bytes_each + 1, 1_000_000))


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (cuts lineage, survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Have the files of shuffles deleted that no frame can read any more: Spark does so when the driver's JVM has collected
    its garbage, which may not come up for as long as a job runs. Not more than a hint."""
    try:
        spark.sparkContext._jvm.System.gc()
    except Exception:  # noqa: BLE001 - Spark Connect: the server sees to it
        pass
