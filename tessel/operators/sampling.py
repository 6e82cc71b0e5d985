"""Seeded sampling, distributed row numbering, shuffles and odd-one-out sets.

Randomness is a hash order: ``md5(seed ':' id)`` is the same for any
partitioning and in any engine, so a sample is reproducible and checkable.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, partitions_for
from .vectors import DIST_CELLS, knn

MAX_SAMPLE = 100_000  # rows of a sample taken as one top-n; groups shipped to a task at once


def hash_key(seed, *parts) -> F.Column:
    """``md5(seed ':' part ':' ...)`` as a hex string (orderable)."""
    pieces = [F.lit(str(seed))]
    for p in parts:
        pieces += [F.lit(":"), p.cast("string") if isinstance(p, F.Column) else F.lit(str(p))]
    return F.md5(F.concat(*pieces))


def hash_int(seed, *parts) -> F.Column:
    """First 32 bits of the same md5, as a non-negative long."""
    return F.conv(F.substring(hash_key(seed, *parts), 1, 8), 16, 10).cast("long")


PREFILTER_ROWS = 1_000_000  # n x partitions above which the top-n merge is prefiltered


def _prefilter(keyed: DataFrame, n: int) -> DataFrame:
    """Exact shortcut for a large top-n: the first 32 bits of the md5 key are
    uniform, so keep rows whose prefix is below a threshold expected to hold
    ~4n rows (raised until at least n survive). Every row outside sorts after
    every row inside, so the n smallest keys are among the survivors."""
    total = keyed.count()
    if total <= n:
        return keyed
    prefix = F.conv(F.substring("_k", 1, 8), 16, 10).cast("long")
    limit = 1 << 32
    x = max(1, min(limit, int(limit * 4 * n / total)))
    while True:
        kept = keyed.filter(prefix < F.lit(x))
        if x >= limit or kept.count() >= n:
            return kept
        x = min(limit, x * 4)


def sample_seeded(df: DataFrame, n: int, seed: int = 123, id_col: str = "uid") -> DataFrame:
    """``n`` rows without replacement in hash order, with 0-based ``pos``.
    Planned as a bounded top-n (TakeOrderedAndProject), not a global sort; a
    sample of more than ``MAX_SAMPLE`` rows is cut from the distributed order instead."""
    keyed = df.withColumn("_k", hash_key(seed, F.col(id_col)))
    if n > MAX_SAMPLE:
        numbered = number_rows(_prefilter(keyed, n), ["_k", id_col])
        return numbered.filter(F.col("idx") < n).withColumn("pos", F.col("idx").cast("int")).drop("_k", "idx")
    try:
        parts = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view: plan as is
        parts = 1
    if n * parts > PREFILTER_ROWS:
        keyed = _prefilter(keyed, n)
    top = keyed.orderBy("_k", id_col).limit(n)
    w = Window.orderBy("_k", id_col)  # over at most n rows
    return top.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).drop("_k")


def number_rows(df: DataFrame, order_by: list[str], partitions: int | None = None) -> DataFrame:
    """Global 0-based ``idx`` in ``order_by`` order without a single-partition window.

    Range-partition + sort within partitions, record (partition id, position)
    and materialise to the checkpoint folder (so a lost executor cannot change
    the layout), then add each partition's offset (a table of one row per
    partition, broadcast). ``order_by`` must be unique per row.
    """
    n = partitions or partitions_for(df)
    laid = (df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)
            .withColumn("_pid", F.spark_partition_id())
            .withColumn("_mid", F.monotonically_increasing_id()))
    laid = checkpoint(laid)
    counts = laid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (laid.join(F.broadcast(offsets), "_pid")
            .withColumn("idx", (F.col("_off") + local).cast("long"))
            .drop("_pid", "_mid", "_off"))


def shuffle_rows(df: DataFrame, seed: int = 123, epoch: int = 0, id_col: str = "uid") -> DataFrame:
    """A seeded random order of all rows as a global ``pos``."""
    keyed = df.withColumn("_k", hash_key(seed, epoch, F.col(id_col)))
    return number_rows(keyed, ["_k", id_col]).withColumnRenamed("idx", "pos").drop("_k")


def exclude(df: DataFrame, other: DataFrame, key) -> DataFrame:
    """Rows of ``df`` whose key is not in ``other``."""
    return df.join(other, key, "left_anti")


def odd_one_out(points: DataFrame, n: int = 30, seed: int = 123, id_col: str = "uid",
                vec_col: str = "vec") -> DataFrame:
    """Q1: ``n`` question sets of 4 rows: the centroid's two nearest points
    (self excluded, ties by id), the centroid, and one pseudo-random outsider.

    The outsider of centroid c is the point p outside {nn1, nn2, c} with the
    smallest ``(h(p) + h(c)) mod 2^32`` (ties by id), ``h`` = first 32 bits of
    ``md5(seed ':odd:' id)``. Output ``index, pos, uid, label`` (label 1 only
    for the outsider, pos 0-3 = nn1, nn2, centroid, outsider).

    Plan: the sampled centroids go through ``knn`` (k = 2) and
    ``random_outsiders``; a task emits at most 2 + 4 candidates per centroid, and
    both take any number of centroids.
    """
    cents = checkpoint(sample_seeded(points.select(id_col, vec_col), n, seed, id_col))
    near = checkpoint(knn(cents, points, 2, include_self=False, id_col=id_col, vec_col=vec_col)
                      .select(F.col("q_uid").alias("c"), F.col("uid").alias(id_col), F.col("rank").alias("pos")))
    own = cents.select(F.col(id_col).alias("c"), F.col(id_col), F.lit(2).alias("pos"))
    taken = near.select("c", id_col).unionByName(own.select("c", id_col))
    odd = random_outsiders(points, cents.select(F.col(id_col).alias("c")), taken, seed, id_col, "c").withColumn("pos", F.lit(3))
    rows = near.unionByName(own).unionByName(odd.select("c", id_col, "pos"))
    index = cents.select(F.col(id_col).alias("c"), F.col("pos").alias("index"))  # a row per set
    return rows.join(F.broadcast(index) if n <= MAX_SAMPLE else index, "c").select(
        F.col("index").cast("int").alias("index"), F.col("pos").cast("int").alias("pos"), id_col,
        (F.col("pos") == 3).cast("int").alias("label"))


CAP_TOP_N = 100_000   # caps up to here are one bounded top-n
CAP_CUT_ROWS = 100_000  # rows at the cut that one task may sort
CAP_BOUNDS = 32       # bounds counted in one pass
CAP_SAMPLE = 1024     # keys that bounds are taken from


def cap_rows(df: DataFrame, n: int | None, order_by: list[str], top_n: int = CAP_TOP_N) -> DataFrame:
    """At most ``n`` rows, the first ones in ``order_by`` order (the
    ``max_*_samples`` options); ``None`` keeps every row. Rows equal in ``order_by`` go by a hash of the whole row.

    A small cap is a bounded top-n. For a large one the cut is found by histograms: bounds from a bounded sample of keys, one counting pass,
    then the same between the two bounds around the n-th row, until few rows or a single key are left there. Rows
    below the cut pass a filter, without a shuffle or a merge; rows that are equal in every column are cut by
    counts per partition. Only bounds and counts reach the driver. Nulls come first.
    """
    if n is None:
        return df
    if n <= top_n:
        return df.orderBy(*order_by, F.xxhash64(*df.columns)).limit(n)
    key = F.struct(*[F.col(c) for c in order_by], F.xxhash64(*df.columns).alias("_h"))
    rows = checkpoint(df)  # counted more than once, and the same rows each time
    total = rows.count()
    if total <= n:
        return rows
    keyed = rows.withColumn("_key", key)
    kind = keyed.schema["_key"].dataType

    def bound(row) -> F.Column:
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, kind.fields)])

    below, inside, count, seed = 0, keyed, total, 0  # rows under the interval; the interval and its size
    low = high = None  # its bounds: low <= key < high
    while True:
        span = inside.agg(F.min("_key").alias("a"), F.max("_key").alias("b")).first()
        if count <= CAP_CUT_ROWS or tuple(span["a"]) == tuple(span["b"]):
            break
        share = max(1, count // CAP_SAMPLE)
        sample = [span["b"]] + [r[0] for r in inside.filter(F.pmod(F.xxhash64(F.lit(seed), "_key"), F.lit(share)) == 0)
                                .select("_key").distinct().limit(CAP_SAMPLE).collect()]
        # sorted by Spark, whose order of keys decides
        order = [r[0] for r in rows.sparkSession.createDataFrame([(k,) for k in sample], keyed.select("_key").schema).distinct().orderBy("_key").collect()]
        step = max(1, len(order) // CAP_BOUNDS)
        bounds = order[::step] + ([order[-1]] if (len(order) - 1) % step else [])
        got = inside.agg(*[F.count(F.when(F.col("_key") < bound(b), 1)).alias(f"c{i}") for i, b in enumerate(bounds)]).first()
        at = max((i for i in range(len(bounds)) if below + got[i] <= n), default=None)
        new_low, base = (bounds[at], got[at]) if at is not None else (low, 0)
        new_high, top = (bounds[at + 1 if at is not None else 0], got[at + 1 if at is not None else 0]) if (at is None or at + 1 < len(bounds)) else (high, count)
        below, count, low, high, seed = below + base, top - base, new_low, new_high, seed + 1
        inside = keyed
        if low is not None:
            inside = inside.filter(F.col("_key") >= bound(low))
        if high is not None:
            inside = inside.filter(F.col("_key") < bound(high))
    left = n - below
    first = keyed.filter(F.col("_key") < bound(low)) if low is not None else keyed.limit(0)
    if count <= CAP_CUT_ROWS:
        last = inside.orderBy("_key").limit(left)
    else:  # equal in every column: any ``left`` of them, taken partition by partition
        last = checkpoint(inside.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
        sizes = sorted(map(tuple, last.groupBy("_pid").count().collect()))
        take, quota = left, []
        for pid, size in sizes:
            quota.append((pid, min(size, take)))
            take -= min(size, take)
        limits = rows.sparkSession.createDataFrame(quota, "_pid int, _q long")
        local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
        last = last.join(F.broadcast(limits), "_pid").filter(local < F.col("_q"))  # a row per partition
    return first.select(*df.columns).unionByName(last.select(*df.columns))

def random_outsiders(points: DataFrame, groups: DataFrame, excluded: DataFrame, seed: int = 123,
                     id_col: str = "uid", group_col: str = "g") -> DataFrame:
    """R2: for every group, one pseudo-random point outside that group's
    excluded set: the point p with the smallest ``(h(p) + h(g)) mod 2^32``
    (ties by id), ``h`` = first 32 bits of ``md5(seed ':odd:' id)`` — the same
    rule as the odd-one-out outsider.

    Groups are shipped to every task in blocks of ``MAX_SAMPLE``; a task keeps
    per group the E + 1 smallest keys over all its rows (E = size of that group's excluded
    set), which provably contains the answer, so no (group, point) pair row
    exists. Output ``group_col, id_col``.
    """
    sizes = excluded.groupBy(group_col).agg(F.count(F.lit(1)).alias("_e"))
    asked = checkpoint(groups.select(group_col, hash_int(seed, "odd", F.col(group_col)).alias("_h"))
                       .join(sizes, group_col, "left").withColumn("_e", F.coalesce("_e", F.lit(0))))
    blocks = max(1, -(-asked.count() // MAX_SAMPLE))
    id_type = points.schema[id_col].dataType.simpleString()
    g_type = groups.schema[group_col].dataType.simpleString()
    src = points.select(F.col(id_col).alias("_u"), hash_int(seed, "odd", F.col(id_col)).alias("_h"))
    cand = None
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64(group_col), F.lit(blocks)) == b).toPandas()
        part = src.mapInPandas(_smallest_keys(src, block, group_col), f"{group_col} {g_type}, _u {id_type}, _k long")
        cand = part if cand is None else cand.unionByName(part)
    cand = checkpoint(cand)
    excl = excluded.select(F.col(group_col), F.col(id_col).alias("_u"))
    w = Window.partitionBy(group_col).orderBy("_k", "_u")  # at most (E + 1) x partitions rows per group
    return (cand.join(excl, [group_col, "_u"], "left_anti")
            .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
            .select(group_col, F.col("_u").alias(id_col)))


def _smallest_keys(src: DataFrame, block: pd.DataFrame, group_col: str):
    """The task of ``random_outsiders``: per group the smallest keys of all its batches, emitted once."""
    shipped = src.sparkSession.sparkContext.broadcast(
        (block[group_col].to_numpy(), block["_h"].to_numpy(np.int64), block["_e"].to_numpy(np.int64) + 1))
    cells = DIST_CELLS

    def smallest(batches):
        gids, gh, keep = shipped.value
        best = pd.DataFrame({"g": [], "_k": [], "_u": []})
        for pdf in batches:
            if pdf.empty or not len(gids):
                continue
            pdf = pdf.sort_values("_u", kind="stable")  # ties by id: earlier rows first
            ids, hp = pdf["_u"].to_numpy(), pdf["_h"].to_numpy(np.int64)
            n = len(ids)
            parts = [best]
            for a in range(0, len(gids), step := max(1, cells // n)):
                key = (hp[None, :] + gh[a:a + step, None]) % np.int64(1 << 32)
                k = min(n, int(keep[a:a + step].max()))
                order = key * np.int64(n) + np.arange(n)  # unique: key, then id
                sel = np.argpartition(order, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(order), 1))
                rows = np.repeat(np.arange(a, a + len(order)), k)
                parts.append(pd.DataFrame({"g": rows, "_k": np.take_along_axis(key, sel, axis=1).ravel(), "_u": ids[sel.ravel()]}))
            best = pd.concat([p for p in parts if len(p)], ignore_index=True).sort_values(["g", "_k", "_u"], kind="stable")
            g = best["g"].to_numpy(np.int64)
            best = best[best.groupby("g").cumcount().to_numpy() < keep[g]]
        if len(best):
            yield pd.DataFrame({group_col: gids[best["g"].to_numpy(np.int64)], "_u": best["_u"].to_numpy(), "_k": best["_k"].to_numpy(np.int64)})

    return smallest
