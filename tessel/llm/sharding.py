"""Shards of near equal size by longest-processing-time scheduling.

Groups of equal texts stay together. A group larger than a small share of one
shard is scheduled on its own; all smaller groups are first bundled by a hash
of their text into a fixed number of bundles. The driver therefore schedules a
number of items that depends on the shard count alone: largest first, each to
the least loaded shard, through a heap.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

SHARDS = 40
OVERHEAD = 16              # bytes counted for a row besides its text
BUNDLES_PER_SHARD = 256    # small groups of a corpus form this many bundles a shard
ROWS_PER_SLOT_RANGE = 100_000


def schedule(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Shard of every (item, size): longest first to the least loaded shard (ties: smaller item, smaller shard)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, item in sorted(((s, i) for i, s in items), key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(heap)
        out[item] = s
        heapq.heappush(heap, (load + size, s))
    return out


def assign_shards(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD,
                  bundles_per_shard: int = BUNDLES_PER_SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    Size is the text's UTF-8 bytes plus ``overhead``; a null text counts as the
    empty one and shares its group. ``law`` is ``bytes``; ``slot`` numbers a
    shard's rows from 0 without gaps; ``grown_shard`` is null (only a key law fixes
    where rows go when a shard is added). A very long text is a group whose size alone travels. Rows that share an id are rows of their
    own; an empty table gives no row.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    bundles = shards * bundles_per_shard
    rows = stored(docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("_text"),
        F.pmod(F.xxhash64(text), F.lit(bundles)).cast("long").alias("_bundle")), "shard-rows")

    total = rows.agg(F.sum("size").alias("t"), F.count(F.lit(1)).alias("n")).first()
    # fewer groups than this reach the limit: bundles of them at most
    limit = max(1, -(-(total["t"] or 0) // bundles))
    groups = rows.groupBy("_text").agg(F.sum("size").alias("bytes"), F.first("_bundle").alias("_bundle"))
    large = groups.filter(F.col("bytes") >= limit).select("_text", "bytes").collect()
    numbered = [(bytes(r["_text"]), bundles + i, r["bytes"]) for i, r in enumerate(sorted(large, key=lambda r: bytes(r["_text"])))]
    own = spark.createDataFrame([(k, i) for k, i, _ in numbered], "_text binary, _item long")
    placed = rows.join(F.broadcast(own), "_text", "left").withColumn("_item", F.coalesce("_item", "_bundle"))
    sizes = placed.filter(F.col("_item") < bundles).groupBy("_item").agg(F.sum("size").alias("bytes")).collect()
    where = schedule([(r["_item"], r["bytes"]) for r in sizes] + [(i, b) for _, i, b in numbered], shards)
    table = spark.createDataFrame(list(where.items()), "_item long, shard int")
    ranges = max(1, -(-total["n"] // (shards * ROWS_PER_SLOT_RANGE)))
    located = (placed.join(F.broadcast(table), "_item")
               .withColumn("_range", F.pmod(F.xxhash64("doc_id", "_text"), F.lit(max(8, ranges)))))
    # slots: rows are numbered inside (shard, range); ranges start where earlier ones end
    counts = located.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_from"))
    inner = Window.partitionBy("shard", "_range").orderBy("doc_id", "_text")
    return (located.withColumn("_at", F.row_number().over(inner) - 1)
            .join(F.broadcast(starts), ["shard", "_range"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("_from") + F.col("_at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
