"""Connected components of an edge list by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored

FEW, FILE_ROWS = 16, 1 << 20  # a round is written in so few files, or in files of so many edges


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a``, ``b`` long): ``root`` is the
    smallest node reachable. A large-star and a small-star step replace each edge
    until nothing changes; each round only shuffles edges, and its result is
    written to the shared folder. Null ends and loops are dropped; an empty
    edge list gives an empty table.
    """
    cur = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .filter("u is not null and v is not null and u <> v").distinct(), name)
    rows, state = cur.count(), None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # every larger neighbour of a node joins the node's smallest neighbour
        large = (both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        # every smaller neighbour, and the node, joins the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        cur = stored(small.coalesce(max(FEW, rows // FILE_ROWS + 1)), name)  # a round never has more edges than the one before
        now = tuple(cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            # a star forest: each node hangs on its root
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        rows, state = now[0], now
