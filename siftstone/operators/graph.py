"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder, its lineage cut; for frames that are used more than once."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if found is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="siftstone-"))
    return df.checkpoint()


#: Rows of a dimension that is broadcast at most.
SMALL_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """`df` marked for broadcast if its rows, counted here, are few; else the join shuffles."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link a node's neighbours to the least of them.

    large: the neighbours greater than the node; else those that are less (edges
    point from the greater to the lesser node then), with the node itself.
    """
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of `edges` (u, v); component is the least node reachable.

    Each round is written to the checkpoint folder, so neither the plan nor the
    loss of an executor grows with the rounds. No node's neighbours meet in one
    task but as counts: the stars are a minimum per node and a join.
    Edges with a null end and loops are left out.
    """
    e = checkpointed(edges.select("u", "v").filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    for _ in range(max_rounds):
        e = checkpointed(_star(_star(e, True), False).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v")).distinct()
