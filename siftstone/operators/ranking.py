"""Ranks, numbers and samples without gathering a table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.operators.graph import checkpointed, small


def most_common(df: DataFrame, group: str, value: str, position: str, k: int) -> DataFrame:
    """(group, top): the k most common values as value=count, ties to the one seen first."""
    c = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    ranked = c.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "first"))).filter(F.col("rn") <= k)
    items = F.array_sort(F.collect_list(F.struct("rn", F.concat_ws("=", F.col(value), F.col("n").cast("string")).alias("s"))))
    return ranked.groupBy(group).agg(F.array_join(F.transform(items, lambda x: x["s"]), ",").alias("top"))


def rank_percentiles(df: DataFrame, group: str, x: str, ranks: dict[str, tuple[int, int]], *more: Column) -> DataFrame:
    """Values at rank n * a div b (from 0) of each group; counts of equal values come first, so ranks are sums over distinct values."""
    values = df.groupBy(group, x).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(group).orderBy(x)
    upto = values.withColumn("upto", F.sum("c").over(order)).join(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group)
    at = lambda a, b: F.floor(F.lit(a) * F.col("n") / b)
    picks = [F.min(F.when(F.col("upto") > at(a, b), F.col(x))).alias(name) for name, (a, b) in ranks.items()]
    return upto.groupBy(group).agg(*picks).join(df.groupBy(group).agg(*more), group) if more else upto.groupBy(group).agg(*picks)


def global_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 0 in a total order, by a range partitioning.

    Each partition numbers its rows; partitions' counts (one row each) give where each begins. The ranges
    come from a sample, which another execution would draw anew: so the numbered rows are written once, and both are read from there.
    """
    spark = df.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = df.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    # the id holds the partition in its upper bits and the row in the lower 33
    part, row = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = checkpointed(parted.select(*df.columns, part.alias("_part"), row.alias("_row")))
    counts = {r["_part"]: r["n"] for r in numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    if not starts:
        return df.withColumn(name, F.lit(0).cast("long"))
    begin = spark.createDataFrame(starts, "_part long, _start long")
    return numbered.join(F.broadcast(begin), "_part").select(*df.columns, (F.col("_start") + F.col("_row")).alias(name))


def group_index(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 0 in order within each group, however many rows a group has: a global order by group, less where the group begins."""
    numbered = global_index(df, [*[F.asc(g) for g in group], *order], "_at")
    begin = numbered.groupBy(*group).agg(F.min("_at").alias("_begin"))
    on = [F.col(f"_n.{g}").eqNullSafe(F.col(f"_b.{g}")) for g in group]
    joined = numbered.alias("_n").join(small(begin).alias("_b"), on)
    return joined.select(*[F.col(f"_n.{c}").alias(c) for c in df.columns], (F.col("_at") - F.col("_begin")).alias(name))


def best(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """(doc_id, rank) of the first k rows of a total order; only k rows are ever numbered."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).select("doc_id", "rank")


def collision_suffix(df: DataFrame, dest: str, order: str, ext: str) -> DataFrame:
    """The second and further rows of one destination get __2, __3 ..."""
    rn = F.col("_rn") + 1
    return group_index(df, [dest], [F.asc(order)], "_rn").withColumn("_rn", rn).withColumn(dest, F.concat(F.col(dest), F.when(F.col("_rn") > 1, F.concat(F.lit("__"), F.col("_rn").cast("string"))).otherwise(""), F.lit(ext))).drop("_rn")


def stride_sample(df: DataFrame, order: str, k: int) -> DataFrame:
    """k rows evenly spaced in order: indexes round(i * last / (k - 1)), halves to even; all for k <= 0."""
    if k <= 0:
        return df
    n = df.count()
    picks = sorted({round(i * (n - 1) / (k - 1)) for i in range(k)}) if k > 1 and n else [0]
    wanted = df.sparkSession.createDataFrame([(p,) for p in picks], "_i long")
    return global_index(df, [F.asc(order)], "_i").join(F.broadcast(wanted), "_i", "left_semi").drop("_i")
