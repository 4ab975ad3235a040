"""Snapshots of entries, guards over counts, ledgers and incremental state."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.operators.graph import checkpointed


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status) of two snapshots (path, entity, size, mtime).

    By path: matched, size_changed, missing, extra. A missing entry and an extra one of equal
    (entity, size, mtime) are one renamed entry; equal ones pair in the order of their paths.
    A changed entry's new state counts as extra as well, for its path is not matched.
    """
    b = before.select("path", F.col("entity").alias("be"), F.col("size").alias("bs"), F.col("mtime").alias("bm"))
    a = after.select("path", F.col("entity").alias("ae"), F.col("size").alias("s"), F.col("mtime").alias("am"))
    both = b.join(a, "path", "full")
    gone = F.col("s").isNull()
    new = F.col("bs").isNull() | (F.col("s") != F.col("bs"))
    signed = lambda df, e, s, m: df.select("path", F.col(e).alias("e"), F.col(s).alias("z"), F.col(m).alias("m"))
    lost, extra = signed(both.filter(gone), "be", "bs", "bm"), signed(both.filter(~gone & new), "ae", "s", "am")
    rank = lambda df, name: df.withColumn("rn", F.row_number().over(Window.partitionBy("e", "z", "m").orderBy("path"))).withColumnRenamed("path", name)
    pairs = rank(lost, "path").join(rank(extra, "new_path"), ["e", "z", "m", "rn"]).select("path", "new_path")
    status = F.when(gone & F.col("new_path").isNotNull(), "renamed").when(gone, "missing").when(F.col("s") != F.col("bs"), "size_changed").otherwise("matched")
    known = both.filter(F.col("bs").isNotNull()).join(pairs, "path", "left").select("path", status.alias("status"))
    return known.unionByName(extra.join(pairs.select(F.col("new_path").alias("path")), "path", "left_anti").select("path", F.lit("extra").alias("status")))


def verdict(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row (missing, changed, verdict): a snapshot may be promoted if both are 0."""
    both = before.select("path", "size").join(after.select("path", F.col("size").alias("now")), "path", "left")
    counts = both.agg(F.count_if(F.col("now").isNull()).alias("missing"), F.count_if(F.col("now") != F.col("size")).alias("changed"))
    return counts.withColumn("verdict", F.when(F.col("missing") + F.col("changed") == 0, "promote").otherwise("block"))


def with_floor(counts: DataFrame, entity: str, run: str, n: str) -> DataFrame:
    """Adds `floor`: the most an entity had in any earlier run (null in its first)."""
    earlier = Window.partitionBy(entity).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("floor", F.max(n).over(earlier))


def latest_state(log: DataFrame, key: str, seq: str, columns: list[str], *more: Column) -> DataFrame:
    """The last event of each key; combined before the shuffle."""
    return log.groupBy(key).agg(*[F.max_by(c, seq).alias(c) for c in columns], F.max(seq).alias(seq), *more)


def chain_ends(steps: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b): where the chain of renames that starts at a ends. Each round doubles the steps taken."""
    now = checkpointed(steps.select("a", "b"))
    for _ in range(max_rounds):
        on = now.select(F.col("a").alias("b"), F.col("b").alias("c"))
        further = now.join(on, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved"))
        further = checkpointed(further)
        now = further.select("a", "b")
        if further.filter("moved").isEmpty():
            return now
    raise RuntimeError("the renames run in a circle")


#: Ids of one range of a signature.
SIGNED = 1000


def content_signature(df: DataFrame, entity: str, order: str, value: Column, *more: Column) -> DataFrame:
    """(entity, sig, ...): sha256 over the digests of an entity's ranges of SIGNED ids, in order.

    A range's digest is the sha256 of its members `order:value`, one a line, in order; so no row holds more than a range's members
    or an entity's digests. `order` is an integer.
    """
    line = F.concat_ws(":", F.col(order).cast("string"), value.cast("string"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["line"]), "\n")
    part = F.floor(F.col(order) / SIGNED)
    parts = df.groupBy(entity, part.alias("_part")).agg(F.sha2(joined(F.struct(F.col(order).alias("o"), line.alias("line"))), 256).alias("_sig"))
    signed = parts.groupBy(entity).agg(F.sha2(joined(F.struct(F.col("_part").alias("o"), F.col("_sig").alias("line"))), 256).alias("sig"))
    return signed.join(df.groupBy(entity).agg(*more), entity) if more else signed


#: Targets of an entity at most.
RESTORED = 5_000_000


def remainder(rows: DataFrame, names: DataFrame, placeholder: str = "person_") -> tuple[DataFrame, DataFrame]:
    """(rows, names) that stay in a session: those of clusters (id, cluster; cluster, name) that still have a placeholder's name; cluster -1 is none."""
    left = names.filter(F.col("name").startswith(placeholder) & (F.col("cluster") != -1))
    return rows.join(left.select("cluster"), "cluster", "left_semi").select("id", "cluster"), left


def save_session(rows: DataFrame, names: DataFrame, path: str, version: int = 1) -> None:
    """A session's tables, each row with the version of the format; what was there is replaced."""
    rows.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/rows")
    names.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/names")


def load_session(spark: SparkSession, path: str, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """A saved session's (rows, names); rows of another version are left out."""
    read = lambda name: spark.read.parquet(f"{path}/{name}").filter(F.col("version") == version).drop("version")
    return read("rows"), read("names")


def cache_aside(rows: DataFrame, cache: DataFrame, attempt: Callable[[int], Column], retries: int = 3) -> DataFrame:
    """(id, hash, value, outcome) of rows (id, hash), each content's value taken from `cache` (hash, value) or asked for once.

    attempt(k) gives the struct (value, error) of the k-th call for `hash`, k from 0: an error "fatal" ends the calls, any other is tried again,
    `retries` times at most. An empty value is a known unknown, which is not asked for again.
    outcome: hit, known_unknown, called, unknown (called, without a value), fatal, failed.
    """
    known = rows.join(cache.select("hash", F.col("value").alias("_known")), "hash", "left")
    asked = known.filter("_known is null").select("hash").distinct()
    tries = [attempt(k) for k in range(retries + 1)]
    settled = F.filter(F.array(*tries), lambda t: t["error"].isNull() | (t["error"] == "fatal"))
    answers = asked.select("hash", F.get(settled, F.lit(0)).alias("_got"))
    got = known.join(answers, "hash", "left")
    called = F.when(F.col("_got").isNull(), "failed").when(F.col("_got.error") == "fatal", "fatal").when(F.coalesce(F.col("_got.value"), F.lit("")) == "", "unknown").otherwise("called")
    outcome = F.when(F.col("_known") == "", "known_unknown").when(F.col("_known").isNotNull(), "hit").otherwise(called)
    return got.select("id", "hash", F.nullif(F.coalesce("_known", "_got.value"), F.lit("")).alias("value"), outcome.alias("outcome"))


def sequential_restore(targets: DataFrame) -> DataFrame:
    """(entity, id, status) of targets (entity, id, digest, look), in order of id within an entity.

    A digest that is there makes a target already_present; a look restored before makes it
    duplicate_target_skipped; else it is restored, and both are there from then on.
    Order decides within an entity, so that is one task's work, on hashes only; an entity of more than
    RESTORED targets raises an error.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > RESTORED:
            raise ValueError(f"an entity of {len(pdf)} targets is one task's work here, {RESTORED} at most")
        digests, looks, status = set(), set(), []
        pdf = pdf.sort_values("id")
        for digest, look in zip(pdf.digest, pdf.look, strict=True):
            if digest in digests:
                status.append("already_present")
            elif look in looks:
                status.append("duplicate_target_skipped")
            else:
                digests.add(digest)
                looks.add(look)
                status.append("restored")
        return pd.DataFrame({"entity": pdf.entity, "id": pdf.id, "status": status})

    return targets.select("entity", "id", "digest", "look").groupBy("entity").applyInPandas(run, "entity string, id long, status string")
