"""Data-quality findings, their rollup, and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.operators.graph import small

SEVERITIES = ("info", "warning", "error")


def findings(df: DataFrame, id_col: str, checks: list[tuple[Column, str, str]]) -> DataFrame:
    """(id, severity, code) of every check (condition, severity, code) that a row fails, in one pass."""
    all_ = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(code).alias("code"))) for c, s, code in checks]))
    return df.select(F.col(id_col).cast("string").alias("id"), F.explode(all_).alias("f")).select("id", "f.severity", "f.code")


def integrity(entries: DataFrame, signatures: DataFrame, files: DataFrame, header: DataFrame, version: int, config: str, dim: int, magic: str) -> DataFrame:
    """(id, severity, code) of all failed checks of a store.

    entries (id, src, k, v, payload), signatures (src, sig), files (src, sig, readable) and header, one row (version, config).
    Of the store: version, config, whether it is empty (id is ''). Of entries: no source, no vector, another
    dimension, no payload, a payload without the magic prefix, an entry that is there twice, a source without
    a signature. Of signatures: a file that is missing, unreadable or modified (id is the source).
    """
    twice = entries.groupBy("src", "k").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 and src is not null").select("src", "k", F.lit(True).alias("_twice"))
    signed = signatures.select("src", F.lit(True).alias("_signed")).distinct()
    rows = entries.join(twice, ["src", "k"], "left").join(signed, "src", "left")
    payload = F.col("payload")
    no_vector = F.col("v").isNull() | (F.size("v") == 0)
    of_entries = findings(
        rows,
        "id",
        [
            (F.col("src").isNull() | (F.col("src") == ""), "error", "missing_src"),
            (no_vector, "error", "missing_embedding"),
            (~no_vector & (F.size("v") != dim), "error", "wrong_embedding_shape"),
            (payload.isNull() | (payload == ""), "error", "missing_payload"),
            (~payload.startswith(magic) & (payload != ""), "warning", "payload_without_magic"),
            (F.col("_twice"), "error", "duplicate_entry"),
            (F.col("src").isNotNull() & F.col("_signed").isNull(), "error", "entry_without_signature"),
        ],
    )
    there = signatures.select("src", "sig").join(files.select("src", F.col("sig").alias("_now"), "readable", F.lit(True).alias("_there")), "src", "left")
    of_files = findings(
        there,
        "src",
        [
            (F.col("_there").isNull(), "warning", "file_missing"),
            (F.col("_there") & ~F.col("readable"), "warning", "file_unreadable"),
            (F.col("readable") & (F.col("_now") != F.col("sig")), "warning", "file_modified"),
        ],
    )
    held = entries.agg(F.count(F.lit(1)).alias("_entries")).crossJoin(signatures.agg(F.count(F.lit(1)).alias("_signatures")))  # one row each
    of_store = findings(
        header.select(F.lit("").alias("id"), "version", "config").join(F.broadcast(held), F.lit(True)),
        "id",
        [
            (~F.col("version").eqNullSafe(F.lit(version)), "error", "version_mismatch"),
            (~F.col("config").eqNullSafe(F.lit(config)), "warning", "config_changed"),
            (F.col("_entries") + F.col("_signatures") == 0, "warning", "empty_store"),
        ],
    )
    return of_entries.unionByName(of_files).unionByName(of_store)


def rollup(found: DataFrame, samples: int = 3) -> DataFrame:
    """(severity, code, n, samples): the count of each kind of finding and its least ids, joined by commas.

    The window keeps `samples` rows a kind, and Spark cuts each task's rows to them before the shuffle.
    """
    kind = ["severity", "code"]
    counts = found.groupBy(*kind).agg(F.count(F.lit(1)).alias("n"))
    first = found.withColumn("_at", F.row_number().over(Window.partitionBy(*kind).orderBy("id"))).filter(F.col("_at") <= samples)
    shown = first.groupBy(*kind).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("samples"))
    return counts.join(shown, kind).select(*kind, "n", "samples")


def exit_code(found: DataFrame) -> DataFrame:
    """One row (code): 2 with errors, 1 with warnings, else 0."""
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    return found.agg(F.coalesce(F.max(rank), F.lit(0)).alias("code"))


def order_violations(steps: DataFrame, required: DataFrame) -> DataFrame:
    """(before, after, ok) for required pairs of steps (name, ord)."""
    b = steps.select(F.col("name").alias("before"), F.col("ord").alias("b"))
    a = steps.select(F.col("name").alias("after"), F.col("ord").alias("a"))
    return required.join(small(b), "before", "left").join(small(a), "after", "left").select("before", "after", F.coalesce(F.col("b") < F.col("a"), F.lit(False)).alias("ok"))
