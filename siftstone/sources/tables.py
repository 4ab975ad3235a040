"""Readers with explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone import make_importable

LEDGER_SCHEMA = "seq long, op string, status string, source struct<path:string,size:long>, dest struct<path:string,size:long>, extra map<string,string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    make_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents; a corrupt one gives nulls instead of an error."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def jsonl_log(spark: SparkSession, path: str, schema: str = LEDGER_SCHEMA) -> DataFrame:
    """An append-only log of JSON lines with the file of each; blank and broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).select("*", F.col("_metadata.file_path").alias("log_file"), F.col("_metadata.file_modification_time").alias("log_time"))


def csv_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header, all columns text; casts are for the reader of the table."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).csv(path)


def file_listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, modified, size) of all files below `root`; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def tagged_union(roots: list[tuple[str, DataFrame]]) -> DataFrame:
    """One table of several roots, each row with its root's name and priority (0 first)."""
    out = None
    for k, (name, df) in enumerate(roots):
        one = df.withColumn("root", F.lit(name)).withColumn("root_rank", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def excluded(path, names: list[str]):
    """True if a directory of the path is named so (any case) or begins with a dot."""
    parts = F.split(F.lower(path), "/")
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(dirs, lambda p: p.isin([n.lower() for n in names]) | p.startswith("."))
