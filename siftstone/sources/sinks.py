"""Report sinks: plans are DataFrames, and nothing is written unless asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame


def csv_report(df: DataFrame, path: str, columns: list[str]) -> None:
    """A report with fixed columns in this order; the file appears only when complete."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def union_of_keys(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; the columns are those of any, in first-seen order."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def versioned(df: DataFrame, root: str, run_id: str) -> str:
    """Write one run's version of a table beside the earlier ones, which stay as backups."""
    path = f"{root}/run={run_id}"
    df.write.mode("error").parquet(path)
    return path


def commit(plan: DataFrame, path: str, apply: bool = False) -> DataFrame:
    """The plan itself (a dry run), written as well if `apply`."""
    if apply:
        plan.write.mode("overwrite").parquet(path)
    return plan


def replace_table(df: DataFrame, path: str, run_id: str) -> str:
    """Overwrite a table so that readers see the old or the new one, and keep the old as a backup.

    The new rows go to a folder of their own first; renames follow only when they are complete.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    new, backup = f"{path}.tmp.{run_id}", f"{path}.bak.{run_id}"
    df.write.mode("overwrite").parquet(new)
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at):
        fs.rename(at, jvm.org.apache.hadoop.fs.Path(backup))
    fs.rename(jvm.org.apache.hadoop.fs.Path(new), at)
    return backup
