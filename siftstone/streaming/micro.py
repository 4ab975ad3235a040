"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """A new folder for one stream's checkpoint and output, in the shared place."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="siftstone-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, sf_dir: str, table: str, files_per_batch: int = 50) -> DataFrame:
    """A table's files as a stream, so many files a batch."""
    path = f"{sf_dir}/{table}.parquet"
    batch = spark.read.parquet(path)
    reader = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files_per_batch)
    if [f.rstrip("/").rsplit("/", 1)[1] for f in batch.inputFiles()] == [f"{table}.parquet"]:  # one file, not a folder
        return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there, committing each batch, and give the rows written."""
    spark = stream.sparkSession
    place = work_dir(spark)
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def latest_result(stream: DataFrame) -> DataFrame:
    """The whole result of an aggregation after the last batch, in complete mode; each batch writes a new version."""
    spark = stream.sparkSession
    place = work_dir(spark)
    schema = stream.schema

    written: list[int] = []  # a batch without data may write nothing

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/v={number}")
        written.append(number)

    query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{place}/v={written[-1]}") if written else spark.createDataFrame([], schema)


def upsert_latest(stream: DataFrame, key: str, seq: str) -> DataFrame:
    """The latest row of each key, kept up to date batch by batch.

    Each batch merges with the state before it and writes a new version of the state,
    so a batch that is run again gives the same version.
    """
    spark = stream.sparkSession
    place = work_dir(spark)
    schema = stream.schema

    written: list[int] = []

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch
        earlier = [v for v in written if v < number]
        if earlier:
            rows = rows.unionByName(batch.sparkSession.read.schema(schema).parquet(f"{place}/v={earlier[-1]}"))
        latest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(seq)).alias("r")).select("r.*")
        latest.write.mode("overwrite").parquet(f"{place}/v={number}")
        written.append(number)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{place}/v={written[-1]}") if written else spark.createDataFrame([], schema)
