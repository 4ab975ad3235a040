"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone import make_importable

#: Rows of one Arrow batch. Texts may be long, so a batch holds few of them.
BATCH_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is absent (tests, local mode) a temporary folder is used;
    on a cluster the setting is required, as no machine's own folder would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(shared_dir, "own", None)
        if found is None:
            found = shared_dir.own = tempfile.mkdtemp(prefix="siftstone-")
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, its lineage cut."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a Parquet table in the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, and thereby the memory of a Python worker."""
    make_importable(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    make_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the columns that the text operators use; any other column is left out."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def held_out(doc_id="doc_id"):
    """True for the fifth of the documents from which nothing may be learned; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


_given_back = 0.0
#: Seconds after which a worker drops what an operator keeps from batch to batch, if it does not come back to it.
IDLE = 10.0


class Kept:
    """What an operator's workers keep: one object for each key, made when first asked for."""

    all: list[Kept] = []

    def __init__(self, make):
        self.make, self.made, self.used = make, {}, 0.0
        Kept.all.append(self)

    def get(self, *key):
        self.used = time.monotonic()
        if key not in self.made:
            self.made[key] = self.make(*key)
        return self.made[key]


def give_back() -> None:
    """Return a Python worker's free memory to the machine, once a second at most.

    Workers outlive their tasks and serve other operators, and the allocators would keep what a batch has used.
    """
    global _given_back
    if time.monotonic() - _given_back < 1.0:
        return
    _given_back = time.monotonic()
    for kept in Kept.all:
        if _given_back - kept.used > IDLE:
            kept.made.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def pieces(texts: list, size: int):
    """Slices of a list of bytes, each of about `size` bytes (one text at least)."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
