"""Mixing sources to target weights: capped water-filling and seeded repetitions.

A document's size is its number of words `[^\\x20\\x09-\\x0D]+`. All sizes together
are shared out among the sources by weight. A source's target stops at `epochs`
times its own size; what it cannot take is shared again by weight among the rest,
until no source is above its limit. All of it is integer arithmetic up to the last
division, so targets do not depend on the order of rows.

A source with target t and size S takes each document floor(t / S) times, and the
words that remain from one further, partial repetition: its documents in the
order of a seeded hash, until the words are taken; the last of them gives
only as many words as are missing. So each source's taken words are its target,
rounded, and no document exceeds `epochs` times its size. For that order no
source is gathered: sizes are summed by 4,096 ranges of the hash, a running sum
over these finds the one range in which the words end, and only its documents are
ordered.

Null texts count as empty, size 0; a null source is a source. Where all sizes are
0, targets and taken words are 0. Rows with equal ids keep apart by their text;
rows equal in both are taken alike in order. Texts of any length are counted whole; an empty table gives no rows. Extra columns are left out of the
digest, and kept by `mixture`.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.common import checkpointed, give_back, small_batches

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 42
#: Sources at most: their totals meet on the driver.
SOURCES = 500_000
#: Hexadecimal digits of the hash that name its range.
DIGITS = 3


def word_count(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""

    @F.arrow_udf("long")
    def size(column: pa.Array) -> pa.Array:
        give_back()
        return pa.array([len(t.split()) if t else 0 for t in column.cast(pa.binary()).to_pylist()], pa.int64())

    return size(F.col(text) if isinstance(text, str) else text)


def water_fill(sizes: list[int], weights: list[int], epochs: int = EPOCHS) -> list[tuple[int, int]]:
    """Each source's target as an exact fraction (numerator, denominator)."""
    rest, total = set(range(len(sizes))), sum(sizes)
    targets: list[tuple[int, int]] = [(0, 1)] * len(sizes)
    while rest:
        mass = total - epochs * sum(sizes[k] for k in range(len(sizes)) if k not in rest)
        weight = sum(weights[k] for k in rest)
        full = {k for k in rest if weights[k] * mass > epochs * sizes[k] * weight}
        for k in full:
            targets[k] = (epochs * sizes[k], 1)
        rest -= full
        if not full:
            for k in rest:
                targets[k] = (weights[k] * mass, weight)
            break
    return targets


def source_plan(sized: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: source, source_size, target, whole (repetitions), part (words of the partial one).

    The list of sources is configuration, like their weights: its totals come to the
    driver and the plan is broadcast. More than SOURCES of them raise an error.
    """
    spark = sized.sparkSession
    totals = checkpointed(sized.groupBy("source").agg(F.sum("size").alias("n")))
    if totals.limit(SOURCES + 1).count() > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    rows = [(r["source"], r["n"] or 0) for r in totals.collect()]
    rows.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be", "surrogatepass")))
    plan = []
    for (source, n), (top, below) in zip(rows, water_fill([n for _, n in rows], [weights[k % len(weights)] for k in range(len(rows))], epochs), strict=True):
        words = (2 * top + below) // (2 * below)  # the target, rounded half up
        whole = min(epochs, words // n) if n else 0
        plan.append((source, n, top / below, whole, words - whole * n))
    return spark.createDataFrame(plan, "source string, source_size long, target double, whole long, part long")


def _sized(docs: DataFrame, *more: Column, seed: int = SEED) -> DataFrame:
    """What the mix needs of each document: source, size, its place in the seeded order, and `more`."""
    small_batches(docs.sparkSession)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    return docs.select(F.col("source").cast("string").alias("source"), word_count("text").alias("size"), key.alias("_key"), F.substring(key, 1, DIGITS).alias("_range"), *more)


def taken(hashed: DataFrame, sums_of: DataFrame, keep: list[str], weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The rows of `hashed` with source_size, target and taken; `sums_of` are the same rows, stored, to be summed."""
    spark = hashed.sparkSession
    plan = source_plan(sums_of, weights, epochs)
    sums = sums_of.groupBy("source", "_range").agg(F.sum("size").alias("n"))
    over = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = sums["source"].eqNullSafe(plan["source"])
    ranges = sums.withColumn("upto", F.sum("n").over(over)).join(F.broadcast(plan), same).select(sums["source"], "_range", (F.col("upto") - F.col("n")).alias("before"), "upto", "part")
    border = [(r["source"], r["_range"], r["before"]) for r in ranges.filter("before < part and upto > part").select("source", "_range", "before").collect()]
    found = spark.createDataFrame([(s, r, b) for s, r, b in border], "source string, border string, before long")
    ends = spark.createDataFrame([(r["source"], r["m"]) for r in ranges.filter("upto <= part").groupBy("source").agg(F.max("_range").alias("m")).collect()], "source string, full_to string")
    # one row per source: the last range taken whole, and the one in which the words end
    marks = plan.join(found.withColumnRenamed("source", "_s1"), F.col("source").eqNullSafe(F.col("_s1")), "left").join(ends.withColumnRenamed("source", "_s2"), F.col("source").eqNullSafe(F.col("_s2")), "left").drop("_s1", "_s2").withColumnRenamed("source", "_source")
    with_plan = hashed.join(F.broadcast(marks), F.col("source").eqNullSafe(F.col("_source")))
    at_border = F.coalesce(F.col("_range") == F.col("border"), F.lit(False))
    plain = with_plan.filter(~at_border).withColumn("extra", F.when(F.col("_range") <= F.col("full_to"), F.col("size")).otherwise(0))
    order = Window.partitionBy("source").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    inside = with_plan.filter(at_border).withColumn("_ahead", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))).withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("part") - F.col("_ahead")))).drop("_ahead")
    return plain.unionByName(inside).withColumn("taken", F.col("whole") * F.col("size") + F.col("extra")).select(*keep, "size", "source_size", "target", "taken", "whole", "extra")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, whole, extra) of each document."""
    sized = checkpointed(_sized(docs, F.col("doc_id").cast("long").alias("doc_id")))
    return taken(sized, sized, ["doc_id"])


def mixture(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with its own columns only, each as often as the mix takes it.

    A partial repetition gives the whole document if half of it or more is taken, and
    else nothing, as texts are never cut.
    """
    rows = _sized(docs, F.struct(*docs.columns).alias("row"))
    times = F.col("whole") + F.when((F.col("extra") > 0) & (2 * F.col("extra") >= F.col("size")), 1).otherwise(0)
    mixed = taken(rows, checkpointed(_sized(docs)), ["row"]).withColumn("times", times.cast("int")).filter("times > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


#: The same in DuckDB. Water-filling in closed form: limits are reached in the order of size by weight.
SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM sized GROUP BY source),
w AS (SELECT source, n, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY n / w::DOUBLE, source NULLS LAST) AS k, sum(n) OVER ()::BIGINT AS total FROM w),
f AS (SELECT *, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_before,
  sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS w_rest FROM o),
first AS (SELECT min(k) AS k FROM f WHERE w * (total - 3 * n_before) <= 3 * n * w_rest),
level AS (SELECT total - 3 * n_before AS mass, w_rest FROM f JOIN first USING (k)),
t AS (SELECT source, n, CASE WHEN f.k < first.k OR level.mass IS NULL THEN 3 * n ELSE w * mass END AS top,
  CASE WHEN f.k < first.k OR level.mass IS NULL THEN 1 ELSE level.w_rest END AS below FROM f CROSS JOIN first LEFT JOIN level ON true),
p AS (SELECT source, n, top / below::DOUBLE AS target, (2 * top + below) // (2 * below) AS words FROM t),
q AS (SELECT *, CASE WHEN n > 0 THEN least(3, words // n) ELSE 0 END AS whole FROM p),
r AS (SELECT d.doc_id, d.size, q.n, q.target, q.whole, q.words - q.whole * q.n AS part,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, target,
  (whole * size + greatest(0, least(size, part - ahead)))::BIGINT AS taken, whole::BIGINT AS whole,
  greatest(0, least(size, part - ahead))::BIGINT AS extra
FROM r
"""
