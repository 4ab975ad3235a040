"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector, padded with zeros to a power of two, goes through three rounds of
random signs and a fast Hadamard transform; its axis is the signed axis that lies
nearest to the result. A bucket of one of TABLES tables is the axis of one such pseudo-rotation, or the axes of
two, so that buckets grow with the index: two as soon as one would leave more than BUCKET_ROWS vectors in a bucket. A query looks
into the buckets nearest to it in every table (multiprobe: those of the largest sum of its components along their axes), and what it finds
there is ranked by the exact cosine of the original vectors in double precision.

How many buckets a query must look into depends on the data: neighbours that are near share its first ones, those of data without
near neighbours lie anywhere. So the number is measured: SAMPLED queries, those with the least hash of their ids, are compared with the whole index
by brute force (work that grows with the index only), and the least number of probes that finds TARGET of their neighbours is taken.

Equal vectors are one class of the index, with its least ids, so a vector that a third of all rows hold is one row here. An index row
goes to one block of its bucket in each table and stays there; queries, a small part of the rows, travel to the blocks. Only where a bucket has more
than QUERY_BLOCK queries do its blocks stand once for each so many of them. A block hands on its k best per query only. A query that finds fewer than k rows is compared with
all of one table, so it gets all candidates if there are fewer than k.

Vectors that are null, zero, empty, or hold null or non-finite components take no part;
vectors of other lengths are never compared with each other, tiny ones are scaled by a power of two, which changes no cosine. Of rows with one id the best
score counts; a query's own id is no candidate; repeated rows count once. An empty table gives no rows. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.llm.common import checkpointed

TABLES = 4
K = 5
SEED = 42
#: Queries that the number of probes is measured with, and the share of their neighbours that it must find.
SAMPLED, TARGET = 256, 0.98
#: Vectors of a bucket, on average, beyond which a bucket takes two rotations.
BUCKET_ROWS = 4096
#: Index rows and queries of a block, about.
INDEX_BLOCK, QUERY_BLOCK = 8192, 32_768


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep its length."""
    n, width = rows.shape
    half = 1
    while half < width:
        pairs = rows.reshape(n, width // (2 * half), 2, half)
        rows = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, width)
        half *= 2
    return rows / np.sqrt(width)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors whose largest component lies between 1/2 and 1: times a power of two, which changes no digit."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None]) + 0.0


def axes(vectors: np.ndarray, table: int, level: int) -> np.ndarray:
    """Each vector's components along the signed axes of one pseudo-rotation: axis k at 2k, its opposite at 2k + 1."""
    n, dim = vectors.shape
    width = 1 << max(0, dim - 1).bit_length()
    signs = np.random.default_rng([SEED, table, width, level]).choice([-1.0, 1.0], (3, width))
    rows = np.zeros((n, width))
    rows[:, :dim] = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    for s in signs:
        rows = hadamard(rows * s)
    return np.stack([rows, -rows], axis=2).reshape(n, -1)


def buckets(vectors: np.ndarray, table: int, levels: int, probes: int = 1) -> np.ndarray:
    """The `probes` nearest buckets of each (scaled) vector, nearest first."""
    near = axes(vectors, table, 0)
    if levels == 2:
        if probes == 1:
            return (near.argmax(1) * near.shape[1] + axes(vectors, table, 1).argmax(1))[:, None]
        near = (near[:, :, None] + axes(vectors, table, 1)[:, None, :]).reshape(len(near), -1)
    return np.argsort(-near, axis=1, kind="stable")[:, :probes]


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vec): vectors that take part, as doubles."""
    vec = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & F.exists(vec, lambda x: x != 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), fine.alias("fine")).filter("fine").select("id", "vec")


def _matrix(batch, dim_rows) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("vec").take(pa.array(dim_rows)).to_pylist()), np.float64).reshape(len(dim_rows), -1)


def _by_dim(batch):
    """(dim, positions, matrix) for the vectors of each length, in pieces."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        for k in range(0, len(at), 1024):
            yield int(dim), at[k : k + 1024], _matrix(batch, at[k : k + 1024])


def vector_classes(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of `usable` vectors: (id, class), and (class, dim, vec, least, ids) of equal vectors with their k + 1 least ids."""

    def run(batches):
        for batch in batches:
            column = batch.column("vec")
            size = np.diff(column.offsets.to_numpy())
            flat, start = column.values.to_numpy(), column.offsets.to_numpy()[:-1]
            vec: list[bytes] = [b""] * len(size)
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                for i, row in zip(at, scaled(flat[start[at][:, None] + np.arange(dim)]), strict=True):
                    vec[i] = row.tobytes()
            names = [xxhash.xxh3_128_hexdigest(v) for v in vec]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(size.astype(np.int64)), pa.array(vec, pa.binary())], ["id", "class", "dim", "vec"])

    rows = checkpointed(vectors.mapInArrow(run, "id long, class string, dim long, vec binary"))
    members = rows.select("id", "class").distinct()
    first = members.withColumn("at", F.row_number().over(Window.partitionBy("class").orderBy("id"))).filter(F.col("at") <= k + 1)
    ids = first.groupBy("class").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    one = rows.groupBy("class").agg(F.min("dim").alias("dim"), F.min("vec").alias("vec"))
    return members, checkpointed(one.join(ids, "class").select("class", "dim", "vec", F.col("ids")[0].alias("least"), "ids"))


def _home(classes: DataFrame, tables: int, levels: int) -> DataFrame:
    """(class, dim, vec, least, homes): each vector's bucket in each table, written once."""

    def run(batches):
        for batch in batches:
            homes = np.zeros((batch.num_rows, tables), np.int64)
            for _, at, rows in _by_dim(batch):
                homes[at] = np.concatenate([buckets(rows, t, levels) for t in range(tables)], axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("class", "dim", "vec", "least")), pa.array(list(homes), pa.list_(pa.int64()))], ["class", "dim", "vec", "least", "homes"])

    return checkpointed(classes.select("class", "dim", "vec", "least").mapInArrow(run, "class string, dim long, vec binary, least long, homes array<long>"))


def _best(index: tuple, queries: tuple, k: int):
    """The k best index rows of each query: (query position, index position, score)."""
    least, x = index
    norm_x, norm_q = np.sqrt((x * x).sum(1)), np.sqrt((queries * queries).sum(1))
    unit = x / norm_x[:, None]
    for a in range(0, len(queries), 256):
        q = queries[a : a + 256]
        rough = (q / norm_q[a : a + 256, None]) @ unit.T
        edge = np.partition(rough, rough.shape[1] - k, axis=1)[:, -k][:, None] if rough.shape[1] > k else np.full((len(rough), 1), -2.0)
        # all that might tie with the k-th, scored again in a way that does not depend on the block
        qi, xi = np.nonzero(rough >= edge - 1e-9)
        score = (x[xi] * q[qi]).sum(1) / (norm_x[xi] * norm_q[a + qi])
        order = np.lexsort((least[xi], -score, qi))
        qi, xi, score = qi[order], xi[order], score[order]
        keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
        yield a + qi[keep], xi[keep], score[keep]


def measured_probes(home: DataFrame, queries: DataFrame, k: int, tables: int, levels: int, target: float = TARGET) -> int:
    """The least number of probes that finds `target` of the k nearest of SAMPLED queries (class, dim, vec), compared with the whole index."""
    some = queries.orderBy(F.xxhash64("class"), "class").limit(SAMPLED).select("class", "dim", "vec").collect()
    by_dim: dict[int, list] = {}
    for r in some:
        by_dim.setdefault(r["dim"], []).append(r)
    sample = {d: (np.array([r["class"] for r in rows], object), np.frombuffer(b"".join(bytes(r["vec"]) for r in rows), np.float64).reshape(-1, d)) for d, rows in by_dim.items()}

    def run(batches):
        for batch in batches:
            homes = np.array(batch.column("homes").to_pylist(), np.int64).reshape(-1, tables)
            names, least = np.array(batch.column("class").to_pylist(), object), batch.column("least").to_numpy()
            for dim, at, rows in _by_dim(batch):
                if dim in sample:
                    for qi, xi, score in _best((least[at], rows), sample[dim][1], k + 1):
                        other = sample[dim][0][qi] != names[at[xi]]
                        qi, xi, score = qi[other], xi[other], score[other]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(qi), dim)), pa.array(qi), pa.array(score), pa.array(least[at[xi]]), pa.array(list(homes[at[xi]]), pa.list_(pa.int64()))], ["dim", "query", "score", "least", "homes"])

    found = home.mapInArrow(run, "dim long, query long, score double, least long, homes array<long>")
    order = Window.partitionBy("dim", "query").orderBy(F.desc("score"), "least")
    truth = found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k).collect()
    needed = []
    for dim, (_, q) in sample.items():
        mine = [r for r in truth if r["dim"] == dim]
        first = np.full(len(mine), 1 << 40)
        for t in range(tables):
            order_of = buckets(q, t, levels, 1 << 40)
            place = np.empty_like(order_of)
            np.put_along_axis(place, order_of, np.broadcast_to(np.arange(order_of.shape[1]), order_of.shape), 1)
            first = np.minimum(first, [place[r["query"], r["homes"][t]] for r in mine]) if mine else first
        needed.extend(first.tolist())
    return int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1 if needed else 1


def _met(home: DataFrame, queries: DataFrame, k: int, tables: int, levels: int, probes: int) -> DataFrame:
    """(query, class, score): of each block the k best of each of its queries (class, dim, vec)."""
    key = ["dim", "tab", "bucket"]

    def probe(batches):
        for batch in batches:
            for dim, at, rows in _by_dim(batch):
                for t in range(tables):
                    got = buckets(rows, t, levels, probes)
                    which = pa.array(np.repeat(at, got.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(got.size, dim)), pa.array(np.full(got.size, t, np.int64)), pa.array(got.ravel().astype(np.int64)), batch.column("class").take(which)], [*key, "query"])

    index = home.select("dim", F.posexplode(F.slice("homes", 1, tables)).alias("tab", "bucket"), "class", "least", "vec").withColumn("tab", F.col("tab").cast("long"))
    asked = checkpointed(queries.select("class", "dim", "vec").mapInArrow(probe, "dim long, tab long, bucket long, query string"))
    # rows by bucket: their number is bounded by the axes of the tables
    there = home.select("dim", F.posexplode(F.slice("homes", 1, tables)).alias("tab", "bucket")).groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / INDEX_BLOCK).alias("blocks"))
    crowd = asked.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("crowds"))
    sizes = checkpointed(there.withColumn("tab", F.col("tab").cast("long")).join(crowd, key))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    across = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    left = index.join(F.broadcast(sizes), key).select(*key, deal("class", "blocks").alias("i"), across("crowds").alias("j"), "class", "least", "vec")
    right = asked.join(F.broadcast(sizes), key).select(*key, across("blocks").alias("i"), deal("query", "crowds").alias("j"), "query").join(queries.select(F.col("class").alias("query"), "vec"), "query")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            x, q = (np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float64).reshape(t.num_rows, -1) for t in (left, right))
            for made in _best((left.column("least").to_numpy(), x), q, k):
                for o, v in zip(out, made, strict=True):
                    o.append(v)
        qi, xi = (pa.array(np.concatenate(o) if o else np.zeros(0, np.int64)) for o in out[:2])
        return pa.table({"query": right.column("query").take(qi), "class": left.column("class").take(xi), "score": pa.array(np.concatenate(out[2]) if out[2] else np.zeros(0))})

    block = [*key, "i", "j"]
    return left.groupBy(*block).cogroup(right.select(*block, "query", "vec").groupBy(*block)).applyInArrow(run, "query string, class string, score double").dropDuplicates(["query", "class"])


def search(vectors: DataFrame, wanted: DataFrame, k: int = K, tables: int = TABLES, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of `usable` vectors, for the ids `wanted` (id) among them; `probes` as measured unless given."""
    members, classes = vector_classes(vectors, k)
    asking = checkpointed(members.join(wanted.select("id").distinct(), "id", "left_semi"))
    n, widest = classes.agg(F.count(F.lit(1)), F.max("dim")).first()
    signed = 2 << max(0, (widest or 1) - 1).bit_length()
    levels = 2 if n > BUCKET_ROWS * signed else 1
    home = _home(classes, tables, levels)
    queries = checkpointed(home.drop("homes").join(asking.select("class").distinct(), "class", "left_semi"))
    probes = probes or measured_probes(home, queries, k, tables, levels)

    def ranked(asking: DataFrame, met: DataFrame) -> DataFrame:
        # k + 1 classes and of each k + 1 ids are enough: a query's own id is one of them at most
        best = met.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id")).groupBy("query", "vec_id").agg(F.max("score").alias("score"))
        first = best.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("at") <= k + 1)
        lists = first.groupBy("query").agg(F.collect_list(F.struct("vec_id", "score")).alias("found"))
        each = asking.join(lists.withColumnRenamed("query", "class"), "class").select(F.col("id").alias("query_id"), F.explode("found").alias("f")).select("query_id", "f.vec_id", "f.score")
        each = each.filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return checkpointed(each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))

    first = ranked(asking, _met(home, queries, k + 1, tables, levels, probes))
    enough = first.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = checkpointed(asking.join(enough, "id", "left_anti"))
    if short.isEmpty():
        return first
    alone = queries.join(short.select("class").distinct(), "class", "left_semi")
    whole = ranked(short, _met(home, alone, k + 1, 1, levels, signed**levels))
    return first.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(whole)


def nearest(embeddings: DataFrame, every: int = 50) -> DataFrame:
    """Search for the rows whose vec_id is divisible by `every` among all rows."""
    vectors = usable(embeddings)
    return search(vectors, vectors.filter(F.col("id") % every == 0).select("id")).select(F.col("query_id"), F.col("rank").cast(T.IntegerType()).alias("rank"), "vec_id", "score")
