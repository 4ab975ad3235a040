"""Centroids, nearest matches and vector pairs."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions import vectors as vec
from siftstone.operators.graph import checkpointed, small

#: Vectors of a block when all pairs are compared, and rows of it that one matrix product takes.
BLOCK, STRIP = 8192, 512
#: Targets that are broadcast at most; more are met by matrix products, which need no row for each pair.
TARGETS = 64
#: Pairs whose distances are taken again, exactly, at a time.
PAIRS = 65_536


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    v = np.array(column.to_pylist(), np.float64)
    size = np.sqrt((v * v).sum(1))
    return v / np.where(size > 0, size, 1.0)[:, None]


def _first_of_equal(t: pa.Table, k: int) -> pa.Table:
    """Of rows (tid, t), the first k of each vector, in order of tid: what no row's k nearest can lack."""
    t = t.sort_by("tid")
    seen: Counter = Counter()
    keep = []
    for v in t.column("t").to_pylist():
        key = tuple(v)
        seen[key] += 1
        keep.append(seen[key] <= k)
    return t.filter(pa.array(keep, pa.bool_()))


def _block_best(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, target, distance) of the k nearest y of each x, ties to the first; x and y hold unit vectors.

    A matrix product's last bits depend on a vector's place, so what it finds within 1e-9 of the k-th is measured again row by row.
    """
    rows, found, dist = [], [], []
    for s in range(0, len(x), STRIP):
        d = 1.0 - x[s : s + STRIP] @ y.T
        last = min(k, d.shape[1]) - 1
        bound = np.partition(d, last, axis=1)[:, last] + 1e-9
        at, to = np.nonzero(d <= np.where(np.isnan(bound), np.inf, bound)[:, None])
        exact = np.concatenate([np.zeros(0), *[1.0 - (x[s + at[p : p + PAIRS]] * y[to[p : p + PAIRS]]).sum(1) for p in range(0, len(at), PAIRS)]])
        order = np.lexsort((to, exact, at))
        at, to, exact = at[order], to[order], exact[order]
        keep = np.arange(len(at)) - np.searchsorted(at, at) < k
        rows.append(s + at[keep])
        found.append(to[keep])
        dist.append(exact[keep])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(dist)


def centroids(df: DataFrame, group: str, vector: str, weight: Column | None = None, unit: bool = True, least: int = 1, first: tuple[str, int] | None = None) -> DataFrame:
    """(group, centroid, n): the (weighted) mean of each group's vectors, as a unit vector.

    Groups of fewer than `least` rows are left out. With first = (column, k), a group's first k rows by that column stand for it.
    Sums are combined per component before the shuffle.
    """
    if first is not None:
        place = F.row_number().over(Window.partitionBy(group).orderBy(first[0]))
        df = df.withColumn("_place", place).filter(F.col("_place") <= first[1]).drop("_place")
    w = weight if weight is not None else F.lit(1.0)
    each = df.select(group, w.cast("double").alias("_w"), F.posexplode(F.col(vector).cast("array<double>")).alias("_pos", "_x"))
    means = each.groupBy(group, "_pos").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_x"), F.count(F.lit(1)).alias("n"))
    rows = means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_x"))), lambda s: s["_x"]).alias("centroid"), F.max("n").alias("n"))
    rows = rows.filter(F.col("n") >= least) if least > 1 else rows
    return rows.withColumn("centroid", vec.normalise(F.col("centroid"))) if unit else rows


def _best(rows: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(id, place, tid, dist): each row's k nearest targets (place from 1), ties to the least tid.

    rows (id, v) meet targets (tid, t) by a broadcast if the targets, counted first, are few. Else both are dealt over a grid of
    blocks, where each task keeps its rows' k nearest: memory is bounded, and k rows leave a block for each row. There, vectors that are
    null or hold a null or no number take no part.
    """
    targets = checkpointed(targets.select("tid", F.col("t").cast("array<double>").alias("t")))
    n = targets.count()
    if n <= TARGETS:
        met = rows.join(F.broadcast(targets), F.lit(True)).select("id", "tid", vec.cosine_distance(F.col("v"), F.col("t")).alias("dist"))
    else:
        kind = dict(targets.dtypes)["tid"], dict(rows.dtypes)["id"]
        wide, high = -(-n // BLOCK), max(1, -(-rows.count() // BLOCK))
        deal = lambda key, blocks: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
        across = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        full = lambda v: F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull())
        left = rows.filter(full("v")).select("id", F.col("v").cast("array<double>").alias("v"), deal("id", high).alias("i"), across(wide).alias("j"))
        right = targets.filter(full("t")).select("tid", "t", across(high).alias("i"), deal("tid", wide).alias("j"))

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            if not len(a) or not len(b):
                return pa.table({"id": a.column("id").slice(0, 0), "tid": b.column("tid").slice(0, 0), "dist": pa.array([], pa.float64())})
            b = _first_of_equal(b, k)
            at, found, dist = _block_best(_unit(a.column("v")), _unit(b.column("t")), k)
            return pa.table({"id": a.column("id").take(pa.array(at)), "tid": b.column("tid").take(pa.array(found)), "dist": dist})

        met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, f"id {kind[1]}, tid {kind[0]}, dist double")
    if k == 1:
        return met.groupBy("id").agg(F.min(F.struct("dist", "tid")).alias("m")).select("id", F.lit(1).alias("place"), "m.tid", "m.dist")
    order = Window.partitionBy("id").orderBy("dist", "tid")
    return met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("id", "place", "tid", "dist")


def nearest(rows: DataFrame, targets: DataFrame, limit: float) -> DataFrame:
    """(id, tid, dist) of each row's nearest target within `limit`; ties go to the least tid."""
    return _best(rows, targets, 1).select("id", "tid", "dist").filter(F.col("dist") <= limit)


def top_two(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, tid, dist, margin): the nearest target and by how much it is nearer than the second (null without one)."""
    two = _best(rows, targets, 2).groupBy("id").agg(F.min_by("tid", "place").alias("tid"), F.min("dist").alias("dist"), F.max(F.when(F.col("place") == 2, F.col("dist"))).alias("second"))
    return two.withColumn("margin", F.col("second") - F.col("dist")).drop("second")


def propagate(rows: DataFrame, known: DataFrame, limit: float, margin: float, least: int = 5, passes: int = 5) -> DataFrame:
    """(id, label, pass): labels that spread from `known` (id, label, v) to rows (id, v), pass by pass.

    Each pass takes unit mean vectors of the labels with `least` examples or more, gives a row its nearest
    label if it is within `limit` and nearer than the second by `margin`, and counts what it assigned among
    the examples of the next. It ends with a pass that assigns nothing, or after `passes`.
    """
    out = None
    for k in range(1, passes + 1):
        fit = centroids(known, "label", "v").filter(F.col("n") >= least).select(F.col("label").alias("tid"), F.col("centroid").alias("t"))
        got = checkpointed(top_two(rows, fit).filter((F.col("dist") <= limit) & (F.col("margin") >= margin)).select("id", F.col("tid").alias("label")))
        step = got.withColumn("pass", F.lit(k))
        out = step if out is None else out.unionByName(step)
        if got.isEmpty():
            break
        known = checkpointed(known.select("id", "label", "v").unionByName(rows.join(got, "id").select("id", "label", "v")))
        rows = checkpointed(rows.join(got.select("id"), "id", "left_anti"))
    return out


def vector_classes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): members (id, class) of rows (id, v), and classes (id, v, n) of equal vectors, named by their least id."""
    rows = df.select("id", F.col("v").cast("array<double>").alias("v"))
    classes = checkpointed(rows.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    members = rows.join(classes.select("v", F.col("id").alias("class")), "v").select("id", "class")
    return members, classes.select("id", "v", "n")


def vector_pairs(df: DataFrame, limit: float, by: list[str] | None = None) -> DataFrame:
    """(a, b, dist), a < b, of all rows (id, v) at cosine distance `limit` or less; of equal columns `by` only.

    Rows are dealt over blocks; each pair of blocks is one task's matrix products, strip by strip, and
    only pairs within the limit leave it. Exact; work is quadratic in rows of equal `by`, memory bounded. A row travels once for each
    BLOCK rows. Where equal vectors are many, pairs of `vector_classes` do.
    """
    by = by or []
    rows = df.select(*by, "id", F.col("v").cast("array<double>").alias("v"))
    if by:
        sizes = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        rows = rows.join(small(sizes), by)
    else:
        rows = rows.withColumn("blocks", F.lit(max(1, -(-df.count() // BLOCK))))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.select(*by, "id", "v", own.alias("own"), other.alias("other"))
    dealt = dealt.select(*by, "id", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"))

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        unit = _unit(t.column("v"))
        left, right = (np.flatnonzero(t.column(c).to_numpy(zero_copy_only=False)) for c in ("left", "right"))
        alone = len(left) == len(right) == len(ids)  # a block with itself
        lo, hi, far = [], [], []
        for s in range(0, len(left), STRIP):
            some = left[s : s + STRIP]
            at, bt = np.nonzero(1.0 - unit[some] @ unit[right].T <= limit + 1e-9)
            a, b = some[at], right[bt]
            exact = 1.0 - (unit[a] * unit[b]).sum(1)
            keep = (exact <= limit) & (ids[a] < ids[b] if alone else ids[a] != ids[b])
            lo.append(np.minimum(ids[a], ids[b])[keep])
            hi.append(np.maximum(ids[a], ids[b])[keep])
            far.append(exact[keep])
        return pa.table({"a": np.concatenate([*lo, np.zeros(0, np.int64)]), "b": np.concatenate([*hi, np.zeros(0, np.int64)]), "dist": np.concatenate([*far, np.zeros(0)])})

    return dealt.groupBy(*by, "i", "j").applyInArrow(run, "a long, b long, dist double")


def use_once(matches: DataFrame) -> DataFrame:
    """Of (cid, name, dist, margin) in cid order, each name goes to the first cid that asks for it.

    Names are few and an order decides, so one window per name does it.
    """
    order = Window.partitionBy("name").orderBy("cid")
    return matches.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")
