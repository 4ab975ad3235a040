"""Density-based clusters, merges and names."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.operators import match, ranking
from siftstone.operators.graph import checkpointed, connected_components


#: Centroids that one task merges at most.
MERGED = 2000


def numbered(components: DataFrame) -> DataFrame:
    """Components (id, component) with cluster numbers from 0, in the order of their least ids."""
    first = components.groupBy("component").agg(F.min("id").alias("first"))
    numbers = ranking.global_index(first, [F.asc("first")], "cluster").withColumn("cluster", F.col("cluster").cast("int"))
    return components.join(numbers.select("component", "cluster"), "component").select("id", "cluster")


def dbscan(classes: DataFrame, pairs: DataFrame, min_samples: int) -> DataFrame:
    """(id, cluster) of all classes (id, n) of n equal rows; -1 is noise. pairs (a, b) are the neighbours.

    A core row has min_samples - 1 neighbours or more, those of its class included; clusters are components of core
    rows, and a border row joins the lowest-numbered cluster among its core neighbours.
    """
    pairs = checkpointed(pairs.select("a", "b"))
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    ids = classes.select("id")
    around = both.join(classes.select(F.col("id").alias("other"), "n"), "other").groupBy("id").agg(F.sum("n").alias("around"))
    core = classes.join(around, "id", "left").filter(F.col("n") + F.coalesce("around", F.lit(0)) >= min_samples).select("id")
    core_pairs = pairs.join(core.select(F.col("id").alias("a")), "a", "left_semi").join(core.select(F.col("id").alias("b")), "b", "left_semi")
    linked = connected_components(core_pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("id"), "component")
    labelled = core.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    clusters = numbered(labelled)
    border = both.join(core, "id", "left_anti").join(clusters.select(F.col("id").alias("other"), "cluster"), "other").groupBy("id").agg(F.min("cluster").alias("cluster"))
    return ids.join(clusters.unionByName(border), "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def folded(commands: list[tuple[str, str, str]]) -> dict[str, str]:
    """What a list of commands makes of each name that it touches: ("merge", from, into) and ("rename", from, to), in order.

    A merge into a name that has itself become another goes on to that one.
    """
    now: dict[str, str] = {}
    for kind, old, new in commands:
        if kind not in ("merge", "rename"):
            raise ValueError(f"no command {kind}")
        target = now.get(new, new) if kind == "merge" else new
        source = now.get(old, old)
        now = {name: target if at == source else at for name, at in now.items()} | {old: target}
    return now


def commanded(rows: DataFrame, column: str, commands: list[tuple[str, str, str]]) -> DataFrame:
    """`rows` with the names in `column` as the commands leave them."""
    now = folded(commands)
    if not now:
        return rows
    names = rows.sparkSession.createDataFrame(sorted(now.items()), "_old string, _new string")
    return rows.join(F.broadcast(names), F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def merge_centroids(rows: DataFrame, limit: float) -> DataFrame:
    """(cluster, merged): repeatedly merge the two nearest centroids below `limit`; the lower number stays.

    rows (cluster, centroid, n) are one per cluster; the order of merges decides, so they are one task's work.
    More than MERGED clusters raise an error.
    """
    if rows.limit(MERGED + 1).count() > MERGED:
        raise ValueError(f"centroids merge in one task, {MERGED} at most")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster")
        sums = {c: np.array(v) * n for c, v, n in zip(pdf.cluster, pdf.centroid, pdf.n, strict=True)}
        owner = {c: c for c in sums}
        while len(sums) > 1:
            names = sorted(sums)
            unit = np.stack([sums[c] / max(np.linalg.norm(sums[c]), 1e-9) for c in names])
            dist = 1 - unit @ unit.T
            np.fill_diagonal(dist, np.inf)
            i, j = divmod(int(np.argmin(dist)), len(names))
            if dist[i, j] >= limit:
                break
            keep, gone = sorted((names[i], names[j]))
            sums[keep] = sums[keep] + sums.pop(gone)
            owner = {c: keep if o == gone else o for c, o in owner.items()}
        return pd.DataFrame(sorted(owner.items()), columns=["cluster", "merged"])

    return rows.select("cluster", "centroid", "n").groupBy(F.lit(0).alias("k")).applyInPandas(run, "cluster int, merged int")


def _classes(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (component, id, class) of members (component, id, v), and classes (component, id, v, n) of equal vectors, named by their least id.

    A vector that is zero, null or not finite is near none, not even one equal to it: each such row is a class of its own.
    """
    v = F.coalesce(F.col("v").cast("array<double>"), F.array().cast("array<double>"))
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    alone = F.when((size > 0) & (size < float("inf")), "").otherwise(F.col("id").cast("string"))
    rows = members.select("component", "id", v.alias("v")).withColumn("alone", alone)
    classes = checkpointed(rows.groupBy("component", "v", "alone").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n")))
    found = rows.join(classes.select("component", "v", "alone", "class"), ["component", "v", "alone"]).select("component", "id", "class")
    return found, classes.select("component", F.col("class").alias("id"), "v", "n", (F.col("alone") == "").alias("linked"))


def _links(classes: DataFrame, limit: float, links: DataFrame | None) -> DataFrame:
    """(a, b, dist) of classes of one component at distance `limit` or less: `links`, if they are known already."""
    if links is None:
        links = match.vector_pairs(classes.filter("linked").select("component", "id", "v"), limit, ["component"])
    return checkpointed(links.select("a", "b", "dist").filter(F.col("dist") <= limit))


def clique_split(members: DataFrame, limit: float, links: DataFrame | None = None) -> DataFrame:
    """(component, id, clique): in order of id, a row joins the first clique all of whose members are within `limit`.

    Equal rows join one clique, so classes stand for them. A class fits a clique if as many of its lesser neighbours are in it
    as it has members: so each component's links pass through one task in order, which keeps a number for each class, not the
    links. links (a, b, dist) of classes, named by their least id, are computed if not given.
    """
    rows, classes = _classes(members)
    links = _links(classes, limit, links)
    near = links.select(F.col("b").alias("id"), F.col("a").alias("other")).join(classes.select("component", "id"), "id")
    steps = classes.select("component", "id", F.lit(None).cast("long").alias("other")).unionByName(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component = now = None
        clique: dict[int, int] = {}
        sizes: list[int] = []
        met: Counter = Counter()
        out: list[tuple[int, int, int]] = []

        def settle() -> None:
            at = min((c for c, n in met.items() if n == sizes[c]), default=len(sizes))
            if at == len(sizes):
                sizes.append(0)
            sizes[at] += 1
            clique[now] = at
            out.append((component, now, at))
            met.clear()

        def table() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["component", "id", "clique"])

        for batch in batches:
            for group, id_, other in zip(*(batch.column(c).to_pylist() for c in ("component", "id", "other")), strict=True):
                if id_ != now or group != component:
                    if now is not None:
                        settle()
                    if group != component:
                        clique.clear()
                        sizes.clear()
                    component, now = group, id_
                if other is not None:
                    met[clique[other]] += 1
            if out:
                yield table()
        if now is not None:
            settle()
            yield table()

    settled = steps.repartition("component").sortWithinPartitions("component", "id").mapInArrow(run, "component long, id long, clique int")
    return rows.join(settled.withColumnRenamed("id", "class"), ["component", "class"]).select("component", "id", "clique")


def recluster(members: DataFrame, eps: float, largest: int, shrink: float = 0.62, floor: float = 0.012, depth: int = 8, links: DataFrame | None = None) -> DataFrame:
    """(component, id, part): groups of over `largest` rows split at ever smaller eps, at last in chunks by id.

    Parts at a smaller eps are components of the links within it, so each level is one run of `connected_components` over what is
    still too large, with classes for equal rows; no group meets in one task. Parts are numbered level by level, in order of
    the least ids on their way. links (a, b, dist) of classes, named by their least id, are computed if not given.
    """
    widths = [eps]
    while len(widths) <= depth and widths[-1] > floor * 1.05:
        widths.append(max(floor, widths[-1] * shrink))
    rows, classes = _classes(members)
    links = _links(classes, widths[1] if len(widths) > 1 else eps, links)
    left = classes.select("component", F.col("id").alias("class"), "n", F.col("component").alias("at"), F.array().cast("array<long>").alias("way"))
    done = []
    for level, width in enumerate(widths):
        if level:
            inner = links.filter(F.col("dist") <= width).join(left.select(F.col("class").alias("a")), "a", "left_semi")
            found = connected_components(inner.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("class"), F.col("component").alias("_to"))
            to = F.coalesce("_to", "class")
            left = left.join(found, "class", "left").select("component", "class", "n", to.alias("at"), F.array_append("way", to).alias("way"))
        sizes = left.groupBy("component", "at").agg(F.sum("n").alias("size"))
        left = checkpointed(left.join(sizes, ["component", "at"]))
        done.append(left.filter(F.col("size") <= largest).select("component", "class", F.lit(level).alias("level"), "way"))
        left = left.filter(F.col("size") > largest).drop("size")
        if left.isEmpty():
            break
    whole = done[0]
    for some in done[1:]:
        whole = whole.unionByName(some)
    placed = rows.join(whole, ["component", "class"]).select("component", "id", "level", "way", F.lit(0).cast("long").alias("chunk"))
    if not left.isEmpty():
        rest = rows.join(left, ["component", "class"]).select("component", "at", "id", "way")
        chunk = F.floor(F.col("_i") / largest).alias("chunk")
        cut = ranking.group_index(rest, ["component", "at"], [F.asc("id")], "_i").select("component", "id", F.lit(len(widths) - 1).alias("level"), "way", chunk)
        placed = placed.unionByName(cut)
    placed = checkpointed(placed)
    key = ["component", "level", "way", "chunk"]
    parts = ranking.group_index(placed.select(*key).distinct(), ["component"], [F.asc(k) for k in key[1:]], "part")
    return placed.join(parts, key).select("component", "id", F.col("part").cast("int").alias("part"))
