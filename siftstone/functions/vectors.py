"""Column builders for vectors, bit hashes and boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column, guard: str = "floor") -> Column:
    """v / |v|. Short vectors: divide by 1e-9 ("floor"), leave as they are ("keep"), or divide a zero one by 1 ("one")."""
    n = norm(v)
    if guard == "floor":
        by = F.greatest(n, F.lit(1e-9))
    elif guard == "keep":
        by = F.when(n < 1e-9, 1.0).otherwise(n)
    else:
        by = F.when(n == 0, 1.0).otherwise(n)
    return F.transform(v, lambda x: x / by)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size <= 0, 1.0).otherwise(1.0 - dot(a, b) / F.when(size <= 0, 1.0).otherwise(size))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pack_bits(bits: Column) -> Column:
    """Booleans to an integer, the first one highest; 64 of them give a signed long."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b.cast("long")))


def sign_bits(v: Column) -> Column:
    """For each component whether it exceeds the median of all but the first."""
    rest = F.array_sort(F.slice(v, 2, F.size(v) - 1))
    n = F.size(rest)
    low, high = F.element_at(rest, F.floor((n + 1) / 2).cast("int")), F.element_at(rest, F.floor(n / 2 + 1).cast("int"))
    return F.transform(v, lambda x: x > (low + high) / 2)


def cosine_transform(side: int) -> list[tuple[int, int, float]]:
    """(coefficient, component, weight) of the orthonormal two-dimensional cosine transform of side x side values, row by row."""
    scale = lambda u: math.sqrt((1 if u == 0 else 2) / side)
    one = [[scale(u) * math.cos(math.pi * (2 * x + 1) * u / (2 * side)) for x in range(side)] for u in range(side)]
    return [(u * side + v, x * side + y, one[u][x] * one[v][y]) for u in range(side) for v in range(side) for x in range(side) for y in range(side)]


def concat_weighted(*parts: tuple[Column, float]) -> Column:
    """Parts times their weights, one behind another, as a unit vector."""
    def times(v: Column, w: float) -> Column:
        return F.transform(v, lambda x: x * F.lit(w))

    return normalise(F.concat(*[times(v, w) for v, w in parts]))


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes struct<x1,y1,x2,y2> as a share of their union."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    areas = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    union = areas - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def suppress_boxes(boxes: Column, limit: float = 0.35) -> Column:
    """Greedy suppression: boxes by area, largest first; one stays if it overlaps none kept by `limit` or more."""
    area = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    ordered = F.transform(F.array_sort(F.transform(boxes, lambda b: F.struct((-area(b)).alias("k"), b.alias("b")))), lambda s: s["b"])
    return F.aggregate(ordered, F.slice(ordered, 1, 0), lambda kept, b: F.when(F.forall(kept, lambda k: iou(k, b) < limit), F.array_append(kept, b)).otherwise(kept))
