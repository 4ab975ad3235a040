"""Declarative rules: labels, scores, classes and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.operators.graph import small


def first_of(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The label of the first rule that holds."""
    out = None
    for cond, label in rules:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(F.lit(default))


def cascade(exclusive: list[tuple[Column, str]], accumulating: list[tuple[Column, str]], fallback: str | None = None, derived: dict[str, list[str]] | None = None) -> Column:
    """A row's sorted labels. An exclusive rule that holds gives its label alone; else all
    accumulating ones that hold; then those derived from labels given before; else the fallback.
    """
    found = F.array_compact(F.array(*[F.when(c, label) for c, label in accumulating]))
    for label, needs in (derived or {}).items():
        have = F.lit(True)
        for n in needs:
            have = have & F.array_contains(found, n)
        found = F.when(have, F.array_append(found, F.lit(label))).otherwise(found)
    labels = F.array_sort(F.array_distinct(found))
    if fallback is not None:
        labels = F.when(F.size(labels) == 0, F.array(F.lit(fallback))).otherwise(labels)
    alone = first_of(exclusive) if exclusive else F.lit(None).cast("string")
    return F.when(alone.isNotNull(), F.array(alone)).otherwise(labels)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rounded(x: Column, digits: int) -> Column:
    """Rounded in binary, halves away from zero, as SQL engines round doubles; Spark's round goes by the shortest decimal form.

    What cannot be scaled (infinite, not a number, too large) stays.
    """
    scaled = F.abs(x) * 10.0**digits
    rest = scaled % 1.0
    out = F.signum(x) * (scaled - rest + F.when(rest >= 0.5, 1.0).otherwise(0.0)) / 10.0**digits
    return F.when(F.isnan(out), x).otherwise(out)


def geometric_mean(*terms: Column) -> Column:
    """exp of the mean logarithm; each term gets 1e-3 so that none is zero."""
    return F.exp(sum((F.ln(t + 1e-3) for t in terms), F.lit(0.0)) / len(terms))


def weighted_sum(terms: list[tuple[Column, float]]) -> Column:
    return sum((t * F.lit(w) for t, w in terms), F.lit(0.0))


def points(gate: Column, terms: list[tuple[Column, float, float]], penalties: list[tuple[Column, float]]) -> Column:
    """Points (value, weight, cap) less penalties (condition, points), clamped to 0..1; 0 unless the gate holds."""
    total = sum((F.least(F.lit(cap), value * F.lit(w)) for value, w, cap in terms), F.lit(0.0))
    for cond, p in penalties:
        total = total - F.when(cond, F.lit(p)).otherwise(0.0)
    return F.when(gate, clamp(total)).otherwise(0.0)


def classify_detections(rows: DataFrame, group: str, thresholds: DataFrame, overall: float, uncertain: str = "uncertain") -> DataFrame:
    """(group, class, score, verdict): of the listed classes the best score decides.

    rows (group, class, score); thresholds (class, threshold) is a small dimension. At the greater of
    the overall and the class's threshold a detection is "possible", below it `uncertain`.
    """
    listed = rows.join(small(thresholds), "class")
    best = listed.groupBy(group).agg(F.max_by(F.struct("class", "score", "threshold"), F.struct("score", "class")).alias("b"))
    verdict = F.when(F.col("b.score") >= F.greatest(F.lit(overall), F.col("b.threshold")), "possible").otherwise(uncertain)
    return best.select(group, "b.class", "b.score", verdict.alias("verdict"))


def best_tags(tags: DataFrame, categories: list[str]) -> DataFrame:
    """One row per source: each category's best tag (label and confidence) of a long table (source, category, label, confidence)."""
    best = F.max_by(F.struct("label", "confidence"), F.struct("confidence", "label"))
    wide = tags.groupBy("source").pivot("category", categories).agg(best)
    return wide.select("source", *[F.col(f"{c}.{f}").alias(f"{c}_{f}") for c in categories for f in ("label", "confidence")])
