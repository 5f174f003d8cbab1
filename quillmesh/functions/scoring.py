"""Column builders for formulas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh import config


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def number(name: str) -> Column:
    """A persisted number; null and what is no number count as 0."""
    return F.coalesce(F.expr(f"try_cast(`{name}` AS double)"), F.lit(0.0))


def formula(dimension: str, weights: dict) -> Column:
    """100 times the clipped weighted sum of a dimension's components."""
    return 100 * clamp(reduce(lambda a, b: a + b, [w * number(c) for c, w in weights[dimension].items()]))


def article_formulas(weights: dict) -> dict[str, Column]:
    return {d: formula(d, weights) for d in ("optimism", "fear", "uncertainty")}


def time_weight(published: Column, collected: Column) -> Column:
    hours = (F.unix_micros(collected.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / 3.6e9
    return F.exp(-F.greatest(hours, F.lit(0.0)) / config.DECAY_HOURS)


def noisy_or(risks: Column) -> Column:
    """100 (1 - product of (1 - severity / 5 * strength)) over an array of (severity, strength)."""
    left = F.aggregate(risks, F.lit(1.0), lambda a, r: a * (1 - r["severity"] / 5.0 * clamp(r["strength"])))
    return clamp(100 * (1 - left), 0.0, 100.0)


def driver_score(share: Column) -> Column:
    return 0.4 * number("risk_intensity") + 0.25 * F.abs(number("sentiment_score")) * 100 + 0.2 * F.col("uncertainty") + 0.15 * share


def sentiment_label(score: Column) -> Column:
    return F.when(score > 0.05, "positive").when(score < -0.05, "negative").otherwise("neutral")
