"""Replay of every day through the aggregates, and how stable its rankings are when formula weights change.

Scores are linear in the weights of their components, so the components are aggregated once per day and group and every
variant of the weights is a projection of that small table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh import config
from quillmesh.functions import scoring as S
from quillmesh.functions import times as D
from quillmesh.operators import metrics as M
from quillmesh.operators import weights as W

# Factors of the sweep, and how many groups count as the top.
FACTORS, TOP = (0.0, 0.5, 0.8, 1.2, 1.5), 3
#: Components of the disagreement that is mixed of spread and polarity.
DISAGREEMENT = {"weighted_std": 0.5, "polarity_mix": 0.5}
REQUIRED = ("article_id", "sector", "published_at", "p_positive", "p_neutral", "p_negative", "sentiment_score", "risk_intensity", "agg_weight", "b_bull", "b_bear", "g_growth", "s_shock", "k_unc", "entropy_norm")


def all_weights(base: dict = config.ENHANCED) -> dict[str, dict[str, float]]:
    return {**base, "disagreement": base.get("disagreement", DISAGREEMENT)}


def perturbed(dimension: str, component: str, factor: float, base: dict | None = None) -> dict[str, dict[str, float]]:
    """Weights with one component multiplied and its dimension made to sum to one again."""
    base = base or all_weights()
    if dimension not in base or component not in base[dimension]:
        raise KeyError(f"no component {component} of {dimension}")
    if not math.isfinite(factor) or factor < 0:
        raise ValueError("a factor is finite and not negative")
    if factor == 1.0:
        return {k: dict(v) for k, v in base.items()}
    own = {k: v * (factor if k == component else 1.0) for k, v in base[dimension].items()}
    total = sum(own.values())
    if total <= 0:
        raise ValueError(f"the weights of {dimension} sum to nothing")
    return {k: dict(v) for k, v in base.items()} | {dimension: {k: v / total for k, v in own.items()}}


def prepared(articles: DataFrame, domain: tuple[str, ...] = config.GROUPS) -> DataFrame:
    """Articles with a time, of the groups of the domain, with their UTC day."""
    missing = sorted(set(REQUIRED) - set(articles.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    kind = dict(articles.dtypes)["published_at"]
    day = F.to_date(F.to_utc_timestamp(D.parsed(F.col("published_at")), F.current_timezone())) if kind == "string" else F.to_date("published_at")
    return articles.withColumn("day", day).where(F.col("day").isNotNull() & F.trim("sector").isin(*domain))


def components(spark: SparkSession, articles: DataFrame, domain: tuple[str, ...] = config.GROUPS, history_days: int = config.HISTORY_DAYS) -> DataFrame:
    """(day, sector, articles, each component) for every day with articles and every group of the domain.

    Attention compares a day's volume and growth with all days before; where there are fewer than ``history_days`` both
    of its components are the rank of the volume among the groups.
    """
    keys = ["day", "sector"]
    weighed = W.with_safe_weight(articles, keys)
    plain = ("p_positive", "p_neutral", "p_negative", "b_bull", "b_bear", "g_growth", "s_shock", "k_unc", "entropy_norm")
    mean = weighed.groupBy(*keys).agg(*(W.wmean(S.number(c)).alias(c) for c in plain), F.count("*").alias("articles"), W.polarity_mix(S.number("sentiment_score")).alias("polarity_mix"))
    spread = W.weighted_std(weighed, keys, "sentiment_score")
    apart = W.pairwise_distance(weighed, keys, "sentiment_score", blocks=1)
    risk = M.risk_parts(articles, keys).select(*keys, F.col("mean").alias("weighted_mean"), "p90")
    volume = W.with_safe_weight(articles, ["day"]).groupBy(*keys).agg(F.sum("w").alias("volume"))
    days = articles.select("day").distinct()
    names = spark.createDataFrame([(n,) for n in domain], "sector string")
    filled = days.crossJoin(F.broadcast(names)).join(volume, keys, "left").na.fill(0.0, ["volume"])
    grown = M.growth_series(filled)
    before = Window.partitionBy("sector").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    past = grown.withColumns({"volumes": F.count("volume").over(before), "growths": F.count("growth").over(before)})
    for name in ("volume", "growth"):
        past = W.counted_before(past, ["sector"], "day", name, f"{name}_below")
    share = lambda name: F.coalesce(F.try_divide(F.col(f"{name}_below").cast("double"), F.col(f"{name}s")), F.lit(0.0))
    rank = 100 * (W.average_rank(F.col("volume"), ["day"], F.col("volume")) - 0.5) / F.count("*").over(Window.partitionBy("day")) / 100
    learnt = F.col("volumes") >= history_days
    attention = past.select(*keys, F.when(learnt, share("volume")).otherwise(rank).alias("volume_ecdf"), F.when(learnt, share("growth")).otherwise(rank).alias("growth_ecdf"))
    out = attention.join(mean, keys, "left").join(spread, keys, "left").join(apart, keys, "left").join(risk, keys, "left")
    numbers = [c for c, kind in out.dtypes if c not in keys and kind in ("double", "bigint")]
    return out.na.fill(0, numbers)


#: What one unit of a dimension's components is worth.
SCALE = {"optimism": 100.0, "fear": 100.0, "uncertainty": 100.0, "attention": 100.0, "disagreement": 100.0, "risk_intensity": 1.0}


def score(dimension: str, weights: dict[str, dict[str, float]]) -> Column:
    total = sum((F.lit(w) * F.col(c) for c, w in weights[dimension].items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), SCALE[dimension] * total))


def replay(spark: SparkSession, articles: DataFrame, weights: dict | None = None, mixed: bool = False, domain: tuple[str, ...] = config.GROUPS, history_days: int = config.HISTORY_DAYS) -> DataFrame:
    """(day, sector, six metrics).  Disagreement is the distance of pairs, or ``mixed`` of spread and polarity."""
    weights = weights or all_weights()
    parts = components(spark, prepared(articles, domain), domain, history_days)
    made = {d: score(d, weights) for d in SCALE}
    if not mixed:
        made["disagreement"] = 100 * F.col("distance")
    return parts.select("day", "sector", *(made[d].alias(d) for d in config.METRICS))


def variants(base: dict | None = None, factors: tuple[float, ...] = FACTORS) -> list[tuple[str, str, float, dict]]:
    """(dimension, component, factor, weights) of each component of the base at each factor."""
    base = base or all_weights()
    return [(d, c, f, perturbed(d, c, f, base)) for d in config.METRICS for c in base[d] for f in factors]


def sweep(spark: SparkSession, parts: DataFrame, base: dict | None = None, factors: tuple[float, ...] = FACTORS) -> DataFrame:
    """One row per component and factor: how far its dimension moves from the base weights.

    ``parts`` is what ``components`` gives; every row of it is unfolded into the variants at once.
    """
    base = base or all_weights()
    each = [F.struct(F.lit(d).alias("dimension"), F.lit(c).alias("component"), F.lit(f).alias("factor"), score(d, base).alias("x"), score(d, w).alias("y")) for d, c, f, w in variants(base, factors)]
    rows = parts.select("day", "sector", F.explode(F.array(*each)).alias("v")).select("day", "sector", "v.*")
    return stability(rows, ["dimension", "component", "factor"])


def stability(rows: DataFrame, keys: list[str], top: int = TOP) -> DataFrame:
    """Days, rows, mean daily rank correlation, mean absolute change and mean daily overlap of the top groups, of (x, y)."""
    own = [*keys, "day"]
    place = lambda c: F.row_number().over(Window.partitionBy(*own).orderBy(F.desc(c), "sector"))
    rank = lambda c: F.rank().over(Window.partitionBy(*own).orderBy(F.desc(c))) + (F.count("*").over(Window.partitionBy(*own, c)) - 1) / 2.0
    # equal scores must rank alike whatever the last bits of their sums
    even = rows.withColumns({"x": F.round("x", 9), "y": F.round("y", 9)})
    r = even.withColumns({"rx": rank("x"), "ry": rank("y"), "in_x": place("x") <= top, "in_y": place("y") <= top})
    n, sx, sy = F.count("*"), F.sum("rx"), F.sum("ry")
    cov, vx, vy = F.sum(F.col("rx") * F.col("ry")) * n - sx * sy, F.sum(F.col("rx") * F.col("rx")) * n - sx * sx, F.sum(F.col("ry") * F.col("ry")) * n - sy * sy
    same = F.sum(F.abs(F.col("rx") - F.col("ry"))) == 0
    daily = r.groupBy(*own).agg(
        F.when(same, 1.0).otherwise(F.coalesce(F.try_divide(cov, F.sqrt(vx * vy)), F.lit(0.0))).alias("spearman"),
        (F.count_if(F.col("in_x") & F.col("in_y")) / F.count_if(F.col("in_x") | F.col("in_y"))).alias("jaccard"),
        F.sum(F.abs(F.col("x") - F.col("y"))).alias("moved"), F.count("*").alias("rows"),
    )
    return daily.groupBy(*keys).agg(
        F.count("*").alias("day_count"), F.sum("rows").alias("sector_day_count"), F.avg("spearman").alias("mean_daily_spearman"),
        (F.sum("moved") / F.sum("rows")).alias("mean_absolute_score_change"), F.avg("jaccard").alias("mean_daily_top3_jaccard"),
    )


def most_sensitive(results: DataFrame) -> DataFrame:
    """For each dimension the component whose least stable factor is the least stable of all."""
    order = [F.asc("mean_daily_spearman"), F.desc("mean_absolute_score_change"), F.asc("component"), F.asc("factor")]
    worst = results.withColumn("r", F.row_number().over(Window.partitionBy("dimension", "component").orderBy(*order))).where("r = 1")
    return worst.withColumn("r", F.row_number().over(Window.partitionBy("dimension").orderBy(*order))).where("r = 1").drop("r")

