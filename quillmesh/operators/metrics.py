"""Group and market metrics, attention history, events and drivers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh import config
from quillmesh.functions import scoring as S
from quillmesh.operators import weights as W

#: Members kept with an event.
MEMBERS = 50


def attention_window(df: DataFrame, newest: DataFrame | None = None) -> DataFrame:
    """The last seven days before the newest article, by the time of collection where articles have one."""
    at = "collected_at" if "collected_at" in df.columns else "published_at"
    newest = df.agg(F.coalesce(F.max(at), F.max("published_at")).alias("newest")) if newest is None else newest
    return df.crossJoin(F.broadcast(newest)).where(F.col("published_at") >= F.col("newest") - F.expr(f"INTERVAL {config.ATTENTION_DAYS} DAYS")).drop("newest")


def attention_volume(spark: SparkSession, df: DataFrame, newest: DataFrame | None = None) -> DataFrame:
    """Weight of each group's articles in the window; the fallback weight looks at the whole window."""
    recent = attention_window(df, newest).groupBy("sector").agg(F.sum(F.greatest(S.number("agg_weight"), F.lit(0.0))).alias("v"), F.count("*").cast("double").alias("n"))
    volume = W.with_totals(recent, [], total=F.sum("v")).select("sector", F.when(F.col("total") <= 0, F.col("n")).otherwise(F.col("v")).alias("volume"))
    return W.zero_fill(spark, volume, config.GROUPS)


def event_representatives(df: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """The heaviest article of each event, then the least id, by an aggregate that each task begins for itself."""
    others = [c for c in df.columns if c not in (*group, "event_key")]
    first = F.min_by(F.struct(*others), F.struct((-S.number("agg_weight")).alias("o"), "article_id"))
    return df.groupBy(*group, "event_key").agg(first.alias("f")).select(*(F.col(c) if c in (*group, "event_key") else F.col(f"f.{c}").alias(c) for c in df.columns))


def risk_parts(df: DataFrame, group: list[str], blocks: int = W.BLOCKS) -> DataFrame:
    """Number, weighted mean and P90 of the risk of each group's event representatives; under three events the P90 is the mean."""
    days = tuple(g for g in group if g != "sector")
    needed = list(dict.fromkeys([*group, "event_key", "article_id", "agg_weight", "risk_intensity"]))
    tied = W.ties(event_representatives(df.select(*needed), days), group, "risk_intensity")
    mean = tied.groupBy(*group).agg((F.sum(F.col("v") * F.col("vw")) / F.sum("vw")).alias("mean"), F.sum("n").alias("events"))
    p90 = W.quantile_of(tied, group, 0.9, "p90", blocks)
    return mean.join(p90, group).withColumn("p90", F.when(F.col("events") < 3, F.col("mean")).otherwise(F.col("p90")))


def sector_risk(df: DataFrame, weights: dict) -> DataFrame:
    """Mixed weighted mean and P90 of event representatives; under three events the mean alone."""
    part = weights["risk_intensity"]
    score = part["weighted_mean"] * F.col("mean") + part["p90"] * F.col("p90")
    return risk_parts(df, ["sector"]).select("sector", "events", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("risk_intensity"))


def sector_metrics(spark: SparkSession, df: DataFrame, weights: dict) -> DataFrame:
    """Six metrics of every group of the domain.

    One aggregate by group and score serves weights, formulas, disagreement and the newest time; events, publishers and
    the window of attention take one more each.  No window holds a group's articles, and the joins are on the domain.
    """
    dims, formulas = ("optimism", "fear", "uncertainty"), S.article_formulas(weights)
    w = F.greatest(S.number("agg_weight"), F.lit(0.0))
    at = "collected_at" if "collected_at" in df.columns else "published_at"
    rows = df.withColumns({d: F.coalesce(formulas[d], F.lit(0.0)) for d in dims}).withColumn("w", w)
    sums = rows.groupBy("sector", S.number("sentiment_score").alias("v")).agg(
        F.sum("w").alias("vw"), F.sum(F.col("w") * F.col("w")).alias("vw2"), F.count("*").alias("n"), F.max(at).alias("newest"), F.max("published_at").alias("published"),
        *(F.sum(F.col(d) * F.col("w")).alias(f"w_{d}") for d in dims), *(F.sum(d).alias(f"n_{d}") for d in dims),
    )
    mean = lambda d: F.when(F.sum("vw") <= 0, F.sum(f"n_{d}") / F.sum("n")).otherwise(F.sum(f"w_{d}") / F.sum("vw")).alias(d)
    main = sums.groupBy("sector").agg(*map(mean, dims), F.sum("n").alias("articles"))
    publishers = df.groupBy("sector").agg(F.count_distinct("publisher").alias("publishers"))
    apart = W.distance_of(W.safe_ties(sums.select("sector", "v", "vw", "vw2", "n"), ["sector"]), ["sector"]).select("sector", (100 * F.col("distance")).alias("disagreement"))
    newest = sums.agg(F.coalesce(F.max("newest"), F.max("published")).alias("newest"))
    volume = attention_volume(spark, df, newest)
    attention = volume.select("sector", (100 * (W.average_rank(F.col("volume"), [F.lit(1)], F.col("volume")) - 0.5) / F.count("*").over(Window.partitionBy(F.lit(1)))).alias("attention"))
    both = main.join(publishers, "sector").join(apart, "sector").join(sector_risk(df, weights), "sector")
    return W.zero_fill(spark, both, config.GROUPS).join(attention, "sector")


def output_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, n, lowest, p10, p50, mean, p90, highest) of numeric columns, with exact percentiles."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "metric", "v")
    parts = W.percentiles(long, ["metric"], "v", [0.1, 0.5, 0.9]).groupBy("metric").pivot("label", [0, 1, 2]).agg(F.first("v"))
    sums = long.groupBy("metric").agg(F.count("v").alias("n"), F.min("v").alias("lowest"), F.avg("v").alias("mean"), F.max("v").alias("highest"))
    return sums.join(parts, "metric", "left").select("metric", "n", "lowest", F.col("0").alias("p10"), F.col("1").alias("p50"), "mean", F.col("2").alias("p90"), "highest")


def market_metrics(spark: SparkSession, df: DataFrame, weights: dict) -> DataFrame:
    return sector_metrics(spark, df, weights).agg(*(F.avg(m).alias(m) for m in config.METRICS))


def daily_volume(df: DataFrame) -> DataFrame:
    return df.groupBy("sector", "day").agg(F.sum("agg_weight").alias("volume"), F.count("*").alias("articles"))


def growth_series(daily: DataFrame, lookback: int = config.LOOKBACK) -> DataFrame:
    """Growth over the mean of the previous ``lookback`` rows, where that many exist."""
    days = Window.partitionBy("sector").orderBy("day")
    mean = F.avg("volume").over(days.rowsBetween(-lookback, -1))
    return daily.withColumn("n", F.row_number().over(days)).withColumn("growth", F.when(F.col("n") > lookback, (F.col("volume") - mean) / (mean + 1)))


def attention_scores(daily: DataFrame, weights: dict) -> DataFrame:
    """Empirical distribution of the newest volume and growth in a group's history, given days enough; else ranks.

    The newest row of each group is compared by a window over its history, so no self join is made.
    """
    last = Window.partitionBy("sector").orderBy(F.desc("day"))
    rows = growth_series(daily).withColumn("back", F.row_number().over(last))
    rows = rows.withColumn("now", F.first("volume").over(last)).withColumn("grown", F.first("growth").over(last))
    history = rows.where("back > 1").groupBy("sector", "now", "grown").agg(
        F.avg(F.when(F.col("volume") <= F.col("now"), 1.0).otherwise(0.0)).alias("volume_ecdf"),
        F.coalesce(F.avg(F.when(F.col("growth").isNull(), None).when(F.col("growth") <= F.col("grown"), 1.0).otherwise(0.0)), F.lit(0.0)).alias("growth_ecdf"),
        F.count("*").alias("days"),
    )
    part = weights["attention"]
    ranked = 100 * (W.average_rank(F.col("now"), [F.lit(1)], F.col("now")) - 0.5) / F.count("*").over(Window.partitionBy(F.lit(1)))
    learnt = 100 * (part["volume_ecdf"] * F.col("volume_ecdf") + part["growth_ecdf"] * F.col("growth_ecdf"))
    return history.select("sector", "days", F.when(F.col("days") >= config.HISTORY_DAYS - 1, learnt).otherwise(ranked).alias("attention"))


def with_driver_score(df: DataFrame) -> DataFrame:
    """The greatest weight comes from an aggregate, not from a window over all rows."""
    top = df.agg(F.max(S.number("agg_weight")).alias("top"))
    share = F.when(F.col("top") > 0, S.number("agg_weight") / F.col("top") * 100).otherwise(0.0)
    scored = df.crossJoin(F.broadcast(top)).withColumn("uncertainty", S.formula("uncertainty", config.ENHANCED)).withColumn("weight_share", share)
    return scored.withColumn("driver_score", S.driver_score(F.col("weight_share"))).drop("top")


def collapse_events(df: DataFrame) -> DataFrame:
    """One row per event: its heaviest article, counts, and the boosted greatest score."""
    first = F.min(F.struct((-S.number("agg_weight")).alias("o"), "article_id", "sector", "published_at"))
    events = df.groupBy("event_key").agg(first.alias("f"), F.count("*").alias("articles"), F.size(F.collect_set("source")).alias("sources"), F.max("driver_score").alias("score"))
    boosted = F.when(F.col("sources") >= 3, F.least(F.col("score") * config.COVERAGE_BOOST, F.lit(config.DRIVER_CAP))).otherwise(F.col("score"))
    return events.select("event_key", "f.article_id", "f.sector", "f.published_at", "articles", "sources", boosted.alias("event_score"))


def event_members(df: DataFrame, most: int = MEMBERS) -> DataFrame:
    """(event_key, members): the newest articles of each event, newest first and then by id, as nested rows.

    A task keeps the newest ``most`` of an event before anything moves, so an event of any size stays small.
    """
    order = Window.partitionBy("event_key").orderBy(F.desc_nulls_last("published_at"), "article_id")
    fields = [c for c in ("article_id", "title", "source", "publisher", "published_at", "url", "agg_weight", "content_level", "evidence_sentence", "driver_score") if c in df.columns]
    kept = df.withColumn("place_", F.row_number().over(order)).where(F.col("place_") <= most)
    return kept.groupBy("event_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("place_", F.struct(*fields).alias("a")))), lambda x: x["a"]).alias("members"))


def event_rows(df: DataFrame, most: int = MEMBERS) -> DataFrame:
    """``collapse_events`` with each event's members."""
    return collapse_events(df).join(event_members(df, most), "event_key")


def strongest_news(df: DataFrame, negative: bool = False, most: int = 20) -> DataFrame:
    """The most positive or most negative articles of each group, with their place; equal scores by id."""
    score = S.number("sentiment_score")
    order = Window.partitionBy("sector").orderBy(F.asc(score) if negative else F.desc(score), "article_id")
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def top_drivers(df: DataFrame, limit: int = 10, macro: str = "error") -> DataFrame:
    """The top events, with a place kept for the best one of the macro group."""
    events = collapse_events(with_driver_score(df))
    order = [F.desc("event_score"), F.asc("article_id")]
    best = events.where(F.col("sector") == macro).orderBy(*order).limit(1)
    others = events.join(best.select(F.col("event_key").alias("k")), F.col("event_key") == F.col("k"), "left_anti").orderBy(*order).limit(limit - 1)
    return others.unionByName(best)


def snapshot(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Both formula versions of every group, as a snapshot holds them."""
    base = sector_metrics(spark, df, config.BASELINE).withColumn("formula", F.lit("baseline"))
    return base.unionByName(sector_metrics(spark, df, config.ENHANCED).withColumn("formula", F.lit("enhanced")))
