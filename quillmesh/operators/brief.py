"""The daily brief: one payload of market, groups, drivers, distributions and coverage, and its text by rules."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh import config
from quillmesh.functions import evidence as V
from quillmesh.functions import scoring as S
from quillmesh.functions import text as X
from quillmesh.functions.display import metric
from quillmesh.operators import metrics as M
from quillmesh.operators.relations import one_row_per_key

LABELS = {"optimism": "optimism", "fear": "fear", "uncertainty": "uncertainty", "attention": "attention", "disagreement": "disagreement", "risk_intensity": "risk intensity"}
DISCLAIMER = "This text is made by rules from news data. It is no investment advice."
WINDOW_HOURS = 24


def window_of(df: DataFrame, now: dt.datetime, hours: int = WINDOW_HOURS) -> DataFrame:
    """Articles of the closed window that ends now."""
    end = F.lit(now).cast("timestamp")
    at = F.col("published_at").cast("timestamp")
    return df.where((at >= end - F.expr(f"INTERVAL {hours} HOURS")) & (at <= end))


def versions(snapshots: DataFrame, keys: list[str], revision: str) -> DataFrame:
    """One row per key: of the active revision if there is one, then the latest."""
    active = (F.coalesce("pipeline_revision", F.lit("")) == revision).cast("int") if "pipeline_revision" in snapshots.columns else F.lit(0)
    order = [F.desc(active), F.desc_nulls_last("snapshot_timestamp")]
    return one_row_per_key(snapshots, keys, order)


def previous(snapshots: DataFrame, day: Column, keys: list[str], revision: str = "r4") -> DataFrame:
    """The rows of the last day before ``day``, one for each of ``keys``."""
    earlier = snapshots.where(F.col("snapshot_date") < day)
    last = earlier.agg(F.max("snapshot_date").alias("last_"))
    return versions(earlier.join(F.broadcast(last), F.col("snapshot_date") == F.col("last_")).drop("last_"), ["snapshot_date", *keys], revision)


def deltas(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Change of each metric since the row before with the same keys; null where there is none."""
    old = before.select(*keys, *(F.col(m).alias(f"old_{m}") for m in config.METRICS))
    both = now.join(old, keys, "left") if keys else now.join(F.broadcast(old.limit(1)), F.lit(True), "left")
    return both.select(*keys, *((F.col(m) - F.col(f"old_{m}")).alias(m) for m in config.METRICS))


def rankings(sectors: DataFrame) -> DataFrame:
    """(metric, place, sector, score) of every group in each metric, best first; equal scores by name."""
    rows = sectors.select("sector", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in config.METRICS))).alias("v")).select("sector", "v.*")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("score"), "sector")))


def movers(sectors: DataFrame, before: DataFrame, most: int = 5) -> DataFrame:
    """Groups by the sum of their absolute changes."""
    change = deltas(sectors, before, ["sector"]).where(F.col(config.METRICS[0]).isNotNull())
    total = sum((F.abs(F.col(m)) for m in config.METRICS), F.lit(0.0))
    return change.withColumn("total_abs_delta", total).orderBy(F.desc("total_abs_delta"), "sector").limit(most)


def drivers(df: DataFrame, most: int = 5, macro: str = "error") -> DataFrame:
    """Top events with the title and evidence of their article, or the evidence of their heaviest full text."""
    top = M.top_drivers(df, most, macro)
    rows = top.join(df.select("article_id", *(c for c in ("title", "url", "evidence_sentence") if c in df.columns)), "article_id")
    if "content_level" in df.columns and "evidence_sentence" in df.columns:
        full = df.where(F.col("content_level") == "fulltext").groupBy("event_key").agg(F.max_by("evidence_sentence", F.struct(S.number("agg_weight"), F.col("article_id"))).alias("full_"))
        rows = rows.join(full, "event_key", "left").withColumn("evidence_sentence", F.coalesce("full_", "evidence_sentence")).drop("full_")
    return rows.orderBy(F.desc("event_score"), "article_id")


def counts(df: DataFrame, column: str, most: int = 5) -> DataFrame:
    """The most frequent values that are not blank."""
    value = V.filled(F.col(column)).alias("value")
    return df.select(value).where("value <> ''").groupBy("value").agg(F.count("*").alias("articles")).orderBy(F.desc("articles"), "value").limit(most)


def extremes(df: DataFrame, positive: bool, most: int = 3) -> DataFrame:
    """Articles of the strongest scores on one side, one for each title."""
    order = [F.desc("sentiment_score") if positive else F.asc("sentiment_score"), F.asc("article_id")]
    own = df.where((F.col("sentiment_score") > 0) if positive else (F.col("sentiment_score") < 0)).where(V.filled(F.col("title")) != "")
    return one_row_per_key(own, ["title"], order).orderBy(*order).limit(most)


def coverage(df: DataFrame) -> DataFrame:
    """Number of articles and of distinct publishers (an article's sources where it has none), first and last time."""
    names = X.split_values(V.first_filled(F.col("publisher"), F.col("source")))
    total = df.agg(F.count("*").alias("articles"), F.min("published_at").alias("first"), F.max("published_at").alias("last"))
    return total.crossJoin(df.select(F.explode(names).alias("n")).agg(F.count_distinct("n").alias("publishers")))


def payload(spark: SparkSession, df: DataFrame, now: dt.datetime, source: str, market_before: DataFrame | None = None, sectors_before: DataFrame | None = None, macro: str = "error", weights: dict = config.ENHANCED) -> dict:
    """All of a brief as one dictionary; only tables of fixed size reach the driver."""
    own = window_of(df, now).persist()
    try:
        sectors = M.sector_metrics(spark, own, weights).persist()
        market = sectors.agg(*(F.avg(m).alias(m) for m in config.METRICS))
        day = F.lit(now.date())
        shown = lambda d: [r.asDict() for r in d.collect()]
        scores = market.select(*(metric(F.col(m)).alias(m) for m in config.METRICS)).first().asDict()
        change = deltas(market, previous(market_before, day, []), []).first() if market_before is not None else None
        moved = movers(sectors, previous(sectors_before, day, ["sector"])) if sectors_before is not None else None
        seen = coverage(own).first()
        titled = "title" in df.columns
        side = lambda up: shown(extremes(own, up).select("title", "sector")) if titled else []
        ranked: dict[str, list] = {}
        for r in rankings(sectors).orderBy("metric", "place").select("metric", "sector", F.round("score", 1).alias("score")).collect():
            ranked.setdefault(r["metric"], []).append({"sector": r["sector"], "score": r["score"]})
        iso = lambda t: t.isoformat() if t else None
        return {
            "generated_at": now.isoformat(timespec="seconds"),
            "data_window": {"start": (now - dt.timedelta(hours=WINDOW_HOURS)).isoformat(), "end": now.isoformat(), "hours": WINDOW_HOURS},
            "data_source": source,
            "market": {"scores": scores, "delta_vs_previous_day": {m: round(change[m], 1) if change and change[m] is not None else None for m in config.METRICS}},
            "sectors": {"rankings": ranked, "movers": shown(moved.select("sector", F.round("total_abs_delta", 1).alias("total_abs_delta"))) if moved is not None else []},
            "top_drivers": shown(drivers(own, macro=macro).drop("published_at")),
            "topic_distribution_top5": shown(counts(own, "topic")) if "topic" in df.columns else [],
            "risk_distribution_top5": {r["value"]: r["articles"] for r in counts(own, "risk_category").collect()} if "risk_category" in df.columns else {},
            "sector_sentiment_counts": shown(own.groupBy("sector").agg(F.count_if(F.col("sentiment_score") > 0).alias("positive"), F.count_if(F.col("sentiment_score") < 0).alias("negative")).orderBy("sector")),
            "sentiment_extremes": {"most_positive_top3": side(True), "most_negative_top3": side(False)},
            "unmapped_macro_titles": [r["title"] for r in own.where(F.col("sector") == macro).orderBy(F.desc("published_at"), "article_id").select("title").limit(5).collect()] if titled else [],
            "coverage": {"article_count": seen["articles"], "source_count": seen["publishers"], "time_range": {"min_published_at": iso(seen["first"]), "max_published_at": iso(seen["last"])}, "data_source": source},
        }
    finally:
        own.unpersist()


def tone(scores: dict) -> str:
    optimism, fear, risk = (scores.get(k) or 0.0 for k in ("optimism", "fear", "risk_intensity"))
    return "cautious" if risk >= 65 or fear >= 55 else "optimistic" if optimism >= 55 and fear < 45 else "neutral"


def rule_text(told: dict) -> str:
    """The brief in words, by rules from its payload."""
    scores, change = told["market"]["scores"], told["market"]["delta_vs_previous_day"]
    leader = lambda m: (told["sectors"]["rankings"].get(m) or [{"sector": "n/a"}])[0]["sector"]
    moves = [f"{LABELS[m]} {change[m]:+.1f}" for m in ("optimism", "fear", "risk_intensity") if change.get(m) is not None]
    seen = told["coverage"]
    names = [m["sector"] for m in told["sectors"]["movers"][:3]]
    risks = ", ".join(f"{k} ({v})" for k, v in told["risk_distribution_top5"].items())
    lines = [f"- {d.get('title') or d.get('event_key')}" for d in told["top_drivers"]]
    return "\n\n".join(
        [
            f"## Market\nThe tone of the last {told['data_window']['hours']} hours is {tone(scores)}: optimism {scores['optimism']:.1f}, fear {scores['fear']:.1f}, risk intensity {scores['risk_intensity']:.1f}. "
            + (f"Since the day before: {'; '.join(moves)}. " if moves else "There is no day before to compare with. ")
            + f"{seen['article_count']} articles of {seen['source_count']} sources.",
            f"## Groups\n{leader('optimism')} leads in optimism, {leader('risk_intensity')} in risk intensity." + (f" Most moved: {', '.join(names)}." if names else ""),
            "## Drivers\n" + ("\n".join(lines) or "Too little news for drivers."),
            f"## Risks\n{risks or 'No risk stands out.'}",
            DISCLAIMER,
        ]
    )


def due(now: dt.datetime, hour: int, latest: str | None) -> bool:
    """Whether a brief is to be made: from the given hour on, once a day; ``latest`` is when the last one was made."""
    return now.hour >= hour and not (latest and latest[:10] == now.date().isoformat())


def as_json(told: dict) -> str:
    return json.dumps(told, sort_keys=True, default=str, ensure_ascii=False)
