"""A generated set of articles: twelve for each group at fixed times, the last two repeats of the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE, SLOTS = "2026-01-05T12:00:00Z", 12
TONES = ("rally", "selloff", "outlook")


def demo_articles(spark: SparkSession, groups: list[str]) -> DataFrame:
    """``SLOTS`` records of each group; slot 10 has the address of slot 0, slot 11 nearly its title."""
    i = F.col("id")
    slot, group = (i % SLOTS).cast("int"), F.element_at(F.array(*(F.lit(g) for g in groups)), (F.floor(i / SLOTS) + 1).cast("int"))
    like = F.when(slot >= SLOTS - 2, 0).otherwise(slot)
    tone = F.element_at(F.array(*(F.lit(t) for t in TONES)), (like % len(TONES) + 1).cast("int"))
    title = F.concat(group, F.lit(" shares see a "), tone, F.lit(" as report number "), like.cast("string"), F.lit(" for the quarter comes out today"), F.when(slot == SLOTS - 1, F.lit(" again")).otherwise(F.lit("")))
    at = F.lit(BASE).cast("timestamp") - F.make_interval(hours=slot * 5)
    text = F.concat(title, F.lit(". Analysts speak of a "), tone, F.lit(" in "), group, F.lit("."))
    address = F.concat(F.lit("https://demo.example/"), F.lower(F.regexp_replace(group, "[^A-Za-z]+", "-")), F.lit("/"), F.when(slot == SLOTS - 2, 0).otherwise(slot).cast("string"))
    iso = F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return spark.range(len(groups) * SLOTS).select(F.concat(F.lit("demo-"), F.lpad(i.cast("string"), 4, "0")).alias("article_id"), title.alias("title"), text.alias("summary"), F.lit("").alias("content"), address.alias("url"), F.concat(F.lit("Demo wire "), (slot % 3).cast("string")).alias("source"), group.alias("sector"), iso.alias("published_at"), F.lit(BASE).alias("collected_at"))
