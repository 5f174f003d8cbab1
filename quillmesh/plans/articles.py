"""Article records derived from the supplied tables.

Every column is integer arithmetic on an id, so the same record can be written in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    a, b, c = i * 7 % 10 + 1, i * 11 % 10 + 1, i * 13 % 10 + 1
    total = a + b + c
    base = table(spark, sf_dir, "events").select(
        i.alias("article_id"),
        F.col("event_type").alias("sector"),
        F.col("ts").cast("timestamp_ntz").alias("published_at"),
        F.to_date("ts").alias("day"),
        "user_id",
        F.concat(F.lit("src"), i % 20).alias("source"),
        F.concat(F.lit("user"), F.col("user_id")).alias("publisher"),
        (a / total).alias("p_positive"), (b / total).alias("p_neutral"), (c / total).alias("p_negative"),
        ((i * 37 % 201 - 100) / 100.0).alias("sentiment_score"),
        (i * 3 % 11 / 10.0).alias("b_bull"), (i * 5 % 11 / 10.0).alias("b_bear"), (i * 7 % 11 / 10.0).alias("g_growth"),
        (i * 9 % 11 / 10.0).alias("s_shock"), (i * 2 % 11 / 10.0).alias("k_unc"),
        (i * 17 % 101).cast("double").alias("risk_intensity"),
        (F.col("value") / 500.0).alias("agg_weight"),
        F.concat_ws("-", "user_id", F.to_date("ts").cast("string")).alias("event_key"),
    )
    return base.withColumn("entropy_norm", entropy_norm("p_positive", "p_neutral", "p_negative"))


def entropy_norm(*names: str):
    terms = [F.when(F.col(p) > 0, F.col(p) * F.log(F.col(p))).otherwise(0.0) for p in names]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return -total / F.log(F.lit(3.0))


SQL = """
art AS (
  SELECT event_id AS article_id, event_type AS sector, CAST(ts AS TIMESTAMP) AS published_at, CAST(ts AS DATE) AS day, user_id,
    'src' || (event_id % 20) AS source, 'user' || user_id AS publisher,
    a / (a + b + c) AS p_positive, b / (a + b + c) AS p_neutral, c / (a + b + c) AS p_negative,
    (event_id * 37 % 201 - 100) / 100.0::DOUBLE AS sentiment_score,
    event_id * 3 % 11 / 10.0::DOUBLE AS b_bull, event_id * 5 % 11 / 10.0::DOUBLE AS b_bear, event_id * 7 % 11 / 10.0::DOUBLE AS g_growth,
    event_id * 9 % 11 / 10.0::DOUBLE AS s_shock, event_id * 2 % 11 / 10.0::DOUBLE AS k_unc,
    CAST(event_id * 17 % 101 AS DOUBLE) AS risk_intensity, value / 500.0::DOUBLE AS agg_weight,
    user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS event_key,
    -(a/(a+b+c)*ln(a/(a+b+c)) + b/(a+b+c)*ln(b/(a+b+c)) + c/(a+b+c)*ln(c/(a+b+c))) / ln(3.0) AS entropy_norm
  FROM (SELECT *, CAST(event_id * 7 % 10 + 1 AS DOUBLE) AS a, CAST(event_id * 11 % 10 + 1 AS DOUBLE) AS b, CAST(event_id * 13 % 10 + 1 AS DOUBLE) AS c FROM events)
)"""
