"""Daily snapshots of groups and market, attention history, article tables and results, with their older forms."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh import config
from quillmesh.functions.evidence import filled, first_filled
from quillmesh.functions.scoring import number
from quillmesh.functions.times import parsed
from quillmesh.operators import metrics as M
from quillmesh.sources import tables
from quillmesh.sources.scratch import Scratch
from quillmesh.sources.store import Change, Store

SECTOR = ("snapshot_date", "snapshot_timestamp", "data_source", "formula_version", "pipeline_revision", "sector", "article_count", "event_count", "publisher_count", "attention_volume", *config.METRICS)
MARKET = tuple(c for c in SECTOR if c not in ("sector", "event_count", "publisher_count", "attention_volume"))
# What rows of older tables are taken for.
OLD_FORMULA, OLD_REVISION = "baseline", "r1"
SENSITIVITY = ("data_source", "dimension", "component", "factor", "day_count", "sector_day_count", "mean_daily_spearman", "mean_absolute_score_change", "mean_daily_top3_jaccard")


def read(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A snapshot table (Parquet folder or CSV file) with these columns; an empty table where there is none to read."""
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    held = tables.stored(spark, path) if not path.endswith(".csv") else None
    if held is None and not tables.exists(spark, path):
        return empty
    try:
        df = held if held is not None else spark.read.csv(path, header=True, multiLine=True, escape='"') if path.endswith(".csv") else spark.read.parquet(path)
    except Exception as error:  # a damaged file counts as none, any other failure does not
        if type(error).__name__ not in ("AnalysisException", "UnsupportedOperationException"):
            raise
        return empty
    return df.select(*((F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns))


def upgraded(df: DataFrame) -> DataFrame:
    """Rows of older tables get the formula, revision and volume they stand for; numbers and dates are typed."""
    out = df.withColumns({"formula_version": first_filled(F.col("formula_version"), F.lit(OLD_FORMULA)), "pipeline_revision": first_filled(F.col("pipeline_revision"), F.lit(OLD_REVISION)), "snapshot_date": F.to_date("snapshot_date")})
    if "attention_volume" in df.columns:
        volume = F.nullif(filled(F.col("attention_volume")), F.lit("")).try_cast("double")
        out = out.withColumn("attention_volume", F.coalesce(volume, number("article_count")))
    return out.withColumns({m: number(m) for m in (*config.METRICS, "article_count")})


def chosen(df: DataFrame, source: str | None = None, formula: str | None = None) -> DataFrame:
    if source is not None:
        df = df.where(F.col("data_source") == source)
    return df if formula is None else df.where(F.col("formula_version") == formula)


def sectors(spark: SparkSession, path: str, source: str | None = None, formula: str | None = "enhanced") -> DataFrame:
    return chosen(upgraded(read(spark, path, SECTOR)), source, formula)


def market(spark: SparkSession, path: str, source: str | None = None, formula: str | None = "enhanced") -> DataFrame:
    return chosen(upgraded(read(spark, path, MARKET)), source, formula)


def attention_history(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(day, sector, volume), the last row of each day and group; the article count stands for a missing volume."""
    from quillmesh.operators.relations import one_row_per_key

    rows = one_row_per_key(sectors(spark, path, source, None), ["snapshot_date", "sector"], [F.desc_nulls_last("snapshot_timestamp")])
    return rows.select(F.col("snapshot_date").alias("day"), "sector", F.col("attention_volume").alias("volume"))


def snapshot_rows(spark: SparkSession, df: DataFrame, source: str, now: dt.datetime, revision: str = "r4") -> tuple[DataFrame, DataFrame]:
    """Rows of both formula versions for every group, and one for the market in each version."""
    df = _for_metrics(df)
    head = {"snapshot_date": F.lit(now.date()), "snapshot_timestamp": F.lit(now.isoformat(timespec="seconds")), "data_source": F.lit(source), "pipeline_revision": F.lit(revision)}
    events = df.groupBy("sector").agg(F.count_distinct("event_key").alias("event_count"))
    volume = M.attention_volume(spark, df).withColumnRenamed("volume", "attention_volume")
    made = M.snapshot(spark, df).withColumnRenamed("formula", "formula_version").withColumnRenamed("articles", "article_count").withColumnRenamed("publishers", "publisher_count")
    rows = made.join(events, "sector", "left").join(volume, "sector", "left").na.fill(0, ["event_count", "attention_volume"]).withColumns(head).select(*SECTOR)
    # both tables and their upserts read these few rows, which are many aggregates of the articles
    rows = Scratch(spark, "snapshot").save(rows, "rows")
    total = rows.groupBy("formula_version").agg(F.sum("article_count").alias("article_count"), *(F.avg(m).alias(m) for m in config.METRICS)).withColumns(head)
    six = {m: F.round(m, 6) for m in config.METRICS}
    return rows.withColumns(six), total.select(*MARKET).withColumns(six)


def _for_metrics(df: DataFrame) -> DataFrame:
    """Articles with the event and the typed times that metrics read."""
    if "event_key" not in df.columns:
        df = df.withColumn("event_key", first_filled(F.col("event_id"), F.col("article_id")))
    times = [c for c in ("published_at", "collected_at") if dict(df.dtypes).get(c) == "string"]
    return df.withColumns({c: parsed(F.col(c)) for c in times})


def _upsert(change: Change, sector_path: str, market_path: str, df: DataFrame, source: str, now: dt.datetime, revision: str) -> None:
    by_sector, by_market = snapshot_rows(df.sparkSession, df, source, now, revision)
    keys = ["snapshot_date", "data_source", "formula_version"]
    tables.upsert_into(change, sector_path, by_sector, [*keys, "sector"])
    tables.upsert_into(change, market_path, by_market, keys)


def write(spark: SparkSession, sector_path: str, market_path: str, df: DataFrame, source: str, now: dt.datetime, revision: str = "r4") -> None:
    """Upsert a day's rows of both tables, which lie in one folder, in one change; rows of other sources, formulas and
    days stay."""
    folder = tables.place_of(sector_path)[0]
    if folder != tables.place_of(market_path)[0]:
        raise ValueError("both tables must lie in one folder, so that they change together")
    change = Store(spark, folder).begin()
    _upsert(change, sector_path, market_path, df, source, now, revision)
    change.commit()


def write_outputs(spark: SparkSession, folder: str, articles: DataFrame, source: str, now: dt.datetime, revision: str = "r4") -> int:
    """Articles, those with an error, and the day's snapshots, from one evaluation of the articles and in one change."""
    change = Store(spark, folder).begin()
    change.replace("articles", articles)
    held = change.read("articles")
    change.replace("errors", held.where(filled(F.col("processing_error")) != ""))
    _upsert(change, f"{folder}/sectors", f"{folder}/market", held, source, now, revision)
    return change.commit()


def has_rows(df: DataFrame) -> bool:
    """Whether there is a row; reads one."""
    return not df.limit(1).isEmpty()


def select_articles(spark: SparkSession, paths: dict[str, str], mode: str, prefer_processed: bool = True) -> DataFrame:
    """Articles of a mode (real or demo): the processed table if it has rows, else the raw one, else none."""
    order = [f"{mode}_processed", f"{mode}_raw"] if prefer_processed else [f"{mode}_raw"]
    for name in order:
        if name in paths:
            df = tables.typed(tables.read_csv(spark, paths[name]))
            if has_rows(df):
                return df
    return tables.typed(spark.createDataFrame([], tables.ARTICLE))


def write_sensitivity(results: DataFrame, path: str) -> None:
    tables.require(results, list(SENSITIVITY))
    results.select(*SENSITIVITY).write.mode("overwrite").parquet(path)


def read_sensitivity(spark: SparkSession, path: str, source: str = "real") -> DataFrame:
    df = tables.require(spark.read.parquet(path), list(SENSITIVITY))
    if has_rows(df.where(~F.col("data_source").eqNullSafe(source))):
        raise ValueError(f"results of another source than {source}")
    return df


def trend(df: DataFrame, days: int, day: str = "snapshot_date") -> DataFrame:
    """Rows of the last days before the newest one, for series of at least two days."""
    newest = df.agg(F.max(day).alias("new_"), F.count_distinct(day).alias("n_"))
    return df.crossJoin(F.broadcast(newest)).where((F.col("n_") >= 2) & (F.col(day) > F.date_sub("new_", days))).drop("new_", "n_")
