"""Reading and writing of article and snapshot tables.

Tables that are updated are tables of a store (``store.py``), cut by day where they have one, so that a day's upsert
rewrites that day alone and readers see all of it or nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.sources.store import Change, Store

ARTICLE = T.StructType([T.StructField(n, T.StringType()) for n in ("article_id", "title", "summary", "content", "url", "source", "publisher", "sector", "tickers", "event_id", "risk_category", "published_at", "collected_at", "sentiment_score", "agg_weight", "risk_intensity")])
NUMBERS = ("sentiment_score", "agg_weight", "risk_intensity")
TIMES = ("published_at", "collected_at")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = ARTICLE) -> DataFrame:
    """All columns as text; a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def conform(df: DataFrame, schema: T.StructType = ARTICLE) -> DataFrame:
    """The schema's columns in order; what is missing is blank, what is more goes."""
    return df.select(*(F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit("")).alias(f.name) if f.name in df.columns else F.lit("").alias(f.name) for f in schema))


def typed(df: DataFrame) -> DataFrame:
    """Numbers (invalid: 0) and UTC times (invalid: null)."""
    out = conform(df)
    for n in NUMBERS:
        out = out.withColumn(n, F.coalesce(F.expr(f"try_cast(nullif(trim({n}), '') AS double)"), F.lit(0.0)))
    for t in TIMES:
        out = out.withColumn(t, F.try_to_timestamp(F.nullif(F.trim(t), F.lit(""))))
    return out


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def place_of(path: str) -> tuple[str, str]:
    """The store's folder and the table's name of a path."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return folder, name


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of a store that lies in the folder of ``path``, None where there is none."""
    folder, name = place_of(path)
    return Store(spark, folder).read(name)


def upsert_into(change: Change, path: str, new: DataFrame, keys: list[str], day: str = "snapshot_date") -> None:
    """Replace rows with the keys of ``new``; only the days that it has are read and written.  A plain table of older
    versions at ``path`` is taken over first."""
    name = place_of(path)[1]
    if name not in change.tables and exists(new.sparkSession, path):
        change.replace(name, new.sparkSession.read.parquet(path), day)
    change.upsert(name, new, keys, day)


def upsert_days(spark: SparkSession, path: str, new: DataFrame, keys: list[str], day: str = "snapshot_date") -> None:
    """``upsert_into`` as a change of its own."""
    change = Store(spark, place_of(path)[0]).begin()
    upsert_into(change, path, new, keys, day)
    change.commit()


def write_if_changed(spark: SparkSession, df: DataFrame, path: str) -> bool:
    """Write unless the table there has the same rows."""
    if exists(spark, path):
        old = spark.read.parquet(path)
        if set(old.columns) == set(df.columns) and old.select(df.columns).exceptAll(df).isEmpty() and df.exceptAll(old.select(df.columns)).isEmpty():
            return False
    df.write.mode("overwrite").parquet(path)
    return True
