"""Column builders for times; all are UTC whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.evidence import filled


def parsed(value: Column) -> Column:
    """An ISO time; without a zone it is UTC, and what is no time is null."""
    v = filled(value)
    day = F.when(v.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.concat(v, F.lit("T00:00:00"))).otherwise(v)
    zoned = F.when(day.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})\z"), day).otherwise(F.concat(day, F.lit("Z")))
    return F.when(v.rlike(r"\A\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(zoned))


def formatted(time: Column) -> Column:
    """ISO text of seconds."""
    return F.concat(F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def label(time: Column, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """Text for display; null is blank."""
    return F.coalesce(F.date_format(F.to_utc_timestamp(time, F.current_timezone()), pattern), F.lit(""))


def feed_time(value: Column, fallback: Column) -> Column:
    """A feed's time, as mail headers or ISO have it, else the fallback."""
    v = F.regexp_replace(filled(value), r"\A[A-Za-z]{3,9},\s*", "")
    named = F.regexp_replace(v, r"\b(?:GMT|UTC|UT|Z)\z", "+0000")
    return F.coalesce(F.try_to_timestamp(named, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(named, F.lit("d MMM yyyy HH:mm Z")), parsed(v), fallback)


def with_normal_times(df: DataFrame, now: Column) -> DataFrame:
    """collected_at (else now) and published_at (else collected_at) as UTC text, with the failures appended to the log."""
    collected, published = parsed(F.col("collected_at")), parsed(F.col("published_at"))
    wrong = lambda name, time, other: F.when(time.isNull(), F.concat(F.lit(f"{name}: invalid time '"), filled(F.col(name)), F.lit(f"'; fallback={other}")))
    log = F.col("time_parse_error") if "time_parse_error" in df.columns else F.lit(None).cast("string")
    errors = F.concat_ws("; ", F.nullif(filled(log), F.lit("")), wrong("collected_at", collected, "current_utc"), wrong("published_at", published, "collected_at"))
    got = F.coalesce(collected, now)
    return df.withColumns({"collected_at": formatted(got), "published_at": formatted(F.coalesce(published, got)), "time_parse_error": errors})
