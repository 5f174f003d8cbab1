"""Daily counts as a stream: file source, watermark, tumbling days, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, late: str = "72 hours") -> DataFrame:
    """(day, event_type, n) of a stream of events (ts, event_type); ``late`` is how long a day stays open."""
    days = F.window("at", "1 day")
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(days.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")


def daily_volume_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all days there are.  Each batch appends the days it changed to a Parquet table; as counts only grow, a
    day's count is the greatest one written, and days behind the watermark leave the state."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = f"{base or 'file:///tmp/checkpoints'}/volume-{uuid.uuid4().hex}"

    def append(rows: DataFrame, _: int) -> None:
        rows.write.mode("append").parquet(f"{root}/days")

    counts = daily_counts(stream)
    run = counts.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{root}/days").groupBy("day", "event_type").agg(F.max("n").alias("n"))
