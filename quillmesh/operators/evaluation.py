"""Evaluation of predictions and stability of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LABELS = ("positive", "neutral", "negative")


def confusion(df: DataFrame, spark: SparkSession, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Counts of predictions by true label, with zeros, for (actual, predicted)."""
    counts = df.groupBy("actual").agg(*(F.count_if(F.col("predicted") == v).alias(v) for v in labels))
    return spark.createDataFrame([(v,) for v in labels], "actual string").join(counts, "actual", "left").na.fill(0)


def class_report(df: DataFrame, spark: SparkSession, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Precision, recall, F1 and support of each label; a ratio over nothing is 0."""
    flags = F.explode(F.array(*(F.struct(F.lit(v).alias("label"), (F.col("actual") == v).alias("t"), (F.col("predicted") == v).alias("p")) for v in labels)))
    sums = df.select(flags.alias("x")).groupBy("x.label").agg(F.count_if(F.col("x.t") & F.col("x.p")).alias("tp"), F.count_if("x.t").alias("support"), F.count_if("x.p").alias("guessed"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    precision, recall = zero(F.try_divide("tp", "guessed")), zero(F.try_divide("tp", "support"))
    all_ = spark.createDataFrame([(v,) for v in labels], "label string").join(sums, "label", "left").na.fill(0)
    return all_.select("label", precision.alias("precision"), recall.alias("recall"), zero(F.try_divide(2 * precision * recall, precision + recall)).alias("f1"), "support")


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """Count, mean confidence and accuracy per confidence bin, for (confidence, correct)."""
    bin_ = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def stratified_sample(df: DataFrame, stratum: str, key: str, size: int, seed: int) -> DataFrame:
    """Rows taken round-robin from the strata, in the order of seeded digests.

    No stratum gives more than ``size`` rows, so each task passes on its first ``size`` of a stratum at most.
    """
    digest = lambda c: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(c).cast("string")))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(digest(key), key))
    return df.withColumn("round", rank).where(F.col("round") <= size).orderBy("round", digest(stratum), stratum).limit(size).drop("round")


def daily_spearman(df: DataFrame) -> DataFrame:
    """Rank correlation of x and y per day; two equal rankings give 1, a constant one 0."""

    def ranked(c: str):
        return F.rank().over(Window.partitionBy("day").orderBy(c)) + (F.count("*").over(Window.partitionBy("day", c)) - 1) / 2.0

    r = df.select("day", ranked("x").alias("x"), ranked("y").alias("y"))
    n, sx, sy = F.count("*"), F.sum("x"), F.sum("y")
    cov, vx, vy = F.sum(F.col("x") * F.col("y")) * n - sx * sy, F.sum(F.col("x") * F.col("x")) * n - sx * sx, F.sum(F.col("y") * F.col("y")) * n - sy * sy
    same = F.sum(F.abs(F.col("x") - F.col("y"))) == 0
    return r.groupBy("day").agg(F.when(same, 1.0).otherwise(F.coalesce(F.try_divide(cov, F.sqrt(vx * vy)), F.lit(0.0))).alias("spearman"))
