"""Weighted aggregates.  Nulls count as zeros; a group without positive weight weighs every row 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.scoring import number

#: Ranges of values that a group is cut into where its values must be in order; no task orders more than one.
BLOCKS = 64


def with_totals(df: DataFrame, group: list[str], **sums: Column) -> DataFrame:
    """``df`` with aggregates of its groups, aggregated before a shuffle and joined back; the groups are few, so the join
    is a broadcast wherever their table is small, and no task holds a group's rows."""
    if not group:
        return df.crossJoin(F.broadcast(df.agg(*(v.alias(k) for k, v in sums.items()))))
    totals = df.groupBy(*(F.col(g).alias(f"of_{g}") for g in group)).agg(*(v.alias(k) for k, v in sums.items()))
    same = [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in group]
    return df.join(totals, same, "left").drop(*(f"of_{g}" for g in group))


def with_safe_weight(df: DataFrame, group: list[str], weight: str = "agg_weight", out: str = "w") -> DataFrame:
    w = F.greatest(number(weight), F.lit(0.0))
    return with_totals(df, group, total_=F.sum(w)).withColumn(out, F.when(F.col("total_") <= 0, 1.0).otherwise(w)).drop("total_")


def wmean(value: Column, w: str = "w") -> Column:
    return F.sum(F.coalesce(value, F.lit(0.0)) * F.col(w)) / F.sum(w)


def weighted_std(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Population deviation about the weighted mean, in two passes; 0 for fewer than two rows."""
    x = number(value)
    marked = with_totals(df, group, mean_=F.sum(x * F.col("w")) / F.sum("w")).withColumn("gap", F.pow(x - F.col("mean_"), 2))
    return marked.groupBy(*group).agg(F.when(F.count("*") < 2, 0.0).otherwise(F.sqrt(F.greatest(F.sum(F.col("gap") * F.col("w")) / F.sum("w"), F.lit(0.0)))).alias("weighted_std"))


def ties(df: DataFrame, group: list[str], value: str, weight: str = "agg_weight") -> DataFrame:
    """(group, v, vw, vw2, n): weights, squared weights and rows of equal values, with the safe weight of their group."""
    w = F.greatest(number(weight), F.lit(0.0))
    sums = df.groupBy(*group, number(value).alias("v")).agg(F.sum(w).alias("vw"), F.sum(w * w).alias("vw2"), F.count("*").alias("n"))
    return safe_ties(sums, group)


def safe_ties(sums: DataFrame, group: list[str]) -> DataFrame:
    """Sums of equal values in which a group without positive weight weighs every row 1."""
    none = F.col("total_") <= 0
    rows = with_totals(sums, group, total_=F.sum("vw"))
    return rows.withColumns({"vw": F.when(none, F.col("n").cast("double")).otherwise(F.col("vw")), "vw2": F.when(none, F.col("n").cast("double")).otherwise(F.col("vw2"))}).drop("total_")


def in_blocks(tied: DataFrame, group: list[str], blocks: int) -> DataFrame:
    """``tied`` with ``block``: the place of ``v`` among cuts of its group, so that blocks are ascending ranges of values
    with about as many distinct values each."""
    if blocks <= 1:
        return tied.withColumn("block", F.lit(0))
    cuts = F.percentile_approx("v", [k / blocks for k in range(1, blocks)], max(10_000, 20 * blocks))
    return with_totals(tied, group, cuts_=cuts).withColumn("block", F.coalesce(F.size(F.filter("cuts_", lambda c: c < F.col("v"))), F.lit(0))).drop("cuts_")


def least_reaching(tied: DataFrame, group: list[str], mass: str, targets: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(group, label, v): the least value of each group at which the mass of all values up to it reaches ``target``.

    Masses are summed by block, the block that decides is found on these sums, and only its values are made distinct and
    put in order.  ``tied`` may hold a value in several rows.  targets: (group, label, target).
    """
    rows = in_blocks(tied, group, blocks)
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, "block").agg(F.sum(mass).alias("mass_")).withColumn("before_", F.coalesce(F.sum("mass_").over(before), F.lit(0)))
    same = [F.col(f"of_{g}").eqNullSafe(F.col(g)) for g in group]
    named = lambda df: df.select(*(F.col(g).alias(f"of_{g}") for g in group), *(c for c in df.columns if c not in group))
    decides = named(targets).join(sums, [*same, F.col("before_") + F.col("mass_") >= F.col("target")]).groupBy(*group, "label", "target").agg(F.min(F.struct("block", "before_")).alias("b_"))
    chosen = named(decides.select(*group, "label", "target", F.col("b_.block").alias("block_"), F.col("b_.before_").alias("before_")))
    run = Window.partitionBy(*group, "label", "block_").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.join(F.broadcast(chosen), [*same, F.col("block") == F.col("block_")]).groupBy(*group, "label", "block_", "before_", "target", "v").agg(F.sum(mass).alias("mass_"))
    inside = held.withColumn("cum_", F.col("before_") + F.sum("mass_").over(run))
    return inside.where("cum_ >= target").groupBy(*group, "label").agg(F.min("v").alias("v"))


def quantile_of(tied: DataFrame, group: list[str], q: float, out: str, blocks: int = BLOCKS) -> DataFrame:
    """Least value whose cumulative weight reaches q of all."""
    targets = tied.groupBy(*group).agg((q * F.sum("vw") - 1e-12).alias("target")).withColumn("label", F.lit(0))
    return least_reaching(tied, group, "vw", targets, blocks).select(*group, F.col("v").alias(out))


def weighted_quantile(df: DataFrame, group: list[str], value: str, q: float, out: str, blocks: int = BLOCKS) -> DataFrame:
    """Least value whose cumulative weight ``w`` reaches q of all; only the values of one block are ever grouped."""
    return quantile_of(df.select(*group, number(value).alias("v"), F.col("w").alias("vw")), group, q, out, blocks)


def percentiles(df: DataFrame, group: list[str], value: str, at: list[float], blocks: int = BLOCKS) -> DataFrame:
    """(group, label, v): exact percentiles ``at[label]`` of non-null values, between neighbours in proportion."""
    tied = df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("v"), F.lit(1).cast("long").alias("n"))
    ranks = tied.groupBy(*group).agg((F.sum("n") - 1).alias("last")).select(*group, F.posexplode(F.array(*(F.lit(float(p)) for p in at))).alias("label", "p"), "last").withColumn("rank", F.col("p") * F.col("last"))
    ends = ranks.select(*group, F.explode(F.array(F.floor("rank"), F.ceil("rank"))).alias("r")).distinct().select(*group, F.col("r").alias("label"), (F.col("r") + 1).alias("target"))
    values = least_reaching(tied, group, "n", ends, blocks)
    same = [F.col(f"of_{g}").eqNullSafe(F.col(g)) for g in group]
    other = values.select(*(F.col(g).alias(f"of_{g}") for g in group), F.col("label").alias("r"), F.col("v").alias("x"))
    near = ranks.join(other, [*same, (F.col("r") == F.floor("rank")) | (F.col("r") == F.ceil("rank"))])
    low, high = F.min(F.struct("r", "x"))["x"], F.max(F.struct("r", "x"))["x"]
    return near.groupBy(*group, "label", "rank").agg((low + (high - low) * (F.first("rank") - F.floor(F.first("rank")))).alias("v")).drop("rank")


def distance_of(tied: DataFrame, group: list[str], normalization: float = 2.0, blocks: int = BLOCKS) -> DataFrame:
    """Weighted mean of |a - b| over all pairs, over ``normalization``, in order n log n from running sums.

    Running sums go over the distinct values of a block; what earlier blocks add to a block follows from its sums.
    """
    rows = in_blocks(tied, group, blocks)
    inside = Window.partitionBy(*group, "block").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    running = lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0.0))
    mine = rows.withColumn("part", F.col("vw") * (F.col("v") * running(F.col("vw"), inside) - running(F.col("vw") * F.col("v"), inside)))
    sums = mine.groupBy(*group, "block").agg(F.sum("part").alias("part"), F.sum("vw").alias("s"), F.sum(F.col("vw") * F.col("v")).alias("m"), F.sum("vw2").alias("q"), F.sum("n").alias("n"))
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = sums.withColumn("part", F.col("part") + F.col("m") * running(F.col("s"), before) - F.col("s") * running(F.col("m"), before))
    pairs = (F.pow(F.sum("s"), 2) - F.sum("q")) / 2
    value_ = F.coalesce(F.try_divide(F.sum("part"), normalization * pairs), F.lit(0.0))
    return whole.groupBy(*group).agg(F.when(F.sum("n") < 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value_))).alias("distance"))


def pairwise_distance(df: DataFrame, group: list[str], value: str, normalization: float = 2.0, blocks: int = BLOCKS) -> DataFrame:
    """``distance_of`` rows with weights ``w``."""
    tied = df.groupBy(*group, number(value).alias("v")).agg(F.sum("w").alias("vw"), F.sum(F.col("w") * F.col("w")).alias("vw2"), F.count("*").alias("n"))
    return distance_of(tied, group, normalization, blocks)


def polarity_mix(score: Column, threshold: float = 0.15) -> Column:
    side = F.least(F.sum(F.when(score > threshold, F.col("w")).otherwise(0.0)), F.sum(F.when(score < -threshold, F.col("w")).otherwise(0.0)))
    return F.when(F.count("*") < 2, 0.0).otherwise(2 * side / F.sum("w"))


def counted_before(df: DataFrame, group: list[str], order: str, value: str, out: str) -> DataFrame:
    """``df`` with the number of its group's earlier rows, by ``order``, whose value is not above its own (null: none).

    Counting by merging: rows are halved again and again by their place, and at each level the rows of a right half count
    those of the left half beside it, in one running count over sorted values.  n log n rows instead of n squared pairs.
    """
    place = F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1
    rows = with_totals(df.withColumn("place_", place), group, last_=F.max("place_"))
    known = rows.where(F.col(value).isNotNull()).select(*group, "place_", "last_", F.col(value).alias("v_"))
    levels = F.filter(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2), k) <= F.col("last_"))
    each = known.select(*group, "place_", "v_", F.explode(levels).alias("level")).withColumns({"pair_": F.floor(F.col("place_") / F.pow(F.lit(2), F.col("level") + 1)), "left_": F.floor(F.col("place_") / F.pow(F.lit(2), F.col("level"))) % 2 == 0})
    running = Window.partitionBy(*group, "level", "pair_").orderBy("v_").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counts = each.withColumn("n_", F.sum(F.col("left_").cast("long")).over(running)).where("not left_")
    found = counts.groupBy(*(F.col(g).alias(f"of_{g}") for g in group), F.col("place_").alias("at_")).agg(F.sum("n_").alias(out))
    same = [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in group]
    joined = rows.join(found, [*same, F.col("place_") == F.col("at_")], "left")
    return joined.withColumn(out, F.coalesce(out, F.lit(0).cast("long"))).drop("place_", "last_", "at_", *(f"of_{g}" for g in group))


def zero_fill(spark, df: DataFrame, domain: tuple[str, ...], key: str = "sector") -> DataFrame:
    """Every member of the domain, with zeros where ``df`` lacks it."""
    names = spark.createDataFrame([(d,) for d in domain], f"{key} string")
    numbers = [f.name for f in df.schema.fields if f.name != key and f.dataType.typeName() != "string"]
    return names.join(df, key, "left").na.fill(0, numbers)


def average_rank(order: Column, group: list[Column | str], value: Column) -> Column:
    """Rank with ties sharing their mean."""
    w = Window.partitionBy(*group).orderBy(order)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*group, value)) - 1) / 2.0
