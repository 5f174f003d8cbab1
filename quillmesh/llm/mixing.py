"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are grouped into cells of source, language and topic, with their token sums.  Raking scales the cells' weights
to the targets of each marginal in turn until all marginals fit.  A document's probability of being sampled is its
cell's weight over its cell's tokens times a common factor, at most 1, with the factor chosen so that the expected
tokens are ``budget`` of all.  The draw is a hash of seed, doc_id and text, so it does not depend on partitions.

Targets not given are the natural shares to the power ``temper``, made to sum to one.  The table of cells has at most
the product of the numbers of sources, languages and topics, whatever the number of documents, and is raked in one task;
all that is done to documents is a partial aggregation before and a join with that table after.

Defined cases: null source, language and text are values of their own ("" for source and language); null and empty texts
have no tokens and probability 1 (they cost nothing); null doc_id is drawn by its text alone; repeated rows share a draw;
marginals that cannot all be met (empty cells) are fitted for ``ROUNDS`` rounds, and the gap left is a column of the
cells; an empty table gives no rows; other columns are ignored, but for mix_* columns, whose names are the operator's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.work import Work

DIMENSIONS = ("source", "lang", "topic")
BUDGET, TEMPER, SEED = 0.7, 0.5, "mix-1"
STEPS, ROUNDS, CLOSE = 4, 50, 1e-6


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A document's topic by its form; takes the place of a classifier's label."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(text.rlike(r"[#*$%&]{3}"), "marked")
        .when(tokens < 50, "note")
        .when(tokens < 500, "prose")
        .otherwise("long prose")
    )


def described(docs: DataFrame) -> DataFrame:
    """``docs`` with what mixing needs to know of each document."""
    text = F.col("text").cast("string")
    mark = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), F.col("doc_id").cast("string"), F.md5(F.coalesce(text, F.lit(""))))), 1, 13), 16, 10)
    plus = docs.withColumn("mix_tokens", token_count(text))
    return plus.withColumns(
        {
            "mix_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "mix_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
            "mix_topic": F.coalesce(topic_of(text, F.col("mix_tokens")), F.lit("note")),
            "mix_draw": mark.cast("double") / F.lit(float(16**13)),
        }
    )


def _targets(cells: DataFrame, targets: dict[str, dict[str, float]] | None, temper: float) -> DataFrame:
    for d in DIMENSIONS:
        own = Window.partitionBy(d)
        if targets and d in targets:
            given = F.create_map(*(x for k, v in targets[d].items() for x in (F.lit(k), F.lit(float(v)))))
            raw = F.coalesce(F.try_element_at(given, F.col(d)), F.lit(0.0))
        else:
            raw = F.pow(F.sum("tokens").over(own), F.lit(temper))
        cells = cells.withColumn(f"raw_{d}", raw).withColumn(f"n_{d}", F.count("*").over(own))
        cells = cells.withColumn(f"target_{d}", F.col(f"raw_{d}") / F.sum(F.col(f"raw_{d}") / F.col(f"n_{d}")).over(Window.partitionBy(F.lit(1)))).drop(f"raw_{d}", f"n_{d}")
    return cells


def raked_cells(work: Work, told: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, temper: float = TEMPER) -> DataFrame:
    """(source, lang, topic, tokens, weight, probability, gap): weight is the cell's share of the mix, gap how far the
    worst marginal is from its target."""
    counted = told.groupBy(*(F.col(f"mix_{d}").alias(d) for d in DIMENSIONS)).agg(F.sum("mix_tokens").cast("double").alias("tokens")).where("tokens > 0")
    cells = _targets(counted.coalesce(1), targets, temper)
    everything = Window.partitionBy(F.lit(1))
    cells = work.save(cells.withColumn("weight", F.col("tokens") / F.sum("tokens").over(everything)), "cells-0")
    gap = None
    for step in range(1, ROUNDS + 1):
        now = cells.coalesce(1)
        for _ in range(STEPS):
            for d in DIMENSIONS:
                now = now.withColumn("weight", F.col("weight") * F.coalesce(F.try_divide(F.col(f"target_{d}"), F.sum("weight").over(Window.partitionBy(d))), F.lit(0.0)))
        cells = work.save(now, f"cells-{step}")
        off = reduce(F.greatest, (F.max(F.abs(F.col(f"at_{d}") - F.col(f"target_{d}"))) for d in DIMENSIONS))
        at = cells.coalesce(1).select("*", *(F.sum("weight").over(Window.partitionBy(d)).alias(f"at_{d}") for d in DIMENSIONS))
        gap = at.agg(off.alias("off")).first()["off"]
        work.drop(f"cells-{step - 1}")
        if gap is None or gap < CLOSE:
            break
    now = cells.coalesce(1).withColumn("grain", F.col("weight") / F.col("tokens")).withColumn("factor", F.lit(0.0))
    total = F.sum("tokens").over(everything)
    for _ in range(8):
        full = F.col("factor") * F.col("grain") >= 1
        free = F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).over(everything)
        used = F.sum(F.when(full, F.col("tokens")).otherwise(0.0)).over(everything)
        now = now.withColumn("factor", F.greatest(F.col("factor"), F.coalesce(F.try_divide(budget * total - used, free), F.lit(0.0))))
    probability = F.round(F.least(F.lit(1.0), F.col("factor") * F.col("grain")), 9)
    return work.save(now.select(*DIMENSIONS, "tokens", "weight", probability.alias("probability"), F.lit(float(gap or 0.0)).alias("gap")), "raked")


def mixed(spark: SparkSession, docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, temper: float = TEMPER) -> DataFrame:
    """``docs`` with mix_* columns: source, lang, topic, tokens, draw, weight, probability and whether it is sampled."""
    told = described(docs)
    cells = raked_cells(Work(spark, "mix"), told, targets, budget, temper)
    cells = cells.select(*(F.col(d).alias(f"cell_{d}") for d in DIMENSIONS), F.col("weight").alias("mix_weight"), F.col("probability").alias("mix_probability"))
    same = reduce(lambda a, b: a & b, (F.col(f"mix_{d}") == F.col(f"cell_{d}") for d in DIMENSIONS))
    out = told.join(cells, same, "left").drop(*(f"cell_{d}" for d in DIMENSIONS))
    out = out.withColumn("mix_probability", F.when(F.col("mix_tokens") == 0, 1.0).otherwise(F.coalesce("mix_probability", F.lit(0.0))))
    return out.withColumn("mix_sampled", F.col("mix_draw") < F.col("mix_probability"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"),
        F.col("mix_tokens").alias("n_tokens"), F.round(F.coalesce("mix_weight", F.lit(0.0)), 6).alias("cell_share"), F.round("mix_probability", 6).alias("probability"), F.col("mix_sampled").alias("sampled"),
    )


def sampled_rows(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are sampled, with their columns as they were, whatever their names."""
    kept = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("mix_row")
    return mixed(spark, docs.select(kept, "doc_id", "text", "lang", "source"), **options).where("mix_sampled").select("mix_row.*")
