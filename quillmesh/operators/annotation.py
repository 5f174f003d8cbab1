"""Samples for human labels, and how models do against the labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text as X
from quillmesh.functions.evidence import filled
from quillmesh.operators import evaluation as E

# Spellings of sentiment labels and of yes and no.
SENTIMENTS = {"positive": "positive", "pos": "positive", "正面": "positive", "neutral": "neutral", "neu": "neutral", "中性": "neutral", "negative": "negative", "neg": "negative", "负面": "negative"}
ANSWERS = {"yes": True, "y": True, "true": True, "1": True, "no": False, "n": False, "false": False, "0": False}
BLIND = ("article_id", "title", "summary", "content", "url", "published_at")
ASKED = ("label_sentiment", "label_sector_ok", "label_risk_categories", "label_evidence_ok")


def _looked_up(value: Column, table: dict) -> Column:
    known = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v))))
    return F.try_element_at(known, F.lower(filled(value)))


def sentiment_of(label: Column) -> Column:
    """The sentiment a label stands for; blank where it stands for none."""
    return F.coalesce(_looked_up(label, SENTIMENTS), F.lit(""))


def answer_of(label: Column) -> Column:
    return _looked_up(label, ANSWERS)


def checked_join(left: DataFrame, right: DataFrame, key: str, one_to_one: bool = True) -> DataFrame:
    """Inner join on a key that must be filled and unique on both sides and, if ``one_to_one``, matched on both."""
    for name, side in (("left", left), ("right", right)):
        bad = side.groupBy(key).agg(F.count("*").alias("n")).agg(F.count_if(filled(F.col(key)) == "").alias("blank"), F.count_if(F.col("n") > 1).alias("twice")).first()
        if bad["blank"] or bad["twice"]:
            raise ValueError(f"{name}: {bad['blank']} blank and {bad['twice']} repeated values of {key}")
    if one_to_one:
        lost = left.join(right, key, "left_anti").count(), right.join(left, key, "left_anti").count()
        if any(lost):
            raise ValueError(f"values of {key} without a partner: {lost[0]} left, {lost[1]} right")
    return left.join(right, key)


def completed_cells(df: DataFrame, columns: tuple[str, ...] = ASKED) -> DataFrame:
    return df.agg(sum((F.count_if(filled(F.col(c)) != "") for c in columns), F.lit(0)).alias("completed"))


def accuracy(df: DataFrame, actual: str, predicted: str, name: str) -> DataFrame:
    """(name, n, correct, accuracy) over rows with a label, case ignored."""
    a, p = F.lower(filled(F.col(actual))), F.lower(filled(F.col(predicted)))
    n, right = F.count_if(a != ""), F.count_if((a != "") & (a == p))
    return df.agg(F.lit(name).alias("name"), n.alias("n"), right.alias("correct"), F.coalesce(F.try_divide(right, n), F.lit(0.0)).alias("accuracy"))


def comparison(df: DataFrame, spark: SparkSession, actual: str, models: dict[str, Column]) -> DataFrame:
    """Accuracy and macro F1 of several predictions of one label."""
    out = None
    for name, column in models.items():
        rows = df.select(sentiment_of(F.col(actual)).alias("actual"), column.alias("predicted")).where("actual <> ''")
        report = E.class_report(rows, spark).agg(F.avg("f1").alias("macro_f1"))
        hit = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col("actual") == F.col("predicted")).cast("double")), F.lit(0.0)).alias("accuracy"))
        row = hit.crossJoin(report).select(F.lit(name).alias("model"), "n", "accuracy", "macro_f1")
        out = row if out is None else out.union(row)
    return out


def most_probable(p: dict[str, Column]) -> Column:
    """Class of the greatest probability; of equals the first."""
    best = F.array_max(F.array(*(F.struct(v.alias("p"), F.lit(-i).alias("o"), F.lit(k).alias("label")) for i, (k, v) in enumerate(p.items()))))
    return best["label"]


def risk_report(df: DataFrame, actual: str, predicted: str, labels: list[str], spark: SparkSession) -> DataFrame:
    """Precision, recall, F1 and support of each label of ``;`` lists; a label outside the list is an error."""
    a, p = X.split_values(F.lower(filled(F.col(actual))), ";"), X.split_values(F.lower(filled(F.col(predicted))), ";")
    known = F.array(*(F.lit(x) for x in labels))
    rows = df.select(a.alias("a"), p.alias("p"))
    odd = rows.select(F.explode(F.array_except("a", known)).alias("x")).distinct().limit(5).collect()
    if odd:
        raise ValueError(f"unknown labels: {', '.join(sorted(r['x'] for r in odd))}")
    flags = F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.array_contains("a", x).alias("t"), F.array_contains("p", x).alias("g")) for x in labels)))
    sums = rows.select(flags.alias("v")).groupBy("v.label").agg(F.count_if(F.col("v.t") & F.col("v.g")).alias("tp"), F.count_if("v.t").alias("support"), F.count_if("v.g").alias("guessed"))
    every = spark.createDataFrame([(x,) for x in labels], "label string").join(sums, "label", "left").na.fill(0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    precision, recall = zero(F.try_divide("tp", "guessed")), zero(F.try_divide("tp", "support"))
    return every.select("label", precision.alias("precision"), recall.alias("recall"), zero(F.try_divide(2 * F.col("tp"), F.col("guessed") + F.col("support"))).alias("f1"), "support")


def brier(df: DataFrame, actual: str) -> DataFrame:
    """Mean squared distance of renormalised probabilities from the label."""
    p = {v: F.col(f"p_{v}").cast("double") for v in E.LABELS}
    total = p["positive"] + p["neutral"] + p["negative"]
    off = sum((F.pow(F.coalesce(F.try_divide(x, total), F.lit(0.0)) - (F.col(actual) == v).cast("int"), 2) for v, x in p.items()), F.lit(0.0))
    return df.where(F.col(actual) != "").agg(F.avg(off).alias("brier"))


def evaluate(blind: DataFrame, key: DataFrame, spark: SparkSession, risks: list[str]) -> dict[str, DataFrame]:
    """All reports of labelled rows against the predictions kept in their key."""
    both = checked_join(blind, key, "article_id").withColumn("actual", sentiment_of(F.col("label_sentiment")))
    labelled = both.where("actual <> ''")
    p = {v: F.col(f"p_{v}").cast("double") for v in E.LABELS}
    total = p["positive"] + p["neutral"] + p["negative"]
    guess = F.lower(filled(F.col("predicted_sentiment_finbert")))
    pairs = labelled.select("actual", guess.alias("predicted"))
    yes = lambda c: both.select(answer_of(F.col(c)).alias("ok")).where("ok is not null").agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("share"))
    return {
        "confusion": E.confusion(pairs, spark),
        "classes": E.class_report(pairs, spark),
        "comparison": comparison(both, spark, "label_sentiment", {"model": guess, "all neutral": F.lit("neutral")}),
        "calibration": E.calibration(labelled.select(F.coalesce(F.try_divide(F.greatest(*p.values()), total), F.lit(0.0)).alias("confidence"), (F.col("actual") == most_probable(p)).cast("int").alias("correct"))),
        "brier": brier(labelled, "actual"),
        "errors": labelled.where(F.col("actual") != guess).select("article_id", "actual", guess.alias("predicted")),
        "sector": yes("label_sector_ok"),
        "evidence": yes("label_evidence_ok"),
        "risks": risk_report(both.where(filled(F.col("label_risk_categories")) != ""), "label_risk_categories", "predicted_risk_categories", risks, spark),
    }


def blind_and_key(raw: DataFrame, processed: DataFrame, size: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """A balanced sample in two tables with the same ids: texts with empty labels, and the predictions."""
    p = {v: F.col(f"p_{v}").cast("double") for v in E.LABELS}
    both = checked_join(raw.select(*BLIND), processed.drop(*(c for c in BLIND if c != "article_id")), "article_id", one_to_one=False)
    rows = both.withColumn("guess_", most_probable(p)).withColumn("stratum_", F.concat_ws("|", "sector", "guess_"))
    chosen = E.stratified_sample(rows, "stratum_", "article_id", size, seed)
    blind = chosen.select(*BLIND, *(F.lit("").alias(c) for c in ASKED), F.lit("").alias("notes"))
    key = chosen.select("article_id", F.col("sector").alias("stratum_sector"), F.col("guess_").alias("stratum_sentiment"), F.col("guess_").alias("predicted_sentiment_finbert"), F.col("sector").alias("predicted_sector"), F.col("risk_category").alias("predicted_risk_categories"), F.col("evidence_sentence").alias("predicted_evidence_sentence"), F.greatest(*p.values()).alias("finbert_confidence"), *(f"p_{v}" for v in E.LABELS))
    return blind, key


def fingerprint(ids: DataFrame, column: str = "article_id", group: tuple[str, ...] = ()) -> DataFrame:
    """Digest of the ordered ids of a batch, or of each group, from digests of its ids, so that no row holds them all."""
    each = ids.select(*group, F.sha2(F.col(column).cast("string"), 256).alias("h"))
    parts = each.groupBy(*group, F.substring("h", 1, 3).alias("k")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("p"))
    whole = [F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]), ""), 256).alias("fingerprint"), F.count("*").alias("parts")]
    return parts.groupBy(*group).agg(*whole) if group else parts.agg(*whole)


def chosen_errors(errors: DataFrame, true: list[str], predicted: list[str]) -> DataFrame:
    """Errors (true_sentiment, predicted_sentiment, ...) with one of the true and one of the predicted labels."""
    return errors.where(F.col("true_sentiment").isin(true) & F.col("predicted_sentiment").isin(predicted))
