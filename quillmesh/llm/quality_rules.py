"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Each rule rejects a document whose score is at least a cutoff.  Cutoffs come from labelled documents held out for that:
for every stratum (language), rule and cutoff of a fixed grid, with n clean holdout documents of which the rule would
reject k, the exact binomial tail P(Bin(n, alpha_rule) <= k) tests "the rule falsely rejects at least alpha_rule".
The cutoffs of a stratum and rule are tested in the fixed order from the highest down until one fails (which needs no
correction within the sequence), each at delta over the number of sequences (Bonferroni); the stratum takes the lowest
cutoff that passed, or none.  As k only grows down the grid, those are the cutoffs whose tail is small enough.  alpha_rule is alpha over the number of rules, so with probability 1 - delta
no stratum loses more than alpha of its clean documents to all rules together.

The rule on flagged words uses a list learnt from at most ``SAMPLE`` labelled documents of the other half.  All counts of
the texts cover every document.

Defined cases: null and empty texts have no words and fail the base rule; a null or unknown language is a stratum of its
own (without labels: no cutoffs); several labels of a document count as the least quality and the greatest toxicity;
null doc_id is kept and unlabelled; repeated rows are judged each for itself; without labels only the base rule rejects;
an empty table gives no rows; other columns are ignored.  Word windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.work import Work

WHITE = r"[\x20\x09-\x0D]+"
ALPHA, DELTA, SAMPLE, FLAGGED = 0.05, 0.05, 8000, 200
#: Ids of the holdout that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Ascending cutoffs of each rule's score.
GRID: dict[str, list[float]] = {
    "symbols_per_word": [0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9],
    "duplicate_line_share": [0.1, 0.2, 0.3, 0.4, 0.5, 0.7],
    "repeated_word_share": [0.05, 0.1, 0.15, 0.2, 0.3, 0.4],
    "mean_word_length": [7.0, 8.0, 9.0, 10.0, 12.0, 15.0],
    "flagged_word_share": [0.002, 0.005, 0.01, 0.02, 0.04],
    "exclamations_per_word": [0.1, 0.2, 0.3, 0.5, 0.8],
}


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def _bare(word: Column) -> Column:
    return F.lower(F.rtrim(word, F.lit(".,;:!?*#$%&")))


def features(docs: DataFrame, flagged: list[str], also: list[str] | None = None) -> DataFrame:
    """doc_id, lang and the counts of every text, and the columns ``also``."""
    also = also or []
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text.alias("t"), *also).withColumn("w", word_array(F.col("t")))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.when(
        F.size("w") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))),
    )
    hits = F.size(F.filter("w", lambda x: _bare(x).isin(flagged))) if flagged else F.lit(0)
    two = one.select(
        "doc_id", "lang", *also,
        F.size("w").cast("long").alias("n_words"),
        F.coalesce(F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)), F.lit(0)).alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit("!")).cast("long").alias("n_exclamations"),
        hits.cast("long").alias("n_flagged"),
        lines.alias("lines"), windows.alias("h"),
    )
    three = two.select(
        "doc_id", "lang", *also, "n_words", "word_chars", "n_symbols", "n_exclamations", "n_flagged",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s"),
    )
    near = lambda x, i: x["x"].eqNullSafe(F.get("s", i - 1)["x"]) | x["x"].eqNullSafe(F.get("s", i + 1)["x"])
    places = F.sort_array(F.transform(F.filter("s", near), lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    return three.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("s")


def scores() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "duplicate_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeated_word_share": F.col("n_repeat_words") / words,
        "mean_word_length": F.col("word_chars") / words,
        "flagged_word_share": F.col("n_flagged") / words,
        "exclamations_per_word": F.col("n_exclamations") / words,
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k < n p, where it is below 1 by enough to matter; else 1."""
    first = n * F.log(F.lit(1 - p))
    begin = F.struct(first.alias("term"), F.exp(first).alias("sum"))
    odds = F.log(F.lit(p / (1 - p)))

    def step(a: Column, j: Column) -> Column:
        term = a["term"] + F.log((n - j + 1) / j) + odds
        return F.struct(term.alias("term"), (a["sum"] + F.exp(term)).alias("sum"))

    more = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), begin, step, lambda a: a["sum"])
    return F.when(k >= n * p, F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(F.least(more, F.lit(1.0)))


def reached(score: Column, grid: list[float]) -> Column:
    """How many of the ascending cutoffs a score reaches."""
    return F.size(F.filter(F.array(*map(F.lit, grid)), lambda c: score >= c))


def clean_labels(labels: DataFrame) -> DataFrame:
    one = labels.groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return one.where("of is not null and quality is not null").withColumn("half", F.pmod(F.xxhash64("of"), F.lit(2)))


def flagged_words(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FLAGGED) -> list[str]:
    """Words that at least five toxic and nearly only toxic documents hold, of at most ``sample`` labelled documents."""
    chosen = clean_labels(labels).where("half = 0").orderBy(F.xxhash64("of", F.lit(1)), "of").limit(sample)
    seen = docs.join(F.broadcast(chosen.select("of", "toxic")), F.col("doc_id").cast("long") == F.col("of"))
    words = seen.select("toxic", F.explode(F.array_distinct(F.transform(word_array(F.coalesce(F.col("text").cast("string"), F.lit(""))), _bare))).alias("word"))
    found = words.groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"), F.count("*").alias("n")).where("bad >= 5 and bad >= 0.8 * n and length(word) >= 3")
    return [r["word"] for r in found.orderBy(F.desc("bad"), "word").limit(most).collect()]


def cutoffs(counted: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with the cutoff of each rule (null: the rule rejects nothing there)."""
    good = clean_labels(labels).where("half = 1 and quality = 1 and toxic = 0")
    held = counted.where("n_words >= 50").join(good, counted["doc_id"] == good["of"])
    rows = F.array(*(F.struct(F.lit(r).alias("rule"), reached(s, GRID[r]).alias("reached")) for r, s in scores().items()))
    tally = held.select("lang", F.explode(rows).alias("x")).groupBy("lang", "x.rule", "x.reached").count()
    sizes = tally.groupBy("lang", "rule").agg(F.sum("count").alias("n"))
    grid = F.create_map(*(y for r, g in GRID.items() for y in (F.lit(r), F.array(*map(F.lit, g)))))
    tests = sizes.select("lang", "rule", "n", F.posexplode(F.element_at(grid, F.col("rule"))).alias("at", "cutoff"))
    over = tests.alias("t").join(tally.alias("y"), (F.col("t.lang") == F.col("y.lang")) & (F.col("t.rule") == F.col("y.rule")) & (F.col("y.reached") > F.col("t.at")), "left")
    k = over.groupBy("t.lang", "t.rule", "t.at", "t.cutoff", "t.n").agg(F.coalesce(F.sum("y.count"), F.lit(0)).alias("k"))
    k = k.withColumn("tests", F.count_if(F.col("at") == 0).over(Window.partitionBy(F.lit(1))))
    allowed = k.where(binomial_tail(F.col("k"), F.col("n"), alpha / len(GRID)) <= delta / F.col("tests"))
    return allowed.groupBy("lang").agg(*(F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in GRID))


def verdict() -> tuple[Column, Column, list[Column]]:
    """base_failed, kept, and whether each rule rejects, of counts joined with their stratum's cutoffs."""
    over = [F.coalesce(s >= F.col(f"cut_{r}"), F.lit(False)) for r, s in scores().items()]
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return base, reduce(lambda a, o: a & ~o, over, ~base), over


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts, base_failed and kept for every row of ``docs`` (doc_id, text, lang)."""
    work = Work(spark, "quality")
    counted = work.save(features(docs, flagged_words(docs, labels)), "counted")
    limits = work.save(cutoffs(counted, labels, alpha, delta), "cutoffs").withColumnRenamed("lang", "stratum")
    both = counted.join(limits, counted["lang"] == limits["stratum"], "left")
    base, kept, over = verdict()
    broken = F.array_compact(F.array(*(F.when(o, F.lit(r)) for r, o in zip(GRID, over, strict=True))))
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), kept.alias("kept"), F.array_join(broken, ",").alias("broken_rules"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def kept_rows(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns as they were.

    The holdout's ids are a table of known size, so they are broadcast while they are few and texts are not moved for them.
    """
    work = Work(spark, "quality")
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text", "lang")
    flagged = flagged_words(docs.select("doc_id", "text"), labels)
    known = work.save(clean_labels(labels).where("half = 1 and quality = 1 and toxic = 0").select(F.col("of").alias("doc_id")), "known")
    known = F.broadcast(known) if known.count() <= BROADCAST_IDS else known
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").join(known, "doc_id", "left_semi")
    limits = work.save(cutoffs(work.save(features(held, flagged), "counted"), labels), "cutoffs")
    work.drop("known", "counted")
    # a column that is not deterministic keeps the filter from being moved below the projections, where it would repeat them
    counted = features(marked, flagged, ["row"]).withColumn("once", F.monotonically_increasing_id())
    both = counted.join(limits.withColumnRenamed("lang", "stratum"), F.col("lang") == F.col("stratum"), "left")
    return both.where(verdict()[1] & (F.col("once") >= 0)).select("row.*")
