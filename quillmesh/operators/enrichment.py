"""From collected records to scored articles: mapping, tags, sentiment, formulas, weights and evidence.

Everything is an expression on one row, so a batch is one pass over the records without a shuffle; vocabularies are data.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh import config
from quillmesh.functions import dictionary as L
from quillmesh.functions import evidence as V
from quillmesh.functions import scoring as S
from quillmesh.functions import text as X
from quillmesh.functions import times as D
from quillmesh.operators import tagging as T

COMPONENTS = ("b_bull", "b_bear", "g_growth", "s_shock", "k_unc", "entropy_norm")
# Weights by how an article was mapped, and the names of what could not be told.
BY_COMPANY, BY_TOPIC, UNMAPPED_WEIGHT = 1.0, 0.7, 0.5
UNMAPPED, GENERAL = "Unmapped", "general market sentiment"


@dataclass(frozen=True)
class Topic:
    name: str
    terms: list[str]
    sector: str = ""


@dataclass(frozen=True)
class Dictionaries:
    """Vocabularies of a run.  ``signals`` has terms of bull, bear, growth, shock and uncertainty, and blockers."""

    companies: list[T.Entity] = field(default_factory=list)
    sectors: dict[str, list[str]] = field(default_factory=dict)
    topics: list[Topic] = field(default_factory=list)
    risks: list[T.RiskRule] = field(default_factory=list)
    signals: dict[str, list[str]] = field(default_factory=dict)
    lexicon: dict[str, list[str]] = field(default_factory=lambda: {"positive": [], "negative": [], "uncertainty": []})
    sources: dict[str, float] = field(default_factory=dict)
    fulltext_sources: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Dictionaries:
        """From one JSON file with the fields as keys."""
        told = json.loads(Path(path).read_text(encoding="utf-8"))
        made = {"companies": T.Entity, "topics": Topic, "risks": T.RiskRule}
        unknown = sorted(set(told) - set(cls.__dataclass_fields__))
        if unknown:
            raise ValueError(f"unknown dictionaries: {', '.join(unknown)}")
        return cls(**{k: [made[k](**x) for x in v] if k in made else v for k, v in told.items()})


def most_common(values: Column) -> Column:
    """The value that occurs most often; of equals the one that comes first in the array."""
    counted = F.transform(F.array_distinct(values), lambda v, i: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-i).alias("o"), v.alias("v")))
    return F.coalesce(F.array_max(counted)["v"], F.lit(""))


def keyword_sector(text: Column, sectors: dict[str, list[str]]) -> Column:
    """The sector with most of its keywords as substrings of the text; ties go to the earlier one, none is blank."""
    return L.best_label(X.collapse(V.filled(text)), {k: [t.lower() for t in v] for k, v in sectors.items() if v}, "") if any(sectors.values()) else F.lit("")


def with_mapping(df: DataFrame, text: str, d: Dictionaries, out: str = "map_") -> DataFrame:
    """``out``: (companies, tickers, sector, method, relevance), by companies named, else by keywords, else unmapped."""
    none = F.expr("cast(array() as array<struct<name:string,ticker:string,group:string>>)")
    rows = df.withColumns({"found_": T.entities(F.col(text), d.companies) if d.companies else none, "word_": keyword_sector(F.col(text), d.sectors)})
    found, by_word = F.col("found_"), F.col("word_")
    names = lambda f: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda e: e[f]))), ";")
    named = F.size(found) > 0
    told = F.struct(
        names("name").alias("companies"),
        names("ticker").alias("tickers"),
        F.when(named, most_common(F.transform(found, lambda e: e["group"]))).when(by_word != "", by_word).otherwise(UNMAPPED).alias("sector"),
        F.when(named, "company_or_ticker").when(by_word != "", "topic_only").otherwise("unmapped").alias("method"),
        F.when(named, BY_COMPANY).when(by_word != "", BY_TOPIC).otherwise(UNMAPPED_WEIGHT).alias("relevance"),
    )
    return rows.withColumn(out, told).drop("found_", "word_")


def topic_of(text: Column, topics: list[Topic]) -> Column:
    """(topic, sector hint) by most terms as substrings; the first of equals, else the general topic."""
    if not topics:
        return F.struct(F.lit(GENERAL).alias("topic"), F.lit("").alias("hint"))
    best = L.best_label(text, {t.name: [w.lower() for w in t.terms] for t in topics}, GENERAL)
    hints = F.create_map(*(x for t in topics for x in (F.lit(t.name), F.lit(t.sector))))
    return F.struct(best.alias("topic"), F.coalesce(F.try_element_at(hints, best), F.lit("")).alias("hint"))


_NO_RISKS = "cast(array() as array<struct<category:string,severity:double,strength:double,evidence:string>>)"


def with_tags(df: DataFrame, text: str, d: Dictionaries, out: str = "tags_", hits: str = "") -> DataFrame:
    """``out``: (topic, hint, risks) of a text, and ``hits``, if named, its signals.  Steps are columns of their own, so that
    none is worked out twice."""
    rows = df.withColumns({"sentences_": X.sentences(F.col(text)), "topic_": topic_of(F.col(text), d.topics)}).withColumn("padded_", F.transform("sentences_", X.padded))
    risks = T.risk_tags(F.col("sentences_"), d.risks, F.col("padded_")) if d.risks else F.expr(_NO_RISKS)
    told = F.struct(F.col("topic_")["topic"].alias("topic"), F.col("topic_")["hint"].alias("hint"), risks.alias("risks"))
    found = {hits: F.struct(*(v.alias(k) for k, v in padded_signals(F.col("padded_"), d).items()))} if hits else {}
    return rows.withColumns({out: told} | found).drop("sentences_", "topic_", "padded_")


def merged_tags(summary: Column, full: Column, has_full: Column) -> Column:
    """Tags of summary and full text: all risks with their greatest strengths; the full text's topic only where the
    summary has none of its own; its evidence only where it adds a risk."""
    other = F.when(has_full, full["risks"]).otherwise(F.expr(_NO_RISKS))
    own = summary["risks"]
    held = lambda risks, c: F.exists(risks, lambda x: x["category"] == c)
    stronger = F.transform(
        own,
        lambda r: F.struct(
            r["category"].alias("category"),
            r["severity"].alias("severity"),
            F.greatest(r["strength"], F.coalesce(F.get(F.transform(F.filter(other, lambda x: x["category"] == r["category"]), lambda x: x["strength"]), F.lit(0)), F.lit(0.0))).alias("strength"),
            r["evidence"].alias("evidence"),
        ),
    )
    added = F.filter(other, lambda x: ~held(own, x["category"]))
    takes = has_full & (full["topic"] != GENERAL) & (summary["topic"] == GENERAL)
    first = lambda risks: F.coalesce(F.get(F.transform(risks, lambda x: x["evidence"]), F.lit(0)), F.lit(""))
    return F.struct(
        F.when(takes, full["topic"]).otherwise(summary["topic"]).alias("topic"),
        F.when(takes, V.first_filled(summary["hint"], full["hint"])).otherwise(summary["hint"]).alias("hint"),
        F.concat(stronger, added).alias("risks"),
        F.when(F.size(added) > 0, first(other)).otherwise(first(own)).alias("evidence"),
    )


def signals(sentences: Column, d: Dictionaries) -> dict[str, Column]:
    """The five signal components of an array of sentences; blockers take from bull and growth."""
    return padded_signals(F.transform(sentences, X.padded), d)


def padded_signals(padded: Column, d: Dictionaries) -> dict[str, Column]:
    """``signals`` of the padded keyword forms of sentences."""
    blockers = d.signals.get("blockers", [])
    score = lambda name, blocked: X.padded_score(padded, d.signals[name], blockers if blocked and blockers else None, config.HIT_SCALE) if d.signals.get(name) else F.lit(0.0)
    return {"b_bull": score("bull", True), "b_bear": score("bear", False), "g_growth": score("growth", True), "s_shock": score("shock", False), "k_unc": score("uncertainty", False)}


def matched_signals(text: Column, d: Dictionaries) -> Column:
    """Terms behind each component, for explanations: a map of component to terms in the order of the dictionary."""
    named = {"b_bull": "bull", "b_bear": "bear", "g_growth": "growth", "s_shock": "shock", "k_unc": "uncertainty"}
    return F.create_map(*(x for c, s in named.items() for x in (F.lit(c), X.matched_terms(text, d.signals[s]) if d.signals.get(s) else F.expr("cast(array() as array<string>)"))))


def with_sentiment(df: DataFrame, title: str, text: str, d: Dictionaries, out: str = "feeling") -> DataFrame:
    """``out``: lexicon sentiment of title and text (positive, neutral, negative, score, evidence, confidence, sentences);
    without a sentence the title is scored."""
    rows = df.withColumn("told_", X.sentences(V.joined(V.parts(F.col(title), F.col(text)))))
    rows = rows.withColumn("told_", F.when(F.size("told_") > 0, F.col("told_")).otherwise(F.array(V.filled(F.col(title)))))
    rows = rows.withColumn("scored_", T.lexicon_sentences(F.col("told_"), d.lexicon))
    rows = rows.withColumn("whole_", T.article_sentiment(F.col("scored_"), F.col(title)))
    whole = F.col("whole_")
    told = F.struct(*(whole[k].alias(k) for k in ("positive", "neutral", "negative", "score", "evidence")), F.greatest(whole["positive"], whole["neutral"], whole["negative"]).alias("confidence"), F.col("scored_").alias("sentences"))
    return rows.withColumn(out, told).drop("told_", "scored_", "whole_")


def entropy_norm(*p: Column) -> Column:
    terms = [F.when(x > 0, -x * F.log(x)).otherwise(0.0) for x in p]
    return reduce(lambda a, b: a + b, terms) / F.log(F.lit(3.0))


def resolve_weights(version: str) -> dict:
    """The weights of a formula version."""
    found = {"baseline": config.BASELINE, "enhanced": config.ENHANCED}.get(version)
    if found is None:
        raise ValueError(f"unknown formula version: {version}")
    return found


def version_of(weights: dict) -> str:
    return "baseline" if weights == config.BASELINE else "enhanced" if weights == config.ENHANCED else "custom"


def problems(df: DataFrame) -> Column:
    """What keeps a row from being scored, else null: a dedup factor that is no number, or times that are none."""
    factor = V.filled(F.col("dedup_factor"))
    checks = [F.when((factor != "") & factor.try_cast("double").isNull(), F.concat(F.lit("ValueError: no number: dedup_factor '"), factor, F.lit("'")))]
    checks += [F.when(D.parsed(F.col(c)).isNull(), F.concat(F.lit(f"ValueError: no time: {c} '"), V.filled(F.col(c)), F.lit("'"))) for c in ("published_at", "collected_at")]
    return F.substring(F.coalesce(*checks), 1, 500)


INPUT = ("article_id", "title", "summary", "content", "body_text", "url", "source", "publisher", "source_weight", "sector", "companies", "tickers", "content_level", "rescored", "dedup_factor", "published_at", "collected_at")


def with_input(df: DataFrame) -> DataFrame:
    """The columns that enrichment reads; missing ones are blank."""
    return df.withColumns({c: F.lit("") for c in INPUT if c not in df.columns})


def score_columns(d: Dictionaries, weights: dict) -> dict[str, Column]:
    """Score row of (feeling, signals_, merged, published_at, collected_at, relevance, factor, own_weight)."""
    p = F.col("feeling")
    return {
        "p_positive": p["positive"], "p_neutral": p["neutral"], "p_negative": p["negative"], "sentiment_score": p["score"], "model_confidence": p["confidence"],
        **{c: F.col("signals_")[c] for c in COMPONENTS[:5]},
        "entropy_norm": entropy_norm(p["positive"], p["neutral"], p["negative"]),
        "risk_intensity": T.risk_intensity(F.col("merged")["risks"]),
        "relevance_weight": F.col("relevance"),
        "time_weight": S.time_weight(D.parsed(F.col("published_at")), D.parsed(F.col("collected_at"))),
        "source_weight": F.col("own_weight"),
    }


def positive_number(value: Column, default: Column) -> Column:
    n = V.filled(value).try_cast("double")
    return F.when(n > 0, n).otherwise(default)


def enrich(df: DataFrame, d: Dictionaries, weights: dict = config.ENHANCED) -> DataFrame:
    """Scored articles of records; a row that cannot be scored is kept with neutral values and ``processing_error``."""
    rows = V.with_variants(with_input(df)).withColumn("processing_error", problems(df))
    has_full = F.col("fulltext") != ""
    rows = with_mapping(rows, "mapping_text", d)
    rows = with_tags(with_tags(rows, "summary_text", d, "own_tags", "signals_"), "fulltext", d, "full_tags")
    rows = with_sentiment(with_sentiment(rows, "title", "sentiment_text", d), "title", "fulltext", d, "full_feeling")
    rows = rows.withColumn("full_feeling", F.when(has_full, F.col("full_feeling"))).withColumn("merged", merged_tags(F.col("own_tags"), F.col("full_tags"), has_full))
    own, hint = V.filled(F.col("sector")), F.col("merged")["hint"]
    unmapped = F.col("map_")["sector"] == UNMAPPED
    rows = rows.withColumns(
        {
            "relevance": F.when(unmapped & (own != ""), BY_COMPANY).otherwise(F.col("map_")["relevance"]),
            "sector": F.when(unmapped & (own != ""), own).when(unmapped & (hint != ""), hint).otherwise(F.col("map_")["sector"]),
            "own_weight": positive_number(F.col("source_weight"), V.greatest_weight(F.col("source"), d.sources)),
            "factor": F.coalesce(F.nullif(V.filled(F.col("dedup_factor")), F.lit("")).try_cast("double"), F.lit(1.0)),
        }
    )
    rows = rows.withColumns(score_columns(d, weights))
    rows = rows.withColumns(S.article_formulas(weights)).withColumn("agg_weight", F.col("time_weight") * F.col("relevance") * F.col("factor") * F.col("own_weight"))
    title = F.col("title")
    body_evidence = F.when(has_full, V.strongest_in_body(F.col("full_feeling")["sentences"], F.col("fulltext")))
    first_full = F.get(F.transform(F.col("full_tags")["risks"], lambda r: r["evidence"]), F.lit(0))
    rows = rows.withColumn("said_", V.said(title, F.when(has_full, first_full), body_evidence, F.col("merged")["evidence"], F.col("feeling")["evidence"]))
    rows = rows.withColumns(
        {
            "companies": V.merged_values(F.col("map_")["companies"], F.col("companies")),
            "tickers": V.merged_values(F.col("map_")["tickers"], F.col("tickers")),
            "publisher": V.first_filled(F.col("publisher"), F.col("source")),
            "content_level": V.first_filled(F.col("content_level"), F.when(has_full, "fulltext").otherwise("summary")),
            "rescored": V.first_filled(F.col("rescored"), F.lit("False")),
            "topic": F.col("merged")["topic"],
            "risk_category": F.array_join(F.transform(F.col("merged")["risks"], lambda r: r["category"]), ";"),
            "evidence_sentence": F.when(F.col("said_") != "", F.col("said_")).otherwise(V.chosen(title, V.first_sentence(F.col("article_body"), title))),
            **{f"{n}_fulltext": F.col("full_feeling")[k] for n, k in (("sentiment_score", "score"), ("p_positive", "positive"), ("p_neutral", "neutral"), ("p_negative", "negative"))},
        }
    )
    used = [*V.variants(), "map_", "own_tags", "full_tags", "feeling", "full_feeling", "signals_", "merged", "relevance", "own_weight", "factor", "said_"]
    return degraded(rows.drop(*used))


def degraded(rows: DataFrame) -> DataFrame:
    """Rows with a ``processing_error`` get neutral scores and no weight."""
    zero = ["sentiment_score", "p_positive", "p_negative", *COMPONENTS, "optimism", "fear", "risk_intensity", "model_confidence", "relevance_weight", "time_weight", "agg_weight"]
    values = {c: F.lit(0.0) for c in zero} | {"p_neutral": F.lit(1.0), "uncertainty": F.lit(40.0), "sector": V.first_filled(F.col("sector"), F.lit(UNMAPPED)), "topic": F.lit("processing error"), "risk_category": F.lit("processing error"), "evidence_sentence": V.first_filled(F.col("summary"), F.col("title"))}
    bad = F.col("processing_error").isNotNull()
    return rows.withColumns({c: F.when(bad, v).otherwise(F.col(c)) for c, v in values.items() if c in rows.columns})


def backfill_components(df: DataFrame, d: Dictionaries, weights: dict = config.ENHANCED) -> DataFrame:
    """Components and formulas of articles that lack a component, from their stored probabilities and text."""
    lacks = reduce(lambda a, b: a | b, (V.filled(F.col(c)) == "" for c in COMPONENTS))
    rows = with_input(df).withColumn("lacks_", lacks).withColumn("text_", V.variants()["article_text"]).withColumn("sentences_", X.sentences(F.col("text_")))
    p = [S.number(c) for c in ("p_positive", "p_neutral", "p_negative")]
    made = signals(F.col("sentences_"), d) | {"entropy_norm": entropy_norm(*p)}
    rows = rows.withColumns({c: F.when(F.col("lacks_"), made[c]).otherwise(S.number(c)) for c in COMPONENTS})
    old = {k: S.number(k) for k in S.article_formulas(weights) if k in df.columns}
    rows = rows.withColumns({k: F.when(F.col("lacks_"), v).otherwise(old[k]) if k in old else v for k, v in S.article_formulas(weights).items()})
    return rows.select(*df.columns, *(k for k in S.article_formulas(weights) if k not in df.columns))


def backfill_sources(df: DataFrame, d: Dictionaries) -> DataFrame:
    """Publisher, source weight and their product with time, relevance and duplicate weights, where they are missing."""
    rows = with_input(df).withColumn("source_weight", positive_number(F.col("source_weight"), V.greatest_weight(F.col("source"), d.sources)))
    factor = F.coalesce(F.nullif(V.filled(F.col("dedup_factor")), F.lit("")).try_cast("double"), F.lit(1.0))
    made = {
        "publisher": V.first_filled(F.col("publisher"), F.col("source")),
        "agg_weight": S.number("time_weight") * S.number("relevance_weight") * factor * F.col("source_weight"),
        "content_level": V.first_filled(F.col("content_level"), F.when(V.filled(F.col("body_text")) != "", "fulltext").otherwise("summary")),
        "rescored": V.first_filled(F.col("rescored"), F.lit("False")),
    }
    return rows.withColumns(made).select(*dict.fromkeys([*df.columns, "publisher", "source_weight", "agg_weight", "content_level", "rescored"]))


def mark_factor(df: DataFrame, reprints: DataFrame | None = None) -> DataFrame:
    """Weight of repeated articles: duplicates by url or normal title, then reprints (article_id), then the others."""
    from quillmesh.operators.relations import mark_duplicates

    marked = mark_duplicates(df.withColumn("title_", X.normal_title(V.filled(F.col("title")))).withColumn("url_", V.filled(F.col("url"))), "url_", "title_", "article_id")
    if reprints is not None:
        marked = marked.join(reprints.select("article_id").distinct().withColumn("reprint_", F.lit(True)), "article_id", "left")
    like = F.coalesce(F.col("reprint_"), F.lit(False)) if reprints is not None else F.lit(False)
    kind = F.when(F.col("duplicate"), "duplicate").when(like, "similar_reprint").otherwise("unique")
    factor = F.when(F.col("duplicate"), config.DUPLICATE).when(like, config.REPRINT).otherwise(config.UNIQUE)
    return marked.withColumns({"dedup_status": kind, "dedup_factor": factor.cast("string")}).drop("title_", "url_", "duplicate", "reprint_")


def batch(raw: DataFrame, d: Dictionaries, now: Column, weights: dict = config.ENHANCED) -> DataFrame:
    """The full batch up to clustering: times, repeats, scores."""
    return enrich(mark_factor(D.with_normal_times(with_input(raw), now)), d, weights)


def incremental(existing: DataFrame, raw: DataFrame, d: Dictionaries, now: Column, weights: dict = config.ENHANCED) -> DataFrame:
    """Existing articles, with the sources that raw records now have, and scores of the raw records whose ids are new."""
    return sync_sources(existing, raw).unionByName(scored_new(existing, raw, d, now, weights), allowMissingColumns=True)


def scored_new(existing: DataFrame, raw: DataFrame, d: Dictionaries, now: Column, weights: dict = config.ENHANCED) -> DataFrame:
    """Scores of the raw records whose ids ``existing`` lacks; repeats are told among all raw records."""
    known = existing.select("article_id").where(V.filled(F.col("article_id")) != "").distinct()
    return enrich(mark_factor(D.with_normal_times(with_input(raw), now)).join(known, "article_id", "left_anti"), d, weights)


def sync_sources(articles: DataFrame, raw: DataFrame) -> DataFrame:
    """Source, publisher and source weight of the raw record with an article's id, where they are not blank."""
    columns = [c for c in ("source", "publisher", "source_weight") if c in articles.columns and c in raw.columns]
    # of repeated ids the greatest row serves, whatever the partitions
    told = raw.groupBy("article_id").agg(F.max(F.struct(*(F.col(c).alias(f"raw_{c}") for c in columns))).alias("t_")).select("article_id", "t_.*")
    rows = articles.join(told, "article_id", "left")
    return rows.withColumns({c: F.when(V.filled(F.col(f"raw_{c}")) != "", F.col(f"raw_{c}").cast(dict(articles.dtypes)[c])).otherwise(F.col(c)) for c in columns}).select(*articles.columns)


def restore_bodies(articles: DataFrame, cache: DataFrame) -> DataFrame:
    """Articles without a body get that of a cache (article_id, status, body_text) of good pages."""
    good = cache.where((F.col("status") == "ok") & (V.filled(F.col("body_text")) != "")).groupBy("article_id").agg(F.max("body_text").alias("cached_"))
    rows = articles.join(good, "article_id", "left")
    return rows.withColumn("body_text", V.first_filled(F.col("body_text"), F.col("cached_"))).drop("cached_").select(*articles.columns)


def replace_rows(rows: DataFrame, other: DataFrame) -> DataFrame:
    """``rows`` with those whose article_id ``other`` has replaced by its rows."""
    return rows.join(other.select("article_id").distinct(), "article_id", "left_anti").unionByName(other, allowMissingColumns=True)


def fulltext_candidates(articles: DataFrame, drivers: DataFrame, cache: DataFrame, day: Column, d: Dictionaries, most: int = 30) -> DataFrame:
    """Articles of a day worth reading whole, best first: drivers, representatives of events with several reports, strong
    sentiment or risk; only web pages of allowed sources that are not cached, one for each title."""
    event = V.first_filled(F.col("event_id"), F.col("article_id"))
    w = Window.partitionBy("event_").orderBy(F.desc(S.number("agg_weight")), "article_id")
    rows = articles.withColumn("event_", event).withColumns({"reports_": F.count("*").over(Window.partitionBy("event_")), "place_": F.row_number().over(w)})
    rows = rows.where(F.to_date(F.to_utc_timestamp(D.parsed(F.col("published_at")), F.current_timezone())) == day).join(drivers.select("article_id").distinct().withColumn("driver_", F.lit(1)), "article_id", "left")
    driver, several = F.coalesce("driver_", F.lit(0)), ((F.col("reports_") > 1) & (F.col("place_") == 1)).cast("int")
    risky, strong = (S.number("risk_intensity") >= 60).cast("int"), (F.abs(S.number("sentiment_score")) >= 0.5).cast("int")
    rows = rows.withColumn("priority", 8 * driver + 4 * several + 2 * risky + strong).withColumn("title_", X.keyword_form(V.filled(F.col("title")))).where("priority > 0")
    rows = rows.where(F.lower(V.filled(F.col("url"))).rlike(r"\Ahttps?://") & V.any_listed(F.col("source"), d.fulltext_sources) & (V.filled(F.col("content_level")) != "fulltext"))
    rows = rows.join(cache.select("article_id").distinct(), "article_id", "left_anti")
    rows = rows.join(cache.where(V.filled(F.col("url")) != "").select(F.col("url").alias("u_")).distinct(), F.col("url") == F.col("u_"), "left_anti")
    rows = rows.join(cache.where(V.filled(F.col("title")) != "").select(X.keyword_form(V.filled(F.col("title"))).alias("t_")).distinct(), F.col("title_") == F.col("t_"), "left_anti")
    best = [F.desc("priority"), F.desc(S.number("risk_intensity")), F.desc(F.abs(S.number("sentiment_score"))), F.desc(S.number("agg_weight")), F.asc("article_id")]
    rows = rows.withColumn("same_", F.row_number().over(Window.partitionBy("title_").orderBy(*best))).where("same_ = 1")
    return rows.orderBy(*best).limit(most).select(*articles.columns, "priority")


def rescore(articles: DataFrame, pages: DataFrame, d: Dictionaries, weights: dict = config.ENHANCED, least: int = 200) -> DataFrame:
    """Articles scored anew with the body of landed pages (article_id, body_text) of at least ``least`` characters."""
    landed = pages.where(F.length(V.filled(F.col("body_text"))) >= least).groupBy("article_id").agg(F.max("body_text").alias("landed_"))
    own = with_input(articles).join(landed, "article_id").withColumns({"body_text": F.col("landed_"), "content_level": F.lit("fulltext"), "rescored": F.lit("True")}).drop("landed_")
    return replace_rows(articles, enrich(own.select(*articles.columns, *(c for c in INPUT if c not in articles.columns)), d, weights))
