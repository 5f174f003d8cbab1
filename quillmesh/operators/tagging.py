"""Entities, risk tags and lexicon sentiment of texts; vocabularies are parameters.

Everything is worked out from one array of sentences per text, so no row leaves its partition; dictionaries of more than a
few terms are found in one pass, so that a text costs the same however many terms there are.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh import config
from quillmesh.functions import dictionary as L
from quillmesh.functions import scoring as S
from quillmesh.functions import text as X


@dataclass(frozen=True)
class RiskRule:
    category: str
    severity: int
    strong: list[str]
    weak: list[str] = field(default_factory=list)
    least: int = 1


@dataclass(frozen=True)
class Entity:
    name: str
    ticker: str
    group: str
    aliases: list[str]


def risk_rules(terms: DataFrame) -> list[RiskRule]:
    """Rules from a table (category, severity, least, term, strong) with a row per term."""
    made: dict[str, RiskRule] = {}
    for r in sorted(L.listed(terms, "category", "severity", "least", "term", "strong"), key=lambda r: (r.category, r.term)):
        rule = made.setdefault(r.category, RiskRule(r.category, r.severity, [], [], r.least or 1))
        (rule.strong if r.strong else rule.weak).append(r.term)
    return list(made.values())


def entity_list(names: DataFrame) -> list[Entity]:
    """Entities from a table (name, ticker, group, alias) with a row per alias."""
    made: dict[tuple, Entity] = {}
    for r in sorted(L.listed(names, "name", "ticker", "group", "alias"), key=lambda r: (r.name, r.ticker, r.alias or "")):
        entity = made.setdefault((r.name, r.ticker), Entity(r.name, r.ticker, r.group, []))
        if r.alias:
            entity.aliases.append(r.alias)
    return list(made.values())


def risk_tags(parts: Column, rules: list[RiskRule], padded: Column | None = None) -> Column:
    """Array of (category, severity, strength, evidence) of the rules that fire.

    A rule fires by a strong term, or by enough different weak ones; its strength is the scaled share of sentences with
    a term of the kind that fired it, its evidence the first of them.  One pass over each sentence finds the terms of all
    rules; only rules with a term in the text are looked at.  ``padded``: the sentences' padded keyword forms, where they are known.
    """
    flat = [(i, kind, t) for i, r in enumerate(rules) for kind, ts in ((1, r.strong), (0, r.weak)) for t in ts]
    numbers = lambda of: F.split(F.lit(",".join(map(str, of))), ",").cast("array<int>")
    if not flat:
        return F.expr("cast(array() as array<struct<category:string,severity:double,strength:double,evidence:string>>)")
    rule_of, strong_of = numbers([i for i, _, _ in flat]), numbers([k for _, k, _ in flat])
    held = L.phrases(F.transform(parts, X.padded) if padded is None else padded, [t for _, _, t in flat])
    told = F.arrays_zip(parts.alias("sentence"), F.transform(held, lambda ks: F.transform(ks, lambda k: F.struct(k.alias("k"), F.get(rule_of, k).alias("rule"), F.get(strong_of, k).alias("strong")))).alias("found"))
    least, severity, category = numbers([max(1, r.least) for r in rules]), F.split(F.lit(",".join(str(float(r.severity)) for r in rules)), ",").cast("array<double>"), F.array(*(F.lit(r.category) for r in rules))

    def fired(told: Column) -> Column:
        every = F.array_distinct(F.flatten(F.transform(told, lambda s: s["found"])))

        def tag(i: Column) -> Column:
            own = F.filter(every, lambda x: x["rule"] == i)
            kind = F.when(F.exists(own, lambda x: x["strong"] == 1), 1).when(F.size(own) >= F.get(least, i), 0)
            hits = F.filter(told, lambda s: F.exists(s["found"], lambda x: (x["rule"] == i) & (x["strong"] == kind)))
            return X.let(hits, lambda h: F.struct(F.get(category, i).alias("category"), F.get(severity, i).alias("severity"), F.least(F.size(h) / F.size(told) * config.HIT_SCALE, F.lit(1.0)).alias("strength"), F.get(h, F.lit(0))["sentence"].alias("evidence")))

        some = F.array_sort(F.array_distinct(F.transform(every, lambda x: x["rule"])))
        return F.filter(F.transform(some, tag), lambda x: x["strength"] > 0)

    return X.let(told, fired)


def risk_intensity(tags: Column) -> Column:
    return S.noisy_or(F.transform(tags, lambda t: F.struct(t["severity"].alias("severity"), t["strength"].alias("strength"))))


def has_term(text: Column, term: str, ignore_case: bool = True) -> Column:
    """A term not inside a longer run of ASCII letters and digits."""
    return text.rlike(f"{'(?i)' if ignore_case else ''}(?<![A-Za-z0-9]){re.escape(term)}(?![A-Za-z0-9])")


def entities(text: Column, known: list[Entity]) -> Column:
    """Array of (name, ticker, group) of the entities named; aliases ignore case, tickers do not."""
    flat = [(i, t, ticker) for i, e in enumerate(known) for t, ticker in [(e.ticker, True), *((a, False) for a in e.aliases)]]
    row = lambda e: F.struct(F.lit(e.name).alias("name"), F.lit(e.ticker).alias("ticker"), F.lit(e.group).alias("group"))
    if len(flat) <= L.FEW:
        found = []
        for e in known:
            hit = has_term(text, e.ticker, ignore_case=False)
            for a in e.aliases:
                hit = hit | has_term(text, a)
            found.append(F.when(hit, row(e)))
        return F.array_compact(F.array(*found))
    terms = L.Terms(tuple(t for _, t, _ in flat), True, frozenset(k for k, (_, _, ticker) in enumerate(flat) if ticker))
    of = F.split(F.lit(",".join(str(i) for i, _, _ in flat)), ",").cast("array<int>")
    # names and tickers as one constant each, not an expression per entity
    parts = [F.from_json(F.lit(json.dumps([getattr(e, f) for e in known])), "array<string>") for f in ("name", "ticker", "group")]
    numbers = F.array_sort(F.array_distinct(F.transform(F.get(L.places(F.array(text), terms), F.lit(0)), lambda x: F.get(of, x["term"]))))
    return F.transform(numbers, lambda i: F.struct(*(F.get(p, i).alias(f) for f, p in zip(("name", "ticker", "group"), parts, strict=True))))


def lexicon_sentences(sentences: Column, lexicon: dict[str, list[str]]) -> Column:
    """(sentence, positive, neutral, negative, score, confidence) of each sentence from counts of lexicon terms."""
    both = F.arrays_zip(sentences.alias("s"), L.counts(F.transform(sentences, lambda s: F.lower(s)), lexicon).alias("n"))
    return F.transform(both, lambda x: _scored(x["s"], x["n"]))


def lexicon_sentence(sentence: Column, lexicon: dict[str, list[str]]) -> Column:
    return F.get(lexicon_sentences(F.array(sentence), lexicon), F.lit(0))


def _scored(sentence: Column, n: Column) -> Column:
    names = ("positive", "neutral", "negative")

    def raw(n: Column) -> Column:
        return F.struct((0.4 + 1.2 * n["positive"]).alias("positive"), (0.8 + 0.5 * n["uncertainty"]).alias("neutral"), (0.4 + 1.2 * n["negative"]).alias("negative"))

    def powers(v: Column) -> Column:
        return F.struct(*(F.exp(v[k] - F.greatest(*(v[j] for j in names))).alias(k) for k in names))

    def shares(e: Column) -> Column:
        return F.struct(*((e[k] / (e["positive"] + e["neutral"] + e["negative"])).alias(k) for k in names))

    def whole(p: Column) -> Column:
        return F.struct(sentence.alias("sentence"), *(p[k].alias(k) for k in names), (p["positive"] - p["negative"]).alias("score"), F.greatest(*(p[k] for k in names)).alias("confidence"))

    return X.let(raw(n), lambda v: X.let(powers(v), lambda e: X.let(shares(e), whole)))


def article_sentiment(scored: Column, title: Column) -> Column:
    """Confidence-weighted mean of sentences' probabilities, with the strongest confident sentence as evidence."""
    weight = lambda s: F.greatest(s["confidence"], F.lit(0.1))

    def total(value) -> Column:
        return F.aggregate(scored, F.lit(0.0), lambda a, s: a + value(s))

    p, u, m = total(lambda s: s["positive"] * weight(s)), total(lambda s: s["neutral"] * weight(s)), total(lambda s: s["negative"] * weight(s))
    every = p + u + m
    sure = F.filter(scored, lambda s: s["confidence"] >= 0.6)
    ranked = F.array_max(F.transform(sure, lambda s, i: F.struct(F.abs(s["score"]).alias("strength"), (-i).alias("o"), s["sentence"].alias("sentence"))))
    return F.struct((p / every).alias("positive"), (u / every).alias("neutral"), (m / every).alias("negative"), ((p - m) / every).alias("score"), F.coalesce(ranked["sentence"], title).alias("evidence"))
