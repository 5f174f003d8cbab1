"""Column builders for the text variants of an article and the sentence that stands for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text as X


def filled(value: Column) -> Column:
    """Trimmed text; null is blank."""
    return F.trim(F.coalesce(value.cast("string"), F.lit("")))


def first_filled(*values: Column) -> Column:
    """The first value that is not blank, else blank."""
    return F.coalesce(*(F.nullif(filled(v), F.lit("")) for v in values), F.lit(""))


def event_text(title: Column, summary: Column) -> Column:
    """Title and summary, or one of them where they say the same."""
    t, s = filled(title), filled(summary)
    return F.when(F.lower(t) == F.lower(s), t).otherwise(F.trim(F.concat_ws(" ", t, s)))


def tickers(value: Column) -> Column:
    """Distinct upper-case items between ``;``, ``,``, ``|`` and blanks."""
    return F.array_distinct(F.filter(F.split(F.upper(filled(value)), r"[;,|\s]+"), lambda x: x != ""))


def parts(*values: Column) -> Column:
    """The values that are not blank; of those with one normal form the first."""
    return keyed_parts(*((filled(v), X.keyword_form(filled(v))) for v in values))


def keyed_parts(*values: tuple[Column, Column]) -> Column:
    """``parts`` of trimmed values with their normal forms, so that a form that is known already is not made again."""
    every = F.array(*(F.struct(v.alias("value"), k.alias("key")) for v, k in values))

    def first(every: Column) -> Column:
        return F.filter(every, lambda x, i: (x["key"] != "") & (F.array_position(every["key"], x["key"]) == i + 1))

    return F.transform(X.let(every, first), lambda x: x["value"])


def joined(values: Column) -> Column:
    """Parts as sentences; a part without an end mark gets a full stop."""
    return F.array_join(F.transform(values, lambda v: F.when(v.rlike(r"[.!?]\z"), v).otherwise(F.concat(v, F.lit(".")))), " ")


def with_variants(df: DataFrame) -> DataFrame:
    """``df`` with its ``variants``: texts are trimmed and brought to normal form once, and a variant serves the next."""
    own = ("title", "summary", "content", "body_text")
    rows = df.withColumns({f"{c}_own_": filled(F.col(c)) for c in own})
    rows = rows.withColumns({f"{c}_key_": X.keyword_form(F.col(f"{c}_own_")) for c in own})
    of = lambda *names: joined(keyed_parts(*((F.col(f"{c}_own_"), F.col(f"{c}_key_")) for c in names)))
    has_body = F.col("body_text_own_") != ""
    rows = rows.withColumns({"summary_text": of("title", "summary", "content")})
    rows = rows.withColumns(
        {
            "article_text": F.when(has_body, of("title", "summary", "body_text")).otherwise(F.col("summary_text")),
            "article_body": F.when(has_body, of("body_text", "summary")).otherwise(of("summary", "content")),
            "sentiment_text": F.when(F.col("content_own_") != "", F.col("content_own_")).otherwise(F.col("summary_own_")),
            "fulltext": F.col("body_text_own_"),
        }
    )
    return rows.withColumn("mapping_text", F.trim(F.concat_ws(" ", "article_text", _names()))).drop(*(f"{c}_{k}_" for c in own for k in ("own", "key")))


def _names() -> Column:
    return F.concat_ws(" ", *(F.nullif(F.replace(filled(F.col(c)), F.lit(";"), F.lit(" ")), F.lit("")) for c in ("companies", "tickers")))


def variants() -> dict[str, Column]:
    """Texts of an article (title, summary, content, body_text, companies, tickers), each for one purpose."""
    title, summary, content, body = (F.col(c) for c in ("title", "summary", "content", "body_text"))
    has_body = filled(body) != ""
    article = F.when(has_body, joined(parts(title, summary, body))).otherwise(joined(parts(title, summary, content)))
    return {
        "article_text": article,
        "summary_text": joined(parts(title, summary, content)),
        "mapping_text": F.trim(F.concat_ws(" ", article, _names())),
        "article_body": F.when(has_body, joined(parts(body, summary))).otherwise(joined(parts(summary, content))),
        "sentiment_text": first_filled(content, summary),
        "fulltext": filled(body),
    }


def without_title(sentence: Column, title: Column) -> Column:
    """A sentence without the title it begins with; blank where it is the title."""
    s, t = filled(sentence), filled(title)
    rest = F.regexp_replace(F.substr(s, F.length(t) + 1), r"\A[ .:-]+", "")
    begins = (t != "") & (F.lower(F.left(s, F.length(t))) == F.lower(t)) & (X.keyword_form(rest) != "")
    same = (X.keyword_form(t) != "") & (X.keyword_form(s) == X.keyword_form(t))
    return F.when(same, "").when(begins, rest).otherwise(s)


def first_sentence(body: Column, title: Column) -> Column:
    """First sentence of a body that is more than the title, else blank."""
    # later sentences are not looked at once one is found
    first = F.aggregate(X.sentences(body), F.lit(""), lambda found, s: F.when(found != "", found).otherwise(without_title(s, title)))
    return F.coalesce(first, F.lit(""))


def strongest_in_body(scored: Column, body: Column) -> Column:
    """Of scored sentences that the body holds, that of the greatest |score| x confidence; the first of equals."""
    inside = X.keyword_form(filled(body))
    key = lambda s: X.keyword_form(s["sentence"])
    own = F.filter(scored, lambda s: (key(s) != "") & F.contains(inside, key(s)))
    ranked = F.transform(own, lambda s, i: F.struct((F.abs(s["score"]) * F.greatest(s["confidence"], F.lit(0.01))).alias("v"), (-i).alias("o"), s["sentence"].alias("sentence")))
    return F.coalesce(F.array_max(ranked)["sentence"], F.lit(""))


def said(title: Column, *candidates: Column) -> Column:
    """The first candidate that says more than the title, else blank; those after it are not looked at."""
    return F.aggregate(F.array(*candidates), F.lit(""), lambda found, c: F.when(found != "", found).otherwise(filled(without_title(c, title))))


def chosen(title: Column, *candidates: Column) -> Column:
    """The first candidate that says more than the title, else the title."""
    return F.coalesce(F.nullif(said(title, *candidates), F.lit("")), filled(title))


def record_key(url: Column, title: Column) -> Column:
    """What makes two collected records one."""
    return F.struct(F.lower(filled(url)).alias("url"), F.lower(filled(title)).alias("title"))


def publisher(*values: Column) -> Column:
    """The publisher of a feed entry: its source, its own field, the feed's."""
    return first_filled(*values)


def any_listed(names: Column, allowed: list[str]) -> Column:
    """Whether one of the names of a ``;`` list is allowed."""
    return F.exists(X.split_values(names), lambda n: n.isin(allowed)) if allowed else F.lit(False)


def greatest_weight(names: Column, weights: dict[str, float]) -> Column:
    """Greatest weight of the names of a ``;`` list; unknown names weigh 1, as does no name."""
    if not weights:
        return F.lit(1.0)
    known = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))))
    return F.coalesce(F.array_max(F.transform(X.split_values(names), lambda n: F.coalesce(F.try_element_at(known, n), F.lit(1.0)))), F.lit(1.0))


def merged_values(*values: Column) -> Column:
    """Items of ``;`` lists, first spelling kept, case ignored."""
    every = F.flatten(F.array(*(F.filter(F.transform(F.split(filled(v), ";"), lambda x: F.trim(x)), lambda x: x != "") for v in values)))
    low = F.transform(every, lambda x: F.lower(x))
    return F.array_join(F.filter(every, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), ";")
