"""Column builders for texts that people read."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmesh.functions import text as X
from quillmesh.functions.evidence import filled


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda v: html.unescape(v) if isinstance(v, str) and "&" in v else v)


def strip_html(value: Column) -> Column:
    """Tags to blanks, then character references, damaged sequences and blanks."""
    return X.collapse(X.repair_mojibake(_unescape(F.regexp_replace(filled(value), r"<[^>]+>", " "))))


def clean_text(value: Column) -> Column:
    """Character references first, so that escaped tags go as well."""
    return X.collapse(F.regexp_replace(_unescape(filled(value)), r"<[^>]+>", " "))


def shorten(value: Column, most: int = 80) -> Column:
    v = filled(value)
    return F.when(F.length(v) <= most, v).otherwise(F.concat(F.rtrim(F.substr(v, F.lit(1), F.lit(most - 3))), F.lit("...")))


def markdown_link(title: Column, url: Column, most: int = 80) -> Column:
    """A link for web addresses, else the label alone."""
    label = F.regexp_replace(shorten(title, most), r"([\[\]])", r"\\$1")
    return F.when(F.lower(filled(url)).rlike(r"\Ahttps?://"), F.concat(F.lit("["), label, F.lit("]("), filled(url), F.lit(")"))).otherwise(label)


def badge(score: Column) -> Column:
    from quillmesh.functions.scoring import sentiment_label

    color = F.when(score > 0.05, "green").when(score < -0.05, "red").otherwise("gray")
    return F.concat(F.lit(":"), color, F.lit("["), sentiment_label(score), F.format_string(" %+.2f]", score))


def number_count(value: Column) -> Column:
    return F.regexp_count(filled(value), F.lit(r"\d+(?:[.,]\d+)*"))


def dense_paragraphs(value: Column, most: int = 4) -> Column:
    """Sentences of a paragraph folded into paragraphs of at most ``most`` numbers; one sentence is never cut."""
    empty = F.expr("cast(array() as array<struct<t:string,n:int>>)")

    def add(done: Column, sentence: Column) -> Column:
        n = number_count(sentence)
        last = F.element_at(done, -1)
        fits = (F.size(done) > 0) & (F.when(F.size(done) > 0, last["n"]).otherwise(0) + n <= most)
        longer = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.concat_ws(" ", F.when(F.size(done) > 0, last["t"]), sentence).alias("t"), (F.when(F.size(done) > 0, last["n"]).otherwise(0) + n).cast("int").alias("n"))))
        return F.when(fits, longer).otherwise(F.concat(done, F.array(F.struct(sentence.alias("t"), n.cast("int").alias("n")))))

    return F.array_join(F.transform(F.aggregate(X.sentences(value), empty, add), lambda x: x["t"]), "\n\n")


def metric(value: Column) -> Column:
    """One decimal; null and NaN are 0."""
    return F.round(F.nanvl(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(0.0)), 1)


def weights_json(weights: dict[str, float]) -> Column:
    """Compact JSON with sorted keys."""
    import json

    return F.lit(json.dumps(weights, sort_keys=True, separators=(",", ":")))


def shown(df: DataFrame, labels: dict[str, str], digits: int = 1) -> DataFrame:
    """The named columns under their labels, numbers rounded."""
    kinds = dict(df.dtypes)
    return df.select(*((F.round(F.col(c), digits) if kinds[c] in ("double", "float") else F.col(c)).alias(n) for c, n in labels.items() if c in kinds))


def first_column(df: DataFrame, candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)
