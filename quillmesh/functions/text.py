"""Column builders for text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Damaged sequences and what they stand for, in the order they are replaced.
MOJIBAKE = [("â€™", "'"), ("â€˜", "'"), ("â€œ", '"'), ("â€\x9d", '"'), ("â€“", "-"), ("â€”", "-"), ("â€¦", "..."), ("Â\u00a0", " ")]


def repair_mojibake(text: Column) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), [*MOJIBAKE, ("�", "")], text)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normal_title(title: Column) -> Column:
    """Lower case without links, other signs as blanks, blanks collapsed."""
    plain = F.regexp_replace(F.lower(title), r"https?://[^ \t\n\r]+|www\.[^ \t\n\r]+", " ")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def keyword_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


# Letters whose upper case is more than one letter, and the single letter that stands for it where there is one.
_WIDE = {c: "ẞ" if c == "ß" else c.title() for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1 and (c == "ß" or len(c.title()) == 1)}


def upper_letters(text: Column) -> Column:
    """Upper case letter by letter, so that no text gets longer: ß becomes ẞ, and ligatures stay."""
    single = lambda c: F.when(F.length(F.upper(c)) > 1, F.translate(c, "".join(_WIDE), "".join(_WIDE.values()))).otherwise(F.upper(c))
    return F.array_join(F.transform(F.split(text, ""), single), "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(collapse(text), r"(?<=[.!?。！？])\s+"), lambda s: s != "")


def content_tokens(text: Column, stop: list[str]) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+(?:'[a-z0-9]+)?"), F.lit(0))
    return F.array_except(F.array_distinct(F.filter(words, lambda t: F.length(t) > 1)), F.array(*map(F.lit, stop)))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once; inside a lambda nothing else shares repeated expressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def padded(sentence: Column) -> Column:
    return F.concat(F.lit(" "), keyword_form(sentence), F.lit(" "))


def any_term(padded_: Column, terms: list[str]) -> Column:
    """Whether a padded keyword form holds one of the terms as whole words."""
    return reduce(lambda a, b: a | b, [F.contains(padded_, F.lit(f" {t} ")) for t in terms])


def has_phrase(sentence: Column, terms: list[str], blockers: list[str] | None = None) -> Column:
    """Whether a sentence holds one of the terms as whole words, and no blocker."""
    return let(padded(sentence), lambda p: any_term(p, terms) & ~any_term(p, blockers) if blockers else any_term(p, terms))


def hit_score(parts: Column, terms: list[str], blockers: list[str] | None = None, scale: float = 3.0) -> Column:
    """min(scale * share of sentences with a term and no blocker, 1)."""
    return padded_score(F.transform(parts, padded), terms, blockers, scale)


def padded_score(parts: Column, terms: list[str], blockers: list[str] | None = None, scale: float = 3.0) -> Column:
    """``hit_score`` of padded keyword forms of sentences."""
    hit = F.size(F.filter(parts, lambda p: any_term(p, terms) & ~any_term(p, blockers) if blockers else any_term(p, terms)))
    return F.when(F.size(parts) > 0, F.least(hit / F.size(parts) * scale, F.lit(1.0))).otherwise(0.0)


def matched_terms(text: Column, terms: list[str]) -> Column:
    return let(padded(text), lambda p: F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(p, F.concat(F.lit(" "), t, F.lit(" ")))))


def count_terms(text: Column, terms: list[str]) -> Column:
    """Occurrences of terms as substrings, not overlapping."""
    return reduce(lambda a, b: a + b, [(F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / F.lit(len(t)) for t in terms]).cast("long")


def best_label(text: Column, rules: dict[str, list[str]], default: str) -> Column:
    """The label with most of its terms in the text; ties go to the earlier label, none to the default."""
    low = F.lower(text)
    hits = [reduce(lambda a, b: a + b, [F.contains(low, F.lit(t)).cast("int") for t in ts]) for ts in rules.values()]
    best = F.array_max(F.array(*(F.struct(h.alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("label")) for i, (k, h) in enumerate(zip(rules, hits, strict=True)))))
    return F.when(best["n"] > 0, best["label"]).otherwise(default)


def softmax(values: list[Column]) -> list[Column]:
    top = F.greatest(*values)
    parts = [F.exp(v - top) for v in values]
    total = reduce(lambda a, b: a + b, parts)
    return [p / total for p in parts]


def hyperlink(url: Column) -> Column:
    """A spreadsheet link for web addresses; links and other values stay."""
    web = F.lower(url).startswith("http://") | F.lower(url).startswith("https://")
    return F.when(web, F.concat(F.lit('=HYPERLINK("'), F.replace(url, F.lit('"'), F.lit('""')), F.lit('","Open")'))).otherwise(url)


def record_id(url: Column, title: Column) -> Column:
    return F.concat(F.lit("rss-"), F.substring(F.sha1(F.concat_ws("|", url, title).cast("binary")), 1, 16))


def split_values(value: Column, pattern: str = r"[;|]") -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), pattern), lambda x: F.trim(x)), lambda x: x != ""))
