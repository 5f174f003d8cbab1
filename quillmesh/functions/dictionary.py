"""Many terms in many texts: one pass over a text finds all terms of a dictionary, however many there are.

``places`` sends texts in Arrow batches through an automaton of all terms, which each worker builds once from the terms in
its task; their size is checked.  ``joined`` has no such bound: it meets the word n-grams of texts with a table of terms in a
hash join and suits dictionaries of any size.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text as X

#: Characters of the terms that are sent to every task at most.
MOST_CHARACTERS = 32 << 20
#: Dictionaries of so many terms at most are plain expressions, which stay in the JVM.
FEW = 16
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_AUTOMATA: dict = {}


@dataclass(frozen=True)
class Terms:
    """Terms, each a substring as it is written; ``bounded``: not inside a longer run of ASCII letters and digits, and
    A-Z are told from a-z only in the terms numbered in ``cased``."""

    terms: tuple[str, ...]
    bounded: bool = False
    cased: frozenset[int] = frozenset()

    def __post_init__(self):
        if sum(map(len, self.terms)) > MOST_CHARACTERS:
            raise ValueError(f"terms of more than {MOST_CHARACTERS} characters: join them as a table")

    @cached_property
    def digest(self) -> str:
        return hashlib.sha256(repr((self.terms, self.bounded, sorted(self.cased))).encode()).hexdigest()


def _fold(text: str) -> str:
    """A-Z in lower case, and nothing else."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _automaton(terms: Terms):
    if terms.digest not in _AUTOMATA:
        import ahocorasick

        if len(_AUTOMATA) > 8:
            _AUTOMATA.clear()
        numbers: dict[str, list[int]] = {}
        for k, t in enumerate(terms.terms):
            if t:
                numbers.setdefault(_fold(t) if terms.bounded else t, []).append(k)
        made = ahocorasick.Automaton()
        for t, ks in numbers.items():
            made.add_word(t, (len(t), tuple(ks)))
        if numbers:
            made.make_automaton()
        _AUTOMATA[terms.digest] = made if numbers else None
    return _AUTOMATA[terms.digest]


def found_in(text: str | None, terms: Terms) -> dict[int, int]:
    """How often each term occurs in a text, not overlapping itself, for the terms that do."""
    made = _automaton(terms)
    counts: dict[int, int] = {}
    if not text or made is None:
        return counts
    ends: dict[int, int] = {}
    for last, (n, ks) in made.iter(_fold(text) if terms.bounded else text):
        start, end = last + 1 - n, last + 1
        if terms.bounded and (start and text[start - 1] in _ALNUM or end < len(text) and text[end] in _ALNUM):
            continue
        for k in ks:
            if start >= ends.get(k, 0) and (k not in terms.cased or text[start:end] == terms.terms[k]):
                ends[k] = end
                counts[k] = counts.get(k, 0) + 1
    return counts


_PLACES = "array<array<struct<term:int,n:int>>>"


def places(texts: Column, terms: Terms) -> Column:
    """For each text of an array the terms that it holds, by number and ascending, with how often each occurs."""

    def run(batch: pa.Array) -> pa.Array:
        told = [None if row is None else [[{"term": k, "n": n} for k, n in sorted(found_in(t, terms).items())] for t in row] for row in batch.to_pylist()]
        return pa.array(told, pa.list_(pa.list_(pa.struct([("term", pa.int32()), ("n", pa.int32())]))))

    run.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _PLACES)(texts)


def grouped(found: Column, groups: list[int], value) -> Column:
    """(group, n) of found places, ascending: ``value(place)`` summed over the terms of each group."""
    of = F.split(F.lit(",".join(map(str, groups))), ",").cast("array<int>")
    own = lambda x: F.get(of, x["term"])

    def told(found: Column) -> Column:
        return F.transform(F.array_sort(F.array_distinct(F.transform(found, own))), lambda g: F.struct(g.alias("group"), F.aggregate(F.filter(found, lambda x: own(x) == g), F.lit(0).cast("long"), lambda s, x: s + value(x)).alias("n")))

    return X.let(found, told)


def best_label(text: Column, rules: dict[str, list[str]], default: str) -> Column:
    """The label with most of its terms in the text as substrings; ties go to the earlier label, none to the default."""
    if sum(map(len, rules.values())) <= FEW:
        return X.best_label(text, rules, default)
    flat = [(i, t) for i, ts in enumerate(rules.values()) for t in ts]
    found = F.get(places(F.array(F.lower(text)), Terms(tuple(t for _, t in flat))), F.lit(0))
    best = F.array_max(F.transform(grouped(found, [i for i, _ in flat], lambda x: F.lit(1)), lambda g: F.struct(g["n"].alias("n"), (-g["group"]).alias("o"))))
    return F.coalesce(F.get(F.array(*map(F.lit, rules)), -best["o"]), F.lit(default))


def counts(texts: Column, groups: dict[str, list[str]]) -> Column:
    """For each text of an array the occurrences of each group's terms as substrings, as a struct."""
    if sum(map(len, groups.values())) <= FEW:
        return F.transform(texts, lambda t: F.struct(*((X.count_terms(t, v) if v else F.lit(0).cast("long")).alias(k) for k, v in groups.items())))
    flat = [(i, t) for i, ts in enumerate(groups.values()) for t in ts]
    found = places(texts, Terms(tuple(t for _, t in flat)))

    def told(p: Column) -> Column:
        of = F.split(F.lit(",".join(str(i) for i, _ in flat)), ",").cast("array<int>")
        total = lambda i: F.aggregate(F.filter(p, lambda x: F.get(of, x["term"]) == i), F.lit(0).cast("long"), lambda s, x: s + x["n"])
        return F.struct(*(total(i).alias(k) for i, k in enumerate(groups)))

    return F.transform(found, told)


def phrases(padded: Column, terms: list[str]) -> Column:
    """For each padded keyword form of an array the numbers of the terms that it holds as whole words, ascending."""
    if len(terms) <= FEW:
        return F.transform(padded, lambda p: F.filter(F.array(*(F.when(F.contains(p, F.lit(f" {t} ")), k) for k, t in enumerate(terms))), lambda k: k.isNotNull()))
    return F.transform(places(padded, Terms(tuple(f" {t} " for t in terms))), lambda found: F.transform(found, lambda x: x["term"]))


def joined(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """(key, term, n): occurrences as whole words of the rows of ``terms`` in texts, all in keyword form.

    Word n-grams, for the lengths that terms have, meet the terms by hash; texts give one row per place and no more.
    """
    known = terms.select(X.keyword_form(F.col(term)).alias("term")).where("term <> ''").distinct()
    lengths = sorted(r[0] for r in known.select(F.size(F.split("term", " "))).distinct().collect())
    words = texts.select(key, F.split(X.keyword_form(F.col(text)), " ").alias("words"))

    def grams_of(n: int) -> Column:
        if n == 1:
            return F.col("words")
        return F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " ")))

    grams = [grams_of(n) for n in lengths]
    every = words.select(key, F.explode(F.flatten(F.array_compact(F.array(*grams)))).alias("term")) if lengths else texts.select(key, F.lit("").alias("term")).limit(0)
    return every.join(known, "term").groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def listed(terms: DataFrame, *columns: str) -> list:
    """Rows of a table of terms, if their text is small enough to be sent to every task."""
    size = terms.agg(F.sum(sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(0)))).first()[0] or 0
    if size > MOST_CHARACTERS:
        raise ValueError(f"terms of more than {MOST_CHARACTERS} characters: join them as a table")
    return terms.select(*columns).collect()
