"""Dictionaries of any size against the expressions for few terms and against plain Python."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import dictionary as L
from quillmesh.functions import text as X
from quillmesh.operators import enrichment as N
from quillmesh.operators import tagging as T

TEXTS = [None, "", "aab AAB.a-b ab", "Éa ab ÉAB aba", "a ab aba. ba ab a! abab", "ΣΑΣ İab ſab K", "ab " * 2000 + "b", "x.ab/ba ab1 1ab AB"]


def terms_of(rng, n):
    return list(dict.fromkeys("".join(rng.choice("abAB .É") for _ in range(rng.randint(1, 4))).strip() or "a" for _ in range(n)))


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")


@pytest.mark.parametrize("bounded", [False, True])
def test_places_against_plain(spark, bounded):
    terms = terms_of(random.Random(1), 60)
    cased = frozenset(range(0, len(terms), 3)) if bounded else frozenset()
    want = {}
    for i, t in enumerate(TEXTS):
        want[i] = []
        for k, x in enumerate(terms):
            pattern = re.escape(x) if not bounded else rf"(?<![A-Za-z0-9]){re.escape(x)}(?![A-Za-z0-9])"
            n = len(re.findall(pattern, t or "", re.ASCII if k in cased or not bounded else re.ASCII | re.IGNORECASE))
            if bounded and k not in cased:
                fold = lambda s: "".join(c.lower() if c < "\x80" else c for c in s)
                n = len(re.findall(rf"(?<![a-z0-9]){re.escape(fold(x))}(?![a-z0-9])", fold(t or "")))
            if n:
                want[i].append((k, n))
    out = frame(spark).select("i", L.places(F.array("t"), L.Terms(tuple(terms), bounded, cased))[0].alias("p")).collect()
    assert {r.i: [(x.term, x.n) for x in r.p] for r in out} == want


@pytest.fixture(params=["few", "many"])
def size(request, monkeypatch):
    monkeypatch.setattr(L, "FEW", 10**6 if request.param == "few" else 0)
    return request.param


RESULTS: dict = {}


def test_both_ways_agree(spark, size):
    rng = random.Random(7)
    words = ["ab", "aba", "a b", "ba", "b", "x", "ab ab"]
    rules = [T.RiskRule(f"c{i}", i + 1, rng.sample(words, rng.randint(0, 2)), rng.sample(words, rng.randint(0, 4)), rng.randint(0, 3)) for i in range(8)]
    known = [T.Entity(f"n{i}", rng.choice(["AB", "ab", "a-b"]), f"g{i}", rng.sample(["aab", "É", "ba", "A.B"], 2)) for i in range(5)]
    labels = {f"l{i}": rng.sample(words, 3) for i in range(4)}
    lexicon = {"positive": ["ab", "aa"], "negative": ["ba", ""], "uncertainty": []}
    parts = X.sentences(F.col("t"))
    out = frame(spark).select("i", T.risk_tags(parts, rules).alias("r"), T.entities(F.col("t"), known).alias("e"), L.best_label(F.col("t"), labels, "none").alias("b"), T.lexicon_sentences(parts, {**lexicon, "negative": ["ba"]}).alias("s"), N.keyword_sector(F.col("t"), labels).alias("k"))
    RESULTS[size] = {r.i: (r.r, r.e or [], r.b, r.s, r.k) for r in out.collect()}
    if len(RESULTS) == 2:
        assert RESULTS["few"] == RESULTS["many"]
        assert sum(len(r[0] or []) for r in RESULTS["few"].values()) > 8


def test_joined_against_plain(spark):
    terms = [("ab",), ("a b",), ("ab aba",), ("AB",), ("",), ("a b ab",), ("nowhere",)]
    got = {(r.i, r.term): r.n for r in L.joined(frame(spark), "i", "t", spark.createDataFrame(terms, "term string"), "term").collect()}
    want = {}
    for i, t in enumerate(TEXTS):
        words = re.sub("[^a-z0-9]+", " ", (t or "").lower()).split()
        for x in {re.sub("[^a-z0-9]+", " ", a.lower()).strip() for (a,) in terms} - {""}:
            n = sum(words[k : k + len(x.split())] == x.split() for k in range(len(words)))
            if n:
                want[i, x] = n
    assert {k: n for k, n in got.items() if k[0] != 5} == {k: n for k, n in want.items() if k[0] != 5}
    assert L.joined(frame(spark), "i", "t", spark.createDataFrame([], "term string"), "term").count() == 0


def test_tables_of_terms(spark):
    rules = spark.createDataFrame([("b", 2, 2, "ab", False), ("b", 2, 2, "ba", False), ("a", 5, 1, "aba", True)], "category string, severity int, least int, term string, strong boolean")
    assert T.risk_rules(rules) == [T.RiskRule("a", 5, ["aba"], [], 1), T.RiskRule("b", 2, [], ["ab", "ba"], 2)]
    names = spark.createDataFrame([("n", "T", "g", "x"), ("n", "T", "g", "y"), ("m", "U", "h", None)], "name string, ticker string, group string, alias string")
    assert T.entity_list(names) == [T.Entity("m", "U", "h", []), T.Entity("n", "T", "g", ["x", "y"])]


def test_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_CHARACTERS", 5)
    with pytest.raises(ValueError):
        L.Terms(("abc", "def"))
    with pytest.raises(ValueError):
        L.listed(spark.createDataFrame([("abcdef",)], "term string"), "term")


def test_cost_is_flat_in_terms(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(3)
    made = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9))) for _ in range(10_000)]

    def seconds(n):
        known = [T.Entity(f"n{i}", t.upper(), "g", [t]) for i, t in enumerate(made[:n])]
        frame = docs.select(T.entities(F.col("text"), known).alias("e"))
        frame.write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        docs.select(T.entities(F.col("text"), known).alias("e")).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    few, many = seconds(50), seconds(10_000)
    print(f"50 entities {few:.2f} s, 10,000 entities {many:.2f} s")
    assert many < 2 * few + 1
