"""Ranked search against SQL on whole tables, and against a plain version on odd rows and small shards."""

import math
import re

import duckdb
import numpy as np
import pytest

from quillmesh.llm import ranked_search
from quillmesh.llm.work import Work

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=50):
    docs = [(d, ts) for d, ts in ((d, terms(t)) for d, t in docs) if ts]
    n, length = len(docs), sum(len(ts) for _, ts in docs)
    out = []
    for item, text in items:
        found = []
        asked = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in ts for _, ts in docs) + 1))) for t in set(terms(text))}
        for d, ts in docs:
            m = 50 + (50 * len(ts) * n) // length
            score = sum(w * ((10**9 * ts.count(t)) // (1000 * ts.count(t) + 20 * m)) for t, w in asked.items() if t in ts)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_tables_against_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    want = con.sql(ranked_search.sql())
    got = ranked_search.op12_ranked_search(spark, path).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


DOCS = [
    (1, "Apple pear, APPLE"), (2, "apple pear, apple"), (3, None), (4, ""), (5, " .,:;/@[`{\x7f"), (None, "apple pear, apple"), (-9, "Ünder über ÜBER Über apple_pie x-ray 12.5"),
    (7, "word " * 300_000 + "needle"), (8, "apple"), (8, "pear apple"), (10, "a\0b\nneedle"), (11, "日本語 пример ＡＢＣ İstanbul"), *[(20 + i, "same text again") for i in range(120)],
]
ITEMS = [(1, "apple"), (2, "Same text"), (3, None), (4, ""), (5, "?!"), (None, "needle PEAR pear"), (6, "über Über 12 5 x"), (7, "nowhere"), (8, "日本語 istanbul İstanbul ａｂｃ b"), (1, "apple")]


@pytest.mark.parametrize(("shard", "block"), [(8 << 20, 1000), (40, 3), (1, 1)])
def test_odd_rows(spark, monkeypatch, shard, block):
    monkeypatch.setattr(ranked_search, "BLOCK_QUERIES", block)
    docs = spark.createDataFrame([(d, t, 1, 2.0) for d, t in DOCS], "doc_id long, text string, rank int, score double")
    items = spark.createDataFrame([(i, t, 5) for i, t in ITEMS], "item_id long, text string, doc_id int")
    work = Work(spark, "test")
    got = ranked_search.search(work, ranked_search.build_index(work, docs, shard), items)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(DOCS, ITEMS), key=key)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    work = Work(spark, "test")
    assert ranked_search.search(work, ranked_search.build_index(work, docs), items).count() == 0
    work = Work(spark, "test")
    index = ranked_search.build_index(work, spark.createDataFrame(DOCS, "doc_id long, text string"))
    assert ranked_search.search(work, index, items.limit(0)).count() == 0


def test_best_takes_ties_by_place():
    rng = np.random.default_rng(5)
    for _ in range(200):
        scores = rng.integers(0, 6, rng.integers(0, 40))
        k = int(rng.integers(1, 12))
        want = sorted((i for i in range(len(scores)) if scores[i]), key=lambda i: (-scores[i], i))[:k]
        assert sorted(ranked_search.best(scores, k).tolist()) == sorted(want)


def test_impacts_beyond_64_bits():
    n_docs, all_terms, n = 30_000_000_000, 10**13, 10**9
    (got,) = ranked_search.impacts(np.array([7]), np.array([n]), np.array([0]), n_docs, all_terms)
    assert got == 7 * 10**9 // (7000 + 20 * (50 + 50 * n * n_docs // all_terms))
