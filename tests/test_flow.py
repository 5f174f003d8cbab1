"""Whole runs: two increments equal one full run, and old tables are clustered from the start."""

import datetime as dt

from pyspark.sql import functions as F

from quillmesh.operators import clustering as C
from quillmesh.operators import enrichment as N
from quillmesh.operators import flow
from quillmesh.sources.store import Store
from tests_data import DICTIONARIES, raw_records


def test_two_increments_equal_one_full_run(spark, tmp_path):
    raw, now = raw_records(spark), dt.datetime(2024, 1, 10, tzinfo=dt.UTC)
    two = str(tmp_path / "two")
    whole = C.cluster_articles(N.batch(raw, DICTIONARIES, F.lit("2024-01-10T00:00:00Z").cast("timestamp")), ["its"])
    flow.increment(spark, two, raw.where("published_at < '2024-01-04'"), DICTIONARIES, now, ["its"])
    assert flow.increment(spark, two, raw, DICTIONARIES, now, ["its"]) == 2

    store = Store(spark, two)
    assert {"articles", "errors", "sectors", "market"} == set(store.manifest()["tables"])
    told = lambda df: {r.article_id: (r.event_id, r.source_count, round(r.sentiment_score, 6)) for r in df.select("article_id", "event_id", "source_count", "sentiment_score").collect()}
    first = told(whole)
    assert first == told(store.read("articles")) and len(first) == raw.count() and any(k != v[0] for k, v in first.items())


def test_only_open_events_are_read_in(spark):
    rows = [(f"k{i}", "central bank raises its key rate", "", "AAA", "X", f"2024-01-{1 + i:02d}T00:00:00Z", 0.1, 1.0, "s", f"e{i}", i) for i in range(0, 20, 5)]
    schema = "article_id string, title string, summary string, tickers string, sector string, published_at string, sentiment_score double, agg_weight double, source string, event_id string, source_count int"
    new = spark.createDataFrame([("n", "central bank raises its key rate", "", "AAA", "X", "2024-01-16T10:00:00Z", 0.1, 9.0, "t", "", 0)], schema)
    got = {r.article_id: (r.event_id, r.source_count) for r in C.cluster_incremental(spark.createDataFrame(rows, schema), new, ["its"]).collect()}
    assert got == {"k0": ("e0", 0), "k5": ("e5", 5), "k10": ("e10", 10), "k15": ("n", 2), "n": ("n", 2)}
    old = spark.createDataFrame(rows, schema).withColumn("event_id", F.when(F.col("article_id") != "k0", F.col("event_id")))
    migrated = {r.article_id: r.event_id for r in C.cluster_incremental(old, new, ["its"]).collect()}
    assert migrated == {"k0": "k0", "k5": "k5", "k10": "k10", "k15": "n", "n": "n"}
