"""Hand-computed numbers and properties of the article operators."""

import math

import pytest
from pyspark.sql import functions as F

from quillmesh import config
from quillmesh.functions import scoring as S
from quillmesh.functions import text as X
from quillmesh.operators import evaluation as E
from quillmesh.operators import metrics as M
from quillmesh.operators import relations as R
from quillmesh.operators import weights as W
from quillmesh.sources import tables


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_formulas(spark):
    row = spark.createDataFrame([(0.2, 0.5, 0.3, 1.0, 0.0, 1.0, 1.0, 0.0, 0.5)], "p_positive double, p_neutral double, p_negative double, b_bull double, b_bear double, g_growth double, s_shock double, k_unc double, entropy_norm double")
    base = row.select(*(c.alias(k) for k, c in S.article_formulas(config.BASELINE).items())).first()
    more = row.select(*(c.alias(k) for k, c in S.article_formulas(config.ENHANCED).items())).first()
    assert (base.optimism, base.fear) == (pytest.approx(20), pytest.approx(30))
    assert (more.optimism, more.fear) == (pytest.approx(44), pytest.approx(31))


def test_hit_score(spark):
    text = F.lit("Profits may grow. Nothing else. All is calm. The end.")
    assert one(spark, x=X.hit_score(X.sentences(text), ["may"])).x == pytest.approx(0.75)
    assert one(spark, x=X.hit_score(X.sentences(text), ["may"], ["profits"])).x == 0


def test_distance_and_mix(spark):
    df = W.with_safe_weight(spark.createDataFrame([("a", 0.5, 1.0), ("a", -0.5, 1.0), ("b", 0.3, 1.0), ("c", 0.1, -1.0), ("c", 0.9, None)], "g string, s double, agg_weight double"), ["g"])
    got = {r.g: r.distance for r in W.pairwise_distance(df, ["g"], "s").collect()}
    assert got["a"] == pytest.approx(0.5) and got["b"] == 0 and got["c"] == pytest.approx(0.4)


def test_risk_of_representatives(spark):
    rows = [("e1", 1, "x", 100.0, 1.0), ("e1", 2, "x", 0.0, 0.1), ("e2", 3, "x", 0.0, 1.0), ("e3", 4, "x", 50.0, 1.0)]
    df = spark.createDataFrame(rows, "event_key string, article_id long, sector string, risk_intensity double, agg_weight double")
    assert M.sector_risk(df, config.ENHANCED).first().risk_intensity == pytest.approx(0.7 * 50 + 0.3 * 100)


def test_noisy_or(spark):
    risks = F.array(*(F.struct(F.lit(s).alias("severity"), F.lit(v).alias("strength")) for s, v in ((5.0, 0.2), (2.5, 1.0))))
    assert one(spark, x=S.noisy_or(risks)).x == pytest.approx(60)


def test_clusters_respect_span(spark):
    nodes = spark.createDataFrame([(0, 0.0), (1, 40 * 3600.0), (2, 80 * 3600.0)], "id long, at double")
    edges = spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    got = R.constrained_clusters(edges, nodes, nodes.select("id", F.lit(0).cast("long").alias("component"))).collect()
    assert sorted((r.id, r.cluster) for r in got) == [(0, 0), (1, 0), (2, 2)]


def test_quantile_against_plain(spark):
    import random

    random.seed(5)
    rows = [("g", random.randint(0, 20) / 10, random.random()) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    total, cum = sum(w for *_, w in rows), 0.0
    for _, v, w in sorted(rows, key=lambda r: r[1]):
        cum += w
        if cum >= 0.9 * total - 1e-12:
            want = v
            break
    assert W.weighted_quantile(df, ["g"], "v", 0.9, "q").first().q == want


def test_range_pairs_against_plain(spark):
    import random

    random.seed(7)
    rows = [(i, random.uniform(0, 40 * 86400), [random.randint(0, 9), 10 + random.randint(0, 9)]) for i in range(300)]
    got = {(r.a, r.b) for r in R.range_overlap_pairs(spark.createDataFrame(rows, "id long, at double, entities array<long>")).collect()}
    want = {(a, b) for a, ta, ea in rows for b, tb, eb in rows if a < b and abs(ta - tb) <= 48 * 3600 and set(ea) & set(eb)}
    assert got == want


def test_reprints(spark):
    rows = [(1, "stocks rise on strong bank earnings today"), (2, "stocks rise on strong bank earnings today again"), (3, "stocks rise on strong but something else entirely"), (4, "short title")]
    assert [r.ord for r in R.similar_reprints(spark.createDataFrame(rows, "ord long, title string")).collect()] == [2]


def test_text_functions(spark):
    r = one(spark, t=X.normal_title(F.lit("Fed's Plan: https://a.b/c Rates UP!")), m=X.repair_mojibake(F.lit("Itâ€™s�")), h=X.hyperlink(F.lit("http://a/?q=\"x\"")), p=X.hyperlink(F.lit("=x")), s=F.size(X.sentences(F.lit("One. Two!  Three"))), c=X.count_terms(F.lit("aaa"), ["aa"]))
    assert r.t == "fed s plan rates up" and r.m == "It's" and r.h == '=HYPERLINK("http://a/?q=""x""","Open")' and r.p == "=x" and r.s == 3 and r.c == 1


def test_merge_context(spark):
    df = spark.createDataFrame([(1, 1, "A;b"), (1, 2, "B; c;a"), (2, 3, None)], "k long, o long, v string")
    assert {r.k: r.v for r in R.merge_context(df, "k", "v", "o").collect()} == {1: "A;b;c"}


def test_spearman(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("b", 1.0, 5.0), ("b", 2.0, 5.0), ("c", 1.0, 2.0), ("c", 2.0, 1.0)], "day string, x double, y double")
    assert {r.day: r.spearman for r in E.daily_spearman(df).collect()} == {"a": 1.0, "b": 0.0, "c": -1.0}


def test_report_and_calibration(spark):
    df = spark.createDataFrame([("positive", "positive"), ("negative", "neutral")], "actual string, predicted string")
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in E.class_report(df, spark).collect()}
    assert got == {"positive": (1, 1, 1, 1), "neutral": (0, 0, 0, 0), "negative": (0, 0, 0, 1)}
    bins = E.calibration(spark.createDataFrame([(1.0, 1), (0.95, 0), (0.0, 1)], "confidence double, correct int")).collect()
    assert sorted((r.bin, r.n) for r in bins) == [(0, 1), (9, 2)]


def test_sample_is_balanced_and_seeded(spark):
    df = spark.range(90).select("id", (F.col("id") % 3).alias("s"))
    a, b, c = (sorted(r.id for r in E.stratified_sample(df, "s", "id", 30, seed).collect()) for seed in (1, 1, 2))
    assert a == b != c and [sum(i % 3 == k for i in a) for k in range(3)] == [10, 10, 10]


def test_adaptive_windows_and_drivers(spark):
    rows = [(i, f"e{i}", "macro" if i == 9 else "x", f"s{i}", float(i), 0.1 * i, 1.0, None) for i in range(12)]
    df = spark.createDataFrame(rows, "article_id long, event_key string, sector string, source string, risk_intensity double, sentiment_score double, agg_weight double, published_at timestamp")
    df = df.withColumns({c: F.lit(0.0) for c in ("p_neutral", "entropy_norm", "k_unc")})
    top = M.top_drivers(df, limit=2, macro="macro").collect()
    assert [r.article_id for r in top] == [11, 9]


def test_csv_and_upsert(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    (tmp_path / "a.csv").write_text('﻿article_id,title,agg_weight,published_at\n1,"a ""b""\nc",x,2024-01-01T00:00:00Z\n2,,1.5,never\n', encoding="utf-8")
    rows = {r.article_id: r for r in tables.typed(tables.read_csv(spark, path)).collect()}
    assert rows["1"].title == 'a "b"\nc' and rows["1"].agg_weight == 0 and rows["2"].agg_weight == 1.5 and rows["2"].published_at is None
    assert tables.read_csv(spark, str(tmp_path / "no.csv")).count() == 0
    with pytest.raises(ValueError, match="missing columns"):
        tables.require(spark.range(1), ["x"])
    out = str(tmp_path / "snap")
    day = lambda rows: spark.createDataFrame(rows, "snapshot_date string, sector string, v double")
    tables.upsert_days(spark, out, day([("2024-01-01", "a", 1.0), ("2024-01-01", "b", 2.0), ("2024-01-02", "a", 3.0)]), ["snapshot_date", "sector"])
    tables.upsert_days(spark, out, day([("2024-01-01", "a", 9.0)]), ["snapshot_date", "sector"])
    got = sorted((str(r.snapshot_date), r.sector, r.v) for r in tables.stored(spark, out).collect())
    assert got == [("2024-01-01", "a", 9.0), ("2024-01-01", "b", 2.0), ("2024-01-02", "a", 3.0)]
    one_ = day([("d", "a", 1.0)])
    assert tables.write_if_changed(spark, one_, str(tmp_path / "w")) and not tables.write_if_changed(spark, one_, str(tmp_path / "w"))


def test_time_weight(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    r = one(spark, x=S.time_weight(t("2024-01-01"), t("2024-01-04")), y=S.time_weight(t("2024-01-04"), t("2024-01-01")))
    assert r.x == pytest.approx(math.exp(-1)) and r.y == 1


def test_queries_agree_with_their_sql(spark):
    import duckdb

    from quillmesh import registry

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")

    def plain(v):
        return "" if v is None or v != v else f"{round(float(v), 5) + 0.0:g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)[:10] if hasattr(v, "isoformat") else str(v)

    def rows(frame):
        return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))

    sql = registry.oracle_sql()
    for name in ("sector_metrics_enhanced", "event_collapse", "raw_merge", "range_overlap_pairs", "jaccard_pairs", "classification_report", "upsert"):
        assert rows(registry.queries()[name](spark, sf).toPandas()) == rows(con.sql(sql[name]).df()), name
