"""Enrichment, clustering, replay, brief, annotation and file sources."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from quillmesh import config
from quillmesh.functions import display, evidence, times
from quillmesh.operators import annotation as A
from quillmesh.operators import brief as B
from quillmesh.operators import clustering as C
from quillmesh.operators import enrichment as N
from quillmesh.operators import replay as P
from quillmesh.operators import tagging as T
from quillmesh.plans.articles import articles
from quillmesh.sources import demo, feeds, files, snapshots

SF = "/root/testdata/sf0.001"
DICTIONARIES = N.Dictionaries(
    companies=[T.Entity("Acme", "ACM", "Technology", ["acme"]), T.Entity("Bolt", "BLT", "Energy", ["bolt oil"])],
    sectors={"Energy": ["oil", "gas"], "Technology": ["chip"]},
    topics=[N.Topic("chips", ["chip", "wafer"], "Technology"), N.Topic("rates", ["rate"], "Financials")],
    risks=[T.RiskRule("credit risk", 5, ["default"]), T.RiskRule("demand risk", 3, ["slump"], ["weak", "soft"], 2)],
    signals={"bull": ["rally"], "bear": ["selloff"], "growth": ["record"], "shock": ["crash"], "uncertainty": ["may"], "blockers": ["no"]},
    lexicon={"positive": ["rally", "gain"], "negative": ["crash", "default"], "uncertainty": ["may"]},
    sources={"wire": 0.9, "blog": 0.5},
    fulltext_sources=["wire"],
)
COLUMNS = "article_id title summary content body_text url source publisher source_weight sector companies tickers published_at collected_at dedup_factor".split()
RAW = [
    ("1", "Acme stock in rally", "Acme stock in rally. Chip gains may last.", "", "Acme stock in rally. A default is feared by some. Sales slump.", "http://a/1", "wire;blog", "", "", "", "", "", "2024-01-02T00:00:00Z", "2024-01-03T00:00:00Z", ""),
    ("2", "Oil up", "", "Oil and gas prices gain", "", "http://a/2", "blog", "", "", "", "", "", "2024-01-02", "2024-01-02T12:00:00+02:00", "0.3"),
    ("3", "Bad", "", "", "", "", "", "", "", "", "", "", "never", "2024-01-02", "x"),
    ("4", "Nothing known", "rate talk", "", "", "", "", "p", "0.7", "", "X corp", "x", "2024-01-02", "2024-01-02", None),
]


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(RAW, ", ".join(f"{c} string" for c in COLUMNS))


@pytest.fixture(scope="module")
def enriched(spark, raw):
    return {r.article_id: r for r in N.enrich(raw, DICTIONARIES).collect()}


def test_enriched_rows(enriched):
    a, b, c, d = (enriched[k] for k in "1234")
    assert (a.sector, a.companies, a.tickers, a.topic, a.risk_category) == ("Technology", "Acme", "ACM", "chips", "credit risk;demand risk")
    assert a.evidence_sentence == "A default is feared by some." and a.content_level == "fulltext" and a.p_positive_fulltext is not None
    assert a.source_weight == 0.9 and a.time_weight == pytest.approx(math.exp(-24 / 72)) and a.agg_weight == pytest.approx(0.9 * a.time_weight)
    assert a.b_bull == 1 and a.k_unc == 1 and a.risk_intensity == pytest.approx(100)
    assert a.optimism == pytest.approx(100 * (0.7 * a.p_positive + 0.2)) and a.sentiment_score == pytest.approx(a.p_positive - a.p_negative)
    assert (b.sector, b.relevance_weight, b.evidence_sentence, b.content_level) == ("Energy", 0.7, "Oil and gas prices gain.", "summary")
    assert b.agg_weight == pytest.approx(0.7 * 0.3 * 0.5 * math.exp(-10 / 72)) and b.p_positive_fulltext is None
    assert c.processing_error.startswith("ValueError") and (c.p_neutral, c.agg_weight, c.uncertainty, c.sector) == (1, 0, 40, "Unmapped")
    assert (d.sector, d.relevance_weight, d.companies, d.publisher, d.source_weight) == ("Financials", 0.5, "X corp", "p", 0.7)


def test_incremental_keeps_known_rows_and_takes_new_sources(spark, raw, enriched):
    known = N.enrich(raw.where("article_id = '2'").withColumn("source", F.lit("old")), DICTIONARIES)
    now = F.lit("2024-01-05T00:00:00Z").cast("timestamp")
    got = {r.article_id: r for r in N.incremental(known, raw, DICTIONARIES, now).collect()}
    assert set(got) == set("1234") and got["2"].source == "blog" and got["2"].agg_weight == pytest.approx(0.7 * 0.3 * 1.0 * math.exp(-10 / 72))
    assert got["3"].processing_error is None and "published_at" in got["3"].time_parse_error


def test_backfills(spark, enriched):
    rows = spark.createDataFrame([("9", "Acme rally", "0.5", "0.3", "0.2", "", "", "", "", "", "", "1", "0.5", "0.5", "wire", ""), ("8", "t", "0.5", "0.3", "0.2", "0.1", "0", "0", "0", "0", "0.9", "1", "1", "1", "", "0.4")], "article_id string, title string, p_positive string, p_neutral string, p_negative string, b_bull string, b_bear string, g_growth string, s_shock string, k_unc string, entropy_norm string, time_weight string, relevance_weight string, dedup_factor string, source string, source_weight string")
    got = {r.article_id: r for r in N.backfill_components(rows, DICTIONARIES).collect()}
    assert got["9"].b_bull == 1 and got["9"].entropy_norm == pytest.approx(-(0.5 * math.log(0.5) + 0.3 * math.log(0.3) + 0.2 * math.log(0.2)) / math.log(3)) and got["8"].b_bull == 0.1
    src = {r.article_id: r for r in N.backfill_sources(rows, DICTIONARIES).collect()}
    assert src["9"].agg_weight == pytest.approx(1 * 0.5 * 0.5 * 0.9) and src["8"].agg_weight == pytest.approx(0.4) and src["9"].publisher == "wire"


def test_fulltext_candidates_and_rescore(spark, raw):
    rows = [("a", "T one", "http://w/1", "wire", 80.0, 0.1, 1.0, "e1"), ("b", "t ONE!", "http://w/2", "wire", 10.0, 0.9, 1.0, "e2"), ("c", "T three", "http://w/3", "blog", 99.0, 0.9, 1.0, "e3"), ("d", "T four", "ftp://w/4", "wire", 99.0, 0.9, 1.0, "e4"), ("e", "T five", "http://w/5", "wire", 10.0, 0.1, 1.0, "e5"), ("f", "T six", "http://w/6", "wire", 99.0, 0.0, 1.0, "e6")]
    art = spark.createDataFrame(rows, "article_id string, title string, url string, source string, risk_intensity double, sentiment_score double, agg_weight double, event_id string").withColumns({"published_at": F.lit("2024-01-02T05:00:00Z"), "content_level": F.lit("summary")})
    cache = spark.createDataFrame([("z", "ok", "T six", "http://x", "b", "")], feeds.CACHE)
    got = N.fulltext_candidates(art, art.where("article_id = 'e'"), cache, F.lit("2024-01-02").cast("date"), DICTIONARIES).collect()
    assert [(r.article_id, r.priority) for r in got] == [("e", 8), ("a", 2)]
    pages = spark.createDataFrame([("2", "Oil and gas gain. " * 20), ("1", "short")], "article_id string, body_text string")
    done = {r.article_id: r for r in N.rescore(N.enrich(raw, DICTIONARIES), pages, DICTIONARIES).collect()}
    assert len(done) == 4 and done["2"].rescored == "True" and done["2"].content_level == "fulltext" and done["1"].rescored == "False"


def test_evidence_and_texts(spark):
    t, s = F.lit("Fed acts"), F.lit("Fed acts: rates rise.")
    r = one(spark, a=evidence.without_title(s, t), b=evidence.without_title(t, t), c=evidence.event_text(t, F.lit("FED ACTS")), d=evidence.event_text(t, F.lit("more")), e=evidence.tickers(F.lit("aapl; msft|AAPL,x")), f=evidence.joined(evidence.parts(t, F.lit("fed  acts!"), F.lit("Other?"))), g=evidence.chosen(t, t, F.lit(""), F.lit("Own words.")), h=evidence.chosen(t, t), i=display.strip_html(F.lit("<b>a</b>&amp;&lt;i&gt;b")), j=display.clean_text(F.lit("a&lt;i&gt;b")), k=display.markdown_link(F.lit("a[b]"), F.lit("https://x")), m=display.dense_paragraphs(F.lit("1 2 3. 4 5. 6.")), n=display.metric(F.lit(float("nan"))), o=evidence.greatest_weight(F.lit("wire;blog"), {"wire": 0.9, "blog": 0.5}), p=evidence.greatest_weight(F.lit("new"), {"wire": 0.9}), q=display.badge(F.lit(0.2)))
    assert r.a == "rates rise." and r.b == "" and r.c == "Fed acts" and r.d == "Fed acts more" and r.e == ["AAPL", "MSFT", "X"] and r.f == "Fed acts. Other?"
    assert r.g == "Own words." and r.h == "Fed acts" and r.i == "a &<i>b" and r.j == "a b" and r.k == "[a\\[b\\]](https://x)" and r.m == "1 2 3.\n\n4 5. 6." and r.n == 0 and r.o == 0.9 and r.p == 1.0 and r.q == ":green[positive +0.20]"


def test_times(spark):
    now = F.lit("2024-03-01T00:00:00Z").cast("timestamp")
    r = one(spark, a=times.formatted(times.parsed(F.lit("2024-01-02T03:04:05+02:00"))), b=times.formatted(times.parsed(F.lit("2024-01-02T03:04:05"))), c=times.parsed(F.lit("soon")), d=times.formatted(times.feed_time(F.lit("Tue, 2 Jan 2024 03:04:05 GMT"), now)), e=times.formatted(times.feed_time(F.lit("?"), now)), f=times.label(times.parsed(F.lit("2024-01-02"))), g=times.formatted(times.feed_time(F.lit("02 Jan 2024 03:04:05 -0500"), now)))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("2024-01-02T01:04:05+00:00", "2024-01-02T03:04:05+00:00", None, "2024-01-02T03:04:05+00:00", "2024-03-01T00:00:00+00:00", "2024-01-02 00:00", "2024-01-02T08:04:05+00:00")


def _events(spark, rows):
    return spark.createDataFrame(rows, "article_id string, title string, summary string, tickers string, sector string, published_at string, sentiment_score double, agg_weight double, source string, event_id string")


def test_clusters_in_context(spark):
    same = "central bank raises its key rate again"
    rows = [
        ("a", same, "", "AAA", "X", "2024-01-01T00:00:00Z", 0.1, 1.0, "s1", ""), ("b", same + " today", "", "AAA;BBB", "X", "2024-01-02T16:00:00Z", 0.1, 2.0, "s2", ""), ("c", same, "", "AAA", "X", "2024-01-04T08:00:00Z", 0.1, 1.0, "s1", ""),
        ("d", same, "", "CCC", "X", "2024-01-01T00:00:00Z", 0.8, 1.0, "s1", ""), ("e", same, "", "CCC", "X", "2024-01-01T01:00:00Z", -0.8, 1.0, "s1", ""),
        ("f", same, "", "", "Unmapped", "2024-01-01T00:00:00Z", 0.0, 1.0, "s1", ""), ("g", same, "", "", "", "2024-01-01T02:00:00Z", 0.0, 1.0, "s3", ""), ("h", same, "", "", "X", "2024-01-01T02:00:00Z", 0.0, 1.0, "s3", ""), ("i", same, "", "AAA", "X", "never", 0.0, 1.0, "s3", ""),
    ]
    got = {r.article_id: (r.event_id, r.source_count) for r in C.cluster_articles(_events(spark, rows), ["its", "again"]).collect()}
    assert got == {"a": ("b", 2), "b": ("b", 2), "c": ("c", 1), "d": ("d", 1), "e": ("e", 1), "f": ("f", 2), "g": ("f", 2), "h": ("h", 1), "i": ("i", 1)}
    old = _events(spark, [rows[0][:-1] + ("k",), rows[1][:-1] + ("k",)])
    more = {r.article_id: r.event_id for r in C.cluster_incremental(old, _events(spark, [("n", same, "", "BBB", "X", "2024-01-02T18:00:00Z", 0.1, 5.0, "s9", "")]), ["its"]).collect()}
    assert more == {"a": "n", "b": "n", "n": "n"}
    assert C.engine_of("embedding", ["id"]) == ("lexical", "no vectors") and C.engine_of("odd", [])[0] == "lexical"


def test_sweep(spark):
    parts = P.components(spark, P.prepared(articles(spark, SF))).persist()
    rows = P.sweep(spark, parts).collect()
    assert len(rows) == 75 and {r.dimension for r in rows} == set(config.METRICS)
    assert all(r.mean_daily_spearman <= 1 + 1e-9 and 0 <= r.mean_daily_top3_jaccard <= 1 for r in rows)
    same = P.sweep(spark, parts, factors=(1.0,)).collect()
    assert len(same) == 15 and all(r.mean_daily_spearman == 1 and r.mean_absolute_score_change == 0 and r.mean_daily_top3_jaccard == 1 for r in same)
    assert P.most_sensitive(P.sweep(spark, parts)).count() == 6
    assert P.perturbed("fear", "b_bear", 0.0)["fear"] == pytest.approx({"p_negative": 0.875, "b_bear": 0.0, "s_shock": 0.125})
    with pytest.raises(ValueError, match="finite"):
        P.perturbed("fear", "b_bear", -1.0)


def test_brief(spark):
    a = articles(spark, SF)
    now = a.agg(F.max("published_at")).first()[0]
    rows = a.withColumns({"title": F.concat(F.lit("T"), F.col("article_id") % 50), "topic": F.col("source"), "risk_category": F.lit(""), "evidence_sentence": F.lit("e"), "content_level": F.when(F.col("article_id") % 2 == 0, "fulltext").otherwise("summary")})
    before = spark.createDataFrame([(now.date() - dt.timedelta(days=n), f"t{n}", r, 10.0 * n) for n, r in ((1, "r3"), (1, "r4"), (2, "r4"))], "snapshot_date date, snapshot_timestamp string, pipeline_revision string, v double")
    market = before.select("*", *(F.col("v").alias(m) for m in config.METRICS))
    sectors = market.crossJoin(spark.createDataFrame([("view",), ("click",)], "sector string"))
    told = B.payload(spark, rows, now, "real", market, sectors)
    assert set(told["market"]["scores"]) == set(config.METRICS) and told["coverage"]["article_count"] == B.window_of(rows, now).count()
    assert told["market"]["delta_vs_previous_day"]["fear"] == pytest.approx(told["market"]["scores"]["fear"] - 10, abs=0.06)
    assert len(told["sectors"]["rankings"]["fear"]) == len(config.GROUPS) and {m["sector"] for m in told["sectors"]["movers"]} == {"view", "click"}
    text = B.rule_text(json.loads(B.as_json(told)))
    assert "optimism" in text and B.DISCLAIMER in text
    assert B.tone({"risk_intensity": 70}) == "cautious" and B.tone({"optimism": 60, "fear": 10}) == "optimistic"
    assert B.due(dt.datetime(2024, 1, 2, 9), 8, "2024-01-01T09:00") and not B.due(dt.datetime(2024, 1, 2, 9), 8, "2024-01-02T08:30") and not B.due(dt.datetime(2024, 1, 2, 7), 8, None)


def test_evaluation_fixture(spark):
    kinds = ("positive", "neutral", "negative")
    blind, key = [], []
    for i in range(30):
        true = kinds[i // 10]
        wrong = i % 10 < 2
        guess = {"positive": "neutral", "neutral": "positive", "negative": "neutral"}[true] if wrong else true
        blind.append((f"a{i}", {"positive": "正面", "neutral": "neu", "negative": "NEGATIVE"}[true], "1" if i % 10 else "0", "credit risk" if i % 2 else "", "yes"))
        key.append((f"a{i}", guess, *(0.8 if guess == k else 0.1 for k in kinds), "credit risk;macro risk"))
    b = spark.createDataFrame(blind, "article_id string, label_sentiment string, label_sector_ok string, label_risk_categories string, label_evidence_ok string")
    k = spark.createDataFrame(key, "article_id string, predicted_sentiment_finbert string, p_positive double, p_neutral double, p_negative double, predicted_risk_categories string")
    out = A.evaluate(b, k, spark, ["credit risk", "macro risk"])
    both = {r.model: r for r in out["comparison"].collect()}
    assert both["model"].accuracy == pytest.approx(0.8) and both["model"].macro_f1 == pytest.approx(0.8, abs=0.01)
    assert both["all neutral"].accuracy == pytest.approx(1 / 3) and both["all neutral"].macro_f1 == pytest.approx(1 / 6)
    assert out["brier"].first().brier == pytest.approx(0.8 * 0.06 + 0.2 * (0.81 + 0.64 + 0.01)) and out["errors"].count() == 6
    assert out["sector"].first().share == pytest.approx(0.9) and {r.label: r.recall for r in out["risks"].collect()} == {"credit risk": 1.0, "macro risk": 0.0}
    with pytest.raises(ValueError, match="partner"):
        A.checked_join(b, k.limit(29), "article_id")
    with pytest.raises(ValueError, match="repeated"):
        A.checked_join(b.union(b), k, "article_id")
    with pytest.raises(ValueError, match="unknown labels"):
        A.risk_report(b, "label_risk_categories", "label_risk_categories", ["macro risk"], spark).collect()


def test_blind_sample(spark):
    rows = [(f"a{i:02}", f"t{i}", "s", "c", "u", "2024-01-01", ("x", "y")[i % 2], "r", "e", 0.6, 0.3, 0.1) for i in range(40)]
    every = spark.createDataFrame(rows, "article_id string, title string, summary string, content string, url string, published_at string, sector string, risk_category string, evidence_sentence string, p_positive double, p_neutral double, p_negative double")
    blind, key = A.blind_and_key(every.select(*A.BLIND), every, 24, 7)
    assert blind.count() == 24 and not any("predict" in c for c in blind.columns) and {r.article_id for r in blind.collect()} == {r.article_id for r in key.collect()}
    assert A.completed_cells(blind).first().completed == 0
    assert A.fingerprint(blind).first().fingerprint == A.fingerprint(blind.repartition(5)).first().fingerprint != A.fingerprint(every).first().fingerprint


def test_snapshot_tables(spark, tmp_path):
    a = articles(spark, SF)
    now = dt.datetime(2024, 2, 1, 12)
    paths = [str(tmp_path / n) for n in ("sectors", "market")]
    for _ in range(2):
        snapshots.write(spark, *paths, a, "real", now)
    assert snapshots.sectors(spark, paths[0], "real").count() == len(config.GROUPS) and snapshots.market(spark, paths[1], "real", None).count() == 2
    assert snapshots.attention_history(spark, paths[0], "real").count() == len(config.GROUPS)
    old = tmp_path / "old.csv"
    old.write_text("snapshot_date,snapshot_timestamp,data_source,article_count,optimism,sector\n2024-01-01,t,real,5,10,x\n")
    r = snapshots.sectors(spark, str(old), "real", "baseline").first()
    assert (r.formula_version, r.pipeline_revision, r.attention_volume, r.optimism) == ("baseline", "r1", 5.0, 10.0)
    assert snapshots.market(spark, str(tmp_path / "none")).count() == 0


def test_small_files(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'a "b"\nc', None)], "id string, text string, url string")
    path = str(tmp_path / "x.csv")
    for _ in range(13):
        files.write_csv(spark, rows, path, ["text", "id", "more"], str(tmp_path / "old"))
    got = spark.read.csv(path, header=True, multiLine=True, escape='"').first()
    assert got.text == 'a "b"\nc' and got.id == "1" and len(list((tmp_path / "old").glob("x.csv.*"))) == 10
    files.write_brief(spark, str(tmp_path / "brief"), {"generated_at": "2024"}, "body\ntext", "2024-01-01")
    assert files.read_brief(spark, str(tmp_path / "brief")) == ({"generated_at": "2024"}, "body\ntext")
    files.write_metadata(spark, str(tmp_path / "m.json"), "b", "f", 3, 7)
    told = files.read_metadata(spark, str(tmp_path / "m.json"))
    assert files.matches(told, "b", "f") and not files.matches(told, "b", "g")
    files.write_json(spark, str(tmp_path / "n.json"), {"batch_id": 1})
    with pytest.raises(ValueError, match="missing"):
        files.read_metadata(spark, str(tmp_path / "n.json"))


def test_feeds(spark, tmp_path):
    told = [{"name": "M", "url": "https://m/x", "kind": "market"}, {"name": "T", "url": "https://t/{ticker}", "kind": "ticker", "weight": 0.5, "max_entries": 2}, {"name": "off", "url": "https://o", "kind": "sector", "enabled": False}]
    companies = spark.createDataFrame([("AAA", "X"), ("BBB", "Y"), ("AAA", "X")], "ticker string, sector string")
    got = sorted((r.feed, r.url, r.sector) for r in feeds.expanded(spark, feeds.checked(told), companies).collect())
    assert got == [("M", "https://m/x", ""), ("T", "https://t/AAA", "X"), ("T", "https://t/BBB", "Y")]
    for bad in ({"weight": 2}, {"kind": "x"}, {"max_entries": 0}, {"url": "ftp://x"}):
        with pytest.raises(ValueError, match="feed 0"):
            feeds.checked([{**told[0], **bad}])
    entries = [("T", "https://n/1", "One &amp; <b>two</b>", "s", "", "", "Tue, 2 Jan 2024 03:04:05 GMT", 0.5, "X", "AAA", 0, 2), ("M", "https://N/1", "one & two", "s", "Pub", "", "", 1.0, "Y", "", 1, 9), ("T", "https://n/2", "late", "s", "", "", "", 0.5, "X", "AAA", 2, 2)]
    rows = feeds.records(spark.createDataFrame(entries, "feed string, link string, title string, summary string, source string, publisher string, published string, weight double, sector string, ticker string, place int, max_entries int"), "2024-01-03T00:00:00Z")
    one_ = feeds.collected(rows).collect()
    assert [(r.title, r.source, r.sector, r.published_at, r.source_weight) for r in one_] == [("One & two", "T;M", "", "2024-01-02T03:04:05+00:00", "1.0")]
    assert {(r.source, r.parsed, r.new) for r in feeds.stats(rows, rows.where("source = 'M'")).collect()} == {("M", 1, 1), ("T", 1, 0)}
    (tmp_path / "c.json").write_text(json.dumps({"a": {"status": "ok", "body_text": "x &amp; <p>y"}}))
    cache = feeds.read_cache(spark, str(tmp_path / "c.json"))
    feeds.write_cache(cache, str(tmp_path / "c"))
    assert feeds.read_cache(spark, str(tmp_path / "c")).first().body_text == "x & y" and feeds.read_cache(spark, str(tmp_path / "no")).count() == 0


def test_demo_batch(spark):
    rows = demo.demo_articles(spark, ["Energy", "Technology"])
    assert rows.count() == 24
    out = N.batch(rows, DICTIONARIES, F.lit("2026-01-06T00:00:00Z").cast("timestamp"))
    got = {r.article_id: r for r in out.collect()}
    assert sum(r.dedup_status == "duplicate" for r in got.values()) == 2 and got["demo-0010"].dedup_factor == "0.3" and all(r.processing_error is None for r in got.values())
    assert C.cluster_articles(out, []).count() == 24


def test_context_clusters_against_plain_greedy(spark):
    from quillmesh import registry

    rows = registry._news(spark, SF).selectExpr("article_id", "unix_micros(cast(published_at as timestamp)) / 1e6 AS at", "title", "tickers", "sector", "sentiment_score", "agg_weight", "source").collect()
    rows.sort(key=lambda r: (r["at"], r["article_id"]))
    words = {r["article_id"]: set(r["title"].split()) for r in rows}
    cluster = {r["article_id"]: [r] for r in rows}
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            if y["at"] - x["at"] > 48 * 3600:
                break
            strict = not x["tickers"] and not y["tickers"] and x["sector"] == y["sector"] == "Unmapped"
            if not strict and not (x["tickers"] and x["tickers"] == y["tickers"]):
                continue
            a, b = words[x["article_id"]], words[y["article_id"]]
            if len(a & b) / len(a | b) < (0.55 if strict else 0.4) or max(x["sentiment_score"], y["sentiment_score"]) > 0.3 and min(x["sentiment_score"], y["sentiment_score"]) < -0.3:
                continue
            one, two = cluster[x["article_id"]], cluster[y["article_id"]]
            if one is not two and max(r["at"] for r in one + two) - min(r["at"] for r in one + two) <= 72 * 3600:
                one += two
                for r in two:
                    cluster[r["article_id"]] = one
    want = {k: (min(v, key=lambda r: (-r["agg_weight"], r["article_id"]))["article_id"], len({r["source"] for r in v})) for k, v in cluster.items()}
    got = {r.article_id: (r.event_id, r.source_count) for r in registry.queries()["context_clusters"](spark, SF).collect()}
    assert got == want and any(len(v) > 1 for v in cluster.values())
