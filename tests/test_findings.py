"""Cases of the review of round 3."""

import itertools
import random
import re

from pyspark.sql import functions as F

from quillmesh import registry
from quillmesh.functions import evidence
from quillmesh.functions import text as X
from quillmesh.operators import clustering as C
from quillmesh.operators import merging
from quillmesh.operators import relations as R
from quillmesh.operators import weights as W
from quillmesh.sources.scratch import Scratch


def test_upper_case_letter_by_letter(spark):
    rows = spark.createDataFrame([("Der scheinß üerau",), ("ﬁ ŉ ᾳé",), ("",), (None,)], "s string")
    got = [tuple(r) for r in rows.select(X.upper_letters(F.col("s")), evidence.without_title(F.col("s"), X.upper_letters(F.substring("s", 1, 12)))).collect()]
    assert got == [("DER SCHEINẞ ÜERAU", "üerau"), ("ﬁ ŉ ᾼÉ", "ﬁ ŉ ᾳé"), ("", ""), (None, "")]


def _plain_pairs(rows, hours=48):
    return {(a, b) for a, at, es in rows for b, bt, fs in rows if a < b and abs(at - bt) <= hours * 3600 and set(es) & set(fs)}


def test_pairs_meet_once_without_a_shuffle_of_pairs(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randrange(0, 400) * 3600), rng.sample(range(6), rng.randrange(0, 4))) for i in range(300)]
    table = spark.createDataFrame(rows, "id long, at double, entities array<long>")
    pairs = R.range_overlap_pairs(table)
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == _plain_pairs(rows)
    assert "HashAggregate" not in pairs._jdf.queryExecution().executedPlan().toString()
    rows += [(i, float(rng.randrange(0, 400) * 3600), [1, 1, 2]) for i in range(0, 300, 30)]
    got = [tuple(r) for r in R.range_overlap_pairs(spark.createDataFrame(rows, "id long, at double, entities array<long>")).collect()]
    assert len(got) == len(set(got)) and set(got) == _plain_pairs(rows)


def test_similar_pairs_are_scored_where_they_meet(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(12)]
    rows = []
    for i in range(250):
        kind = rng.random()
        rows.append((i, float(rng.randrange(0, 100) * 3600), rng.sample(["A", "B", "C"], rng.randrange(1, 3)) if kind < 0.6 else [], kind < 0.9, rng.choice([-0.5, 0.0, 0.5]), 1.0, sorted(rng.sample(words, rng.randrange(0, 7)))))
    table = spark.createDataFrame(rows, "id long, at double, tickers array<string>, unmapped boolean, score double, weight double, tokens array<string>")
    met, alike = set(), set()
    for a, at, ta, ua, sa, _, ka in rows:
        for b, bt, tb, ub, sb, _, kb in rows:
            strict = not ta and not tb and ua and ub and bool(set(ka) & set(kb))
            if a < b and abs(at - bt) <= 48 * 3600 and (set(ta) & set(tb) or strict):
                met.add((a, b, strict))
                share = len(set(ka) & set(kb)) / max(len(set(ka) | set(kb)), 1)
                if share >= (0.55 if strict else 0.4) and sa * sb >= 0:
                    alike.add((a, at, b, bt, round(share, 9)))
    pairs = C.similar_pairs(table)
    got = [(r.a, r.at_a, r.b, r.at_b, round(r.similarity, 9)) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == alike
    told = [tuple(r) for r in C.candidate_pairs(table).collect()]
    assert len(told) == len(set(told)) and set(told) == met
    fresh = table.where("id % 5 = 0").select("id")
    assert {(r.a, r.b) for r in C.similar_pairs(table, fresh=fresh).collect()} == {(a, b) for a, _, b, _, _ in alike if a % 5 == 0 or b % 5 == 0}


def test_thinned_edges_connect_the_same(spark):
    rng = random.Random(7)
    edges = [(a, b) for a in range(400) for b in rng.sample(range(a // 40 * 40, a // 40 * 40 + 40), 20) if a != b]
    table = spark.createDataFrame(edges, "a long, b long").repartition(3)
    for most in (None, 50):
        kept = merging.forest(table, most).collect()
        assert len(kept) < (1200 if most is None else len(edges)) and {(r.a, r.b) for r in kept} <= set(edges)
    scratch = Scratch(spark, "thin")
    assert {(r.id, r.component) for r in merging.components(scratch, table).collect()} == {(i, i // 40 * 40) for i in range(400)}


def test_normal_title_in_two_passes(spark):
    rows = ["A  b—c\t\nhttps://x.y/z?a q www.k d", " Été: 5%\r\n!", "", None, "x www.a\xa0b\x0bc d"]
    plain = lambda t: None if t is None else re.sub(r"[ \t\n\r]+", " ", re.sub(r"[^a-z0-9 \t\n\r]", " ", re.sub(r"https?://[^ \t\n\r]+|www\.[^ \t\n\r]+", " ", t.lower()))).strip(" ")
    out = spark.createDataFrame([(t,) for t in rows], "t string").select(X.normal_title(F.col("t")).alias("n"))
    assert [r.n for r in out.collect()] == [plain(t) for t in rows]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2


def test_titles_are_normalised_once_a_side(spark, tmp_path):
    rows = [(1, "One two three four five six"), (2, "one, two THREE four five!"), (3, "one two three four"), (4, "one two three four"), (5, None), (6, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pairs = registry.prefix_block_pairs(spark, str(tmp_path))
    assert [tuple(r) for r in pairs.collect()] == [(2, 1)]
    marked = registry.dup_marking(spark, str(tmp_path))
    assert {r.doc_id for r in marked.where("duplicate").collect()} == {4}
    assert "split(trim(regexp_replace" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_quantile_groups_only_the_deciding_block(spark):
    rng = random.Random(9)
    rows = [(g, float(rng.randrange(500)), float(rng.randrange(4))) for g in ("a", "b", None) for _ in range(3000)]
    out = W.weighted_quantile(spark.createDataFrame(rows, "g string, v double, w double"), ["g"], "v", 0.9, "q")
    for r in out.collect():
        own, total = sorted(x[1:] for x in rows if x[0] == r.g), sum(x[2] for x in rows if x[0] == r.g)
        sums = itertools.accumulate(w for _, w in own)
        assert r.q == next(v for (v, _), c in zip(own, sums) if c >= 0.9 * total - 1e-12)
    whole = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in x and "v#" in x.split("], [")[0]]
    assert whole and all("block_" in x.split("], [")[0] for x in whole)


def test_windows_of_a_chunk_are_worked_out_once(monkeypatch):
    import numpy as np

    from quillmesh.llm import chunks
    from quillmesh.llm import suffix_dedup as S

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "x1"]) for _ in range(rng.choice([0, 3, 40, 400]))).encode() for _ in range(60)]
    chunk = chunks.Chunk(chunks.pack_chunk(np.arange(60), np.array([len(t) for t in texts]), b"".join(texts)))
    blocks, calls, once = sum(1 for _ in S.blocks_of(chunk)), [], S.anchor_runs
    monkeypatch.setattr(S, "anchor_runs", lambda *a: calls.append(1) or once(*a))
    keys, _ = S._anchors(chunk)
    assert len(calls) == blocks
    own = S._Suffixes(chunk, 1, {0: chunks.pack_arrays(np.packbits(np.ones(len(keys), bool)), np.packbits(np.zeros(len(keys), bool)))})
    assert len(calls) == 2 * blocks and own.least
    # the same anchors, whatever the size of blocks
    monkeypatch.setattr(S, "BLOCK", 2000)
    assert np.array_equal(S._anchors(chunk)[0], keys)
    strings = list(own.strings)
    splitters = np.sort(np.array([S.leading(s[a : a + 8]) for s, a, _ in strings[::50]], np.uint64))
    fans = np.full(len(splitters) + 1, 3)
    offsets = np.cumsum(fans) - fans
    got = S._by_range(splitters, fans, offsets, strings)
    for (s, a, _), to in zip(strings, got.tolist(), strict=True):
        part = sum(int(x) <= int.from_bytes(s[a : a + 8], "big") for x in splitters)
        assert offsets[part] <= to < offsets[part] + 3


def test_vector_pairs_in_blocks(spark):
    rng = random.Random(6)
    rows = [(i % 190, rng.choice([1, 1, 1, 2, None]), [float(rng.randint(-2, 2)) / 2 for _ in range(rng.choice([3, 3, 3, 2]))]) for i in range(200)]
    rows += [(300, 1, None), (None, 1, [1.0, 1.0, 1.0]), (301, 1, [1.0, None, 1.0]), (302, 1, [float("nan"), 0.0, 0.0]), (303, 2, []), (304, 1, [0.1, 0.2, 0.0]), (305, 1, [1.0, 1.0, 0.0])]
    table = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    x, y = (table.select("label", F.col("id").alias(n), F.col("vector").alias(f"v{n}")) for n in "ab")
    for least in (0.3, 0.5, 0.1 + 0.2):
        want = sorted(tuple(r) for r in x.join(y, "label").where("a < b").where(R.cosine(F.col("va"), F.col("vb")) >= least).select("a", "b").collect())
        for most in (16, 10_000):
            assert sorted(tuple(r) for r in R.vector_pairs(table, least, most).collect()) == want and want
    plan = registry.queries()["cosine_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join Inner" not in plan


def test_texts_of_a_record_are_read_a_few_times(spark):
    from quillmesh.operators import enrichment as N

    rows = [("A b.", " a B!", "The text of the day. And with that", "", "Alpha;x", "T"), ("", "s", "s.", "Body of it. More", "", ""), (None, None, None, None, None, None), ("t", "t", "T?", " ", " ", "U"), ("x", "", "x! x. A new thing, that is. Last", "", "", "")]
    table = spark.createDataFrame(rows, "title string, summary string, content string, body_text string, companies string, tickers string")
    names = list(evidence.variants())
    assert evidence.with_variants(table).select(*names).collect() == table.select(*(v.alias(k) for k, v in evidence.variants().items())).collect()
    assert evidence.with_variants(table).columns[: len(table.columns)] == table.columns and set(evidence.with_variants(table).columns) == {*table.columns, *names}
    got = [r[0] for r in table.select(evidence.first_sentence(F.col("content"), F.col("title"))).collect()]
    assert got == ["The text of the day.", "s.", "", "", "A new thing, that is."]
    got = [r[0] for r in table.select(evidence.chosen(F.col("title"), F.lit(None).cast("string"), F.col("summary"), F.col("content"))).collect()]
    assert got == ["The text of the day. And with that", "s", "", "t", "! x. A new thing, that is. Last"]
    plan = N.enrich(N.with_input(table.withColumns({"article_id": F.lit("1"), "published_at": F.lit("2024-01-02"), "collected_at": F.lit("2024-01-03")})), registry.WORDS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 80


def test_kinds_cluster_as_all_pairs_do(spark):
    words = ["w%d" % i for i in range(5)]
    for seed, span in ((1, 200), (2, 60)):
        rng = random.Random(seed)
        kinds = [(rng.sample(["A", "B", "C"], rng.randrange(0, 3)), sorted(rng.sample(words, rng.randrange(0, 5)))) for _ in range(9)]
        rows = []
        for i in rng.sample(range(1000), 260):
            tickers, tokens = rng.choice(kinds)
            rows.append((i, None if rng.random() < 0.02 else float(rng.randrange(0, span) * 3600), tickers, rng.random() < 0.8, rng.choice([-0.5, 0.0, 0.0, 0.5, None]), 1.0, tokens))
        table = spark.createDataFrame(rows, "id long, at double, tickers array<string>, unmapped boolean, score double, weight double, tokens array<string>")
        want = {r.id: r.cluster for r in C.clusters(table, C.similar_pairs(table)).collect()}
        got = [tuple(r) for r in C.clusters_of_kinds(table, Scratch(spark, "kinds")).collect()]
        assert len(got) == len(rows) and dict(got) == want and 10 < len(set(want.values())) < 240


def test_copies_of_an_article_are_one_kind_and_no_pairs(spark):
    rows = [(i, i * 600.0, ["A"], False, 0.0, 1.0, ["x", "y"]) for i in range(2000)]
    table = spark.createDataFrame(rows, "id long, at double, tickers array<string>, unmapped boolean, score double, weight double, tokens array<string>")
    scratch = Scratch(spark, "copies")
    assert C.kinds(table, scratch)[1].count() < 30
    found = {r.id: r.cluster for r in C.clusters_of_kinds(table, Scratch(spark, "copies")).collect()}
    assert found == {i: i // 433 * 433 for i in range(2000)}


def test_a_stream_lets_closed_clusters_go():
    stream = merging.Stream(48 * 3600.0, 72 * 3600.0, {1: [1]})
    most = 0
    for i in range(20_000):
        stream.add(i * 600.0, i, 1)
        most = max(most, len(stream.of))
    stream.end()
    assert dict(stream.out) == {i: i // 433 * 433 for i in range(20_000)} and most < 5000


def test_sweep_sends_a_row_once_to_an_entity_and_holds_a_window(spark):
    rng = random.Random(17)
    rows = [(i, float(rng.randrange(-300, 900) * 3600), rng.sample(range(5), rng.randrange(0, 5))) for i in rng.sample(range(2000), 500)]
    rows += [(5000, None, [1]), (5001, float("nan"), [1]), (5002, float("inf"), [1]), (None, 0.0, [1]), (5003, 0.0, None)]
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(batch)
    spark.conf.set(batch, "16")
    pairs = R.range_overlap_pairs(spark.createDataFrame(rows, "id long, at double, entities array<long>"))
    got = [tuple(r) for r in pairs.collect()]
    spark.conf.set(batch, was)
    assert len(got) == len(set(got)) and set(got) == _plain_pairs([r for r in rows if r[0] is not None and r[0] < 5000])
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_candidate_pairs_come_from_a_sweep(spark):
    rng = random.Random(19)
    words = ["w%d" % i for i in range(6)]
    rows = []
    for i in range(220):
        tickers = rng.sample(["A", "B", "C"], rng.randrange(0, 3))
        rows.append((f"n{i}", float(rng.randrange(0, 300) * 3600), tickers, rng.random() < 0.8, sorted(rng.sample(words, rng.randrange(0, 4)))))
    table = spark.createDataFrame(rows, "id string, at double, tickers array<string>, unmapped boolean, tokens array<string>")
    want = set()
    for a, at, ta, ua, ka in rows:
        for b, bt, tb, ub, kb in rows:
            strict = not ta and not tb and ua and ub and bool(set(ka) & set(kb))
            if a < b and abs(at - bt) <= 48 * 3600 and (set(ta) & set(tb) or strict):
                want.add((a, b, strict))
    new = {f"n{i}" for i in range(0, 220, 3)}
    for fresh, of in ((None, want), (spark.createDataFrame([(x,) for x in sorted(new)], "id string"), {p for p in want if p[0] in new or p[1] in new})):
        pairs = C.candidate_pairs(table, fresh=fresh)
        got = [tuple(r) for r in pairs.collect()]
        assert len(got) == len(set(got)) and set(got) == of
        assert fresh is not None or "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
