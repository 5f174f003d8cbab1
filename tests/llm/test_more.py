"""Scoring, extraction, decontamination, mixing and the pipeline."""

import html
import math
import re
import zlib

import pytest

import brute
import corpus_pipeline
from quillmesh.llm import decontamination, html_extract, mixing, suffix_tree_lm
from quillmesh.llm.work import Work
from test_contracts import ODD, SF, unique


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, "en" if d else None, None if d == 1013 else "s", "x") for d, t in ODD], "doc_id long, text string, lang string, source string, mix_tokens string")


def test_scores(spark, docs, odd):
    for frame in (docs, odd.where("doc_id is not null and doc_id <> 1013")):
        rows = unique([(r.doc_id, r.text) for r in frame.collect()])
        base, tree = brute.base_scores(rows), brute.suffix_tree(rows)[0]
        out = suffix_tree_lm.score_documents(spark, frame.repartition(3)).collect()
        assert {r.doc_id for r in out} == set(base)
        for r in out:
            held, n, known, total, score = base[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
            assert r.base_score == pytest.approx(score, rel=1e-9) and r.score == pytest.approx(tree[r.doc_id], rel=1e-9)
            assert r.score_per_token == pytest.approx(r.score / r.n_tokens, rel=1e-12)


def test_hot_contexts_are_spread(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for depth in (1, 4):
        tree = brute.suffix_tree(rows, depth)[0]
        assert {r.doc_id: pytest.approx(r.score, rel=1e-9) for r in suffix_tree_lm.score_documents(spark, docs, depth, 50).collect()} == tree


def test_states_sum_to_one(docs):
    _, p, states, counts = brute.suffix_tree([(r.doc_id, r.text) for r in docs.collect()])
    assert {len(s) for s in states} == {1, 2, 3}
    for s in sorted(states, key=str)[::40]:
        assert sum(p(s, x) for x in counts) + p(s, "a word never seen") == pytest.approx(1)


def test_scores_without_training_and_of_odd_ids(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    out = suffix_tree_lm.score_documents(spark, frame([(i, "a b a") for i in held])).collect()
    assert len(out) == len(held) and {(r.n_known, r.train_tokens, r.base_score, r.score) for r in out} == {(0, 0, 0.0, 0.0)}
    assert suffix_tree_lm.score_documents(spark, frame([]).limit(0)).count() == 0
    own = next(i for i in range(1, 20) if zlib.crc32(str(i).encode()) % 7 != 2)
    assert zlib.crc32(b"") % 7 != 2
    rows = [(None, "a b a"), (None, None), (own, "a b a"), (own, "a b a"), (own, "")]
    got = sorted((r.doc_id or 0, r.n_tokens, r.train_tokens, round(r.base_score, 9)) for r in suffix_tree_lm.score_documents(spark, frame(rows)).collect())
    known = {"a": 6, "b": 3, None: 5}
    base = lambda *ws: round(sum(math.log10((known[w] + 1) / (14 + 4)) for w in ws), 9)
    assert got == sorted([(d or 0, len((t or "").split()) + 1, 14, base(*(t or "").split(), None)) for d, t in rows])


def plain_article(page):
    body = re.sub("<br>", " ", re.search("<article>(.*?)</article>", page, re.DOTALL)[1])
    lines = re.sub("<[^>]*>", "", re.sub("</?(?:p|h1)>", "\n", body)).split("\n")
    return "\n".join(x for x in (" ".join(html.unescape(line).split()) for line in lines) if x)


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: plain_article(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in html_extract.main_texts(pages).collect()} == want
    rows = [(None, None, None), (1, "http://a/", ""), (2, "x", "no tags &amp; <b>bold"), (3, "http://b.c/1", "<p>" * 3000 + "deep"), (3, "http://b.c/1", "<p>again")]
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(0, "", 0), (1, "", 0), (2, "no tags & bold", 14), (3, "again", 5), (3, "deep", 4)]
    assert html_extract.main_texts(pages.limit(0)).count() == 0


PAGE = """<html><body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><div id="wrap"><div class="sidebar">side {n}</div>
<div class="post-body"><h2>Title {n}</h2><p>Text one&nbsp;of {n}<p>and <i>two</i> &lt;{n}&gt;</p><ul><li>item</li><li>other</li></ul>{more}</div>
<div class="comments"><p>reader {n} says</p></div><form>search</form></div><footer>foot</footer><script>x("</p>")</script></body></html>"""


def test_wrapper_of_a_host():
    pages = [PAGE.format(n=n, more="<blockquote>quoted</blockquote>" if n % 2 else "") for n in range(4)]
    wrapper = html_extract.infer(pages)
    path = html_extract.article_path(wrapper)
    assert path[-1] == "div post-body"
    body = wrapper
    for label in path:
        body = next(c for c in body[2] if c[0] == label)
    shape = {c[0]: c[1] for c in body[2]}
    assert shape == {"h2": "1", "p": "+", "ul": "1", "blockquote": "?"}
    assert html_extract.extract(pages[1], wrapper, path) == "Title 1\nText one of 1\nand two <1>\nitem\nother\nquoted"


def test_benchmark(spark, docs, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = bench.collect()
    got = {r.doc_id: r.items for r in decontamination.find_contaminated(docs, bench).collect()}
    for r in docs.collect():
        whole = [i.item_id for i in items if i.text in r.text]
        assert set(map(str, whole)) <= set(got[r.doc_id].split(",")), r.doc_id
        shared = {w for i in items for w in grams(i.text)} & grams(r.text)
        assert bool(got[r.doc_id]) <= bool(shared)
    assert decontamination.find_contaminated(odd, bench).where("contaminated").count() == 0
    assert decontamination.find_contaminated(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.find_contaminated(docs.limit(0), bench).count() == 0
    kept = decontamination.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, i in got.items() if not i}


def grams(text, n=8):
    w = [re.sub(r"^\W+|\W+$", "", x).lower() for x in text.split()]
    w = [x for x in w if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_benchmark_against_plain(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(i.item_id, i.text) for i in bench.collect()]
    got = {r.doc_id: (r.items, r.greatest_share, r.n_changed) for r in decontamination.find_contaminated(docs, bench).collect()}
    hit = 0
    for r in docs.collect():
        want = brute.contaminating(r.text, items)
        assert got[r.doc_id] == (",".join(str(w[0]) for w in want), pytest.approx(max((w[1] for w in want), default=0.0)), sum(w[2] for w in want))
        hit += bool(want)
    assert hit


def test_raking(spark, docs):
    goal = {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}
    told = mixing.described(docs)
    cells = [r.asDict() for r in mixing.raked_cells(Work(spark, "t"), told, goal, 0.5).collect()]
    tokens = {(c["source"], c["lang"], c["topic"]): c["tokens"] for c in cells}
    weight = {k: v / sum(tokens.values()) for k, v in tokens.items()}
    targets = []
    for i, d in enumerate(mixing.DIMENSIONS):
        total = {}
        for k, v in tokens.items():
            total[k[i]] = total.get(k[i], 0) + v
        raw = goal.get(d) or {k: v**0.5 for k, v in total.items()}
        targets.append({k: v / sum(raw.values()) for k, v in raw.items()})
    for _ in range(mixing.STEPS * mixing.ROUNDS):
        for i, goal_ in enumerate(targets):
            now = {}
            for k, v in weight.items():
                now[k[i]] = now.get(k[i], 0) + v
            weight = {k: v * goal_[k[i]] / now[k[i]] for k, v in weight.items()}
    for c in cells:
        assert c["weight"] == pytest.approx(weight[c["source"], c["lang"], c["topic"]], abs=1e-4)
    assert sum(c["probability"] * c["tokens"] for c in cells) == pytest.approx(0.5 * sum(tokens.values()), rel=1e-3)
    assert all(0 < c["probability"] <= 1 and c["gap"] < mixing.CLOSE for c in cells)


def test_sampling_keeps_columns(spark, docs, odd):
    out = mixing.sampled_rows(spark, odd)
    assert out.columns == odd.columns and 0 < out.count() <= len(ODD)
    assert mixing.sampled_rows(spark, odd.limit(0)).count() == 0
    once = {r.doc_id for r in mixing.sampled_rows(spark, docs).collect()}
    assert once == {r.doc_id for r in mixing.sampled_rows(spark, docs.repartition(7)).collect()}


def test_pipeline(spark, docs):
    rows = {r.doc_id: r for r in docs.collect()}
    work, now = Work(spark, "t"), docs
    left = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, now = now, work.save(stage(spark, now, SF), f"s{i}")
        left.append({r.doc_id for r in now.collect()})
        if i < 4:
            assert now.columns == docs.columns
            assert all(r.text == rows[r.doc_id].text for r in now.collect())
    assert left[0] == {d for d, r in rows.items() if not brute.quality(r.text)[-1]}
    groups = brute.jaccard([(d, rows[d].text) for d in left[0]])
    assert left[1] == {d for d, (_, c) in groups.items() if d == c}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert left[2] <= left[1] and not any(i in rows[d].text for d in left[2] for i in items)
    assert left[3] <= left[2] and left[4] == left[3]
    got = {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {tuple(r) for r in now.collect()}
    assert sum(r.n_tokens for r in now.collect()) == max(r.start + r.n_tokens for r in now.collect())


def test_pipeline_stages_take_odd_rows(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert out.count() <= len(ODD) and stage(spark, odd.limit(0), SF).count() == 0


def test_context_numbers_without_hashing(monkeypatch):
    import numpy as np

    for high, low in ((np.array([3, 1, 3, 1, 2]), [5, 9, 5, 8, 0]), (np.array([2**32 - 1, 7, 2**32 - 1, 7]), [2**32 - 1, 1, 2**32 - 1, 0]), (np.zeros(0, np.int64), [])):
        low = np.array(low, np.uint32)
        want = np.unique(high.astype(np.uint64) << np.uint64(32) | low, return_inverse=True)
        assert all((a == b).all() for a, b in zip(suffix_tree_lm._in_order(high, low), want, strict=True))
    # A chunk's contexts are numbered by sorting alone: hashing every position was most of the operator's time.
    body = b"a b a c a b d a b a"
    t = suffix_tree_lm._Tokens(suffix_tree_lm.pack_tokens(np.array([1, 3]), np.array([11, 8]), body))
    monkeypatch.setattr(suffix_tree_lm.C, "numbered", None)
    seen = np.full(len(t.words), 9)
    words = {b: suffix_tree_lm.C.pack_arrays(seen[lo:hi]) for b, (lo, hi) in enumerate(zip(*(lambda c: (c[:-1], c[1:]))(suffix_tree_lm.C.bucket_bounds(t.words, 8, 64)), strict=True))}
    grams = suffix_tree_lm._Model(t, {"word": words}, (40, 4), 8, 8, [], 3, 100).grams
    assert (np.diff(grams.contexts.astype(object)) > 0).all() and (grams.contexts[grams.of] == t.words[t.token[grams.at - 1]]).all()
    assert (t.token[grams.at] == grams.grams[grams.inverse] & np.uint64(0xFFFFFFFF)).all()
