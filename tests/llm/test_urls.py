"""URL verdicts against plain versions of the rules, the models and the cutoff."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillmesh.llm import url_filter
from quillmesh.llm.work import Work

URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://a.www.example.com/en/", "http://example.com/en", "http://example.com/en/", "http://wwwexample.com/en/", "ftp://net/es/", "x://b.net?es/",
    "x://b.net/fr/#/", "http://com", "http://com/", "http://.com/", "http://a..net/es/", "//a.net/es/", "a://b://c.com/", "http://user@x.com:80/", "http://x.com:80/", "http://ИМЯ.com/é", "http://x\ny.net/es/", "http://" + "a." * 50_000 + "net/fr/" + "z" * 90_000,
]


def plain_rule(url, rules=url_filter.RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, default=(0, 0, None, None))[2:])


class Plain:
    """Witten-Bell smoothing with dictionaries, over whole lists of URLs."""

    def __init__(self, good, bad):
        self.counts = [Counter(g for u in urls for g in self.grams(u)) for urls in (good, bad)]
        both = self.counts[0] + self.counts[1]
        self.counts = [{g: n for g, n in c.items() if len(g) < url_filter.RARE_FROM or both[g] > 1} for c in self.counts]
        self.after = [{}, {}]
        for c, after in zip(self.counts, self.after, strict=True):
            for g, n in c.items():
                after.setdefault(g[:-1], []).append(n)

    def grams(self, url):
        raw = b"\x02" + url.encode() + b"\x03"
        return [raw[i - o : i + 1] for i in range(1, len(raw)) for o in range(url_filter.ORDER + 1) if o <= i]

    def score(self, url):
        raw, total = b"\x02" + (url or "").encode() + b"\x03", 0
        for i in range(1, len(raw)):
            for sign, c, after in zip((1, -1), self.counts, self.after, strict=True):
                p = 1 / 256
                for o in range(min(i, url_filter.ORDER) + 1):
                    seen = after.get(raw[i - o : i])
                    if seen:
                        p = (c.get(raw[i - o : i + 1], 0) + len(seen) * p) / (sum(seen) + len(seen))
                total += sign * math.log2(p)
        return total / (len(raw) - 1)


def frame(spark, urls):
    return spark.createDataFrame([(i or None, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")


def test_rules(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for rows in (frame(spark, URLS), pages):
        want = sorted((r.page_id or 0, *(x or "" for x in plain_rule(r.url))) for r in rows.collect())
        got = url_filter.judged_by_rules(rows, url_filter.RULES).collect()
        assert sorted((r.page_id or 0, r.host, r.path, r.rule or "", r.verdict or "") for r in got) == want


def test_rules_of_equal_length_block():
    rules = url_filter.Rules([("allow", "a.b", "/c"), ("block", "b", "/cde"), ("allow", "b", "/x"), ("block", "b", "/x")])
    assert rules.judge("a.b", "/cdef") == ("b/cde", "block") and rules.judge("a.b", "/x") == ("b/x", "block") and rules.judge("c", "/") == (None, None)


def test_model_against_plain(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    judged = url_filter.judged_by_rules(pages, url_filter.RULES)
    found = url_filter.fit(Work(spark, "test"), judged)
    labelled = judged.filter("verdict is not null").selectExpr("url", "verdict", f"pmod(xxhash64(url, 'holdout'), {url_filter.HOLDOUT}) = 0 as held").collect()
    model = Plain(*([r.url for r in labelled if r.verdict == v and not r.held] for v in ("allow", "block")))
    asked = [*(r.url for r in pages.collect()), *URLS[:-1]]
    assert np.allclose(url_filter.scores_of(found.model, pa.array(asked)), [model.score(u) for u in asked], atol=1e-8)
    held = [(model.score(r.url), r.verdict == "allow") for r in labelled if r.held]
    lost = lambda c: sum(s < c for s, ok in held if ok) / sum(ok for _, ok in held) + sum(s >= c for s, ok in held if not ok) / sum(not ok for _, ok in held)
    assert lost(found.cutoff) <= min(lost(s) for s, _ in held) + 1e-9


def test_held_out_accuracy(spark):
    """Labels that the address does not give away as a whole: numbers differ, words of the path tell."""
    rng = np.random.default_rng(4)
    word = lambda kinds: kinds[rng.integers(len(kinds))]
    good, bad = ["news", "science", "history"], ["casino", "pills", "win-cash"]
    rows = [(i, f"http://site{rng.integers(99)}.{tld}/{word(good if i % 2 else bad)}/{rng.integers(10**6)}", i % 2) for i in range(600) for tld in ("org",)]
    rules = [("allow" if i % 2 else "block", re.match("http://([^/]*)", u)[1], u.split("/", 3)[3] and "/" + u.split("/", 3)[3]) for i, u, _ in rows[:400]]
    out = url_filter.filter_urls(spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string"), rules).collect()
    new = [r for r in out if r.page_id >= 400 and r.rule is None]
    assert len(new) > 190 and sum((r.verdict == "allow") == bool(r.page_id % 2) for r in new) >= 0.97 * len(new)


def test_odd_rows(spark):
    out = url_filter.filter_urls(frame(spark, URLS + URLS)).collect()
    assert len(out) == 2 * len(URLS) and all(r.verdict in ("allow", "block") for r in out)
    assert {(r.host, r.path, r.rule, r.verdict) for r in out if r.rule} == {p for p in map(plain_rule, URLS) if p[2]}


@pytest.mark.parametrize(("urls", "verdict"), [(["x://a.org/"], "allow"), (["x://a.org/", "x://a.net/es/"], "block"), (["x://a.org/", "x://a.com/"], "allow"), ([], None)])
def test_labels_missing(spark, urls, verdict):
    out = url_filter.filter_urls(frame(spark, urls)).collect()
    assert len(out) == len(urls) and all(r.verdict == verdict and r.score is None for r in out if r.rule is None)


def test_cutoff():
    assert url_filter.cutoff_of(np.array([3.0, 4.0]), np.array([1.0, 2.0])) == 2.5
    assert url_filter.cutoff_of(np.array([]), np.array([1.0])) == math.inf and url_filter.cutoff_of(np.array([1.0]), np.array([])) == -math.inf
