"""URL verdicts by rules and, where no rule fits, by the ratio of two character language models.

URLs that rules allow or block are the labelled rows.  Two variable-order Markov models over their bytes are counted by
Spark, one per label: the next byte given the last 0 to ``ORDER`` bytes, each order smoothed by the one below after Witten
and Bell (a context gives its lower order as much weight as it has distinct next bytes), the lowest by equal shares of 256.
A URL's score is the difference of its log2 probabilities under both models, divided by its bytes and the end mark.  The
cutoff is calibrated on labelled URLs that the models have not seen: the one with the least sum of the share of accepted
URLs below it and of rejected URLs not below it, in the middle of the widest gap between scores that reaches this.

Bounds of the fit, chosen by hash among distinct URLs: ``FIT_URLS`` per label to count and as many to calibrate, each of at
most ``FIT_BYTES`` bytes (longer ones are only judged), ``GRAMS`` byte strings in the models, the most frequent ones.  Every URL is
judged, whole.

Defined cases: a null URL and one without "://" have empty host and path and no rule; the models judge the whole URL, null
as the empty text; with labelled URLs of one label only, its verdict is given to all others, and with none all are allowed;
rules of equal length that fit are decided for block; null page_ids and repeated rows are judged each for itself; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.caches import tidy
from quillmesh.llm.chunks import texts_of
from quillmesh.llm.work import Work

#: (verdict, host, path): the rules of the query.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Rules are sent to every task; more than this are refused.
MOST_RULES = 1_000_000
#: Bytes of context at most; with the next byte and the length they fit in 64 bits.
ORDER = 5
FIT_URLS, FIT_BYTES, GRAMS = 20_000, 2_048, 1_000_000
#: Strings of this many bytes or more count only where they occur twice.
RARE_FROM = 4
#: Every fifth labelled URL, by hash, calibrates the cutoff.
HOLDOUT = 5
START, END = 2, 3


class Rules:
    """Longest rule that fits a host or one of the domains above it, and the path's beginning."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        if len(rules) > MOST_RULES:
            raise ValueError(f"at most {MOST_RULES} rules")
        self.by_host: dict[str, dict[str, str]] = {}
        for verdict, host, path in rules:
            paths = self.by_host.setdefault(host, {})
            paths[path] = "block" if "block" in (verdict, paths.get(path)) else "allow"
        self.lengths = {host: sorted({len(p) for p in paths}, reverse=True) for host, paths in self.by_host.items()}
        self.longest = max(map(len, self.by_host), default=0)

    def judge(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict), or (None, None)."""
        best, dot = (-1, False, None, None), len(host) - self.longest - 1
        at = 0 if dot < 0 else host.find(".", dot) + 1
        while at or dot < 0:
            own = host[at:]
            for n in self.lengths.get(own, ()):
                verdict = self.by_host[own].get(path[:n]) if len(path) >= n else None
                if verdict:
                    best = max(best, (len(own) + n, verdict == "block", own + path[:n], verdict), key=lambda b: b[:2])
                    break
            dot = host.find(".", at)
            at = dot + 1
            if not at:
                break
        return best[2:]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def judged_by_rules(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rows (page_id, url, host, path, rule, verdict); the last two are null where no rule fits."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    known = Rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [known.judge(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"page_id {kind}, url string, host string, path string, rule string, verdict string")


def grams_of(body: bytes, lengths: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the keys of all byte strings that end at each byte or end mark, and each byte's text.

    A key holds the string's bytes and, above them, its length; strings begin at the start mark at most.
    """
    lengths = np.maximum(lengths, 0)
    ends = np.cumsum(lengths)
    n, texts = len(body), len(lengths)
    raw = np.full(n + 2 * texts, END, np.uint64)
    first = ends - lengths + 2 * np.arange(texts)
    raw[first] = START
    text = np.repeat(np.arange(texts), lengths + 2)
    inside = np.ones(len(raw), bool)
    inside[first] = inside[first + lengths + 1] = False
    raw[inside] = np.frombuffer(body, np.uint8)
    place = np.arange(len(raw)) - np.repeat(first, lengths + 2)
    keys, last = [], raw.copy()
    for order in range(ORDER + 1):
        if order:
            shifted = np.zeros_like(raw)
            shifted[order:] = raw[: len(raw) - order]
            last = last | shifted << np.uint64(8 * order)
        length = np.uint64(order + 1) << np.uint64(56)
        keys.append(np.where(place >= max(order, 1), last | length, np.uint64(0)))
    scored = place > 0
    return [k[scored] for k in keys], text[scored]


class Model(NamedTuple):
    """Sorted keys of strings with their counts by label, and sorted keys of contexts with counts and distinct next bytes."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray


def model_of(grams: np.ndarray, counts: np.ndarray) -> Model:
    """Contexts from strings: a context has the counts of the strings that are one byte longer."""
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order]
    length = grams >> np.uint64(56)
    context = (length - np.uint64(1)) << np.uint64(56) | (grams & np.uint64((1 << 56) - 1)) >> np.uint64(8)
    contexts, place = np.unique(context, return_inverse=True)
    totals, kinds = np.zeros((len(contexts), 2)), np.zeros((len(contexts), 2))
    np.add.at(totals, place, counts)
    np.add.at(kinds, place, counts > 0)
    return Model(grams, counts, contexts, totals, kinds)


def pieces(column: pa.Array, size: int = 4 << 20) -> Iterator[tuple[slice, bytes, np.ndarray]]:
    """Rows of a string column with their bytes and lengths, so many that the bytes are about ``size`` at most."""
    lengths, body = texts_of(column)
    lengths = np.maximum(lengths, 0)
    ends, lo = np.cumsum(lengths), 0
    while lo < len(lengths):
        base = int(ends[lo] - lengths[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + size, "right")))
        yield slice(lo, hi), body[base : int(ends[hi - 1])], lengths[lo:hi]
        lo = hi


def _find(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros((len(asked), 2))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return values[at] * (keys[at] == asked)[:, None]


def scores_of(model: Model, urls: pa.Array) -> np.ndarray:
    """Log2 ratio of accepted to rejected per byte and end mark, for each URL."""
    return np.concatenate([np.zeros(0), *(_scores(model, body, lengths) for _, body, lengths in pieces(urls))])


def _scores(model: Model, body: bytes, lengths: np.ndarray) -> np.ndarray:
    keys, text = grams_of(body, lengths)
    p = np.full((len(text), 2), 1 / 256)
    for order, key in enumerate(keys):
        context = np.uint64(order) << np.uint64(56) | (key & np.uint64((1 << 56) - 1)) >> np.uint64(8)
        count, total, kinds = _find(model.grams, model.counts, key), _find(model.contexts, model.totals, context), _find(model.contexts, model.kinds, context)
        known = (total > 0) & (key > 0)[:, None]
        p = np.where(known, (count + kinds * p) / np.where(known, total + kinds, 1), p)
    logs = np.log2(p)
    n = np.bincount(text, minlength=len(lengths))
    return np.round((np.bincount(text, logs[:, 0], len(lengths)) - np.bincount(text, logs[:, 1], len(lengths))) / np.maximum(n, 1), 9)


def cutoff_of(accepted: np.ndarray, rejected: np.ndarray) -> float:
    """Scores not below this are accepted."""
    if not len(accepted) or not len(rejected):
        return np.inf if len(rejected) else -np.inf
    every = np.unique(np.concatenate([accepted, rejected]))
    lost = np.searchsorted(np.sort(accepted), every) / len(accepted) + 1 - np.searchsorted(np.sort(rejected), every) / len(rejected)
    edges = np.concatenate([every, [every[-1] + 2e-9]])
    lost = np.append(lost, 1.0)
    below = np.concatenate([[every[0] - 2e-9], every])
    good = np.flatnonzero(lost <= lost.min() + 1e-12)
    widest = good[np.argmax(edges[good] - below[good])]
    return float((edges[widest] + below[widest]) / 2)


class Filter(NamedTuple):
    """A model with its cutoff, or a fixed ``verdict`` where one label has no URLs."""

    model: Model | None
    cutoff: float
    verdict: str | None


def _chosen(labelled: DataFrame, held_out: bool, urls: int) -> DataFrame:
    """At most ``urls`` distinct URLs (url, accepted) of each label, those of least hash."""
    part = (F.pmod(F.xxhash64("url", F.lit("holdout")), F.lit(HOLDOUT)) == 0) == F.lit(held_out)
    rows = labelled.filter(part).select("url", (F.col("verdict") == "allow").alias("accepted"), F.pmod(F.xxhash64("url"), F.lit(1 << 40)).alias("place"))
    there = dict(rows.groupBy("accepted").count().collect())
    chosen = []
    for label in (True, False):
        few = (1 << 40) * 2 * urls // max(there.get(label, 0), 2 * urls, 1)
        chosen.append(rows.filter((F.col("accepted") == label) & (F.col("place") < few)).orderBy("place", "url").limit(urls))
    return chosen[0].unionByName(chosen[1]).select("url", "accepted")


def fit(work: Work, judged: DataFrame, urls: int = FIT_URLS) -> Filter:
    """Fit models and cutoff to the rows (url, verdict) whose verdict is not null."""
    usable = F.col("verdict").isNotNull() & F.col("url").isNotNull() & (F.octet_length("url") <= FIT_BYTES)
    labelled = work.save(judged.filter(usable).select("url", "verdict").distinct(), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            accepted = batch.column(1).to_numpy(zero_copy_only=False)
            for rows, body, lengths in pieces(batch.column(0)):
                keys, text = grams_of(body, lengths)
                for key in keys:
                    for label in (True, False):
                        found, n = np.unique(key[(key > 0) & (accepted[rows][text] == label)], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n * label, pa.int64()), pa.array(n * (not label), pa.int64())], names=["gram", "good", "bad"])

    grams = _chosen(labelled, False, urls).mapInArrow(tidy(count), "gram long, good long, bad long").groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    often = (F.shiftright("gram", 56) < RARE_FROM) | (F.col("good") + F.col("bad") > 1)
    table = grams.filter(often).orderBy((F.col("good") + F.col("bad")).desc(), "gram").limit(GRAMS).toArrow()
    counts = np.stack([table.column(c).to_numpy().astype(float) for c in ("good", "bad")], 1)
    labels = counts.sum(0) > 0
    if not labels.all():
        work.drop("labelled")
        return Filter(None, 0.0, "block" if labels[1] else "allow")
    model = model_of(table.column("gram").to_numpy().view(np.uint64), counts)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(scores_of(model, batch.column(0)), pa.float64())], names=["accepted", "score"])

    held = _chosen(labelled, True, urls).mapInArrow(tidy(score), "accepted boolean, score double").toArrow()
    work.drop("labelled")
    accepted, scores = held.column("accepted").to_numpy().astype(bool), held.column("score").to_numpy()
    return Filter(model, cutoff_of(scores[accepted], scores[~accepted]), None)


def apply_filter(judged: DataFrame, found: Filter) -> DataFrame:
    """Verdicts for the rows without one, and every URL's score (null where there is no model)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("verdict").to_pylist()
            if found.model is None:
                verdicts, scores = [v or found.verdict for v in own], pa.nulls(len(own), pa.float64())
            else:
                score = scores_of(found.model, batch.column("url"))
                verdicts, scores = [v or ("allow" if s >= found.cutoff else "block") for v, s in zip(own, score.tolist(), strict=True)], pa.array(score)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), scores], names=["page_id", "host", "path", "rule", "verdict", "score"])

    kind = judged.schema["page_id"].dataType.simpleString()
    return judged.mapInArrow(tidy(run), f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, score) for rows (page_id, url)."""
    judged = judged_by_rules(pages, rules)
    return apply_filter(judged, fit(Work(pages.sparkSession, "urls"), judged))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
