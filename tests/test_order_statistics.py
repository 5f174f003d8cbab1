"""Order statistics by ranges of values against plain Python, whatever the number of ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import weights as W


def rows(seed=1, n=400):
    rng = random.Random(seed)
    out = [(rng.choice(["a", "a", "a", "b"]), rng.choice([rng.gauss(0, 1), float(rng.randint(-3, 3)), 1e6 * rng.random()]), float(rng.randint(0, 5)), i) for i in range(n)]
    return out + [("one", 2.5, 1.0, n), ("two", 1.0, 2.0, n + 1), ("two", 4.0, 2.0, n + 2), (None, 7.0, 1.0, n + 3), (None, 9.0, 3.0, n + 4)]


@pytest.mark.parametrize("blocks", [1, 3, 64])
def test_quantiles_distances_percentiles(spark, blocks):
    data = rows()
    df = spark.createDataFrame(data, "g string, v double, w double, i int")
    by = {g: [(v, w) for k, v, w, _ in data if k == g] for g in {r[0] for r in data}}
    got = {r.g: r.q for r in W.weighted_quantile(df, ["g"], "v", 0.9, "q", blocks).collect()}
    for g, pairs in by.items():
        total, cum = sum(w for _, w in pairs), 0.0
        for v in sorted({v for v, _ in pairs}):
            cum += sum(w for x, w in pairs if x == v)
            if cum >= 0.9 * total - 1e-12:
                break
        assert got[g] == v, g
    got = {r.g: r.distance for r in W.pairwise_distance(df, ["g"], "v", 1e6, blocks).collect()}
    for g, pairs in by.items():
        x, w = np.array(pairs).T
        top = np.triu(np.outer(w, w) * np.abs(x[:, None] - x[None]), 1).sum()
        bottom = np.triu(np.outer(w, w), 1).sum()
        assert got[g] == pytest.approx(min(1, top / bottom / 1e6) if len(pairs) > 1 else 0, abs=1e-9)
    got = {(r.g, r.label): r.v for r in W.percentiles(df, ["g"], "v", [0.0, 0.1, 0.5, 0.9, 1.0], blocks).collect()}
    for g, pairs in by.items():
        want = np.percentile([v for v, _ in pairs], [0, 10, 50, 90, 100])
        assert [got[g, k] for k in range(5)] == pytest.approx(list(want), rel=1e-12)


def test_no_window_holds_a_group(spark):
    df = spark.range(100_000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"), F.lit(1.0).alias("w"))
    sizes = W.in_blocks(df, ["g"], 64).groupBy("block").count().collect()
    assert len(sizes) == 64 and max(r["count"] for r in sizes) < 2 * 100_000 / 64


@pytest.mark.parametrize("n", [1, 2, 7, 64, 300])
def test_counted_before(spark, n):
    rng = random.Random(n)
    data = [(g, i, None if rng.random() < 0.1 else float(rng.randint(0, 20))) for g in ("x", "y") for i in range(n)]
    got = W.counted_before(spark.createDataFrame(data, "g string, day int, v double"), ["g"], "day", "v", "n").collect()
    want = {(g, i): 0 if v is None else sum(h == g and j < i and u is not None and u <= v for h, j, u in data) for g, i, v in data}
    assert {(r.g, r.day): r.n for r in got} == want
