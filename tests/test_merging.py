"""Components and greedy merging against plain versions, in one task and in ranges of time."""

import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import merging
from quillmesh.operators import relations as R
from quillmesh.sources.scratch import Scratch


def plain(nodes, edges, hours):
    at, cluster = dict(nodes), {k: [k] for k, _ in nodes}
    order = []
    for a, b, turn in edges:
        x, y = sorted([(at[a], a), (at[b], b)])
        order.append((turn, *x, *y))
    for _, _, a, _, b in sorted(order):
        one, two = cluster[a], cluster[b]
        if one is not two:
            times = [at[k] for k in one + two]
            if max(times) - min(times) <= hours * 3600:
                one += two
                for k in two:
                    cluster[k] = one
    return {k: min(v) for k, v in cluster.items()}


def made(seed, n=300, stars=True):
    rng = random.Random(seed)
    nodes = [(i, float(rng.randrange(0, 60) * 3600 * 5)) for i in range(n)]
    edges = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(4 * n)) if a != b and abs(nodes[a][1] - nodes[b][1]) <= 48 * 3600}
    rows = [(a, b, 1) for a, b in edges]
    if stars:
        ids = rng.sample(range(n), 60)
        for k in range(0, 60, 4):
            group = sorted(ids[k : k + 4])
            rows += [(group[0], x, 0) for x in group[1:]]
    return nodes, rows


@pytest.mark.parametrize(("seed", "stars", "most"), [(2, True, 10**6), (3, False, 100), (5, True, 200)])
def test_clusters_against_plain(spark, monkeypatch, seed, stars, most):
    monkeypatch.setattr(merging, "MOST_EDGES", most)
    nodes, edges = made(seed, stars=stars)
    n, e = spark.createDataFrame(nodes, "id long, at double"), spark.createDataFrame(edges, "a long, b long, turn int")
    scratch = Scratch(spark, "test")
    got = R.constrained_clusters(e, n, merging.components(scratch, e), 72, scratch)
    assert {r.id: r.cluster for r in got.collect()} == plain(nodes, edges, 72)
    scratch.drop()


def test_components_of_chains_stars_and_strings(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(1000)] + [(5000, 6000 + i) for i in range(500)] + [(9000, 9000)] + [(a, b) for a, b in ((rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(300)) if a != b]
    rng.shuffle(edges)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted([find(a), find(b)])
            parent[y] = x
    scratch = Scratch(spark, "test")
    got = {r.id: r.component for r in merging.components(scratch, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    named = merging.components(Scratch(spark, "test"), spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string"))
    assert sorted(map(tuple, named.collect())) == [("a", "a"), ("b", "a"), ("c", "a")]
    assert merging.components(Scratch(spark, "test"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_grow_slowly_and_tasks_stay_bounded_on_a_long_chain(spark, monkeypatch):
    """A long chain of edges: few rounds, and no range of it has more than 1.3 times its share."""
    saved = []
    real = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: (saved.append(name), real(self, df, name))[1])
    n = 200_000
    nodes = spark.range(n + 1).select("id", (F.col("id") * 60.0).alias("at"))
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    scratch = Scratch(spark, "test")
    found = merging.components(scratch, edges)
    assert sum(x.startswith("star") for x in saved) <= 30
    monkeypatch.setattr(merging, "MOST_EDGES", 60_000)
    out = R.constrained_clusters(edges, nodes, found, 72, scratch)
    # 72 hours hold 4,321 articles of a minute each
    wrong = out.where(F.col("cluster") != F.floor(F.col("id") / 4321) * 4321).count()
    assert wrong == 0 and sum(x.startswith("state") for x in saved) == 5
    scratch.drop()
