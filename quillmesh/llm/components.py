"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.work import Work

#: Edges that one task contracts at once.
LOCAL_EDGES = 1_000_000


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's edges as (node, least node that they connect it with)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = list(parent)
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        out = pd.DataFrame({"a": part, "b": [find(x) for x in part]}, dtype="int64")
        yield out[out.a != out.b]


def connected_components(work: Work, edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the least node reachable.

    Each task first contracts at most ``LOCAL_EDGES`` edges into a forest.  With several tasks, rounds of large-star and
    small-star joins follow until nothing changes.  Every round's edges are a table in the shared folder.
    """
    edges = work.save(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges")
    tasks = max(1, -(-edges.count() // LOCAL_EDGES))
    now = work.save(edges.repartition(tasks).mapInPandas(_forest, "a long, b long"), f"{name}-0")
    step = 0
    while tasks > 1:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the least neighbour of a node is aggregated and joined back, so a node with many edges is not one task's
        low = work.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-low", "uncompressed")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = work.save(large, f"{name}-large", "uncompressed")
        least = work.save(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least", "uncompressed")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        step += 1
        after = work.save(small, f"{name}-{step}")
        work.drop(f"{name}-low", f"{name}-large", f"{name}-least")
        shape = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        same = tuple(shape(after)) == tuple(shape(now))
        work.drop(f"{name}-{step - 1}")
        now = after
        if same:
            break
    work.drop(f"{name}-edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
