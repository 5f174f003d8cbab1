"""Greedy merging of similar pairs into clusters that span a limited time.

Components of the pairs come from star contraction, whose rounds grow with the logarithm of the longest chain.  Edges are
then merged in the order of time, component by component: a task reads its edges as a sorted stream and holds one component's
open clusters at a time.  Where kinds of articles tell what is similar, the articles themselves are the stream (``by_kinds``).  A component of more than ``MOST_EDGES`` edges is cut into ranges of time; what a range hands on
is the clusters that still have an article at or after its border, as no edge of a later range touches any other.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.sources.scratch import Scratch

#: Edges of one component that one task merges at most.
MOST_EDGES = 500_000


#: Ids that a task holds at most while it thins edges.
MOST_IDS = 1_000_000


def forest(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Edges (a, b) that connect what ``edges`` connect: each task leaves out those whose ends it has connected already.

    A task that holds more than ``most`` ids begins anew, so it keeps more edges than it must, never fewer.
    """
    limit = most or MOST_IDS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict = {}

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for f in frames:
            kept = []
            for a, b in zip(f["a"].tolist(), f["b"].tolist(), strict=True):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                x, y = find(a), find(b)
                if x != y:
                    parent[y] = x
                    kept.append((a, b))
            if len(parent) > limit:
                parent.clear()
            yield pd.DataFrame(kept, columns=["a", "b"]).astype(dict(f.dtypes))

    rows = edges.select("a", "b")
    return rows.mapInPandas(run, rows.schema)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, component) of the ends of edges (a, b); a component is named by its least id."""
    now = forest(edges.where("a <> b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before, turn = scratch.save(now, "star-0"), None, 0
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        before, turn = state, turn + 1
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower)
        now = scratch.save(small.distinct(), f"star-{turn}")
        scratch.drop(f"star-{turn - 1}")


class Clusters:
    """Clusters by union-find, named by their least id, with the times of their first and last article."""

    def __init__(self, limit: float):
        self.limit, self.parent, self.low, self.high = limit, {}, {}, {}

    def find(self, x):
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def add(self, x, low: float, high: float, root=None) -> None:
        """A node, or one of a cluster handed on."""
        root = x if root is None else root
        if root not in self.parent:
            self.parent[root], self.low[root], self.high[root] = root, low, high
        if x not in self.parent:
            self.parent[x] = root

    def merge(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            low, high = min(self.low[a], self.low[b]), max(self.high[a], self.high[b])
            if high - low <= self.limit:
                keep, gone = (a, b) if a < b else (b, a)
                self.parent[gone], self.low[keep], self.high[keep] = keep, low, high


def merged(rows: DataFrame, limit: float, kind: str) -> DataFrame:
    """(component, id, cluster, low, high) of the ends of edges, merged in the order of (component, turn, time, ids).

    Rows (component, turn, a, at_a, b, at_b); a row of turn -1 hands on that node ``a`` is in cluster ``b``, which spans
    from ``at_a`` to ``at_b``.
    """
    key = dict(rows.dtypes)["component"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, now = None, None

        def done() -> pd.DataFrame:
            ids = list(own.parent)
            roots = [own.find(x) for x in ids]
            return pd.DataFrame({"component": [now] * len(ids), "id": ids, "cluster": roots, "low": [own.low[r] for r in roots], "high": [own.high[r] for r in roots]})

        held: list[pd.DataFrame] = []
        for f in frames:
            for c, turn, a, ta, b, tb in zip(*(f[k].tolist() for k in ("component", "turn", "a", "at_a", "b", "at_b")), strict=True):
                if own is None or c != now:
                    if own is not None:
                        held.append(done())
                    own, now = Clusters(limit), c
                if turn < 0:
                    own.add(a, ta, tb, b)
                else:
                    own.add(a, ta, ta)
                    own.add(b, tb, tb)
                    own.merge(a, b)
            if len(held) > 500:
                yield pd.concat(held)
                held = []
        if own is not None:
            held.append(done())
            yield pd.concat(held)

    sorted_ = rows.repartition("component").sortWithinPartitions("component", "turn", "at_a", "a", "at_b", "b")
    return sorted_.select("component", "turn", "a", "at_a", "b", "at_b").mapInPandas(run, f"component {key}, id {kind}, cluster {kind}, low double, high double")


class _Cluster:
    """A cluster with its articles; ``done``: the last article of each kind that has met all others near it."""

    __slots__ = ("low", "high", "name", "ids", "done")

    def __init__(self, name, at: float):
        self.low, self.high, self.name, self.ids, self.done = at, at, name, [name], {}


class Stream:
    """Greedy merging of articles that come in the order (at, id), where kinds tell which of them are similar.

    An article meets the later ones within ``window`` in their order, once all of them have come.  Two clusters that were
    refused a union are refused it for ever, as spans only grow.  So an article whose kind has met others from its cluster
    meets only what lay out of their reach, and no cluster is offered what lies more than ``limit`` after its beginning.
    Clusters that end before the first article that still has to meet others are given out and forgotten.
    """

    def __init__(self, window: float, limit: float, links: dict):
        self.window, self.limit, self.links = window, limit, links
        self.of: dict = {}
        self.queue: deque = deque()
        self.kinds: dict = {}
        self.head: dict = {}
        self.out: list[tuple] = []
        self.wait = self.left = 0

    def add(self, at: float, x, kind) -> None:
        while self.queue and at - self.queue[0][0] > self.window:
            self.meet()
        self.of[x] = _Cluster(x, at)
        self.queue.append((at, x, kind))
        self.kinds.setdefault(kind, []).append((at, x))

    def meet(self) -> None:
        at, x, kind = self.queue.popleft()
        own = self.of[x]
        before, met = own.done.get(kind), []
        for other in self.links.get(kind, ()):
            rows = self.kinds.get(other)
            if not rows:
                continue
            i = bisect_right(rows, (at, x), self.head.get(other, 0))
            if before is not None:
                i = max(i, bisect_right(rows, before + self.window, i, key=lambda r: r[0]))
                while i < len(rows) and rows[i][0] - before <= self.window:
                    i += 1
            while i < len(rows) and rows[i][0] - at <= self.window and rows[i][0] - own.low <= self.limit:
                met.append(rows[i])
                i += 1
        for _, y in sorted(met):
            own = self.merge(own, self.of[y])
        own.done[kind] = at
        rows, head = self.kinds[kind], self.head.get(kind, 0) + 1
        if 2 * head > len(rows):
            del rows[:head]
            head = 0
            if not rows:
                del self.kinds[kind]
        self.head[kind] = head
        self.wait += 1
        if self.wait > 1000 + self.left:
            self.close(self.queue[0][0] if self.queue else at)

    def merge(self, own: _Cluster, other: _Cluster) -> _Cluster:
        """The cluster of ``own`` after its union with the other, if it is allowed."""
        if own is other or max(own.high, other.high) - min(own.low, other.low) > self.limit:
            return own
        keep, gone = (own, other) if len(own.ids) >= len(other.ids) else (other, own)
        keep.low, keep.high, keep.name = min(own.low, other.low), max(own.high, other.high), min(own.name, other.name)
        keep.ids += gone.ids
        for x in gone.ids:
            self.of[x] = keep
        for kind, at in gone.done.items():
            keep.done[kind] = max(at, keep.done.get(kind, at))
        return keep

    def close(self, before: float | None = None) -> None:
        """Give out the clusters that end earlier, without a time all of them."""
        self.wait, gone = 0, {id(c): c for c in self.of.values() if before is None or c.high < before}
        for c in gone.values():
            self.out += ((x, c.name) for x in c.ids)
            for x in c.ids:
                del self.of[x]
        self.left = len(self.of)

    def end(self) -> None:
        while self.queue:
            self.meet()
        self.close()


def by_kinds(articles: DataFrame, links: DataFrame, hours: float, span_hours: float) -> DataFrame:
    """(id, cluster) of articles (component, kind, at, id), all those of linked kinds (component, kind, other) being similar
    that lie within ``hours``; ``links`` has both directions.  A task holds the links of a component and the articles of
    some spans of time."""
    kind = dict(articles.dtypes)["id"]
    rows = links.select("component", F.lit(0).alias("turn"), F.lit(0.0).alias("at"), F.col("other").alias("id"), "kind").union(articles.select("component", F.lit(1), "at", "id", "kind"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, now, held = None, None, []
        for f in frames:
            for c, turn, at, x, k in zip(*(f[n].tolist() for n in ("component", "turn", "at", "id", "kind")), strict=True):
                if own is None or c != now:
                    if own is not None:
                        own.end()
                        held += own.out
                    own, now = Stream(hours * 3600.0, span_hours * 3600.0, {}), c
                if turn:
                    own.add(at, x, k)
                else:
                    own.links.setdefault(k, []).append(x)
            yield pd.DataFrame(held + own.out if own else held, columns=["id", "cluster"])
            held = []
            if own is not None:
                own.out = []
        if own is not None:
            own.end()
            yield pd.DataFrame(own.out, columns=["id", "cluster"])

    sorted_ = rows.repartition("component").sortWithinPartitions("component", "turn", "at", "id")
    return sorted_.select("component", "turn", "at", "id", "kind").mapInPandas(run, f"id {kind}, cluster {kind}")


def timed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the times of their ends."""
    return edges.join(nodes.select(F.col("id").alias("a"), F.col("at").alias("at_a")), "a").join(nodes.select(F.col("id").alias("b"), F.col("at").alias("at_b")), "b")


def constrained(edges: DataFrame, nodes: DataFrame, found: DataFrame, span_hours: float, scratch: Scratch) -> DataFrame:
    """(id, cluster) of nodes (id, at seconds): edges (a, b, turn) merged where ``found`` (id, component) allows none across.
    Edges that do not tell the times of their ends (at_a, at_b) take them from the nodes."""
    kind, limit = dict(nodes.dtypes)["id"], span_hours * 3600.0
    ends = edges if "at_a" in edges.columns else timed(edges, nodes)
    flip = (F.col("at_a") > F.col("at_b")) | ((F.col("at_a") == F.col("at_b")) & (F.col("a") > F.col("b")))
    one, two = F.struct("a", F.col("at_a").alias("t")), F.struct(F.col("b").alias("a"), F.col("at_b").alias("t"))
    ordered = ends.select("turn", F.when(flip, two).otherwise(one).alias("x"), F.when(flip, one).otherwise(two).alias("y")).select("turn", F.col("x.a").alias("a"), F.col("x.t").alias("at_a"), F.col("y.a").alias("b"), F.col("y.t").alias("at_b"))
    rows = scratch.save(ordered.join(found.select(F.col("id").alias("a"), "component"), "a"), "ordered")
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_EDGES)
    large = scratch.save(sizes, "large")
    greatest = large.agg(F.max("n")).first()[0]
    if greatest is None:
        labels = merged(rows, limit, kind).select("id", "cluster")
    else:
        small = merged(rows.join(large, "component", "left_anti"), limit, kind).select("id", "cluster")
        labels = small.union(_by_ranges(rows.join(large.select("component"), "component", "left_semi"), -(-greatest // MOST_EDGES), limit, kind, scratch))
    return nodes.join(labels, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def _by_ranges(rows: DataFrame, least: int, limit: float, kind: str, scratch: Scratch) -> DataFrame:
    """(id, cluster) of components too large for one task, range of time by range.

    Edges of turn 0 come before all others and are disjoint stars, so each is merged for itself; their clusters are what the
    first range begins with.
    """
    cuts = sorted(set(rows.where("turn > 0").approxQuantile("at_a", [k / least for k in range(1, least)], 0.01))) if least > 1 else []
    first = merged(rows.where("turn = 0").withColumns({"of": F.col("component"), "component": F.least("a", "b")}).drop("of"), limit, kind)
    of = rows.where("turn = 0").select("component", F.explode(F.array("a", "b")).alias("id")).distinct()
    state = scratch.save(first.drop("component").join(of, "id").select("component", "id", "cluster", "low", "high"), "state-0")
    at = rows.select(F.col("a").alias("id"), F.col("at_a").alias("at")).union(rows.select("b", "at_b")).distinct()
    steps = [state]
    for k, (start, end) in enumerate(zip([None, *cuts], [*cuts, None], strict=True), 1):
        own = rows.where("turn > 0")
        own = own if start is None else own.where(F.col("at_a") >= start)
        own = own if end is None else own.where(F.col("at_a") < end)
        open_ = state if start is None else state.join(at, "id").where(F.col("at") >= start)
        handed = open_.select("component", F.lit(-1).alias("turn"), F.col("id").alias("a"), F.col("low").alias("at_a"), F.col("cluster").alias("b"), F.col("high").alias("at_b"))
        state = scratch.save(merged(own.select(handed.columns).union(handed), limit, kind), f"state-{k}")
        steps.append(state)
    final = steps[-1].select("id", "cluster")
    parts = [final]
    for k in range(len(steps) - 2, -1, -1):
        later = final.select(F.col("id").alias("cluster"), F.col("cluster").alias("then"))
        final = scratch.save(steps[k].select("id", "cluster").join(later, "cluster", "left").select("id", F.coalesce("then", "cluster").alias("cluster")), f"final-{k}")
        parts.append(final)
    return reduce(DataFrame.union, parts).distinct()
