"""Queries without SQL against plain versions over whole tables."""

import difflib
from collections import defaultdict

from quillmesh import registry
from quillmesh.functions import text as X

SF = "/root/testdata/sf0.001"


def test_event_clusters_of_all_events(spark):
    rows = [(r.event_id, r.at / 1e6, r.user_id) for r in spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id", "unix_micros(cast(ts as timestamp)) AS at", "user_id").collect()]
    cluster, span = {i: {i} for i, _, _ in rows}, {i: (t, t) for i, t, _ in rows}
    users = defaultdict(list)
    for i, t, u in rows:
        users[u].append((t, i))
    for own in users.values():
        own.sort()
        for x, (ta, a) in enumerate(own):
            for tb, b in own[x + 1 :]:
                one, two = cluster[a], cluster[b]
                low, high = min(span[a][0], span[b][0]), max(span[a][1], span[b][1])
                if tb - ta <= 48 * 3600 and one is not two and high - low <= 72 * 3600:
                    one |= two
                    for i in one:
                        cluster[i], span[i] = one, (low, high)
    got = {r.id: r.cluster for r in registry.queries()["event_clusters"](spark, SF).collect()}
    assert got == {i: min(c) for i, c in cluster.items()}


def test_reprints_by_whole_texts(spark, tmp_path):
    lead = "stocks rise on strong bank earnings today and the market is calm again as traders await the next report on jobs and prices from the federal office in the coming week which many expect "
    same = lead + "to be quite good for all of them with few risks."
    rows = [(1, same), (2, lead + " ".join(f"zx{i} qj{i * 7}" for i in range(200))), (3, same + " Yes"), (4, same), (5, "short text")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.ord for r in registry.queries()["similar_reprint"](spark, str(tmp_path)).collect()) == [3, 4]


def test_reprints_against_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", X.normal_title("text").alias("t")).orderBy("doc_id").collect()
    want, groups = set(), defaultdict(list)
    for r in docs:
        words = r.t.split(" ")
        if len(words) >= 5:
            own = groups[tuple(words[:5])]
            if any(difflib.SequenceMatcher(None, r.t, t).ratio() >= 0.9 for t in own):
                want.add(r.doc_id)
            own.append(r.t)
    assert {r.ord for r in registry.queries()["similar_reprint"](spark, SF).collect()} == want and want
