"""Vector codes against SQL's full search on whole tables, and against a plain version on odd rows."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from quillmesh.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, n int"


def plain(rows, entries=16, rounds=6, parts=8):
    """{place in the usable rows: (id, label, code, error)} by full searches, and the codebooks' digest."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, list(map(np.float32, r[1]))))
    width = -(-max((len(r[1]) for r in kept), default=0) // parts)
    cut = []
    for r in kept:
        v = [math.floor(4096 * float(np.float32(x))) for x in r[1]] + [0] * (parts * width - len(r[1]))
        cut.append([v[p * width : (p + 1) * width] for p in range(parts)])
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, book: min((gap(v, e), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = [near(c[p], book)[1] for c in cut]
            for j in range(len(book)):
                mine = [c[p] for c, o in zip(cut, own, strict=True) if o == j]
                if mine:
                    book[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = []
    for r, c in zip(kept, cut, strict=True):
        best = [near(c[p], books[p]) for p in range(parts)]
        out.append((r[0], r[2], "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_tables_against_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    want = con.sql(vector_codes.sql())
    got = vector_codes.op11_vector_codes(spark, path)
    assert sorted(got.select(*want.columns).collect()) == sorted(want.fetchall())


def odd():
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 16).astype(float) / 2, i % 3 or None) for i in range(60)]
    rows += [(5, rows[7][1], 1), (None, rows[9][1], None), (None, np.zeros(16), 2), (-7, np.ones(16), 2), (70, np.ones(16), 2), (71, np.ones(11), 2), (72, np.zeros(0), 2), (73, np.full(16, 900.5), 2)]
    rows = [(a, list(map(float, b)), c) for a, b, c in rows]
    return rows + [(80, None, 1), (81, [None] * 16, 1), (82, [float("nan")] * 16, 1), (83, [float("inf")] + [0.0] * 15, 1), (84, [float("-inf")], None)]


def test_odd_rows(spark):
    rows = odd()
    frame = spark.createDataFrame([(*r, "old", 1) for r in rows], SCHEMA)
    want, books = plain(rows)
    found = vector_codes.compress(spark, frame)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, found.rows.select("vec_id", "label", "code", "error").collect()), key=key) == sorted(want, key=key)
    assert vector_codes.digest(found.books) == books
    totals = {}
    for _, label, _, error in want:
        totals[label] = totals.get(label, 0) + error
    assert {r.label: r.label_error for r in vector_codes._with_totals(found.rows).collect()} == totals


def test_totals_of_many_labels_equal_those_of_few(spark, monkeypatch):
    found = vector_codes.compress(spark, spark.createDataFrame([(*r, "old", 1) for r in odd()], SCHEMA))
    few = sorted(map(str, vector_codes._with_totals(found.rows).collect()))
    for most in (0, 2):
        monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", most)
        assert sorted(map(str, vector_codes._with_totals(found.rows).select("vec_id", "label", "code", "error", "label_error").collect())) == few


def test_few_rows_and_empty_table(spark):
    assert vector_codes.compress(spark, spark.createDataFrame([], SCHEMA)).rows.count() == 0
    rows = [(2, [1.0, 2.0, 3.0], None), (1, [1.0, 2.0, 3.5], 4)]
    want, books = plain(rows)
    found = vector_codes.compress(spark, spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA))
    assert sorted(map(tuple, found.rows.select("vec_id", "label", "code", "error").collect())) == sorted(want)
    assert vector_codes.digest(found.books) == books


def test_bounds_skip_distances(spark):
    found = vector_codes.compress(spark, spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    assert found.computed[-1] < 0.5 * found.computed[0]


def test_large_components_stay_exact():
    rng = np.random.default_rng(1)
    parts, entries = rng.integers(-(1 << 27), 1 << 27, (50, 8)), rng.integers(-(1 << 27), 1 << 27, (5, 8))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, e, strict=True)) for e in entries] for x in parts]
    assert vector_codes.distances(parts, entries).tolist() == want
