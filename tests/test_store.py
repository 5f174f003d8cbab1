"""The versioned store: what a crash between any two steps leaves, conflicts, and merging of runs against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillmesh.plans.articles import articles
from quillmesh.sources import feeds, files, snapshots, tables
from quillmesh.sources.store import Change, Store

SF = "/root/testdata/sf0.001"


def contents(store):
    m = store.manifest()
    return {t: sorted(map(str, store.read(t, m).collect())) for t in m["tables"]}


def test_a_crash_between_any_two_steps_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    rows = lambda v: spark.createDataFrame([("2024-01-01", "a", v), ("2024-01-02", "b", v)], "day string, k string, v int")

    def change(v):
        c = store.begin()
        c.replace("whole", rows(v))
        c.upsert("days", rows(v).where(F.col("day") == "2024-01-01") if v else rows(v), ["day", "k"], "day")
        c.merge("merged", rows(v), "k", lambda old, new: old.unionByName(new))
        return c.commit()

    change(0)
    before, steps, real = contents(store), [], {n: getattr(Change, n) for n in ("_write", "_put")}

    def failing(at):
        def wrap(name):
            def step(self, *args):
                steps.append(name)
                if len(steps) == at:
                    raise OSError("lost")
                out = real[name](self, *args)
                if len(steps) + 0.5 == at and name != "_put":
                    raise OSError("lost after")
                return out

            return step

        for n in real:
            monkeypatch.setattr(Change, n, wrap(n))

    for at in (1, 1.5, 2, 2.5, 3, 3.5, 4):
        steps.clear()
        failing(at)
        with pytest.raises(OSError):
            change(1)
        assert contents(store) == before, at
    for n, f in real.items():
        monkeypatch.setattr(Change, n, f)
    change(1)
    after = contents(store)
    assert after["days"] == ["Row(day='2024-01-01', k='a', v=1)", "Row(day='2024-01-02', k='b', v=0)"] and len(after["merged"]) == 4 and len(after["whole"]) == 2
    assert store.clean(1) > 3 and contents(store) == after and store.versions() == [2]


def test_only_the_first_of_two_changes_commits(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    one, two = store.begin(), store.begin()
    one.replace("t", spark.range(3))
    two.replace("t", spark.range(5))
    one.commit()
    with pytest.raises(RuntimeError):
        two.commit()
    assert store.read("t").count() == 3 and store.read("none") is None
    odd = spark.createDataFrame([(None, 1), ("a/b=c %", 2), ("", 3)], "p string, v int")
    c = store.begin()
    c.upsert("odd", odd, ["p", "v"], "p")
    c.commit()
    assert sorted((r.p or "", r.v) for r in store.read("odd").collect()) == [("", 1), ("", 3), ("a/b=c %", 2)]


def test_untouched_parts_are_not_written_again(spark, tmp_path):
    path = str(tmp_path / "snap")
    rows = lambda day, v: spark.createDataFrame([(day, "a", v)], "snapshot_date string, sector string, v double")
    tables.upsert_days(spark, path, rows("2024-01-01", 1.0).union(rows("2024-01-02", 2.0)), ["snapshot_date", "sector"])
    store = Store(spark, str(tmp_path))
    before = store.manifest()["tables"]["snap"]["parts"]
    tables.upsert_days(spark, path, rows("2024-01-02", 3.0), ["snapshot_date", "sector"])
    after = store.manifest()["tables"]["snap"]["parts"]
    assert len(before) == len(after) == 2 and len(set(before.values()) & set(after.values())) == 1


def test_outputs_change_together_and_scores_have_six_digits(spark, tmp_path, monkeypatch):
    a = articles(spark, SF).withColumn("processing_error", F.when(F.col("article_id") % 10 == 0, "x"))
    folder = str(tmp_path / "out")
    snapshots.write_outputs(spark, folder, a, "real", dt.datetime(2024, 2, 1))
    store = Store(spark, folder)
    before = contents(store)
    assert set(before) == {"articles", "errors", "sectors", "market"} and len(before["errors"]) == a.where("article_id % 10 = 0").count()
    monkeypatch.setattr(Change, "upsert", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        snapshots.write_outputs(spark, folder, a.limit(5), "real", dt.datetime(2024, 2, 2))
    assert contents(store) == before
    for r in snapshots.sectors(spark, f"{folder}/sectors", "real").collect():
        assert all(round(r[m], 6) == r[m] for m in ("optimism", "fear", "disagreement"))


def test_files_are_swapped_in_one_step(spark, tmp_path):
    path = str(tmp_path / "a.txt")
    files.write_text(spark, path, "one")
    files.write_text(spark, path, "two")
    assert files.read_text(spark, path) == "two" and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["a.txt"]


# --- runs ---


def plain_lists(*values):
    out = {}
    for v in values:
        for x in (v or "").split(";"):
            if x.strip():
                out.setdefault(x.strip().lower(), x.strip())
    return ";".join(out.values())


def plain_merge(stored, run):
    key = lambda r: ((r["url"] or "").strip().lower(), (r["title"] or "").strip().lower())
    rows = [dict(r) for r in stored]
    by_key = {key(r): r for r in sorted(rows, key=lambda r: r["article_id"]) if key(r) != ("", "")}
    new = []
    for r in sorted(run, key=lambda r: r["place"]):
        r, k = {c: v for c, v in r.items() if c != "place"}, key(r)
        if k == ("", ""):
            continue
        if k not in by_key:
            by_key[k] = r
            rows.append(r)
            new.append(r["article_id"])
            continue
        t = by_key[k]
        for c in ("source", "tickers"):
            t[c] = plain_lists(t[c], r[c])
        number = lambda x: float(x) if x else 0.0
        t["source_weight"] = f"{max(number(t['source_weight']), number(r['source_weight']), 1e-9):.3f}"
        t["sector"] = r["sector"] if not t["sector"] else t["sector"] if r["sector"] in ("", t["sector"]) else ""
    return rows, new


def test_runs_against_plain(spark, tmp_path):
    rng, names = random.Random(5), ["article_id", "url", "title", "source", "tickers", "sector", "source_weight", "place"]
    schema = ", ".join(f"{n} {'int' if n == 'place' else 'string'}" for n in names)
    store, want = Store(spark, str(tmp_path / "s")), []
    for turn in range(3):
        run = [dict(zip(names, (f"{turn}-{i:03d}", rng.choice(["", " http://A/1", "http://a/1", "http://b", f"http://c/{rng.randint(0, 30)}"]), rng.choice(["", "T", "t ", "u"]), rng.choice(["f1", "F1", "f2;f3"]), rng.choice(["", "X;y", "Y", "z"]), rng.choice(["", "p", "q"]), rng.choice(["", "0.5", "0.9"]), i), strict=True)) for i in range(60)]
        want, new = plain_merge(want, run)
        change = store.begin()
        found = feeds.store_run(change, spark.createDataFrame([tuple(r[n] for n in names) for r in run], schema))
        assert sorted(r.article_id for r in found.collect()) == sorted(new)
        change.commit()
        got = store.read("raw").select(*names[:-1]).collect()
        assert sorted(map(tuple, got)) == sorted(tuple(r[n] for n in names[:-1]) for r in want), turn


def test_run_with_a_key_of_many_records(spark):
    rng, names = random.Random(9), ["article_id", "url", "title", "source", "tickers", "sector", "source_weight", "place"]
    schema = ", ".join(f"{n} {'int' if n == 'place' else 'string'}" for n in names)
    row = lambda i, **own: {"article_id": f"{i:05d}", "url": f"http://{i % 97 % 5}", "title": "T", "source": f"f{i % 400}; F{i % 7}", "tickers": rng.choice(["", f"X{i % 900};y"]), "sector": rng.choice(["", "p", "q", "q", "r"]), "source_weight": rng.choice(["", "0.5", "0.9"]), "place": i} | own
    stored = [{k: v for k, v in row(i, url=f"http://{i}").items() if k != "place"} for i in range(3)]
    run = [row(i) for i in range(10, 4000)]
    for stored_sector in ("", "p"):
        old = [r | {"sector": stored_sector} for r in stored]
        rows = feeds.merged_run(spark.createDataFrame([tuple(r.values()) for r in old], schema.rsplit(",", 1)[0]), spark.createDataFrame([tuple(r[n] for n in names) for r in run], schema).repartition(7))
        want, new = plain_merge(old, run)
        got = rows.collect()
        assert sorted(tuple(r[n] for n in names[:-1]) for r in got) == sorted(tuple(r[n] for n in names[:-1]) for r in want)
        assert sorted(r.article_id for r in got if r.new_) == sorted(new)
    # what is brought together of a key are its different items, never its records
    assert "collect_list(struct(place" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_sectors_in_turn(spark):
    rng = random.Random(4)
    rows = [(str(k), 1, i, f"{i:04d}", rng.choice(["", "a", "b", "c", "a"][: 2 + k % 4])) for k in range(40) for i in range(rng.randint(1, 60))]
    schema = "key_ string, later_ int, place int, article_id string, sector string"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.key_: r.agreed_ for r in feeds._agreed(spark.createDataFrame(rows, schema).repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for k, _, _, _, x in rows:
        s = want.get(k, "")
        want[k] = x if s == "" else s if x in ("", s) else ""
    assert {k: got.get(k, "") for k in want} == want and len(set(want.values())) > 2
