"""Feeds: their configuration, their entries as records, landed pages and the cache of full texts.

Fetching is not done here: entries and pages are read where a collector has landed them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import display
from quillmesh.functions import evidence as V
from quillmesh.functions import text as X
from quillmesh.functions import times as D
from quillmesh.operators.relations import merge_context
from quillmesh.sources import files
from quillmesh.sources.store import Change, bucket
from quillmesh.sources.tables import exists

# Kinds of feeds.
KINDS = ("market", "sector", "ticker")
CACHE = "article_id string, status string, title string, url string, body_text string, fetched_at string"


def checked(sources: list[dict]) -> list[dict]:
    """The enabled feeds of a configuration, or an error that names the first fault."""
    for i, s in enumerate(sources):
        fault = next(
            (
                what
                for what, wrong in {
                    "no name": not str(s.get("name", "")).strip(),
                    "no web address": not str(s.get("url", "")).lower().startswith(("http://", "https://")),
                    f"kind is none of {', '.join(KINDS)}": s.get("kind") not in KINDS,
                    "weight is not above 0 and at most 1": not isinstance(s.get("weight", 1.0), (int, float)) or not 0 < s.get("weight", 1.0) <= 1,
                    "max_entries is not at least 1": not isinstance(s.get("max_entries", 1), int) or s.get("max_entries", 1) < 1,
                    "a ticker feed without {ticker}": s.get("kind") == "ticker" and "{ticker}" not in str(s.get("url")),
                }.items()
                if wrong
            ),
            None,
        )
        if fault:
            raise ValueError(f"feed {i}: {fault}")
    return [s for s in sources if s.get("enabled", True)]


def load_sources(spark: SparkSession, path: str) -> list[dict]:
    return checked(files.read_json(spark, path) or [])


def expanded(spark: SparkSession, sources: list[dict], companies: DataFrame) -> DataFrame:
    """(feed, kind, url, weight, max_entries, sector, ticker): ticker feeds once for each distinct ticker."""
    told = [(s["name"], s["kind"], s["url"], float(s.get("weight", 1.0)), int(s.get("max_entries", 50)), s.get("sector", "")) for s in sources]
    feeds = spark.createDataFrame(told, "feed string, kind string, url string, weight double, max_entries int, sector string")
    each = companies.where(V.filled(F.col("ticker")) != "").groupBy("ticker").agg(F.min("sector").alias("of"))
    plain = feeds.where("kind <> 'ticker'").withColumn("ticker", F.lit(""))
    # the feeds are a list of the configuration, so this is a copy of the companies for each of a few feeds
    made = each.crossJoin(F.broadcast(feeds.where("kind = 'ticker'"))).withColumns({"url": F.replace("url", F.lit("{ticker}"), F.col("ticker")), "sector": F.col("of")}).select(*plain.columns)
    return plain.union(made)


def records(entries: DataFrame, collected_at: str) -> DataFrame:
    """Records of landed feed entries (feed, link, title, summary, source, publisher, published, weight, sector, ticker,
    place), the first ``max_entries`` of each feed by place."""
    kept = entries.where(F.col("place") < F.coalesce("max_entries", F.lit(50)))
    title, summary = display.strip_html(F.col("title")), display.strip_html(F.col("summary"))
    url, now = V.filled(F.col("link")), D.parsed(F.lit(collected_at))
    rows = kept.select(
        X.record_id(url, title).alias("article_id"), title.alias("title"), summary.alias("summary"), F.lit("").alias("content"), F.lit("").alias("body_text"), url.alias("url"), F.col("feed").alias("source"),
        V.publisher(F.col("source"), F.col("publisher"), F.col("feed")).alias("publisher"), F.col("weight").cast("string").alias("source_weight"), V.filled(F.col("sector")).alias("sector"), V.filled(F.col("ticker")).alias("tickers"),
        D.formatted(D.feed_time(F.col("published"), now)).alias("published_at"), D.formatted(now).alias("collected_at"), F.lit("summary").alias("content_level"), F.lit("False").alias("rescored"), F.col("place"),
    )
    return rows.where("title <> '' OR url <> ''")


def collected(records_: DataFrame) -> DataFrame:
    """One record for each address and title: the first, with the sources and tickers of all, and a sector only if they agree."""
    key = F.sha2(F.concat_ws("\0", F.lower(V.filled(F.col("url"))), F.lower(V.filled(F.col("title")))), 256)
    rows = records_.withColumn("key_", key).persist()
    sources, tickers = (merge_context(rows, "key_", c, "place").withColumnRenamed(c, f"all_{c}") for c in ("source", "tickers"))
    first = rows.groupBy("key_").agg(F.min_by(F.struct(*(F.col(c) for c in records_.columns)), F.struct("place", "article_id")).alias("r"), F.array_distinct(F.collect_set(F.nullif(V.filled(F.col("sector")), F.lit("")))).alias("all_"), F.max(F.col("source_weight").try_cast("double")).alias("best_"))
    both = first.join(sources, "key_", "left").join(tickers, "key_", "left").select("r.*", "all_", "best_", "all_source", "all_tickers")
    merged = {"source": F.coalesce("all_source", "source"), "tickers": F.coalesce("all_tickers", F.lit("")), "sector": F.when(F.size("all_") == 1, F.get("all_", F.lit(0))).otherwise(""), "source_weight": F.coalesce(F.col("best_").cast("string"), F.col("source_weight"))}
    return both.withColumns(merged).select(*records_.columns)


_LISTS = ("tickers", "companies", "source", "publisher", "time_parse_error", "processing_error")
BUCKETS = 64


_TURN = ("later_", "place", "article_id")


def _all_items(rows: DataFrame) -> DataFrame:
    """(key_, all_<list>...): the items of a key's ``;`` lists in their order, first spelling, case ignored.

    Only the first place of each different item of a key is brought together, not its rows.
    """
    lists = F.filter(F.array(*(F.struct(F.lit(i).alias("list_"), F.col(c).alias("value")) for i, c in enumerate(_LISTS))), lambda x: x["value"] != "")
    each = rows.select("key_", *_TURN, F.explode(lists).alias("l")).select("key_", *_TURN, "l.list_", F.posexplode(F.split("l.value", ";")).alias("p_", "item_"))
    each = each.withColumn("item_", F.trim("item_")).where("item_ <> ''")
    first = each.groupBy("key_", "list_", F.lower("item_").alias("low_")).agg(F.min(F.struct(*_TURN, "p_", "item_")).alias("f_"))
    joined = lambda i: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("list_") == i, F.col("f_")))), lambda x: x["item_"]), ";")
    return first.groupBy("key_").agg(*(joined(i).alias(f"all_{c}") for i, c in enumerate(_LISTS)))


def _agreed(rows: DataFrame) -> DataFrame:
    """(key_, agreed_): a key's sectors in turn, where a blank takes the next and another one clears it.

    Rows are dealt by ranges of key and turn, so a key of many rows is cut over tasks.  What a stretch of rows makes of the
    sector before it is told by a few values: a sector twice in a row settles it, else every row takes or clears in turn.
    """
    kinds = dict(rows.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out = None, []
        for f in frames:
            for key, *turn, sector in f.itertuples(index=False, name=None):
                if now is None or key != now[0]:
                    out += [now] if now else []
                    now = [key, *turn, sector, sector, True, None]
                    continue
                if sector == now[-3]:
                    now[-1] = sector
                elif now[-1] is not None:
                    now[-1] = "" if now[-1] else sector
                now[-3], now[-2] = sector, not now[-2]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        out += [now] if now else []
        if out:
            yield pd.DataFrame(out, columns=names)

    names = ["key_", *_TURN, "first", "last", "odd", "end"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in names[:4]) + ", first string, last string, odd boolean, end string"
    ordered = rows.where("sector <> ''").select("key_", *_TURN, "sector").repartitionByRange("key_", *_TURN).sortWithinPartitions("key_", *_TURN, "sector")
    parts = ordered.mapInPandas(run, schema).groupBy("key_").agg(F.sort_array(F.collect_list(F.struct(*names[1:]))).alias("parts_"))
    step = lambda s, x: F.when(x["end"].isNotNull(), x["end"]).when(((s == "") | (s == x["first"])) == x["odd"], x["last"]).otherwise("")
    return parts.select("key_", F.aggregate("parts_", F.lit(""), step).alias("agreed_"))


def merged_run(stored: DataFrame, run: DataFrame) -> DataFrame:
    """Stored records and those of a collection run (in the order of ``place``), with ``new_`` and ``changed_``.

    Records of one address and title (case and outer blanks aside) are one: the stored record, else the run's first, takes the
    lists of all (first spelling, case ignored), the greatest weight, and the sector only while sectors agree.  Records
    of a run without both are left out.  A key's records are never brought together, only its different list items.
    """
    key = F.sha2(F.concat_ws("\0", F.lower(V.filled(F.col("url"))), F.lower(V.filled(F.col("title")))), 256)
    named = (V.filled(F.col("url")) != "") | (V.filled(F.col("title")) != "")
    columns = [c for c in run.columns if c != "place"]
    run = run.withColumns({c: F.lit("") for c in (*_LISTS, "source_weight", "sector") if c not in run.columns})
    keyed = run.where(named).withColumn("key_", key)
    weight = F.coalesce(V.filled(F.col("source_weight")).try_cast("double"), F.lit(0.0))
    found = keyed.groupBy("key_").agg(F.min_by(F.struct(*columns), F.struct("place", "article_id")).alias("first_"), F.count(F.lit(1)).alias("told_"), F.max(weight).alias("heaviest_"))
    every = list(dict.fromkeys([*stored.columns, *columns, *_LISTS, "source_weight", "sector"]))
    # of stored records with one key the last takes what is new
    old = stored.withColumns({c: F.lit("") for c in every if c not in stored.columns})
    last = old.where(named).groupBy(key.alias("key_")).agg(F.max("article_id").alias("taker_"))
    old = old.withColumn("key_", F.when(named, key)).join(last, "key_", "left").withColumn("key_", F.when(F.col("article_id") == F.col("taker_"), F.col("key_")))
    texts = {c: V.filled(F.col(c)).alias(c) for c in (*_LISTS, "sector")}
    earlier = old.where("key_ is not null").select("key_", F.lit(0).alias("later_"), F.lit(None).cast(dict(run.dtypes)["place"]).alias("place"), "article_id", *texts.values())
    rows = earlier.union(keyed.select("key_", F.lit(1).alias("later_"), "place", "article_id", *texts.values()))
    both = old.select("key_", F.struct(*every).alias("old_")).join(found, "key_", "full_outer")
    both = both.join(_all_items(rows), "key_", "left").join(_agreed(rows), "key_", "left")
    has, came = F.col("old_").isNotNull(), F.col("told_").isNotNull()
    base = {c: F.when(has, F.col(f"old_.{c}")).otherwise(F.col(f"first_.{c}") if c in columns else F.lit("")) for c in every}
    takes = came & (has | (F.col("told_") > 1))
    heaviest = F.greatest(F.coalesce(V.filled(base["source_weight"]).try_cast("double"), F.lit(0.0)), F.col("heaviest_"), F.lit(1e-9))
    made = {**{c: F.coalesce(f"all_{c}", F.lit("")) for c in _LISTS}, "source_weight": F.format_string("%.3f", heaviest), "sector": F.coalesce("agreed_", F.lit(""))}
    out = {c: F.when(takes, made[c]).otherwise(base[c]) if c in made else base[c] for c in every}
    shown = ("tickers", "companies", "source", "publisher", "source_weight", "sector")
    differs = sum((F.coalesce((~made[c].eqNullSafe(base[c])).cast("int"), F.lit(0)) for c in shown), F.lit(0)) > 0
    return both.select(*(v.alias(c) for c, v in out.items()), (~has).alias("new_"), (has & came & differs).alias("changed_"))


def bucket_of(rows: DataFrame) -> Column:
    """The part of a record in the store, by its address and title."""
    return bucket(F.concat_ws("\0", F.lower(V.filled(F.col("url"))), F.lower(V.filled(F.col("title")))), BUCKETS)


def store_run(change: Change, run: DataFrame, table: str = "raw") -> DataFrame:
    """Merge a run into the stored records of ``table``, part of a change; returns the ids of new records (article_id)."""
    kept = [f.name for f in run.schema.fields if f.name != "place"]
    shape = run.withColumns({c: F.lit("") for c in (*_LISTS, "source_weight", "sector") if c not in run.columns})

    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        rows = merged_run(old.drop("run_new_"), new.select(*kept, "place"))
        return rows.withColumn("run_new_", F.col("new_")).drop("new_", "changed_")

    if table not in change.tables:
        empty = shape.drop("place").withColumn("run_new_", F.lit(True)).limit(0)
        change.tables[table] = {"schema": empty.schema.jsonValue(), "parts": {}}
    touched = run.where((V.filled(F.col("url")) != "") | (V.filled(F.col("title")) != ""))
    before = set(change.tables[table]["parts"].values())
    change.merge(table, touched, bucket_of(touched), combine)
    fresh = {p: f for p, f in change.tables[table]["parts"].items() if f not in before}
    return change.read(table, list(fresh)).where("run_new_").select("article_id")


def with_full_texts(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Raw records with the bodies of processed ones, which are then read whole; of repeated ids the greatest body serves."""
    have = processed.where(V.filled(F.col("body_text")) != "").groupBy("article_id").agg(F.max(F.struct("body_text", F.coalesce("rescored", F.lit("True")).alias("rescored"))).alias("full_"))
    rows = raw.join(have, "article_id", "left")
    return rows.withColumns({"body_text": F.coalesce("full_.body_text", "body_text"), "content_level": F.when(F.col("full_").isNotNull(), "fulltext").otherwise(F.col("content_level")), "rescored": F.coalesce("full_.rescored", "rescored")}).drop("full_")


def stats(records_: DataFrame, new_ids: DataFrame) -> DataFrame:
    """(source, parsed, new) of a collection run."""
    new = new_ids.select("article_id").distinct().withColumn("new_", F.lit(1))
    return records_.join(new, "article_id", "left").groupBy("source").agg(F.count("*").alias("parsed"), F.count("new_").alias("new"))


def raw_articles(df: DataFrame) -> DataFrame:
    """Stored raw records with defaults for the columns that older ones lack."""
    rows = df.withColumns({c: F.lit(None).cast("string") for c in ("publisher", "source_weight", "content_level", "rescored", "body_text") if c not in df.columns})
    level = F.when(V.filled(F.col("body_text")) != "", "fulltext").otherwise("summary")
    return rows.withColumns({"publisher": V.first_filled(F.col("publisher"), F.col("source")), "source_weight": V.first_filled(F.col("source_weight"), F.lit("1.0")), "content_level": V.first_filled(F.col("content_level"), level), "rescored": V.first_filled(F.col("rescored"), F.lit("False"))})


def clean_body(value):
    """A body without references, tags and runs of blanks."""
    return display.clean_text(value)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache of full texts: a Parquet folder, or an older JSON file of one object by article id."""
    if not exists(spark, path):
        return spark.createDataFrame([], CACHE)
    if path.endswith(".json"):
        told = json.loads(files.read_text(spark, path) or "{}")
        names = [x.split()[0] for x in CACHE.split(", ")]
        rows = spark.createDataFrame([(k, *(str(v.get(n) or "") for n in names[1:])) for k, v in told.items()], CACHE)
    else:
        rows = spark.read.schema(CACHE).parquet(path)
    return rows.withColumn("body_text", clean_body(F.col("body_text")))


def write_cache(cache: DataFrame, path: str) -> None:
    cache.select(*(x.split()[0] for x in CACHE.split(", "))).write.mode("overwrite").parquet(path)


def allowed_pages(pages: DataFrame, least: int = 200) -> DataFrame:
    """(article_id, body_text) of landed main texts that are long enough."""
    return pages.select("article_id", clean_body(F.col("text")).alias("body_text")).where(F.length("body_text") >= least)
