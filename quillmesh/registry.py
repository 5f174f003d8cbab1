"""Named queries over the supplied tables, with the SQL each is checked against.

Floating results are rounded to six digits on both sides, as sums depend on order.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh import config
from quillmesh.functions import dictionary as L
from quillmesh.functions import display as Y
from quillmesh.functions import evidence as V
from quillmesh.functions import scoring as S
from quillmesh.functions import text as X
from quillmesh.functions import times as D
from quillmesh.operators import annotation as A
from quillmesh.operators import brief as B
from quillmesh.operators import clustering as C
from quillmesh.operators import enrichment as N
from quillmesh.operators import evaluation as E
from quillmesh.operators import metrics as M
from quillmesh.operators import relations as R
from quillmesh.operators import replay as P
from quillmesh.operators import tagging as T
from quillmesh.operators import weights as W
from quillmesh.plans.articles import SQL as ART
from quillmesh.plans.articles import articles, table
from quillmesh.sources import feeds as K
from quillmesh.sources import snapshots as Z
from quillmesh.sources.scratch import Scratch
from quillmesh.sources.store import Store

_FOUND: dict[str, tuple[Callable, str | None]] = {}
STOP = ["the", "and", "of", "that", "with"]
TOPICS = {"conjunction": ["and", "with"], "article": ["the", "der"], "other": ["que"]}
GROUP_ROWS = "dom AS (SELECT unnest(['absent','click','error','purchase','signup','view']) AS sector)"
NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), 'https?://[^ \\t\\n\\r]+|www\\.[^ \\t\\n\\r]+', ' ', 'g'), '[^a-z0-9 \\t\\n\\r]', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"


def query(sql: str | None):
    def keep(fn: Callable) -> Callable:
        _FOUND[fn.__name__] = (fn, sql)
        return fn

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _FOUND.items() if s}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sector_metrics_enhanced(spark, sf_dir)


# --- filters ---


@query(f"WITH {ART} SELECT article_id, sector FROM art WHERE published_at >= (SELECT max(published_at) FROM art) - INTERVAL 10 DAYS")
def working_set_filter(spark, d):
    a = articles(spark, d)
    newest = a.agg(F.max("published_at").alias("m"))
    return a.crossJoin(F.broadcast(newest)).where(F.col("published_at").isNull() | (F.col("published_at") >= F.col("m") - F.expr("INTERVAL 10 DAYS"))).select("article_id", "sector")


@query(f"WITH {ART} SELECT article_id FROM art WHERE published_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-11 00:00:00'")
def window_24h(spark, d):
    return articles(spark, d).where("published_at BETWEEN TIMESTAMP_NTZ '2024-01-10 00:00:00' AND TIMESTAMP_NTZ '2024-01-11 00:00:00'").select("article_id")


@query(f"WITH {ART} SELECT article_id, sector FROM art WHERE published_at >= (SELECT max(published_at) FROM art) - INTERVAL 7 DAYS")
def attention_window(spark, d):
    return M.attention_window(articles(spark, d)).select("article_id", "sector")


@query(f"WITH {ART} SELECT article_id, publisher FROM art WHERE sector = 'error'")
def macro_filter(spark, d):
    return articles(spark, d).where("sector = 'error'").select("article_id", "publisher")


@query(f"WITH {ART} SELECT article_id FROM art WHERE published_at >= DATE '2024-01-05' AND published_at < DATE '2024-01-08'")
def date_range(spark, d):
    return articles(spark, d).where("published_at >= TIMESTAMP_NTZ '2024-01-05' AND published_at < TIMESTAMP_NTZ '2024-01-08'").select("article_id")


@query(f"WITH {ART} SELECT article_id FROM art WHERE source IN ('src1','src2','src3') AND sector IN ('view','click') AND (user_id % 7 IN (1, 2) OR user_id % 5 IN (1, 2))")
def multi_select_overlap(spark, d):
    sets = F.array(F.col("user_id") % 7, F.col("user_id") % 5)
    return articles(spark, d).where(F.col("source").isin("src1", "src2", "src3") & F.col("sector").isin("view", "click") & F.arrays_overlap(sets, F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))).select("article_id")


@query(
    f"""WITH {ART}, m AS (SELECT max(published_at) AS t FROM art), n AS (SELECT count(DISTINCT CASE WHEN published_at >= t - INTERVAL 48 HOURS THEN event_key END) AS a,
    count(DISTINCT CASE WHEN published_at >= t - INTERVAL 72 HOURS THEN event_key END) AS b FROM art, m)
    SELECT article_id, CASE WHEN a >= 300 THEN 48 WHEN b >= 300 THEN 72 ELSE 168 END AS hours FROM art, m, n
    WHERE published_at >= t - to_hours(CASE WHEN a >= 300 THEN 48 WHEN b >= 300 THEN 72 ELSE 168 END)"""
)
def adaptive_window(spark, d):
    a = articles(spark, d)
    newest = F.broadcast(a.agg(F.max("published_at").alias("t")))
    dated = a.crossJoin(newest)
    within = lambda h: F.col("published_at") >= F.col("t") - F.expr(f"INTERVAL {h} HOURS")
    n = dated.agg(F.count_distinct(F.when(within(48), F.col("event_key"))).alias("n48"), F.count_distinct(F.when(within(72), F.col("event_key"))).alias("n72"))
    hours = F.when(F.col("n48") >= 300, 48).when(F.col("n72") >= 300, 72).otherwise(168)
    ok = F.when(F.col("hours") == 48, within(48)).when(F.col("hours") == 72, within(72)).otherwise(within(168))
    return dated.crossJoin(F.broadcast(n.select(hours.alias("hours")))).where(ok).select("article_id", F.col("hours").cast("int").alias("hours"))


@query("SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(value AS VARCHAR) END AS DOUBLE), 0) AS value, lower(event_type) IN ('true', 'view') AS flag FROM events")
def coerce_numeric(spark, d):
    e = table(spark, d, "events").withColumn("text", F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.col("value").cast("string")))
    return e.select("event_id", S.number("text").alias("value"), F.lower("event_type").isin("true", "view").alias("flag"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'baseline' ELSE event_type END AS formula, coalesce(CASE WHEN event_id % 5 <> 0 THEN value END, user_id) AS volume FROM events")
def legacy_marking(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.lit(" ")).otherwise(F.col("event_type")).alias("f"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"), "user_id")
    return e.select("event_id", F.when(F.col("f").isNull() | (F.trim("f") == ""), "baseline").otherwise(F.col("f")).alias("formula"), F.coalesce("v", F.col("user_id").cast("double")).alias("volume"))


# --- joins and set operations ---


@query("SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)")
def join_validated(spark, d):
    labels = table(spark, d, "labels")
    unique = labels.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic")).where("n = 1").drop("n")
    return table(spark, d, "documents").select("doc_id", "lang").join(unique, "doc_id")


@query("SELECT e.event_id, coalesce(nullif(d.source, ''), e.event_type) AS source, (d.source IS NOT NULL) AS changed FROM events e LEFT JOIN documents d ON e.event_id = d.doc_id")
def left_update(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("s"))
    e = table(spark, d, "events")
    return e.join(docs, e.event_id == docs.doc_id, "left").select("event_id", F.coalesce(F.nullif("s", F.lit("")), "event_type").alias("source"), F.col("s").isNotNull().alias("changed"))


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT doc_id FROM documents)")
def new_ids_anti(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    e = table(spark, d, "events").select("event_id")
    return e.join(docs, e.event_id == docs.doc_id, "left_anti")


@query(f"WITH {ART}, {GROUP_ROWS} SELECT sector, coalesce(n, 0) AS n FROM dom LEFT JOIN (SELECT sector, count(*) AS n FROM art GROUP BY 1) USING (sector)")
def zero_fill(spark, d):
    return W.zero_fill(spark, articles(spark, d).groupBy("sector").agg(F.count("*").alias("n")), config.GROUPS)


@query(
    """WITH r AS (SELECT event_id AS id, epoch(ts) AS at, unnest([user_id % 700, 1000 + user_id % 500]) AS e FROM events)
    SELECT DISTINCT x.id AS a, y.id AS b FROM r x JOIN r y ON x.e = y.e AND x.id < y.id AND abs(x.at - y.at) <= 172800"""
)
def range_overlap_pairs(spark, d):
    e = table(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return R.range_overlap_pairs(e.select(F.col("event_id").alias("id"), at.alias("at"), F.array(F.col("user_id") % 700, 1000 + F.col("user_id") % 500).alias("entities")))


@query(
    f"""WITH t AS (SELECT doc_id, string_split({NORMAL.format('text')}, ' ')[1:5] AS p, length({NORMAL.format('text')}) AS n FROM documents)
    SELECT x.doc_id AS later, min(y.doc_id) AS earlier FROM t x JOIN t y ON x.p = y.p AND y.doc_id < x.doc_id AND len(x.p) = 5 GROUP BY 1"""
)
def prefix_block_pairs(spark, d):
    words = F.substring_index(X.normal_title(F.col("text")), " ", 5)
    t = table(spark, d, "documents").select("doc_id", words.alias("p")).select("doc_id", F.when(F.size(F.split("p", " ")) == 5, F.unhex(F.md5("p"))).alias("key"))
    first = t.groupBy(F.col("key").alias("k")).agg(F.min("doc_id").alias("earlier"), F.count("*").alias("n")).where("n > 1 and k is not null")
    return t.select(F.col("doc_id").alias("later"), F.col("key").alias("own")).join(first, F.col("own") == F.col("k")).where("earlier < later").select("later", "earlier")


@query(f"WITH {ART}, v AS (SELECT sector, day, sum(agg_weight) AS x FROM art GROUP BY 1, 2) SELECT c.sector, round(c.x - p.x, 6) AS delta FROM v c JOIN v p ON c.sector = p.sector AND c.day = DATE '2024-01-20' AND p.day = DATE '2024-01-19'")
def snapshot_delta(spark, d):
    v = M.daily_volume(articles(spark, d))
    now, then = (v.where(F.col("day") == F.lit(x).cast("date")).select("sector", F.col("volume").alias(n)) for x, n in (("2024-01-20", "now"), ("2024-01-19", "then")))
    return rounded(now.join(then, "sector").select("sector", (F.col("now") - F.col("then")).alias("delta")))


@query(f"WITH {ART} SELECT event_key, arg_max(article_id, agg_weight * 1e9 - article_id) AS evidence FROM art WHERE article_id % 3 = 0 GROUP BY 1")
def evidence_lookup(spark, d):
    return articles(spark, d).where("article_id % 3 = 0").groupBy("event_key").agg(F.max_by("article_id", F.col("agg_weight") * 1e9 - F.col("article_id")).alias("evidence"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'new' ELSE p_brand END AS p_brand FROM part UNION ALL SELECT max(p_partkey) + 1, 'new' FROM part")
def upsert(spark, d):
    old = table(spark, d, "part").select("p_partkey", "p_brand")
    new = old.where("p_partkey % 4 = 0").select("p_partkey", F.lit("new").alias("p_brand")).unionByName(old.agg((F.max("p_partkey") + 1).alias("p_partkey")).withColumn("p_brand", F.lit("new")))
    return R.upsert(old, new, ["p_partkey"])


@query("SELECT doc_id AS id, 'document' AS kind FROM documents UNION ALL SELECT item_id, 'item' FROM benchmark")
def union_all(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind")).unionByName(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("item").alias("kind")))


@query("SELECT DISTINCT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def key_except(spark, d):
    return table(spark, d, "documents").select("doc_id").distinct().join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    """WITH p AS (SELECT user_id, event_id, i, part FROM (SELECT user_id, event_id, unnest([event_type, upper(event_type), 'S' || event_id % 3]) AS part, unnest([1, 2, 3]) AS i FROM events)),
    f AS (SELECT *, row_number() OVER (PARTITION BY user_id, lower(part) ORDER BY event_id, i) AS r FROM p) SELECT user_id, string_agg(part, ';' ORDER BY event_id, i) AS sources FROM f WHERE r = 1 GROUP BY 1"""
)
def raw_merge(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.concat_ws(";", "event_type", F.upper("event_type"), F.concat(F.lit("S"), F.col("event_id") % 3)).alias("sources"))
    return R.merge_context(e, "user_id", "sources", "event_id")


# --- aggregates ---

LINE = "l AS (SELECT l_returnflag AS g, l_extendedprice / 1000 AS v, l_quantity AS w FROM lineitem)"


def _lines(spark, d) -> DataFrame:
    return W.with_safe_weight(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_extendedprice") / 1000).alias("v"), "l_quantity"), ["g"], "l_quantity")


@query(f"WITH {LINE} SELECT g, round(sum(v * w) / sum(w), 6) AS mean FROM l GROUP BY 1")
def weighted_mean(spark, d):
    return rounded(_lines(spark, d).groupBy("g").agg(W.wmean(F.col("v")).alias("mean")))


@query(f"WITH {LINE}, m AS (SELECT g, sum(v * w) / sum(w) AS mean FROM l GROUP BY 1) SELECT g, round(sqrt(sum(w * (v - mean) ** 2) / sum(w)), 6) AS weighted_std FROM l JOIN m USING (g) GROUP BY 1")
def weighted_std(spark, d):
    return rounded(W.weighted_std(_lines(spark, d), ["g"], "v"))


@query(f"WITH {LINE}, c AS (SELECT g, v, sum(w) OVER (PARTITION BY g ORDER BY v) AS cum, sum(w) OVER (PARTITION BY g) AS tot FROM l) SELECT g, min(v) AS p90 FROM c WHERE cum >= 0.9 * tot - 1e-12 GROUP BY 1")
def weighted_p90(spark, d):
    return W.weighted_quantile(_lines(spark, d), ["g"], "v", 0.9, "p90")


@query(
    f"""WITH {ART}, a AS (SELECT sector AS g, day, sentiment_score AS v, agg_weight AS w, article_id AS i FROM art)
    SELECT x.g, x.day, round(least(1, sum(x.w * y.w * abs(x.v - y.v)) / (2 * sum(x.w * y.w))), 6) AS distance FROM a x JOIN a y ON x.g = y.g AND x.day = y.day AND x.i < y.i GROUP BY 1, 2"""
)
def pairwise_distance(spark, d):
    a = articles(spark, d).select(F.col("sector").alias("g"), "day", "sentiment_score", F.col("agg_weight").alias("w"))
    many = W.pairwise_distance(a, ["g", "day"], "sentiment_score")
    sizes = a.groupBy("g", "day").count().where("count > 1").drop("count")
    return rounded(many.join(sizes, ["g", "day"], "left_semi"))


@query(f"WITH {ART} SELECT sector, round(2 * least(sum(CASE WHEN sentiment_score > 0.15 THEN agg_weight ELSE 0 END), sum(CASE WHEN sentiment_score < -0.15 THEN agg_weight ELSE 0 END)) / sum(agg_weight), 6) AS mix FROM art GROUP BY 1")
def polarity_mix(spark, d):
    return rounded(W.with_safe_weight(articles(spark, d), ["sector"]).groupBy("sector").agg(W.polarity_mix(F.col("sentiment_score")).alias("mix")))


@query(
    f"""WITH {ART}, m AS (SELECT sector, sum(sentiment_score * agg_weight) / sum(agg_weight) AS mean, 2 * least(sum(CASE WHEN sentiment_score > 0.15 THEN agg_weight ELSE 0 END), sum(CASE WHEN sentiment_score < -0.15 THEN agg_weight ELSE 0 END)) / sum(agg_weight) AS mix FROM art GROUP BY 1)
    SELECT sector, round(least(100, 100 * (0.5 * sqrt(sum(agg_weight * (sentiment_score - mean) ** 2) / sum(agg_weight)) + 0.5 * any_value(mix))), 6) AS disagreement FROM art JOIN m USING (sector) GROUP BY 1"""
)
def disagreement_legacy(spark, d):
    a = W.with_safe_weight(articles(spark, d), ["sector"])
    both = W.weighted_std(a, ["sector"], "sentiment_score").join(a.groupBy("sector").agg(W.polarity_mix(F.col("sentiment_score")).alias("mix")), "sector")
    return rounded(both.select("sector", F.least(F.lit(100.0), 100 * (0.5 * F.col("weighted_std") + 0.5 * F.col("mix"))).alias("disagreement")))


VOLUME = f"{GROUP_ROWS}, vol AS (SELECT sector, coalesce(x, 0) AS volume FROM dom LEFT JOIN (SELECT sector, sum(agg_weight) AS x FROM art WHERE published_at >= (SELECT max(published_at) FROM art) - INTERVAL 7 DAYS GROUP BY 1) USING (sector))"


@query(f"WITH {ART}, {VOLUME} SELECT sector, round(volume, 6) AS volume FROM vol")
def attention_volume(spark, d):
    return rounded(M.attention_volume(spark, articles(spark, d)))


@query("SELECT event_type, count(DISTINCT p) AS publishers FROM (SELECT event_type, unnest(['u' || user_id, 's' || user_id % 20]) AS p FROM events) GROUP BY 1")
def publisher_count(spark, d):
    names = F.concat(F.lit("u"), F.col("user_id"), F.lit("; s"), F.col("user_id") % 20)
    return table(spark, d, "events").select("event_type", F.explode(X.split_values(names)).alias("p")).groupBy("event_type").agg(F.count_distinct("p").alias("publishers"))


def _metrics_sql(weights: dict) -> str:
    dims = ", ".join(
        f"sum(100 * greatest(0, least(1, {' + '.join(f'{w} * {c}' for c, w in weights[dim].items())})) * agg_weight) / sum(agg_weight) AS {dim}" for dim in ("optimism", "fear", "uncertainty")
    )
    part = weights["risk_intensity"]
    return f"""{ART}, {VOLUME}, main AS (SELECT sector, {dims}, count(*) AS articles, count(DISTINCT publisher) AS publishers FROM art GROUP BY 1),
    tie AS (SELECT sector, sentiment_score AS v, sum(agg_weight) AS w, sum(agg_weight * agg_weight) AS w2 FROM art GROUP BY 1, 2),
    dis AS (SELECT x.sector, 100 * sum(CASE WHEN x.v < y.v THEN x.w * y.w * (y.v - x.v) ELSE 0 END) / (2 * any_value(z.p)) AS disagreement FROM tie x JOIN tie y USING (sector) JOIN (SELECT sector, (sum(w) ** 2 - sum(w2)) / 2 AS p FROM tie GROUP BY 1) z USING (sector) GROUP BY 1),
    reps AS (SELECT * FROM art QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY agg_weight DESC, article_id) = 1),
    cum AS (SELECT sector, risk_intensity AS v, sum(agg_weight) OVER (PARTITION BY sector ORDER BY risk_intensity) AS c, sum(agg_weight) OVER (PARTITION BY sector) AS t FROM reps),
    p AS (SELECT sector, min(v) AS p90 FROM cum WHERE c >= 0.9 * t - 1e-12 GROUP BY 1),
    risk AS (SELECT sector, count(*) AS events, {part['weighted_mean']} * sum(risk_intensity * agg_weight) / sum(agg_weight) + {part['p90']} * any_value(p90) AS risk_intensity FROM reps JOIN p USING (sector) GROUP BY 1),
    att AS (SELECT sector, 100 * ((SELECT count(*) FROM vol v2 WHERE v2.volume < v.volume) + ((SELECT count(*) FROM vol v2 WHERE v2.volume = v.volume) + 1) / 2.0 - 0.5) / 6 AS attention FROM vol v),
    met AS (SELECT sector, coalesce(optimism, 0) AS optimism, coalesce(fear, 0) AS fear, coalesce(uncertainty, 0) AS uncertainty, attention, coalesce(disagreement, 0) AS disagreement, coalesce(risk_intensity, 0) AS risk_intensity,
      coalesce(articles, 0) AS articles, coalesce(events, 0) AS events, coalesce(publishers, 0) AS publishers FROM dom LEFT JOIN main USING (sector) LEFT JOIN dis USING (sector) LEFT JOIN risk USING (sector) LEFT JOIN att USING (sector))"""


_ROUND6 = ", ".join(f"round({m}, 6) AS {m}" for m in config.METRICS)


@query(f"WITH {_metrics_sql(config.BASELINE)} SELECT sector, {_ROUND6}, articles, events, publishers FROM met")
def sector_metrics_baseline(spark, d):
    return rounded(M.sector_metrics(spark, articles(spark, d), config.BASELINE))


@query(f"WITH {_metrics_sql(config.ENHANCED)} SELECT sector, {_ROUND6}, articles, events, publishers FROM met")
def sector_metrics_enhanced(spark, d):
    return rounded(M.sector_metrics(spark, articles(spark, d), config.ENHANCED))


@query(f"WITH {_metrics_sql(config.ENHANCED)} SELECT {', '.join(f'round(avg({m}), 6) AS {m}' for m in config.METRICS)} FROM met")
def market_metrics(spark, d):
    return rounded(M.market_metrics(spark, articles(spark, d), config.ENHANCED))


SCORED = f"{ART}, sc AS (SELECT *, 0.4 * risk_intensity + 0.25 * abs(sentiment_score) * 100 + 0.2 * 100 * greatest(0, least(1, 0.4 * p_neutral + 0.3 * entropy_norm + 0.3 * k_unc)) + 0.15 * agg_weight / max(agg_weight) OVER () * 100 AS driver_score FROM art)"
EVENTS = f"""{SCORED}, ev AS (SELECT event_key, first(article_id ORDER BY agg_weight DESC, article_id) AS article_id, first(sector ORDER BY agg_weight DESC, article_id) AS sector, count(*) AS articles, count(DISTINCT source) AS sources,
    CASE WHEN count(DISTINCT source) >= 3 THEN least(max(driver_score) * 1.15, 115) ELSE max(driver_score) END AS event_score FROM sc GROUP BY 1)"""


@query(f"WITH {SCORED} SELECT article_id, round(driver_score, 6) AS driver_score FROM sc")
def driver_score(spark, d):
    return rounded(M.with_driver_score(articles(spark, d)).select("article_id", "driver_score"))


@query(f"WITH {EVENTS} SELECT event_key, article_id, sector, articles, sources, round(event_score, 6) AS event_score FROM ev")
def event_collapse(spark, d):
    return rounded(M.collapse_events(M.with_driver_score(articles(spark, d))).select("event_key", "article_id", "sector", "articles", "sources", "event_score"))


@query(f"WITH {EVENTS}, m AS (SELECT event_key, article_id, row_number() OVER (PARTITION BY event_key ORDER BY published_at DESC, article_id) AS k FROM sc), g AS (SELECT event_key, string_agg(article_id::VARCHAR, ';' ORDER BY k) AS members FROM m WHERE k <= 3 GROUP BY 1) SELECT event_key, article_id, articles, members FROM ev JOIN g USING (event_key)")
def event_members(spark, d):
    """Events with their newest three articles."""
    rows = M.event_rows(M.with_driver_score(articles(spark, d)), 3)
    return rows.select("event_key", "article_id", "articles", F.array_join(F.transform("members", lambda m: m["article_id"].cast("string")), ";").alias("members"))


@query(f"WITH {ART} SELECT sector, article_id, 'positive' AS side, row_number() OVER (PARTITION BY sector ORDER BY sentiment_score DESC, article_id) AS place FROM art QUALIFY place <= 20 UNION ALL SELECT sector, article_id, 'negative', row_number() OVER (PARTITION BY sector ORDER BY sentiment_score, article_id) AS place FROM art QUALIFY place <= 20")
def strongest_news(spark, d):
    a = articles(spark, d)
    sides = [M.strongest_news(a, side == "negative").select("sector", "article_id", F.lit(side).alias("side"), F.col("place").cast("long").alias("place")) for side in ("positive", "negative")]
    return sides[0].union(sides[1])


@query(
    f"""WITH {EVENTS}, best AS (SELECT * FROM ev WHERE sector = 'error' ORDER BY event_score DESC, article_id LIMIT 1)
    SELECT event_key, article_id, round(event_score, 6) AS event_score FROM ((SELECT * FROM ev WHERE event_key NOT IN (SELECT event_key FROM best) ORDER BY event_score DESC, article_id LIMIT 9) UNION ALL SELECT * FROM best)"""
)
def top_drivers(spark, d):
    return rounded(M.top_drivers(articles(spark, d)).select("event_key", "article_id", "event_score"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 5")
def value_counts_top(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)


@query(f"WITH {ART}, {GROUP_ROWS} SELECT sector, coalesce(p, 0) AS positive, coalesce(n, 0) AS negative FROM dom LEFT JOIN (SELECT sector, count(*) FILTER (sentiment_score > 0.05) AS p, count(*) FILTER (sentiment_score < -0.05) AS n FROM art GROUP BY 1) USING (sector)")
def sentiment_counts(spark, d):
    label = S.sentiment_label(F.col("sentiment_score"))
    return W.zero_fill(spark, articles(spark, d).groupBy("sector").agg(F.count_if(label == "positive").alias("positive"), F.count_if(label == "negative").alias("negative")), config.GROUPS)


@query(
    f"""WITH {ART}, u AS (UNPIVOT (SELECT sentiment_score, risk_intensity, agg_weight FROM art) ON sentiment_score, risk_intensity, agg_weight INTO NAME metric VALUE v)
    SELECT metric, count(*) AS n, round(min(v), 6) AS lowest, round(quantile_cont(v, 0.1), 6) AS p10, round(median(v), 6) AS p50, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.9), 6) AS p90, round(max(v), 6) AS highest FROM u GROUP BY 1"""
)
def output_distribution(spark, d):
    return rounded(M.output_distribution(articles(spark, d), ["sentiment_score", "risk_intensity", "agg_weight"]))


@query(f"WITH {ART} SELECT count(*) AS articles, count(DISTINCT sector) AS sectors, count(DISTINCT publisher) AS publishers, count(DISTINCT event_key) AS events, count(*) FILTER (risk_intensity > 0) AS risky, min(day) AS first_day, max(day) AS last_day FROM art")
def coverage_summary(spark, d):
    return articles(spark, d).agg(F.count("*").alias("articles"), F.count_distinct("sector").alias("sectors"), F.count_distinct("publisher").alias("publishers"), F.count_distinct("event_key").alias("events"), F.count_if(F.col("risk_intensity") > 0).alias("risky"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def _formula_sql(name: str, weights: dict) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS formula, '{dim}' AS metric, sector, 100 * greatest(0, least(1, {' + '.join(f'{w} * {c}' for c, w in weights[dim].items())})) AS v FROM art" for dim in ("optimism", "fear", "uncertainty"))


@query(f"WITH {ART}, f AS ({_formula_sql('baseline', config.BASELINE)} UNION ALL {_formula_sql('enhanced', config.ENHANCED)}), s AS (SELECT formula, metric, sector, avg(v) AS v FROM f GROUP BY ALL) SELECT formula, metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(max(v) - min(v), 6) AS spread FROM s GROUP BY ALL")
def formula_comparison(spark, d):
    a, parts = articles(spark, d), []
    for name, weights in (("baseline", config.BASELINE), ("enhanced", config.ENHANCED)):
        parts += [F.struct(F.lit(name).alias("formula"), F.lit(k).alias("metric"), c.alias("v")) for k, c in S.article_formulas(weights).items()]
    s = a.select("sector", F.explode(F.array(*parts)).alias("x")).groupBy("x.formula", "x.metric", "sector").agg(F.avg("x.v").alias("v"))
    return rounded(s.groupBy("formula", "metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), (F.max("v") - F.min("v")).alias("spread")))


@query(f"WITH {ART} SELECT sector, {', '.join(f'round(sum({c} * agg_weight) / sum(agg_weight), 6) AS {c}' for c in ('b_bull', 'b_bear', 'g_growth', 's_shock', 'k_unc'))} FROM art GROUP BY 1")
def component_means(spark, d):
    return rounded(W.with_safe_weight(articles(spark, d), ["sector"]).groupBy("sector").agg(*(W.wmean(F.col(c)).alias(c) for c in ("b_bull", "b_bear", "g_growth", "s_shock", "k_unc"))))


@query(f"WITH {ART}, s AS (SELECT event_key, count(*) AS n FROM art GROUP BY 1) SELECT n AS size, count(*) AS events FROM s GROUP BY 1")
def size_histogram(spark, d):
    return articles(spark, d).groupBy("event_key").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("events"))


@query(f"WITH {ART}, s AS (SELECT event_key, count(*) AS n FROM art GROUP BY 1) SELECT count(*) AS events, count(*) FILTER (n > 1) AS multi, sum(n) FILTER (n > 1) AS in_multi, max(n) AS largest FROM s")
def cluster_summary(spark, d):
    s = articles(spark, d).groupBy("event_key").agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("events"), F.count_if(F.col("n") > 1).alias("multi"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("in_multi"), F.max("n").alias("largest"))


@query(f"WITH {ART} SELECT sector, round(max(abs(agg_weight - (article_id % 5 + 1) / 5.0 * (user_id % 3 + 1) / 3.0 * 0.7)), 6) AS off, round(avg(agg_weight), 6) AS mean FROM art GROUP BY 1")
def weight_audit(spark, d):
    """Stored weights against the product of their factors."""
    parts = articles(spark, d).withColumns({"stored": F.col("agg_weight"), "time_weight": (F.col("article_id") % 5 + 1) / 5.0, "relevance_weight": (F.col("user_id") % 3 + 1) / 3.0, "dedup_factor": F.lit("0.7"), "source_weight": F.lit("")})
    made = N.backfill_sources(parts, N.Dictionaries())
    return rounded(made.groupBy("sector").agg(F.max(F.abs(F.col("stored") - F.col("agg_weight"))).alias("off"), F.avg("stored").alias("mean")))


# --- windows and top-k ---


@query(f"WITH {ART}, {VOLUME} SELECT sector, 100 * ((SELECT count(*) FROM vol v2 WHERE v2.volume < v.volume) + ((SELECT count(*) FROM vol v2 WHERE v2.volume = v.volume) + 1) / 2.0 - 0.5) / 6 AS percentile FROM vol v")
def avg_rank_percentile(spark, d):
    v = M.attention_volume(spark, articles(spark, d))
    return v.select("sector", (100 * (W.average_rank(F.col("volume"), [F.lit(1)], F.col("volume")) - 0.5) / F.count("*").over(Window.partitionBy(F.lit(1)))).alias("percentile"))


DAILY = "daily AS (SELECT sector, day, sum(agg_weight) AS volume, count(*) AS articles FROM art GROUP BY 1, 2)"
GROWTH = f"{DAILY}, gr AS (SELECT *, row_number() OVER s AS n, CASE WHEN row_number() OVER s > 7 THEN (volume - avg(volume) OVER p) / (avg(volume) OVER p + 1) END AS growth FROM daily WINDOW s AS (PARTITION BY sector ORDER BY day), p AS (PARTITION BY sector ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))"


@query(f"WITH {ART}, {GROWTH} SELECT sector, day, round(growth, 6) AS growth FROM gr WHERE growth IS NOT NULL")
def growth_series(spark, d):
    return rounded(M.growth_series(M.daily_volume(articles(spark, d))).where("growth IS NOT NULL").select("sector", "day", "growth"))


@query(
    f"""WITH {ART}, {GROWTH}, l AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY day DESC) AS b FROM gr), c AS (SELECT sector, volume AS v, growth AS g FROM l WHERE b = 1)
    SELECT sector, count(*) AS days, round(100 * (0.7 * avg(CASE WHEN volume <= v THEN 1.0 ELSE 0 END) + 0.3 * avg(CASE WHEN growth IS NULL THEN NULL WHEN growth <= g THEN 1.0 ELSE 0 END)), 6) AS attention FROM l JOIN c USING (sector) WHERE b > 1 GROUP BY 1"""
)
def attention_scores(spark, d):
    return rounded(M.attention_scores(M.daily_volume(articles(spark, d)), config.ENHANCED))


@query(f"WITH {ART}, {DAILY} SELECT sector, day, round(cume_dist() OVER (PARTITION BY sector ORDER BY volume), 6) AS ecdf FROM daily")
def volume_ecdf(spark, d):
    return rounded(M.daily_volume(articles(spark, d)).select("sector", "day", F.cume_dist().over(Window.partitionBy("sector").orderBy("volume")).alias("ecdf")))


@query(f"WITH {ART} SELECT event_key, article_id FROM art QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY agg_weight DESC, article_id) = 1")
def event_representatives(spark, d):
    return M.event_representatives(articles(spark, d)).select("event_key", "article_id")


@query(f"WITH {ART} SELECT sector, day, article_id FROM art QUALIFY row_number() OVER (PARTITION BY sector, day ORDER BY published_at DESC, article_id DESC) = 1")
def keep_last(spark, d):
    return R.one_row_per_key(articles(spark, d), ["sector", "day"], [F.desc("published_at"), F.desc("article_id")]).select("sector", "day", "article_id")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'view') DESC, ts DESC NULLS LAST) = 1")
def snapshot_select(spark, d):
    return R.one_row_per_key(table(spark, d, "events"), ["user_id"], [(F.col("event_type") == "view").desc(), F.col("ts").desc_nulls_last()]).select("user_id", "event_id")


@query(f"WITH {ART}, {DAILY}, l AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY day DESC) AS b, first(volume) OVER (PARTITION BY sector ORDER BY day DESC) AS now FROM daily) SELECT sector, CASE WHEN count(*) FILTER (volume > now) = 0 THEN 'high' WHEN count(*) FILTER (volume < now) = 0 THEN 'low' ELSE 'middle' END AS place FROM l WHERE b <= 7 GROUP BY 1 HAVING count(*) = 7")
def seven_day_position(spark, d):
    w = Window.partitionBy("sector").orderBy(F.desc("day"))
    rows = M.daily_volume(articles(spark, d)).withColumn("b", F.row_number().over(w)).withColumn("now", F.first("volume").over(w)).where("b <= 7")
    place = F.when(F.count_if(F.col("volume") > F.col("now")) == 0, "high").when(F.count_if(F.col("volume") < F.col("now")) == 0, "low").otherwise("middle")
    return rows.groupBy("sector").agg(place.alias("place"), F.count("*").alias("n")).where("n = 7").drop("n")


@query(f"WITH t AS (SELECT doc_id, md5(text) AS url, {NORMAL.format('text')} AS title FROM documents) SELECT doc_id, (url <> '' AND row_number() OVER (PARTITION BY url ORDER BY doc_id) > 1) OR (title <> '' AND row_number() OVER (PARTITION BY title ORDER BY doc_id) > 1) AS duplicate FROM t")
def dup_marking(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.md5("text").alias("url"), X.normal_title(F.col("text")).alias("title"))
    return R.mark_duplicates(t, "url", "title", "doc_id").select("doc_id", "duplicate")


@query(f"WITH {ART}, {VOLUME} SELECT sector, round(CASE WHEN max(volume) OVER () = min(volume) OVER () THEN 50 ELSE 100 * (volume - min(volume) OVER ()) / (max(volume) OVER () - min(volume) OVER ()) END, 6) AS scaled FROM vol")
def minmax_scale(spark, d):
    v, w = M.attention_volume(spark, articles(spark, d)), Window.partitionBy(F.lit(1))
    low, high = F.min("volume").over(w), F.max("volume").over(w)
    return rounded(v.select("sector", F.when(high == low, 50.0).otherwise(100 * F.try_divide(F.col("volume") - low, high - low)).alias("scaled")))


@query(
    f"""WITH {ART}, {DAILY}, r AS (SELECT day, rank() OVER (PARTITION BY day ORDER BY volume) + (count(*) OVER (PARTITION BY day, volume) - 1) / 2.0 AS x, rank() OVER (PARTITION BY day ORDER BY articles) + (count(*) OVER (PARTITION BY day, articles) - 1) / 2.0 AS y FROM daily)
    SELECT day, round(CASE WHEN sum(abs(x - y)) = 0 THEN 1 WHEN stddev_pop(x) = 0 OR stddev_pop(y) = 0 THEN 0 ELSE corr(x, y) END, 6) AS spearman FROM r GROUP BY 1"""
)
def daily_spearman(spark, d):
    return rounded(E.daily_spearman(M.daily_volume(articles(spark, d)).select("day", F.col("volume").alias("x"), F.col("articles").alias("y"))))


@query(
    f"""WITH {ART}, {DAILY}, k AS (SELECT day, list(sector) FILTER (a <= 3) AS x, list(sector) FILTER (b <= 3) AS y FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY volume DESC, sector) AS a, row_number() OVER (PARTITION BY day ORDER BY articles DESC, sector) AS b FROM daily) GROUP BY 1)
    SELECT day, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS overlap FROM k"""
)
def topk_jaccard(spark, d):
    rank = lambda c: F.row_number().over(Window.partitionBy("day").orderBy(F.desc(c), "sector"))
    k = M.daily_volume(articles(spark, d)).withColumn("a", rank("volume")).withColumn("b", rank("articles"))
    sets = k.groupBy("day").agg(F.collect_set(F.when(F.col("a") <= 3, F.col("sector"))).alias("x"), F.collect_set(F.when(F.col("b") <= 3, F.col("sector"))).alias("y"))
    return rounded(sets.select("day", (F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("overlap")))


@query(f"WITH {ART} SELECT article_id, risk_intensity FROM art ORDER BY risk_intensity DESC, article_id LIMIT 20")
def top_articles(spark, d):
    return articles(spark, d).select("article_id", "risk_intensity").orderBy(F.desc("risk_intensity"), "article_id").limit(20)


@query(f"WITH {_metrics_sql(config.ENHANCED)}, u AS (UNPIVOT (SELECT sector, {', '.join(f'round({m}, 6) AS {m}' for m in config.METRICS)} FROM met) ON {', '.join(config.METRICS)} INTO NAME metric VALUE v) SELECT metric, sector, row_number() OVER (PARTITION BY metric ORDER BY v DESC, sector) AS place FROM u")
def sector_rankings(spark, d):
    u = sector_metrics_enhanced(spark, d).unpivot(["sector"], list(config.METRICS), "metric", "v")
    return u.select("metric", "sector", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("v"), "sector")).cast("long").alias("place"))


@query(f"WITH {ART}, {DAILY} SELECT c.sector, round(abs(c.volume - p.volume) + abs(c.articles - p.articles), 6) AS moved FROM daily c JOIN daily p ON c.sector = p.sector AND c.day = DATE '2024-01-20' AND p.day = DATE '2024-01-19' ORDER BY 2 DESC LIMIT 3")
def movers(spark, d):
    v = M.daily_volume(articles(spark, d))
    now, then = (v.where(F.col("day") == F.lit(x).cast("date")).select("sector", F.col("volume").alias(f"v{i}"), F.col("articles").alias(f"n{i}")) for i, x in ((1, "2024-01-20"), (0, "2024-01-19")))
    moved = F.abs(F.col("v1") - F.col("v0")) + F.abs(F.col("n1") - F.col("n0"))
    return rounded(now.join(then, "sector").select("sector", moved.alias("moved")).orderBy(F.desc("moved")).limit(3))


@query(f"WITH {ART}, f AS (SELECT article_id, publisher, sentiment_score FROM art WHERE sentiment_score > 0.05 QUALIFY row_number() OVER (PARTITION BY publisher ORDER BY sentiment_score DESC, article_id) = 1) SELECT article_id, sentiment_score FROM f ORDER BY sentiment_score DESC, article_id LIMIT 3")
def sentiment_extremes(spark, d):
    f = R.one_row_per_key(articles(spark, d).where("sentiment_score > 0.05"), ["publisher"], [F.desc("sentiment_score"), F.asc("article_id")])
    return f.select("article_id", "sentiment_score").orderBy(F.desc("sentiment_score"), "article_id").limit(3)


@query(f"WITH {ART}, f AS (SELECT article_id, sector, risk_intensity, row_number() OVER (PARTITION BY sector ORDER BY risk_intensity DESC, article_id) = 1 AS lead FROM art) SELECT article_id, sector FROM f ORDER BY lead DESC, risk_intensity DESC, article_id LIMIT 8")
def diverse_pick(spark, d):
    w = Window.partitionBy("sector").orderBy(F.desc("risk_intensity"), "article_id")
    return articles(spark, d).withColumn("lead", F.row_number().over(w) == 1).orderBy(F.desc("lead"), F.desc("risk_intensity"), "article_id").limit(8).select("article_id", "sector")


@query(f"WITH b AS (WITH {_metrics_sql(config.BASELINE)} SELECT sector, optimism FROM met), e AS (WITH {_metrics_sql(config.ENHANCED)} SELECT sector, optimism FROM met) SELECT sector, rank() OVER (ORDER BY round(e.optimism, 6) DESC) - rank() OVER (ORDER BY round(b.optimism, 6) DESC) AS change FROM b JOIN e USING (sector)")
def rank_changes(spark, d):
    b, e = (f(spark, d).select("sector", F.col("optimism").alias(n)) for f, n in ((sector_metrics_baseline, "b"), (sector_metrics_enhanced, "e")))
    place = lambda c: F.rank().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(c)))
    return b.join(e, "sector").select("sector", (place("e") - place("b")).cast("long").alias("change"))


# --- text ---


@query(f"SELECT doc_id, {NORMAL.format('text')} AS title FROM documents")
def normalize_title(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normal_title(F.col("text")).alias("title"))


@query(r"SELECT doc_id, len(list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?。！？]) ', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) AS sentences FROM documents")
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("sentences"))


@query("SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z0-9]+)?')), lambda t: length(t) > 1 AND t NOT IN ('the','and','of','that','with'))) AS tokens FROM documents")
def content_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.content_tokens(F.col("text"), STOP)).cast("long").alias("tokens"))


@query("SELECT doc_id, 'rss-' || left(sha1(source || '|' || text), 16) AS article_id FROM documents")
def article_id_sha1(spark, d):
    return table(spark, d, "documents").select("doc_id", X.record_id(F.col("source"), F.col("text")).alias("article_id"))


@query("SELECT source, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY 1")
def fingerprint_sha256(spark, d):
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), "\n")
    return table(spark, d, "documents").groupBy("source").agg(F.sha2(ids, 256).alias("fingerprint"))


@query("WITH h AS (SELECT source, sha256(doc_id::VARCHAR) AS h FROM documents), p AS (SELECT source, left(h, 3) AS k, sha256(string_agg(h, '' ORDER BY h)) AS p FROM h GROUP BY 1, 2) SELECT source, sha256(string_agg(p, '' ORDER BY k)) AS fingerprint, count(*) AS parts FROM p GROUP BY 1")
def fingerprint_tree(spark, d):
    return A.fingerprint(table(spark, d, "documents"), "doc_id", ("source",))


@query("SELECT page_id, '=HYPERLINK(\"' || replace(url, '\"', '\"\"') || '\",\"Open\")' AS link FROM pages")
def hyperlink(spark, d):
    return table(spark, d, "pages").select("page_id", X.hyperlink(F.col("url")).alias("link"))


@query(f"WITH {ART} SELECT article_id, round(exp(-greatest(epoch(max(published_at) OVER ()) - epoch(published_at), 0) / 3600 / 72), 6) AS weight FROM art")
def time_weight(spark, d):
    a = articles(spark, d).select("article_id", "published_at")
    return rounded(a.crossJoin(F.broadcast(a.agg(F.max("published_at").alias("now")))).select("article_id", S.time_weight(F.col("published_at"), F.col("now")).alias("weight")))


@query(f"WITH {ART} SELECT article_id, round(entropy_norm, 6) AS entropy FROM art")
def entropy_norm(spark, d):
    return rounded(articles(spark, d).select("article_id", F.col("entropy_norm").alias("entropy")))


@query(f"WITH {ART} SELECT article_id, round(exp(b_bull) / (exp(b_bull) + exp(b_bear) + exp(k_unc)), 6) AS first, round(exp(k_unc) / (exp(b_bull) + exp(b_bear) + exp(k_unc)), 6) AS last FROM art")
def softmax(spark, d):
    p = X.softmax([F.col("b_bull"), F.col("b_bear"), F.col("k_unc")])
    return rounded(articles(spark, d).select("article_id", p[0].alias("first"), p[2].alias("last")))


PADDED = "' ' || trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')) || ' '"


@query(f"SELECT doc_id, array_to_string(list_filter(['the','of the','and','mit'], lambda t: contains({PADDED.format('text')}, ' ' || t || ' ')), ';') AS terms FROM documents")
def token_match(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.matched_terms(F.col("text"), ["the", "of the", "and", "mit"]), ";").alias("terms"))


@query(
    rf"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?。！？]) ', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS p FROM documents)
    SELECT doc_id, round(CASE WHEN len(p) > 0 THEN least(3.0 * len(list_filter(p, lambda s: (contains({PADDED.format('s')}, ' of ') OR contains({PADDED.format('s')}, ' with ')) AND NOT contains({PADDED.format('s')}, ' and '))) / len(p), 1) ELSE 0 END, 6) AS score FROM s"""
)
def sentence_hit_score(spark, d):
    parts = table(spark, d, "documents").select("doc_id", X.sentences(F.col("text")).alias("p"))
    return rounded(parts.select("doc_id", X.hit_score(F.col("p"), ["of", "with"], ["and"]).alias("score")))


@query("SELECT doc_id, (length(text) - length(replace(text, 'th', ''))) / 2 + (length(text) - length(replace(text, 'ing', ''))) / 3 AS n FROM documents".replace("/ 2", "// 2").replace("/ 3", "// 3"))
def substring_count(spark, d):
    return table(spark, d, "documents").select("doc_id", X.count_terms(F.col("text"), ["th", "ing"]).alias("n"))


@query("SELECT doc_id, CASE WHEN a >= greatest(b, c) AND a > 0 THEN 'conjunction' WHEN b >= c AND b > 0 THEN 'article' WHEN c > 0 THEN 'other' ELSE 'none' END AS topic FROM (SELECT doc_id, contains(lower(text), 'and')::INT + contains(lower(text), 'with')::INT AS a, contains(lower(text), 'the')::INT + contains(lower(text), 'der')::INT AS b, contains(lower(text), 'que')::INT AS c FROM documents)")
def topic_choice(spark, d):
    return table(spark, d, "documents").select("doc_id", X.best_label(F.col("text"), TOPICS, "none").alias("topic"))


@query(f"WITH {ART} SELECT article_id, round(100 * (1 - (1 - 5 / 5.0 * least(b_bear, 1)) * (1 - 3 / 5.0 * least(s_shock, 1)) * (1 - 2 / 5.0 * least(k_unc, 1))), 6) AS risk FROM art")
def risk_noisy_or(spark, d):
    risks = F.array(*(F.struct(F.lit(float(s)).alias("severity"), F.col(c).alias("strength")) for s, c in ((5, "b_bear"), (3, "s_shock"), (2, "k_unc"))))
    return rounded(articles(spark, d).select("article_id", S.noisy_or(risks).alias("risk")))


@query(f"WITH {ART} SELECT article_id, {', '.join(f'round(100 * greatest(0, least(1, ' + ' + '.join(f'{w} * {c}' for c, w in config.ENHANCED[dim].items()) + f')), 6) AS {dim}' for dim in ('optimism', 'fear', 'uncertainty'))} FROM art")
def article_formulas(spark, d):
    return rounded(articles(spark, d).select("article_id", *(c.alias(k) for k, c in S.article_formulas(config.ENHANCED).items())))


@query("SELECT doc_id, replace(replace(text, 'Th', ''''), chr(65533), '') = replace(text, 'Th', '''') AS same FROM documents")
def mojibake(spark, d):
    damaged = F.replace("text", F.lit("Th"), F.lit("â€™"))
    return table(spark, d, "documents").select("doc_id", (X.repair_mojibake(damaged) == F.replace("text", F.lit("Th"), F.lit("'"))).alias("same"))


# --- similarity, evaluation, pipelines ---


@query(
    """WITH t AS (SELECT item_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS k FROM benchmark WHERE len(regexp_extract_all(lower(text), '[a-z0-9]+')) > 0)
    SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.k, y.k)) / len(list_distinct(list_concat(x.k, y.k))), 6) AS similarity FROM t x JOIN t y ON x.id < y.id WHERE len(list_intersect(x.k, y.k)) >= 0.2 * len(list_distinct(list_concat(x.k, y.k)))"""
)
def jaccard_pairs(spark, d):
    t = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("tokens")).where("size(tokens) > 0")
    return rounded(R.jaccard_pairs(t, 0.2))


@query("SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.3")
def cosine_pairs(spark, d):
    return R.vector_pairs(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector")), 0.3)


@query(None)
def event_clusters(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.array("user_id").alias("entities"))
    component = e.select("id", F.col("entities")[0].alias("component"))
    return R.constrained_clusters(R.range_overlap_pairs(e), e.select("id", "at"), component)


@query(None)
def similar_reprint(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), X.normal_title(F.col("text")).alias("title"))
    return R.similar_reprints(t)


PRED = f"{ART}, pr AS (SELECT CASE WHEN sentiment_score > 0.05 THEN 'positive' WHEN sentiment_score < -0.05 THEN 'negative' ELSE 'neutral' END AS actual, CASE WHEN p_positive >= p_neutral AND p_positive >= p_negative THEN 'positive' WHEN p_neutral >= p_negative THEN 'neutral' ELSE 'negative' END AS predicted, greatest(p_positive, p_neutral, p_negative) AS confidence, * FROM art)"


def _predicted(spark, d) -> DataFrame:
    p, n, m = F.col("p_positive"), F.col("p_neutral"), F.col("p_negative")
    best = F.when((p >= n) & (p >= m), "positive").when(n >= m, "neutral").otherwise("negative")
    return articles(spark, d).withColumns({"actual": S.sentiment_label(F.col("sentiment_score")), "predicted": best, "confidence": F.greatest(p, n, m)})


@query(f"WITH {PRED} SELECT actual, count(*) FILTER (predicted = 'positive') AS positive, count(*) FILTER (predicted = 'neutral') AS neutral, count(*) FILTER (predicted = 'negative') AS negative FROM pr GROUP BY 1")
def confusion_matrix(spark, d):
    return E.confusion(_predicted(spark, d), spark)


@query(
    f"""WITH {PRED}, c AS (SELECT label, count(*) FILTER (actual = label AND predicted = label) AS tp, count(*) FILTER (actual = label) AS support, count(*) FILTER (predicted = label) AS g FROM pr, (SELECT unnest(['positive','neutral','negative']) AS label) GROUP BY 1)
    SELECT label, round(tp / g, 6) AS precision, round(tp / support, 6) AS recall, round(2.0 * tp / (g + support), 6) AS f1, support FROM c"""
)
def classification_report(spark, d):
    return rounded(E.class_report(_predicted(spark, d), spark))


@query(f"WITH {PRED} SELECT CAST(least(floor(confidence * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0 END), 6) AS accuracy FROM pr GROUP BY 1")
def calibration_bins(spark, d):
    return rounded(E.calibration(_predicted(spark, d).select("confidence", (F.col("actual") == F.col("predicted")).cast("int").alias("correct"))))


@query(f"WITH {PRED} SELECT round(avg((p_positive - (actual = 'positive')::INT) ** 2 + (p_neutral - (actual = 'neutral')::INT) ** 2 + (p_negative - (actual = 'negative')::INT) ** 2), 6) AS brier FROM pr")
def brier(spark, d):
    off = [F.pow(F.col(f"p_{v}") - (F.col("actual") == v).cast("int"), 2) for v in E.LABELS]
    return rounded(_predicted(spark, d).agg(F.avg(off[0] + off[1] + off[2]).alias("brier")))


@query("SELECT quality, count(*) AS n, round(avg(toxic), 6) AS toxic_share FROM labels GROUP BY 1")
def binary_quality(spark, d):
    return rounded(table(spark, d, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.avg(F.col("toxic").cast("double")).alias("toxic_share")))


@query(f"WITH {PRED} SELECT article_id, actual, predicted FROM pr WHERE actual <> predicted")
def error_sample(spark, d):
    return _predicted(spark, d).where("actual <> predicted").select("article_id", "actual", "predicted")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('5720:' || doc_id), doc_id) AS k FROM documents) ORDER BY k, md5('5720:' || source), source LIMIT 100")
def stratified_sample(spark, d):
    return E.stratified_sample(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 100, 5720)


REPLAY_DAYS = 10
_PLAIN = ("p_positive", "p_neutral", "p_negative", "b_bull", "b_bear", "g_growth", "s_shock", "k_unc", "entropy_norm")
PARTS = f"""{ART}, {GROUP_ROWS}, mean AS (SELECT day, sector, {', '.join(f'sum({c} * agg_weight) / sum(agg_weight) AS {c}' for c in _PLAIN)},
  CASE WHEN count(*) < 2 THEN 0 ELSE 2 * least(sum(CASE WHEN sentiment_score > 0.15 THEN agg_weight ELSE 0 END), sum(CASE WHEN sentiment_score < -0.15 THEN agg_weight ELSE 0 END)) / sum(agg_weight) END AS polarity_mix,
  CASE WHEN count(*) < 2 THEN 0 ELSE sqrt(greatest(sum(agg_weight * sentiment_score * sentiment_score) / sum(agg_weight) - (sum(agg_weight * sentiment_score) / sum(agg_weight)) ** 2, 0)) END AS weighted_std FROM art GROUP BY 1, 2),
apart AS (SELECT x.day, x.sector, sum(x.agg_weight * y.agg_weight * abs(x.sentiment_score - y.sentiment_score)) / (2 * sum(x.agg_weight * y.agg_weight)) AS distance FROM art x JOIN art y ON x.day = y.day AND x.sector = y.sector AND x.article_id < y.article_id GROUP BY 1, 2),
rep AS (SELECT * FROM art QUALIFY row_number() OVER (PARTITION BY day, event_key ORDER BY agg_weight DESC, article_id) = 1),
cum AS (SELECT *, sum(agg_weight) OVER (PARTITION BY day, sector ORDER BY risk_intensity RANGE UNBOUNDED PRECEDING) AS c, sum(agg_weight) OVER (PARTITION BY day, sector) AS t FROM rep),
risk AS (SELECT day, sector, sum(risk_intensity * agg_weight) / sum(agg_weight) AS weighted_mean, CASE WHEN count(*) < 3 THEN sum(risk_intensity * agg_weight) / sum(agg_weight) ELSE min(CASE WHEN c >= 0.9 * t - 1e-12 THEN risk_intensity END) END AS p90 FROM cum GROUP BY 1, 2),
filled AS (SELECT y.day, dom.sector, coalesce(sum(agg_weight), 0) AS volume FROM (SELECT DISTINCT day FROM art) y CROSS JOIN dom LEFT JOIN art ON art.day = y.day AND art.sector = dom.sector GROUP BY 1, 2),
grown AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY day) AS n, avg(volume) OVER (PARTITION BY sector ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m, (rank() OVER (PARTITION BY day ORDER BY volume) + (count(*) OVER (PARTITION BY day, volume) - 1) / 2.0 - 0.5) / 6 AS place FROM filled),
growth AS (SELECT *, CASE WHEN n > 7 THEN (volume - m) / (m + 1) END AS growth FROM grown),
att AS (SELECT a.day, a.sector, CASE WHEN a.n > {REPLAY_DAYS} THEN (SELECT count(*) FILTER (b.volume <= a.volume) / count(*) FROM growth b WHERE b.sector = a.sector AND b.day < a.day) ELSE a.place END AS volume_ecdf,
  CASE WHEN a.n > {REPLAY_DAYS} THEN coalesce((SELECT count(*) FILTER (b.growth <= a.growth) / count(b.growth) FROM growth b WHERE b.sector = a.sector AND b.day < a.day), 0) ELSE a.place END AS growth_ecdf FROM growth a),
parts AS (SELECT att.day, att.sector, volume_ecdf, growth_ecdf, {', '.join(f'coalesce({c}, 0) AS {c}' for c in (*_PLAIN, 'polarity_mix', 'weighted_std', 'distance', 'weighted_mean', 'p90'))} FROM att LEFT JOIN mean USING (day, sector) LEFT JOIN apart USING (day, sector) LEFT JOIN risk USING (day, sector))"""


def _score_sql(dimension: str, weights: dict) -> str:
    return f"greatest(0, least(100, {P.SCALE[dimension]} * ({' + '.join(f'{w!r} * {c}' for c, w in weights[dimension].items())})))"


@query(f"WITH {PARTS} SELECT day, sector, {', '.join(f'round({_score_sql(m, P.all_weights())}, 6) AS {m}' for m in config.METRICS if m != 'disagreement')}, round(100 * distance, 6) AS disagreement FROM parts")
def daily_replay(spark, d):
    """Six metrics of every day and group, attention against the days before."""
    return rounded(P.replay(spark, articles(spark, d), history_days=REPLAY_DAYS))


@query(
    f"""WITH {PARTS}, v AS (SELECT day, sector, unnest([{', '.join(f"{{'dimension': '{m}', 'component': '{c}', 'factor': {f}::DOUBLE, 'x': round({_score_sql(m, P.all_weights())}, 9), 'y': round({_score_sql(m, w)}, 9)}}" for m, c, f, w in P.variants())}]) AS v FROM parts),
    e AS (SELECT day, sector, v.dimension, v.component, v.factor, v.x, v.y FROM v),
    r AS (SELECT *, rank() OVER (PARTITION BY dimension, component, factor, day ORDER BY x DESC) + (count(*) OVER (PARTITION BY dimension, component, factor, day, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY dimension, component, factor, day ORDER BY y DESC) + (count(*) OVER (PARTITION BY dimension, component, factor, day, y) - 1) / 2.0 AS ry,
      row_number() OVER (PARTITION BY dimension, component, factor, day ORDER BY x DESC, sector) <= 3 AS ix, row_number() OVER (PARTITION BY dimension, component, factor, day ORDER BY y DESC, sector) <= 3 AS iy FROM e),
    g AS (SELECT dimension, component, factor, day, CASE WHEN sum(abs(rx - ry)) = 0 THEN 1 WHEN var_pop(rx) = 0 OR var_pop(ry) = 0 THEN 0 ELSE covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) END AS s, count(*) FILTER (ix AND iy) / count(*) FILTER (ix OR iy) AS j, sum(abs(x - y)) AS moved, count(*) AS n FROM r GROUP BY ALL)
    SELECT dimension, component, factor, count(*) AS day_count, sum(n)::BIGINT AS sector_day_count, round(avg(s), 6) AS mean_daily_spearman, round(sum(moved) / sum(n), 6) AS mean_absolute_score_change, round(avg(j), 6) AS mean_daily_top3_jaccard FROM g GROUP BY 1, 2, 3"""
)
def sensitivity_sweep(spark, d):
    """All components of all dimensions at five factors."""
    a = articles(spark, d)
    return rounded(P.sweep(spark, P.components(spark, P.prepared(a), history_days=REPLAY_DAYS)))


@query(f"WITH {_metrics_sql(config.ENHANCED)} SELECT round(avg(optimism), 6) AS optimism, round(avg(risk_intensity), 6) AS risk, arg_max(sector, round(risk_intensity, 6)) AS riskiest, sum(articles)::BIGINT AS articles FROM met")
def brief_payload(spark, d):
    m = M.sector_metrics(spark, articles(spark, d), config.ENHANCED)
    return rounded(m.agg(F.avg("optimism").alias("optimism"), F.avg("risk_intensity").alias("risk"), F.max_by("sector", F.round("risk_intensity", 6)).alias("riskiest"), F.sum("articles").alias("articles")))


@query(f"SELECT * FROM (WITH {_metrics_sql(config.BASELINE)} SELECT 'baseline' AS formula, sector, {_ROUND6} FROM met) UNION ALL SELECT * FROM (WITH {_metrics_sql(config.ENHANCED)} SELECT 'enhanced' AS formula, sector, {_ROUND6} FROM met)")
def daily_snapshots(spark, d):
    return rounded(M.snapshot(spark, articles(spark, d)).select("formula", "sector", *config.METRICS))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_volume(spark, d):
    from quillmesh.streaming.volume import daily_volume_stream

    return daily_volume_stream(spark, d)


# --- tagging and sentiment ---

RULES = [T.RiskRule("credit risk", 5, ["of the"]), T.RiskRule("demand risk", 3, [], ["that", "with", "mit"], 2)]
KNOWN = [T.Entity("Alpha", "The", "first", ["die"]), T.Entity("Beta", "Que", "second", ["with"])]
LEXICON = {"positive": ["ing"], "negative": ["ed"], "uncertainty": ["or"]}
SENTENCES = r"""s AS (SELECT doc_id, source, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?。！？]) ', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS p FROM documents)"""


def _has(term: str, of: str = "x") -> str:
    return f"contains({PADDED.format(of)}, ' {term} ')"


@query(
    f"""WITH {SENTENCES}, h AS (SELECT doc_id, len(p) AS n, len(list_filter(p, lambda x: {_has('of the')})) AS a,
    (len(list_filter(p, lambda x: {_has('that')})) > 0)::INT + (len(list_filter(p, lambda x: {_has('with')})) > 0)::INT + (len(list_filter(p, lambda x: {_has('mit')})) > 0)::INT AS d,
    len(list_filter(p, lambda x: {_has('that')} OR {_has('with')} OR {_has('mit')})) AS b FROM s),
    r AS (SELECT doc_id, CASE WHEN a > 0 THEN least(3.0 * a / n, 1) ELSE 0 END AS x, CASE WHEN d >= 2 THEN least(3.0 * b / n, 1) ELSE 0 END AS y FROM h)
    SELECT doc_id, concat_ws(';', CASE WHEN x > 0 THEN 'credit risk' END, CASE WHEN y > 0 THEN 'demand risk' END) AS categories, round(100 * (1 - (1 - x) * (1 - 0.6 * y)), 6) AS risk FROM r"""
)
def risk_tags(spark, d):
    parts = table(spark, d, "documents").select("doc_id", X.sentences(F.col("text")).alias("p"))
    tagged = parts.select("doc_id", T.risk_tags(F.col("p"), RULES).alias("t"))
    return rounded(tagged.select("doc_id", F.array_join(F.transform("t", lambda x: x["category"]), ";").alias("categories"), T.risk_intensity(F.col("t")).alias("risk")))


def _term_sql(term: str, flags: str = "") -> str:
    return f"regexp_matches(text, '{flags}(^|[^A-Za-z0-9]){term}($|[^A-Za-z0-9])')"


@query(f"SELECT doc_id, concat_ws(';', CASE WHEN {_term_sql('The')} OR {_term_sql('die', '(?i)')} THEN 'Alpha' END, CASE WHEN {_term_sql('Que')} OR {_term_sql('with', '(?i)')} THEN 'Beta' END) AS names FROM documents")
def entity_detect(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(T.entities(F.col("text"), KNOWN), lambda e: e["name"]), ";").alias("names"))


_BENCH_TERMS = """w AS (SELECT string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM benchmark), terms AS (SELECT DISTINCT term FROM (SELECT unnest(w) AS term FROM w UNION ALL SELECT w[1] || ' ' || w[2] || ' ' || w[3] FROM w) WHERE length(term) > 2)"""


def _bench_terms(spark, d) -> DataFrame:
    """Words of the benchmark, and the first three of each item as a phrase."""
    words = F.split(X.keyword_form(F.col("text")), " ")
    return table(spark, d, "benchmark").select(F.explode(F.concat(words, F.array(F.array_join(F.slice(words, 1, 3), " ")))).alias("term")).where("length(term) > 2").distinct()


@query(f"WITH {_BENCH_TERMS}, p AS (SELECT doc_id, {PADDED.format('text')} AS p FROM documents) SELECT doc_id, count(*) AS n, min(term) AS first FROM p JOIN terms ON contains(p, ' ' || term || ' ') GROUP BY doc_id")
def dictionary_terms(spark, d):
    """Documents with the terms of a dictionary of some thousand, found in one pass."""
    terms = sorted(r.term for r in L.listed(_bench_terms(spark, d), "term"))
    found = table(spark, d, "documents").select("doc_id", F.get(L.phrases(F.array(X.padded(F.col("text"))), terms), F.lit(0)).alias("k"))
    names = F.from_json(F.lit(json.dumps(terms)), "array<string>")
    return found.where("size(k) > 0").select("doc_id", F.size("k").cast("long").alias("n"), F.get(names, F.col("k")[0]).alias("first"))


@query(
    f"""WITH {_BENCH_TERMS}, t AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents), g AS (SELECT doc_id, w[i] AS one, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS three FROM t, unnest(generate_series(1, len(w))) AS x(i))
    SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, one AS term FROM g UNION ALL SELECT doc_id, three FROM g) JOIN terms USING (term) GROUP BY ALL"""
)
def dictionary_join(spark, d):
    """The same dictionary as a table of any size, joined by word n-grams."""
    return L.joined(table(spark, d, "documents"), "doc_id", "text", _bench_terms(spark, d), "term")


LEX = f"""{SENTENCES}, q AS (SELECT doc_id, i, lower(x) AS x FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM s)),
v AS (SELECT doc_id, i, 0.4 + 1.2 * ((length(x) - length(replace(x, 'ing', ''))) // 3) AS a, 0.8 + 0.5 * ((length(x) - length(replace(x, 'or', ''))) // 2) AS b, 0.4 + 1.2 * ((length(x) - length(replace(x, 'ed', ''))) // 2) AS e FROM q),
c AS (SELECT doc_id, i, exp(a - greatest(a, b, e)) AS a, exp(b - greatest(a, b, e)) AS b, exp(e - greatest(a, b, e)) AS e FROM v),
l AS (SELECT doc_id, i, a / (a + b + e) AS pos, b / (a + b + e) AS neu, e / (a + b + e) AS neg FROM c)"""


@query(f"WITH {LEX} SELECT doc_id, i AS place, round(pos - neg, 6) AS score, round(greatest(pos, neu, neg), 6) AS confidence FROM l")
def lexicon_sentence(spark, d):
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(T.lexicon_sentences(X.sentences(F.col("text")), LEXICON)).alias("i", "s"))
    scored = parts.select("doc_id", (F.col("i") + 1).cast("long").alias("place"), "s")
    return rounded(scored.select("doc_id", "place", "s.score", "s.confidence"))


@query(f"WITH {LEX} SELECT doc_id, round(sum(pos * greatest(pos, neu, neg)) / sum(greatest(pos, neu, neg)), 6) AS positive, round(sum((pos - neg) * greatest(pos, neu, neg)) / sum(greatest(pos, neu, neg)), 6) AS score FROM l GROUP BY 1")
def article_sentiment(spark, d):
    parts = table(spark, d, "documents").select("doc_id", T.lexicon_sentences(X.sentences(F.col("text")), LEXICON).alias("s")).where("size(s) > 0")
    return rounded(parts.select("doc_id", T.article_sentiment(F.col("s"), F.lit("")).alias("a")).select("doc_id", "a.positive", "a.score"))


@query(f"WITH {SENTENCES} SELECT doc_id, round(CASE WHEN len(p) = 0 THEN 0 ELSE least(3.0 * len(list_filter(p, lambda x: {_has('of')} AND NOT {_has('and')})) / len(p), 1) END, 6) AS b_bull, round(CASE WHEN len(p) = 0 THEN 0 ELSE least(3.0 * len(list_filter(p, lambda x: {_has('der')})) / len(p), 1) END, 6) AS b_bear FROM s")
def signal_components(spark, d):
    parts = table(spark, d, "documents").select("doc_id", X.sentences(F.col("text")).alias("p"))
    return rounded(parts.select("doc_id", X.hit_score(F.col("p"), ["of"], ["and"]).alias("b_bull"), X.hit_score(F.col("p"), ["der"]).alias("b_bear")))


@query(
    f"""WITH {ART}, l AS (SELECT unnest([0, 1, 2]) AS label), f AS (SELECT label, article_id % 3 = label OR user_id % 4 = label AS t, article_id % 5 = label OR user_id % 4 = label AS p FROM art, l), c AS (SELECT label, count(*) FILTER (t AND p) AS tp, count(*) FILTER (t) AS support, count(*) FILTER (p) AS guessed FROM f GROUP BY 1)
    SELECT label, round(tp / guessed, 6) AS precision, round(tp / support, 6) AS recall, round(2.0 * tp / (guessed + support), 6) AS f1 FROM c"""
)
def multilabel_report(spark, d):
    i, u = F.col("article_id"), F.col("user_id")
    sets = articles(spark, d).select(F.array(i % 3, u % 4).alias("t"), F.array(i % 5, u % 4).alias("p"))
    flags = F.explode(F.array(*(F.struct(F.lit(k).alias("label"), F.array_contains("t", F.lit(k).cast("long")).alias("t"), F.array_contains("p", F.lit(k).cast("long")).alias("p")) for k in range(3))))
    c = sets.select(flags.alias("x")).groupBy("x.label").agg(F.count_if(F.col("x.t") & F.col("x.p")).alias("tp"), F.count_if("x.t").alias("s"), F.count_if("x.p").alias("g"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return rounded(c.select("label", zero(F.try_divide("tp", "g")).alias("precision"), zero(F.try_divide("tp", "s")).alias("recall"), zero(F.try_divide(2 * F.col("tp"), F.col("g") + F.col("s"))).alias("f1")))


@query(
    f"""WITH {ART}, r AS (SELECT *, row_number() OVER (PARTITION BY md5(publisher || sector) ORDER BY agg_weight DESC, article_id) AS k FROM art WHERE published_at >= (SELECT max(published_at) FROM art) - INTERVAL 24 HOURS AND (risk_intensity >= 60 OR abs(sentiment_score) >= 0.5) AND article_id NOT IN (SELECT doc_id FROM documents))
    SELECT article_id FROM r WHERE k = 1 ORDER BY risk_intensity DESC, abs(sentiment_score) DESC, agg_weight DESC, article_id LIMIT 30"""
)
def fulltext_candidates(spark, d):
    a = articles(spark, d)
    newest = F.broadcast(a.agg(F.max("published_at").alias("m")))
    today = a.crossJoin(newest).where(F.col("published_at") >= F.col("m") - F.expr("INTERVAL 24 HOURS")).where((F.col("risk_intensity") >= 60) | (F.abs("sentiment_score") >= 0.5))
    fresh = today.join(table(spark, d, "documents").select(F.col("doc_id").alias("article_id")), "article_id", "left_anti")
    one = R.one_row_per_key(fresh, ["publisher", "sector"], [F.desc("agg_weight"), F.asc("article_id")])
    return one.orderBy(F.desc("risk_intensity"), F.desc(F.abs("sentiment_score")), F.desc("agg_weight"), "article_id").limit(30).select("article_id")


@query(
    f"""WITH {ART}, f AS (SELECT unnest(['p_positive', 'b_bull', 'g_growth']) AS component, unnest([1, 0, 0]) AS x, unnest([0, 1, 0]) AS y, unnest([0, 0, 1]) AS z),
    s AS (SELECT component, day, sector, sum(agg_weight * abs((0.7 * p_positive + 0.2 * b_bull + 0.1 * g_growth) - (0.7 * (1 - x) * p_positive + 0.2 * (1 - y) * b_bull + 0.1 * (1 - z) * g_growth) / (1 - 0.7 * x - 0.2 * y - 0.1 * z))) / sum(agg_weight) AS off FROM art, f GROUP BY ALL)
    SELECT component, round(100 * avg(off), 6) AS moved FROM s GROUP BY 1 ORDER BY 2 DESC LIMIT 1"""
)
def most_sensitive(spark, d):
    weights = config.ENHANCED["optimism"]
    whole = sum(w * F.col(c) for c, w in weights.items())
    a = W.with_safe_weight(articles(spark, d), ["day", "sector"])
    moved = {k: F.abs(whole - sum(w * F.col(c) for c, w in weights.items() if c != k) / (1 - weights[k])) for k in weights}
    s = a.groupBy("day", "sector").agg(*(W.wmean(v).alias(k) for k, v in moved.items())).unpivot(["day", "sector"], list(weights), "component", "off")
    return rounded(s.groupBy("component").agg((100 * F.avg("off")).alias("moved")).orderBy(F.desc("moved")).limit(1))


@query(r"SELECT page_id, length(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS n FROM pages")
def strip_html(spark, d):
    bare = F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), r"[ \t\n\r]+", " ")
    return table(spark, d, "pages").select("page_id", F.length(bare).cast("long").alias("n"))


# --- enrichment ---

SECTOR_WORDS = {"first": ["ing", "zz"], "second": ["und", "der"], "third": ["que", "el "]}
WORDS = N.Dictionaries(companies=KNOWN, sectors=SECTOR_WORDS, topics=[N.Topic(k, v) for k, v in TOPICS.items()], risks=RULES, lexicon=LEXICON, signals={"bull": ["of"], "bear": ["der"], "blockers": ["and"]}, sources={"src1": 0.5, "src2": 0.8})


def _collapsed(of: str) -> str:
    return rf"trim(regexp_replace({of}, '\s+', ' ', 'g'))"


def _hits(terms: list[str], of: str) -> str:
    return " + ".join(f"contains({of}, '{t}')::INT" for t in terms)


_BY_WORD = f"""h AS (SELECT doc_id, text, {', '.join(f"{_hits(v, 'low')} AS {k}" for k, v in SECTOR_WORDS.items())} FROM (SELECT doc_id, text, lower({_collapsed('text')}) AS low FROM documents)),
k AS (SELECT doc_id, text, CASE WHEN greatest(first, second, third) = 0 THEN '' WHEN first >= second AND first >= third THEN 'first' WHEN second >= third THEN 'second' ELSE 'third' END AS sector FROM h)"""


@query(f"WITH {_BY_WORD} SELECT doc_id, sector FROM k")
def keyword_sector(spark, d):
    return table(spark, d, "documents").select("doc_id", N.keyword_sector(F.col("text"), SECTOR_WORDS).alias("sector"))


@query(
    f"""WITH {_BY_WORD}, m AS (SELECT doc_id, sector, {_term_sql('The')} OR {_term_sql('die', '(?i)')} AS a, {_term_sql('Que')} OR {_term_sql('with', '(?i)')} AS b FROM k)
    SELECT doc_id, concat_ws(';', CASE WHEN a THEN 'Alpha' END, CASE WHEN b THEN 'Beta' END) AS companies, CASE WHEN a THEN 'first' WHEN b THEN 'second' WHEN sector <> '' THEN sector ELSE 'Unmapped' END AS sector,
    CASE WHEN a OR b THEN 'company_or_ticker' WHEN sector <> '' THEN 'topic_only' ELSE 'unmapped' END AS method, CASE WHEN a OR b THEN 1.0 WHEN sector <> '' THEN 0.7 ELSE 0.5 END::DOUBLE AS relevance FROM m"""
)
def article_mapping(spark, d):
    return N.with_mapping(table(spark, d, "documents").select("doc_id", "text"), "text", WORDS).select("doc_id", "map_.companies", "map_.sector", "map_.method", "map_.relevance")


def _records(spark, d) -> DataFrame:
    """Documents as collected records."""
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("article_id"), F.col("source").alias("title"), F.col("lang").alias("summary"), F.col("text").alias("content"), F.concat(F.lit("http://x/"), F.col("doc_id")).alias("url"), F.concat(F.lit("src"), F.col("doc_id") % 4, F.lit(";src"), F.col("doc_id") % 3).alias("source"), F.lit("2024-01-02T00:00:00Z").alias("published_at"), F.lit("2024-01-03").alias("collected_at"))


def _key(of: str) -> str:
    return f"trim(regexp_replace(lower({of}), '[^a-z0-9]+', ' ', 'g'))"


def _sentence(of: str) -> str:
    return f"CASE WHEN right({of}, 1) IN ('.', '!', '?') THEN {of} ELSE {of} || '.' END"


_TEXTS = f"""t AS (SELECT doc_id, trim(source) AS a, trim(lang) AS b, trim(text, ' ') AS c FROM documents), v AS (SELECT *, {_key('a')} AS x, {_key('b')} AS y, {_key('c')} AS z FROM t)"""


@query(
    f"""WITH {_TEXTS} SELECT doc_id, md5(concat_ws(' ', CASE WHEN x <> '' THEN {_sentence('a')} END, CASE WHEN y <> '' AND y <> x THEN {_sentence('b')} END, CASE WHEN z <> '' AND z <> x AND z <> y THEN {_sentence('c')} END)) AS summary_text,
    CASE WHEN lower(a) = lower(b) THEN a ELSE trim(a || ' ' || b) END AS event_text FROM v"""
)
def text_variants(spark, d):
    r = _records(spark, d).withColumns({c: F.lit("") for c in ("body_text", "companies", "tickers")})
    return r.select(F.col("article_id").cast("long").alias("doc_id"), F.md5(V.variants()["summary_text"]).alias("summary_text"), V.event_text(F.col("title"), F.col("summary")).alias("event_text"))


@query(
    f"""WITH t AS (SELECT doc_id, trim(text, ' ') AS s, trim(CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN upper(left(text, 12)) ELSE 'other' END, ' ') AS t FROM documents), r AS (SELECT *, ltrim(substr(s, length(t) + 1), ' .:-') AS rest FROM t)
    SELECT doc_id, md5(CASE WHEN {_key('t')} <> '' AND {_key('s')} = {_key('t')} THEN '' WHEN t <> '' AND starts_with(lower(s), lower(t)) AND {_key('rest')} <> '' THEN rest ELSE s END) AS evidence FROM r"""
)
def evidence_without_title(spark, d):
    i, text = F.col("doc_id"), F.col("text")
    title = F.when(i % 3 == 0, text).when(i % 3 == 1, X.upper_letters(F.substring(text, 1, 12))).otherwise("other")
    return table(spark, d, "documents").select("doc_id", F.md5(V.without_title(text, title)).alias("evidence"))


@query("SELECT event_id, greatest(CASE event_id % 20 WHEN 1 THEN 0.5 WHEN 2 THEN 0.8 ELSE 1.0 END, CASE user_id % 20 WHEN 1 THEN 0.5 WHEN 2 THEN 0.8 ELSE 1.0 END)::DOUBLE AS weight, event_id % 20 IN (1, 3) OR user_id % 20 IN (1, 3) AS allowed FROM events")
def source_weights(spark, d):
    names = F.concat(F.lit("src"), F.col("event_id") % 20, F.lit(";src"), F.col("user_id") % 20)
    return table(spark, d, "events").select("event_id", V.greatest_weight(names, WORDS.sources).alias("weight"), V.any_listed(names, ["src1", "src3"]).alias("allowed"))


@query(
    f"""WITH {ART}, n AS (SELECT max(published_at) AS t FROM art) SELECT article_id, round(exp(-epoch(t - published_at) / 3600 / 72.0), 6) AS time_weight,
    round(exp(-epoch(t - published_at) / 3600 / 72.0) * CASE WHEN sector = 'error' THEN 0.5 ELSE 1.0 END * CASE WHEN article_id % 4 = 0 THEN 0.3 ELSE 1.0 END * CASE WHEN source = 'src1' THEN 0.5 WHEN source = 'src2' THEN 0.8 ELSE 1.0 END, 6) AS weight FROM art, n"""
)
def article_scores(spark, d):
    """Time weight, and its product with relevance, duplicate and source weights."""
    a = articles(spark, d)
    rows = a.crossJoin(F.broadcast(a.agg(F.max("published_at").alias("t")))).withColumn("time_weight", S.time_weight(F.col("published_at"), F.col("t")))
    rows = rows.withColumns({"relevance_weight": F.when(F.col("sector") == "error", N.UNMAPPED_WEIGHT).otherwise(N.BY_COMPANY), "dedup_factor": F.when(F.col("article_id") % 4 == 0, "0.3").otherwise(""), "source_weight": F.lit("")})
    return rounded(N.backfill_sources(rows, WORDS).select("article_id", "time_weight", F.col("agg_weight").alias("weight")))


@query(None)
def enriched_batch(spark, d):
    """The full batch over all documents; its parts are held against SQL, its rows against hand-made cases in the tests."""
    now = F.lit("2024-01-05T00:00:00Z").cast("timestamp")
    out = N.batch(_records(spark, d), WORDS, now)
    return rounded(out.select("article_id", "sector", "topic", "risk_category", "companies", "dedup_status", "sentiment_score", "optimism", "fear", "uncertainty", "risk_intensity", "agg_weight", "evidence_sentence"))


@query("SELECT doc_id::VARCHAR AS article_id, 'src' || (doc_id % 4) || ';src' || (doc_id % 3) AS source, CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'src' || (doc_id % 4) || ';src' || (doc_id % 3) END AS publisher, doc_id % 2 = 1 AS fresh FROM documents")
def incremental_batch(spark, d):
    """Documents with even ids are known already; they take new sources, the others are scored."""
    raw = _records(spark, d)
    known = raw.where("article_id % 2 = 0").withColumns({"source": F.lit("old"), "publisher": F.lit("old"), "sentiment_score": F.lit(0.0), "known": F.lit(True)})
    out = N.incremental(known, raw, WORDS, F.lit("2024-01-05T00:00:00Z").cast("timestamp"))
    return out.select("article_id", "source", "publisher", F.col("known").isNull().alias("fresh"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN '2024-03-01T00:00:00+00:00' ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS published, event_id % 4 = 3 AS failed FROM events")
def time_parsing(spark, d):
    ts = F.col("ts").cast("timestamp_ntz")
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(kind == 1, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(kind == 2, F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise("soon")
    fallback = F.lit("2024-03-01T00:00:00Z").cast("timestamp")
    return table(spark, d, "events").select("event_id", D.formatted(D.feed_time(text, fallback)).alias("published"), (kind == 3).alias("failed"))


@query(r"SELECT doc_id, len(regexp_extract_all(trim(text, ' '), '\d+(?:[.,]\d+)*'))::INT AS numbers, CASE WHEN length(trim(text, ' ')) <= 80 THEN trim(text, ' ') ELSE rtrim(substr(trim(text, ' '), 1, 77), ' ') || '...' END AS label FROM documents")
def display_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", Y.number_count(F.col("text")).cast("int").alias("numbers"), Y.shorten(F.col("text")).alias("label"))


# --- clustering in context ---

_NEWS = f"""n AS (SELECT article_id AS id, epoch(published_at) AS at, CASE WHEN article_id % 4 <> 0 THEN 'T' || (user_id % 300) ELSE '' END AS ticker, sector = 'error' AS unmapped, sentiment_score AS score, ['w' || (article_id % 50), 'v' || (user_id % 20)] AS k FROM art)"""


def _news(spark, d) -> DataFrame:
    i, u = F.col("article_id"), F.col("user_id")
    a = articles(spark, d).withColumns({"title": F.concat(F.lit("w"), i % 50, F.lit(" v"), u % 20), "summary": F.lit(""), "tickers": F.when(i % 4 != 0, F.concat(F.lit("T"), u % 300)).otherwise(""), "sector": F.when(F.col("sector") == "error", "Unmapped").otherwise(F.col("sector")), "event_id": F.col("event_key")})
    return a


_CONTEXT = f"""{_NEWS}, c AS (SELECT x.id AS a, y.id AS b, false AS strict, x.k AS xk, y.k AS yk, x.score AS xs, y.score AS ys FROM n x JOIN n y ON x.ticker = y.ticker AND x.ticker <> '' AND x.id < y.id AND abs(x.at - y.at) <= 172800
    UNION ALL SELECT x.id, y.id, true, x.k, y.k, x.score, y.score FROM n x JOIN n y ON x.ticker = '' AND y.ticker = '' AND x.unmapped AND y.unmapped AND x.id < y.id AND abs(x.at - y.at) <= 172800 AND list_has_any(x.k, y.k))"""


@query(f"WITH {ART}, {_CONTEXT} SELECT a, b, strict FROM c")
def context_pairs(spark, d):
    return C.candidate_pairs(C.prepared(_news(spark, d), ["the"]))


@query(
    f"""WITH {ART}, {_CONTEXT}, s AS (SELECT *, len(list_intersect(xk, yk)) / len(list_distinct(list_concat(xk, yk))) AS similarity FROM c)
    SELECT a, b, round(similarity, 6) AS similarity FROM s WHERE similarity >= CASE WHEN strict THEN 0.55 ELSE 0.4 END AND NOT (xs > 0.3 AND ys < -0.3) AND NOT (ys > 0.3 AND xs < -0.3)"""
)
def similar_context_pairs(spark, d):
    rows = C.prepared(_news(spark, d), ["the"])
    return rounded(C.similar_pairs(rows).select("a", "b", "similarity"))


@query(f"WITH {ART} SELECT article_id, first(article_id) OVER (PARTITION BY event_key ORDER BY agg_weight DESC, article_id) AS event_id, (SELECT count(DISTINCT b.source) FROM art b WHERE b.event_key = a.event_key) AS source_count FROM art a")
def event_assignment(spark, d):
    a = articles(spark, d)
    return C.assigned(a, a.select(F.col("article_id").alias("id"), F.col("event_key").alias("cluster"))).select("article_id", "event_id", F.col("source_count").cast("long").alias("source_count"))


@query(f"WITH {ART} SELECT user_id AS event_id, count(*) AS articles, round(epoch(max(published_at) - min(published_at)) / 3600, 6) AS hours, epoch(max(published_at) - min(published_at)) / 3600 > 72 AS over_span FROM art GROUP BY 1")
def cluster_diagnostics(spark, d):
    return rounded(C.diagnostics(articles(spark, d).withColumn("event_id", F.col("user_id"))))


@query(None)
def context_clusters(spark, d):
    """Events of all articles by shared tickers and words; held against a plain greedy version in the tests."""
    return C.cluster_articles(_news(spark, d), ["the"]).select("article_id", "event_id", "source_count")


# --- brief, labels and sources ---


@query(f"WITH {_metrics_sql(config.ENHANCED)}, u AS (SELECT sector, unnest([{', '.join(f"{{'metric': '{m}', 'score': round({m}, 6)}}" for m in config.METRICS)}]) AS u FROM met) SELECT sector, u.metric AS metric, u.score AS score, row_number() OVER (PARTITION BY u.metric ORDER BY u.score DESC, sector) AS place FROM u")
def brief_rankings(spark, d):
    rows = rounded(M.sector_metrics(spark, articles(spark, d), config.ENHANCED))
    return B.rankings(rows).select("sector", "metric", "score", F.col("place").cast("long").alias("place"))


@query(f"WITH {_metrics_sql(config.ENHANCED)}, u AS (SELECT sector, unnest([{', '.join(f"{{'metric': '{m}', 'score': round({m}, 6)}}" for m in config.METRICS)}]) AS u FROM met) SELECT u.metric AS metric, sector FROM u QUALIFY row_number() OVER (PARTITION BY u.metric ORDER BY u.score DESC, sector) <= 5")
def largest_groups(spark, d):
    """The five leading groups of each metric."""
    rows = rounded(M.sector_metrics(spark, articles(spark, d), config.ENHANCED))
    return B.rankings(rows).where("place <= 5").select("metric", "sector")


@query(f"WITH {PRED} SELECT article_id, actual AS true_sentiment, predicted AS predicted_sentiment FROM pr WHERE actual <> predicted AND actual IN ('positive', 'negative') AND predicted = 'neutral'")
def chosen_errors(spark, d):
    s, names = F.col("sentiment_score"), ("p_positive", "p_neutral", "p_negative")
    p, u, n = map(F.col, names)
    rows = articles(spark, d).select("article_id", F.when(s > 0.05, "positive").when(s < -0.05, "negative").otherwise("neutral").alias("true_sentiment"), F.when((p >= u) & (p >= n), "positive").when(u >= n, "neutral").otherwise("negative").alias("predicted_sentiment"))
    return A.chosen_errors(rows.where("true_sentiment <> predicted_sentiment"), ["positive", "negative"], ["neutral"])


@query(f"SELECT * FROM (WITH {_metrics_sql(config.BASELINE)} SELECT 'baseline' AS formula_version, sum(articles)::BIGINT AS article_count, {', '.join(f'round(avg({m}), 6) AS {m}' for m in config.METRICS)} FROM met) UNION ALL SELECT * FROM (WITH {_metrics_sql(config.ENHANCED)} SELECT 'enhanced', sum(articles)::BIGINT, {', '.join(f'round(avg({m}), 6)' for m in config.METRICS)} FROM met)")
def market_snapshot(spark, d):
    _, market = Z.snapshot_rows(spark, articles(spark, d), "real", dt.datetime(2024, 2, 1))
    return rounded(market.select("formula_version", F.col("article_count").cast("long").alias("article_count"), *config.METRICS))


@query(f"WITH {ART} SELECT count(*) AS articles, min(published_at) AS first, max(published_at) AS last, count(DISTINCT publisher) AS publishers FROM art")
def brief_coverage(spark, d):
    return B.coverage(articles(spark, d))


@query(f"WITH {ART}, x AS (SELECT sector, day, sum(agg_weight) AS v FROM art WHERE day < DATE '2024-01-20' GROUP BY 1, 2) SELECT sector, day AS snapshot_date, round(v, 6) AS v FROM x WHERE day = (SELECT max(day) FROM x)")
def previous_snapshot(spark, d):
    daily = articles(spark, d).groupBy("sector", F.col("day").alias("snapshot_date")).agg(F.sum("agg_weight").alias("v")).withColumn("snapshot_timestamp", F.lit("t"))
    return rounded(B.previous(daily, F.lit("2024-01-20").cast("date"), ["sector"]).select("sector", "snapshot_date", "v"))


@query(f"WITH {ART} SELECT day, sector, count(*) AS n FROM art WHERE day > (SELECT max(day) FROM art) - 5 GROUP BY 1, 2")
def trend_days(spark, d):
    return Z.trend(articles(spark, d).groupBy("day", "sector").agg(F.count("*").alias("n")), 5, "day")


@query(f"WITH {PRED}, l AS (SELECT unnest(['positive','neutral','negative']) AS label), m AS (SELECT 'model' AS model, actual, predicted FROM pr UNION ALL SELECT 'all neutral', actual, 'neutral' FROM pr), f AS (SELECT model, label, coalesce(2.0 * count(*) FILTER (actual = label AND predicted = label) / nullif(count(*) FILTER (actual = label) + count(*) FILTER (predicted = label), 0), 0) AS f1 FROM m, l GROUP BY 1, 2), g AS (SELECT model, avg(f1) AS macro_f1 FROM f GROUP BY 1) SELECT m.model, count(*) AS n, round(avg((actual = predicted)::INT), 6) AS accuracy, round(any_value(macro_f1), 6) AS macro_f1 FROM m JOIN g ON m.model = g.model GROUP BY 1")
def model_comparison(spark, d):
    return rounded(A.comparison(_predicted(spark, d), spark, "actual", {"model": F.col("predicted"), "all neutral": F.lit("neutral")}))


@query(f"WITH {PRED} SELECT 'model' AS name, count(*) AS n, count(*) FILTER (actual = predicted) AS correct, round(avg((actual = predicted)::INT), 6) AS accuracy FROM pr WHERE article_id % 3 <> 0")
def accuracy_row(spark, d):
    rows = _predicted(spark, d).withColumn("actual", F.when(F.col("article_id") % 3 != 0, F.upper("actual")).otherwise(" "))
    return rounded(A.accuracy(rows, "actual", "predicted", "model"))


RISKS = sorted(config.RISK_SEVERITY)


@query(
    f"""WITH {ART}, l AS (SELECT unnest(range({len(RISKS)})) AS i, unnest({RISKS}) AS label), f AS (SELECT label, article_id % 10 = i OR user_id % 10 = i AS t, article_id % 7 = i OR user_id % 10 = i AS p FROM art, l), c AS (SELECT label, count(*) FILTER (t AND p) AS tp, count(*) FILTER (t) AS support, count(*) FILTER (p) AS g FROM f GROUP BY 1)
    SELECT label, round(coalesce(tp / nullif(g, 0), 0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(g + support, 0), 0), 6) AS f1, support FROM c"""
)
def risk_report(spark, d):
    names = F.array(*(F.lit(r) for r in RISKS))
    pick = lambda i, j: F.concat_ws(";", F.element_at(names, (i + 1).cast("int")), F.element_at(names, (j + 1).cast("int")))
    i, u = F.col("article_id"), F.col("user_id")
    return rounded(A.risk_report(articles(spark, d).select(pick(i % 10, u % 10).alias("t"), pick(i % 7, u % 10).alias("p")), "t", "p", RISKS, spark))


@query("SELECT count(*) FILTER (lang <> '') + count(*) FILTER (source <> '') AS completed FROM documents")
def completed_cells(spark, d):
    return A.completed_cells(table(spark, d, "documents"), ("lang", "source"))


@query("SELECT source, count(*) AS parsed, count(l.doc_id) AS new FROM documents JOIN (SELECT doc_id AS k FROM documents) ON k = documents.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = documents.doc_id GROUP BY 1")
def collection_stats(spark, d):
    return K.stats(table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), "source"), table(spark, d, "labels").select(F.col("doc_id").alias("article_id")))


# --- lists, evidence, display and backfills of the library's functions ---


@query(r"SELECT event_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(upper('t' || event_id % 7 || '; T' || user_id % 5 || ',' || event_type || '|'), '[;,|\s]+'), lambda x: x <> ''))), ';') AS tickers FROM events")
def ticker_lists(spark, d):
    text = F.concat(F.lit("t"), F.col("event_id") % 7, F.lit("; T"), F.col("user_id") % 5, F.lit(","), "event_type", F.lit("|"))
    return table(spark, d, "events").select("event_id", F.array_join(F.array_sort(V.tickers(text)), ";").alias("tickers"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'u' || user_id WHEN user_id % 2 = 0 THEN 'second ' || user_id ELSE event_type END AS evidence,
    CASE WHEN event_id % 4 = 0 THEN 'own' WHEN event_id % 4 = 1 THEN 'field' ELSE 'feed' || user_id END AS publisher FROM events""")
def evidence_choice(spark, d):
    i, title, user = F.col("event_id"), F.col("event_type"), F.col("user_id")
    first = F.when(i % 3 == 0, F.upper(title)).when(i % 3 == 1, F.concat(title, F.lit(": u"), user)).otherwise(" ")
    second = F.when(user % 2 == 0, F.concat(F.lit("second "), user))
    own, field = F.when(i % 4 == 0, " own "), F.when(i % 4 < 2, "field")
    return table(spark, d, "events").select("event_id", V.chosen(title, first, second).alias("evidence"), V.publisher(own, field, F.concat(F.lit("feed"), user)).alias("publisher"))


@query(
    f"""WITH {ART} SELECT article_id, CASE WHEN article_id % 10 = 0 THEN 0 ELSE round(risk_intensity / 4, 1) END AS metric,
    ':' || CASE WHEN sentiment_score > 0.05 THEN 'green[positive ' WHEN sentiment_score < -0.05 THEN 'red[negative ' ELSE 'gray[neutral ' END || printf('%+.2f', sentiment_score) || ']' AS badge,
    CASE WHEN article_id % 2 = 0 THEN '[\\[' || sector || '\\]](https://x/' || user_id || ')' ELSE '\\[' || sector || '\\]' END AS link FROM art"""
)
def score_display(spark, d):
    title, url = F.concat(F.lit("["), "sector", F.lit("]")), F.concat(F.when(F.col("article_id") % 2 == 0, "https://x/").otherwise("mailto:"), "user_id")
    value = F.when(F.col("article_id") % 10 != 0, F.col("risk_intensity") / 4)
    return articles(spark, d).select("article_id", Y.metric(value).alias("metric"), Y.badge(F.col("sentiment_score")).alias("badge"), Y.markdown_link(title, url).alias("link"))


@query(
    f"""WITH {ART} SELECT article_id, CASE WHEN bad THEN 0 ELSE sentiment_score END AS sentiment_score, CASE WHEN bad THEN 1 ELSE round(p_neutral, 6) END AS p_neutral, CASE WHEN bad THEN 0 ELSE round(agg_weight, 6) END AS agg_weight,
    CASE WHEN bad AND article_id % 2 = 0 THEN 'Unmapped' ELSE 'known' || article_id % 2 END AS sector FROM (SELECT *, article_id % 5 = 0 AS bad FROM art)"""
)
def degraded_rows(spark, d):
    error, sector = F.when(F.col("article_id") % 5 == 0, "failed"), F.when((F.col("article_id") % 10 == 0), " ").otherwise(F.concat(F.lit("known"), F.col("article_id") % 2))
    rows = articles(spark, d).withColumns({"processing_error": error, "sector": sector})
    return rounded(N.degraded(rows).select("article_id", "sentiment_score", "p_neutral", "agg_weight", "sector"))


@query(
    f"""WITH {ART} SELECT article_id, CASE WHEN NOT lacks THEN b_bull WHEN article_id % 3 = 0 THEN 1 ELSE 0 END AS b_bull, CASE WHEN NOT lacks THEN b_bear WHEN article_id % 3 = 1 THEN 1 ELSE 0 END AS b_bear,
    CASE WHEN lacks THEN 0 ELSE g_growth END AS g_growth, round(entropy_norm, 6) AS entropy_norm FROM (SELECT *, article_id % 5 = 0 AS lacks FROM art)"""
)
def component_backfill(spark, d):
    i = F.col("article_id")
    title = F.when(i % 3 == 0, "rise of shares").when(i % 3 == 1, "Fall der shares").otherwise("rise of shares and bonds")
    rows = articles(spark, d).withColumns({"title": title, "b_bull": F.when(i % 5 != 0, F.col("b_bull"))})
    return rounded(N.backfill_components(rows, WORDS).select("article_id", "b_bull", "b_bear", "g_growth", "entropy_norm"))


@query(
    """SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 5 > 0 AND event_id % 3 > 0 THEN 'full' WHEN event_id % 2 = 0 THEN 'general market sentiment' ELSE 'own' END AS topic,
    concat_ws(';', CASE WHEN event_id % 4 < 2 THEN 'x:' || greatest(event_id % 7, CASE WHEN event_id % 5 > 0 THEN user_id % 7 ELSE 0 END) WHEN event_id % 5 > 0 THEN 'x:' || user_id % 7 END, CASE WHEN event_id % 5 > 0 AND user_id % 2 = 0 THEN 'y:3' END) AS risks,
    CASE WHEN event_id % 5 > 0 AND (event_id % 4 >= 2 OR user_id % 2 = 0) THEN 'in full' WHEN event_id % 4 < 2 THEN 'in summary' ELSE '' END AS evidence FROM events"""
)
def merged_tags(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    risk = lambda name, strength, where: F.struct(F.lit(name).alias("category"), F.lit(2.0).alias("severity"), strength.cast("double").alias("strength"), F.lit(where).alias("evidence"))
    none = F.expr(N._NO_RISKS)
    own = F.struct(F.when(i % 2 == 0, N.GENERAL).otherwise("own").alias("topic"), F.lit("").alias("hint"), F.when(i % 4 < 2, F.array(risk("x", i % 7, "in summary"))).otherwise(none).alias("risks"))
    more = F.when(u % 2 == 0, F.array(risk("x", u % 7, "in full"), risk("y", F.lit(3), "in full"))).otherwise(F.array(risk("x", u % 7, "in full")))
    full = F.struct(F.when(i % 3 > 0, "full").otherwise(N.GENERAL).alias("topic"), F.lit("").alias("hint"), more.alias("risks"))
    rows = table(spark, d, "events").select("event_id", own.alias("own"), full.alias("full"), (i % 5 > 0).alias("has"))
    tags = rows.select("event_id", N.merged_tags(F.col("own"), F.col("full"), F.col("has")).alias("t"))
    told = F.transform("t.risks", lambda r: F.concat(r["category"], F.lit(":"), r["strength"].cast("int")))
    return tags.select("event_id", "t.topic", F.array_join(told, ";").alias("risks"), "t.evidence")


@query("SELECT doc_id::VARCHAR AS article_id, CASE WHEN doc_id % 3 = 0 THEN 'own' WHEN doc_id % 4 = 0 AND doc_id % 5 > 0 THEN 'cached ' || doc_id ELSE '' END AS body_text FROM documents")
def cache_restore(spark, d):
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select(i, i.cast("string").alias("article_id"))
    status, body = F.when(i % 4 == 0, "ok").otherwise("failed"), F.when(i % 5 > 0, F.concat(F.lit("cached "), i)).otherwise(" ")
    cache = docs.select("article_id", status.alias("status"), body.alias("body_text"))
    return N.restore_bodies(docs.select("article_id", F.when(i % 3 == 0, "own").otherwise("").alias("body_text")), cache)


@query("SELECT doc_id::VARCHAR AS article_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM documents")
def replaced_rows(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("article_id"), "doc_id")
    new = docs.where("doc_id % 3 = 0").select("article_id", F.lit("new").alias("state"))
    return N.replace_rows(docs.select("article_id", F.lit("old").alias("state")), new)


@query(f"SELECT doc_id, CASE WHEN contains({PADDED.format('text')}, ' of ') THEN 'of' ELSE '' END AS b_bull, CASE WHEN contains({PADDED.format('text')}, ' der ') THEN 'der' ELSE '' END AS b_bear, 0 AS k_unc FROM documents")
def matched_signals(spark, d):
    found = table(spark, d, "documents").select("doc_id", N.matched_signals(F.col("text"), WORDS).alias("m"))
    return found.select("doc_id", F.array_join("m.b_bull", ";").alias("b_bull"), F.array_join("m.b_bear", ";").alias("b_bear"), F.size("m.k_unc").alias("k_unc"))


def _entries(spark, d) -> DataFrame:
    """Documents as entries, three feeds for every 600 of them, whose entries are cut at 200; half of them repeat an
    address and title of another feed."""
    i = F.col("doc_id")
    names = {"feed": F.concat(F.lit("f"), F.floor(i / 600) * 3 + i % 3), "link": F.concat(F.lit("http://x/"), (i / 2).cast("long")), "title": F.concat(F.lit("t <b>"), (i / 2).cast("long"), F.lit("</b>")), "source": F.when(i % 2 == 0, F.concat(F.lit("p"), i % 4))}
    plain = {"summary": F.lit(""), "publisher": F.lit(None).cast("string"), "published": F.lit("2024-01-05T00:00:00Z"), "weight": F.lit(1.0), "sector": F.lit(""), "ticker": F.concat(F.lit("T"), i % 5), "place": (i % 600 / 2).cast("int"), "max_entries": F.lit(200)}
    return table(spark, d, "documents").select(*(v.alias(k) for k, v in (names | plain).items()))


_ENTRIES = "e AS (SELECT 'http://x/' || doc_id // 2 AS url, 't ' || doc_id // 2 AS title, 'f' || (doc_id // 600 * 3 + doc_id % 3) AS source, CASE WHEN doc_id % 2 = 0 THEN 'p' || doc_id % 4 ELSE 'f' || (doc_id // 600 * 3 + doc_id % 3) END AS publisher, 'T' || doc_id % 5 AS ticker, doc_id % 600 // 2 AS place FROM documents WHERE doc_id % 600 // 2 < 200)"


@query(f"WITH {_ENTRIES} SELECT 'rss-' || left(sha1(url || '|' || title), 16) AS article_id, title, source, publisher, '2024-01-05T00:00:00+00:00' AS published_at FROM e")
def feed_records(spark, d):
    return K.records(_entries(spark, d), "2024-02-01T00:00:00Z").select("article_id", "title", "source", "publisher", "published_at")


@query(f"WITH {_ENTRIES} SELECT url, array_to_string(list_sort(list(DISTINCT source)), ';') AS sources, array_to_string(list_sort(list(DISTINCT ticker)), ';') AS tickers FROM e GROUP BY 1")
def collected_records(spark, d):
    rows = K.collected(K.records(_entries(spark, d), "2024-02-01T00:00:00Z"))
    return rows.select("url", *(F.array_join(F.array_sort(X.split_values(F.col(c))), ";").alias(n) for c, n in (("source", "sources"), ("tickers", "tickers"))))


_RUNS = """r AS (SELECT doc_id, 'http://x/' || (doc_id * 7 % 300) AS url, CASE WHEN doc_id % 2 = 0 THEN 'A story' ELSE 'a Story ' END AS title, 'feed' || (doc_id % 7) AS source, 'T' || (doc_id % 5) || ';t' || (doc_id % 3) AS tickers, doc_id * 7 % 300 % 4 AS s, 0.5 + doc_id % 4 / 10.0 AS w, doc_id % 3 = 0 AS later FROM documents)"""


@query(
    f"""WITH {_RUNS}, o AS (SELECT url, source, row_number() OVER (PARTITION BY url, source ORDER BY later, doc_id) AS k, later, doc_id FROM r), l AS (SELECT url, string_agg(source, ';' ORDER BY later, doc_id) AS sources FROM o WHERE k = 1 GROUP BY 1),
    t AS (SELECT url, lower(t) AS t, later, doc_id, i, t AS spelled, row_number() OVER (PARTITION BY url, lower(t) ORDER BY later, doc_id, i) AS k FROM (SELECT url, later, doc_id, unnest(string_split(tickers, ';')) AS t, unnest([1, 2]) AS i FROM r)), m AS (SELECT url, string_agg(spelled, ';' ORDER BY later, doc_id, i) AS tickers FROM t WHERE k = 1 GROUP BY 1)
    SELECT url, sources, CASE WHEN count(*) = 1 THEN any_value(r.tickers) ELSE m.tickers END AS tickers, 'S' || any_value(s) AS sector, max(w)::DOUBLE AS weight, arg_min(doc_id, (later::INT, doc_id))::VARCHAR AS article_id, NOT bool_or(NOT later) AS fresh FROM r JOIN l USING (url) JOIN m USING (url) GROUP BY url, sources, m.tickers"""
)
def stored_runs(spark, d):
    """Two collection runs merged into one stored table; records of the second run that are new to it are marked."""
    i, scratch = F.col("doc_id"), Scratch(spark, "runs")
    every = table(spark, d, "documents").select(i.cast("string").alias("article_id"), F.concat(F.lit("http://x/"), i * 7 % 300).alias("url"), F.when(i % 2 == 0, "A story").otherwise("a Story ").alias("title"), F.concat(F.lit("feed"), i % 7).alias("source"), F.concat(F.lit("T"), i % 5, F.lit(";t"), i % 3).alias("tickers"), F.concat(F.lit("S"), i * 7 % 300 % 4).alias("sector"), F.format_number(0.5 + i % 4 / 10.0, 1).alias("source_weight"), i.alias("place"))
    held = Store(spark, scratch.root)
    for later in (False, True):
        change = held.begin()
        new = K.store_run(change, every.where((F.col("place") % 3 == 0) == later))
        change.commit()
    rows = held.read("raw").join(new.withColumn("fresh", F.lit(True)), "article_id", "left")
    return rows.select("url", F.col("source").alias("sources"), "tickers", "sector", F.col("source_weight").cast("double").alias("weight"), "article_id", F.coalesce("fresh", F.lit(False)).alias("fresh"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(text) ELSE md5('own') END AS body, CASE WHEN doc_id % 3 = 0 THEN 'fulltext' ELSE 'summary' END AS content_level, CASE WHEN doc_id % 6 = 0 THEN 'yes' WHEN doc_id % 3 = 0 THEN 'True' ELSE 'False' END AS rescored FROM documents WHERE trim(text, ' ') <> ''")
def full_text_sync(spark, d):
    docs, i = table(spark, d, "documents").where(F.trim("text") != ""), F.col("doc_id")
    raw = docs.select(i.alias("article_id"), F.lit("own").alias("body_text"), F.lit("summary").alias("content_level"), F.lit("False").alias("rescored"))
    processed = docs.where(i % 3 != 2).select(i.alias("article_id"), F.when(i % 3 == 0, F.col("text")).otherwise(" ").alias("body_text"), F.when(i % 6 == 0, "yes").alias("rescored"))
    return K.with_full_texts(raw, processed).select(F.col("article_id").alias("doc_id"), F.md5("body_text").alias("body"), "content_level", "rescored")


@query("SELECT 'plain' AS feed, 'http://x/all' AS url, '' AS ticker UNION ALL SELECT DISTINCT 'by ticker', 'http://x/T' || c_nationkey, 'T' || c_nationkey FROM customer")
def feed_expansion(spark, d):
    told = [{"name": "plain", "kind": "market", "url": "http://x/all"}, {"name": "by ticker", "kind": "ticker", "url": "http://x/{ticker}"}, {"name": "off", "kind": "market", "url": "http://x/off", "enabled": False}]
    companies = table(spark, d, "customer").select(F.concat(F.lit("T"), "c_nationkey").alias("ticker"), F.lit("s").alias("sector"))
    return K.expanded(spark, K.checked(told), companies).select("feed", "url", "ticker")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'own' END AS publisher, '1.0' AS source_weight, CASE WHEN doc_id % 3 = 0 THEN 'fulltext' ELSE 'summary' END AS content_level FROM documents")
def raw_defaults(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(i, "source", F.when(i % 2 == 0, " ").otherwise("own").alias("publisher"), F.when(i % 3 == 0, "body").alias("body_text"))
    return K.raw_articles(rows).select("doc_id", "publisher", "source_weight", "content_level")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' WHEN 3 THEN 'positive' ELSE '' END AS label, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS answer FROM events")
def label_aliases(spark, d):
    spelled = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", A.sentiment_of(spelled([" POS ", "负面", "Neu", "positive", "good", ""])).alias("label"), A.answer_of(spelled(["Yes", "n", "maybe", " "])).alias("answer"))


@query(
    f"""WITH {ART}, e AS (SELECT *, count(*) OVER (PARTITION BY event_key) AS reports, row_number() OVER (PARTITION BY event_key ORDER BY agg_weight DESC, article_id) AS place FROM art),
    p AS (SELECT *, (article_id % 11 = 0)::INT * 8 + (reports > 1 AND place = 1)::INT * 4 + (risk_intensity >= 60)::INT * 2 + (abs(sentiment_score) >= 0.5)::INT AS priority FROM e WHERE day = DATE '2024-01-15'),
    c AS (SELECT *, row_number() OVER (PARTITION BY user_id % 200 ORDER BY priority DESC, risk_intensity DESC, abs(sentiment_score) DESC, agg_weight DESC, article_id) AS same FROM p
        WHERE priority > 0 AND article_id % 3 <> 1 AND source IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6') AND article_id % 13 <> 0 AND user_id % 200 <> 7)
    SELECT article_id, priority FROM c WHERE same = 1 ORDER BY priority DESC, risk_intensity DESC, abs(sentiment_score) DESC, agg_weight DESC, article_id LIMIT 30"""
)
def reading_list(spark, d):
    """The articles of one day worth reading whole, the first 30: web pages of allowed sources that no cache holds."""
    i = F.col("article_id")
    scheme = F.when(i % 3 == 1, "ftp://x/").otherwise("https://x/")
    a = articles(spark, d).withColumns({"event_id": F.col("event_key"), "title": F.concat(F.lit("t"), F.col("user_id") % 200), "url": F.concat(scheme, i), "content_level": F.lit("summary"), "published_at": F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")})
    cache = a.where(i % 13 == 0).select("article_id", F.lit("").alias("url"), F.lit("").alias("title")).union(spark.createDataFrame([(-1, "", "T7!")], "article_id long, url string, title string"))
    words = dataclasses.replace(WORDS, fulltext_sources=[f"src{k}" for k in range(1, 7)])
    return N.fulltext_candidates(a, a.where(i % 11 == 0), cache, F.lit("2024-01-15").cast("date"), words).select("article_id", "priority")
