"""Ranked lexical search over an index of document shards with integer impacts.

``build_index`` cuts the documents into shards of some megabytes.  A shard is one row: its documents in ascending order of
id, its terms in byte order, and its postings in compressed sparse rows, one row per term, each posting with a precomputed
integer impact (what the term's frequency and the document's length contribute).  Number and length of all documents are
counted before, as impacts need them.

``search`` takes stated queries in blocks.  Document frequencies of a block's terms are added up over the shards; each
shard then goes through a query's terms one after the other, adding weight times impact to a dense array of scores, one
place per document.  ``argpartition`` finds the least score among the best k; scores above it are taken, and of those equal
to it the first by id.  A task keeps the best k of all its shards per query, and Spark merges tasks, first by a salt.

Terms are maximal runs of ASCII letters, digits and any characters beyond ASCII; only A-Z are lower-cased.

Defined cases: null and empty texts have no terms, are never found and count in no statistic; a null doc_id is searched
too and comes last among equal scores; repeated doc_ids are documents each for itself; each row of the queries is a query
of its own, a null item_id stays null; queries without terms, or with terms that no document holds, give no rows; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.caches import tidy
from quillmesh.llm.chunks import expand, pack_arrays, squeeze, texts_of, unpack_arrays
from quillmesh.llm.work import Work

#: Best documents per query.
TOP = 50
#: Text of a shard; a longer document has one of its own.
SHARD_BYTES = 8 << 20
#: Queries are answered in blocks of at most so many rows and bytes of text.
BLOCK_QUERIES, BLOCK_BYTES = 1000, 4 << 20
#: The length part of the impact, and the fixed-point unit of both (fixed values of the ranking).
LENGTH_SHARE, UNIT, SATURATION = 50, 1000, 20
#: Best documents of tasks meet in so many groups per query before the last merge.
SALTS = 32
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Terms(NamedTuple):
    """Distinct terms in byte order, and for each occurrence its number among them and its text."""

    every: pa.Array
    code: np.ndarray
    text: np.ndarray


def terms_of(body: bytes, lengths: np.ndarray) -> Terms:
    """Terms of concatenated UTF-8 texts.  Bytes beyond ASCII are in characters beyond ASCII, so bytes decide."""
    raw = _LOWER[np.frombuffer(body, np.uint8)]
    ends = np.cumsum(np.maximum(lengths, 0))
    held = _IN_TERM[raw]
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = held[1:] != held[:-1]
    edge[ends] = edge[0] = True
    at = np.flatnonzero(edge)
    good = held[at[:-1]] if len(raw) else np.zeros(0, bool)
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw.tobytes())])
    coded = pc.dictionary_encode(runs.filter(pa.array(good)))
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return Terms(coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()], np.searchsorted(ends, at[:-1][good], "right"))


def impacts(count: np.ndarray, n_terms: np.ndarray, of: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """What ``count`` occurrences give in documents ``of`` with ``n_terms`` terms; exact whatever the corpus' size."""
    distinct, place = np.unique(n_terms, return_inverse=True)
    norm = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * int(n) * n_docs // all_terms for n in distinct], np.int64)[place]
    return UNIT**3 * count // (UNIT * count + SATURATION * norm[of])


def _shard(ids: list[pa.Array], lengths: list[np.ndarray], bodies: list[bytes], n_docs: int, all_terms: int) -> pa.RecordBatch:
    keys, length, body = pa.concat_arrays(ids), np.concatenate(lengths), b"".join(bodies)
    order = pc.array_sort_indices(keys, null_placement="at_end").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    terms = terms_of(body, length)
    n_terms = np.bincount(place[terms.text], minlength=len(keys))
    both, count = np.unique(terms.code * len(keys) + place[terms.text], return_counts=True)
    term, doc = both // max(len(keys), 1), both % max(len(keys), 1)
    width = pc.binary_length(terms.every).to_numpy()
    return pa.RecordBatch.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys.take(pa.array(order))),
            pa.array([pack_arrays(width.astype(np.uint32))], pa.binary()),
            pa.array([squeeze(b"".join(terms.every.to_pylist()))], pa.binary()),
            pa.array([pack_arrays(np.bincount(term, minlength=len(terms.every)).astype(np.uint32))], pa.binary()),
            pa.array([pack_arrays(doc.astype(np.uint32), impacts(count, n_terms, doc, n_docs, all_terms).astype(np.uint32))], pa.binary()),
        ],
        names=["docs", "widths", "terms", "counts", "postings"],
    )


class Index(NamedTuple):
    """Shards, and the numbers of documents with terms and of all their terms."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def build_index(work: Work, docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> Index:
    """Write the index of rows (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = F.regexp_count("text", F.lit(TERM))
    n_docs, all_terms = rows.filter(F.col("text").isNotNull()).select(n.alias("n")).filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, bodies, size, held = [], [], [], 0, 0
        for batch in batches:
            length, body = texts_of(batch.column(1))
            ends = np.cumsum(np.maximum(length, 0))
            lo = 0
            while lo < batch.num_rows:
                base = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, base + max(shard_bytes - size, 0), "right")))
                ids.append(batch.column(0).slice(lo, hi - lo))
                lengths.append(length[lo:hi])
                bodies.append(body[base : int(ends[hi - 1])])
                size, held, lo = size + len(bodies[-1]), held + hi - lo, hi
                if size >= shard_bytes or held >= 200_000:
                    yield _shard(ids, lengths, bodies, n_docs, all_terms)
                    ids, lengths, bodies, size, held = [], [], [], 0, 0
        if held and all_terms:
            yield _shard(ids, lengths, bodies, n_docs, all_terms)

    found = rows.filter(F.col("text") != "").mapInArrow(tidy(run), "docs array<long>, widths binary, terms binary, counts binary, postings binary")
    return Index(work.save(found, "index", "uncompressed"), n_docs, all_terms)


def _places(asked: pa.Array, widths: bytes, terms: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the asked terms that a shard holds, and their places among its terms."""
    (width,), body = unpack_arrays(widths), expand(terms)
    offsets = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(width), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    at = pc.index_in(asked, value_set=own)
    held = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    return held, at.drop_null().to_numpy().astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0; of equal ones the first; in no order."""
    some = np.flatnonzero(scores)
    if len(some) <= k:
        return some
    own = scores[some]
    least = own[np.argpartition(own, len(own) - k)[len(own) - k]]
    above, equal = some[own > least], some[own == least]
    return np.concatenate([above, equal[: k - len(above)]])


def _document_counts(index: Index, asked: pa.Array) -> np.ndarray:
    """How many documents hold each asked term: added per task, then by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            for widths, terms, counts in zip(*batch.columns, strict=True):
                held, at = _places(asked, widths.as_py(), terms.as_py())
                total[held] += unpack_arrays(counts.as_py())[0][at].astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["term", "n"])

    out = np.zeros(len(asked), np.int64)
    for term, n in index.shards.select("widths", "terms", "counts").mapInArrow(tidy(run), "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


def _shard_scores(docs: pa.Array, widths: bytes, terms: bytes, counts: bytes, postings: bytes, asked: pa.Array, queries: list[np.ndarray], weights: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """(query, scores, doc_ids) of the best documents of a shard."""
    held, at = _places(asked, widths, terms)
    ends = np.cumsum(unpack_arrays(counts)[0], dtype=np.int64)
    doc, impact = unpack_arrays(postings)
    row = np.full(len(asked), -1)
    row[held] = at
    scores = np.zeros(len(docs), np.int64)
    for q, terms_asked in enumerate(queries):
        scores[:] = 0
        for t in terms_asked:
            if row[t] >= 0:
                span = slice(ends[row[t] - 1] if row[t] else 0, ends[row[t]])
                scores[doc[span]] += weights[t] * impact[span].astype(np.int64)
        top = best(scores, k)
        if len(top):
            top.sort()
            yield q, scores[top], docs.take(pa.array(top))


def _search_block(index: Index, items: list[tuple], k: int, ids: str) -> DataFrame:
    """Rows (query, item_id, doc_id, score): per task the best k of each query of a block."""
    bodies = [(text or "").encode() for _, text in items]
    found = terms_of(b"".join(bodies), np.array([len(b) for b in bodies], np.int64))
    asked = found.every
    queries = [np.unique(found.code[found.text == q]) for q in range(len(items))]
    held = _document_counts(index, asked)
    weights = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * int(n) + 1))) for n in held], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, pa.Array]] = {}
        for batch in batches:
            for docs, *parts in zip(*batch.columns, strict=True):
                for q, scores, own in _shard_scores(docs.values, *(p.as_py() for p in parts), asked, queries, weights, k):
                    if q in kept:
                        scores, own = np.concatenate([kept[q][0], scores]), pa.concat_arrays([kept[q][1], own])
                        order = pc.sort_indices(pa.table({"s": scores, "d": own}), sort_keys=[("s", "descending"), ("d", "ascending")])[:k]
                        scores, own = scores[order.to_numpy()], own.take(order)
                    kept[q] = scores, own
        for q, (scores, own) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), q), pa.int32()), own, pa.array(scores, pa.int64())], names=["query", "doc_id", "score"])

    hits = index.shards.mapInArrow(tidy(run), "query int, doc_id long, score long")
    names = index.shards.sparkSession.createDataFrame([(q, item) for q, (item, _) in enumerate(items)], f"query int, item_id {ids}")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for by in (["query", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))], ["query"]):
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    return hits.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def search(work: Work, index: Index, queries: DataFrame, k: int = TOP) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): for each row (item_id, text) its k best documents.

    Queries come to the driver block by block, never as a whole; each block's answers are written.
    """
    ids = queries.schema["item_id"].dataType.simpleString()
    block, size, frames = [], 0, []

    def answer() -> None:
        frames.append(work.save(_search_block(index, block, k, ids), f"hits-{len(frames)}"))

    if index.n_terms:
        for row in queries.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
            block.append((row.item_id, row.text))
            size += len(row.text or "")
            if len(block) >= BLOCK_QUERIES or size >= BLOCK_BYTES:
                answer()
                block, size = [], 0
        if block:
            answer()
    if not frames:
        return work.spark.createDataFrame([], f"item_id {ids}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, frames)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all ``documents`` for each item of ``benchmark``."""
    work = Work(spark, "search")
    index = build_index(work, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    hits = search(work, index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    work.drop("index")
    return hits


def sql(k: int = TOP) -> str:
    """The same rows without an index."""
    lower = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = lambda c: f"unnest(regexp_extract_all({lower(c)}, '{TERM}'))"
    return f"""WITH held AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {terms("text")} AS term FROM documents) GROUP BY ALL),
lengths AS MATERIALIZED (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY doc_id),
size AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM lengths),
asked AS MATERIALIZED (SELECT DISTINCT item_id, term FROM (SELECT item_id, {terms("text")} AS term FROM benchmark)),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, size GROUP BY term, nd),
norms AS (SELECT doc_id, 100 - {LENGTH_SHARE} + ({LENGTH_SHARE} * n * nd) // nt AS m FROM lengths, size),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + {SATURATION} * m))) AS BIGINT) AS score FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {k}"""
