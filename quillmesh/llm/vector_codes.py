"""Compression of vectors to codes of a few bytes by product quantisation, with codebooks fitted by Yinyang Lloyd rounds.

Vectors are packed into blocks of some thousand rows, written once per round to the shared folder together with what the
method remembers of each part: the entry it is assigned to, an upper bound of its distance to that entry, and one lower
bound per *group* of codebook entries.  A round lowers a group's bound by the furthest that any entry of the group has
moved and raises the upper bound by the move of the own entry; only parts whose upper bound reaches a group's lower bound
compute distances to that group's entries.  Distances are squared and integer, bounds are whole numbers rounded to the
safe side, and equality never prunes, so ties are settled by exact integers in favour of the lower index and the result
equals a full search.  Blocks give sums per entry, which Spark adds up; the driver sees only codebooks.

Defined cases: rows whose vector is null or has null, NaN or infinite components are dropped; null ids are kept and come
last in the order of ids; equal ids are ordered by their vectors; fewer than ``ENTRIES`` rows give as many entries; entries
that no part uses stay; vectors shorter than the longest, or whose length no number of equal parts fits, are read as if
zeros followed; integer components are held within bounds that keep all sums in 64 bits (with 64 components, floats of
+-32768); an empty vector has zeros; an empty table gives no rows; repeated rows are coded each for itself; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.caches import tidy
from quillmesh.llm.chunks import pack_arrays, unpack_arrays
from quillmesh.llm.work import Work

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Groups of codebook entries per part, each with one lower bound.
GROUPS = 4
#: Components of a block at most, so that a block has 4 MB.
BLOCK_COMPONENTS = 1 << 20
#: Totals of labels up to this number are broadcast; beyond it, only those with a large share of the rows are.
BROADCAST_LABELS = 10_000
#: Sums of squares below this are exact as doubles.
EXACT = 1 << 53


class Book(NamedTuple):
    """Entries of one part (entries x components), the group of each entry."""

    entries: np.ndarray
    group: np.ndarray


def grouped(entries: np.ndarray, groups: int) -> np.ndarray:
    """Groups of near entries: seeds far from each other, then a few Lloyd rounds."""
    k = len(entries)
    if not k:
        return np.zeros(0, np.int64)
    points = entries.astype(float)
    seeds, near = [0], ((points - points[0]) ** 2).sum(1)
    while len(seeds) < min(groups, k):
        seeds.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[seeds[-1]]) ** 2).sum(1))
    centres = points[seeds]
    for _ in range(5):
        own = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.stack([points[own == g].mean(0) if (own == g).any() else centres[g] for g in range(len(centres))])
    return own


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``parts`` to ``entries``, as 64-bit integers."""
    if not parts.size or not entries.size:
        return np.zeros((len(parts), len(entries)), np.int64)
    most = max(int(np.abs(parts).max()), int(np.abs(entries).max()), 1)
    if 4 * most * most * parts.shape[1] < EXACT:
        x, c = parts.astype(float), entries.astype(float)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    out = np.empty((len(parts), len(entries)), np.int64)
    for j, entry in enumerate(entries):
        gap = parts - entry
        out[:, j] = (gap * gap).sum(1)
    return out


def _below(squares: np.ndarray) -> np.ndarray:
    """Whole numbers not above the roots."""
    return np.maximum(np.sqrt(squares).astype(np.int64) - 1, 0)


def _above(squares: np.ndarray) -> np.ndarray:
    """Whole numbers above the roots."""
    return np.sqrt(squares).astype(np.int64) + 2


class Bounds(NamedTuple):
    """Of one part of a block's rows: the entry, the bound above its distance, the bounds below by group."""

    own: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def first_bounds(parts: np.ndarray, book: Book) -> Bounds:
    groups = int(book.group.max()) + 1
    far = distances(parts, book.entries)
    own = far.argmin(1)
    rows = np.arange(len(parts))
    upper = _above(far[rows, own])
    far[rows, own] = np.iinfo(np.int64).max
    return Bounds(own, upper, np.stack([_below(far[:, book.group == g].min(1)) for g in range(groups)], 1))


def next_bounds(parts: np.ndarray, before: np.ndarray, book: Book, kept: Bounds) -> tuple[Bounds, int]:
    """Bounds after the entries moved from ``before``, and how many distances were computed."""
    groups = int(book.group.max()) + 1
    moves = _above(((book.entries - before) ** 2).sum(1))
    moves[(book.entries == before).all(1)] = 0
    by_group = np.array([moves[book.group == g].max() for g in range(groups)])
    own, upper, lower = kept.own.copy(), kept.upper + moves[kept.own], np.maximum(kept.lower - by_group, 0)
    rows = np.flatnonzero(upper >= lower.min(1))
    if not len(rows):
        return Bounds(own, upper, lower), 0
    old = own[rows]
    gap = parts[rows] - book.entries[old]
    to_own = (gap * gap).sum(1)
    upper[rows] = _above(to_own)
    asked = upper[rows, None] >= lower[rows]
    some = asked.any(1)
    rows, old, to_own, asked = rows[some], old[some], to_own[some], asked[some]
    far = np.full((len(rows), len(book.entries)), np.iinfo(np.int64).max)
    done = len(some)
    for g in range(groups):
        at = np.flatnonzero(asked[:, g])
        if len(at):
            members = np.flatnonzero(book.group == g)
            far[np.ix_(at, members)] = distances(parts[rows[at]], book.entries[members])
            done += len(at) * len(members)
    each = np.arange(len(rows))
    far[each, old] = to_own
    best = far.argmin(1)
    own[rows], upper[rows] = best, _above(far[each, best])
    far[each, best] = np.iinfo(np.int64).max
    for g in range(groups):
        least = _below(far[:, book.group == g].min(1))
        lower[rows, g] = np.where(asked[:, g], least, np.minimum(lower[rows, g], least))
    return Bounds(own, upper, lower), done


def _state(bounds: list[Bounds]) -> bytes:
    return pack_arrays(*(a for b in bounds for a in (b.own.astype(np.uint8 if len(b.own) == 0 or b.own.max() < 256 else np.uint32), b.upper, b.lower.ravel())))


def _bounds(state: bytes, groups: int) -> list[Bounds]:
    arrays = unpack_arrays(state)
    return [Bounds(arrays[i].astype(np.int64), arrays[i + 1], arrays[i + 2].reshape(-1, groups)) for i in range(0, len(arrays), 3)]


def _sums(matrix: np.ndarray, own: list[np.ndarray], entries: int) -> np.ndarray:
    """Counts and component sums by part and entry."""
    out = []
    for p, codes in enumerate(own):
        one = np.zeros((len(codes), entries))
        one[np.arange(len(codes)), codes] = 1
        parts = matrix[:, p]
        out.append(np.concatenate([one.sum(0)[:, None], one.T @ parts], 1).astype(np.int64))
    return np.stack(out)


def _matrix(data: bytes, parts: int, length: int) -> np.ndarray:
    """Components of a block (rows x parts x components)."""
    low, high = unpack_arrays(data)
    return (high.astype(np.int64) + low[0]).reshape(-1, parts, length)


def _blocks(width: int, parts: int, scale: int, ids: str, labels: str):
    """Rows (id, vector, label) into blocks of integer components."""
    most = math.isqrt((1 << 62) // (4 * max(width, 1)))
    rows = max(1, min(4096, BLOCK_COMPONENTS // max(width, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                piece = batch.slice(at, rows)
                vectors = piece.column(1)
                offsets = vectors.offsets.to_numpy().astype(np.int64)
                flat = vectors.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
                lengths = np.diff(offsets)
                matrix = np.zeros((len(piece), width), np.int64)
                row = np.repeat(np.arange(len(piece)), lengths)
                place = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)
                matrix[row, place] = np.clip(np.floor(scale * flat), -most, most).astype(np.int64)
                low = int(matrix.min(initial=0))
                data = pack_arrays(np.array([low], np.int64), (matrix - low).ravel().astype(np.uint32))
                ends = pa.array([0, len(piece)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, piece.column(0)), pa.ListArray.from_arrays(ends, piece.column(2)), pa.array([data], pa.binary()), pa.array([b""], pa.binary())], names=["ids", "labels", "data", "state"])

    return tidy(run), f"ids array<{ids}>, labels array<{labels}>, data binary, state binary"


def _assigned(blocks: DataFrame, books: list[Book], before: list[np.ndarray] | None, length: int) -> DataFrame:
    """Blocks with their bounds under ``books``, their sums, and the number of distances computed."""
    groups = int(books[0].group.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                matrix = _matrix(batch.column(2)[i].as_py(), len(books), length)
                if before is None:
                    found, done = [first_bounds(matrix[:, p], b) for p, b in enumerate(books)], len(matrix) * len(books) * len(books[0].entries)
                else:
                    kept = _bounds(batch.column(3)[i].as_py(), groups)
                    moved = [next_bounds(matrix[:, p], before[p], b, kept[p]) for p, b in enumerate(books)]
                    found, done = [m[0] for m in moved], sum(m[1] for m in moved)
                sums = _sums(matrix, [b.own for b in found], len(books[0].entries))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), batch.column(2).slice(i, 1), pa.array([_state(found)], pa.binary()), pa.array([pack_arrays(sums.ravel().view(np.uint64))], pa.binary()), pa.array([done], pa.int64())],
                    names=["ids", "labels", "data", "state", "sums", "computed"],
                )

    ids, labels = (blocks.schema[c].dataType.simpleString() for c in ("ids", "labels"))
    return blocks.select("ids", "labels", "data", "state").mapInArrow(tidy(run), f"ids {ids}, labels {labels}, data binary, state binary, sums binary, computed long")


def _totals(blocks: DataFrame, slots: int) -> np.ndarray:
    """Sums of all blocks: added per task, then by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += unpack_arrays(data.as_py())[0].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(slots), pa.int32()), pa.array(total, pa.int64())], names=["slot", "total"])

    out = np.zeros(slots, np.int64)
    for slot, total in blocks.select("sums").mapInArrow(run, "slot int, total long").groupBy("slot").agg(F.sum("total")).collect():
        out[slot] = total
    return out


def _moved(books: list[Book], totals: np.ndarray) -> list[Book]:
    """Each entry at the floor of its parts' mean; entries without parts stay."""
    counts, sums = totals[:, :, :1], totals[:, :, 1:]
    return [b._replace(entries=np.where(n > 0, s // np.maximum(n, 1), b.entries)) for b, n, s in zip(books, counts, sums, strict=True)]


def _read_out(blocks: DataFrame, books: list[Book], length: int, ids: str, labels: str) -> DataFrame:
    """Rows (vec_id, label, code, error) of blocks whose bounds hold under ``books``."""
    groups, digits = int(books[0].group.max()) + 1, max(2, len(f"{len(books[0].entries) - 1:x}"))
    names = [f"{j:0{digits}x}" for j in range(len(books[0].entries))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                matrix, found = _matrix(batch.column(2)[i].as_py(), len(books), length), _bounds(batch.column(3)[i].as_py(), groups)
                gaps = np.stack([matrix[:, p] - b.entries[f.own] for p, (b, f) in enumerate(zip(books, found, strict=True))], 1)
                codes = ["".join(names[j] for j in row) for row in np.stack([f.own for f in found], 1).tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(codes, pa.string()), pa.array((gaps * gaps).sum((1, 2)), pa.int64())], names=["vec_id", "label", "code", "error"])

    return blocks.select("ids", "labels", "data", "state").mapInArrow(tidy(run), f"vec_id {ids}, label {labels}, code string, error long")


def usable(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, vector as doubles, label) whose vector has finite components only."""
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")
    return rows.filter(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _with_totals(codes: DataFrame) -> DataFrame:
    """``codes`` with the error summed over equal labels; labels with many rows never meet in one task."""
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")).withColumnRenamed("label", "of")
    labels, n = totals.agg(F.count(F.lit(1)), F.sum("n")).first()
    on = F.col("label").eqNullSafe(F.col("of"))
    if labels <= BROADCAST_LABELS:
        return codes.join(F.broadcast(totals), on).drop("of", "n")
    large = totals.filter(F.col("n") * BROADCAST_LABELS > n)
    first = codes.join(F.broadcast(large.withColumnRenamed("label_error", "early")), on, "left")
    common = first.filter(F.col("n").isNotNull()).withColumn("label_error", F.col("early"))
    rare = first.filter(F.col("n").isNull()).drop("of", "n", "early").join(totals, on)
    return common.drop("of", "n", "early").unionByName(rare.drop("of", "n"))


class Codes(NamedTuple):
    """Codes of all rows (vec_id, label, code, error), the codebooks, and the distances computed in each round."""

    rows: DataFrame
    books: list[np.ndarray]
    computed: list[int]


def compress(spark: SparkSession, vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, groups: int = GROUPS) -> Codes:
    """Fit codebooks to rows (vec_id, embedding, label) and code every usable row with them."""
    rows = usable(vectors)
    ids, labels = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    length = -(-longest // parts)
    work = Work(spark, "codes")
    pack, kind = _blocks(parts * length, parts, scale, ids, labels)
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries)
    start = [_matrix(r[0], parts, length) for r in seeds.mapInArrow(pack, kind).select("data").collect()]
    if not start:
        return Codes(spark.createDataFrame([], f"vec_id {ids}, label {labels}, code string, error long"), [], [])
    start = np.concatenate(start)
    books = [Book(start[:, p], grouped(start[:, p], groups)) for p in range(parts)]
    most = min(int(b.group.max()) for b in books) + 1
    books = [b._replace(group=np.minimum(b.group, most - 1)) for b in books]
    blocks, before, computed = work.save(rows.mapInArrow(pack, kind), "blocks", "uncompressed"), None, []
    for r in range(rounds + 1):
        last, blocks = blocks, work.save(_assigned(blocks, books, before, length), f"round-{r}", "uncompressed")
        work.drop("blocks" if r == 0 else f"round-{r - 1}")
        computed.append(blocks.agg(F.sum("computed")).first()[0])
        if r < rounds:
            totals = _totals(blocks, parts * len(start) * (length + 1)).reshape(parts, len(start), length + 1)
            before, books = [b.entries for b in books], _moved(books, totals)
    codes = work.save(_read_out(blocks, books, length, ids, labels), "result")
    work.drop(f"round-{rounds}")
    return Codes(codes, [b.entries for b in books], computed)


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, error, error of the label and digest of the codebooks for every usable row of ``embeddings``."""
    codes = compress(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return _with_totals(codes.rows).select("vec_id", "code", "error", "label_error", F.lit(digest(codes.books)).alias("codebooks_sha256"))


def sql(width: int = 64, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same rows by a full search, for vectors of ``width`` components."""
    length = width // parts
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cut AS MATERIALIZED (SELECT vec_id, p, list_transform(e[p * {length} + 1 : (p + 1) * {length}], lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM kept, range({parts}) AS t(p))",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))",
        "book0 AS MATERIALIZED (SELECT p, k, v AS c FROM cut JOIN first USING (vec_id))",
    ]
    for r in range(rounds + 1):
        gap = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"near{r} AS MATERIALIZED (SELECT vec_id, p, any_value(v) AS v, min({{'d': CAST({gap} AS BIGINT), 'k': k}}) AS m FROM cut JOIN book{r} USING (p) GROUP BY vec_id, p)")
        if r < rounds:
            steps.append(f"mean{r} AS (SELECT p, k, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY i) AS c FROM (SELECT p, m.k AS k, i, sum(v[i]) AS s, count(*) AS n FROM near{r}, range(1, {length + 1}) AS t(i) GROUP BY ALL) GROUP BY p, k)")
            steps.append(f"book{r + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(n.c, b.c) AS c FROM book{r} AS b LEFT JOIN mean{r} AS n ON b.p = n.p AND b.k = n.k)")
    return f"""WITH {", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', m.k), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), books"""
