"""N-gram Jaccard join with signature trees.

Two documents link when 100 * |A n B| >= 80 * |A u B| for their sets of distinct five-word shingles.  The steps:

1. Count, over all documents, how many hold each shingle (an exchange of hashed shingles between packed chunks).
2. Order a document's shingles from rare to frequent.  Documents that link share one of the first n - ceil(0.8 n) + 1
   of them, so only those (and of them only the ones that another document holds) can pair documents.
3. Tie the documents of a shared shingle to one of each band of set sizes, and those of neighbouring bands together, as
   sizes of a link are in the same or neighbouring bands.  The components of those ties are blocks: no link leaves a
   block.  A shingle's documents are only reduced to their least, and joined with it, so no task needs all of them.
4. In a block, a signature tree: leaves hold documents, nodes hold the OR (per-cell maximum) of token bitmaps and the
   range of sizes.  A dual traversal drops node pairs whose greatest possible overlap is too small, and node pairs
   already connected; the rest is decided by exact set intersection.  A large block is cut into sub-blocks whose pairs
   are separate tasks.
5. Components of the links found.

Texts with the same words are one class throughout, so copies are never expanded.

Defined cases: null, empty or blank texts have n_shingles 0 and are linked with nothing; a text of fewer than five words
has one shingle, its whole sequence; rows that repeat a doc_id
are linked by their texts alone, each with its own n_shingles; a null doc_id
takes part and comes back as null, and a group's component_id is its least doc_id that is not null (null where it has
none); other columns are ignored; an empty table gives an empty
result.  Shingles and texts are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import chunks as C
from quillmesh.llm.components import connected_components
from quillmesh.llm.work import Work

DF_BITS = 48
#: Shingles of one sub-block of a block (8 bytes each), and bitmap cells of a signature.
BLOCK_SHINGLES = 1_500_000
CELLS = 256
LEAF = 16
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Distinct shingle hashes, ascending, of a sequence of word hashes."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < width:
        acc = np.uint64(n)
        for w in words:
            acc = C.mix(np.array([acc], np.uint64) * _K[0] + w)[0]
        return np.array([acc], np.uint64)
    acc = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        acc += C.mix(words[j : n - width + 1 + j] * _K[j])
    return np.unique(C.mix(acc))


class _Docs:
    """Word sequences of a chunk's documents; equal sequences come once."""

    def __init__(self, chunk: C.Chunk):
        self.keys: list[bytes] = []
        self.sets: dict[bytes, np.ndarray] = {}
        self.first: dict[bytes, int] = {}
        found = C.Words(chunk.body.lower(), chunk.ends - chunk.starts)
        hashes = found.hashes()[found.code]
        cuts = np.searchsorted(found.doc, np.arange(len(chunk) + 1)).tolist()
        for i in range(len(chunk)):
            words = hashes[cuts[i] : cuts[i + 1]]
            if not len(words):
                self.keys.append(b"")
                continue
            key = xxhash.xxh3_128_digest(words.tobytes())
            self.keys.append(key)
            if key not in self.sets:
                self.sets[key] = shingles(words)
                self.first[key] = i
        self.low = [s >> np.uint64(64 - DF_BITS) for s in self.sets.values()]
        if self.low:
            self.unique, counts = np.unique(np.concatenate(self.low), return_counts=True)
        else:
            self.unique, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.counts = np.minimum(counts, 255).astype(np.uint8)


def _emit(buckets: int):
    def run(chunk: C.Chunk, _) -> dict[int, bytes]:
        docs = _Docs(chunk)
        cut = C.bucket_bounds(docs.unique, buckets, DF_BITS)
        return {b: C.pack_arrays(C.pack_sorted(docs.unique[cut[b] : cut[b + 1]]), docs.counts[cut[b] : cut[b + 1]]) for b in range(buckets) if cut[b] < cut[b + 1]}

    return run


def _count(rows: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """Documents that hold each key, in every chunk's order; 65535 stands for that many or more."""
    got = []
    for c, p in rows:
        deltas, counts = C.unpack_arrays(p)
        got.append((c, C.unpack_sorted(deltas) << np.uint64(8) | counts))
    every = np.concatenate([k for _, k in got])
    every.sort()
    starts = np.flatnonzero(np.append(True, every[1:] >> np.uint64(8) != every[:-1] >> np.uint64(8)))
    unique = every[starts] >> np.uint64(8)
    total = np.minimum(np.add.reduceat(every & np.uint64(255), starts), np.uint64(65535)).astype(np.uint16)
    return [(c, C.pack_arrays(total[np.searchsorted(unique, k >> np.uint64(8))])) for c, k in got]


ROWS_SCHEMA = "doc_id long, text_hash long, key binary, n long, prefix array<long>, shingles binary"


def _prefixes(buckets: int, percent: int):
    def run(_: int, chunk: C.Chunk, answers: dict) -> pa.Table:
        docs = _Docs(chunk)
        cut = C.bucket_bounds(docs.unique, buckets, DF_BITS)
        held = np.zeros(len(docs.unique), np.uint16)
        for b, payload in answers.get("df", {}).items():
            held[cut[b] : cut[b + 1]] = C.unpack_arrays(payload)[0]
        prefix: list = [None] * len(chunk)
        sets: list = [None] * len(chunk)
        sizes = [len(docs.sets[k]) if k else 0 for k in docs.keys]
        for (key, own), low in zip(docs.sets.items(), docs.low, strict=True):
            n = len(own)
            df = held[np.searchsorted(docs.unique, low)]
            lead = np.lexsort((own, df))[: n - (-(-percent * n // 100)) + 1]
            lead = own[lead[df[lead] >= 2]]
            if len(lead):
                prefix[docs.first[key]] = lead.view(np.int64)
                sets[docs.first[key]] = own.tobytes()
        ids = pa.array(chunk.ids, pa.int64(), mask=chunk.ids == C.NULL_ID)
        # what F.xxhash64 gives for the text
        hashes = np.array([xxhash.xxh64_intdigest(chunk.text(i), 42) for i in range(len(chunk))], np.uint64).view(np.int64)
        return pa.table({"doc_id": ids, "text_hash": pa.array(hashes, pa.int64()), "key": pa.array(docs.keys, pa.binary()), "n": pa.array(sizes, pa.int64()), "prefix": pa.array(prefix, pa.list_(pa.int64())), "shingles": pa.array(sets, pa.binary())})

    return run


class SignatureTree:
    """Documents in leaves; nodes with per-cell maxima of token counts and the range of set sizes."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        cells = np.zeros((len(sets), CELLS), np.int32)
        for i, s in enumerate(sets):
            cells[i] = np.bincount((s & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        self.size = np.array([len(s) for s in sets], np.int64)
        self.cells = cells
        self.nodes: list[tuple] = []  # (members or None, left, right, cells, least, most)
        lead = np.array([int(s[0]) if len(s) else 0 for s in sets], np.uint64)
        self.root = self._build(np.lexsort((lead, self.size))) if sets else -1

    def _build(self, members: np.ndarray) -> int:
        if len(members) <= LEAF:
            self.nodes.append((members, -1, -1, self.cells[members].max(axis=0), self.size[members].min(), self.size[members].max()))
        else:
            a, b = self._build(members[: len(members) // 2]), self._build(members[len(members) // 2 :])
            x, y = self.nodes[a], self.nodes[b]
            self.nodes.append((None, a, b, np.maximum(x[3], y[3]), min(x[4], y[4]), max(x[5], y[5])))
        return len(self.nodes) - 1


class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x


def tree_links(one: SignatureTree, two: SignatureTree | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the documents of two trees (or within one): pairs of positions.

    Positions of ``two`` follow those of ``one``.
    """
    other, shift = (two, len(one.sets)) if two is not None else (one, 0)
    union = _Union(len(one.sets) + (len(two.sets) if two is not None else 0))
    links: list[tuple[int, int]] = []
    find = union.find

    def need(a: int, b: int) -> int:
        return -(-percent * (a + b) // (100 + percent))

    def same(x: tuple, y: tuple) -> bool:
        if x[0] is None or y[0] is None:
            return False
        root = find(int(x[0][0]))
        return all(find(int(i)) == root for i in x[0]) and all(find(int(j) + shift) == root for j in y[0])

    stack = [(one.root, other.root)] if one.root >= 0 and other.root >= 0 else []
    while stack:
        a, b = stack.pop()
        x, y = one.nodes[a], other.nodes[b]
        if 100 * x[5] < percent * y[4] or 100 * y[5] < percent * x[4]:
            continue
        if np.minimum(x[3], y[3]).sum() < need(x[4], y[4]):
            continue
        own = two is None and a == b
        if x[0] is not None and y[0] is not None:
            if same(x, y):
                continue
            for i in x[0].tolist():
                js = y[0]
                if own:
                    js = js[js > i]
                js = js[(100 * np.minimum(one.size[i], other.size[js])) >= percent * np.maximum(one.size[i], other.size[js])]
                if not len(js):
                    continue
                most = np.minimum(one.cells[i], other.cells[js]).sum(axis=1)
                js = js[(100 + percent) * most >= percent * (one.size[i] + other.size[js])]
                for j in js.tolist():
                    ri, rj = find(i), find(j + shift)
                    if ri == rj:
                        continue
                    s, t = one.sets[i], other.sets[j]
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * common >= percent * (len(s) + len(t) - common):
                        union.parent[max(ri, rj)] = min(ri, rj)
                        links.append((i, j + shift))
        elif own:
            stack += [(x[1], x[2]), (x[2], x[2]), (x[1], x[1])]
        elif y[0] is not None or (x[0] is None and x[5] - x[4] >= y[5] - y[4]):
            stack += [(x[1], b), (x[2], b)]
        else:
            stack += [(a, y[1]), (a, y[2])]
    return links


def _block(percent: int):
    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side").to_numpy())
        ids, blobs = np.asarray(table.column("node").to_numpy()), table.column("shingles").to_pylist()
        split = bool(table.column("split")[0].as_py())
        order = np.argsort(side, kind="stable")
        ids, sets = ids[order], [np.frombuffer(blobs[i], np.uint64) for i in order]
        k = int((side == 0).sum()) if split else len(ids)
        links = tree_links(SignatureTree(sets[:k]), SignatureTree(sets[k:]) if split else None, percent)
        a, b = ([int(ids[p[q]]) for p in links] for q in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _groups(spark: SparkSession, docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, class_rows, group) for every row; group tells components apart
    whatever the ids of their rows, and is null for texts without words."""
    work = Work(spark, "jaccard")
    chunks = C.build_chunks(work, docs)
    buckets = C.buckets_for(chunks, 12 << 20)
    df = work.save(C.reduce_buckets(C.send(chunks, _emit(buckets)), "df", _count), "df", "uncompressed")
    rows = work.save(C.per_chunk(chunks, _prefixes(buckets, percent), ROWS_SCHEMA, df), "rows", "uncompressed")
    work.drop("chunks", "df")

    # a node is a class of equal texts, told by the hash of its key
    classes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("class_rows")).withColumn("own", F.xxhash64("key"))
    held = rows.where("prefix is not null").select("key", "n", "prefix", "shingles").dropDuplicates(["key"])
    nodes = work.save(held.select(F.xxhash64("key").alias("node"), "n", "prefix", "shingles"), "nodes", "uncompressed")
    # the base is a little over 100 / percent, so rounding parts no two sizes of a link by two bands
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(101 / percent))).cast("int")
    held_by = nodes.select("node", band.alias("band"), F.explode("prefix").alias("s"))
    least = held_by.groupBy("s", "band").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    least = work.save(least, "least", "uncompressed")
    own = held_by.join(least.where("least <> most").select("s", "band", "least"), ["s", "band"]).select(F.col("least").alias("a"), F.col("node").alias("b"))
    above = least.select("s", (F.col("band") - 1).alias("band"), F.col("least").alias("b"))
    edges = own.union(least.join(above, ["s", "band"]).select(F.col("least").alias("a"), "b"))
    blocks = connected_components(work, edges, "blocks").select(F.col("node").alias("of"), F.col("component").alias("block"))

    placed = nodes.join(blocks, F.col("node") == F.col("of")).select("node", "n", "shingles", "block")
    load = placed.groupBy("block").agg(F.sum("n").alias("load")).where(F.col("load") > BLOCK_SHINGLES)
    large = work.save(load.select("block", F.ceil(F.col("load") / BLOCK_SHINGLES).cast("int").alias("parts")), "large", "uncompressed")
    placed = placed.join(large, "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), F.when(F.col("own") <= o, 0).otherwise(1).alias("side")))
    tasks = placed.withColumn("p", F.explode(pairs)).select("block", "p.i", "p.j", "p.side", (F.col("p.i") != F.col("p.j")).alias("split"), "node", "shingles")
    # dealt out by sub-block, else the parts of one large block would all stay in the task that holds the block
    links = tasks.repartition("block", "i", "j").groupBy("block", "i", "j").applyInArrow(_block(percent), "a long, b long")
    found = connected_components(work, links, "links").select(F.col("node").alias("own"), F.col("component").alias("group"))

    least = classes.join(found, "own").groupBy("group").agg(F.min("least").alias("component_id"))
    linked = found.join(least, "group").select("own", "group", "component_id")
    # a table of its own, so that the join below is one of two shuffles and a class of many copies can be split
    known = classes.join(linked, "own", "left").select("key", "class_rows", F.when(F.col("group").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("group", "own").alias("group"))
    known = work.save(known, "known", "uncompressed")
    told = rows.select("doc_id", "text_hash", "key", F.col("n").alias("n_shingles"))
    columns = ["doc_id", "text_hash", "n_shingles", "component_id", "class_rows", "group"]
    blank = told.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "class_rows": F.lit(1).cast("long"), "group": F.lit(None).cast("long")})
    out = told.where("n_shingles > 0").join(known, "key").select(*columns).union(blank.select(*columns))
    out = work.save(out, "result")
    work.drop("rows", "nodes", "least", "known", "large", "blocks-*", "links-*")
    return out


def jaccard_components(spark: SparkSession, docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_rows) for every row of ``docs`` (doc_id, text)."""
    return _groups(spark, docs, percent).select("doc_id", "n_shingles", "component_id", "class_rows")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of each group of ``docs``, with all columns: that of the least doc_id (null after all), then the least
    hash of the text.  Rows without words are in no group and stay."""
    found = _groups(spark, docs.select("doc_id", "text"), percent).where("n_shingles > 0")
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"))
    stay = first.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_text"), F.lit(True).alias("_stays"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blank = text.rlike(r"\A[ \t\n\x0B\f\r]*\z")
    rows = docs.withColumns({"_hash": F.xxhash64(text), "_row": F.when(blank, F.monotonically_increasing_id())})
    rows = rows.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text")), "left").where("_row is not null or _stays")
    return rows.dropDuplicates(["doc_id", "_hash", "_row"]).select(*docs.columns)
