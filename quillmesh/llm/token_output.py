"""Token ids in fixed-width bit-packed shards.

Format of a shard (all integers little-endian): magic ``QMTB``, version u16, bits u16, block size u32, number of
documents u64, number of ids u64, number of blocks u64; then per document its doc_id i64 and number of ids u64; then
per block its byte offset in the body u64; then the body.  An id takes ``bits`` bits, most significant first: the least
number that holds every id of the vocabulary.  Every block holds ``block size`` ids (the last one fewer) and starts on
a byte, so ids [a, b) of a shard are read from the blocks that hold them alone.

A shard is one row (shard, first_id, n_docs, n_ids, payload) of a Parquet table in the shared folder, as executors may
see no other common store; ``export_shard`` writes a payload to a file.  Shards hold documents in ascending doc_id order.

Encoding is the tokenizers library's own, strings of special tokens in a text included (``special_as_text`` makes them
ordinary text).  With a byte-level split, a word starts at each blank or line end before a visible character whatever
stands before it, so a block of documents is cut there, the distinct pieces are encoded by the library as one text, and
their ids are put back in place; the lengths of the tokens in bytes tell where a piece ends.  Texts with a special
token's string, and all texts of other tokenizers, are encoded whole.

Defined cases: null and empty texts give just the end id; a null doc_id orders first and comes back as null; rows that
repeat a doc_id are ordered by text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm import chunks as C
from quillmesh.llm.caches import tidy
from quillmesh.llm.work import Work

MAGIC, VERSION, BLOCK_IDS, END_ID = b"QMTB", 1, 4096, 2
HEAD = struct.Struct("<4sHHIQQQ")
NULL_ID = np.iinfo(np.int64).min
SHARD_SCHEMA = "part int, seq long, n_docs long, n_ids long, payload binary"


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype(">u2").tobytes()
    planes = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(planes.reshape(-1)).tobytes()


def unpack_bits(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, ">u2", count).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits).reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - bits :] = planes
    return np.packbits(wide, axis=1).view(">u4").reshape(count).astype(np.uint32)


def write_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK_IDS) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    cuts = range(0, len(ids), block)
    body = [pack_bits(ids[i : i + block], bits) for i in cuts]
    offsets = np.cumsum([0, *map(len, body)])[:-1] if body else np.zeros(0)
    head = HEAD.pack(MAGIC, VERSION, bits, block, len(doc_ids), len(ids), len(body))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), lengths.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), *body])


class ShardReader:
    """Random access to the ids of a shard."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.block, docs, self.n_ids, blocks = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.lengths = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", blocks, at + 16 * docs).astype(np.int64)
        self.data, self.body = data, at + 16 * docs + 8 * blocks
        self.starts = np.cumsum(self.lengths) - self.lengths

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        parts = []
        for b in range(first, last + 1):
            count = min(self.block, self.n_ids - b * self.block)
            at = self.body + int(self.offsets[b])
            parts.append(unpack_bits(self.data[at : at + (count * self.bits + 7) // 8], count, self.bits))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i] + self.lengths[i]))


def export_shard(payload: bytes, path: str) -> None:
    with open(path, "wb") as file:
        file.write(payload)


#: Bytes of text cut at once, and of distinct pieces that the library takes at once (it needs some hundred bytes for each).
BLOCK_BYTES, CALL_BYTES = 6 << 20, 1 << 16
#: Pieces that a worker remembers from block to block.
KEEP = 800_000
# Bytes after a blank that certainly begin a visible character: no control, and no lead of a multi-byte white space.
_VISIBLE = np.ones(256, bool)
_VISIBLE[:33] = _VISIBLE[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False


def pieces_of(body: bytes, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of concatenated texts begin, which are encoded alike wherever they stand, and the end."""
    raw = np.frombuffer(body, np.uint8)
    first = np.zeros(len(raw) + 1, bool)
    if len(raw):
        first[:-2] = ((raw[:-1] == 32) | (raw[:-1] == 10)) & _VISIBLE[raw[1:]]
    # a text's last blank is followed by nothing
    first[starts[starts > 0] - 1] = False
    first[starts] = first[-1] = True
    return np.flatnonzero(first)


class Encoder:
    """ids of texts by the library."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        split = repr(self.tokenizer.pre_tokenizer)
        self.byte_level = self.tokenizer.normalizer is None and split.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in split
        if self.byte_level:
            # every character of a byte-level token stands for one byte
            self.sizes = np.zeros(self.vocabulary, np.int64)
            for token, i in self.tokenizer.get_vocab().items():
                self.sizes[i] = len(token)
        self.forget()

    def forget(self) -> None:
        """Pieces remembered: their numbers, and by number the first and the count of their ids in ``flat``."""
        self.known = pa.array([], pa.large_binary())
        self.flat, self.begin, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _distinct(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """ids of each of some distinct pieces, one after the other, and how many each has."""
        offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1 + words.offset)[words.offset :]
        body = words.buffers()[2]
        raw = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        sizes = np.diff(offsets)
        lead = raw[np.minimum(offsets[:-1], len(raw) - 1)]
        joins = (sizes > 1) & ((lead == 32) | (lead == 10))
        joins[joins] = _VISIBLE[raw[offsets[:-1][joins] + 1]]
        counts = np.zeros(len(words), np.int64)
        one = words.filter(pa.array(joins))
        at = np.frombuffer(one.buffers()[1], np.int64, len(one) + 1 + one.offset)[one.offset :]
        calls = np.unique(np.append(np.searchsorted(at, np.arange(at[0], at[-1], CALL_BYTES)), len(one))) if len(one) else np.zeros(1, np.int64)
        parts = [self._whole([bytes(memoryview(one.buffers()[2])[at[a] : at[b]]).decode()])[0] for a, b in zip(calls[:-1].tolist(), calls[1:].tolist(), strict=True)]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        reach = np.append(0, np.cumsum(self.sizes[ids]))
        ends = np.searchsorted(reach, at - at[0])
        if (reach[np.minimum(ends, len(ids))] != at - at[0]).any():
            raise ValueError("a token reaches over the end of a piece")
        counts[joins] = np.diff(ends)
        rest = np.flatnonzero(~joins)
        other = self._whole([v.decode() for v in words.take(pa.array(rest)).to_pylist()])
        counts[rest] = [len(x) for x in other]
        out = np.empty(int(counts.sum()), np.uint32)
        mine = np.repeat(joins, counts)
        out[mine] = ids
        out[~mine] = np.concatenate(other) if other else np.zeros(0, np.uint32)
        return out, counts

    def _numbers(self, words: pa.LargeBinaryArray) -> np.ndarray:
        """Numbers of distinct pieces; those not remembered are encoded."""
        if len(self.known) > KEEP:
            self.forget()
        found = pc.index_in(words, value_set=self.known)
        out = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.flatnonzero(out < 0)
        if len(fresh):
            new = words.take(pa.array(fresh))
            flat, counts = self._distinct(new)
            out[fresh] = len(self.counts) + np.arange(len(fresh))
            self.known = pa.concat_arrays([self.known, new])
            self.begin = np.append(self.begin, len(self.flat) + np.cumsum(counts) - counts)
            self.flat, self.counts = np.append(self.flat, flat), np.append(self.counts, counts)
        return out

    def encode(self, body: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of concatenated texts, and how many each has."""
        ends = np.cumsum(lengths)
        starts = ends - lengths
        if not self.byte_level or any(s in body for s in self.special):
            texts = [body[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            odd = np.array([not self.byte_level or any(s in t for s in self.special) for t in texts], bool)
            plain = [t for t, o in zip(texts, odd, strict=True) if not o]
            ids, counts = self._pieces(b"".join(plain), lengths[~odd])
            cuts = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [])
            whole = iter(self._whole([t.decode() for t, o in zip(texts, odd, strict=True) if o]))
            parts = [next(whole) if o else next(cuts) for o in odd]
            return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.array([len(p) for p in parts], np.int64)
        return self._pieces(body, lengths)

    def _pieces(self, body: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not body:
            return np.zeros(0, np.uint32), np.zeros(len(lengths), np.int64)
        starts = np.cumsum(lengths) - lengths
        at = pieces_of(body, starts)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(body)])
        coded = pc.dictionary_encode(found)
        which = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        sizes, begin = self.counts[which], self.begin[which]
        ids = self.flat[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        sums = np.append(0, np.cumsum(sizes))
        edges = sums[np.searchsorted(at, np.append(starts, len(body)))]
        return ids, np.diff(edges)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder_of(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder for each worker process, kept from task to task."""
    key = (path, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def _shards(path: str, special_as_text: bool, bits: int, end_id: int, shard_ids: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, seq = encoder_of(path, special_as_text), TaskContext.get().partitionId(), 0
        keys: list[np.ndarray] = []
        coded: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, keys, coded, counts, held
            doc_ids, lengths = np.concatenate(keys), np.concatenate(counts)
            payload = write_shard(doc_ids, lengths, np.concatenate(coded), bits)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(doc_ids)], pa.int64()), pa.array([held], pa.int64()), pa.array([payload], pa.binary())], names=["part", "seq", "n_docs", "n_ids", "payload"])
            seq, keys, coded, counts, held = seq + 1, [], [], [], 0
            return out

        for batch in batches:
            own = np.asarray(batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False), np.int64)
            lengths, body = C.texts_of(batch.column(1))
            lengths = np.maximum(lengths, 0)
            ends = np.cumsum(lengths)
            lo = 0
            while lo < len(own):
                base = int(ends[lo] - lengths[lo])
                hi = max(lo + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, "right")))
                ids, n = encoder.encode(body[base : int(ends[hi - 1])], lengths[lo:hi])
                keys.append(own[lo:hi])
                counts.append(n + 1)
                coded.append(np.insert(ids, np.cumsum(n), end_id).astype(np.uint32))
                held += len(coded[-1])
                lo = hi
                if held >= shard_ids:
                    yield flush()
        if keys:
            yield flush()

    return tidy(run)


def write_tokens(spark: SparkSession, work: Work, docs: DataFrame, path: str, end_id: int = END_ID, shard_ids: int = 4_000_000, special_as_text: bool = False) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write shards in ascending doc_id order; returns the table of shards."""
    bits = max(1, (max(encoder_of(path, special_as_text).vocabulary, end_id + 1) - 1).bit_length())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.md5("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return work.save(ordered.mapInArrow(_shards(path, special_as_text, bits, end_id, shard_ids), SHARD_SCHEMA), "shards", "uncompressed")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            reader = ShardReader(payload.as_py())
            n = len(reader.doc_ids)
            every = memoryview(reader.ids(0, reader.n_ids).astype("<u4")).cast("B")
            crc = [zlib.crc32(every[4 * a : 4 * (a + k)]) for a, k in zip(reader.starts.tolist(), reader.lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int64()), pa.array(reader.doc_ids, pa.int64(), mask=reader.doc_ids == NULL_ID), pa.array(reader.starts, pa.int64()), pa.array(reader.lengths, pa.int64()), pa.array(crc, pa.int64())],
                names=["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def read_digest(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the shards.

    The ids before a shard are those of the parts before its own, one number for each task that wrote, and those of the
    shards before it in its part.
    """
    sums = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    bases, at = [], 0
    for part in sorted(sums):
        bases.append((part, at))
        at += sums[part]
    parts = shards.sparkSession.createDataFrame(bases, "part int, base long")
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    places = shards.select("part", "seq", F.coalesce(before, F.lit(0)).alias("inside")).join(parts, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("base"))
    each = shards.select("part", "seq", "payload").mapInArrow(tidy(_digest), "part int, seq long, doc_id long, within long, n_tokens long, ids_crc32 long")
    return each.join(places, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_digest(write_tokens(spark, Work(spark, "tokens"), docs, default_path()))
