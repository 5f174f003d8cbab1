"""Packed chunks of documents and balanced exchanges of hashed keys between them.

A chunk is one row holding a few megabytes of documents.  ``exchange`` sends, for every chunk, arrays of keys to
buckets, lets a reducer see each key's entries of all chunks, and returns one answer per (chunk, bucket).  A key occurs
at most once per chunk in what is sent, so no bucket holds more than one entry per chunk for even the most frequent key,
and the bytes moved are a few per distinct key and chunk.  Chunk and answer tables are written to the shared folder, so
a lost executor costs only its own tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.caches import after_group, tidy
from quillmesh.llm.work import Work

#: Stands for a null doc_id inside chunks; it orders before every id.
NULL_ID = np.iinfo(np.int64).min
CHUNK_BYTES = 4 << 20
CHUNK_SCHEMA = "chunk_id long, n_docs long, n_bytes long, payload binary"
SENT_SCHEMA = "bucket int, chunk_id long, payload binary"
ANSWER_SCHEMA = "chunk_id long, tag string, bucket int, payload binary"


# One of each for a worker process, which has one thread; making them costs more than a small payload.
_COMPRESSOR, _DECOMPRESSOR = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(data: bytes) -> bytes:
    return _COMPRESSOR.compress(data)


def expand(data: bytes) -> bytes:
    return _DECOMPRESSOR.decompress(data)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays into compressed bytes; integers are stored as byte planes, without those above their greatest value."""
    parts = [struct.pack("<i", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.itemsize
        if planes > 1 and a.dtype.kind in "iu" and len(a):
            planes = max(1, (int(a.view(f"<u{planes}").max()).bit_length() + 7) // 8)
        body = a.view(np.uint8).reshape(len(a), a.itemsize)[:, :planes].T.tobytes() if a.itemsize > 1 else a.tobytes()
        parts += [a.dtype.str.encode().ljust(7), struct.pack("<Bq", planes, len(a)), body]
    return squeeze(b"".join(parts))


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    data = expand(data)
    (count,), at, out = struct.unpack_from("<i", data), 4, []
    for _ in range(count):
        kind = np.dtype(data[at : at + 7].strip().decode())
        planes, n = struct.unpack_from("<Bq", data, at + 7)
        at += 16
        raw = np.frombuffer(data, np.uint8, n * planes, at).reshape(planes, n)
        at += n * planes
        if planes == kind.itemsize:
            whole = np.ascontiguousarray(raw.T)
        else:
            whole = np.zeros((n, kind.itemsize), np.uint8)
            whole[:, :planes] = raw.T
        out.append(whole.view(kind).reshape(n) if n else np.zeros(0, kind))
    return out


def pack_sorted(keys: np.ndarray) -> np.ndarray:
    """Differences of ascending uint64 keys."""
    return np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys


def unpack_sorted(deltas: np.ndarray) -> np.ndarray:
    return np.cumsum(deltas, dtype=np.uint64)


def texts_of(column: pa.Array) -> tuple[np.ndarray, bytes]:
    """Lengths (-1 for null) and concatenated UTF-8 bytes of a string column."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    if not n:
        return np.zeros(0, np.int64), b""
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    lengths = np.diff(offsets)
    if column.null_count:
        dead = np.asarray(column.is_null().to_numpy(zero_copy_only=False))
        parts = [b"" if d else v for d, v in zip(dead, column.to_pylist(), strict=True)]
        return np.where(dead, -1, [len(p or b"") for p in parts]).astype(np.int64), b"".join(parts)
    body = column.buffers()[2]
    return lengths.astype(np.int64), bytes(memoryview(body)[offsets[0] : offsets[-1]]) if body is not None else b""


def pack_chunk(ids: np.ndarray, lengths: np.ndarray, body: bytes) -> bytes:
    return squeeze(struct.pack("<q", len(ids)) + ids.astype("<i8").tobytes() + lengths.astype("<i8").tobytes() + body)


class Chunk:
    """Documents of a chunk: ids, and each text as bytes (null: empty)."""

    def __init__(self, payload: bytes):
        data = expand(payload)
        (n,) = struct.unpack_from("<q", data)
        self.ids = np.frombuffer(data, "<i8", n, 8)
        lengths = np.maximum(np.frombuffer(data, "<i8", n, 8 + 8 * n), 0)
        self.body = data[8 + 16 * n :]
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, i: int) -> bytes:
        return self.body[self.starts[i] : self.ends[i]]


def _pack(limit: int, write: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        bodies: list[bytes] = []
        size = rows = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, ids, lens, bodies, size, rows
            payload = write(np.concatenate(ids), np.concatenate(lens), b"".join(bodies))
            out = pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | seq], pa.int64()), pa.array([rows], pa.int64()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())],
                names=["chunk_id", "n_docs", "n_bytes", "payload"],
            )
            seq, ids, lens, bodies, size, rows = seq + 1, [], [], [], 0, 0
            return out

        for batch in batches:
            key = batch.column(0)
            own = np.asarray(key.fill_null(NULL_ID).to_numpy(zero_copy_only=False), np.int64)
            length, body = texts_of(batch.column(1))
            ends = np.cumsum(np.maximum(length, 0))
            lo = 0
            while lo < len(own):
                base = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, base + max(limit - size, 0), "right")))
                ids.append(own[lo:hi])
                lens.append(length[lo:hi])
                bodies.append(body[base : ends[hi - 1]])
                size, rows, lo = size + int(ends[hi - 1] - base), rows + hi - lo, hi
                if size >= limit or rows >= 200_000:
                    yield flush()
        if rows:
            yield flush()

    return tidy(run)


def build_chunks(work: Work, docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, write: Callable = pack_chunk) -> DataFrame:
    """Write documents (doc_id, text) as chunks of about ``chunk_bytes``; a longer text has a chunk of its own.

    ``write(ids, lengths, body)`` makes a chunk's payload; length -1 stands for null.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return work.save(source.mapInArrow(_pack(chunk_bytes, write), CHUNK_SCHEMA), "chunks", "uncompressed")


def buckets_for(chunks: DataFrame, bytes_each: int, least: int = 8) -> int:
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(least, -(-total // bytes_each))


def send(chunks: DataFrame, emit: Callable, answers: DataFrame | None = None, read: Callable = Chunk) -> DataFrame:
    """Rows (bucket, chunk_id, payload) that ``emit(chunk, answers)`` gives for each chunk as {bucket: payload}."""

    def rows(chunk_id: int, got: dict[int, bytes]) -> pa.Table:
        return pa.table({"bucket": pa.array(list(got), pa.int32()), "chunk_id": pa.array([chunk_id] * len(got), pa.int64()), "payload": pa.array(list(got.values()), pa.binary())})

    return per_chunk(chunks, lambda chunk_id, chunk, got: rows(chunk_id, emit(chunk, got)), SENT_SCHEMA, answers, read)


def per_chunk(chunks: DataFrame, make: Callable, schema: str, answers: DataFrame | None = None, read: Callable = Chunk) -> DataFrame:
    """``make(chunk_id, read(payload), answers)`` -> Arrow table, for every chunk; answers: {tag: {bucket: payload}}."""
    if answers is None:

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk_id, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield from make(chunk_id, read(payload.as_py()), {}).to_batches()

        return chunks.select("chunk_id", "payload").mapInArrow(tidy(alone), schema)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        got: dict[str, dict[int, bytes]] = {}
        for tag, bucket, payload in zip(right.column("tag").to_pylist(), right.column("bucket").to_pylist(), right.column("payload").to_pylist(), strict=True):
            got.setdefault(tag, {})[bucket] = payload
        chunk_id = left.column("chunk_id")[0].as_py()
        out = make(chunk_id, read(left.column("payload")[0].as_py()), got)
        after_group()
        return out

    return chunks.select("chunk_id", "payload").groupBy("chunk_id").cogroup(answers.groupBy("chunk_id")).applyInArrow(both, schema)


def reduce_buckets(sent: DataFrame, tag: str, reduce: Callable) -> DataFrame:
    """``reduce([(chunk_id, payload)])`` -> [(chunk_id, payload)] for each bucket."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        got = reduce(list(zip(table.column("chunk_id").to_pylist(), table.column("payload").to_pylist(), strict=True)))
        after_group()
        return pa.table({"chunk_id": pa.array([c for c, _ in got], pa.int64()), "tag": pa.array([tag] * len(got), pa.string()), "bucket": pa.array([bucket] * len(got), pa.int32()), "payload": pa.array([p for _, p in got], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, ANSWER_SCHEMA)


def bucket_bounds(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Positions in ascending keys below 2**bits where each of ``buckets`` equal ranges begins, and the end."""
    edges = np.array([(b << bits) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, edges, "left"), len(keys))


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Words of concatenated texts, which ASCII white space parts: the distinct ones (``every``), and for each word its
    number among them (``code``), its text (``doc``) and its place [``first``, ``last``) in the bytes."""

    def __init__(self, body: bytes, lengths: np.ndarray):
        raw = np.frombuffer(body, np.uint8)
        ends = np.cumsum(lengths)
        blank = _BLANK[raw]
        edge = np.ones(len(raw) + 1, bool)
        edge[1:-1] = blank[1:] != blank[:-1]
        edge[ends - lengths] = True
        at = np.flatnonzero(edge)
        held = ~blank[at[:-1]] if len(raw) else np.zeros(0, bool)
        self.first, self.last = at[:-1][held], at[1:][held]
        self.doc = np.searchsorted(ends, self.first, "right")
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(body)])
        coded = pc.dictionary_encode(runs.filter(pa.array(held)))
        self.every, self.code = coded.dictionary, coded.indices.to_numpy()

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the distinct words."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.every.to_pylist()), np.uint64, len(self.every))


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in the order of their first places, and for each key its number among them."""
    coded = pc.dictionary_encode(pa.array(keys))
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
