"""Removal of repeated byte strings with range-partitioned suffixes.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id.  Sorting all suffixes
of the corpus would move fifty times its size, so the suffixes are thinned first without losing a match:

1. Every 50-byte window has an anchor: the 24-byte string in it with the least hash (the leftmost of equals).  Equal
   windows have equal anchors at equal places.  Anchors are counted over all documents by an exchange of hashes; a
   window whose anchor no other document has is unique and needs no sorting.
2. The remaining suffixes are those of the windows of shared anchors.  Splitters sampled from the anchors' leading bytes
   range-partition them; windows of one anchor travel as one string, equal strings of a chunk once, with the least
   doc_id that has them.  Equal leading bytes always fall on the same side of a splitter, and a range that one
   leading string fills is cut further by the rest of the anchor, so no comparison is left across a boundary.
   An anchor that ``HOT_DOCS`` documents hold is spread over all buckets: its windows fall into classes by how many bytes
   of them stand before the anchor, and those of a class are dealt out by the bytes around the anchor that all of them
   have.  Equal windows are of one class and share these bytes, so they still meet.
3. In a bucket a multikey quicksort orders the windows: by their first eight bytes, then each run of equals by the next
   eight, and so on; runs left at the end are equal windows, whose least doc_id decides.
4. The verdicts go back to the chunks, which mark the covered bytes.

Defined cases: null and empty texts, and texts under 50 bytes, lose nothing; rows with the same doc_id never remove
bytes from each other; a null doc_id orders before all ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm import chunks as C
from quillmesh.llm.work import Work

SPAN, ANCHOR = 50, 24
HASH_BITS = 48
#: Bytes of concatenated text handled at once, few enough for a processor's cache; positions in it fit the low bits of a
#: sliding key.
BLOCK = 1 << 17
_POS = np.uint64((1 << 20) - 1)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
SAMPLE, HOT_DOCS = 65_536, 20_000
#: Classes of a hot anchor's windows, by the least and greatest number of bytes before the anchor.
CLASSES = ((0, 6), (7, 12), (13, 19), (20, SPAN - ANCHOR))


def words_at(data: bytes) -> np.ndarray:
    """For every position, the eight bytes from it as a little-endian number (zeros after the end)."""
    n = len(data)
    padded = data + bytes(16)
    out = np.empty((n + 7) // 8 * 8, np.uint64)
    for o in range(8):
        out[o::8] = np.frombuffer(padded, "<u8", (n + 7) // 8, o)
    return out[:n]


def anchor_runs(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (document, first window, last window, anchor, anchor hash), positions in ``data``.

    Documents lie at [starts[i], ends[i]) one after the other; a run stays inside its document.
    """
    n = len(data)
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    if n < SPAN:
        return empty
    w = words_at(data)
    m = n - ANCHOR + 1
    h = C.mix((w[:m] * _K[0]) ^ C.mix(w[8 : m + 8] * _K[1]) ^ (w[16 : m + 16] * _K[2]))
    key = (h & ~_POS) | np.arange(m, dtype=np.uint64)
    m2 = np.minimum(key[:-1], key[1:])
    m4 = np.minimum(m2[:-2], m2[2:])
    m8 = np.minimum(m4[:-4], m4[4:])
    m16 = np.minimum(m8[:-8], m8[8:])
    width = SPAN - ANCHOR + 1
    best = np.minimum(m16[: n - SPAN + 1], m16[width - 16 : width - 16 + n - SPAN + 1])
    at = (best & _POS).astype(np.int64)
    doc = np.repeat(np.arange(len(starts)), ends - starts)[: len(at)]
    valid = np.arange(len(at)) + SPAN <= ends[doc]
    fresh = np.append(True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(fresh & valid)
    if not len(first):
        return empty
    stop = np.flatnonzero(np.append((fresh & valid)[1:] | ~valid[1:], True) & valid)
    return doc[first], first, stop, at[first], h[at[first]] >> np.uint64(64 - HASH_BITS)


def blocks_of(chunk: C.Chunk):
    """(first document, data, starts, ends): documents of a block; a longer document comes in overlapping pieces."""
    i = 0
    while i < len(chunk):
        if chunk.ends[i] - chunk.starts[i] > BLOCK:
            a, b = int(chunk.starts[i]), int(chunk.ends[i])
            for at in range(a, b - SPAN + 1, BLOCK - SPAN + 1):
                piece = chunk.body[at : min(b, at + BLOCK)]
                yield i, at, piece, np.array([0]), np.array([len(piece)])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(chunk.ends, chunk.starts[i] + BLOCK, "right")))
        base = int(chunk.starts[i])
        yield i, base, chunk.body[base : chunk.ends[j - 1]], chunk.starts[i:j] - base, chunk.ends[i:j] - base
        i = j


def runs_of(chunk: C.Chunk):
    """(first document, place, data, runs of windows with one anchor) of a chunk's blocks that have windows."""
    for i, base, data, starts, ends in blocks_of(chunk):
        runs = anchor_runs(data, starts, ends)
        if len(runs[0]):
            yield i, base, data, runs


def _keys(blocks: list) -> np.ndarray:
    """Distinct anchor hashes of blocks."""
    if not blocks:
        return np.zeros(0, np.uint64)
    every = np.sort(np.concatenate([runs[4] for _, _, _, runs in blocks]))
    return every[np.append(True, every[1:] != every[:-1])]


def _anchors(chunk: C.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor hashes of a chunk, and how many of its documents have them (65535: that many or more)."""
    parts = []
    for i, _, _, (doc, _, _, _, h) in runs_of(chunk):
        ids = chunk.ids[doc + i]
        fresh = np.lexsort((ids, h))
        h, ids = h[fresh], ids[fresh]
        keep = np.append(True, (h[1:] != h[:-1]) | (ids[1:] != ids[:-1]))
        parts.append((h[keep], ids[keep]))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16)
    h, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(h, kind="stable")
    h, ids = h[order], ids[order]
    fresh = np.append(True, h[1:] != h[:-1])
    starts = np.flatnonzero(fresh)
    # an id's parts of one block come together; rows of one id that lie in several blocks may count twice, but not as two
    docs = np.add.reduceat((fresh | np.append(True, ids[1:] != ids[:-1])).astype(np.int64), starts)
    alone = np.maximum.reduceat(ids, starts) == np.minimum.reduceat(ids, starts)
    return h[starts], np.where(alone, 1, np.minimum(docs, 65535)).astype(np.uint16)


def _emit(buckets: int):
    def run(chunk: C.Chunk, _) -> dict[int, bytes]:
        keys, many = _anchors(chunk)
        cut = C.bucket_bounds(keys, buckets, HASH_BITS)
        return {b: C.pack_arrays(C.pack_sorted(keys[cut[b] : cut[b + 1]]), many[cut[b] : cut[b + 1]]) for b in range(buckets) if cut[b] < cut[b + 1]}

    return run


def _held(some: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys are among some, both ascending."""
    if not len(some):
        return np.zeros(len(keys), bool)
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


def _shared(hot_docs: int):
    def run(rows: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
        """For each chunk's keys, whether several documents of all chunks have them, and whether ``hot_docs`` have."""
        got = []
        for c, p in rows:
            deltas, docs = C.unpack_arrays(p)
            got.append((c, C.unpack_sorted(deltas), docs))
        # a key's 48 bits and 16 of its count are sorted in one number
        every = np.concatenate([k << np.uint64(16) | d for _, k, d in got])
        every.sort()
        starts = np.flatnonzero(np.append(True, every[1:] >> np.uint64(16) != every[:-1] >> np.uint64(16)))
        total = np.add.reduceat(every & np.uint64(65535), starts)
        unique = every[starts] >> np.uint64(16)
        several, hot = unique[total > 1], unique[total >= hot_docs]
        return [(c, C.pack_arrays(np.packbits(_held(several, k)), np.packbits(_held(hot, k)))) for c, k, _ in got]

    return run


def leading(data: bytes) -> int:
    return int.from_bytes(data[:8], "big")


class _Suffixes:
    """A chunk's runs of windows with shared anchors; equal strings once, with the least doc_id that has them."""

    def __init__(self, chunk: C.Chunk, buckets: int, answers: dict):
        blocks = list(runs_of(chunk))
        keys = _keys(blocks)
        cut = C.bucket_bounds(keys, buckets, HASH_BITS)
        flag, often = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        for b, payload in answers.items():
            n = cut[b + 1] - cut[b]
            several, hot = C.unpack_arrays(payload)
            flag[cut[b] : cut[b + 1]] = np.unpackbits(several, count=n).astype(bool)
            often[cut[b] : cut[b + 1]] = np.unpackbits(hot, count=n).astype(bool)
        shared, often = keys[flag], often[flag]
        #: Class of each string: that of the windows of a hot anchor, or -1.
        self.kind: list[int] = []
        self.strings: dict[tuple[bytes, int, int], int] = {}
        self.least: list[int] = []
        doc_parts, at_parts, string_parts = [], [], []
        for i, base, data, (doc, first, last, at, h) in blocks if len(shared) else ():
            where = np.searchsorted(shared, h)
            hit = np.flatnonzero(shared[np.minimum(where, len(shared) - 1)] == h)
            doc, first, last, at = doc[hit], first[hit], last[hit], at[hit]
            kind = np.full(len(hit), -1)
            if often.any() and (hot := often[where[hit]]).any():
                doc, first, last, at, kind = _classes(hot, doc, first, last, at)
            which = np.empty(len(first), np.int64)
            ids = chunk.ids[doc + i].tolist()
            strings, least, kinds = self.strings, self.least, self.kind
            for k, (s, e, a, own, c) in enumerate(zip(first.tolist(), last.tolist(), at.tolist(), ids, kind.tolist(), strict=True)):
                key = (data[s : e + SPAN], a - s, c)
                n = strings.get(key)
                if n is None:
                    n = strings[key] = len(least)
                    least.append(own)
                    kinds.append(c)
                elif own < least[n]:
                    least[n] = own
                which[k] = n
            doc_parts.append(doc + i)
            at_parts.append(first + base)
            string_parts.append(which)
        cat = lambda p: np.concatenate(p) if p else np.zeros(0, np.int64)
        self.doc, self.at, self.string = cat(doc_parts), cat(at_parts), cat(string_parts)


def _classes(hot: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with those of hot anchors cut into classes, and each run's class (-1: not hot)."""
    parts = [(doc[~hot], first[~hot], last[~hot], at[~hot], np.full(int((~hot).sum()), -1))]
    doc, first, last, at = doc[hot], first[hot], last[hot], at[hot]
    for c, (few, many) in enumerate(CLASSES):
        a, b = np.maximum(first, at - many), np.minimum(last, at - few)
        some = a <= b
        parts.append((doc[some], a[some], b[some], at[some], np.full(int(some.sum()), c)))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _around(s: bytes, a: int, c: int) -> bytes:
    """What all windows of a hot anchor's class have: the class, the anchor, and bytes on both its sides."""
    few, many = CLASSES[c]
    return bytes([c]) + s[a - few : a + SPAN - many]


def _route(splitters: np.ndarray, fans: np.ndarray, offsets: np.ndarray, strings) -> np.ndarray:
    """Bucket of each string, by the leading bytes of its anchor; ranges that one leading string fills are fanned out,
    and strings of hot anchors are dealt to all buckets."""
    to = _by_range(splitters, fans, offsets, strings)
    every = int(offsets[-1] + fans[-1])
    for n, (s, a, c) in enumerate(strings):
        if c >= 0:
            to[n] = xxhash.xxh3_64_intdigest(_around(s, a, c)) % every
    return to


def _by_range(splitters: np.ndarray, fans: np.ndarray, offsets: np.ndarray, strings) -> np.ndarray:
    lanes = np.frombuffer(b"".join([s[a : a + ANCHOR] for s, a, _ in strings]), "<u8").reshape(len(strings), 3)
    part = np.searchsorted(splitters, lanes[:, 0].byteswap(), "right")
    rest = lanes[:, 1] ^ lanes[:, 2]
    return offsets[part] + (C.mix(rest) % fans[part].astype(np.uint64)).astype(np.int64)


def _send_suffixes(buckets: int, plan: tuple):
    def run(chunk: C.Chunk, answers: dict) -> dict[int, bytes]:
        own = _Suffixes(chunk, buckets, answers.get("anchor", {}))
        if not own.least:
            return {}
        strings = list(own.strings)
        to = _route(*plan, strings)
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.append(True, to[order][1:] != to[order][:-1]))
        least = np.array(own.least, np.int64)
        out = {}
        for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            some = order[a:b]
            body = b"".join(strings[i][0] for i in some)
            out[int(to[some[0]])] = C.pack_arrays(np.array([len(strings[i][0]) for i in some], np.uint8), np.array([strings[i][1] for i in some], np.uint8), least[some], np.frombuffer(body, np.uint8))
        return out

    return run


def equal_runs(lanes: np.ndarray) -> np.ndarray:
    """Multikey quicksort: a number for each row of ``lanes`` (rows x columns), the same for equal rows only.

    Rows are sorted by the first column; each run of equals is then sorted by the next column, until runs are single
    rows or columns end.
    """
    n = len(lanes)
    label = np.zeros(n, np.int64)
    live = np.arange(n)
    group = np.zeros(n, np.int64)
    used = 0
    for j in range(lanes.shape[1]):
        if not len(live):
            break
        order = np.lexsort((lanes[live, j], group)) if j else np.argsort(lanes[live, 0], kind="quicksort")
        live, group = live[order], group[order]
        col = lanes[live, j]
        fresh = np.append(True, (col[1:] != col[:-1]) | (group[1:] != group[:-1]))
        group = np.cumsum(fresh) - 1
        size = np.bincount(group)
        alone = size[group] == 1
        label[live[alone]] = used + np.arange(int(alone.sum()))
        used += int(alone.sum())
        live, group = live[~alone], group[~alone]
    if len(live):
        fresh = np.append(True, group[1:] != group[:-1])
        label[live] = used + np.cumsum(fresh) - 1
    return label


def _verdicts(rows: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """For each window of each chunk's strings, whether a smaller doc_id than the string's least has it."""
    ids: dict[tuple[bytes, int], int] = {}
    least: list[int] = []
    mine: list[tuple[int, np.ndarray, np.ndarray]] = []
    for c, payload in rows:
        lengths, places, low, body = C.unpack_arrays(payload)
        data, at = body.tobytes(), 0
        which = np.empty(len(lengths), np.int64)
        for k, (n, a, d) in enumerate(zip(lengths.tolist(), places.tolist(), low.tolist(), strict=True)):
            key = (data[at : at + n], a)
            at += n
            i = ids.get(key)
            if i is None:
                i = ids[key] = len(least)
                least.append(d)
            elif d < least[i]:
                least[i] = d
            which[k] = i
        mine.append((c, which, low))
    strings = list(ids)
    windows = np.array([len(s) - SPAN + 1 for s, _ in strings], np.int64)
    first = np.cumsum(windows) - windows
    best = np.empty(int(windows.sum()), np.int64)
    # windows are equal only under equal anchors, so strings are handled in runs of anchors of a bounded size
    order = sorted(range(len(strings)), key=lambda i: strings[i][0][strings[i][1] : strings[i][1] + ANCHOR])
    low = np.array(least, np.int64)
    lo = 0
    while lo < len(order):
        hi, total = lo, 0
        while hi < len(order) and (total < 200_000 or _anchor(strings[order[hi]]) == _anchor(strings[order[hi - 1]])):
            total += int(windows[order[hi]])
            hi += 1
        some = np.array(order[lo:hi])
        data = b"".join(strings[i][0] for i in some)
        sizes = windows[some] + SPAN - 1
        base = np.cumsum(sizes) - sizes
        count = windows[some]
        inner = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(base, count) + inner
        w = words_at(data)
        lanes = np.stack([w[at + 8 * j] for j in range(6)] + [w[at + SPAN - 8]], axis=1)
        label = equal_runs(lanes)
        value = np.full(int(label.max()) + 1, np.iinfo(np.int64).max)
        owner = np.repeat(low[some], count)
        np.minimum.at(value, label, owner)
        best[np.repeat(first[some], count) + inner] = value[label]
        lo = hi
    out = []
    for c, which, low_c in mine:
        count = windows[which]
        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        gone = best[np.repeat(first[which], count) + inner] < np.repeat(low_c, count)
        out.append((c, C.squeeze(np.packbits(gone).tobytes())))
    return out


def _anchor(string: tuple[bytes, int]) -> bytes:
    return string[0][string[1] : string[1] + ANCHOR]


OUT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed_mask(chunk: C.Chunk, buckets: int, plan: tuple, answers: dict) -> np.ndarray:
    own = _Suffixes(chunk, buckets, answers.get("anchor", {}))
    edge = np.zeros(len(chunk.body) + 1, np.int32)
    if own.least:
        strings = list(own.strings)
        windows = np.array([len(s) - SPAN + 1 for s, _, _ in strings], np.int64)
        to = _route(*plan, strings)
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.append(True, to[order][1:] != to[order][:-1]))
        first = np.cumsum(windows) - windows
        gone = np.zeros(int(windows.sum()), bool)
        for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            some = order[a:b]
            count = windows[some]
            inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            bits = np.unpackbits(np.frombuffer(C.expand(answers["suffix"][int(to[some[0]])]), np.uint8), count=len(inner))
            gone[np.repeat(first[some], count) + inner] = bits.astype(bool)
        least = np.array(own.least, np.int64)
        for lo in range(0, len(own.at), 100_000):
            string, at, doc = own.string[lo : lo + 100_000], own.at[lo : lo + 100_000], own.doc[lo : lo + 100_000]
            count = windows[string]
            inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            hit = gone[np.repeat(first[string], count) + inner] | np.repeat(chunk.ids[doc] > least[string], count)
            start = (np.repeat(at, count) + inner)[hit]
            np.add.at(edge, start, 1)
            np.add.at(edge, start + SPAN, -1)
    return np.cumsum(edge[:-1]) > 0


def _apply(buckets: int, plan: tuple):
    def run(_: int, chunk: C.Chunk, answers: dict) -> pa.Table:
        mask = removed_mask(chunk, buckets, plan, answers)
        removed, spans, kept = [], [], []
        raw = np.frombuffer(chunk.body, np.uint8)
        for a, b in zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True):
            m = mask[a:b]
            n = int(m.sum())
            removed.append(n)
            spans.append(int(m[0]) + int((m[1:] & ~m[:-1]).sum()) if n else 0)
            kept.append(hashlib.sha256(raw[a:b][~m].tobytes() if n else chunk.body[a:b]).hexdigest())
        return pa.table({"doc_id": pa.array(chunk.ids, pa.int64(), mask=chunk.ids == C.NULL_ID), "n_bytes": pa.array(chunk.ends - chunk.starts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(kept, pa.string())})

    return run


def _sample(chunk_id: int, chunk: C.Chunk, answers: dict) -> pa.Table:
    """Leading bytes of a few occurrences of anchors, chosen by a hash of their places, with that hash."""
    lead, order = [], []
    for _, base, data, (_, _, _, at, _) in runs_of(chunk):
        place = C.mix((at + base).astype(np.uint64) + C.mix(np.full(1, chunk_id, np.int64).view(np.uint64))) >> np.uint64(1)
        few = np.flatnonzero(place % np.uint64(512) == 0)
        lead += [leading(data[a : a + 8]) for a in at[few].tolist()]
        order += place[few].tolist()
    return pa.table({"h": pa.array(order, pa.int64()), "lead": pa.array(np.array(lead, np.uint64).view(np.int64), pa.int64())})


def splitters_of(chunks: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Splitters of the anchors' leading bytes from at most ``SAMPLE`` anchors, the number of buckets of each range, and the first."""
    rows = C.per_chunk(chunks, _sample, "h long, lead long").orderBy("h").limit(SAMPLE).collect()
    lead = np.sort(np.array([r["lead"] for r in rows], np.int64).view(np.uint64))
    if not len(lead):
        return np.zeros(0, np.uint64), np.ones(1, np.int64), np.zeros(1, np.int64)
    picks = lead[(np.arange(1, buckets) * len(lead)) // buckets]
    splitters, times = np.unique(picks, return_counts=True)
    # a splitter drawn several times begins a range that its own value fills
    fans = np.concatenate([[1], times]).astype(np.int64)
    return splitters, fans, np.cumsum(fans) - fans


def dedup_suffixes(spark: SparkSession, docs: DataFrame, hot_docs: int = HOT_DOCS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs`` (doc_id, text)."""
    work = Work(spark, "suffix")
    chunks = C.build_chunks(work, docs)
    buckets = C.buckets_for(chunks, 16 << 20)
    anchors = work.save(C.reduce_buckets(C.send(chunks, _emit(buckets)), "anchor", _shared(hot_docs)), "anchors", "uncompressed")
    work.settle()
    plan = splitters_of(chunks, C.buckets_for(chunks, 8 << 20))
    sent = C.send(chunks, _send_suffixes(buckets, plan), anchors)
    suffixes = work.save(C.reduce_buckets(sent, "suffix", _verdicts), "suffixes", "uncompressed")
    out = work.save(C.per_chunk(chunks, _apply(buckets, plan), OUT_SCHEMA, anchors.union(suffixes)), "result")
    work.drop("chunks", "anchors", "suffixes")
    work.settle()
    return out


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
