"""Language-model scoring with a probabilistic suffix tree over words.

The root holds smoothed word frequencies.  A context of one to ``DEPTH`` words is a state of the tree if it passes a
divergence test: the leave-one-out log-likelihood gain of its next-word counts over the distribution of its suffix,
sum over x of N(sx) ln(P(x | s without one) / P(x | suffix)), is positive.  A word is scored in the longest suffix of
what stands before it that is a state, and a state's distribution is smoothed with that of its suffix:
P(x | s) = (N(sx) + k P(x | suffix)) / (N(s) + k).  All next words of a context are counted, so with a word that was
never seen as one more outcome every state's distribution sums to one.  Contexts need ``LEAST`` occurrences in training.

Nothing of the corpus is held in one place: texts are turned into packed chunks of word numbers once; words and then
contexts of one, two and more words with their next words are counted by exchanges of hashed keys between chunks and
buckets, and the answers return to the chunks that asked.  A context of k words is asked for only where it occurs
``LEAST`` times.  What follows a context goes to one bucket, which makes the test there.  Contexts with more than ``HOT``
occurrences, or a thousandth of all, are spread over all buckets, each sums its part of the gain, and the parts of those
at most a thousand contexts for each length are added up.

Words are told apart by 64-bit hashes, the next words of a context by 40 bits.  The test rounds probabilities to a sixth
of a factor of two; scores do not.

Defined cases: null and empty texts are the end token alone; null doc_id counts as the empty string in the split and
comes back as null; repeated rows are trained on and scored each for itself; without training documents N is 0 and
every word is unknown; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import chunks as C
from quillmesh.llm.work import Work

FOLDS, HELD_OUT = 7, 2
DEPTH, LEAST, HOT, SMOOTH = 3, 4, 500_000, 10.0
END = np.uint64(0x5851F42D4C957F2D)
_NEXT = np.uint64((1 << 40) - 1)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def is_held_out(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i == C.NULL_ID else str(i).encode()) % FOLDS == HELD_OUT for i in ids.tolist()], bool)


def pack_tokens(ids: np.ndarray, lengths: np.ndarray, body: bytes) -> bytes:
    """A chunk of documents as numbers of its distinct words, which are in the order of their hashes."""
    lengths = np.maximum(lengths, 0)
    found = C.Words(body.lower(), lengths)
    hashes = np.append(found.hashes(), END)
    words, place = np.unique(hashes, return_inverse=True)
    counts = np.bincount(found.doc, minlength=len(ids))
    token = np.insert(place[found.code], np.cumsum(counts), place[-1]).astype(np.uint32)
    return C.pack_arrays(ids.astype(np.int64), (counts + 1).astype(np.uint32), C.pack_sorted(words), token)


class _Tokens:
    """Tokens of a chunk as numbers of its distinct words."""

    def __init__(self, payload: bytes):
        self.ids, lengths, words, self.token = C.unpack_arrays(payload)
        self.lengths, self.words = lengths.astype(np.int64), C.unpack_sorted(words)
        self.held = is_held_out(self.ids)
        self.doc = np.repeat(np.arange(len(self.ids)), self.lengths)
        self.trained = ~self.held[self.doc]
        self.counts = np.bincount(self.token[self.trained], minlength=len(self.words)).astype(np.uint32)
        first = np.cumsum(self.lengths) - self.lengths
        self.before = np.arange(len(self.token)) - np.repeat(first, self.lengths)

    def __len__(self) -> int:
        return len(self.ids)


def _spread(data: np.ndarray, cut: np.ndarray, answers: dict[int, bytes], out: np.ndarray, part: int = 0) -> np.ndarray:
    for b, payload in answers.items():
        out[cut[b] : cut[b + 1]] = C.unpack_arrays(payload)[part]
    return out


# --- words ---


def _emit_words(buckets: int):
    def run(t: _Tokens, _) -> dict[int, bytes]:
        cut = C.bucket_bounds(t.words, buckets, 64)
        return {b: C.pack_arrays(C.pack_sorted(t.words[cut[b] : cut[b + 1]]), t.counts[cut[b] : cut[b + 1]]) for b in range(buckets) if cut[b] < cut[b + 1]}

    return run


def _parts(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1]) if sizes else []


def _count_words(rows: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    got = [(c, *C.unpack_arrays(p)) for c, p in rows]
    _, which = C.numbered(np.concatenate([C.unpack_sorted(d) for _, d, _ in got]))
    total = np.bincount(which, np.concatenate([n for _, _, n in got])).astype(np.int64)
    out = [(c, C.pack_arrays(v)) for (c, d, _), v in zip(got, _parts(total[which], [len(d) for _, d, _ in got]), strict=True)]
    return [*out, (-1, C.pack_arrays(np.array([total.sum(), (total > 0).sum()], np.int64)))]


# --- contexts ---


def _quantised(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-6 * np.log2(p)), 255).astype(np.uint8)


def _probability(q: np.ndarray) -> np.ndarray:
    return np.exp2(-q.astype(np.float64) / 6)


def _in_order(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of numbers below 2**32 as high << 32 | low, ascending, and each pair's number among them.

    Where a pair and its place fit a word together, one sort of words does it, which is faster than hashing or sorting places.
    """
    shift, bits = int(low.max(initial=0)).bit_length(), len(low).bit_length()
    if int(high.max(initial=0)).bit_length() + shift + bits > 64:
        return np.unique(high.astype(np.uint64) << np.uint64(32) | low, return_inverse=True)
    key = (high.astype(np.uint64) << np.uint64(shift) | low) << np.uint64(bits) | np.arange(len(low), dtype=np.uint64)
    key.sort()
    place, key = (key & np.uint64((1 << bits) - 1)).astype(np.int64), key >> np.uint64(bits)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    number = np.empty(len(key), np.int64)
    number[place] = np.cumsum(new) - 1
    key = key[new]
    return (key >> np.uint64(shift)) << np.uint64(32) | key & np.uint64((1 << shift) - 1), number


class _Grams:
    """Distinct contexts and (context, next word) of a chunk, in the order of the contexts' hashes, and what to send.

    ``at`` are the token positions after a possible context, ``which`` a number and ``context`` a hash of it for each of
    them, ``seen`` the context's training count, ``parent`` the probability of the next word in the context's suffix.
    """

    def __init__(self, t: _Tokens, at: np.ndarray, which: np.ndarray, context: np.ndarray, seen: np.ndarray, parent: np.ndarray, buckets: int, hot: int):
        self.tokens, self.at, self.prob = t, at, parent
        hashes = np.zeros(which.max(initial=-1) + 1, np.uint64)
        hashes[which] = context
        there = np.flatnonzero(np.bincount(which, minlength=len(hashes)))
        there = there[np.argsort(hashes[there], kind="stable")]
        n, place = len(there), np.empty(len(hashes), np.int64)
        self.contexts, place[there] = hashes[there], np.arange(n)
        self.of = place[which]
        self.grams, self.inverse = _in_order(self.of, t.token[at])
        self.ctx = (self.grams >> np.uint64(32)).astype(np.int64)
        self.pairs = np.bincount(self.ctx, minlength=n)
        self.seen = np.zeros(n, np.int64)
        self.seen[self.of] = seen
        often = self.seen > hot
        self.hot = np.flatnonzero(often[self.ctx])
        self.cold_contexts = np.flatnonzero(~often)
        self.cold = np.flatnonzero(~often[self.ctx])
        key = C.mix(self.contexts[self.ctx[self.hot]] ^ (self._next(self.hot) * _K[0])) >> np.uint64(8)
        order = np.argsort(key, kind="stable")
        self.hot, self.hot_keys = self.hot[order], key[order]
        self.cut_context = C.bucket_bounds(self.contexts[self.cold_contexts], buckets, 64)
        ends = np.append(0, np.cumsum(self.pairs[self.cold_contexts]))
        self.cut_cold = ends[self.cut_context]
        self.cut_hot = C.bucket_bounds(self.hot_keys, buckets, 56)

    def _next(self, some: np.ndarray) -> np.ndarray:
        """What tells the next words of some (context, next word) apart."""
        return (self.tokens.words[(self.grams[some] & np.uint64(0xFFFFFFFF)).astype(np.int64)] >> np.uint64(24)) & _NEXT

    def sent(self, buckets: int) -> dict[int, bytes]:
        n, out = len(self.grams), {}
        count = np.bincount(self.inverse[self.tokens.trained[self.at]], minlength=n).astype(np.uint32)
        parent = np.zeros(n, np.uint8)
        parent[self.inverse] = _quantised(self.prob)
        for b in range(buckets):
            cs = self.cold_contexts[self.cut_context[b] : self.cut_context[b + 1]]
            ps = self.cold[self.cut_cold[b] : self.cut_cold[b + 1]]
            hs = slice(self.cut_hot[b], self.cut_hot[b + 1])
            if len(cs) or hs.start < hs.stop:
                own, which = np.unique(self.ctx[self.hot[hs]], return_inverse=True)
                hot = (C.pack_sorted(self.hot_keys[hs]), count[self.hot[hs]], self.contexts[own], which.astype(np.uint16), self.seen[own], parent[self.hot[hs]])
                out[b] = C.pack_arrays(C.pack_sorted(self.contexts[cs]), self.seen[cs], self.pairs[cs], self._next(ps), parent[ps], count[ps], *hot)
        return out

    def answered(self, answers: dict[int, bytes], hot_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position in ``at``: count of (context, next word), and whether the context is a state."""
        total, state = np.zeros(len(self.ctx), np.int64), np.isin(self.contexts, hot_states)
        for b, payload in answers.items():
            pairs, states, hot = C.unpack_arrays(payload)
            total[self.cold[self.cut_cold[b] : self.cut_cold[b + 1]]] = pairs
            state[self.cold_contexts[self.cut_context[b] : self.cut_context[b + 1]]] = states
            total[self.hot[self.cut_hot[b] : self.cut_hot[b + 1]]] = hot
        return total[self.inverse], state[self.of]


def _test_contexts(rows: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """Sums of the counts of (context, next word), and which contexts are states."""
    got = [(c, *C.unpack_arrays(p)) for c, p in rows]
    every, where = C.numbered(np.concatenate([C.unpack_sorted(g[1]) for g in got]))
    seen = np.zeros(len(every), np.int64)
    seen[where] = np.concatenate([g[2] for g in got])
    key = np.repeat(where, np.concatenate([g[3] for g in got])).astype(np.uint64) << np.uint64(40) | np.concatenate([g[4] for g in got])
    unique, which, total, parent = _sums(key, [g[6] for g in got], [g[5] for g in got])
    state = _gain((unique >> np.uint64(40)).astype(np.int64), total, parent, seen) > 0
    hot_key = np.concatenate([C.unpack_sorted(g[7]) for g in got])
    hot_unique, hot_which, hot_total, hot_parent = _sums(hot_key, [g[8] for g in got], [g[12] for g in got])
    hot_contexts, own = C.numbered(np.concatenate([g[9] for g in got]))
    hot_seen, hot_of = np.zeros(len(hot_contexts), np.int64), np.zeros(len(hot_unique), np.int64)
    hot_seen[own] = np.concatenate([g[11] for g in got])
    base = np.cumsum([0, *(len(g[9]) for g in got)])
    hot_of[hot_which] = own[np.concatenate([g[10].astype(np.int64) + b for g, b in zip(got, base[:-1].tolist(), strict=True)])] if len(own) else 0
    hot_gain = _gain(hot_of, hot_total, hot_parent, hot_seen)
    sums = _parts(total[which], [len(g[4]) for g in got])
    states = _parts(state[where].astype(np.uint8), [len(g[1]) for g in got])
    hots = _parts(hot_total[hot_which], [len(g[7]) for g in got])
    out = [(g[0], C.pack_arrays(n, s, h)) for g, n, s, h in zip(got, sums, states, hots, strict=True)]
    return [*out, (-1, C.pack_arrays(hot_contexts, hot_gain))]


def _sums(keys: np.ndarray, counts: list[np.ndarray], parents: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct keys, each key's number among them, and their sums of counts and probabilities in the suffix."""
    unique, which = C.numbered(keys)
    total = np.bincount(which, np.concatenate(counts), len(unique)).astype(np.int64)
    parent = np.zeros(len(unique))
    parent[which] = _probability(np.concatenate(parents))
    return unique, which, total, parent


def _gain(context: np.ndarray, total: np.ndarray, parent: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Leave-one-out log-likelihood gain of each context over its suffix."""
    some = total > 0
    n = np.maximum(seen[context[some]], total[some])
    left = (total[some] - 1 + SMOOTH * parent[some]) / (n - 1 + SMOOTH)
    return np.bincount(context[some], total[some] * np.log(left / parent[some]), len(seen))


def hot_states(answers: DataFrame) -> np.ndarray:
    """Contexts with parts in all buckets whose gains add up to more than 0."""

    def parts(batches):
        for batch in batches:
            for payload in batch.column(0):
                contexts, gain = C.unpack_arrays(payload.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(contexts.view(np.int64), pa.int64()), pa.array(gain.astype(np.float64))], names=["context", "gain"])

    rows = answers.where("chunk_id = -1").select("payload").mapInArrow(parts, "context long, gain double")
    found = rows.groupBy("context").agg(F.sum("gain").alias("gain")).where("gain > 0").collect()
    return np.sort(np.array([r["context"] for r in found], np.int64).view(np.uint64))


class _Model:
    """What a chunk knows of the corpus after some rounds: the counts of its words, and for each length of contexts that
    is done (``states`` has those spread over all buckets) which of them are states and what follows them.

    ``prob`` is the probability of each token so far, ``grams`` what to ask for next.
    """

    def __init__(self, t: _Tokens, answers: dict, sizes: tuple[int, int], buckets: int, gram_buckets: int, states: list[np.ndarray], depth: int, hot: int):
        total, distinct = sizes
        self.seen = _spread(t.words, C.bucket_bounds(t.words, buckets, 64), answers.get("word", {}), np.zeros(len(t.words), np.int64))
        count = self.seen[t.token]
        self.root = (count + 1) / (total + distinct + 1)
        self.prob = self.root.copy()
        word = t.words[t.token]
        # The number of the context that ends with a token: a context and its next word make the context one longer.
        context, which = word, t.token.astype(np.int64)
        for k in range(1, depth + 1):
            at = np.flatnonzero(t.before >= k)
            at = at[count[at - 1] >= LEAST]
            seen = count[at - 1]
            grams = _Grams(t, at, which[at - 1], context[at - 1], seen, self.prob[at], gram_buckets, max(hot, total // 1000))
            if k > len(states):
                self.grams = grams
                return
            n, state = grams.answered(answers.get(f"gram-{k}", {}), states[k - 1])
            count = np.zeros(len(t.token), np.int64)
            count[at] = n
            on = at[state]
            self.prob[on] = (n[state] + SMOOTH * self.prob[on]) / (seen[state] + SMOOTH)
            if k < depth:
                longer = np.zeros(len(word), np.uint64)
                longer[k:] = C.mix(word[:-k] * _K[0] + C.mix(context[k:] * _K[1]))
                context, which = longer, np.zeros(len(word), np.int64)
                which[at] = grams.inverse


OUT_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, score_per_token double"


def score_documents(spark: SparkSession, docs: DataFrame, depth: int = DEPTH, hot: int = HOT) -> DataFrame:
    """``OUT_SCHEMA`` for every row of ``docs`` (doc_id, text)."""
    work = Work(spark, "lm")
    chunks = C.build_chunks(work, docs, write=pack_tokens)
    buckets, gram_buckets = C.buckets_for(chunks, 16 << 20), C.buckets_for(chunks, 8 << 20)
    words = work.save(C.reduce_buckets(C.send(chunks, _emit_words(buckets), read=_Tokens), "word", _count_words), "words", "uncompressed")
    stats = words.where("chunk_id = -1").select("payload").mapInArrow(_sizes, "n long, distinct long").agg(F.sum("n"), F.sum("distinct")).first()
    sizes = (stats[0] or 0, stats[1] or 0)
    known = words.where("chunk_id >= 0")
    states: list[np.ndarray] = []
    for k in range(1, depth + 1):

        def ask(t: _Tokens, answers: dict, done=tuple(states), k=k) -> dict[int, bytes]:
            return _Model(t, answers, sizes, buckets, gram_buckets, list(done), k, hot).grams.sent(gram_buckets)

        found = work.save(C.reduce_buckets(C.send(chunks, ask, known, _Tokens), f"gram-{k}", _test_contexts), f"gram-{k}", "uncompressed")
        states.append(hot_states(found))
        work.settle()
        known = known.union(found.where("chunk_id >= 0"))

    def rows(_: int, t: _Tokens, answers: dict) -> pa.Table:
        m, n = _Model(t, answers, sizes, buckets, gram_buckets, states, depth, hot), len(t)
        per_doc = lambda v: np.bincount(t.doc, v, n)
        score = per_doc(np.log10(m.prob))
        known_words = per_doc((m.seen[t.token] > 0).astype(np.float64)).astype(np.int64)
        return pa.table(
            {
                "doc_id": pa.array(t.ids, pa.int64(), mask=t.ids == C.NULL_ID),
                "held_out": pa.array(t.held),
                "n_tokens": pa.array(t.lengths, pa.int64()),
                "n_known": pa.array(known_words, pa.int64()),
                "train_tokens": pa.array(np.full(n, sizes[0]), pa.int64()),
                "base_score": pa.array(per_doc(np.log10(m.root)), pa.float64()),
                "score": pa.array(score, pa.float64()),
                "score_per_token": pa.array(score / np.maximum(t.lengths, 1), pa.float64()),
            }
        )

    out = work.save(C.per_chunk(chunks, rows, OUT_SCHEMA, known, _Tokens), "result")
    work.drop("chunks", "words", "gram-*")
    return out


def _sizes(batches):
    """Training tokens and distinct words that each bucket counted."""
    for batch in batches:
        got = [C.unpack_arrays(p.as_py())[0] for p in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([int(g[0]) for g in got], pa.int64()), pa.array([int(g[1]) for g in got], pa.int64())], names=["n", "distinct"])


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
