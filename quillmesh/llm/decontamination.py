"""Benchmark decontamination with template canonicalisation.

Texts become templates: a number turns into a typed placeholder, as do a unit after a number and a capitalised word
inside a sentence; other words are lower-cased without outer punctuation.  Windows of eight template tokens of every
document are hash-joined with the windows of the benchmark items.  The windows found for one item are grouped into
occurrences, by where the item would begin in the text.  Windows of an occurrence must put the same value into equal
slots of the item (a re-parameterised question changes a number everywhere); a slot that two of them fill differently is
a coincidence and its windows do not count.  A document is contaminated by an item if the windows left of an occurrence,
or of all the text, cover at least half of the item's tokens, or a passage of it with ``PASSAGE`` words that are no
placeholders.  Windows of an item with under ``LITERALS`` such words are joined as they stand, numbers and names included.

The benchmark's windows are a table.  A bitmap of their hashes, of at most ``2 ** MOST_BITS`` bits whatever the benchmark
has, goes to the tasks that read the documents, so that only windows that may be in the benchmark leave the scan; a bit
set by chance costs a row and never a result, as the join decides.  Equal texts are one key of the join throughout.

Defined cases: null and empty texts are clean; an item with fewer than eight tokens is one window of its length; an item
without any word or number (punctuation alone) cannot be found; equal rows of the benchmark count once, and an item
without id is written as "null"; a null doc_id stays null; repeated rows are judged each for itself; an empty table gives
no rows; with an empty benchmark all is clean; other columns are ignored.  Words end at ASCII white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import chunks as C
from quillmesh.llm.caches import in_use, tidy
from quillmesh.llm.work import Work

WIDTH, LITERALS, SHARE = 8, 4, 0.5
SHIFT, PASSAGE = 8, 30
#: Bits of the bitmap for each window of the benchmark, and the greatest bitmap as a power of two (16 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 1024, 16, 27
#: Bytes of documents that are looked up at once, words remembered between, and texts whose broadcast is allowed.
BLOCK_BYTES, KEEP, BROADCAST_TEXTS = 4 << 20, 400_000, 1_000_000
NUMBER, UNIT, QUANTITY, NAME = (np.uint64(x) for x in (11, 12, 13, 14))
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’–—…¿¡€£"
_NUMBER = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th)?$")
_QUANTITY = re.compile(r"[+-]?\d+(?:[.,]\d+)*[a-zµ°%]{1,5}$")
# Units that follow a number.
UNITS = frozenset("mm cm m km kg g mg t l ml s ms min h hour hours minute minutes second seconds day days week weeks month months year years meter meters metre metres mile miles foot feet inch inches kilogram kilograms gram grams pound pounds ounce ounces liter liters litre litres degree degrees dollar dollars euro euros cent cents percent stunden minuten sekunden tage jahre kilometer heures minutes jours ans horas minutos días años".split())
_IS_NUM, _IS_SLOT, _IS_CAP, _IS_END, _IS_UNIT, _IS_WORD = 1, 2, 4, 8, 16, 32


def bare(raw: str) -> str:
    return raw.strip(_EDGE)


def entry_of(raw: str) -> tuple[int, int, int]:
    """Template hash, hash as it stands, and flags of a raw word; punctuation alone has no flags."""
    word = bare(raw)
    if not word:
        return 0, 0, 0
    low = word.lower()
    number = quantity = False
    if not low.isalpha():
        number = bool(_NUMBER.match(low))
        quantity = not number and bool(_QUANTITY.match(low))
    end = raw[-1] in ".!?:" or raw[-1] in "\"'”)" and raw[-2:-1] in (".", "!", "?")
    exact = xxhash.xxh3_64_intdigest(low)
    flags = _IS_WORD | number * _IS_NUM | (number or quantity) * _IS_SLOT | word[0].isupper() * _IS_CAP | end * _IS_END | (low in UNITS) * _IS_UNIT
    return int(NUMBER) if number else int(QUANTITY) if quantity else exact, exact, flags


class Lexicon:
    """Entries of raw words, remembered up to a bound."""

    def __init__(self):
        self.clear()

    def __len__(self) -> int:
        return len(self.known)

    def clear(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.hash, self.exact, self.flags = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint8)

    def entries(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Template hash, hash as it stands and flags of distinct words."""
        if len(self) > KEEP:
            self.clear()
        at = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            new = words.take(pa.array(fresh))
            got = [entry_of(w.decode()) for w in new.to_pylist()]
            at[fresh] = len(self.hash) + np.arange(len(fresh))
            self.known = pa.concat_arrays([self.known, new])
            self.hash = np.append(self.hash, np.array([g[0] for g in got], np.uint64))
            self.exact = np.append(self.exact, np.array([g[1] for g in got], np.uint64))
            self.flags = np.append(self.flags, np.array([g[2] for g in got], np.uint8))
        return self.hash[at], self.exact[at], self.flags[at]


_KNOWN = Lexicon()


class Templates:
    """Template tokens of concatenated texts, one after the other.

    For each token: ``hash`` (a placeholder or the word), ``exact`` (the word as it stands), ``slot``, ``doc``, and the
    raw word's place in ``body``.
    """

    def __init__(self, body: bytes, lengths: np.ndarray):
        self.body = body
        found = C.Words(body, lengths)
        first, last, doc, code = found.first, found.last, found.doc, found.code
        hashes, exact, flags = in_use(_KNOWN).entries(found.every)
        h, flag = hashes[code], flags[code]
        lines = np.cumsum(np.frombuffer(body, np.uint8) == 10)[first] if len(first) else first
        fresh = np.append(True, (lines[1:] != lines[:-1]) | (doc[1:] != doc[:-1]))[: len(first)]
        words = np.flatnonzero(flag)
        h, flag, doc, fresh = h[words], flag[words], doc[words], fresh[words]
        self.exact, self.doc, self.first, self.last = exact[code[words]], doc, first[words], last[words]
        if len(h):
            opens = np.append(True, doc[1:] != doc[:-1])
            fresh |= opens
            fresh[1:] |= (flag[:-1] & _IS_END) > 0
            unit = (flag & _IS_UNIT) > 0
            unit[1:] &= (flag[:-1] & _IS_NUM) > 0
            unit &= ~opens
            fixed = (flag & _IS_SLOT) > 0
            name = ((flag & _IS_CAP) > 0) & ~fresh & ~fixed & ~unit
            h[name], h[unit & ~fixed] = NAME, UNIT
            self.slot = name | unit | fixed
        else:
            self.slot = np.zeros(0, bool)
        self.hash = h
        self.literals = np.cumsum(np.append(0, ~self.slot))

    def word(self, i: int) -> str:
        return bare(self.body[self.first[i] : self.last[i]].decode()).lower()

    def inside(self, at: np.ndarray, width: int) -> np.ndarray:
        """Those of the windows beginning at ``at`` that end in their own text."""
        at = at[at + width <= len(self.doc)]
        return at[self.doc[at + width - 1] == self.doc[at]]

    def enough(self, at: np.ndarray, width: int) -> np.ndarray:
        """Whether the windows beginning at ``at`` have words enough to be joined as templates."""
        return self.literals[at + width] - self.literals[at] >= min(LITERALS, width)


def window_hashes(tokens: np.ndarray, at: np.ndarray, width: int, exact: bool) -> np.ndarray:
    """Hashes of the windows of ``width`` tokens that begin at ``at``."""
    acc = np.full(len(at), np.uint64(width | exact << 8))
    # windows that are all there is are read in place
    every = len(at) and len(at) == at[-1] - at[0] + 1
    for j in range(width):
        acc = (acc ^ (tokens[at[0] + j : at[-1] + j + 1] if every else tokens[at + j])) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return C.mix(acc)


# --- benchmark ---

WINDOWS = "h long, first long, width int, exact boolean, item long, text_key long, place int, slots array<int>, said array<string>"
ITEMS = "item long, text_key long, length int, slot binary"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of items (item, text_key, text); ``first`` is the hash of the first word of a window that is taken as it stands."""
    for batch in batches:
        rows: list[dict] = []
        for item, key, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            body = (text or "").encode()
            t = Templates(body, np.array([len(body)]))
            n = len(t.hash)
            width = min(WIDTH, n)
            if not n:
                continue
            at = np.arange(n - width + 1)
            plain = t.enough(at, width)
            h = np.where(plain, window_hashes(t.hash, at, width, False), window_hashes(t.exact, at, width, True)).view(np.int64)
            for q in at.tolist():
                slots = np.flatnonzero(t.slot[q : q + width]).tolist()
                rows.append({"h": int(h[q]), "first": None if plain[q] else int(t.exact[q].view(np.int64)), "width": width, "exact": not plain[q], "item": item, "text_key": key, "place": q, "slots": slots, "said": [t.word(q + j) for j in slots]})
        yield from pa.Table.from_pylist(rows, pa.schema([("h", pa.int64()), ("first", pa.int64()), ("width", pa.int32()), ("exact", pa.bool_()), ("item", pa.int64()), ("text_key", pa.int64()), ("place", pa.int32()), ("slots", pa.list_(pa.int32())), ("said", pa.list_(pa.string()))])).to_batches()


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks = []
        for text in batch.column(2).to_pylist():
            body = (text or "").encode()
            masks.append(Templates(body, np.array([len(body)])).slot.astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(m) for m in masks], pa.int32()), pa.array(masks, pa.binary())], names=["item", "text_key", "length", "slot"])


def bitmap_of(windows: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the leading bits of the windows' hashes and first words, and the number of those bits."""
    n = windows.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (n * BITS_EACH).bit_length()))
    every = windows.select(F.explode(F.array("h", "first")).alias("x")).where("x is not null").select(F.shiftrightunsigned("x", 64 - bits).alias("x"))
    # a block of 2 ** 15 bits is one row, so at most 2 ** (MOST_BITS - 15) rows of 4 kB come to the driver
    rows = every.groupBy(F.shiftright("x", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("x") % (1 << 15)).alias("bits")).collect()
    out = np.zeros((1 << bits) >> 3, np.uint8)
    for r in rows:
        out[r["block"] << 12 : (r["block"] + 1) << 12] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out, bits


def _in(bitmap: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    x = (h >> np.uint64(64 - bits)).astype(np.int64)
    return bitmap[x >> 3] >> (x & 7).astype(np.uint8) & 1 > 0


# --- documents ---

FOUND = "one long, two long, h long, width int, exact boolean, p int, filled array<string>"


def _scan(bitmap: np.ndarray, bits: int, kinds: list[tuple[int, bool]], block_bytes: int):
    """Windows of texts (one, two, text) that may be in the benchmark; ``filled`` are the words in their slots."""

    def block(one: np.ndarray, two: np.ndarray, body: bytes, lengths: np.ndarray) -> pa.RecordBatch | None:
        t = Templates(body, lengths)
        starts = np.searchsorted(t.doc, np.arange(len(lengths)))
        parts = []
        led = np.flatnonzero(_in(bitmap, bits, t.exact)) if any(e for _, e in kinds) else None
        for width, exact in kinds:
            at = t.inside(led if exact else np.arange(len(t.doc)), width)
            if exact:
                h = window_hashes(t.exact, at, width, True)
            elif len(at) > len(t.doc) // 2:
                h = window_hashes(t.hash, np.arange(len(t.doc) - width + 1), width, False)[at]
            else:
                h = window_hashes(t.hash, at, width, False)
            hit = np.flatnonzero(_in(bitmap, bits, h) & (exact or t.enough(at, width)))
            parts.append((at[hit], h[hit], width, exact))
        rows = [(p, h, w, e) for at, hs, w, e in parts for p, h in zip(at.tolist(), hs.view(np.int64).tolist(), strict=True)]
        if not rows:
            return None
        at = np.array([r[0] for r in rows])
        doc = t.doc[at]
        filled = [None if e else [t.word(p + j) for j in np.flatnonzero(t.slot[p : p + w]).tolist()] for p, _, w, e in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array(one[doc]), pa.array(two[doc]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.bool_()), pa.array(at - starts[doc], pa.int32()), pa.array(filled, pa.list_(pa.string()))],
            names=["one", "two", "h", "width", "exact", "p", "filled"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            lengths, body = C.texts_of(batch.column(2))
            ends = np.cumsum(lengths)
            lo = 0
            while lo < len(ends):
                base = int(ends[lo] - lengths[lo])
                hi = max(lo + 1, int(np.searchsorted(ends, base + block_bytes, "right")))
                found = block(one[lo:hi], two[lo:hi], body[base : int(ends[hi - 1])], lengths[lo:hi])
                if found is not None:
                    yield found
                lo = hi

    return tidy(run)


def _enough(covered: np.ndarray, slot: np.ndarray) -> bool:
    """Whether half of an item is covered, or a passage of it with ``PASSAGE`` words that are no placeholders."""
    if covered.mean() >= SHARE:
        return True
    words = np.cumsum(np.append(0, covered & ~slot))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
    return bool(np.any(words[edges[1::2]] - words[edges[::2]] >= PASSAGE))


def _occurrences(found: list[tuple], length: int) -> Iterator[list[tuple]]:
    """Windows (place in text, place in item, ...) of each occurrence of an item: of one alignment, then of near ones.

    An alignment is where the item would begin in the text; words put in or left out shift it by a few places.
    """
    by: dict[int, list[tuple]] = {}
    for hit in found:
        by.setdefault(hit[0] - hit[1], []).append(hit)
    starts = sorted(by)
    yield from (by[d] for d in starts)
    slack = min(SHIFT, (length - 1) // 2)
    near: list[int] = []
    for d in [*starts, None]:
        if near and (d is None or d - near[0] > slack):
            if len(near) > 1:
                yield [hit for n in near for hit in by[n]]
            near = []
        near.append(d)


def judge(found: list[tuple], slot: np.ndarray) -> tuple[float, bool, bool]:
    """Share of an item's tokens that consistent windows cover, whether a slot of them is filled otherwise, and whether
    they are enough.  A window is (place in text, place in item, width, the item's words in its slots, the text's)."""
    values: dict[str, set[str]] = {}
    for _, _, _, said, filled in found:
        for a, b in zip(said, filled, strict=True):
            values.setdefault(a, set()).add(b)
    clash = {v for v, got in values.items() if len(got) > 1}
    covered, changed = np.zeros(len(slot), bool), False
    for _, q, width, said, filled in found:
        if not clash.intersection(said):
            covered[q : q + width] = True
            changed |= said != filled
    if clash and not _enough(covered, slot):
        # the item as it stands is found whatever else in the text has its shape
        for _, q, width, said, filled in found:
            if said == filled:
                covered[q : q + width] = True
    return float(covered.mean()), changed, _enough(covered, slot)


def verdict(found: list[tuple], slot: np.ndarray) -> tuple[float, bool] | None:
    """Greatest share covered and whether re-parameterised, if the windows found in a text contaminate it."""
    good = [g for g in (judge(group, slot) for group in _occurrences(found, len(slot))) if g[2]]
    # pieces that lie far apart are judged together where no occurrence is enough alone
    good = good or [g for g in (judge(found, slot),) if g[2]]
    return (max(g[0] for g in good), any(g[1] for g in good)) if good else None


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for hits, slot in zip(batch.column("hits").to_pylist(), batch.column("slot").to_pylist(), strict=True):
            found = sorted((h["p"], h["place"], h["width"], h["said"], h["said"] if h["filled"] is None else h["filled"]) for h in hits)
            out.append(verdict(found, np.frombuffer(slot, np.uint8).astype(bool)))
        keep = pa.array([g is not None for g in out])
        kept = batch.select(["one", "two", "item"]).filter(keep)
        good = [g for g in out if g is not None]
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([g[0] for g in good], pa.float64()), pa.array([g[1] for g in good], pa.bool_())], names=["one", "two", "item", "share", "changed"])


REPORT = "doc_id long, n_items long, items string, greatest_share double, n_changed long, contaminated boolean"


def _keys(text: str = "text") -> list:
    """Two hashes that tell texts apart."""
    t = F.col(text).cast("string")
    return [F.xxhash64(t).alias("one"), F.xxhash64(t, F.lit(1)).alias("two")]


def contaminated_texts(work: Work, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(one, two, items) for every contaminated text of ``docs``: its hashes, and the items (id, share, changed)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    asked = benchmark.select(F.col("item_id").cast("long").alias("item"), F.xxhash64(text).alias("text_key"), text.alias("text")).dropDuplicates(["item", "text_key"])
    windows = work.save(asked.mapInArrow(tidy(_windows), WINDOWS), "windows")
    bitmap, bits = bitmap_of(windows)
    kinds = [tuple(r) for r in windows.select("width", "exact").distinct().orderBy("width", "exact").collect()]
    texts = docs.select(*_keys(), F.col("text").cast("string").alias("text")).where("text <> ''")
    found = texts.mapInArrow(_scan(bitmap, bits, kinds, BLOCK_BYTES), FOUND).distinct()
    hits = found.join(windows.drop("first"), ["h", "width", "exact"])
    one = F.struct("p", "place", "width", "said", "filled")
    groups = hits.groupBy("one", "two", "item", "text_key").agg(F.collect_list(one).alias("hits"))
    items = work.save(asked.mapInArrow(tidy(_items), ITEMS), "items")
    same = F.col("item").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key"))
    judged = groups.join(items.select(F.col("item").alias("of"), F.col("text_key").alias("of_key"), "slot"), same).select("one", "two", "item", "hits", "slot")
    judged = judged.mapInArrow(_verdicts, "one long, two long, item long, share double, changed boolean")
    out = judged.groupBy("one", "two").agg(F.sort_array(F.collect_list(F.struct("item", "share", "changed"))).alias("items"))
    out = work.save(out, "found")
    work.drop("windows", "items")
    return out


def find_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``REPORT`` for every row of ``docs`` (doc_id, text)."""
    found = contaminated_texts(Work(docs.sparkSession, "benchmark"), docs, benchmark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keys()).join(found, ["one", "two"], "left")
    ids = F.transform("items", lambda x: F.coalesce(x["item"].cast("string"), F.lit("null")))
    return rows.select(
        "doc_id",
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce(F.array_join(ids, ","), F.lit("")).alias("items"),
        F.coalesce(F.array_max(F.transform("items", lambda x: x["share"])), F.lit(0.0)).alias("greatest_share"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size(F.filter("items", lambda x: x["changed"]))).cast("long").alias("n_changed"),
        F.col("items").isNotNull().alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    found = contaminated_texts(Work(docs.sparkSession, "benchmark"), docs, benchmark).select("one", "two")
    found = F.broadcast(found) if found.count() <= BROADCAST_TEXTS else found
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_keys())
    return rows.join(found, ["one", "two"], "left_anti").select("row.*")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
