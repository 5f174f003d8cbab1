"""Secret scans with multipart credential linking.

The plain scan reports assignments of passwords, tokens and keys, access identifiers and long hexadecimal strings.  Weak
candidates (a user or client identifier, a mixed-alphabet string, an endpoint) mean little alone; an interval join finds,
within a scope of a few hundred characters, identifiers, secrets and endpoints together, and only candidates with a
complementary part nearby are added: an identifier with a secret, or a secret with an endpoint.

Scopes are intervals around candidates; candidates sorted by start are joined by a sweep that keeps open intervals only,
so a text costs time in proportion to its length and memory in proportion to its candidates.  Spans are code points,
end exclusive.

Defined cases: null and empty texts have no spans and the digest of the empty string; null doc_id stays null; repeated
rows are scanned each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.caches import tidy

KINDS = ("assign", "access", "hex")
LINKED = ("identifier", "secret", "endpoint")
ORDER = {k: i for i, k in enumerate((*KINDS, *LINKED))}
SCOPE = 200

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9_])(?:user(?:name|_?id)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?|key_?id|tenant(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.IGNORECASE | re.ASCII)
_ID_HINTS = ("user", "login", "client", "account", "access", "key", "tenant")
_MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{0,30}://[^\s\"'<>]{3,}|(?<![\w.-])(?:[a-z0-9-]++\.)+[a-z]{2,}:[0-9]{2,5}(?![0-9])")


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """Plain spans by kind."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    low = text.lower()
    if any(h in low for h in _HINTS):
        found["assign"] = [m.span() for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found["access"] = [m.span() for m in _ACCESS.finditer(text)]
    found["hex"] = [m.span() for m in _HEX.finditer(text)]
    return found


def _varied(s: str) -> bool:
    """Letters of both cases and digits, as random strings have and words and numbers have not."""
    return sum(bool(re.search(c, s)) for c in ("[A-Z]", "[a-z]", "[0-9]")) == 3 and len(set(s)) >= 10


def weak(text: str) -> list[tuple[int, int, str]]:
    low = text.lower()
    out: list[tuple[int, int, str]] = []
    if any(h in low for h in _ID_HINTS):
        out += [(*m.span(), "identifier") for m in _IDENTIFIER.finditer(text)]
    if "://" in text or ":" in text:
        out += [(*m.span(), "endpoint") for m in _ENDPOINT.finditer(text)]
    out += [(*m.span(), "secret") for m in _MIXED.finditer(text) if _varied(m[0])]
    return out


def link(candidates: list[tuple[int, int, str]], scope: int = SCOPE) -> set[tuple[int, int, str]]:
    """Weak candidates with a complementary part within ``scope`` characters; kinds of ``KINDS`` count as parts."""
    role = {"assign": "secret", "hex": "secret", "access": "identifier"}
    parts = sorted((s, e, role.get(k, k), k) for s, e, k in candidates)
    linked: set[tuple[int, int, str]] = set()
    open_: list[tuple[int, int, str, str]] = []
    for part in parts:
        open_ = [o for o in open_ if o[1] + scope >= part[0]]
        partners = {o[2] for o in open_}
        if part[2] == "secret" and partners & {"identifier", "endpoint"} or part[2] != "secret" and "secret" in partners:
            linked.add((part[0], part[1], part[3]))
            linked.update((o[0], o[1], o[3]) for o in open_ if (o[2] == "secret") != (part[2] == "secret"))
            # what is linked and has met both sides need not stay open: one latest part of each role decides
        keep: dict[str, tuple[int, int, str, str]] = {}
        rest = []
        for o in [*open_, part]:
            if (o[0], o[1], o[3]) in linked:
                if o[2] not in keep or keep[o[2]][1] < o[1]:
                    keep[o[2]] = o
            else:
                rest.append(o)
        open_ = rest + list(keep.values())
    return {x for x in linked if x[2] in LINKED}


def scan(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[int, int, str]]]:
    """Plain spans, and linked weak candidates that overlap none of them."""
    base = detect(text)
    plain = [(s, e, k) for k in KINDS for s, e in base[k]]
    candidates = weak(text)
    if not candidates:
        return base, []
    # the plain spans joined into intervals that do not overlap, so that one of them decides on a candidate
    starts: list[int] = []
    ends: list[int] = []
    for s, e, _ in sorted(plain):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)

    def is_free(candidate: tuple[int, int, str]) -> bool:
        i = bisect_right(ends, candidate[0])
        return i == len(ends) or starts[i] >= candidate[1]

    return base, sorted(link([c for c in candidates if is_free(c)] + plain))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        digests, every, extra, total = [], [], [], []
        for text in batch.column(1).to_pylist():
            base, added = scan(text or "")
            plain = sorted(((s, e, k) for k in KINDS for s, e in base[k]), key=lambda x: (x[0], ORDER[x[2]]))
            line = ",".join(f"{k}:{s}:{e}" for s, e, k in plain)
            digests.append(hashlib.sha256(line.encode()).hexdigest())
            every.append(",".join(f"{k}:{s}:{e}" for s, e, k in sorted(plain + added, key=lambda x: (x[0], ORDER[x[2]]))) if added else line)
            extra.append(len(added))
            total.append(len(plain) + len(added))
            for k in KINDS:
                counts[k].append(len(base[k]))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(every, pa.string()), pa.array(extra, pa.int64()), pa.array(total, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_linked", "n_spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """Plain spans by kind, their digest, all spans, and how many of them are linked (``n_linked``) and in all."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_rows), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long, n_spans long")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
