"""Personal data with offset-preserving deobfuscation.

The plain scan finds e-mail addresses, IP addresses, card and phone numbers as written.  For disguised ones a transducer
rewrites the text (homoglyphs and full-width forms to ASCII, zero-width characters away, spelled digits to digits, "at"
and "dot" disguises to their signs) while it keeps, for every character it writes, the source characters it stands for.
The same detectors run on what it wrote, and each hit that was touched by a rewrite is mapped back to source characters
and added, unless it overlaps a plain span of its kind that it does not wholly hold: a plain scan that finds a fragment
of a disguised address keeps its span, and the whole address is added.

Disguised dots are undone where they join labels to an "@" (bare words only up to a label that hosts end with, and before
the "@" only if the rest is disguised too; ten labels at most), and between the four numbers of an IP address.

A text that no rewrite rule touches is its own normal form, so only touched texts take the second scan.  Every scan is
linear in the text.  Spans are code points, end exclusive.

Defined cases: null and empty texts have no spans and the digest of the empty string; null doc_id stays null; repeated
rows are scanned each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.caches import tidy

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += _DOUBLED[int(c)] if i % 2 else int(c)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, last = [], 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            last = m.end()
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """Plain spans by kind."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found["phone"].append(m.span())
    return found


# Letters of other scripts that look like ASCII letters.
HOMOGLYPHS = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "․": ".", "。": ".", "﹒": ".", "﹫": "@", "﹢": "+",
}
# Spelled digits in the languages of the corpus.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_ZERO_WIDTH = "­​‌‍⁠﻿"
_ODD = re.compile(f"[{''.join(HOMOGLYPHS)}{_ZERO_WIDTH}！-～٠-٩۰-۹०-९①-⑨\U0001d7ce-\U0001d7ff]")
_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_RUN = re.compile(rf"(?<!\w)(?:plus[\s-]+)?(?:(?:{_WORD}|[0-9]+)[\s,.-]{{1,3}}){{3,}}(?:{_WORD}|[0-9]+)(?!\w)", re.IGNORECASE)


def _by_first_letter(words: list[str]) -> str:
    groups: dict[str, list[str]] = {}
    for w in words:
        groups.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in groups.items())


# Letters that match s, i and k where case is ignored.
_FOLD = str.maketrans("ſıİK", "siik")


def _lower(text: str) -> str:
    return (text if text.isascii() else text.translate(_FOLD)).lower()


# A run has three spelled digits at least, so one of them stands before another item: the hint misses no run.
_QUICK = _by_first_letter(sorted(SPELLED, key=len, reverse=True))
_RUN_HINT = re.compile(rf"(?<!\w)(?=[{''.join(sorted({w[0] for w in SPELLED}))}])(?:{_QUICK})[\s,.-]+(?:{_QUICK}|[0-9]+)(?!\w)")
# Last labels of host names that a bare "at ... dot ..." may end with: all country codes, and generic ones.
_COUNTRIES = "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vu wf ws ye yt za zm zw".split()
_GENERIC = "com org net edu gov mil int arpa info biz io dev app name pro aero coop museum jobs mobi tel travel cat asia post xxx xyz top site online shop store tech cloud club blog email mail live news world space website digital agency company group team work works studio design media network systems solutions services software zone center global today life page wiki link click art music film photo photos video games game finance bank law legal health care school academy university science social chat one icu vip fun win bid best eco green earth city berlin hamburg koeln wien bayern paris bzh london nyc amsterdam madrid barcelona gal eus swiss".split()
# Country codes that are common words after "point".
_ALSO_WORDS = frozenset("am as be by do in is la my no so to".split())
_LAST = "|".join(dict.fromkeys(_GENERIC + _COUNTRIES))
_LAST_POINT = "|".join(c for c in dict.fromkeys(["com", "org", "net", "edu", "gov", "info", "biz", "io", "dev", "app", *_COUNTRIES]) if c not in _ALSO_WORDS)
# Blanks are taken whole and only from where their run begins, and a host has at most ten labels of 63 characters, so that
# no pattern looks at a character more than a fixed number of times.
_BARE = r"(?:dot|punkt|point|punto)"
_AT = re.compile(rf"(?<!\s)\s*+[\[({{<]\s*+at\s*+[\])}}>]\s*+|(?<!\s)\s++at\s++(?=[a-z0-9-]{{1,63}}(?:\s++{_BARE}\s++[a-z0-9-]{{1,63}}){{0,8}}?\s++(?:(?:dot|punkt|punto)\s++(?:{_LAST})|point\s++(?:{_LAST_POINT}))(?![a-z0-9-]))", re.IGNORECASE)
_DOT = re.compile(r"(?<!\s)\s*+[\[({<]\s*+(?:dot|punkt|point|punto|\.)\s*+[\])}>]\s*+|(?<!\s)\s++(?:dot|punkt|point|punto)\s++", re.IGNORECASE)
_BETWEEN = r"(?:\s{0,3}[\[({<]\s{0,3}(?:dot|punkt|point|punto|\.)\s{0,3}[\])}>]\s{0,3}|\s{1,3}(?:dot|punkt|point|punto)\s{1,3}|\.)"
_IP_RUN = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_BETWEEN}[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
_BRACKET_DOT = re.compile(r"[\[({<]\s*+\.\s*+[\])}>]")
_LABEL = re.compile(r"[A-Za-z0-9-]{1,63}")
_LAST_LABELS, _LAST_AFTER_POINT = frozenset(_LAST.split("|")), frozenset(_LAST_POINT.split("|"))
#: Labels that disguised dots join to an "@" on each side.
LABELS = 10
_HINTS = ("dot", "punkt", "point", "punto")
_BRACKET_AT = re.compile(r"[\[({<]\s*at\s*[\])}>]")
_SPACED = re.compile(r"(?<=[A-Za-z0-9])\s++@\s*+(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@\s++(?=[A-Za-z0-9-]{1,63}\.[A-Za-z0-9])")


class Rewritten:
    """A text and, for each of its characters, the source characters [starts[i], ends[i]) and whether a rule wrote it."""

    __slots__ = ("text", "starts", "ends", "new")

    def __init__(self, text: str, starts: list[int], ends: list[int], new: list[bool]):
        self.text, self.starts, self.ends, self.new = text, starts, ends, new

    @classmethod
    def of(cls, text: str) -> Rewritten:
        n = len(text)
        return cls(text, list(range(n)), list(range(1, n + 1)), [False] * n)

    def sub(self, pattern: re.Pattern, write) -> Rewritten:
        """Replace matches; what ``write(match)`` returns (None: keep) stands for the whole match."""
        parts, starts, ends, new, last = [], [], [], [], 0
        for m in pattern.finditer(self.text):
            put = write(m)
            if put is None or m.end() == m.start():
                continue
            a, b = m.span()
            parts += [self.text[last:a], put]
            starts += self.starts[last:a] + [self.starts[a]] * len(put)
            ends += self.ends[last:a] + [self.ends[b - 1]] * len(put)
            new += self.new[last:a] + [True] * len(put)
            last = b
        if not parts:
            return self
        parts.append(self.text[last:])
        return Rewritten("".join(parts), starts + self.starts[last:], ends + self.ends[last:], new + self.new[last:])


def _plain_char(m: re.Match) -> str:
    c = m[0]
    if c in _ZERO_WIDTH:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    digit = unicodedata.digit(c, None)
    return str(digit) if digit is not None else unicodedata.normalize("NFKC", c)


_STEP = re.compile(rf"(?P<plus>plus)[\s-]+|(?P<word>{_WORD})|(?P<num>[0-9]+)|[\s,.-]+", re.IGNORECASE)


def _spelled(m: re.Match) -> str | None:
    put, words = [], 0
    for s in _STEP.finditer(m[0]):
        if s["plus"]:
            put.append("+")
        elif s["word"]:
            put.append(SPELLED[_lower(s["word"])])
            words += 1
        elif s["num"]:
            put.append(s["num"])
    return "".join(put) if words >= 3 else None


def touched(text: str) -> bool:
    low = _lower(text)
    return bool(_ODD.search(text)) or any(h in low for h in _HINTS) or bool(_BRACKET_AT.search(low)) or bool(_BRACKET_DOT.search(low)) or ("@" in text and bool(_SPACED.search(text))) or bool(_RUN_HINT.search(low))


def _joining_dots(form: Rewritten) -> set[int]:
    """Starts of the disguised dots that belong to an address."""
    text, found = form.text, set()
    before = {m.end(): m for m in _DOT.finditer(text)}
    at = text.find("@")
    while at >= 0:
        own, waiting, pos = [], [], at + 1
        for _ in range(LABELS):
            label = _LABEL.match(text, pos)
            if not label:
                break
            if waiting and _lower(label[0]) in (_LAST_AFTER_POINT if "point" in _lower(waiting[-1][0]) else _LAST_LABELS):
                own += waiting
                waiting = []
            pos = label.end()
            dot = _DOT.match(text, pos)
            if dot:
                pos = dot.end()
                if dot[0].strip()[0].isalpha():
                    waiting.append(dot)
                else:
                    own, waiting = own + waiting + [dot], []
            elif text.startswith(".", pos):
                pos += 1
            else:
                break
        if own or form.new[at]:
            pos = at
            for _ in range(LABELS):
                start = pos
                while pos and text[pos - 1] in _LOCAL and start - pos < 64:
                    pos -= 1
                dot = before.get(pos)
                if pos == start or not dot or not dot.start() or text[dot.start() - 1] not in _LOCAL:
                    break
                own.append(dot)
                pos = dot.start()
        found |= {m.start() for m in own}
        at = text.find("@", at + 1)
    return found


def _dotted(m: re.Match) -> str | None:
    parts = re.findall("[0-9]+", m[0])
    return ".".join(parts) if len(m[0]) > sum(map(len, parts)) + 3 and all(map(_small, parts)) else None


def rewrite(text: str) -> Rewritten:
    out = Rewritten.of(text).sub(_ODD, _plain_char).sub(_RUN, _spelled).sub(_IP_RUN, _dotted)
    out = out.sub(_AT, lambda m: "@").sub(_SPACED, lambda m: "@")
    if "@" in out.text:
        dots = _joining_dots(out)
        out = out.sub(_DOT, lambda m: "." if m.start() in dots else None)
    return out


def scan(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Plain spans, and spans of disguised data that hold all of each plain span of their kind that they overlap."""
    base = detect(text)
    added: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if touched(text):
        form = rewrite(text)
        if any(form.new) or len(form.text) != len(text):
            for kind, spans in detect(form.text).items():
                plain, k = base[kind], 0
                for a, b in spans:
                    s, e = form.starts[a], form.ends[b - 1]
                    while k < len(plain) and plain[k][1] <= s:
                        k += 1
                    hit = k
                    while hit < len(plain) and plain[hit][0] < e:
                        hit += 1
                    wrote = any(form.new[a:b]) or e - s != b - a
                    if wrote and (s, e) not in plain[k:hit] and all(s <= p and q <= e for p, q in plain[k:hit]):
                        added[kind].append((s, e))
    return base, added


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        digests, every, extra, total = [], [], [], []
        for text in batch.column(1).to_pylist():
            base, added = scan(text or "")
            line = ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in base[k])
            digests.append(hashlib.sha256(line.encode()).hexdigest())
            more = sum(map(len, added.values()))
            every.append(",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(base[k] + added[k])) if more else line)
            extra.append(more)
            total.append(more + sum(map(len, base.values())))
            for k in KINDS:
                counts[k].append(len(base[k]))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(every, pa.string()), pa.array(extra, pa.int64()), pa.array(total, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised", "n_spans"])


def find_pii(docs: DataFrame) -> DataFrame:
    """Plain spans by kind, their digest, all spans, and how many of them are disguised (``n_disguised``) and in all."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_rows), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long, n_spans long")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
