"""Plain one-process versions of the operators' fixed parts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def luhn(d):
    return sum((x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = {}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    line = ",".join(f"{k}:{s}:{e}" for k in out for s, e in out[k])
    return tuple(len(v) for v in out.values()), hashlib.sha256(line.encode()).hexdigest()


def secrets(text):
    text = text or ""
    key = "(" + "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    found = [(m.start(), 0, m.end()) for m in re.finditer(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    found.sort()
    names = ("assign", "access", "hex")
    line = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in found)
    return tuple(sum(k == i for _, k, _ in found) for i in range(3)), hashlib.sha256(line.encode()).hexdigest()


def shingle_set(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def jaccard(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverse = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            inverse[g].append(d)
    common = Counter()
    for ds in inverse.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def suffixes(rows, span=50):
    first = {}
    texts = {d: (t or "").encode() for d, t in rows}
    for d in sorted(texts):
        t = texts[d]
        for i in range(len(t) - span + 1):
            first.setdefault(t[i : i + span], d)
    out = {}
    for d, t in texts.items():
        mask = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if first[t[i : i + span]] < d:
                mask[i : i + span] = b"\1" * span
        runs = len(re.findall(b"\1+", bytes(mask)))
        kept = bytes(c for c, m in zip(t, mask, strict=True) if not m)
        out[d] = (len(t), sum(mask), runs, hashlib.sha256(kept).hexdigest())
    return out


def base_scores(rows):
    docs = {d: [*words(t), None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    counts = Counter(w for d, ws in docs.items() if not held[d] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    return {d: (held[d], len(ws), sum(counts[w] > 0 for w in ws), total, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws)) for d, ws in docs.items()}


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def suffix_tree(rows, depth=3, least=4, smooth=10.0):
    """log10 probability of each document under the suffix tree with contexts of up to ``depth`` words, and the model."""
    docs = {d: [*words(t), None] for d, t in rows}
    train = [ws for d, ws in docs.items() if zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for ws in train for w in ws)
    total, distinct = sum(c.values()), len(c)
    step = lambda p: 2.0 ** (-min(round(-6 * math.log2(p)), 255) / 6)
    follow, states = defaultdict(Counter), set()
    for ws in train:
        for i, x in enumerate(ws):
            for k in range(1, depth + 1):
                if i >= k:
                    follow[tuple(ws[i - k : i])][x] += 1

    def p(context, x):
        if not context:
            return (c[x] + 1) / (total + distinct + 1)
        shorter = p(context[1:], x)
        return (follow[context][x] + smooth * shorter) / (sum(follow[context].values()) + smooth) if context in states else shorter

    for k in range(1, depth + 1):
        for context in [s for s in follow if len(s) == k]:
            n = sum(follow[context].values())
            if n >= least:
                gain = 0.0
                for x, m in follow[context].items():
                    q = step(p(context[1:], x))
                    gain += m * math.log((m - 1 + smooth * q) / (n - 1 + smooth) / q)
                if gain > 0:
                    states.add(context)
    scores = {d: sum(math.log10(p(tuple(ws[max(0, i - depth) : i]), x)) for i, x in enumerate(ws)) for d, ws in docs.items()}
    return scores, p, states, c


EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’–—…¿¡€£"


def template(text):
    """(template token, word as it stands, is a placeholder) of each word that is no punctuation alone."""
    from quillmesh.llm.decontamination import UNITS

    out, opens = [], True
    for line in (text or "").split("\n"):
        begins = True
        for raw in WORD.findall(line):
            word = raw.strip(EDGE)
            if not word:
                begins = False
                continue
            low = word.lower()
            number = re.fullmatch(r"[+-]?\d+([.,:/]\d+)*(st|nd|rd|th)?", low)
            if number:
                kind = "NUM"
            elif re.fullmatch(r"[+-]?\d+([.,]\d+)*[a-zµ°%]{1,5}", low):
                kind = "QTY"
            elif low in UNITS and out and out[-1][3]:
                kind = "UNIT"
            elif word[0].isupper() and not (opens or begins):
                kind = "NAME"
            else:
                kind = None
            out.append((kind or low, low, kind is not None, bool(number)))
            opens = raw[-1] in ".!?:" or (raw[-1] in "\"'”)" and raw[-2:-1] in (".", "!", "?"))
            begins = False
    return [t[:3] for t in out]


def contaminating(text, items):
    """(item id, greatest share, re-parameterised) of each item that contaminates a text, by all pairs of windows."""
    doc, out = template(text), []
    for item_id, item_text in items:
        item = template(item_text)
        width = min(8, len(item))
        if not width:
            continue
        by = defaultdict(list)
        for q in range(len(item) - width + 1):
            plain = sum(not t[2] for t in item[q : q + width]) >= min(4, width)
            want = [t[not plain] for t in item[q : q + width]]
            for p in range(len(doc) - width + 1):
                if doc[p][not plain] == want[0] and [t[not plain] for t in doc[p : p + width]] == want:
                    by[p - q].append((p, q))
        if not by:
            continue

        def judged(found):
            values, covered, changed = defaultdict(set), set(), False
            slots = lambda q: [j for j in range(width) if item[q + j][2]]
            for p, q in found:
                for j in slots(q):
                    values[item[q + j][1]].add(doc[p + j][1])
            clash = {v for v, got in values.items() if len(got) > 1}

            def enough():
                best = run = 0
                for i in range(len(item)):
                    run = run + (not item[i][2]) if i in covered else 0
                    best = max(best, run)
                return 2 * len(covered) >= len(item) or best >= 30

            for p, q in found:
                if not any(item[q + j][1] in clash for j in slots(q)):
                    covered.update(range(q, q + width))
                    changed |= any(item[q + j][1] != doc[p + j][1] for j in slots(q))
            if clash and not enough():
                for p, q in found:
                    if all(item[q + j][1] == doc[p + j][1] for j in slots(q)):
                        covered.update(range(q, q + width))
            return len(covered) / len(item), changed, enough()

        slack, groups, near = min(8, (len(item) - 1) // 2), [by[d] for d in sorted(by)], []
        for d in [*sorted(by), None]:
            if near and (d is None or d - near[0] > slack):
                groups += [[x for n in near for x in by[n]]] if len(near) > 1 else []
                near = []
            near.append(d)
        good = [g for g in map(judged, groups) if g[2]] or [g for g in [judged([x for d in by for x in by[d]])] if g[2]]
        if good:
            out.append((item_id, max(g[0] for g in good), any(g[1] for g in good)))
    return sorted(out)
