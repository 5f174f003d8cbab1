"""Main text of web pages by union-free wrappers inferred per host.

A page is read into a tree of elements.  For each host a wrapper, a union-free regular expression over such trees, is
inferred from a few of its pages: runs of siblings of one shape become a repeated group, then pages are aligned with the
wrapper one after the other; children that a page or the wrapper lacks become optional, texts that differ become slots,
texts that agree stay constants, and so do whole elements that are the same on every page.  On the wrapper it is decided
once per host which part is the article (an article or main element, else the part whose slots hold most text).  A page
is then matched against its host's wrapper and read from that part on.

What is left out: elements whose name (nav, footer, form, ...) or a whole class, id or role (``ad``, ``post-comments``,
but not ``side-effects``) tells that they are no part of an article; a header inside the article stays if it has a
heading and is not the same on all pages.  Where no article or main element tells the article's borders, the wrapper
does: elements that are the same on all pages go if they stand before the first or after the last element that differs;
never headings, nor anything between elements that differ, and nothing where the pages are versions of one text (they
share half of the text of their paragraphs).  Inside an article or main element nothing that is shared goes.

At most ``PAGES`` pages of a host, chosen by hash, make its wrapper (a documented bound); every page is extracted whole.
Wrappers are joined to pages by host.

Defined cases: null and empty html give an empty text; a null url is the host ""; a host with one page has a wrapper
of that page; unclosed and misnested elements are closed as browsers do, and elements more than ``DEPTH`` levels deep are
read one after the other; null page_id stays null; repeated rows are
extracted each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.caches import tidy
from quillmesh.llm.work import Work

#: Pages of a host that make its wrapper, levels of elements told apart, and cells of a table that aligns two sequences.
PAGES, DEPTH, CELLS = 8, 150, 250_000
# A tag ends at ">" or, unclosed, is text up to the next "<", so that no character is looked at twice.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp svg math select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCK_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
DROPPED = frozenset("nav header footer aside form script style noscript template button input select textarea iframe svg math dialog menu head title object embed canvas audio video".split())
# Words of class names that tell what is no part of an article, and words that may stand beside them.
_TELLING = re.compile(r"ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|signup|nav\w*|menu|breadcrumbs?|sidebar|side|aside|footer|foot|header|head|masthead|related|recommend\w*|share|sharing|social|comments?|replies|reply|disqus|login|search|widgets?|toolbar|pagination|pager|skip|toc|tags?")
NEUTRAL = frozenset("area article bar block bottom box button buttons column container content entry form global group icons inner item items left line links list main media news outer page panel post posts primary right row secondary section site slot story text top unit wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Parts of an article that are named like parts of a page.
_OWN_WORDS = re.compile(r"(?<![a-z])(?:article|post|entry|story|content)[_-](?:header|head|title|headline|body|text)(?![a-z])", re.IGNORECASE)
_MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article|post|story|entry|content|main|body|text)(?:$|[\s_-])", re.IGNORECASE)


class Node:
    __slots__ = ("name", "words", "children", "hidden")

    def __init__(self, name: str, words: str = "", hidden: bool = False):
        self.name, self.words, self.hidden = name, words, hidden
        self.children: list[Node | str] = []

    @property
    def label(self) -> str:
        return f"{self.name} {self.words}".strip()


def _attributes(text: str) -> tuple[str, bool]:
    if not text or "=" not in text and "hidden" not in text:
        return "", False
    words, hidden = [], False
    for m in _ATTRIBUTE.finditer(text):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id", "role"):
            words.append(re.sub(r"\d+", "", value))
        elif name == "hidden" and (m.start() == 0 or text[m.start() - 1].isspace()) or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    return " ".join(words), hidden


def parse(page: str) -> Node:
    """The page's elements; markup errors are closed as browsers do."""
    root = Node("html")
    stack, at, n = [root], 0, len(page)

    def close(names, stop=()):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                del stack[k:]
                return
            if stack[k].name in stop or (not stop and stack[k].name not in INLINE and stack[k].name != "p"):
                return

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            continue
        if name in ("html", "body", "!doctype"):
            continue
        if name in BLOCK_CLOSES_P:
            close({"p"}, ("article", "main", "section", "div", "td", "th", "li", "blockquote", "table", "ul", "ol", "form", "aside", "nav", "header", "footer"))
        if name in CLOSES:
            close(CLOSES[name], ("ul", "ol", "dl", "table", "select", "article", "section", "div"))
        words, hidden = _attributes(m[3])
        node = Node(name, words, hidden)
        stack[-1].children.append(node)
        if name in VOID or m[3].endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            node.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        # deeper elements are read as children of the last level, one after the other
        if len(stack) < DEPTH:
            stack.append(node)
    return root


def telling(words: str) -> bool:
    """Whether one of these class names is made of telling words, with neutral ones at most."""
    for name in words.lower().split():
        found = [bool(_TELLING.fullmatch(w)) or (None if w in NEUTRAL else False) for w in re.split(r"[_-]+", name) if w]
        if True in found and False not in found:
            return True
    return False


def dropped(name: str, words: str, hidden: bool = False) -> bool:
    return name in DROPPED or hidden or bool(words and name not in ("article", "main") and telling(_OWN_WORDS.sub("", words)))


def prints(node: Node, known: dict[int, str] | None = None) -> str:
    """What an element holds, as a hash."""
    known = {} if known is None else known
    if id(node) not in known:
        parts = ["".join(entities.unescape(c).split()) if isinstance(c, str) else prints(c, known) for c in node.children if isinstance(c, str) or c.name not in RAW]
        known[id(node)] = xxhash.xxh3_128_hexdigest("\0".join([node.label, *filter(None, parts)]))
    return known[id(node)]


# --- wrappers: [label, quantifier, children, hash if the same everywhere]; a text is ["#", quantifier, constant or None for a slot, characters] ---


def _shape(node: Node, known: dict[int, str] | None = None) -> list:
    known = {} if known is None else known
    kids: list = []
    for c in node.children:
        if isinstance(c, str):
            text = " ".join(c.split())
            if text:
                _append(kids, ["#", "1", text, len(text)])
        elif c.name not in INLINE:
            _append(kids, _shape(c, known))
        elif any(isinstance(x, Node) or x.strip() for x in c.children):
            _append(kids, _shape(c, known))
    return [node.label, "1", kids, prints(node, known)]


def _append(kids: list, item: list) -> None:
    """Add a child; a sibling with the label of the one before makes both a repeated group."""
    if kids and kids[-1][0] == item[0]:
        kids[-1] = merge(kids[-1], item)
        kids[-1][1] = "+" if kids[-1][1] in "1+" else "*"
    else:
        kids.append(item)


def _quantifier(a: str, b: str) -> str:
    many, may = "+" in a + b or "*" in a + b, "?" in a + b or "*" in a + b
    return ("*" if may else "+") if many else ("?" if may else "1")


def merge(a: list, b: list) -> list:
    """The least union-free expression of this form that covers both (of one label)."""
    if a[0] == "#":
        return ["#", _quantifier(a[1], b[1]), a[2] if a[2] == b[2] else None, max(a[3], b[3])]
    return [a[0], _quantifier(a[1], b[1]), align(a[2], b[2]), a[3] if a[3] == b[3] else None]


def align(x: list, y: list) -> list:
    """Align two child sequences by their longest common sequence of labels; the rest becomes optional.

    Labels that agree at both ends are aligned first; of what lies between, sequences too long for the table are aligned
    label by label, each with its next place in the other sequence.
    """
    n, m = len(x), len(y)
    head = 0
    while head < min(n, m) and x[head][0] == y[head][0]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and x[n - 1 - tail][0] == y[m - 1 - tail][0]:
        tail += 1
    if head or tail:
        ends = [merge(a, b) for a, b in zip(x[n - tail :], y[m - tail :], strict=True)]
        return [merge(a, b) for a, b in zip(x[:head], y[:head], strict=True)] + align(x[head : n - tail], y[head : m - tail]) + ends
    if n * m > CELLS:
        return _align_next(x, y)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i][0] == y[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i][0] == y[j][0]:
            out.append(merge(x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([x[i][0], _quantifier(x[i][1], "?"), *x[i][2:]])
            i += 1
        else:
            out.append([y[j][0], _quantifier(y[j][1], "?"), *y[j][2:]])
            j += 1
    return out


def _align_next(x: list, y: list) -> list:
    places: dict[str, list[int]] = {}
    for j, item in enumerate(y):
        places.setdefault(item[0], []).append(j)
    out, j = [], 0
    for item in x:
        own = places.get(item[0], [])
        at = bisect_left(own, j)
        # a place far ahead would leave too much of the other sequence alone
        if at < len(own) and own[at] - j <= 64:
            out += [[b[0], _quantifier(b[1], "?"), *b[2:]] for b in y[j : own[at]]]
            out.append(merge(item, y[own[at]]))
            j = own[at] + 1
        else:
            out.append([item[0], _quantifier(item[1], "?"), *item[2:]])
    return out + [[b[0], _quantifier(b[1], "?"), *b[2:]] for b in y[j:]]


def infer(pages: list[str]) -> list:
    """The wrapper of a host's pages."""
    wrapper = None
    for page in pages:
        shape = _shape(parse(page))
        wrapper = shape if wrapper is None else merge(wrapper, shape)
    return wrapper or ["html", "1", [], None]


def _split(label: str) -> tuple[str, str]:
    name, _, words = label.partition(" ")
    return name, words


def _slots(w: list, constants: bool = False) -> int:
    """Characters that the slots (or all texts) outside dropped parts hold."""
    if w[0] == "#":
        return w[3] if constants or w[2] is None else 0
    return 0 if dropped(*_split(w[0])) else sum(_slots(c, constants) for c in w[2])


def article_path(wrapper: list, many: bool = True) -> list[str]:
    """Labels from the root to the part of the wrapper that holds the article; one page alone (not ``many``) has no slots."""
    every = not many or not _slots(wrapper)
    found: list[tuple[int, int, list[str]]] = []

    def walk(w: list, path: list[str]) -> None:
        if w[0] == "#" or dropped(*_split(w[0])):
            return
        name, words = _split(w[0])
        rank = 3 if name == "article" else 2 if name == "main" or re.search(r"(?:^|\s)main(?:$|\s)", words) else 1 if words and _MAIN_WORDS.search(words) and name not in INLINE else 0
        if rank:
            found.append((rank, _slots(w, every), path))
        for c in w[2]:
            walk(c, [*path, c[0]])

    walk(wrapper, [])
    total = _slots(wrapper, every)
    good = [f for f in found if f[0] == 3] or [f for f in found if f[0] == 2] or [f for f in found if 2 * f[1] >= total]
    return max(good, key=lambda f: (f[1], -len(f[2])))[2] if good else []


def _paragraphs(node: Node, found: set[str]) -> set[str]:
    for c in node.children:
        if isinstance(c, Node):
            if c.name in ("p", "blockquote", "pre", "td", "dd"):
                found.add("".join(_texts(c)))
            _paragraphs(c, found)
    return found


def _texts(node: Node) -> Iterator[str]:
    for c in node.children:
        if isinstance(c, str):
            yield "".join(c.split())
        elif c.name not in RAW:
            yield from _texts(c)


def versions(pages: list[str]) -> bool:
    """Whether the pages are versions of one text: all share half of the text of a page's paragraphs."""
    each = [_paragraphs(parse(page), set()) for page in pages]
    shared = sum(map(len, set.intersection(*each))) if each else 0
    return len(each) > 1 and shared > 0 and 2 * shared >= min(sum(map(len, e)) for e in each)


def extract(page: str, wrapper: list, path: list[str], many: bool = True) -> str:
    """Main text of a page by its host's wrapper, which ``many`` pages of different texts made."""
    root = parse(page)
    start = [root]
    for label in path:
        start = [c for node in start for c in node.children if isinstance(c, Node) and c.label == label]
        at = next((w for w in wrapper[2] if w[0] == label), None)
        wrapper = at or [label, "1", [], None]
    if not start or not any(_has_text(s) for s in start):
        shape = _shape(root)
        path, many = article_path(shape, False), False
        start, wrapper = [root], shape
        for label in path:
            start = [c for node in start for c in node.children if isinstance(c, Node) and c.label == label]
            wrapper = next(w for w in wrapper[2] if w[0] == label)
    blocks: list[str] = []
    run: list[str] = []
    known: dict[int, str] = {}

    def flush() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if text:
            blocks.append(text)

    def same(c: Node, parts: dict[str, list]) -> bool:
        """Whether a block is the same on all pages of the wrapper."""
        return many and c.name not in INLINE and any(w[3] and w[3] == prints(c, known) for w in parts.get(c.label, ()))

    def out(c: Node, parts: dict[str, list]) -> bool:
        if path and not c.hidden and (c.name == "header" or c.name == "div" and "head" in c.words) and _has_heading(c) and not same(c, parts):
            return False
        return c.name in RAW or dropped(c.name, c.words, c.hidden)

    def read(node: Node, ws: list[list], lead: bool, trail: bool) -> None:
        """``ws`` are the parts of the wrapper that ``node`` may stand for and that every page has; ``lead`` and ``trail``:
        nothing that differs comes before, or after."""
        below: dict[str, list] = {}
        for x in (x for w in ws for x in w[2] if x[0] != "#" and x[1] in "1+"):
            below.setdefault(x[0], []).append(x)
        kids = [c for c in node.children if isinstance(c, str) or not out(c, below)]
        if lead or trail:
            full = [k for k, c in enumerate(kids) if (c.strip() if isinstance(c, str) else _has_text(c))]
            cut = [k for k in full if isinstance(kids[k], Node) and kids[k].name not in HEADINGS and same(kids[k], below)]
            rest = sorted(set(full) - set(cut))
            first, last = (rest[0], rest[-1]) if rest else (-1, len(kids))
            gone = {k for k in cut if lead and k < first or trail and k > last}
        else:
            first, last, gone = -1, len(kids), set()
        for k, c in enumerate(kids):
            if isinstance(c, str):
                run.append(c)
            elif c.name == "br":
                run.append(" ")
            elif k not in gone:
                inner = below.get(c.label, [])
                edges = (lead and k == first, trail and k == last)
                if c.name in INLINE:
                    read(c, inner, *edges)
                else:
                    flush()
                    read(c, inner, *edges)
                    flush()

    open_ends = many and bool(_slots(wrapper)) and not (path and _split(path[-1])[0] in ("article", "main"))
    for k, node in enumerate(start):
        read(node, [wrapper], open_ends and k == 0, open_ends and k == len(start) - 1)
        flush()
    return "\n".join(blocks)


def _has_heading(node: Node) -> bool:
    return any(isinstance(c, Node) and (c.name in HEADINGS or _has_heading(c)) for c in node.children)


def _has_text(node: Node) -> bool:
    return any(c.strip() if isinstance(c, str) else _has_text(c) for c in node.children)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?(?:www\.|m\.|blog\.)?([^/:?#]*)", 1))


def _infer(table: pa.Table) -> pa.Table:
    order = sorted(zip(table.column("mark").to_pylist(), table.column("html").to_pylist(), strict=True))
    texts = [h for _, h in order]
    wrapper, many = infer(texts), len(texts) > 1 and not versions(texts)
    return pa.table({"host": table.column("host")[:1].cast(pa.string()), "wrapper": pa.array([json.dumps([wrapper, article_path(wrapper, many), many])], pa.string())})


def wrappers(pages: DataFrame, most: int = PAGES) -> DataFrame:
    """(host, wrapper) inferred from at most ``most`` pages of each host.

    The chosen marks and the wrappers are tables of known size, so a join broadcasts them only where they are small.
    """
    work = Work(pages.sparkSession, "wrappers")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    # marks first, so that only the chosen pages' html is moved; partial aggregation keeps the least mark of each slot
    marked = pages.select(host_of(F.col("url")).alias("host"), html.alias("html")).withColumn("mark", F.md5("html"))
    slot = F.pmod(F.xxhash64("mark"), F.lit(most))
    chosen = marked.select("host", "mark", slot.alias("slot")).groupBy("host", "slot").agg(F.min("mark").alias("chosen"))
    chosen = work.save(chosen.select(F.col("host").alias("of"), "chosen"), "chosen")
    few = marked.join(chosen, (F.col("host") == F.col("of")) & (F.col("mark") == F.col("chosen"))).groupBy("host", "mark").agg(F.first("html").alias("html"))
    return work.save(few.groupBy("host").applyInArrow(_infer, "host string, wrapper string"), "wrappers")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple] = {}
    for batch in batches:
        texts = []
        for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if wrapper not in known:
                if len(known) > 1000:
                    known.clear()
                known[wrapper] = tuple(json.loads(wrapper)) if wrapper else (["html", "1", [], None], [], False)
            texts.append(extract(page, *known[wrapper]) if page else "")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html)."""
    found = wrappers(pages).withColumnRenamed("host", "of")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    both = rows.join(found, host_of(F.col("url")) == F.col("of"), "left").select("page_id", "url", "html", "wrapper")
    return both.mapInArrow(tidy(_extract), "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
