"""Main text of web pages by differencing each page with its nearest neighbour.

A page is cut into text blocks at block-level tags. Pages of a host are put in the
order of their URL paths; of the page before and the page after, the one whose path
begins more like a page's own is its neighbour. The two pages' blocks are aligned by
a longest common subsequence, and shared blocks are deleted as template text. Pages
of a host with equal blocks count as one page, as a copy tells nothing apart.

Mark-up has the first word where a neighbour can't tell: what stands in navigation,
footers, asides, forms, adverts, notices or comments is never main text, however
much it varies; the paragraphs, headings, lists, tables and quotes of an ``article``
or ``main`` element are main text even if the neighbour repeats one. Differencing
decides all other blocks: those of pages without such an element, those outside it,
and those inside it that are no prose, unless the neighbour's article is a copy of
the page's own (more than half of its text is shared).
"""

from __future__ import annotations

import html
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lodestone.llm.shared import load, trim, written
from lodestone.llm.url_filter import url_parts

#: Elements whose content is no text of the page.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select", "button", "object", "canvas")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE) for name in RAW}
#: Of these, those that reach to the end of the page if nothing closes them.
SWALLOW = {"script", "style", "textarea", "iframe", "title"}
#: Elements that are never main text.
DROPPED = {"head", "nav", "footer", "aside", "form", "menu", "dialog"}
#: Elements that mark main text.
MAIN = {"article", "main"}
#: Elements that end a block where they begin and end.
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements whose text in a main element is main text whatever the neighbour has.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "li", "dt", "dd", "blockquote", "pre", "td", "th", "caption", "figcaption", "summary"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that have no end tag of their own accord: a new one of the group ends an open one.
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Names of class, id or role that mark template text wherever they stand.
LABELS = {
    "ad", "ads", "adsense", "alert", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "gdpr",
    "masthead", "modal", "nav", "newsletter", "notice", "pager", "pagination", "popup", "sidebar", "subscribe", "topbar",
}
#: Beginnings of further such names.
LABEL_STEMS = ("advert", "sponsor", "promo", "navig", "navbar", "navi")
#: Names that also stand for ordinary things: they count if the attribute says nothing else.
WEAK_LABELS = {
    "banner", "footer", "header", "login", "menu", "recommendations", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "side", "signup", "social", "widget",
}
#: Parts that a compound name may have besides a label, as in site-header or comment-list.
FILLERS = {
    "area", "articles", "banner", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "footer", "form", "global", "header", "icons", "inner", "item",
    "left", "links", "list", "main", "menu", "news", "page", "panel", "post", "posts", "primary", "right", "secondary", "section", "site", "slot", "text", "thread", "top", "unit", "widget", "wrap", "wrapper",
}
_PARTS = re.compile(r"[-_]+")
_SIZE = re.compile(r"\d+(?:x\d+)?")
_LETTER = re.compile(r"[a-zA-Z]")
_NAME_END = re.compile(r"[\s/>]")
_QUOTE_OR_END = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_NO_DISPLAY = re.compile(r"display\s*+:\s*+none", re.IGNORECASE)
_NUMBER = re.compile(r"&#(\d{8,}|[xX][0-9a-fA-F]{8,})")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
OPEN, KEPT, LOST = 0, 1, 2
#: In a main element, but no prose.
SOFT = 3
#: Lost like LOST while the page is read, but main elements in a form, and ``main`` in a labelled element, are main text.
FORM, LABELLED = 4, 5


def _label(name: str) -> str | None:
    """``strong`` or ``weak`` if a class, id or role name marks template text: a label, or a compound of labels and fillers."""
    parts = _PARTS.split(name.lower())
    kind = None
    for part in parts:
        if part in LABELS or part.startswith(LABEL_STEMS):
            kind = "strong"
        elif part in WEAK_LABELS:
            kind = kind or "weak"
        elif part not in FILLERS and not _SIZE.fullmatch(part):
            return None
    return kind


def label_of(values: list[str], in_main: bool) -> str | None:
    """What the attributes ``values`` say of an element. A weak label needs a value that holds nothing else.

    In a main element headers are left alone: an article's own header holds its headline.
    """
    found = None
    for value in values:
        names = [n for n in value.split() if not (in_main and "header" in n.lower())]
        kinds = [_label(n) for n in names]
        if "strong" in kinds:
            return "strong"
        if kinds and None not in kinds:
            found = "weak"
    return found


def decoded(text: str) -> str:
    """Character references decoded. A number too long to be a character counts as an unknown one."""
    if "&" not in text:
        return text
    return html.unescape(_NUMBER.sub("&#xFFFFFF", text))


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of texts (name is the text), start tags and end tags, in one pass over the page.

    Comments, declarations and elements without text are left out. A ``<`` that
    begins no tag is text, and so is the rest of the page behind its last ``>``. The
    first quote of an attribute that is never closed ends quoting for the rest of the
    page, so that each character is looked at a bounded number of times.
    """
    at, text_from, n, quoting = 0, 0, len(page), True
    last = page.rfind(">")
    unclosed: set[str] = set()
    while True:
        start = page.find("<", at)
        if start < 0 or start > last:
            break
        after = page[start + 1 : start + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                end = n if end < 0 else end + 3
            else:
                end = page.find(">", start) + 1
            if start > text_from:
                yield "text", page[text_from:start], ""
            at = text_from = end
            if end >= n:
                return
            continue
        closing = after == "/"
        begin = start + 1 + closing
        if not _LETTER.match(page, begin):
            at = start + 1
            continue
        stop = _NAME_END.search(page, begin).start()  # there is a ">" ahead
        where, end = stop, -1
        while quoting:
            m = _QUOTE_OR_END.search(page, where)
            if m is None:
                quoting = False
            elif m[0] == ">":
                end = m.start()
                break
            else:
                where = page.find(m[0][-1], m.end()) + 1
                quoting = where > 0
        if end < 0:
            end = page.find(">", stop)
        if start > text_from:
            yield "text", page[text_from:start], ""
        name, rest = page[begin:stop].lower(), page[stop:end]
        at = text_from = end + 1
        if closing:
            yield "end", name, ""
        elif name in RAW:
            close = None if name in unclosed or rest.endswith("/") and name == "svg" else _RAW_END[name].search(page, at)
            if close:
                at = text_from = page.find(">", close.end()) + 1 or n
            elif name in SWALLOW:
                return
            else:
                unclosed.add(name)
        else:
            yield "start", name, rest
    if text_from < n:
        yield "text", page[text_from:], ""


def attributes(rest: str) -> tuple[dict[str, str], bool]:
    """The attributes of a start tag, and whether they hide the element."""
    if not rest or rest.isspace() or rest == "/":
        return {}, False
    found: dict[str, str] = {}
    for name, b, c, d in _ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), b or c or d)
    hidden = "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or bool(_NO_DISPLAY.search(found.get("style", "")))
    return found, hidden


def page_blocks(page: str | None) -> list[tuple[int, str]]:
    """(state, text) of each text block: LOST for template elements, KEPT for main prose, SOFT for other text of main elements, OPEN where the mark-up is silent.

    References are decoded, white space becomes one space, blocks are trimmed and
    empty ones left out. Broken mark-up is read as a browser would, more or less:
    unknown end tags are ignored, open elements end with their parents. Null is an
    empty page. Time grows with the length of the page, whatever it holds.
    """
    out: list[tuple[int, str, int]] = []
    stack: list[tuple[str, int, bool, int]] = []  # open elements: name, state inside, prose, group
    places: dict[str, list[int]] = {}  # where each name stands in the stack
    walls: list[int] = []  # where articles, mains and bodies stand
    words: list[str] = []
    #: Weakly labelled elements of main elements: lost unless they hold a paragraph. Group 0 is none of them.
    lost = [False]
    state, prose, group = OPEN, False, 0

    def flush():
        if words:
            text = " ".join(decoded("".join(words)).split())
            words.clear()
            if text:
                kind = LOST if state in (LOST, FORM, LABELLED) else SOFT if state == KEPT and not prose else state
                out.append((kind, text, group))

    def cut(to: int):
        for name, *_ in stack[to:]:
            places[name].pop()
        while walls and walls[-1] >= to:
            walls.pop()
        del stack[to:]

    for kind, name, rest in tokens(page or ""):
        if kind == "text":
            words.append(name)
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            words.append(" ")
        if kind == "end":
            if places.get(name):
                to = places[name][-1]
                if not walls or to >= walls[-1] or name in ("article", "main", "body", "html"):
                    cut(to)
        elif name not in VOID and not rest.endswith("/"):
            if name in IMPLIED:
                while stack and stack[-1][0] in IMPLIED[name]:
                    cut(len(stack) - 1)
            elif name in BLOCKS:
                while stack and stack[-1][0] == "p":
                    cut(len(stack) - 1)
            if name == "body":
                cut(0)
            _, inside, flows, within = stack[-1] if stack else ("", OPEN, False, 0)
            if name == "p":
                lost[within] = False
            if inside != LOST:
                found, hidden = attributes(rest)
                label = None
                if found and name not in ("html", "body", *MAIN):
                    # a heading's id is its anchor and marks nothing
                    label = label_of([found[a] for a in ("class", "id", "role") if found.get(a) and (a != "id" or name not in HEADINGS)], inside == KEPT)
                wraps = name == "form" and inside != KEPT
                if name in DROPPED and not wraps or name == "header" and inside != KEPT or hidden:
                    inside = LOST
                elif label and inside != KEPT:
                    inside = LABELLED
                elif label == "strong":
                    inside = LOST
                elif label:
                    lost.append(True)
                    within = len(lost) - 1
                elif wraps:
                    inside = FORM if inside == OPEN else inside
                elif name in MAIN and (inside != LABELLED or name == "main"):
                    inside = KEPT
            places.setdefault(name, []).append(len(stack))
            if name in ("article", "main", "body"):
                walls.append(len(stack))
            stack.append((name, inside, name not in MAIN and (flows or name in PROSE), within))
        _, state, prose, group = stack[-1] if stack else ("", OPEN, False, 0)
    flush()
    return [(LOST if lost[g] else kind, text) for kind, text, g in out]


def shared_blocks(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """True for the blocks of ``own`` in a longest common subsequence with ``other``.

    Equal beginnings and ends are matched first; of the rest only blocks that both
    have count. Bit-parallel: one large integer holds a row of the table, whose zero
    bits are its steps. One row in a stride is kept and the rows between are made
    again on the way back, so memory is the square root of the table.
    """
    shared = np.zeros(len(own), bool)
    n = min(len(own), len(other))
    head = int(np.argmin(np.append(own[:n] == other[:n], False)))
    tail = int(np.argmin(np.append(own[::-1][: n - head] == other[::-1][: n - head], False)))
    shared[:head] = True
    shared[len(own) - tail :] = True
    a, b = own[head : len(own) - tail], other[head : len(other) - tail]
    at = head + np.flatnonzero(np.isin(a, b))
    a, b = a[np.isin(a, b)].tolist(), b[np.isin(b, a)].tolist()
    if not a:
        return shared
    where: dict[int, list[int]] = {}
    for i, x in enumerate(b):
        where.setdefault(x, []).append(i)
    many: dict[int, int] = {}

    def places(x: int) -> int:
        """The places of a block in ``b`` as bits; kept for frequent blocks only."""
        found = where[x]
        if len(found) == 1:
            return 1 << found[0]
        if x not in many:
            bits = np.zeros(len(b), bool)
            bits[found] = True
            mask = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if len(found) < 32:
                return mask
            many[x] = mask
        return many[x]

    full = (1 << len(b)) - 1
    stride = max(1, int(len(a) ** 0.5))

    def rows(first: int, row: int) -> list[int]:
        out = [row]
        for x in a[first : first + stride]:
            met = row & places(x)
            row = (row + met | row - met) & full
            out.append(row)
        return out

    marks, row = [], full
    for first in range(0, len(a), stride):
        marks.append(row)
        row = rows(first, row)[-1]
    j = len(b)
    for k in range(len(marks) - 1, -1, -1):
        part = rows(k * stride, marks[k])
        for i in range(len(part) - 1, 0, -1):
            steps = ~part[i] & (1 << j) - 1
            j = steps.bit_length()  # the last step at or before j
            if not j:
                return shared
            if part[i - 1] >> (j - 1) & 1:  # no step there in the row above: a match
                shared[at[k * stride + i - 1]] = True
                j -= 1
    return shared


def _hashes(blocks: list[tuple[int, str]]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t.encode()) for _, t in blocks], np.uint64).view(np.int64)


def kept_blocks(blocks: list[tuple[int, str]], shared: list[bool]) -> list[str]:
    """The texts that are main text, given which blocks the neighbour shares.

    If the neighbour's article is a copy, more than half of it shared, its loose
    lines tell nothing and stay.
    """
    main = [(len(t), twice) for (kind, t), twice in zip(blocks, shared, strict=True) if kind in (KEPT, SOFT)]
    copy = 2 * sum([n for n, twice in main if twice]) > sum([n for n, _ in main])
    return [t for (kind, t), twice in zip(blocks, shared, strict=True) if kind == KEPT or kind == OPEN and not twice or kind == SOFT and (copy or not twice)]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, 128):
            part = batch.slice(s, 128)
            hashes = [_hashes(page_blocks(x)) for x in part.column(4).to_pylist()]
            digest = [xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63) for h in hashes]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(digest, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["host", "path", "page_id", "key", "digest", "hashes"])
    trim()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, 128):
            part = batch.slice(s, 128)
            texts, counts = [], []
            for page, other in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                blocks = page_blocks(page)
                shared = shared_blocks(_hashes(blocks), np.array(other or [], np.int64))
                texts.append("\n".join(kept_blocks(blocks, shared.tolist())))
                counts.append(int(shared.sum()))
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["page_id", "url", "text", "n_shared"])
    trim()


@F.pandas_udf(IntegerType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Characters that two paths begin with in common; -1 without a second path."""
    return pd.Series([-1 if y is None else len(os.path.commonprefix((x, y))) for x, y in zip(a, b, strict=True)])


_PLACE = ["host", "path", "page_id", "key", "digest"]


def neighbours(places: DataFrame) -> DataFrame:
    """(``host``, ``digest``, ``near``) of places (``host``, ``path``, ``page_id``, ``key``, ``digest``); ``near`` is another place's digest.

    In the order of paths the longest common beginning stands next to a path: before
    it or behind it. Of equals the page before counts. The order is dealt out in
    ranges, so a host of any size is spread over tasks; the ends of a range look to
    the ranges beside it.
    """
    order = [F.col(c) for c in _PLACE]
    light = written(places.select(*order).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "order")
    line = Window.partitionBy("range").orderBy(*order)
    row = F.struct("host", "path", "digest")
    both = light.select("*", F.lag(row).over(line).alias("back"), F.lead(row).over(line).alias("ahead"))
    edges = light.groupBy("range").agg(F.max(F.struct(*order)).alias("last"), F.min(F.struct(*order)).alias("first"))
    ranges = Window.orderBy("range")  # a row for each range
    edges = edges.select("range", F.lag("last").over(ranges).alias("last"), F.lead("first").over(ranges).alias("first"))
    both = both.join(edges, "range")
    one = lambda inside, edge: F.coalesce(inside, F.struct(f"{edge}.host", f"{edge}.path", f"{edge}.digest"))
    both = both.select("host", "path", "digest", one("back", "last").alias("back"), one("ahead", "first").alias("ahead"))
    same = lambda c: F.when(F.col(f"{c}.host") == F.col("host"), F.col(c))
    both = both.select("host", "path", "digest", same("back").alias("back"), same("ahead").alias("ahead"))
    nearer = F.when(_alike("path", "ahead.path") > _alike("path", "back.path"), F.col("ahead.digest")).otherwise(F.col("back.digest"))
    return both.select("host", "digest", nearer.alias("near")).where("near IS NOT NULL")


def main_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``url``, ``text``, ``n_shared`` (blocks shared with the neighbour).

    ``text`` is the kept blocks joined by newlines, empty for null and empty pages.
    Pages without a host are neighbours among themselves. Pages of a host with equal
    blocks, repeated rows among them, stand once in the order of URLs, where the
    first does, and have one neighbour. Other columns are not read. Only hashes of
    blocks travel to find neighbours; the pages themselves are shuffled once.
    """
    host, path = url_parts(F.col(url))
    ident = F.xxhash64(F.col(url), F.col(page))
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"), host.alias("host"), path.alias("path"), ident.alias("key"))
    lines = rows.select("host", "path", "page_id", "key", "html").mapInArrow(_lines, "host string, path string, page_id bigint, key bigint, digest bigint, hashes array<bigint>")
    lines = written(lines, "lines")
    places = lines.groupBy("host", "digest").agg(F.min(F.struct("path", "page_id", "key")).alias("p")).select("host", "p.*", "digest")
    near = neighbours(places)
    contents = lines.groupBy("host", "digest").agg(F.first("hashes").alias("others")).withColumnRenamed("digest", "near")
    near = near.join(contents, ["host", "near"]).select("host", "digest", "others")
    ident = [F.coalesce("page_id", F.lit(-(1 << 63))).alias("p"), "key"]
    of = lines.select(*ident, "host", "digest").join(near, ["host", "digest"]).groupBy("p", "key").agg(F.first("others").alias("others"))
    joined = rows.select(*ident, "page_id", "url", "html").join(of, ["p", "key"], "left").select("page_id", "url", "html", "others")
    return joined.mapInArrow(_texts, "page_id bigint, url string, text string, n_shared bigint")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = main_text(load(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"), "n_shared")
