"""Main text of web pages: marked-up blocks, minus what the page nearest by URL has too."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from itemlens.llm.common import blocks, bounded, lists
from itemlens.llm.neighbours import in_order
from itemlens.session import table

# a quote opens a value only right after "="; nothing here is tried twice
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|<[!?/][^>]*>", re.S)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object"}
NESTING = {"svg", "math", "object", "template"}
UNENDED = {"noscript", *NESTING}  # without an end tag of these what follows is no part of them
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "col", "colgroup", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend",
    "li", "listing", "main", "menu", "nav", "ol", "optgroup", "option", "p", "plaintext", "pre", "search", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "title", "tr", "ul", "xmp"}  # others, unknown ones too, stand in a line
WORDS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dt", "dd", "td", "th", "span", "a"}  # whose ids in an article are made of their text
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar"}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
    "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "popup", "promo", "promoted", "related", "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "widget"}
TOP_NAMES = {"header", "masthead", "banner"}  # of a page; an article's own is its headline
QUALIFIERS = {"site", "global", "top", "bottom", "left", "right", "list", "box", "block", "area", "links", "bar"}  # that change no name of NAMES
MAIN = {"article", "main"}
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
CLOSES = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}  # a new one ends an open one
OPEN, KEPT, LEFT_OUT = 0, 1, 2  # a line outside of the main element, inside it, or in a part that is left out
STAYS, BY_NAME, GONE = 0, 1, 2  # why a part is left out: not, by its class or id only, by its element, role or hiding


def _named(value: str, in_main: bool) -> bool:
    """Is a whole name of a class or id one of NAMES, or made of them and of words that change nothing ("cookie-notice", "site-footer")?"""
    for whole in value.split():
        parts = {x for x in re.split(r"[^a-z0-9]+", whole) if not x.isdigit()} - {""}
        found = parts & NAMES
        if found and parts <= NAMES | QUALIFIERS and not (in_main and found <= TOP_NAMES):
            return True
    return False


def _left_out(tag: str, attributes: str, in_main: bool) -> int:
    if tag in DROPPED or (tag == "header" and not in_main):
        return GONE
    by_name = STAYS
    for name, value in ATTRIBUTE.findall(attributes or ""):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return GONE
        if name == "id" and in_main and tag in WORDS:
            continue
        if name in ("class", "id") and tag not in ("body", "html") and _named(value, in_main):
            by_name = BY_NAME
    return by_name


def text_lines(page: str) -> list[tuple[str, int]]:
    """(line, mark) of each block of text in page order; character references decoded, white space runs one space."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int, bool]] = []  # (tag, left out, main) of the open elements
    buffer: list[str] = []
    kind = OPEN  # the mark of what is in the buffer
    ends: dict[str, dict[int, int]] = {}

    def state() -> tuple[int, bool]:
        return (stack[-1][1], stack[-1][2]) if stack else (STAYS, False)

    def flush():
        if buffer:
            line = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if line:
                out.append((line, kind))

    def add(text: str):
        """More text of the line at hand. A part within it that is left out goes and does not end it."""
        nonlocal kind
        gone, main = state()
        mark = LEFT_OUT if gone else KEPT if main else OPEN
        if buffer and mark != kind:
            if mark == LEFT_OUT:
                return
            flush()
        kind = mark
        buffer.append(text)

    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        found = TOKEN.search(page, at) if at <= last else re.compile(r"<!--.*\Z", re.S).search(page, at)  # without a ">" no tag can follow
        stop = found.start() if found else end
        if stop > at:
            add(page[at:stop])
        if not found:
            break
        at = found.end()
        tag = (found.group(2) or "").lower() if found.re is TOKEN else ""
        if not tag:
            continue
        if tag not in BLOCK:
            if tag == "br":
                add(" ")
            elif found.group(1):
                if stack and stack[-1][0] == tag:
                    stack.pop()
            elif tag in RAW:
                at = _after(page, tag, found.group(3), at, ends)
            elif tag not in VOID:
                gone, main = state()
                if not gone and _left_out(tag, found.group(3), main):
                    stack.append((tag, GONE, main))
            continue
        flush()
        if found.group(1):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            at = _after(page, tag, found.group(3), at, ends)
            continue
        if tag in VOID or found.group(3).endswith("/"):
            continue
        if tag in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] not in CLOSES and stack[k][0] in BLOCK:
                    break
        gone, main = state()
        is_main = tag in MAIN or re.search(r"role\s*=\s*[\"']?main\b", found.group(3), re.I) is not None
        own = _left_out(tag, found.group(3), main)
        if is_main and own == BY_NAME and not gone:
            own = STAYS
        if is_main and own == STAYS and gone == BY_NAME and not main:
            gone = STAYS  # a wrapper's name says nothing about the main element in it
        stack.append((tag, max(gone, own), main or is_main))
    flush()
    return out


def _after(page: str, tag: str, attributes: str, at: int, ends: dict[str, dict[int, int]]) -> int:
    """The place after an element whose inside is no text. Of those that may hold one of their own name the ends of all that follow are
    found in one pass, and kept in ``ends``."""
    if tag in ("svg", "math") and attributes.endswith("/"):  # of these only a parser takes the slash for the end
        return at
    if tag not in NESTING:
        found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
        return found.end() if found else at if tag in UNENDED else len(page)
    if tag not in ends:
        ends[tag], open_ = {}, [at]
        for found in re.compile(rf"<(/?){tag}\b[^<>]*>", re.I).finditer(page, at):
            if not found.group(1):
                if not found.group(0).endswith("/>"):
                    open_.append(found.end())
            elif open_:
                ends[tag][open_.pop()] = found.end()
    return ends[tag].get(at, at)


def shared(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence of two lists, by the longest rise of matching places."""
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    tails: list[int] = []
    nodes: list = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            node = (i, j, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                nodes.append(node)
            else:
                tails[k], nodes[k] = j, node
    out, node = [], nodes[-1] if nodes else None
    while node:
        out.append((node[0], node[1]))
        node = node[2]
    return out[::-1]


ALMOST = 20  # characters of own lines that copies may differ in: a count of views, a date


def aligned(a: list[str], b: list[str]) -> tuple[list[tuple[int, int]], bool]:
    """The pairs of ``shared``, and whether the two are copies: neither has more than ``ALMOST`` characters of its own."""
    if a == b:
        return [(k, k) for k in range(len(a))], True
    pairs = shared(a, b)
    same = sum(len(a[i]) for i, _ in pairs)
    return pairs, max(sum(map(len, a)), sum(map(len, b))) - same <= ALMOST


def told_apart(rows: Iterator[tuple]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Each row (id, lines, marks, url, key, bucket, ghost) with the nearest different pages of its host before and after it.

    Rows that are copies of the one before wait together until a different page comes; equal ones share their lines.
    """
    before, waiting = None, []
    for row in rows:
        last = waiting[-1] if waiting else None
        if last and (last[5] != row[5] or last[4].split("\t", 1)[0] != row[4].split("\t", 1)[0]):
            yield from ((x, [y for y in (before,) if y]) for x in waiting)
            before, waiting, last = None, [], None
        if last and last[1] == row[1] and last[2] == row[2]:
            row = (row[0], last[1], last[2], *row[3:])
        if last and not _copies(last, row):
            yield from ((x, [y for y in (before, row) if y]) for x in waiting)
            before, waiting = last, []
        waiting.append(row)
    yield from ((x, [y for y in (before,) if y]) for x in waiting)


def _copies(a: tuple, b: tuple) -> bool:
    return aligned(*([x[1][k] for k, m in enumerate(x[2]) if m != LEFT_OUT] for x in (a, b)))[1]


def deleted(lines: list[str], marks: list[int], others: list[tuple[list[str], list[int]]]) -> str:
    """The text without lines that a neighbour has at the same turn of the page.

    All lines that are not left out are aligned, and shared ones go, however many they are; a copy tells nothing about a template.
    Lines of a main element stay even so, as articles may quote each other. Beside a main element a line of the page's own stays where a
    neighbour shows the template around it, by having a line outside the main element too; where none does, the main element is the text.
    """
    own = [k for k, m in enumerate(marks) if m != LEFT_OUT]
    main = {k for k in own if marks[k] == KEPT}
    gone: set[int] = set()
    a = [lines[k] for k in own]
    for theirs, their_marks in others:
        pairs, copies = aligned(a, [x for x, m in zip(theirs, their_marks) if m != LEFT_OUT])
        if not copies:
            gone.update(own[i] for i, _ in pairs)
    told = not main or not gone <= main
    return "\n".join(lines[k] for k in own if k in main or (told and k not in gone))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text string): each page's main text.

    A page is read into lines, one a block, marked by the elements they stand in. Pages of a host are ordered by path;
    a page is aligned with the nearest pages before and after it that are not copies of it, and lines shared with one go, as do the
    parts that their elements or names call menus, headers, footers, sidebars, notices, adverts, forms or comments. Where a
    page has an article or main element its lines stay, shared or not, and with them lines outside that the page has for itself, if a
    neighbour shows the template there. Past the bounds of a
    task one page is seen to either side: if that is a copy too, the other side alone tells.

    A null or empty page has an empty text. A null URL counts as the empty host and path; pages of one URL follow by id
    and content. Repeated rows give a row each; broken markup ends elements where a parser would; an empty table gives an
    empty one; other columns are left out.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    df = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"), F.col(url_col).cast("string").alias("url"), F.concat_ws(
        "\t", host, path, rest, F.lpad(F.coalesce(F.col(id_col).cast("string"), F.lit("")), 20, "0"),
        F.hex(F.xxhash64(html_col))).alias("key"))
    kind = pages.schema[id_col].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1 << 22):
            found = [text_lines(x or "") for x in batch.column(1).to_pylist()]
            sizes = [len(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), lists(pa.array([t for x in found for t, _ in x], pa.string()), sizes),
                 lists(pa.array([m for x in found for _, m in x], pa.int32()), sizes)], names=["id", "url", "key", "lines", "marks"])

    lines = bounded(df).mapInArrow(parse, f"id {kind}, url string, key string, lines array<string>, marks array<int>")
    id_type = to_arrow_type(pages.schema[id_col].dataType)
    rows = in_order(lines, F.col("key"), before=True, keys=df.select("key")).select("id", "lines", "marks", "url", "#key", "#bucket", "#ghost")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple]:
            for whole in batches:
                for at in range(0, len(whole), 256):
                    yield from zip(*(c.to_pylist() for c in whole.slice(at, 256).columns))

        schema = pa.schema([(id_col, id_type), ("url", pa.string()), ("text", pa.string())])
        texts = ({id_col: row[0], "url": row[3], "text": deleted(row[1], row[2], [x[1:3] for x in others])}
                 for row, others in told_apart(read()) if row[6] == 0)
        while out := list(islice(texts, 256)):
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(finish, f"`{id_col}` {kind}, url string, text string")


def op7_page_text(spark: SparkSession, d: str) -> DataFrame:
    """The main text of all ``pages``."""
    return extract(table(spark, d, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
