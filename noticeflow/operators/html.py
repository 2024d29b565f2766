"""The one Python step: HTML pages in, rows of raw facts out.

Each page is parsed once inside ``mapInPandas`` and only flat facts leave the
worker.  Every later rule is a column expression.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import entities
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from noticeflow.functions import text
from noticeflow.functions.staging import stage
from noticeflow.session import spread

_VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex "
    "keygen link menuitem meta nextid param source spacer track wbr".split()
)
_HIDDEN = frozenset(("script", "style", "template", "rt", "rp"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CONTAINERS = frozenset(("article", "li", "tr", "section", "div", "td", "p"))
# The ampersand of a named reference without its semicolon.
_BARE = re.compile(r"&(?=[A-Za-z][A-Za-z0-9]*(?![A-Za-z0-9;]))")
# Plain markup: start tags whose attributes are all double-quoted, end tags, text; no references.
_PLAIN = re.compile(
    r'(<([A-Za-z][A-Za-z0-9]*)((?:[ \t\n\r\f]+[A-Za-z][A-Za-z0-9_-]*="[^"&\0]*")*)[ \t\n\r\f]*>|</([A-Za-z][A-Za-z0-9]*)>|([^<&\0]+))'
)
_ATTRIBUTE = re.compile(r'([A-Za-z][A-Za-z0-9_-]*)="([^"]*)"')
# Their content is read by rules of its own.
_OWN_RULES = frozenset("script style title textarea iframe noembed noframes noscript xmp plaintext".split())


def _plain_tokens(source: str):
    """Tokens (whole, start, attributes, end, text) of a page of plain markup only, else None."""
    tokens = _PLAIN.findall(source)
    if sum([len(t[0]) for t in tokens]) != len(source) or any([t[1] and t[1].lower() in _OWN_RULES for t in tokens]):
        return None
    return tokens


class Page(HTMLParser):
    """Flat document: elements in order with their subtree and text ranges.

    Unclosed elements stay open until an enclosing end tag closes them, and an end
    tag that matches nothing is ignored.  ``bare_references``: a named reference without
    its semicolon counts, as in browsers; else it stays as written.
    """

    def __init__(self, source: str, bare_references: bool = True):
        super().__init__(convert_charrefs=False)
        self.tags, self.attrs, self.parents = [], [], []
        self.ends, self.text_from, self.text_to = [], [], []
        self.texts = []
        self._stack, self._open, self._hidden = [], {}, 0
        self._buffer = []
        self._memo = {}
        self._read(source if bare_references else _BARE.sub("&amp;", source))
        self._flush()
        while self._stack:
            self._pop()

    def _read(self, source: str):
        tokens = _plain_tokens(source)
        if tokens is None:
            self.feed(source)
            self.close()
            return
        self._read_plain(tokens)

    def _read_plain(self, tokens):
        """What the handlers do, for all tokens in one loop."""
        tags, attrs, parents, ends = self.tags, self.attrs, self.parents, self.ends
        text_from, text_to, texts, stack, opened = self.text_from, self.text_to, self.texts, self._stack, self._open
        hidden, text = 0, ""
        for _, start, own, end, data in tokens:
            if data:
                text = data
                continue
            if text and (text := text.strip()) and not hidden:
                texts.append(text)
            text = ""
            if start:
                tag = start.lower()
                void = tag in _VOID
                parents.append(stack[-1] if stack else -1)
                if not void:
                    stack.append(len(tags))
                    opened[tag] = opened.get(tag, 0) + 1
                    hidden += tag in _HIDDEN
                tags.append(tag)
                attrs.append({n.lower(): v for n, v in _ATTRIBUTE.findall(own)} if own else {})
                text_from.append(len(texts))
                ends.append(len(tags) if void else 0)
                text_to.append(len(texts) if void else 0)
                continue
            tag = end.lower()
            closing = not opened.get(tag)
            while not closing:
                node = stack.pop()
                closing = tags[node] == tag
                opened[tags[node]] -= 1
                hidden -= tags[node] in _HIDDEN
                ends[node], text_to[node] = len(tags), len(texts)
        self._hidden = hidden
        self._buffer.append(text)

    def _flush(self):
        if self._buffer:
            text = "".join(self._buffer).strip()
            self._buffer.clear()
            if text and not self._hidden:
                self.texts.append(text)

    def _pop(self):
        node = self._stack.pop()
        tag = self.tags[node]
        self._open[tag] -= 1
        self._hidden -= tag in _HIDDEN
        self.ends[node], self.text_to[node] = len(self.tags), len(self.texts)

    def handle_starttag(self, tag, attrs):
        self._flush()
        self.parents.append(self._stack[-1] if self._stack else -1)
        self._stack.append(len(self.tags))
        self._open[tag] = self._open.get(tag, 0) + 1
        self._hidden += tag in _HIDDEN
        self.tags.append(tag)
        self.attrs.append({key: "" if value is None else value for key, value in attrs} if attrs else {})
        self.text_from.append(len(self.texts))
        self.ends.append(0)
        self.text_to.append(0)
        if tag in _VOID:
            self._pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._pop()

    def handle_endtag(self, tag):
        self._flush()
        if self._open.get(tag):
            while True:
                closing = self.tags[self._stack[-1]] == tag
                self._pop()
                if closing:
                    break

    def handle_data(self, data):
        self._buffer.append(data)

    def handle_entityref(self, name):
        char = entities.html5.get(name + ";")
        self._buffer.append(char if char is not None else "&" + name)

    def handle_charref(self, name):
        try:
            code = int(name[1:], 16) if name[:1] in "xX" else int(name)
            # C1 controls are Windows-1252 characters in practice.
            char = bytes((code,)).decode("windows-1252", "replace") if 128 <= code < 160 else chr(code)
        except (ValueError, OverflowError):
            char = "�"
        self._buffer.append(char)

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    # -- queries -----------------------------------------------------------

    def text(self, node: int) -> str:
        """Visible text below a node, pieces joined by one space."""
        if node not in self._memo:
            span = self.texts[self.text_from[node] : self.text_to[node]]
            self._memo[node] = " ".join(span)
        return self._memo[node]

    def all_text(self) -> str:
        return " ".join(self.texts)

    def below(self, node: int, tag: str):
        return (i for i in range(node + 1, self.ends[node]) if self.tags[i] == tag)

    def has_class(self, node: int, name: str) -> bool:
        return name in self.attrs[node].get("class", "").split()


def _words(text: str) -> str:
    return " ".join(text.split())


def _context(page: Page, link: int, headings: list[int], cache: dict) -> tuple[str, bool]:
    """(heading of the nearest enclosing block, True), else (that block's differing text, False)."""
    own = _words(page.text(link))
    node = page.parents[link]
    while node >= 0 and page.tags[node] not in ("body", "html"):
        if page.tags[node] in _CONTAINERS:
            if node not in cache:
                at = bisect_left(headings, node + 1)
                inside = at < len(headings) and headings[at] < page.ends[node]
                head = _words(page.text(headings[at])) if inside else ""
                cache[node] = (head, _words(page.text(node)))
            head, block = cache[node]
            if head:
                return head, True
            if block and block != own:
                return block, False
        node = page.parents[node]
    return "", False


# Addresses whose join with a path below the host is the host and that path.
_HOST = re.compile(r"https?://[A-Za-z0-9.:-]+(?=[/?#]|$)")
_PATH = re.compile(r"(?:/[A-Za-z0-9_~%-][A-Za-z0-9_~%.-]*)+/?")


def _absolute(base: str, href: str) -> str:
    if _PATH.fullmatch(href) and (host := _HOST.match(base or "")):
        return host[0] + href
    try:
        return urljoin(base or "", href)
    except ValueError:
        return ""


def page_links(page: Page, url: str):
    """(href, abs_url, text, context, from a heading, rel, class, title) of every anchor with a target."""
    headings = [i for i, tag in enumerate(page.tags) if tag in _HEADINGS]
    cache: dict = {}
    for node, tag in enumerate(page.tags):
        attrs = page.attrs[node]
        if tag == "a" and "href" in attrs:
            href = _words(attrs["href"])
            yield (
                href,
                _absolute(url, href),
                page.text(node),
                *_context(page, node, headings, cache),
                " ".join(attrs.get("rel", "").split()),
                " ".join(attrs.get("class", "").split()),
                attrs.get("title", ""),
            )


def _untidy(text: str) -> bool:
    """Cleaning does more to the text, or to a part of it, than to collapse its white space."""
    return ("<" in text and ">" in text) or "Ã" in text or "Â" in text


def page_rows(page: Page, url: str):
    """Table rows as in ``ROW_SCHEMA`` from ``in_listing`` on: position facts, group link, cells with classes, row links.

    White space is collapsed where cleaning does no more; other rows are ``untidy`` and keep their texts.
    """
    tags, attributes, text = page.tags, page.attrs, page.text
    listing = next((i for i, t in enumerate(tags) if t == "table" and page.has_class(i, "listagem")), None)
    number = 0
    for node, tag in enumerate(tags):
        if tag != "tr":
            continue
        in_listing = listing is not None and listing < node < page.ends[listing]
        inside = range(node + 1, page.ends[node])
        cells = [i for i in inside if tags[i] == "td"]
        group = next((c for c in cells if "class" in attributes[c] and page.has_class(c, "agrupador")), None)
        anchor = next(page.below(group, "a"), None) if group is not None else None
        number += in_listing and group is not None
        title = attributes[anchor].get("title", "") if anchor is not None else None
        untidy = _untidy(text(node)) or _untidy(title or "")
        tidy = text if untidy else lambda n: _words(text(n))
        yield (
            in_listing,
            number,
            tidy(node),
            group is not None,
            anchor is not None,
            tidy(anchor) if anchor is not None else None,
            title if untidy or not title else _words(title),
            attributes[anchor].get("onclick", "") if anchor is not None else None,
            [(tidy(c), attributes[c].get("class", "")) for c in cells],
            [
                (href, _absolute(url, href), tidy(a))
                for a in inside
                if tags[a] == "a" and "href" in attributes[a]
                for href in (_words(attributes[a]["href"]),)
            ],
            untidy,
        )


def page_containers(page: Page, url: str, cls: str):
    """(title, href, date) of each ``div.cls`` whose first anchor has a target."""
    for node, tag in enumerate(page.tags):
        if tag == "div" and page.has_class(node, cls):
            anchor = next(page.below(node, "a"), None)
            if anchor is not None and page.attrs[anchor].get("href"):
                dates = (s for s in page.below(node, "span") if page.has_class(s, "date"))
                date = next(dates, None)
                yield (
                    page.text(anchor),
                    page.attrs[anchor]["href"],
                    page.text(date) if date is not None else None,
                )


def _matches(page: Page, node: int, selector: str) -> bool:
    if selector.startswith("."):
        return page.has_class(node, selector[1:])
    tag, _, test = selector.rstrip("]").partition("[")
    if page.tags[node] != tag:
        return False
    name, _, part = test.partition("*=")
    return not test or (name in page.attrs[node] and part.strip("'\"") in page.attrs[node][name])


def page_signals(page: Page, selectors):
    """Title, structure flags, matched selectors and the visible text."""
    title = next((i for i, t in enumerate(page.tags) if t == "title"), None)
    nodes = range(len(page.tags))
    return {
        "title": page.text(title) if title is not None else None,
        "has_structure": "html" in page.tags and "body" in page.tags,
        "has_password": any(
            t == "input" and a.get("type") == "password" for t, a in zip(page.tags, page.attrs)
        ),
        "matched": [s for s in selectors if any(_matches(page, n, s) for n in nodes)],
        "body_text": page.all_text(),
        "link_count": page_link_count(page),
    }


def page_link_count(page: Page) -> int:
    return sum(t == "a" and "href" in a for t, a in zip(page.tags, page.attrs))


LINK_SCHEMA = (
    "page_id long, url string, pos int, href string, abs_url string, text string, context string, "
    "from_heading boolean, rel string, cls string, title_attr string"
)
ROW_SCHEMA = (
    "page_id long, url string, pos int, in_listing boolean, grp int, row_text string, is_group boolean, "
    "has_link boolean, link_text string, link_title string, link_onclick string, "
    "cells array<struct<text:string,cls:string>>, links array<struct<href:string,abs_url:string,text:string>>, "
    "untidy boolean"
)
TEXT_SCHEMA = "page_id long, body_text string"
CONTAINER_SCHEMA = "page_id long, url string, pos int, title string, href string, date string"
SIGNAL_SCHEMA = (
    "page_id long, url string, title string, has_structure boolean, has_password boolean, "
    "matched array<string>, body_text string, link_count long"
)


def _frame(rows, columns):
    return pd.DataFrame(rows, columns=columns)


def _names(schema: str) -> list[str]:
    names, depth, start = [], 0, 0
    for i, char in enumerate(schema + ","):
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            names.append(schema[start:i].split()[0])
            start = i + 1
    return names


def _per_page(pages: DataFrame, facts, schema: str) -> DataFrame:
    """Run ``facts(page, url)`` over every page; one output row per yielded tuple."""
    columns = _names(schema)

    def run(batches):
        for batch in batches:
            rows = []
            for page_id, url, source in zip(batch["page_id"], batch["url"], batch["html"]):
                for pos, fact in enumerate(facts(Page(source or ""), url)):
                    rows.append((page_id, url, pos, *fact))
                    if len(rows) >= 4096:
                        yield _frame(rows, columns)
                        rows = []
            if rows:
                yield _frame(rows, columns)

    return spread(pages.select("page_id", "url", "html")).mapInPandas(run, schema)


def extract_links(pages: DataFrame, repair: bool = True) -> DataFrame:
    """Every anchor of every page, in document order, with its context.

    ``repair``: texts that show markup or mojibake are read once more; else they stay as a reader sees them.
    """
    raw = _per_page(pages, page_links, LINK_SCHEMA)
    clean = text.clean_text if repair else text.squash
    cleaned = stage(raw, text=clean(F.col("text")), context=clean(F.col("context")))
    context = F.col("context")
    cut = F.when(F.col("from_heading"), text.truncate(context, 240)).otherwise(text.truncate(context, 600))
    return stage(cleaned, context=F.coalesce(cut, F.lit(""))).select(*[c for c in raw.columns if c != "from_heading"])


def _structs(lists: list[list[tuple]], names: list[str]) -> pa.Array:
    """Lists of string tuples as an array of lists of structs."""
    ends = [0]
    for each in lists:
        ends.append(ends[-1] + len(each))
    columns = list(zip(*[item for each in lists for item in each], strict=True)) or [()] * len(names)
    fields = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)


_ROW_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), *[pa.string()] * 3]


def _row_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    flat = [pa.array(c, t) for c, t in zip(columns, _ROW_TYPES)]
    cells, links = _structs(columns[11], ["text", "cls"]), _structs(columns[12], ["href", "abs_url", "text"])
    return pa.RecordBatch.from_arrays([*flat, cells, links, pa.array(columns[13], pa.bool_())], names)


def extract_rows(pages: DataFrame) -> DataFrame:
    """Every table row of every page, texts cleaned; absent texts stay null.

    Nested facts leave the worker as Arrow columns. Only texts of untidy rows are cleaned by expressions.
    """
    names = _names(ROW_SCHEMA)

    def run(batches):
        for batch in batches:
            rows = []
            for page_id, url, source in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html")], strict=True):
                for pos, fact in enumerate(page_rows(Page(source or ""), url)):
                    rows.append((page_id, url, pos, *fact))
                    if len(rows) >= 4096:
                        yield _row_batch(rows, names)
                        rows = []
            if rows:
                yield _row_batch(rows, names)

    raw = spread(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")).mapInArrow(run, ROW_SCHEMA)
    untidy = F.col("untidy")
    cleaned = lambda c: F.when(untidy & c.isNotNull(), text.clean_text(c)).otherwise(c)
    each = lambda c: F.when(
        untidy, F.transform(c, lambda e: e.withField("text", text.clean_text(e["text"])))).otherwise(c)
    staged = stage(
        raw, **{c: cleaned(F.col(c)) for c in ("row_text", "link_text", "link_title")}, **{c: each(F.col(c)) for c in ("cells", "links")}
    )
    return staged.select(*[c for c in raw.columns if c != "untidy"])


def page_text(source: str) -> str:
    """Visible text of a page; plain markup without hidden elements needs no tree."""
    tokens = _plain_tokens(source)
    if tokens is None or any([t[1] and t[1].lower() in _HIDDEN for t in tokens]):
        return Page(source).all_text()
    return " ".join(filter(None, [t[4].strip() for t in tokens if t[4]]))


def extract_texts(pages: DataFrame) -> DataFrame:
    """page_id, body_text of every page, as in ``extract_signals``."""

    def run(batches):
        for batch in batches:
            bodies = [page_text(source or "") for source in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(bodies, pa.string())], ["page_id", "body_text"])

    return spread(pages.select(F.col("page_id").cast("long").alias("page_id"), "html")).mapInArrow(run, TEXT_SCHEMA)


def extract_containers(pages: DataFrame, cls: str) -> DataFrame:
    """Links of fixed containers, with their date text."""
    return _per_page(pages, lambda page, url: page_containers(page, url, cls), CONTAINER_SCHEMA)


def extract_signals(pages: DataFrame, selectors, carry: str | None = None, bare_references: bool = True) -> DataFrame:
    """One row of structural facts per page; ``carry`` names a text column to pass along.

    Passing it through the parser saves a join that would shuffle the page text.
    """
    selectors = tuple(selectors)
    schema = SIGNAL_SCHEMA + (f", {carry} string" if carry else "")
    columns = _names(schema)

    def run(batches):
        for batch in batches:
            rows = []
            extra = batch[carry] if carry else [None] * len(batch)
            for page_id, url, source, more in zip(batch["page_id"], batch["url"], batch["html"], extra):
                facts = (page_id, url, *page_signals(Page(source or "", bare_references), selectors).values())
                rows.append((*facts, more) if carry else facts)
            yield _frame(rows, columns)

    read = ["page_id", "url", "html", *([carry] if carry else [])]
    return spread(pages.select(*read)).mapInPandas(run, schema)


def count_links(pages: DataFrame) -> DataFrame:
    """page_id, link_count of every page; no text leaves the worker, and one page is held at a time."""

    def run(batches):
        for batch in batches:
            counts = [page_link_count(Page(source or "")) for source in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "link_count": pd.Series(counts, dtype="int64")})

    return spread(pages.select("page_id", "html")).mapInPandas(run, "page_id long, link_count long")
