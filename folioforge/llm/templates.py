"""Main text of web pages, with site templates removed.

Every page is parsed into elements; each element's subtree has a hash of its tags and text.  Spark counts on how many pages
of a host each hash occurs; subtrees that recur on a fixed number of them are template and are deleted, with the
regions that HTML itself marks as menus, headers, footers, forms and the like.  Paragraph text inside the article is
never judged by recurrence, so a sentence that many articles share stays.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)", re.DOTALL)
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
#: Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head script style noscript template nav footer aside form button select option textarea input svg canvas iframe object embed audio video dialog menu title noembed noframes datalist".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody thead table figcaption caption article main body html".split())
ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role names that mark what is not the article.
MARKS = frozenset("ad ads advert advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup sidebar side aside widget menu nav navbar navigation breadcrumb breadcrumbs toolbar topbar masthead header footer copyright legal comment comments disqus respond reply replies discussion reactions share sharing social related recommended recommendations login search pagination pager skip toc".split())


class Element:
    """block: the nearest element, itself included, that is a block; hidden: whether it or one around it is no part of an article."""

    __slots__ = ("tag", "marked", "children", "parent", "hash", "block", "hidden")

    def __init__(self, tag: str, marked: bool, parent):
        self.tag, self.marked, self.children, self.parent, self.hash = tag, marked, [], parent, 0
        self.block = self if tag in BLOCKS or parent is None else parent.block
        self.hidden = marked or tag in DROPPED or parent is not None and parent.hidden


def marks(attributes: str) -> bool:
    found = NAMES.findall(attributes) if "=" in attributes else ()
    return any(w in MARKS for _, v in found for w in re.split(r"[^a-z]+", v.lower()))


def parse(text: str) -> Element:
    """The element tree of a page, however badly it nests.  Every step up the tree closes an element, so the time is linear."""
    root = Element("#root", False, None)
    now, at = root, 0
    opened: dict[str, int] = {}  # open elements of each tag

    def up(e: Element) -> Element:
        opened[e.tag] -= 1
        return e.parent

    end = len(text)
    while at < end:
        m = TOKEN.search(text, at)
        if not m:
            break
        if m.start() > at:
            now.children.append(text[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                now.children.append(html.escape(m[0][9:].removesuffix("]]>"), False))
            continue
        tag = tag.lower()
        if m[1]:
            if opened.get(tag):
                while now.tag != tag:
                    now = up(now)
                now = up(now)
            elif tag == "p":
                now.children.append(Element("p", False, now))
            continue
        if tag in BLOCKS and now.block.tag == "p":  # nothing but inline elements inside an open paragraph
            while now.tag != "p":
                now = up(now)
            now = up(now)
        if tag in ENDS_ITSELF and now.tag in ENDS_ITSELF[tag]:
            while now.parent is not None and now.tag in ENDS_ITSELF[tag]:
                now = up(now)
        element = Element(tag, marks(m[3]), now)
        now.children.append(element)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>|\Z", re.IGNORECASE).search(text, at)
            element.children.append(text[at : close.start()])
            at = close.end()
            continue
        now = element
        opened[tag] = opened.get(tag, 0) + 1
    if at < end:
        now.children.append(text[at:])
    return root


def elements(root: Element) -> list[Element]:
    """All elements, each before its parent."""
    out, stack = [], [root]
    while stack:
        e = stack.pop()
        out.append(e)
        stack.extend(c for c in e.children if isinstance(c, Element))
    return out[::-1]


def hashed(root: Element) -> list[Element]:
    """All elements with the hash of their subtree, stable between processes."""
    import xxhash

    order = elements(root)
    for e in order:
        e.hash = xxhash.xxh64_intdigest("\0".join([e.tag, *(str(c.hash) if isinstance(c, Element) else " ".join(c.split()) for c in e.children)]).encode("utf-8", "replace"))
    return order


def _article(root: Element) -> Element:
    """The article or main element with the most text; without one, the page."""
    sizes: dict[int, int] = {}
    best, most = root, 0
    for e in elements(root):  # each before its parent
        size = sizes[id(e)] = sum(len(c) if isinstance(c, str) else sizes[id(c)] for c in e.children)
        if e.tag in ("article", "main") and not e.hidden and (size > most or size == most and e.tag == "article" and best.tag == "main"):
            best, most = e, size
    return best


def counted(e: Element) -> bool:
    return e.tag in BLOCKS and e.tag not in ("html", "body", "article", "main")


def judged_by_recurrence(e: Element) -> bool:
    return e.tag in BLOCKS and e.tag not in PARAGRAPHS


def cut(root: Element) -> tuple[list[str], list[tuple[int, int, int]]]:
    """Blocks of the article in page order, and (hash, first block, end) of every element that recurrence may judge."""
    top = _article(root)
    inside = top.tag != "#root"
    blocks: list[str] = []
    judged: list[tuple[int, int, int]] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            block = " ".join(html.unescape("".join(run)).split())
            if block:
                blocks.append(block)
            run.clear()

    stack: list = [(top, 0, 0)]
    while stack:
        e, k, first = stack.pop()
        if k == 0 and e is not top and (e.tag in DROPPED or e.tag == "header" and not inside or e.marked):
            if e.tag in BLOCKS:
                flush()
            continue
        if k == 0:
            if e.tag in BLOCKS:
                flush()
                first = len(blocks)
            elif e.tag == "br":
                run.append(" ")
        while k < len(e.children):
            c = e.children[k]
            k += 1
            if isinstance(c, str):
                run.append(c)
            else:
                stack.append((e, k, first))
                stack.append((c, 0, 0))
                break
        else:
            if e.tag in BLOCKS:
                flush()
                if e is not top and counted(e) and (judged_by_recurrence(e) or not inside) and len(blocks) > first:
                    judged.append((e.hash, first, len(blocks)))
    flush()
    return blocks, judged


def page_key(text: str) -> int:
    """Pages with equal HTML are one page."""
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))


def signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _hashes(least_pages: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(host, hash, page) of this batch; least_pages different pages of a subtree are enough to know it recurs."""
        for batch in batches:
            seen: dict[tuple[str, int], set[int]] = {}
            for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = page_key(text)
                for h in {e.hash for e in hashed(parse(text)) if counted(e)}:
                    of = seen.setdefault((host, h), set())
                    if len(of) < least_pages:
                        of.add(page)
            rows = [(host, h, page) for (host, h), of in seen.items() for page in of]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), signed([r[1] for r in rows]), signed([r[2] for r in rows])], names=["host", "hash", "page"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages, made = [], []
        for text in batch.column("html").to_pylist():
            root = parse(text)
            hashed(root)
            pages.append(page_key(text))
            made.append(cut(root))
        ends = np.cumsum([0, *(len(judged) for _, judged in made)]).astype(np.int32)
        flat = [j for _, judged in made for j in judged]
        lists = [pa.ListArray.from_arrays(pa.array(ends), values) for values in (signed([j[0] for j in flat]), pa.array([j[1] for j in flat], pa.int32()), pa.array([j[2] for j in flat], pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("host"), signed(pages), pa.array([blocks for blocks, _ in made], pa.list_(pa.string())), *lists], names=["page_id", "url", "host", "page", "blocks", "hashes", "firsts", "ends"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, gone = [], []
        for template, blocks, *judged in zip(*(batch.column(c).to_pylist() for c in ("template", "blocks", "hashes", "firsts", "ends")), strict=True):
            known = frozenset(template or ())
            dropped = {k for h, first, end in zip(*judged, strict=True) if h in known for k in range(first, end)} if known else ()
            texts.append("\n".join(b for k, b in enumerate(blocks) if k not in dropped))
            gone.append(len(dropped))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_template"])


def extracted(pages: DataFrame, least_pages: int = 5, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_template of every row.

    A subtree of a host is template if it stands on at least least_pages different pages of it, however many the host
    has; pages with equal HTML count once, so copies of an article do not make it template.  n_template: blocks that
    recurrence alone removed.  A null page is empty; a null or odd URL has the empty host.  White space of any kind
    counts; a block without text gives no line.  A quote that nothing closes ends with its tag.  Rows may repeat, an empty table gives
    no rows, and the time for a page is linear in its length.
    """
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"\A[^/]*?://([^/?#]*)", 1))
    rows = rows.withColumn("host", host)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    counts = rows.select("host", "html").mapInArrow(_hashes(least_pages), "host string, hash long, page long").groupBy("host", "hash").agg(F.count_distinct("page").alias("n"))
    often = written(counts.where(F.col("n") >= least_pages).select("host", "hash"), "templates")
    blocks = rows.mapInArrow(_cut, f"page_id {kinds['page_id']}, url {kinds['url']}, host string, page long, blocks array<string>, hashes array<long>, firsts array<int>, ends array<int>")
    # by subtree first, then by page: the templates of a host never meet in one row
    found = blocks.select("host", "page", F.explode(F.array_distinct("hashes")).alias("hash")).join(often, ["host", "hash"])
    template = written(found.groupBy("host", "page").agg(F.collect_set("hash").alias("template")), "page-templates")
    return blocks.join(template, ["host", "page"], "left").mapInArrow(_joined, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_template long")
