"""Main text of web pages by consensus host paths.

1. Every page is parsed; menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are left out. Content
   are the blocks within main or article, or else all that have text outside of links, and the page votes for the deepest path of
   containers that holds all of them.
2. A path is generalised: tags with their classes, digits replaced, so that pages of one template share it. Votes are counted per host in Spark.
3. Every page is parsed again and its text taken from the host's winning path; a page in which that path doesn't hold all of its content
   is of another template and keeps its own.

A block is what stands between block-level tags; its white space becomes one space; blocks are joined by line breaks in page order. Nulls, empty
pages and pages without text give an empty text. Pages without a url form one host. Truncated pages end where they end. Repeated rows
give repeated results; extra columns are left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from followgraph.llm.common import small_side
from followgraph.session import written

# Names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe object svg math textarea title xmp select button canvas audio video".split())
CONTAINERS = set("html body main article section div td center".split())
BLOCKS = CONTAINERS | set(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table thead tbody tfoot tr th caption hr figure figcaption address details"
    " summary nav header footer aside form fieldset head hgroup".split()
)
SKIPPED = set("head nav header footer aside form fieldset dialog menu".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
CLASSES = set(
    "ad ads advert adverts advertisement sponsored sponsor promo banner cookie cookies consent notice notices alert popup modal overlay"
    " sidebar side-bar nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer comment comments disqus"
    " respond replies social share sharing related recommended newsletter subscribe widget pagination pager skip copyright".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)[^>]*+(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_MARKED = [re.compile(rf"/{tag}(?:[./]|$)") for tag in ("main", "article")]
_SPACE = re.compile(r"[\s​﻿]+")


class _Open:
    """An open element."""

    __slots__ = ("tag", "path", "skipped", "link")

    def __init__(self, tag: str, path: str, skipped: bool, link: bool) -> None:
        self.tag, self.path, self.skipped, self.link = tag, path, skipped, link


def _described(attributes: str) -> tuple[list[str], bool]:
    """Classes of an element, and whether it is one of those to leave out."""
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    classes = sorted({re.sub(r"\d+", "#", c.lower()) for c in found.get("class", "").split()})
    names = [*classes, *found.get("id", "").lower().split()]
    words = {w for name in names for w in (name, *re.split(r"[-_]+", name)[:1])}
    hidden = re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes) is not None if "hidden" in attributes else False
    return classes, bool(words & CLASSES) or found.get("role", "").lower() in ROLES or hidden


def blocks_of(page: str) -> list[tuple[str, int, tuple[str, ...]]]:
    """(text, characters inside links, paths of the containers around it) of each block that isn't left out."""
    out: list[tuple[str, int, tuple[str, ...]]] = []
    stack: list[_Open] = [_Open("", "", False, False)]
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            paths = tuple(dict.fromkeys(e.path for e in stack))
            out.append((text, linked, paths))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        top = stack[-1]
        if text and not top.skipped:
            text = html.unescape(text)
            parts.append(text)
            linked += len(text.strip()) if top.link else 0

    def close(count: int) -> None:
        for _ in range(count):
            if stack[-1].tag in BLOCKS:
                flush()
            stack.pop()

    at = 0
    while at < len(page):
        token = _TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        add(page[at : token.start()])
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if token[1]:
            depth = next((k for k, e in enumerate(reversed(stack)) if e.tag == tag), None)
            if depth is not None:
                close(depth + 1)
            elif tag in BLOCKS:
                flush()
            continue
        if tag in RAW:
            if not token[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            parts.append(" ")
            continue
        if tag in VOID:
            flush() if tag == "hr" else parts.append(" ")
            continue
        if tag in BLOCKS:
            ends = CLOSES.get(tag, set())
            inner = len(stack) - 1
            while inner > 0 and stack[inner].tag not in CONTAINERS | SKIPPED | {"ul", "ol", "dl", "table", "blockquote"}:
                if stack[inner].tag == "p" or stack[inner].tag in ends:
                    close(len(stack) - inner)
                    break
                inner -= 1
            else:
                if tag == "td" and stack[-1].tag == "td":
                    close(1)
            flush()
        classes, left_out = _described(token[3]) if token[3].strip() else ([], False)
        top = stack[-1]
        path = f"{top.path}/{'.'.join([tag, *classes])}" if tag in CONTAINERS else top.path
        left_out = left_out and tag not in ("html", "body", "article", "main")
        stack.append(_Open(tag, path, top.skipped or tag in SKIPPED or left_out, top.link or tag == "a"))
    close(len(stack) - 1)
    flush()
    return out


def _content(blocks: list[tuple[str, int, tuple[str, ...]]]) -> list[tuple[str, ...]]:
    """Containers around each block of the main content.

    These are the blocks within main, else within article, where it has half of the page's text outside of links, and else all
    blocks that aren't links only.
    """
    total = sum(max(0, len(text) - linked) for text, linked, _ in blocks)
    for inside in _MARKED:
        marked = [(max(0, len(text) - linked), paths) for text, linked, paths in blocks if inside.search(paths[-1])]
        if marked and 2 * sum(own for own, _ in marked) >= total:
            return [paths for _, paths in marked]
    return [paths for text, linked, paths in blocks if len(text) > linked]


def _best(content: list[tuple[str, ...]]) -> str | None:
    """The deepest path that holds all of the content."""
    common = set(content[0]).intersection(*content) if content else ()
    return max(common, key=content[0].index) if common else None


def extract_text(page: str, host_path: str | None) -> str:
    """The page's text within the host's path, or within its own best path where that one would lose content."""
    blocks = blocks_of(page)
    content = _content(blocks)
    path = host_path if content and all(host_path in paths for paths in content) else _best(content)
    return "\n".join(text for text, _, paths in blocks if path in paths)


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path that most pages of each host vote for; ties go to the longer path."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [_best(_content(blocks_of(p or ""))) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["host", "path"])

    counts = pages.select(_host(), "html").mapInArrow(votes, "host string, path string").where("path is not null")
    counts = counts.groupBy("host", "path").agg(F.count("*").alias("n"))
    first = F.max(F.struct("n", F.length("path").alias("size"), "path"))
    return counts.groupBy("host").agg(first.alias("first")).select("host", F.col("first.path").alias("path"))


def _host():
    url = F.lower(F.coalesce(F.col("url"), F.lit("")))
    return F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1).alias("host")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    winners = small_side(written(host_paths(pages), "host-paths"), 256)
    rows = pages.select("page_id", "url", "html", _host()).join(winners, "host", "left").select("page_id", "url", "html", "path")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_text(p or "", path) for p, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")
