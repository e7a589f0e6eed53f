"""Main text of web pages: subtrees that recur on a host's pages are its template and go, and so does declared boilerplate.

1. Every page is read into a tree of block elements; each subtree is hashed from its tag, texts and children's hashes.
   Pages only send (host, subtree hash) rows; they are pre-aggregated and counted per host on Spark.
2. A subtree is template when it stands beside at least ``min_pages`` different main texts of its host, and beside at
   least ``min_share`` of them.  A page's main text is its three longest blocks, so copies of a page that differ in a date
   or counter count once, and an article that is posted many times is no template.
3. A second pass keeps the texts of a page's blocks, compressed, joins the numbers of its template subtrees, and drops them.

What a page declares goes without being counted, as an advert may be seen once only: menus, asides, footers, forms, scripts
and the like by tag, role, class or id, headers outside the article.  Prose elements (paragraphs, headings, lists, quotes,
tables) within an element that declares the article are never template: licence lines and passages that articles share stay.
Where a page declares its article (``article``, ``main`` or their roles) only what is in it counts; where several outermost ones
hold less than half of the text that is left they are taken for teasers, and all of it counts.

Defined results: null and empty pages have an empty text; pages without host (null or odd addresses) have no template;
rows stand for themselves, also where ids repeat or are null; unclosed elements, comments, tags and quotes are read as
browsers do, text without markup is the text; elements may be nested to any depth; an empty table gives no rows; pages of
any length are taken whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, bounded, column

# Names of HTML elements and of page parts.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var".split()
)
NEVER = set("aside audio button canvas datalist dialog footer menu nav noscript object select svg template video".split())
PROSE = set("blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 li ol p pre table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"}}
ROLES = set("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search".split())
PARTS = set(
    "ad adbox ads adsense advert advertisement advertising adverts alert alerts banner breadcrumb breadcrumbs consent cookie cookies copyright"
    " footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo"
    " promotion recommendations recommended related search share sharing sidebar signup social sponsor sponsored sponsors subscribe subscription"
    " toolbar topbar widget".split()
)
REMARKS = set("comment comments disqus replies respond".split())
CONTENT = set("article body content entry main post story".split())

TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>|</([a-zA-Z][^\s/>]*+)[^>]*>"""
    r"""|<([a-zA-Z][^\s/>]*+)((?:[^\s>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|[\s/=]++)*+)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+""")
PIECES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
UNFINISHED = re.compile(r"<(?=[a-zA-Z/!?])")

#: How an element is left out: not, unless an article lies in it, always.
KEEP, UNLESS_ARTICLE, ALWAYS = 0, 1, 2


class _Open:
    """An open element; ``block``, ``node`` and ``mains`` are how many there were when it began."""

    __slots__ = ("tag", "out", "main", "block", "node", "mains", "parts")

    def __init__(self, tag: str, out: int, main: bool, block: int, node: int, mains: int):
        self.tag, self.out, self.main, self.block, self.node, self.mains = tag, out, main, block, node, mains
        self.parts: list[str] = []


class Page:
    """``blocks`` (text, in the article), ``nodes`` [hash, first block, end] of the countable subtrees, ``mains`` articles."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool]] = []
        self.nodes: list[list[int]] = []
        self.mains = self.in_main = self.in_out = 0
        self.words: list[str] = []
        self.open_tags: Counter[str] = Counter()
        self.stack = [_Open("", KEEP, False, 0, 0, 0)]
        self._read(source)
        while len(self.stack) > 1:
            self._close()
        self._flush()

    def _read(self, source: str) -> None:
        at, end = 0, source.rfind(">") + 1
        while match := TOKEN.search(source, at, end):
            self._text(source[at : match.start()])
            at = match.end()
            if at == end and source.startswith("<!--", match.start()) and not match[0].endswith(("-->", "--!>")):
                at = len(source)
            elif match[1]:
                self._end_tag(match[1].lower())
            elif match[2]:
                tag = match[2].lower()
                if tag in RAW:
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                    at = close.start() if close else len(source)
                else:
                    self._start_tag(tag, match[3])
        rest = source[at:]
        odd = UNFINISHED.search(rest)
        self._text(rest[: odd.start()] if odd else rest)

    def _text(self, raw: str) -> None:
        if raw:
            self.words.append(html.unescape(raw) if "&" in raw else raw)

    def _flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words.clear()
        if text:
            self.stack[-1].parts.append(text)
            self.blocks.append((text, self.in_main > 0))

    def _judge(self, tag: str, attributes: str) -> tuple[int, bool]:
        """How an element is left out, and whether it declares the article."""
        if tag in NEVER:
            return ALWAYS, False
        found = {k.lower(): v[1:-1] if v[:1] in ("'", '"') else v for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        role = found.get("role", "").lower()
        main = tag in ("article", "main") or role == "main" or found.get("itemprop", "").lower() == "articlebody"
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
            return ALWAYS, False
        if role in ROLES:
            return UNLESS_ARTICLE, main
        out = UNLESS_ARTICLE if tag == "form" or tag == "header" and not self.in_main else KEEP
        for name in (found.get("class", "") + " " + found.get("id", "")).split():
            pieces = {x.lower() for x in PIECES.findall(name)}
            if pieces & REMARKS:
                return ALWAYS, False
            if pieces & PARTS and not (pieces & PARTS == {"header"} and (self.in_main or pieces & CONTENT)):
                out = UNLESS_ARTICLE
        return (KEEP if tag in ("html", "body") else out), main and out == KEEP

    def _start_tag(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag in ("br", "hr"):
                self.words.append(" ")
            return
        if tag in INLINE:
            if attributes.strip() or self.stack[-1].tag in INLINE:
                out, _ = self._judge(tag, attributes)
                if out or self.stack[-1].tag in INLINE:  # only inside inline elements that go do others matter
                    self._flush()
                    self._open(tag, out, False)
            return
        self._flush()
        while self.stack[-1].tag in INLINE or self.stack[-1].tag == "p":
            self._close()
        while self.stack[-1].tag in CLOSES.get(tag, ()):
            self._close()
        self._open(tag, *self._judge(tag, attributes))

    def _open(self, tag: str, out: int, main: bool) -> None:
        main = main and not self.in_main and not self.in_out
        self.stack.append(_Open(tag, out, main, len(self.blocks), len(self.nodes), self.mains))
        self.open_tags[tag] += 1
        self.mains += main
        self.in_main += main
        self.in_out += out == ALWAYS

    def _end_tag(self, tag: str) -> None:
        if tag in ("br", "p", "body", "html") or tag in VOID:
            self.words.append(" ")
            if tag != "p":
                return
        if not self.open_tags[tag]:
            return self._flush() if tag not in INLINE else None
        if tag in INLINE:
            depth = len(self.stack) - 1
            while depth and self.stack[depth].tag in INLINE:
                if self.stack[depth].tag == tag:
                    while len(self.stack) > depth:
                        self._close()
                    return
                depth -= 1
            return
        self._flush()
        depth = len(self.stack) - 1
        while depth and self.stack[depth].tag != tag:
            if tag == "p" and self.stack[depth].tag not in INLINE:
                return
            depth -= 1
        while depth and len(self.stack) > depth:
            self._close()

    def _close(self) -> None:
        self._flush()
        done = self.stack.pop()
        self.open_tags[done.tag] -= 1
        self.in_out -= done.out == ALWAYS
        if done.parts:
            digest = hashlib.blake2b("\0".join([done.tag, *done.parts]).encode("utf-8", "surrogatepass"), digest_size=8).digest()
            if done.tag not in INLINE:
                self.stack[-1].parts.append(digest.hex())
                if done.tag not in ("html", "body") and not (self.in_main and (done.main or done.tag in PROSE)):
                    self.nodes.append([int.from_bytes(digest, "little", signed=True), done.block, len(self.blocks)])
        self.in_main -= done.main
        if done.out == ALWAYS or done.out == UNLESS_ARTICLE and self.mains == done.mains:
            del self.blocks[done.block :]
            for node in self.nodes[done.node :]:
                node[1] = node[2] = done.block

    def main_text(self) -> int:
        longest = heapq.nlargest(3, {text for text, _ in self.blocks}, key=lambda text: (len(text), text))
        return int.from_bytes(hashlib.blake2b("\0".join(longest).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _host(url_col: str) -> F.Column:
    return F.lower(F.try_parse_url(column(url_col).cast("string"), F.lit("HOST")))


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    source = F.coalesce(column(html_col).cast("string"), F.lit(""))
    return pages.select(column(id_col).cast("long").alias("page_id"), column(url_col).cast("string").alias("url"), _host(url_col).alias("host"), F.xxhash64(_host(url_col), source).alias("k"), source.alias("html"))


def subtrees(rows: DataFrame) -> DataFrame:
    """(page_id, k, host, main, hashes): the countable subtrees of pages that have a host."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [Page(x.as_py()) for x in batch.column(3)]
            mains, hashes = pa.array([p.main_text() for p in pages], pa.int64()), pa.array([[n[0] for n in p.nodes] for p in pages], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), mains, hashes], ["page_id", "k", "host", "main", "hashes"])

    return rows.where("host IS NOT NULL").select("page_id", "k", "host", "html").mapInArrow(read, "page_id long, k long, host string, main long, hashes array<long>")


def templates(found: DataFrame, min_pages: int, min_share: float, scratch: Scratch) -> DataFrame:
    """(page_id, k, gone): the numbers of each page's subtrees that are its host's template."""
    slim = scratch.keep(found.select("page_id", "k", F.xxhash64("host").alias("h"), "main", F.posexplode("hashes").alias("node", "hash")), "zstd")
    size = found.groupBy(F.xxhash64("host").alias("h")).agg(F.count_distinct("main").alias("size"))
    counts = slim.groupBy("h", "hash").agg(F.count_distinct("main").alias("n")).where(F.col("n") >= min_pages)
    recurring = scratch.keep(counts.join(bounded(scratch.keep(size)), "h").where(F.col("n") >= min_share * F.col("size")).select("h", "hash"))
    return slim.join(bounded(recurring), ["h", "hash"]).groupBy("page_id", "k").agg(F.sort_array(F.collect_set("node")).alias("gone"))


def _blocks(rows: DataFrame) -> DataFrame:
    """(page_id, url, k, packed): block texts and the ranges of the countable subtrees."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for x in batch.column(3):
                page = Page(x.as_py())
                held = json.dumps([page.blocks, [n[1:] for n in page.nodes], page.mains], ensure_ascii=False)
                packed.append(zlib.compress(held.encode("utf-8", "surrogatepass"), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(packed, pa.binary())], ["page_id", "url", "k", "packed"])

    return rows.select("page_id", "url", "k", "html").mapInArrow(read, "page_id long, url string, k long, packed binary")


def main_blocks(blocks: list, ranges: list, mains: int, gone: list[int]) -> list[str]:
    """The texts that stay: outside the template subtrees, and within the declared article where it holds."""
    left, at = [], 0
    for first, end in sorted(ranges[i] for i in gone):
        left += blocks[at : max(first, at)]
        at = max(at, end)
    left += blocks[at:]
    inside = [text for text, main in left if main]
    whole = [text for text, _ in left]
    return inside if inside and (mains == 1 or 2 * sum(map(len, inside)) >= sum(map(len, whole))) else whole


def extract(
    pages: DataFrame, *, min_pages: int = 5, min_share: float = 0.02, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """(page_id, url, text, n_chars, template_subtrees), one per row."""

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, dropped = [], []
            for packed, gone in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                held = json.loads(zlib.decompress(packed.as_py()).decode("utf-8", "surrogatepass"))
                texts.append(" ".join(main_blocks(*held, gone or [])))
                dropped.append(len(gone or []))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(dropped, pa.int64())], ["page_id", "url", "text", "n_chars", "template_subtrees"])

    scratch = Scratch(pages.sparkSession)
    rows = _rows(pages, id_col, url_col, html_col)
    found = scratch.keep(subtrees(rows), "zstd")
    gone = scratch.keep(templates(found, min_pages, min_share, scratch))
    size = gone.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("m")).first()
    gone = gone.select(F.col("page_id").alias("p"), F.col("k").alias("j"), "gone")
    gone = F.broadcast(gone) if size.n <= BROADCAST_ROWS and size.m <= 8 * BROADCAST_ROWS else gone
    joined = _blocks(rows).join(gone, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("k") == F.col("j")), "left")
    return joined.select("page_id", "url", "packed", "gone").mapInArrow(put_together, "page_id long, url string, text string, n_chars long, template_subtrees long")
