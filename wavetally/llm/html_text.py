"""Main text of web pages by removal of site templates.

Every element's subtree is hashed from its tag, its children and its text. Spark
counts per host on how many different pages a subtree occurs; subtrees that recur
on many pages of their host are template and are deleted, with everything in them,
inside articles as well. What says itself that it is no content (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) goes
too. Where elements marked as article or main hold at least ``MAIN_SHARE`` of the text
that is left, they alone are the content; otherwise all that is left is.

Pages of a host with the same text (before template deletion) count as one page, so
what is copied as a whole is not template. Paragraphs that a few articles share stay
in each; on ``MIN_PAGES`` different pages and ``MIN_SHARE`` of the host's they are template.

A page's subtrees are a short list of hashes, and copies of a page and a host's
subtrees are counted before anything moves, so a host with a third of all pages costs
no more than others. Recurring subtrees per host are few: each is on at least
``MIN_SHARE`` of the host's pages, so there are at most 1 / MIN_SHARE times the
elements of a page.

Blocks are what block-level tags set apart; white space within a block becomes one
space; character references are decoded.

Defined results: a null or empty page has the text ''; a page without url counts
to a host of its own kind (null); unclosed elements end with the element around
them; repeated rows count each; other columns of the input are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.llm.common import slices
from wavetally.session import materialize

MIN_PAGES = 5
MIN_SHARE = 0.3
MAIN_SHARE = 0.5
BROADCAST_ROWS = 100_000

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)>""",
    re.S,
)
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "xmp", "iframe"}
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
DROPPED = {
    "nav", "menu", "header", "footer", "aside", "form", "button", "select", "option", "dialog", "head", "svg", "canvas", "object", "audio",
    "video", "map", "math", "fieldset", "frameset",
} | RAW
MAIN = {"article", "main"}
#: Words of class, id and role that say what an element is. Fixed values.
NOT_CONTENT = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promoted", "banner", "cookie",
    "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
    "sidebar", "complementary", "contentinfo", "footer", "header", "search", "comment", "comments", "disqus", "replies", "reply", "share",
    "sharing", "social", "related", "newsletter", "subscribe", "pagination",
}
#: Articles carry category words in their classes, so only a whole class, id or role says what they are, or one of these.
REMARK = re.compile(r"(?:div-)?(?:comment|reply)[_-](?:body|item|\d+)")
#: A start tag that ends an open element of these tags.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class _Open:
    """An open element: what it has gathered so far, and how many blocks there were before it."""

    __slots__ = ("around", "blocks", "digest", "dropped", "main", "tag")

    def __init__(self, tag: str, dropped: bool, main: bool, blocks: int, around: list[str] | None = None):
        self.tag, self.dropped, self.main, self.blocks = tag, dropped, main, blocks
        self.around = around  # of an inline element: the block it stands in, which goes on behind it
        self.digest = xxhash.xxh3_64(tag)


def _is_dropped(tag: str, attrs: str) -> bool:
    if tag in DROPPED:
        return True
    if not attrs or tag in ("main", "body", "html"):
        return False
    said = " ".join("".join(m) for m in MARKS.findall(attrs)).lower()
    if tag in MAIN:
        return any(w in NOT_CONTENT or REMARK.fullmatch(w) for w in said.split())
    return bool(said) and not NOT_CONTENT.isdisjoint(re.split(r"[\s_-]+", said))


class Page:
    """A parsed page. ``subtrees``: hashes of the subtrees with text that is not dropped; ``text``: what stays."""

    def __init__(self, source: str, recurring: frozenset[int] | set[int] = frozenset()):
        self.recurring = recurring
        self.subtrees: set[int] = set()
        self.blocks: list[tuple[str, bool]] = []  # text, whether inside the main content
        self._stack: list[_Open] = [_Open("", False, False, 0)]
        self._held: list[str] = []
        self._parse(source)

    @property
    def text(self) -> str:
        marked = sum(len(t) for t, main in self.blocks if main)
        only = marked > 0 and marked >= MAIN_SHARE * sum(len(t) for t, _ in self.blocks)
        return "\n".join(t for t, main in self.blocks if main or not only)

    @property
    def key(self) -> int:
        """The same for pages of the same text."""
        return xxhash.xxh3_64_intdigest("\n".join(t for t, _ in self.blocks)) - (1 << 63)

    def _say(self, raw: str) -> None:
        if raw:
            self._held.append(raw)

    def _end_block(self) -> None:
        if self._held:
            words = html.unescape("".join(self._held)).split()
            self._held.clear()
            if words:
                text, top = " ".join(words), self._stack[-1]
                top.digest.update(text)
                if not top.dropped:
                    self.blocks.append((text, top.main))

    def _close(self) -> None:
        self._end_block()
        done = self._stack.pop()
        if done.around is not None:
            self._held = done.around
            return
        key = done.digest.intdigest() - (1 << 63)
        if len(self.blocks) > done.blocks:
            self.subtrees.add(key)
            if key in self.recurring:
                del self.blocks[done.blocks :]
        self._stack[-1].digest.update(key.to_bytes(8, "little", signed=True))

    def _open(self, tag: str, attrs: str) -> None:
        if tag in INLINE:  # only what is dropped is opened
            self._stack.append(_Open(tag, True, False, len(self.blocks), self._held))
            self._held = []
            return
        self._end_block()
        block_ends = CLOSES.get(tag, {"p"} if tag not in VOID else set())
        if self._stack[-1].tag in block_ends:
            self._close()
        top = self._stack[-1]
        dropped = top.dropped or _is_dropped(tag, attrs)
        main = not dropped and (top.main or tag in MAIN)
        if tag not in VOID:
            self._stack.append(_Open(tag, dropped, main, len(self.blocks)))

    def _parse(self, source: str) -> None:
        at = 0
        while m := TOKEN.search(source, at):
            tag, end = (m["tag"] or "").lower(), bool(m["end"])
            self._say(source[at : m.start()])
            at = m.end()
            if not tag:
                continue
            if tag in RAW:
                if not end and not m["attrs"].endswith("/"):
                    close = RAW_END[tag].search(source, at)  # what stands before it is no markup
                    at = close.end() if close else len(source)
                continue
            if tag == "br":
                self._say(" ")
            elif tag in INLINE and not (any(o.tag == tag for o in self._stack) if end else tag not in VOID and _is_dropped(tag, m["attrs"])):
                continue
            elif not end:
                self._open(tag, m["attrs"])
            elif any(o.tag == tag for o in self._stack):
                while self._stack[-1].tag != tag:
                    self._close()
                self._close()
            else:
                self._end_block()
        self._say(source[at:])
        while len(self._stack) > 1:
            self._close()
        self._end_block()


def host():
    """Column: the host of ``url``, without port, user and www."""
    return F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?(?:www\.)?([^/:?#]*)", 1)


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, recurring): hashes of the subtrees on at least ``min_pages`` pages and ``min_share`` of the host's pages.

    Pages are those of different text: of copies, one counts."""

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            read = [Page(source or "") for source in part.column("html").to_pylist()]
            lists = [sorted(p.subtrees) for p in read]
            yield pa.RecordBatch.from_arrays(
                [part.column("host"), pa.array([p.key for p in read], pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["host", "page", "subtrees"]
            )

    found = pages.select(host().alias("host"), "html").mapInArrow(subtrees, "host string, page long, subtrees array<long>")
    different = found.groupBy("host", "page").agg(F.min("subtrees").alias("subtrees"))
    each = different.select("host", F.explode(F.concat("subtrees", F.array(F.lit(None).cast("long")))).alias("subtree"))  # null counts the page
    counts = each.groupBy("host", "subtree").agg(F.count("*").alias("n")).where((F.col("n") >= min_pages) | F.col("subtree").isNull())
    counts = materialize(counts, "subtrees")
    totals = counts.where("subtree IS NULL").select(F.col("host").alias("_host"), F.col("n").alias("pages"))
    often = counts.where("subtree IS NOT NULL").join(totals, F.col("host").eqNullSafe(F.col("_host"))).where(F.col("n") >= min_share * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("subtree").alias("recurring"))


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text of every row."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            rows = zip(part.column("html").to_pylist(), part.column("recurring").to_pylist())
            texts = [Page(source or "", set(recurring or ())).text for source, recurring in rows]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    templates = site_templates(pages, min_pages, min_share).persist()
    few = templates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    with_host = pages.select("page_id", "url", "html", host().alias("_host"))
    side = F.broadcast(templates) if few else templates
    joined = with_host.join(side, F.col("host").eqNullSafe(F.col("_host")), "left").select("page_id", "url", "html", "recurring")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(extract, f"page_id {kind}, url string, text string")
