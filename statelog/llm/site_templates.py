"""Main text of web pages, without what a site repeats.

Every page is read into elements. The subtrees of block elements are hashed and counted for each
host in Spark; a subtree that recurs on many different pages of its host, or of a section of it, is
part of the site's template and is deleted. Pages of the same main text are copies and count once, so a page's own text
is no template however often its host serves the page. What is left of an ``article`` or ``main`` element is the main text; without one, it is
what is left of the page. Inside an article, a paragraph, heading, list item or table row is a
template only if it is on half of the host's different pages, such as a notice on each, and goes where
most of the article stays; a line that some articles share is content. Elements that say what they are, such as ``nav`` or ``class="ad"``, go
on any page, also on hosts with few pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelog.llm.common import stored

#: A template subtree is on so many different pages of its host, and on this share of them.
LEAST_PAGES = 5
LEAST_SHARE = 0.01
#: Prose of articles is a template on this share of the host's different pages; on a page it goes if
#: the article keeps as much of its text at least.
PROSE_SHARE = 0.5

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
_RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|title|select|canvas|video|audio"
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rb rp rt ruby s samp small span "
    "strike strong sub sup time tt u var label".split())
_CONTENT = frozenset("article main".split())
#: Text of an article.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li tr figcaption".split())
#: Values, which repeat by chance; a table's cells are judged with their row.
_VALUES = frozenset("dd dt td th".split())
_DROPPED = frozenset("nav footer aside form head button dialog menu fieldset".split())
#: Part of a page's frame, but the head of an article inside one.
_FRAME = frozenset(["header"])
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert sidebar comment comments disqus replies respond menu nav navbar navigation breadcrumb "
    "breadcrumbs footer share sharing social related recommended newsletter subscribe subscription signup login popup "
    "modal overlay widget toolbar pagination pager skip disclaimer copyright tags search".split())
#: What names run together may begin with.
_BEGINNINGS = ("comment", "advert", "adsby", "sponsor", "cookie", "sidebar", "footer", "navbar")
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: A paragraph ends where one of these begins.
_ENDS_PARAGRAPH = frozenset(
    "p div ul ol dl table section article main aside nav header footer form h1 h2 h3 h4 h5 h6 pre blockquote hr "
    "figure fieldset address details menu".split())
#: An element ends where its like begins.
_ENDS_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
              "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("ul ol dl table select div section article main body".split())

_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*)>""",
    re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(
    r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    __slots__ = ("tag", "first", "gone", "content", "inside")

    def __init__(self, tag: str, first: int, gone: bool, content: bool, inside: bool) -> None:
        self.tag, self.first, self.gone, self.content, self.inside = tag, first, gone, content, inside


def _says_gone(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element names itself as something else than main text."""
    if tag in _DROPPED or (tag in _FRAME and not inside):
        return True
    if tag in _CONTENT or tag in ("body", "html") or "=" not in attributes and "hidden" not in attributes:
        return False
    for found in _ATTRIBUTE.finditer(attributes):
        name, value = found[1].lower(), found[2] or found[3] or found[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return True
        if name in ("class", "id") and tag not in _INLINE:
            parts = {p.lower() for p in _NAME_PARTS.findall(value)}
            if parts & _NAMES or not inside and "header" in parts or any(
                p.startswith(_BEGINNINGS) for p in parts
            ):
                return True
    return False


class Page:
    """The text pieces of a page and the spans of pieces that its elements cover."""

    def __init__(self, source: str) -> None:
        #: (text or None for the border of a block, dropped by name, inside an article)
        self.pieces: list[tuple[str | None, bool, bool]] = []
        #: (hash, first piece, piece after the last, prose of an article)
        self.subtrees: list[tuple[int, int, int, bool]] = []
        self.has_content = False
        self._open: list[Element] = [Element("", 0, False, False, False)]
        at = 0
        for found in _MARKUP.finditer(source):
            self._text(source[at : found.start()])
            at = found.end()
            tag = found[3]
            if tag:
                tag = tag.lower()
                if found[2]:
                    self._end(tag)
                else:
                    self._start(tag, found[4])
            elif not found[1]:
                continue
        self._text(source[at:])
        while len(self._open) > 1:
            self._close()

    def _text(self, text: str) -> None:
        if text:
            top = self._open[-1]
            self.pieces.append((text, top.gone, top.inside))

    def _border(self) -> None:
        self.pieces.append((None, False, False))

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _VOID:
            if tag in ("br", "hr"):
                self._border()
            return
        if tag in _ENDS_PARAGRAPH:
            self._end_before("p", ("p",))
        elif tag in _ENDS_LIKE:
            self._end_before(tag, _ENDS_LIKE[tag])
        if tag not in _INLINE:
            self._border()
        if attributes.endswith("/"):
            return
        top = self._open[-1]
        gone = top.gone or _says_gone(tag, attributes, top.inside)
        content = tag in _CONTENT and not gone
        self.has_content |= content
        self._open.append(Element(tag, len(self.pieces), gone, content, top.inside or content))

    def _end_before(self, tag: str, ended: tuple[str, ...]) -> None:
        """Close the innermost of the elements that this start tag ends, within its scope."""
        for depth in range(len(self._open) - 1, 0, -1):
            if self._open[depth].tag in ended:
                while len(self._open) > depth:
                    self._close()
                return
            if self._open[depth].tag in _SCOPES:
                return

    def _end(self, tag: str) -> None:
        if tag == "p" and not any(e.tag == "p" for e in self._open):
            self._border()
            return
        for depth in range(len(self._open) - 1, 0, -1):
            if self._open[depth].tag == tag:
                while len(self._open) > depth:
                    self._close()
                return
            if tag in _INLINE and self._open[depth].tag not in _INLINE:
                return

    def _close(self) -> None:
        element = self._open.pop()
        if element.tag in _INLINE:
            return
        self._border()
        if element.tag in ("html", "body") or element.tag in _CONTENT and element.inside:
            return
        if element.inside and element.tag in _VALUES:
            return
        prose = element.inside and element.tag in _PROSE
        text = "\x1f".join(t for t, _, _ in self.pieces[element.first :] if t and not t.isspace())
        if text:
            number = xxhash.xxh3_64_intdigest(f"{'article ' if prose else ''}{element.tag}\x1e{text}")
            self.subtrees.append((number - 2**63, element.first, len(self.pieces), prose))

    def digest(self) -> int:
        """A hash of the main text with all that recurs in it: copies of a page have the same."""
        return xxhash.xxh3_64_intdigest(self._kept([False] * len(self.pieces))) - 2**63

    def text(self, templates: frozenset[int] | set[int]) -> str:
        """The main text without the subtrees of the host's template.

        A page of which nothing would be left, such as a page that its host serves many times, keeps
        what only the counts would delete.
        """
        gone = [False] * (len(self.pieces) + 1)
        for number, first, last, prose in self.subtrees if templates else ():
            if number in templates and not prose:
                gone[first:last] = [True] * (last - first)
        less = gone.copy()
        for number, first, last, prose in self.subtrees if templates else ():
            if number in templates and prose:
                less[first:last] = [True] * (last - first)
        # An article of which little else would stay is a copy, not a story with notices.
        if less != gone and len(self._kept(less)) >= PROSE_SHARE * len(self._kept(gone)):
            gone = less
        return self._kept(gone) or (self._kept([False] * len(gone)) if templates else "")

    def _kept(self, gone: list[bool]) -> str:
        out = []
        for (text, dropped, inside), removed in zip(self.pieces, gone):
            if text is None:
                out.append(" ")
            elif not dropped and not removed and (inside or not self.has_content):
                out.append(html.unescape(text) if "&" in text else text)
        return " ".join("".join(out).split())


def host_of(url: str | None) -> str:
    """The host of a URL, without user and port, in lower case; empty if there is none."""
    found = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def section_of(url: str | None) -> str:
    """The first folder of a URL's path; empty if there is none."""
    found = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//[^/?#]*/([^/?#]+)/", url or "")
    return found[1] if found else ""


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, host, section, subtree, prose, page): the distinct subtrees of each page, and 0 for the
    page itself, with the digest of the page."""
    for batch in batches:
        pages, hosts, sections, trees, prose, digests = [], [], [], [], [], []
        ids = batch.column("id").to_pylist()
        for number, url, source in zip(ids, batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            page = Page(source or "")
            found = {s[0]: s[3] for s in page.subtrees}
            found[0] = False
            pages.extend([number] * len(found))
            hosts.extend([xxhash.xxh3_64_intdigest(host_of(url)) - 2**63] * len(found))
            sections.extend([xxhash.xxh3_64_intdigest(section_of(url)) - 2**63] * len(found))
            trees.extend(found)
            prose.extend(found.values())
            digests.extend([page.digest()] * len(found))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(x, pa.int64()) for x in (pages, hosts, sections, trees, digests)), pa.array(prose, pa.bool_())],
            names=["id", "host", "section", "subtree", "page", "prose"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = [None if x is None else squeeze(x.encode()) for x in batch.column("html").to_pylist()]
        names = ["id", "page_id", "url"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(packed, pa.binary())], names=[*names, "html"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts = []
        for source, found in zip(batch.column("html").to_pylist(), batch.column("found").to_pylist()):
            texts.append("" if source is None else Page(expand(source).decode()).text(frozenset(found or ())))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array(np.array([len(t) for t in texts], np.int64))],
            names=["page_id", "url", "text", "n_chars"])


def templates_of(subtrees: DataFrame) -> DataFrame:
    """(host, subtree) of the subtrees that recur on many different pages of their host or section.

    A page that is in several sections counts in the first of them.
    """
    # Copies meet by page, before the shuffle where they can, so no task gets a host.
    tree = ["host", "subtree", "prose"]
    different = subtrees.groupBy(*tree, "page").agg(F.min("section").alias("section"))
    by_section = different.groupBy(*tree, "section").agg(F.count("*").alias("pages"))
    by_host = by_section.groupBy(*tree).agg(F.sum("pages").alias("pages"))
    share = F.when(F.col("prose"), PROSE_SHARE).otherwise(LEAST_SHARE)

    def often(counts: DataFrame, of: list[str]) -> DataFrame:
        every = counts.where("subtree = 0").select(*of, F.col("pages").alias("all_pages"))
        many = counts.where((F.col("subtree") != 0) & (F.col("pages") >= LEAST_PAGES))
        return many.join(every, of).where(F.col("pages") >= share * F.col("all_pages")).select("host", "subtree")

    # A line of a language is on many pages of that language's section, so prose is judged by host.
    sections = often(by_section.where("not prose"), ["host", "section"])
    return often(by_host, ["host"]).union(sections).distinct()


def main_texts(pages: DataFrame) -> DataFrame:
    """Text and length in code points of every page, from its whole html.

    A NULL html gives an empty text, a NULL url counts as a host of its own. Character references
    are decoded, white space inside a block is one space, blocks are joined by one space. Repeated
    rows have a text each and count as one page. An empty table gives no rows; other columns are ignored. Rows are
    numbered as they are read: ``pages`` must give the same rows in the same order whenever it is
    read, as a table in files does.
    """
    rows = pages.select(F.monotonically_increasing_id().alias("id"), "page_id", "url", "html")
    subtrees = stored(
        rows.select("id", "url", "html").mapInArrow(
            _subtrees, "id long, host long, section long, subtree long, page long, prose boolean"), "html-subtrees")
    templates = stored(templates_of(subtrees), "html-templates")
    # The template's side may split no host's pages; a host with a third of all pages is split by
    # the join instead, since its pages meet rows, not one list.
    found = subtrees.join(templates, ["host", "subtree"]).groupBy("id").agg(
        F.collect_list("subtree").alias("found"))
    page_type, url_type = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    packed = rows.mapInArrow(_packed, f"id long, page_id {page_type}, url {url_type}, html binary")
    return packed.join(found, "id", "left").select("page_id", "url", "html", "found").mapInArrow(
        _texts, f"page_id {page_type}, url {url_type}, text string, n_chars long")
