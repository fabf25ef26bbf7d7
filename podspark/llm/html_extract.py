"""Main text of web pages by site template removal.

Pass 1 hashes the element subtrees of every page (tag, class, id, text and children, bottom up), in its
article if it marks one, else everywhere.  Spark counts, per host, in how many different articles or pages
a subtree stands.  Pass 2 reads every page again and deletes the subtrees that recur on many pages of
their host: containers outside an article from ``MIN_SHARE`` of the pages on; what holds running text
(paragraphs, headings, list items) and everything in an article from ``TEXT_SHARE`` on, since articles
may be copied, wholly or nearly, and quote each other.  Copies of one article or page count once.
An article itself is never a template.

After the counts, elements go whose tag, role, class or id says that they are no content: menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments; and of a page
that marks its article (``article`` or ``main``) what stands outside.  A name decides by itself if all its words
are such words or words of layout (``ad-box``); if only some are (``social-science``), the links in the element
decide.  A form that holds more than half of the text of its page is no form but the page.

Defined results: null or empty html gives an empty text; broken markup is read as far as it goes
(open elements end with the page, a tag without its ``>`` is text); repeated pages get the same text; pages without a host share
one; an empty table gives an empty result; other input columns are dropped; nothing is capped, and a
page is read in time in proportion to its length however deep its elements are nested and however
many of its tags are left open.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podspark.llm.arrow_text import slices
from podspark.llm.common import fresh, stored

#: A subtree is a template from this number of different pages or articles of a host on, and from this share of them.
MIN_PAGES = 5
MIN_SHARE = 0.02
#: The share for running text and in articles: more than any group of near copies is taken to have.
TEXT_SHARE = 0.4
#: Recurring subtrees are sent to all executors only up to this number (about 100 bytes each).
BROADCAST_SUBTREES = 100_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/><]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
_OPENED = re.compile(r"</?[A-Za-z][^\s/><]*+")
_ATTRIBUTE = re.compile(r"(?<![A-Za-z-])([A-Za-z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr script style noscript template".split())
DROPPED = frozenset("head script style noscript template nav footer aside form button input select textarea option datalist iframe object embed svg canvas audio video map dialog menu title xmp noembed noframes".split())
CONTENT = frozenset("article main".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of class and id that mark what is no content.
DROPPED_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus respond replies related recommended pagination pager".split()
)
#: Words of comments decide in any name; words of layout say nothing in a name.
COMMENTS = frozenset("comment comments disqus respond replies".split())
LAYOUT = frozenset("area bar block body bottom box button buttons col container content inner item items left link links list main outer page panel posts primary right row secondary section site slot text top unit wrap wrapper".split())
#: A name of mixed words decides if links hold at least this share of the element's characters.
LINK_SHARE = 1 / 3
#: In an article a header holds its title, and these names say nothing about it.
IN_ARTICLE = frozenset("header masthead banner".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption".split())
_BOUNDS = frozenset("ul ol dl table select div article section".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HIDDEN = frozenset("head script style noscript template title".split())
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
#: Tells hashes of running text from those of containers.
_OF_TEXT = 0x5BD1E9955BD1E995
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(source)}


def _dropped(tag: str, found: dict[str, str], source: str, inside: bool) -> bool | None:
    """Whether tag, role or name say that an element is no content; None if its links decide."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not source or tag in ("html", "body") or tag in CONTENT and "comment" not in source.lower():
        return False
    if found.get("role", "").lower() in DROPPED_ROLES or found.get("aria-hidden") == "true" or re.search(r"\shidden(?=[\s/=]|$)", source) or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    listed = DROPPED_NAMES - IN_ARTICLE if inside else DROPPED_NAMES
    verdict: bool | None = False
    for name in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
        words = {w for w in re.split(r"[^a-z]+", name) if w}
        if words & listed:
            if words & COMMENTS or words <= DROPPED_NAMES | LAYOUT:
                return True
            verdict = None
    return verdict


class _Closing:
    """Whether a tag is ever closed, that is, whether a ``>`` outside quotes follows its name.

    Found for all places of a page in one pass from its end, so that tags left open need no scan each.
    """

    def __init__(self, page: str):
        self.places = [m.start() for m in re.finditer(r"[>\"']", page)]
        self.closed = [False] * (len(self.places) + 1)
        later: dict[str, int] = {}
        for i in range(len(self.places) - 1, -1, -1):
            sign = page[self.places[i]]
            self.closed[i] = sign == ">" or self.closed[later.get(sign, i) + 1]
            later[sign] = i

    def __call__(self, name_end: int) -> bool:
        return self.closed[bisect_left(self.places, name_end)]


class _Element:
    __slots__ = ("block", "blocks", "bound", "content", "digest", "dropped", "from_chars", "from_hash", "from_linked", "from_piece", "inside", "number", "tag", "under")

    def __init__(self, tag: str, dropped: bool | None, from_piece: int, from_hash: int, parent: _Element | None, place: int, marks: bool, digest):
        self.tag, self.dropped, self.from_piece, self.from_hash, self.digest = tag, dropped, from_piece, from_hash, digest
        self.from_chars = self.from_linked = 0
        self.number = -1  # of a form
        self.content = marks and tag in CONTENT  # or holds such an element
        self.inside = parent is not None and (parent.inside or marks and parent.tag in CONTENT)
        self.under = parent is not None and (parent.under or parent.dropped is True)
        # Of the stack up to here: elements that are not inline, the last of them, and the last that bounds a list or table.
        inline = tag in INLINE
        self.blocks = (parent.blocks if parent else 0) + (not inline)
        self.block = (parent.block if parent else -1) if inline else place
        self.bound = place if tag in _BOUNDS else parent.bound if parent else -1


class Subtrees(NamedTuple):
    """Hashes of the subtrees of one article, or of one page without an article: ``containers``, and ``texts`` that need the higher share."""

    unit: int
    containers: list[int]
    texts: list[int]


def read_page(page: str, doomed: frozenset[int] = frozenset(), marks: bool = True, spared: int = -1) -> tuple[list[Subtrees], str]:
    """The subtrees by which templates are found, and the text that is left without ``doomed`` subtrees.

    Pieces of text pile up as elements open; an element that is dropped or doomed takes its own
    pieces with it when it closes, so one pass does both.  Without ``marks`` no tag, role or name
    decides anything: of a page only what the counts doom is deleted (and what is never shown).
    The form of number ``spared`` is an element like others: a page whose text is mostly in a form is read again so.
    """
    pieces: list[str | None] = []  # None ends a block
    article: list[str | None] = []
    has_article = False
    stack: list[_Element] = []
    places: dict[str, list[int]] = {}
    hashes: list[tuple[int, bool]] = []
    articles: list[Subtrees] = []
    chars = linked = forms = 0
    largest, large_form = 0, -1
    closing: _Closing | None = None

    def listed(unit: int, found: list[tuple[int, bool]]) -> Subtrees:
        return Subtrees(unit, [v for v, t in found if not t], [v for v, t in found if t])

    def close() -> None:
        nonlocal has_article, largest, large_form
        e = stack.pop()
        places[e.tag].pop()
        if e.number >= 0 and chars - e.from_chars >= largest:
            largest, large_form = chars - e.from_chars, e.number
        parent = stack[-1] if stack else None
        if e.content and parent:
            parent.content = True
        if e.dropped is None:
            e.dropped = not e.content and linked - e.from_linked >= LINK_SHARE * (chars - e.from_chars)
        value = e.digest.intdigest()
        if parent:
            parent.digest.update(value.to_bytes(8, "big"))
        value -= 1 << 63
        container = marks and e.tag in CONTENT and not e.inside
        if not e.content and e.tag not in ("html", "body"):
            of_text = e.inside or e.tag in TEXT or e.tag in INLINE
            if of_text:
                value ^= _OF_TEXT
            hashes.append((value, of_text))
            e.dropped |= value in doomed
        if e.tag not in INLINE:
            pieces.append(None)
        if e.dropped:
            del pieces[e.from_piece :]
            if e.tag not in INLINE:
                pieces.append(None)
        elif container and not e.under:
            has_article = True
            article.extend(pieces[e.from_piece :])
            articles.append(listed(value, hashes[e.from_hash :]))

    def text(raw: str) -> None:
        nonlocal chars, linked
        if raw:
            if not (stack and stack[-1].tag in RAW):
                size = len(raw) if not raw.isspace() else 0
                chars += size
                linked += size if places.get("a") else 0
            pieces.append(entities.unescape(raw))
            if stack:
                stack[-1].digest.update(" ".join(raw.split()).encode("utf-8", "surrogatepass"))

    at, n = 0, len(page)
    while at < n:
        m, start = None, page.find("<", at)
        while start >= 0:
            opened = _OPENED.match(page, start) if closing else None
            m = None if opened and not closing(opened.end()) else _TOKEN.match(page, start)
            if m:
                break
            if not closing and _OPENED.match(page, start):
                closing = _Closing(page)
            start = page.find("<", start + 1)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            text(entities.escape(m[1], False))
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            if tag == "br":
                pieces.append(" ")
            elif places.get(tag):
                # An inline end tag does not end the blocks around it.
                if tag in INLINE and stack[-1].blocks > stack[places[tag][-1]].blocks:
                    continue
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag in VOID:
            pieces.append(" " if tag == "br" else None if tag == "hr" else "")
            continue
        if tag in _CLOSES_P and stack and stack[-1].block >= 0 and stack[stack[-1].block].tag == "p":
            for _ in range(len(stack) - stack[-1].block):
                close()
        for other in _SAME.get(tag, ()):
            if stack and places.get(other) and places[other][-1] > stack[-1].bound:
                for _ in range(len(stack) - places[other][-1]):
                    close()
        found = _attributes(m[4])
        if tag not in INLINE:
            pieces.append(None)
        parent = stack[-1] if stack else None
        e = _Element(tag, False, len(pieces), len(hashes), parent, len(stack), marks, xxhash.xxh64(f"{tag}|{found.get('class', '')}|{found.get('id', '')}"))
        e.dropped = _dropped(tag, found, m[4], e.inside) if marks else tag in HIDDEN
        e.from_chars, e.from_linked = chars, linked
        if marks and tag == "form":
            e.number, forms = forms, forms + 1
            if e.number == spared:
                e.dropped, e.number = False, -1
        places.setdefault(tag, []).append(len(stack))
        stack.append(e)
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            text(page[at : end.start() if end else n])
            at = end.end() if end else n
            close()
        elif m[4].endswith("/") and tag not in INLINE and tag not in _CLOSES_P:
            close()
    while stack:
        close()
    if spared < 0 and 2 * largest > chars:
        return read_page(page, doomed, marks, large_form)

    blocks, block = [], []
    for piece in [*(article if has_article else pieces), None]:
        if piece is not None:
            block.append(piece)
        elif block:
            line = " ".join("".join(block).split())
            if line:
                blocks.append(line)
            block = []
    return articles if has_article else [listed(xxhash.xxh64_intdigest(page) - (1 << 63), hashes)], "\n".join(blocks)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def recurring(pages: DataFrame, html: str = "html", url: str = "url", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, text_share: float = TEXT_SHARE, marks: bool = True) -> DataFrame:
    """Subtrees that stand on many different pages of a host: ``host``, ``subtree``."""
    rows = pages.select(_host(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html", 4 << 20):
            out: list[tuple] = []
            for host, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                for unit, *kinds in read_page(source, marks=marks)[0]:
                    for kind, found in enumerate(kinds):
                        out.append((host, None, kind == 1, unit))  # a row without a subtree counts the page or article itself
                        out += [(host, value, kind == 1, unit) for value in set(found)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], ["host", "subtree", "text", "unit"])

    # The number of different units by distinct rows first, so a hot host is spread over all tasks.
    seen = rows.mapInArrow(subtrees, "host string, subtree bigint, text boolean, unit bigint").distinct().groupBy("host", "text", "subtree").agg(F.count("*").alias("n"))
    seen = stored(seen.filter((F.col("n") >= min_pages) | F.col("subtree").isNull()))
    totals = seen.filter("subtree is null").select("host", "text", F.col("n").alias("total"))
    share = F.when(F.col("text"), text_share).otherwise(min_share)
    return seen.filter("subtree is not null").join(totals, ["host", "text"]).filter(F.col("n") >= F.col("total") * share).select("host", "subtree")


def extract(
    pages: DataFrame, keep: list[str], html: str = "html", url: str = "url", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, text_share: float = TEXT_SHARE, marks: bool = True
) -> DataFrame:
    """The columns ``keep`` of every page with its main ``text``."""
    host, source, doomed = fresh(pages, "_host", "_html", "_doomed")
    templates = stored(recurring(pages, html, url, min_pages, min_share, text_share, marks))
    rows = pages.select(*keep, _host(F.col(url)).alias(host), F.coalesce(F.col(html), F.lit("")).alias(source))
    few = templates.limit(BROADCAST_SUBTREES + 1).count() <= BROADCAST_SUBTREES
    shared = None
    if few:
        by_host: dict[str, set[int]] = {}
        for r in templates.collect():
            by_host.setdefault(r.host, set()).add(r.subtree)
        shared = pages.sparkSession.sparkContext.broadcast({k: frozenset(v) for k, v in by_host.items()})
        rows = rows.withColumn(doomed, F.lit(None).cast("array<bigint>"))
    else:
        rows = rows.join(templates.groupBy(F.col("host").alias(host)).agg(F.collect_set("subtree").alias(doomed)), host, "left")
    rows = rows.select(*keep, host, source, doomed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, source, 4 << 20):
            texts = []
            for of, page, gone in zip(*(part.column(c).to_pylist() for c in (host, source, doomed)), strict=True):
                texts.append(read_page(page, shared.value.get(of, frozenset()) if shared else frozenset(gone or ()), marks)[1])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return rows.mapInArrow(run, rows.select(*keep).schema.add("text", "string"))
