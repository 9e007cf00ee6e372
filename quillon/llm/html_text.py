"""Main text of web pages by site template removal.

Every page is read as a stream of tags. Each block element's subtree outside article and main gets a hash from its
tag, its text and its children's hashes, whatever its name; Spark counts for each host on how many different articles'
pages a subtree stands (copies of one article count once), and a subtree on ``least`` of them is template: the same
number for every host. A paragraph, heading or list item of under ``BRIEF`` words, which articles without an article
element share as headings, is template on ``share`` of the pages only. A second reading leaves out template subtrees,
and elements that by tag, role or class are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
or reader comments. A class or id tells that by a whole name ("sidebar") or one made of such words and plain ones
("cookie-box"), not by a part ("has-sidebar"). An element that holds the main element, or most of the page's text
outside links, is a wrapper and never left out (``Reading._wrappers``). If a page has article or main elements, the rest
of the page is left out too, and what stands in them depends on the page alone: nothing goes there by count, text
elements don't go by their names, and other elements only if all their names tell it.

The templates of one host are at most its elements / least. The table of all hosts' templates is broadcast if its
counted hosts and hashes are few, and otherwise joined by host, the hosts' pages dealt over salts.

Defined cases: a null or empty page has the empty text; a page without a host has no site and loses no template; broken
and unclosed markup is closed where a browser would close it, or by the end; repeated rows are extracted alike; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import need, written

#: The start of a tag, comment or declaration. What follows a tag's name is read up to its end by TAIL, if it has no further "<" or ">", and else by Reading._tail.
TAG = re.compile(r"<(?:([!?])|(/?)([a-zA-Z][^\s/>]*+))")
TAIL = re.compile(r"(?:[^<>\"']++|\"[^<>\"]*+\"|'[^<>']*+')*+>")
SIGN = re.compile(r"[>\"']")
#: The host of an address after its scheme and user, before its port; one of numbers in its brackets.
HOST = r"^(?:[^:/?#]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "noscript", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "noscript", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr", "picture"}
SPACE_INLINE = {"br"}
LEFT_OUT = {"script", "style", "noscript", "iframe", "template", "head", "nav", "footer", "aside", "form", "button", "select", "textarea", "input", "svg", "canvas", "object", "audio", "video", "map", "menu", "dialog", "title", "datalist", "fieldset", "option", "xmp", "noembed", "noframes"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tooltip", "status"}
TOKENS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promoted", "banner", "sidebar", "sidenav", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "masthead", "footer", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "comment", "comments", "commentlist", "disqus", "respond", "replies", "share", "sharing", "social", "related", "recommended", "widget", "widgets", "toolbar", "pagination", "pager", "skip"}
#: Words that make a name of TOKENS no less clear.
PLAIN = {"", "area", "bar", "block", "bottom", "box", "button", "buttons", "container", "form", "icons", "inner", "left", "link", "links", "list", "message", "posts", "primary", "right", "secondary", "section", "site", "top", "wrap", "wrapper"}
#: Names of what readers add: however long, it isn't the page's own text.
REMARKS = {"comment", "comments", "commentlist", "disqus", "respond", "replies"}
#: Elements left out by their tag that a broken or odd page may wrap its text in: loosely, or only around an article.
LOOSE = {"form", "fieldset", "dialog", "header"}
FIRM = {"nav", "footer", "aside", "menu", "head"}
FIRM_ROLES = {"navigation", "banner", "contentinfo", "complementary", "menu", "menubar", "toolbar"}
KEPT, SOFT, STRONG, REMARK, NEVER = range(5)
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "tr", "dd", "dt", "figcaption", "caption", "article", "main", "body", "html"}
#: Text elements, and how many words they need to be template by count.
TEXTS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote"}
BRIEF = 5
#: What an opening tag closes before it, up to one of the elements that hold it in.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
#: Block elements that end an open paragraph.
END_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}


#: Where Reading counts what an element holds.
HELD = {"p": 2, "article": 3, "main": 4}


def host_of(url: Column) -> Column:
    """The lower-case host of an address, or null."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


@lru_cache(1 << 16)
def named(name: str) -> int:
    """What a whole class name or id says of its element."""
    parts = set(re.split(r"[_\-:]+", name))
    if TOKENS.isdisjoint(parts) or not parts <= TOKENS | PLAIN:
        return KEPT
    return SOFT if REMARKS.isdisjoint(parts) else REMARK


@lru_cache(1 << 16)
def plain(name: str) -> bool:
    """Whether a class name or id is made of telling and plain words alone."""
    return set(re.split(r"[_\-:]+", name)) <= TOKENS | PLAIN


def left_out(tag: str, attributes: str, in_main: bool) -> int:
    """Whether an element is by its tag, role, class or id not main text (over KEPT), and how surely."""
    kind = KEPT
    if tag in LEFT_OUT and not (in_main and tag == "noscript") or tag == "header" and not in_main:
        kind = SOFT if tag in LOOSE else STRONG if tag in FIRM else NEVER
    if kind == NEVER or not attributes or tag in ("html", "body", "main"):
        return kind
    names: list[str] = []
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            kind = max(kind, STRONG)
        elif name == "role" and value in ROLES:
            kind = max(kind, STRONG if value in FIRM_ROLES else SOFT)
        elif name in ("class", "id"):
            names += value.split()
    if in_main and (tag in LEAVES or not all(map(plain, names))):
        return kind
    return max(kind, *map(named, names), KEPT)


class Reading:
    """One pass over a page: its blocks of text and its block elements' subtrees."""

    def __init__(self, page: str | None, templates: frozenset[int] = frozenset(), wrappers: frozenset[int] = frozenset()):
        self.blocks: list[tuple[bool, str]] = []  # within article or main, text
        self.subtrees: list[tuple[bool, int]] = []  # (brief, hash), of those that can be template
        self.has_main = False
        self._text: list[str] = []
        self._stack: list[list] = []  # tag, left out, block, within main, first block, hash parts, main element, place, kind, kind for counting text (the greatest above, a link's as NEVER), held before it
        self._opened = 0
        self._places: dict[str, list[int]] = {}  # of each tag's open elements in the stack
        self._open_blocks: list[int] = []
        self._dead: set[int] = set()  # quotes from which no tag ends
        self._held = [0] * 5  # so far: characters outside links and what is STRONG, or REMARK, and up; paragraphs; articles; main elements
        self._doubted: list[tuple[int, int, list[int]]] = []  # place, kind, held
        self._templates = templates
        self._spared = wrappers
        if page:
            self._read(page)
        while self._stack:
            self._close()
        self._flush()
        if not wrappers and (found := self._wrappers()):
            self.__init__(page, templates, found)

    def _wrappers(self) -> frozenset[int]:
        """The places of elements not to leave out: those around the main element; loose ones with most of the text and a paragraph or article; and others, but for remarks, with most of the text and an article."""
        loose, firm = self._held[:2]
        return frozenset(
            place
            for place, kind, (a, b, paragraphs, articles, mains) in self._doubted
            if mains or kind == SOFT and (paragraphs or articles) and 2 * a > loose or kind < REMARK and articles and 2 * b > firm
        )

    def text(self) -> str:
        return "\n\n".join(t for inside, t in self.blocks if inside or not self.has_main)

    def _within(self) -> bool:
        return bool(self._stack) and self._stack[-1][3]

    def _out(self) -> bool:
        return bool(self._stack) and self._stack[-1][1]

    def _flush(self) -> None:
        if self._text:
            block = " ".join("".join(self._text).split())
            self._text.clear()
            if block:
                self.blocks.append((self._within(), block))

    def _say(self, raw: str) -> None:
        if not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if self._stack:
            self._stack[-1][5].append(text)
        uncounted = self._stack[-1][9] if self._stack else KEPT
        if uncounted < REMARK:
            size = len(text.strip())
            self._held[1] += size
            if uncounted < STRONG:
                self._held[0] += size
        if not self._out():
            self._text.append(text)

    def _open(self, tag: str, attributes: str) -> None:
        place, kind = self._opened, left_out(tag, attributes, self._within())
        self._opened += 1
        above = self._stack[-1][9] if self._stack else KEPT
        uncounted = max(above, NEVER if tag == "a" else kind)
        out = self._out() or kind > KEPT and place not in self._spared
        block = tag not in INLINE
        if block:
            self._flush()
        main = tag in ("article", "main") and not out
        self.has_main |= main
        self._places.setdefault(tag, []).append(len(self._stack))
        if block:
            self._open_blocks.append(len(self._stack))
        self._stack.append([tag, out, block, main or self._within(), len(self.blocks), [tag], main, place, kind, uncounted, self._held[:] if KEPT < kind < NEVER else None])
        if tag in HELD and uncounted < NEVER:
            self._held[HELD[tag]] += 1

    def _close(self) -> None:
        tag, out, block, within, first, parts, main, place, kind, _, held = self._stack[-1]
        if block and not out:
            self._flush()
        self._places[tag].pop()
        if block:
            self._open_blocks.pop()
        h = xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) >> 1
        self._stack.pop()
        if held:
            self._doubted.append((place, kind, [y - x for x, y in zip(held, self._held, strict=True)]))
        if self._stack:
            self._stack[-1][5].append(f"\x01{h:x}")
        # Whether it can be template: a block outside the article with more in it than its tag.
        if block and not within and len(parts) > 1 and tag not in ("html", "body", "head"):
            words = " ".join(parts[1:] if out else [t for _, t in self.blocks[first : first + BRIEF]]).split(None, BRIEF)
            self.subtrees.append((tag in TEXTS and len(words) < BRIEF, h))
            if h in self._templates:
                del self.blocks[first:]

    def _tail(self, page: str, at: int) -> int:
        """Where the tag ends whose name ends at ``at``: after the first ">" outside quotes, or, if a quote stays open to the end of the page, the first ">" of all; 0 if there is none.

        Quotes from which a search failed are remembered, so that all searches of a page together read it a few times.
        """
        if m := TAIL.match(page, at):
            return m.end()
        passed, p = [], at
        while p <= self._last[">"] and (m := SIGN.search(page, p)):
            if m[0] == ">":
                return m.end()
            if m.start() in self._dead or m.end() > self._last[m[0]]:
                break
            passed.append(m.start())
            p = page.find(m[0], m.end()) + 1
        self._dead.update(passed)
        return page.find(">", at) + 1 if at <= self._last[">"] else 0

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        self._last = {c: page.rfind(c) for c in ">\"'"}
        said = 0
        while at < n:
            m = TAG.search(page, at)
            if not m:
                break
            if m[1]:
                closing = "-->" if page.startswith("<!--", m.start()) else ">"
                end = page.find(closing, m.start() + (4 if closing == "-->" else 2))
                end = n if end < 0 else end + len(closing)
            else:
                end = self._tail(page, m.end())
                if not end:
                    at = m.end()
                    continue
            self._say(page[said : m.start()])
            said = at = end
            if m[1]:
                continue
            tag = m[3].lower()
            if m[2]:
                self._end(tag)
                continue
            if tag in SPACE_INLINE:
                self._say(" ")
                continue
            if tag in END_P:
                self._end_within("p", {"article", "body", "button", "td", "th", "table", "html"})
            if tag in CLOSES:
                shut, held = CLOSES[tag]
                for x in shut:
                    self._end_within(x, held)
            attributes = page[m.end() : end - 1]
            self._open(tag, attributes)
            if tag in VOID or attributes.endswith("/") and tag not in RAW:
                self._close()
            elif tag in RAW and not (tag == "noscript" and self._within()):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                said = at = close.end() if close else n
                self._close()
        self._say(page[said:])

    def _end_from(self, place: int) -> None:
        while len(self._stack) > place:
            self._close()

    def _end_within(self, tag: str, held: set[str]) -> None:
        """Closes the nearest open element of a tag, unless one that holds it in comes first."""
        places = self._places.get(tag)
        if places and all(places[-1] > x[-1] for h in held if (x := self._places.get(h))):
            self._end_from(places[-1])

    def _end(self, tag: str) -> None:
        """Closes the nearest open element of a tag; an inline end tag doesn't close a block."""
        places = self._places.get(tag)
        if places and not (tag in INLINE and self._open_blocks and self._open_blocks[-1] > places[-1]):
            self._end_from(places[-1])


_SUBTREE = T.StructType([T.StructField("host", T.StringType()), T.StructField("brief", T.BooleanType()), T.StructField("h", T.LongType()), T.StructField("content", T.LongType())])
_TEXT = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: set[tuple] = set()
        for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            r = Reading(page.as_py())
            content = xxhash.xxh3_64_intdigest(r.text().encode("utf-8", "surrogatepass")) >> 1
            rows.add((host, None, None, content))
            rows.update((host, brief, h, content) for brief, h in r.subtrees)
        cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=_SUBTREE.names)


def templates(pages: DataFrame, share: float = 0.5, least: int = 3) -> DataFrame:
    """(host, hashes): each host's template subtrees."""
    sites = need(pages, url=T.StringType(), html=T.StringType()).select(host_of(F.col("url")).alias("host"), "html").where("host is not null")
    seen = sites.mapInArrow(_hashed, _SUBTREE).distinct()
    counted = seen.groupBy("host", "brief", "h").agg(F.count("*").alias("n"))
    counted = written(counted.where((F.col("n") >= least) | F.col("h").isNull()), "html-subtrees")
    hosts = counted.where("h is null").select("host", F.col("n").alias("pages"))
    found = counted.where("h is not null").join(hosts, "host").where(~F.col("brief") | (F.col("n") >= share * F.col("pages")))
    return found.groupBy("host").agg(F.collect_set("h").alias("hashes"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        known: dict[str | None, frozenset[int]] = {}
        texts = []
        for i, (page, host) in enumerate(zip(b.column(2), b.column(3).to_pylist(), strict=True)):
            if host not in known:
                known[host] = frozenset(b.column(4)[i].as_py() or ())
            texts.append(Reading(page.as_py(), known[host]).text())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=_TEXT.names)


def extract(pages: DataFrame, share: float = 0.5, least: int = 3, broadcast_hosts: int = 10_000, salts: int = 64) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars."""
    rows = need(pages, page_id=T.LongType(), url=T.StringType(), html=T.StringType())
    known = written(templates(rows, share, least), "html-templates")
    rows = rows.withColumn("host", host_of(F.col("url")))
    n_hosts, n_hashes = known.agg(F.count("*"), F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()
    few = n_hosts <= broadcast_hosts and n_hashes <= 100 * broadcast_hosts
    if few:
        met = rows.join(F.broadcast(known), "host", "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
        met = rows.join(known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["host", "salt"], "left")
    return met.select("page_id", "url", "html", "host", "hashes").mapInArrow(_extracted, _TEXT)
