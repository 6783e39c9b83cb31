"""Main text of web pages by line-block distribution.

Markup is stripped to lines: one per block element, with empty lines where elements begin and end, two for those that
hold others. Lines inside menus, headers, footers, sidebars, notices, adverts, forms and comments are left out. The
lengths of the text outside links are summed over a sliding window of lines. A surge is where the sum rises from nothing
and reaches SURGE before the dive, where it falls back to nothing; from the first surge to the last dive the text is
kept, whole, however short its lines, with the headlines right before it. What does not surge, a line of navigation or
of contacts that no markup names, stays outside, and so does a span that is mostly links. On a page where nothing
surges, all spans are kept. An ``article`` (or ``main``) element bounds the lines where there is one, and then the sum
need not reach anything; a nested article belongs to the one around it, and of several those go that are mostly links.
Words of class and id alone do not exclude an article around which they stand, nor all text of a page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

#: Lines in a window, fixed by the method; a gap of as many empty lines ends a block of text. Characters of a surge.
WINDOW, SURGE = 3, 80
#: An article or span with more than this share of its text in links is a list of links beside the main text.
LINKS = 0.5

#: Elements whose content is no text.
SILENT = frozenset("script style noscript template svg math canvas iframe object embed video audio map select textarea head title".split())
#: Elements that hold what is not the article.
ASIDE = frozenset("nav aside form footer menu dialog button fieldset".split())
#: Elements that begin and end a block.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Those that hold other blocks: their edges are two lines.
HOLDER = frozenset("article aside blockquote body center details dialog div dl fieldset figure footer form header html main menu nav ol section table ul".split())
HEADLINES = ("h1", "h2", "h3", "h4", "h5", "h6")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that tell what is not the article.
NOT_MAIN = frozenset("ad ads adv advert adverts advertisement advertisements advertising adbox banner banners sponsor sponsored sponsors promo promos promotion nav navbar navigation navigate menu menus breadcrumb breadcrumbs header masthead footer sidebar sidebars aside rail cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist discussion disqus replies reply respond widget widgets pagination pager skip contentinfo complementary search toolbar copyright".split())
#: Those of them that name what can hold articles of its own beside the main text.
BESIDE = frozenset("ad ads adv advert adverts advertisement advertisements advertising adbox sponsor sponsored sponsors promo promos promotion footer sidebar sidebars aside rail related recommended recommendations comment comments commentlist discussion disqus replies reply respond widget widgets".split())
#: Beside one of these a word of layout says how a page is laid out, not what an element holds: with-sidebar, nav-fixed.
LAYOUT = frozenset("with without no has have hide hidden show fixed sticky open closed collapsed enabled disabled active layout".split())
#: Inside an article a class counts only if each of its words is one of NOT_MAIN or of these: related-posts, not related-work.
PLAIN = frozenset("a area article articles author bar bars block body bottom box button buttons card cards container content element entry footer form group holder icon icons inline inner inside item items js left line link links list main media module outer page panel post posts primary right row section secondary single site slot small stories story tools top unit wrap wrapper".split())
#: Boxes that are part of an article when they stand in it.
IN_ARTICLE = frozenset("header alert notice notices".split())
#: How an element takes part: as main text, not unless it is around an article, not by its class, not at all.
MAIN, AROUND, CLASSED, NEVER = range(4)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z]+", re.I)
_SPACE = re.compile(r"\s+")
#: Elements that an opening tag closes when it is inside one of the same group.
CLOSES = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dd": frozenset({"dd", "dt"}), "dt": frozenset({"dd", "dt"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "tr": frozenset({"tr", "td", "th"}), "option": frozenset({"option"})}
SCOPE = frozenset("ul ol dl table article main section div nav aside header footer form body".split())


def _part(tag: str, attrs: str, in_article: bool, classes: bool) -> int:
    if tag in ASIDE or (tag == "header" and not in_article):
        return NEVER
    if not attrs or tag in ("html", "body", "main"):
        return MAIN
    out = MAIN
    for name, a, b, c in _NAMED.findall(attrs):
        value, name = a or b or c, name.lower()
        if tag != "article":
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                return NEVER
            if name == "role" and value.lower() in ROLES:
                return NEVER
        if classes and name in ("class", "id") and value:
            for part in value.split():
                split = {w.lower() for w in _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", part))}
                said = split & NOT_MAIN
                if not said or split & LAYOUT:
                    continue
                if in_article or tag == "article":
                    if said <= IN_ARTICLE or not split <= NOT_MAIN | PLAIN or (tag == "article" and not said & BESIDE):
                        continue
                out = max(out, CLASSED if said & BESIDE else AROUND)
    return out


class Line(NamedTuple):
    """A block's text, whether it may be main text, the number of the outermost article element around it or 0, its
    characters but spaces, those in links, the line ends before it, and whether it is a headline."""

    text: str
    ok: bool
    article: int
    size: int
    links: int
    gap: int
    headline: bool


class _Open:
    """The open elements, with the places of each name, of scopes and of blocks, so that nothing is ever searched."""

    def __init__(self):
        self.stack: list[tuple[str, int, int, bool]] = []  # name, part of it and those around it, article, inside a link
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.blocks: list[int] = []

    def top(self) -> tuple[str, int, int, bool]:
        return self.stack[-1] if self.stack else ("", MAIN, 0, False)

    def push(self, tag: str, part: int, article: int, link: bool) -> None:
        k = len(self.stack)
        self.stack.append((tag, part, article, link))
        self.at.setdefault(tag, []).append(k)
        if tag in SCOPE:
            self.scopes.append(k)
        if tag in BLOCK:
            self.blocks.append(k)

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            tag = self.stack.pop()[0]
            self.at[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()
            if tag in BLOCK:
                self.blocks.pop()

    def last(self, names, through: bool = False) -> int | None:
        """The place of the innermost element of these names that is open in this scope, or in any if ``through``."""
        k = -1
        for n in names:
            places = self.at.get(n)
            if places and places[-1] > k:
                k = places[-1]
        return k if k >= 0 and (through or not self.scopes or self.scopes[-1] <= k) else None


class _Ends:
    """Where elements without text end; each is searched on from where it was last found, so a page is read once a name."""

    def __init__(self, page: str):
        self.page, self.found = page, {}

    def find(self, pattern: str, at: int):
        if pattern not in self.found or (self.found[pattern] and self.found[pattern].start() < at):
            self.found[pattern] = re.compile(pattern, re.I).search(self.page, at)
        return self.found[pattern]


def lines(page: str, classes: bool = True) -> list[Line]:
    """The blocks of a page with text, in page order."""
    out: list[Line] = []
    elements, ends = _Open(), _Ends(page)
    held: list[str] = []
    linked: list[str] = []
    n_articles = at = gap = 0

    def hold(text: str):
        held.append(text)
        if elements.top()[3]:
            linked.append(text)

    def flush():
        nonlocal gap
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            links = len(_SPACE.sub("", html.unescape("".join(linked)))) if linked else 0
            held.clear()
            linked.clear()
            if text:
                _, part, article, _ = elements.top()
                out.append(Line(text, part == MAIN, article, len(text.replace(" ", "")), links, gap, any(elements.at.get(h) for h in HEADLINES)))
                if part == MAIN:
                    gap = 0

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            hold(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                hold(html.escape(m[0][9:-3]))
            continue
        if m[1]:  # closing
            if tag in BLOCK:
                flush()
            k = elements.last((tag,), tag in SCOPE)
            if k is not None:
                if elements.blocks and elements.blocks[-1] >= k:
                    flush()
                if tag in BLOCK and elements.stack[k][1] == MAIN:
                    gap += 1 + (tag in HOLDER)
                elements.cut(k)
            continue
        if tag in SILENT:
            if tag in VOID or m[0].endswith("/>"):
                continue
            end = ends.find(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", at)
            if tag == "head" and (body := ends.find(r"<body\b", at)) and (not end or body.start() < end.start()):
                at = body.start()
            else:
                at = end.end() if end else (len(page) if tag != "head" else at)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in VOID:
            if tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            flush()
        closes = CLOSES.get(tag, ("p",) if tag in BLOCK else ())  # a block closes an open paragraph
        k = elements.last(closes)
        if k is not None:
            elements.cut(k)
        if m[0].endswith("/>") and tag not in BLOCK:
            continue
        _, part, article, link = elements.top()
        part = max(part, _part(tag, m[3] or "", article > 0, classes))
        if tag in ("article", "main"):
            part = MAIN if part == AROUND else part
            if part == MAIN and not article:
                n_articles += 1
                article = n_articles
        if tag in BLOCK and part == MAIN:
            gap += 1 + (tag in HOLDER)
        elements.push(tag, part, article, link or tag == "a")
    if at < len(page):
        hold(page[at:])
    flush()
    return out


def main_text(page: str) -> str:
    """The article's blocks, joined by line feeds; empty if there is no text."""
    found = lines(page)
    return "\n".join(_main(found) or (_main(lines(page, classes=False)) if found else []))


def _main(found: list[Line]) -> list[str]:
    found = [x for x in found if x.ok]
    inside: dict[int, list[int]] = {}
    for x in found:
        if x.article:
            part = inside.setdefault(x.article, [0, 0])
            part[0] += x.size
            part[1] += x.links
    if inside:
        whole = {k for k, (n, links) in inside.items() if links <= LINKS * n} or set(inside)
        return [x.text for x in found if x.article in whole]
    spans = surges([x.size - x.links for x in found], [x.gap for x in found])
    parts = [(i, j, peak) for i, j, peak in spans if sum(x.links for x in found[i:j]) <= LINKS * sum(x.size for x in found[i:j])]
    high = [k for k, (_, _, peak) in enumerate(parts) if peak >= SURGE]
    if high:
        parts = parts[high[0] : high[-1] + 1]
        begin = parts[0][0]
        while begin and found[begin - 1].headline and not found[begin - 1].links:
            begin -= 1
        parts[0] = (begin, *parts[0][1:])
    return [x.text for i, j, _ in parts for x in found[i:j]] or [x.text for x in found]


def surges(sizes: list[int], gaps: list[int]) -> list[tuple[int, int, int]]:
    """(first line, line after the last, greatest sum over WINDOW lines) of each run of lines with no dive inside.

    ``gaps`` are the line ends before each line: all but the first are empty lines.
    """
    out: list[tuple[int, int, int]] = []
    window: list[int] = []
    start, last, peak = None, 0, 0
    for i, (size, gap) in enumerate(zip(sizes, gaps, strict=True)):
        for n in [0] * min(max(gap - 1, 0), WINDOW) + [size]:
            window = [*window[1 - WINDOW :], n]
            if not sum(window) and start is not None:
                out.append((start, last + 1, peak))
                start = None
        if size:
            start = i if start is None else start
            last = i
        if start is not None:
            peak = max(peak if start != i else 0, sum(window))
    if start is not None:
        out.append((start, last + 1, peak))
    return out


def extract(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (page_id, url, text, n_chars): the main text of every whole page, and its code points.

    Null and empty pages have an empty text; repeated rows each give a row; other columns are ignored; an empty table
    gives an empty result. Broken markup is read as browsers do, roughly, and never fails; very long pages are read
    whole, in linear time.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = [main_text(p) if p else "" for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
