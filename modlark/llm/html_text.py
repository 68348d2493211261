"""Main text of web pages from flat text blocks.

A page is cut into blocks: runs of text between block-level tags.  Each block
is described by its words and link density, those of the blocks before and
after it, and the kind of region that it stands in, as told by the names of
the elements around it.  A decision tree, grown from the small labelled table
below, tells main text from the rest.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose text is no part of the page's: those whose tags inside count for nothing, and the others.
_RAW = frozenset("script style title textarea".split())
_DROPPED = frozenset("noscript template svg annotation annotation-xml iframe object select button datalist audio video canvas map".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^<>]*>|</?[a-zA-Z][^<>]*>",
    re.S | re.I,
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _RAW}
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
#: Parts of forms, whose text says nothing of what a form holds.
_CONTROLS = frozenset("input select textarea button label legend option".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_REST_TAGS = frozenset("nav header footer aside form menu head dialog".split())
_MAIN_TAGS = frozenset("article main".split())
_SPLIT = re.compile(r"[-_]+")
# Words in class, id and role names of elements that hold no main text.
_REST_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts adsense banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies "
    "disqus footer gdpr hidden login masthead menu menus meta modal nav navbar navigation newsletter notice notices pager pagination "
    "popup promo promotion promoted recommended related replies reply respond rss share sharing sidebar signup skip social sponsor sponsored subscribe "
    "tagcloud tags teaser advertorial".split()
)
# Words that name such elements, and parts of an article as well: within one they are a feature among others.
_DOUBTFUL_NAMES = frozenset("alert complementary contentinfo copyright disclaimer discussion feedback legal links responses reviews search toolbar topbar warning widget widgets".split())
# Names of elements that hold no main text elsewhere; within an article they are a feature as well.
_WEAK_NAMES = frozenset("banner login masthead menu menus navigation pager tags teaser".split())
# Of these, the names of what readers write: an article among them is a comment.
_TALK_NAMES = frozenset("comment comments commentlist discussion disqus replies reply respond responses".split())
# Words that follow such a name without changing it, and words before which it tells of a state or topic.
_PLACES = frozenset("area bar block box bottom buttons container group icons inner item items left links list posts primary right secondary slot top unit wrap wrapper".split())
_STATES = frozenset("has no with without is not hide overflow tag category cat topic supports enable disable".split())
#: ``DOUBTFUL``: within the main text, in an element with a doubtful name.
UNKNOWN, DOUBTFUL, MAIN, REST = 0.0, 0.5, 1.0, -1.0


@dataclass
class Block:
    text: str
    words: int
    linked: int
    region: float


@dataclass(frozen=True)
class Names:
    """What an element's class, id, role and style tell of it."""

    rest: bool = False
    doubtful: bool = False
    #: All that tells of a rest is in names of parts of articles too.
    weak: bool = False
    #: A class is such a name as a whole.
    plainly: bool = False
    talk: bool = False
    main: bool = False
    role_main: bool = False
    hidden: bool = False


@lru_cache(maxsize=4096)
def names(attrs: str) -> Names:
    """Whole names count, and ends of them, but for those of a state or topic:
    ``cookie-notice`` and ``comments-area``, not ``has-sidebar`` or ``related-work``."""
    rest = doubtful = strong = plainly = talk = main = role_main = hidden = False
    for m in _ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        hidden |= key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value) is not None)
        if key not in ("class", "id", "role"):
            continue
        role_main |= key == "role" and value.strip() == "main"
        shown = re.search(r"\w:(?:block|flex|grid|inline|table|contents)", value) is not None  # hidden on some screens alone
        for token in value.split():
            if shown and token == "hidden":
                continue
            parts = [p for p in _SPLIT.split(token) if p]
            main |= "main" in parts
            while len(parts) > 1 and (parts[-1] in _PLACES or parts[-1].isdigit()):
                parts.pop()
            if not parts or (len(parts) > 1 and (parts[0] in _STATES or parts[-1] == "hidden")):
                continue
            unsure = parts[-1] in _DOUBTFUL_NAMES
            plainly |= token in _REST_NAMES or token in _DOUBTFUL_NAMES
            told = parts[-1] in _REST_NAMES or (unsure and key == "role")
            rest |= told
            strong |= told and parts[-1] not in _WEAK_NAMES
            doubtful |= unsure
            talk |= parts[-1] in _TALK_NAMES or parts[0] == "comment"
    return Names(rest, doubtful, rest and not strong, plainly, talk, main, role_main, hidden)


def _region(tag: str, attrs: str, outer: float, holds: bool = False) -> float:
    """The region inside an element: rest stays rest; a page header within the
    main text is a part of it, and a doubtful name there leaves open what its
    blocks are.  What ``holds`` an article isn't rest by name."""
    if outer == REST or tag in ("html", "body"):
        return outer
    inside = outer in (MAIN, DOUBTFUL)
    if tag in _REST_TAGS and not (tag == "header" and inside) and not (tag == "form" and holds):
        return REST
    told = names(attrs)
    if told.hidden or (not holds and ((told.rest and not (inside and told.weak)) or (told.doubtful and not inside))):
        return REST
    if tag in _MAIN_TAGS or told.main:
        return MAIN
    return DOUBTFUL if inside and (told.doubtful or told.rest) and not holds else outer


@dataclass
class Tag:
    """A tag, comment (no ``name``), or element without text of its own (" "), from ``start`` to ``end``."""

    start: int
    end: int
    name: str = ""
    closes: bool = False
    attrs: str = ""
    #: Of a dropped element that is closed: the number of its end tag.
    until: int = -1
    #: It is or has an article or main element.
    holds: bool = False


def tags(page: str) -> list[Tag]:
    """The page's tags, in order.  Script, style, title and textarea run to their
    end tag or the end of the page, and other dropped elements to their own end
    tag: where there is none, only the tag is dropped."""
    out: list[Tag] = []
    opened: dict[str, list[int]] = {}
    at = 0
    while m := _TOKEN.search(page, at):
        start, at = m.span()
        name, closes, attrs = (m["tag"] or "").lower(), bool(m["end"]), m["attrs"] or ""
        foreign, empty = bool(opened.get("svg")), attrs.endswith("/")
        if name in _RAW and not closes:
            if not (empty and foreign):
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            name = " "
        elif name in ("svg", "math") and empty:
            name = " "
        elif name in _DROPPED and not closes:
            opened.setdefault(name, []).append(len(out))
        elif name in _DROPPED and opened.get(name):
            out[opened[name].pop()].until = len(out)
        out.append(Tag(start, at, name, closes, attrs))
    return out


def _find_articles(found: list[Tag]) -> None:
    """Set ``holds``.  Articles within articles or among comments are comments,
    and those named as rest speak for themselves only."""
    open_tags: list[tuple[Tag, bool]] = []
    depth: Counter[str] = Counter()
    skip = -1
    for k, t in enumerate(found):
        if k <= skip or not t.name.strip() or t.name in _INLINE or t.name in _VOID:
            continue
        if t.name in _DROPPED and not t.closes:
            skip = t.until
        elif t.closes:
            while depth[t.name]:
                last = open_tags.pop()[0].name
                depth[last] -= 1
                if last == t.name:
                    break
        elif not t.attrs.endswith("/"):
            told = names(t.attrs)
            talk = bool(open_tags) and open_tags[-1][1] or (told.talk and t.name not in ("html", "body"))
            main = t.name == "main" or told.role_main
            if main or (t.name == "article" and not depth["article"] and not talk):
                t.holds = True
                if main or not told.plainly:
                    for outer, _ in reversed(open_tags):
                        if outer.holds and outer.name != "article":
                            break
                        outer.holds = True
            open_tags.append((t, talk))
            depth[t.name] += 1


def _find_forms(page: str, found: list[Tag]) -> None:
    """Set ``holds`` of forms that a page's text stands in: over a hundred words,
    and over fifteen for each of their controls."""
    forms: list[list] = []
    before = None
    for t in found:
        if forms and before is not None and (before.closes or before.name not in _CONTROLS and before.name != "a"):
            forms[-1][1] += len(page[before.end : t.start].split())
        if t.name in _CONTROLS and not t.closes and forms and "hidden" not in t.attrs.lower():
            forms[-1][2] += 1
        if t.name == "form" and not t.closes:
            forms.append([t, 0, 0])
        elif t.name == "form" and forms:
            tag, words, controls = forms.pop()
            tag.holds |= words > max(100, 15 * controls)
        before = t
    for tag, words, controls in forms:  # never closed
        tag.holds |= words > max(100, 15 * controls)


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks, in order (null: none)."""
    page, out = page or "", []
    open_tags: list[tuple[str, float]] = []
    parts: list[tuple[str, bool]] = []
    link, at, skip = False, 0, -1

    def flush() -> None:
        text = " ".join(html.unescape("".join([p for p, _ in parts])).split())
        if text:
            linked = sum([len(html.unescape(p).split()) for p, a in parts if a])
            out.append(Block(text, len(text.split()), linked, open_tags[-1][1] if open_tags else UNKNOWN))
        parts.clear()

    found = tags(page)
    _find_articles(found)
    _find_forms(page, found)
    for k, m in enumerate(found):
        if k <= skip:
            at = m.end
            continue
        if m.start > at:
            parts.append((page[at : m.start], link))
        at, tag = m.end, m.name
        if tag in _DROPPED and not m.closes:
            skip = m.until
            if tag not in ("button", "select") or m.until < 0:
                parts.append((" ", False))
            continue
        if not tag.strip():
            if tag:
                parts.append((" ", False))
            continue
        if tag == "a":
            link = not m.closes
        if tag == "br":
            parts.append((" ", False))
        outer = open_tags[-1][1] if open_tags else UNKNOWN
        if tag in _INLINE:  # goes on with the block, unless it opens or ends a region of its own
            if m.closes:
                if all(t != tag for t, _ in open_tags):
                    continue
            elif outer == REST or not m.attrs or _region(tag, m.attrs, outer) != REST:
                continue
        if parts:
            flush()
        link = link and tag == "a"
        if m.closes:
            if any(t == tag for t, _ in open_tags):
                while open_tags.pop()[0] != tag:
                    pass
        elif tag not in _VOID and not m.attrs.endswith("/"):
            while open_tags and open_tags[-1][0] in ("p", "li", "dt", "dd", "td", "th", "tr", "option") and (open_tags[-1][0] == tag or open_tags[-1][0] == "p"):
                open_tags.pop()
            outer = open_tags[-1][1] if open_tags else UNKNOWN
            open_tags.append((tag, _region(tag, m.attrs, outer, m.holds)))
    if at < len(page):
        parts.append((page[at:], link))
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """Per block: words and link density of it, the one before and the one
    after, and its region."""
    words = np.asarray([b.words for b in found], float)
    density = np.asarray([b.linked for b in found], float) / np.maximum(words, 1)
    region = np.asarray([b.region for b in found], float)
    before, after = slice(0, -2), slice(2, None)
    w, d = np.pad(words, 1), np.pad(density, 1)
    return np.stack([words, density, w[before], d[before], w[after], d[after], region], axis=1)


# Labelled blocks, fixed values: words, link density, those of the block before, those of the block after, region; main text or not.
LABELLED = np.array(
    [
        # within an article: headings, paragraphs of any length, lists
        (8, 0.0, 6, 0.0, 60, 0.0, 1, 1), (12, 0.0, 0, 0.0, 45, 0.0, 1, 1), (1, 0.0, 40, 0.0, 5, 0.0, 1, 1), (3, 0.0, 2, 0.0, 1, 0.0, 1, 1),
        (90, 0.02, 12, 0.0, 70, 0.0, 1, 1), (150, 0.0, 90, 0.0, 9, 0.4, 1, 1), (5, 0.0, 80, 0.1, 0, 0.0, 1, 1), (40, 0.3, 30, 0.1, 50, 0.0, 1, 1),
        (6, 0.2, 55, 0.0, 48, 0.0, 1, 1), (25, 0.1, 7, 0.0, 6, 1.0, 1, 1), (4, 0.5, 60, 0.0, 61, 0.0, 1, 1), (18, 0.6, 44, 0.0, 38, 0.1, 1, 1),
        # within an article, only links: linked titles, closing links, lists of links and references
        (4, 1.0, 3, 1.0, 4, 1.0, 1, 1), (2, 1.0, 60, 0.0, 2, 1.0, 1, 1), (6, 1.0, 5, 1.0, 0, 0.0, 1, 1), (3, 1.0, 0, 0.0, 8, 0.0, 1, 1), (1, 1.0, 1, 1.0, 1, 1.0, 1, 1), (15, 1.0, 14, 1.0, 16, 1.0, 1, 1),
        # within an article, in elements with doubtful names: text, and lists of links
        (1, 0.0, 30, 0.0, 25, 0.0, 0.5, 1), (8, 0.0, 40, 0.0, 60, 0.0, 0.5, 1), (45, 0.1, 7, 0.0, 50, 0.0, 0.5, 1), (20, 0.3, 18, 0.2, 25, 0.0, 0.5, 1), (3, 1.0, 4, 1.0, 3, 1.0, 0.5, 0), (12, 0.9, 40, 0.0, 9, 1.0, 0.5, 0), (2, 1.0, 60, 0.0, 50, 0.0, 0.5, 0), (25, 0.8, 3, 1.0, 60, 0.0, 0.5, 0),
        # menus, adverts, notices, footers, comments, forms
        (1, 1.0, 1, 1.0, 1, 1.0, -1, 0), (8, 0.0, 1, 1.0, 11, 0.0, -1, 0), (9, 0.0, 70, 0.0, 0, 0.0, -1, 0), (40, 0.0, 60, 0.0, 35, 0.0, -1, 0), (120, 0.0, 80, 0.0, 90, 0.0, -1, 0),
        (25, 0.1, 9, 0.0, 30, 0.0, -1, 0), (60, 0.5, 4, 1.0, 5, 1.0, -1, 0), (3, 0.0, 2, 0.0, 90, 0.0, -1, 0), (15, 0.9, 3, 1.0, 8, 0.0, -1, 0), (200, 0.0, 0, 0.0, 100, 0.0, -1, 0),
        # nothing is known of the region: long blocks without many links
        (60, 0.0, 8, 0.0, 70, 0.0, 0, 1), (45, 0.05, 60, 0.0, 30, 0.0, 0, 1), (120, 0.1, 5, 0.0, 4, 1.0, 0, 1), (35, 0.0, 2, 1.0, 80, 0.0, 0, 1), (25, 0.0, 50, 0.0, 40, 0.0, 0, 1),
        (22, 0.1, 30, 0.0, 25, 0.0, 0, 1), (80, 0.2, 0, 0.0, 0, 0.0, 0, 1), (30, 0.0, 0, 0.0, 0, 0.0, 0, 1), (20, 0.0, 45, 0.1, 60, 0.0, 0, 1),
        # short ones between long ones
        (6, 0.0, 50, 0.0, 60, 0.0, 0, 1), (8, 0.0, 35, 0.0, 70, 0.1, 0, 1), (10, 0.0, 4, 1.0, 90, 0.0, 0, 1), (12, 0.0, 60, 0.0, 30, 0.0, 0, 1), (7, 0.0, 3, 0.5, 40, 0.0, 0, 1), (4, 0.0, 45, 0.0, 55, 0.0, 0, 1),
        # list items, lines of dialogue and short paragraphs in a run, without links; its first and last
        (5, 0.0, 5, 0.0, 5, 0.0, 0, 1), (12, 0.0, 12, 0.0, 12, 0.0, 0, 1), (4, 0.0, 2, 0.0, 5, 0.0, 0, 1), (5, 0.0, 8, 0.0, 3, 0.0, 0, 1), (3, 0.0, 14, 0.0, 21, 0.0, 0, 1), (20, 0.0, 6, 0.0, 9, 0.1, 0, 1), (15, 0.1, 9, 0.0, 4, 0.0, 0, 1),
        (12, 0.0, 40, 0.0, 10, 0.0, 0, 1), (6, 0.0, 70, 0.0, 7, 0.0, 0, 1), (8, 0.0, 9, 0.0, 50, 0.0, 0, 1), (8, 0.0, 9, 0.0, 0, 0.0, 0, 1), (11, 0.0, 6, 0.0, 0, 0.0, 0, 1), (10, 0.0, 12, 0.0, 2, 1.0, 0, 1), (5, 0.0, 7, 0.0, 4, 1.0, 0, 1),
        # linked titles and references there, between text or each other
        (6, 1.0, 50, 0.0, 60, 0.0, 0, 1), (8, 1.0, 30, 0.0, 35, 0.0, 0, 1), (4, 1.0, 12, 0.0, 40, 0.0, 0, 1), (7, 1.0, 15, 0.1, 14, 0.0, 0, 1), (5, 1.0, 9, 0.0, 10, 0.0, 0, 1), (15, 0.8, 14, 0.7, 16, 0.9, 0, 1), (18, 1.0, 17, 1.0, 15, 1.0, 0, 1), (16, 1.0, 45, 0.0, 15, 1.0, 0, 1), (15, 0.9, 16, 0.8, 2, 1.0, 0, 1),
        # menus there, to the last link before the text
        (1, 1.0, 1, 1.0, 60, 0.0, 0, 0), (3, 1.0, 2, 1.0, 90, 0.0, 0, 0), (2, 1.0, 3, 1.0, 12, 0.0, 0, 0), (8, 1.0, 6, 1.0, 40, 0.0, 0, 0), (7, 1.0, 9, 1.0, 8, 1.0, 0, 0), (2, 1.0, 60, 0.0, 3, 1.0, 0, 0), (1, 1.0, 0, 0.0, 2, 1.0, 0, 0),
        # unknown region: links, labels and lines at the page's borders
        (1, 1.0, 1, 1.0, 1, 1.0, 0, 0), (3, 1.0, 2, 1.0, 4, 1.0, 0, 0), (5, 0.8, 40, 0.0, 3, 1.0, 0, 0), (20, 0.7, 6, 1.0, 5, 1.0, 0, 0), (35, 0.6, 10, 0.9, 4, 1.0, 0, 0), (2, 0.0, 1, 1.0, 3, 1.0, 0, 0),
        (6, 0.0, 60, 0.0, 0, 0.0, 0, 0), (9, 0.1, 50, 0.0, 2, 1.0, 0, 0), (3, 0.0, 0, 0.0, 2, 1.0, 0, 0), (10, 0.5, 30, 0.0, 40, 0.0, 0, 0),
        (50, 0.55, 3, 1.0, 3, 1.0, 0, 0), (12, 0.0, 5, 1.0, 4, 1.0, 0, 0), (7, 0.0, 9, 0.2, 6, 0.9, 0, 0),
    ]
)


def _runs() -> np.ndarray:
    """Blocks of a run of its like in an unknown region, by their words: within
    it, first, last, alone.  Text is main text; links are if they are as long
    as references and amid such, or stand alone between text as titles do, but
    not at the page's borders, where menus in one block are."""
    out = []
    for n in (1, 2, 3, 5, 8, 10, 12, 15, 20, 30, 50):
        for m in (2, 5, 9, 14, 21, 40, 80):
            out += [(n, 0.0, m, 0.0, m, 0.0, 1), (n, 1.0, m, 0.0, m, 0.0, 1)]
            out += [(n, d, m, 1.0, m, 1.0, int(min(n, m) > 12)) for d in (0.7, 1.0)]
            out += [(n, d, m, 1.0, 60, 0.0, int(min(n, m) > 12)) for d in (0.7, 1.0)]
            out += [(n, d, 60, 0.0, m, 1.0, int(min(n, m) > 12)) for d in (0.7, 1.0)]
        out += [(n, 0.0, n, 0.0, 60, 0.0, 1), (n, 0.0, 60, 0.0, n, 0.0, 1), (n, 0.0, 0, 0.0, n, 0.0, 1), (n, 0.0, 3, 1.0, n, 0.0, int(n > 2)), (n, 0.0, 3, 1.0, 3, 1.0, int(n > 12))]
        out += [(n, 0.0, n, 0.0, 0, 0.0, int(n > 1)), (n, 0.0, n, 0.0, 3, 1.0, int(n > 3)), (n, 1.0, 0, 0.0, n, 1.0, int(n > 12)), (n, 1.0, n, 1.0, 0, 0.0, int(n > 12))]
        out += [(n, 0.0, a, x, b, y, 1) for a, x in ((0, 0.0), (4, 1.0), (15, 1.0), (60, 0.0)) for b, y in ((0, 0.0), (4, 1.0), (15, 1.0), (60, 0.0)) if n > 12]
        out += [(n, 1.0, 0, 0.0, m, 0.0, 0) for m in (14, 40, 80)] + [(n, 1.0, m, 0.0, 0, 0.0, 0) for m in (14, 40, 80)]
    table = np.array(out)
    return np.insert(table, 6, UNKNOWN, axis=1)


def labelled() -> np.ndarray:
    """The table and runs; their main text once more as if in a region of the
    rest, where it is none; other unknown blocks as if in an article, where
    they are main text; and all unknown ones as if under a doubtful name, where
    links are none."""
    table = np.concatenate([LABELLED, _runs()])
    rest = table[table[:, -1] == 1].copy()
    rest[:, -2:] = REST, 0
    main = table[(table[:, -1] == 0) & (table[:, -2] == UNKNOWN)].copy()
    main[:, -2:] = MAIN, 1
    doubtful = table[table[:, -2] == UNKNOWN].copy()
    doubtful[:, -2], doubtful[:, -1] = DOUBTFUL, doubtful[:, 1] < 0.5
    return np.concatenate([table, rest, main, doubtful])


@dataclass
class Node:
    """Rows whose ``feature`` is at most ``border`` go to ``low``; a leaf has a ``label``."""

    label: int
    feature: int = -1
    border: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _gini(y: np.ndarray) -> float:
    p = y.mean() if len(y) else 0.0
    return len(y) * 2 * p * (1 - p)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7) -> Node:
    """A classification tree by the Gini index."""
    node = Node(int(2 * y.sum() > len(y)))
    if not depth or _gini(y) == 0:
        return node
    best = _gini(y)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for border in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= border
            if (rest := _gini(y[low]) + _gini(y[~low])) < best - 1e-9:
                best, node.feature, node.border = rest, f, float(border)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.border
        node.low, node.high = grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    return node


@lru_cache(maxsize=1)
def tree() -> Node:
    table = labelled()
    return grow(table[:, :-1], table[:, -1], 12)


def classify(node: Node, x: np.ndarray) -> np.ndarray:
    """Whether each row is main text."""
    if node.feature < 0:
        return np.full(len(x), bool(node.label))
    low, out = x[:, node.feature] <= node.border, np.empty(len(x), bool)
    out[low], out[~low] = classify(node.low, x[low]), classify(node.high, x[~low])
    return out


def main_text(page: str | None) -> str:
    """Main text blocks, joined by line ends."""
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, classify(tree(), features(found))) if keep)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main text of every whole page.

    * Null or empty html, or no main text: an empty text.  Tags that are never
      closed, or never opened, end where their parent ends or are skipped.
    * Null ids and urls, and repeated rows, come through as they are.
    * Other columns are not read; an empty table gives no rows.
    """
    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return given.mapInArrow(_extracted, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
