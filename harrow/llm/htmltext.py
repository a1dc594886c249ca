"""Main text of web pages from streaming parser events.

The standard library's parser feeds events; every block element gives one line
with its text, the tags met since the line before and its link characters. Each
line's text-to-tag ratio, lowered where a tag, class, id or role around it speaks
of boilerplate, is smoothed with a Gaussian, and two-means clustering of the
smoothed ratios sets the threshold between content and other lines. All lines are
read before anything is left out.

Block elements form a tree by parent numbers; characters, content and links are
summed over it in one pass from the last element to the first, so the work is
linear in the page, however deep it is nested. From the page inwards, a container
that holds nearly all of the content is gone into, up to an article or main
element at most; where the content is spread over several containers, all of them
are the region. All lines of the region are the text, so that a short paragraph
between long ones stays, but for what is boilerplate inside it:

* elements that say so plainly (menus, headers, footers, asides, forms; a class,
  id or role that is such a word), unless they hold an article or main element, or
  all of its content, or half of a page's without one, or were never closed;
* elements that only hint at it (such a word among others), if their lines fall
  below the threshold and are short or mostly links;
* containers that are nearly all links, parts without any content line, articles
  with little content beside larger ones, and articles inside one that has its own
  content (teaser cards, reader comments).

Scripts, styles, templates, embedded objects and buttons have no text at all.

Defined results: null or empty html, and pages without text, give an empty
string; character references are decoded; white space inside a block becomes one
space, a line break element too; blocks are joined by two newlines; broken
markup is read as far as it goes; repeated rows give repeated results; an empty
table gives no rows. Other columns pass through, whatever their names, but one
with the name of the output, which is a parameter, is replaced.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from harrow.llm.common import bounded_batches

#: Elements without text of their own (fixed values).
NEVER = frozenset("head title script style noscript template iframe object svg canvas audio video button select option textarea".split())
#: Elements that are boilerplate by their tag (fixed values).
MARKED = frozenset("nav header footer aside form dialog menu".split())
#: Class, id and role words that say so plainly, words that may stand beside them, and words that only hint at it (fixed values).
PLAIN = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus replies toolbar pagination pager complementary contentinfo".split()
)
BESIDE = frozenset("container wrapper wrap box block list area section site page top bottom left right global main primary secondary buttons button bar links link item items post posts inner slot unit form widget widgets thread body content".split())
HINTS = frozenset("alert search discussion widget widgets".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("html body main article section div td center ul ol dl table blockquote figure details fieldset".split()) | MARKED
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARTS = frozenset("article main section div td".split())
SAME = frozenset("li dt dd tr td th option".split())
#: MOST: share of the content that a container holds to be gone into. SHARE: of the largest part's content, for an article beside it. LINKS: of a menu. HALF: of the content of a page without article and main elements, for what is not left out. LOWERED: weight of a ratio in what speaks of boilerplate. SHORT: characters of a line, on average.
SIGMA, RADIUS, MOST, SHARE, LINKS, HALF, LOWERED, SHORT = 1.0, 3, 0.9, 0.1, 0.5, 0.5, 0.3, 80
_KERNEL = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)


def spoken(names: str) -> int:
    """2 if a name is plainly one of boilerplate, 1 if a word of one hints at it, else 0."""
    most = 0
    for name in names.split():
        parts = [p for p in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if p]
        plain = [p for p in parts if p in PLAIN]
        if plain and all(p in PLAIN or p in BESIDE for p in parts):
            return 2
        if plain or any(p in HINTS for p in parts):
            most = 1
    return most


class Events(HTMLParser):
    """Collects lines (text, tags, link characters, element) and the tree of block elements: parent, kind, how plainly boilerplate, whether closed by its own end tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.parent, self.kind, self.says, self.closed = [-1], ["page"], [0], [True]
        self.open: list[tuple[str, int, bool]] = []  # name, element or -1, without text
        self.places: dict[str, list[int]] = {}  # where a name is open
        self.bars: list[int] = []  # where containers are open
        self.parts: list[str] = []
        self.at = self.tags = self.linked = self.mute = self.anchors = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            self.lines.append((text, self.tags, self.linked, self.at))
            self.tags = 0
        self.linked = 0

    def close_to(self, place: int) -> None:
        while len(self.open) > place:
            name, number, mute = self.open.pop()
            self.places[name].pop()
            if self.bars and self.bars[-1] == len(self.open):
                self.bars.pop()
            if number >= 0:
                self.at = self.parent[number]
            self.mute -= mute

    def last(self, name: str) -> int:
        """Where the name is open last, or -1."""
        places = self.places.get(name)
        return places[-1] if places else -1

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        if not self.mute:
            self.tags += 1
        if tag == "a":
            self.anchors += 1
        if tag in BLOCKS:
            self.end_line()
            # a block ends an open paragraph, a list item an open one of the same list
            place = max(self.last("p"), self.last(tag) if tag in SAME else -1)
            if place > (self.bars[-1] if self.bars else -1):
                self.close_to(place)
        if tag in VOID:
            return
        mute = tag in NEVER or any(k == "hidden" for k, _ in attrs)
        if not mute and tag not in BLOCKS:
            return
        number = -1
        if tag in BLOCKS:
            number = len(self.parent)
            names = {k: v for k, v in attrs if k in ("class", "id", "role") and v}
            says = 2 if tag in MARKED else 0 if tag in ("html", "body", "main", "article") else max(map(spoken, names.values()), default=0)
            self.parent.append(self.at)
            self.kind.append("main" if names.get("role") == "main" else tag)
            self.says.append(0 if names.get("role") == "main" else says)
            self.closed.append(False)
            self.at = number
        if tag in CONTAINERS:
            self.bars.append(len(self.open))
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, number, mute))
        self.mute += mute

    def handle_endtag(self, tag):
        if tag == "a":
            self.anchors = max(0, self.anchors - 1)
        if tag in BLOCKS:
            self.end_line()
        place = self.last(tag)
        if place >= 0:
            number = self.open[place][1]
            if number >= 0:
                self.closed[number] = True
            self.close_to(place)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not self.mute:
            self.parts.append(data)
            if self.anchors:
                self.linked += len(data)

    def unknown_decl(self, data):
        pass


def read_lines(html: str) -> Events:
    for text in (html, html.replace("<![", "&lt;![")):
        events = Events()
        try:
            events.feed(text)
            events.close()
        except AssertionError:  # a marked section that the parser does not know
            continue
        break
    events.end_line()
    return events


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is what lies inside."""
    n = len(ratios)
    total = np.convolve(ratios, _KERNEL)[RADIUS : RADIUS + n]
    return total / np.convolve(np.ones(n), _KERNEL)[RADIUS : RADIUS + n]


def threshold(values: np.ndarray) -> float:
    """Between the two means of the values; below all of them if they are alike."""
    low, high = values.min(), values.max()
    if high <= 2 * low:
        return -1.0
    for _ in range(20):
        cut = (low + high) / 2
        below, above = values[values <= cut], values[values > cut]
        new = (below.mean(), above.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def content_lines(events: Events) -> np.ndarray:
    """Per line, whether its smoothed ratio is over the threshold."""
    weight = [1.0]
    for n in range(1, len(events.parent)):
        weight.append(LOWERED if events.says[n] and events.kind[n] != "article" else weight[events.parent[n]])
    ratios = np.array([len(t) / max(tags, 1) * weight[at] for t, tags, _, at in events.lines])
    ratios = smoothed(ratios)
    return ratios > threshold(ratios)


class Sums:
    """Characters, content, links and lines of every element with all in it, without what was left out."""

    def __init__(self, events: Events, content, out: list[bool]):
        n = len(events.parent)
        self.size, self.held, self.links, self.lines = [0] * n, [0] * n, [0] * n, [0] * n
        for (text, _, linked, at), yes in zip(events.lines, content):
            if not out[at]:
                self.size[at] += len(text)
                self.held[at] += len(text) * bool(yes)
                self.links[at] += linked
                self.lines[at] += 1
        for k in range(n - 1, 0, -1):
            up = events.parent[k]
            self.size[up] += self.size[k]
            self.held[up] += self.held[k]
            self.links[up] += self.links[k]
            self.lines[up] += self.lines[k]


def boilerplate(events: Events, sums: Sums) -> list[bool]:
    """Per element, whether it or what it stands in says plainly that it is boilerplate, or hints at it and looks like it.

    Spared is what holds an article or main element, all the content of the one
    that it stands in, or, on a page without any, half of the page's content.
    """
    n, parent = len(events.parent), events.parent
    main = [kind in ("article", "main") and sums.size[k] > 0 for k, kind in enumerate(events.kind)]
    holds, anchor = list(main), [-1 if any(main) else 0] * n
    for k in range(n - 1, 0, -1):
        holds[parent[k]] |= holds[k]
    out = [False] * n
    for k in range(1, n):
        anchor[k] = parent[k] if main[parent[k]] else anchor[parent[k]]
        says = events.says[k] if events.closed[k] or events.kind[k] not in MARKED else 1
        dull = sums.held[k] < LINKS * sums.size[k] and (sums.links[k] >= LINKS * sums.size[k] or sums.size[k] < SHORT * sums.lines[k])
        whole = anchor[k] >= 0 and sums.held[k] > 0 and sums.held[k] >= (1.0 if anchor[k] else HALF) * sums.held[anchor[k]]
        out[k] = out[parent[k]] or not (holds[k] or whole) and (says == 2 or says == 1 and dull)
    return out


def inner_articles(events: Events, sums: Sums, out: list[bool]) -> None:
    """Leaves out articles inside an article with at least as much content outside of such ones."""
    n = len(events.parent)
    over = [-1] * n  # the nearest article above
    nested: dict[int, int] = {}
    for k in range(1, n):
        up = events.parent[k]
        over[k] = up if events.kind[up] == "article" else over[up]
        if events.kind[k] == "article" and over[k] >= 0:
            nested[over[k]] = nested.get(over[k], 0) + sums.held[k]
    for k in range(1, n):
        above = over[k]
        out[k] |= out[events.parent[k]] or events.kind[k] == "article" and above >= 0 and 2 * nested[above] <= sums.held[above]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    events = read_lines(html)
    if not events.lines:
        return ""
    n, parent, kind = len(events.parent), events.parent, events.kind
    content = content_lines(events)
    out = boilerplate(events, Sums(events, content, [False] * n))
    inner_articles(events, Sums(events, content, out), out)
    sums = Sums(events, content, out)
    children: list[list[int]] = [[] for _ in range(n)]
    within = [0] * n  # the nearest container above
    for k in range(1, n):
        within[k] = parent[k] if kind[parent[k]] in CONTAINERS else within[parent[k]]
        if kind[k] in CONTAINERS and sums.size[k]:
            children[within[k]].append(k)
    deeper = lambda k: next((c for c in children[k] if sums.held[c] >= MOST * sums.held[k]), None)
    region = 0  # all of the page; then inwards as long as one container holds nearly all content
    while kind[region] not in ("article", "main") and (inside := deeper(region)) is not None:
        region = inside
    cut = [False] * n
    for k in range(1, n):
        linked, size, held = sums.links[k], sums.size[k], sums.held[k]
        if kind[k] in CONTAINERS and k != region and size and linked >= LINKS * size:
            cut[k] = held < LINKS * size or linked >= MOST * size and held < LINKS * sums.held[0]
    level = region
    while level is not None and kind[level] != "article":
        parts = [k for k in children[level] if kind[k] in PARTS]
        most = max((sums.held[k] for k in parts), default=0)
        for k in parts:
            cut[k] |= sums.held[k] == 0 or kind[k] == "article" and sums.held[k] < SHARE * most
        level = deeper(level)
    inside = [k == region for k in range(n)]
    for k in range(1, n):
        inside[k] |= inside[parent[k]]
        out[k] |= cut[k] or out[parent[k]]
    return "\n\n".join(t for t, _, _, at in events.lines if inside[at] and not out[at])


@F.pandas_udf(StringType())
def extracted(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(h) for h in pages], dtype=object)


def with_main_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add ``out``: the main text of the whole page."""
    return bounded_batches(df).withColumn(out, extracted(F.col(html)))
