"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's tags and text; block elements cut
them into lines. A line's ratio is its text, links left out, to its tags, times a
weight below 1 where an element around names itself after what stands beside an
article. Ratios are smoothed by a Gaussian along the page, within each such frame
by itself, and lines above one standard deviation form the clusters of content.
The element around the clusters (an article where the page has one) is the
region. In it, lines between clusters belong to the text unless links make them
up; frames belong to it where their own smoothed ratio is near the page's best;
without an article, so do lines beside the clusters only where they are of the
same kind and place, or headings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES_AT_ONCE = 128

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a line.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption title".split()
)
#: Elements whose text is never content.
BARRED = frozenset(
    "nav footer aside form script style noscript template head title iframe object svg math canvas audio video button select option "
    "textarea input label dialog menu map applet datalist output progress meter".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id attributes that mark an element as no content.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner nav "
    "navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside widget widgets masthead footer foot cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup share sharing sharebar social "
    "related recommended recommendations comment comments commentlist commentform discussion replies reply respond disqus login search "
    "searchform toolbar pagination pager copyright disclaimer tracking hidden".split()
)
#: Words that say nothing of what an element holds; any other word beside a hint makes it a weak one.
NEUTRAL = frozenset(
    "box wrap wrapper container list item items area section block inner outer left right top bottom site page main global post article "
    "entry content text bar row col column unit slot link links btn button icon icons title label body group panel module region left side rail zone new js".split()
)
#: Words that say nothing of what an element holds; any other word beside a hint makes it a weak one.
NEUTRAL = frozenset(
    "box wrap wrapper container list item items area section block inner outer left right top bottom site page main global post article "
    "entry content text bar row col column unit slot link links btn button icon icons title label body group panel module region left side rail zone new js".split()
)
HEADER = frozenset(("header", "head"))
COMMENTS = frozenset("comment comments commentlist discussion replies reply respond disqus".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Weights of lines in elements that name themselves, surely or perhaps, after what stands beside an article.
STRONG, WEAK = 0.02, 0.5
#: Share of the page's best smoothed ratio that a named element's lines need.
NEAR_BEST = 0.2
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class _Frame(NamedTuple):
    """What holds inside an open element: ``number`` of the element that named itself last, and its weight."""

    weight: float = 1.0
    number: int = 0
    barred: bool = False  # text is never content
    talk: bool = False  # readers' comments
    headings_only: bool = False


class Line(NamedTuple):
    text: str
    tags: int
    linked: int
    heading: bool
    block: int
    frame: _Frame


class _Lines(HTMLParser):
    """Lines of a page, and its block elements by number: kind, parent, outermost article and main part around."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, _Frame]] = []  # name, number of its block, frame
        self.opened: Counter[str] = Counter()
        self.kind, self.parent, self.article, self.main = [""], [0], [0], [0]
        self.buffer: list[str] = []
        self.tags = self.linked = self.links = self.headings = 0
        self.lines: list[Line] = []

    def _top(self) -> tuple[int, _Frame]:
        return self.open[-1][1:] if self.open else (0, _Frame())

    def cut(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text or self.tags:
            block, frame = self._top()
            if frame.headings_only and not self.headings:
                frame = frame._replace(barred=True)
            self.lines.append(Line(text, self.tags, self.linked, self.headings > 0, block, frame))
        self.buffer.clear()
        self.tags = self.linked = 0

    def _inside(self, tag: str, attrs: list[tuple[str, str | None]], around: _Frame) -> _Frame:
        if around.barred or tag in BARRED:
            return around._replace(barred=True)
        if tag in ("article", "main") and not around.talk:
            return _Frame(headings_only=around.headings_only)  # whatever it stands in is named after, this is content
        if tag in ("html", "body"):
            return around
        given = dict(attrs)
        if "hidden" in given or (given.get("aria-hidden") or "").lower() == "true" or (given.get("role") or "").lower() in ROLES:
            return around._replace(barred=True)
        if "display:none" in (given.get("style") or "").replace(" ", "").lower():
            return around._replace(barred=True)
        if tag == "header":
            return around._replace(headings_only=True) if self.opened["article"] else around._replace(barred=True)
        own = [{w.lower() for w in _WORDS.findall(name)} for key in ("class", "id") for name in (given.get(key) or "").split()]
        if tag not in HEADINGS and any(words & HEADER for words in own):
            return around._replace(headings_only=True) if self.opened["article"] else around._replace(weight=around.weight * STRONG, number=len(self.kind))
        named = [words for words in own if words & HINTS]
        if not named:
            return around
        sure = any(words <= HINTS | NEUTRAL for words in named)
        return around._replace(weight=around.weight * (STRONG if sure else WEAK), number=len(self.kind), talk=around.talk or any(words & COMMENTS and words <= HINTS | NEUTRAL for words in named))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCK
        if block:
            self.cut()
            if tag != "body":
                self._close_implied(tag)
        elif tag in ("br", "td", "th"):
            self.buffer.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        number, around = self._top()
        frame = self._inside(tag, attrs, around)
        self.opened[tag] += 1
        self.headings += tag in HEADINGS
        self.links += tag == "a"
        if block or frame.number != around.number:
            self.kind.append(tag)
            self.parent.append(number)
            new = len(self.kind) - 1
            self.article.append(self.article[number] or (new if tag == "article" and not frame.talk else 0))
            self.main.append(self.main[number] or (new if tag == "main" and not frame.talk else 0))
            number = new
        self.open.append((tag, number, frame))

    def _close_implied(self, tag: str) -> None:
        """A block ends an open paragraph; list and table items end their like."""
        ends = {"p"} | ({tag} if tag in ("li", "tr") else {"dt", "dd"} if tag in ("dt", "dd") else set())
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name in ends:
                self._pop_to(k)
                return
            if name in BLOCK or name in ("td", "th"):
                return

    def _pop_to(self, k: int) -> None:
        while len(self.open) > k:
            name = self.open.pop()[0]
            self.opened[name] -= 1
            self.headings -= name in HEADINGS
            self.links -= name == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.cut()
        self.tags += 1
        if not self.opened[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._pop_to(k)
                return
            if tag not in BLOCK and self.open[k][0] in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        self.buffer.append(data)
        if self.links:
            self.linked += len(data)


def _plain_ratio(line: Line) -> float:
    return max(0, len(line.text) - (0 if line.heading else line.linked)) / max(1, line.tags)


def _smoothed(ratio: np.ndarray, frame: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian means along the page; a line hears only those of its own frame."""
    reach = max(1, round(3 * sigma))
    total, heard = np.zeros(len(ratio)), np.zeros(len(ratio))
    for d in range(-min(reach, len(ratio) - 1), min(reach, len(ratio) - 1) + 1):
        near = np.exp(-0.5 * (d / sigma) ** 2)
        here, there = slice(max(0, -d), len(ratio) - max(0, d)), slice(max(0, d), len(ratio) + min(0, d))
        same = near * (frame[here] == frame[there])
        total[here] += same * ratio[there]
        heard[here] += same
    return total / heard


def extract(html: str | None, sigma: float = 1.0, share: float = 0.25, linked: float = 0.5, ratio_of: Callable[[Line], float] = _plain_ratio) -> str:
    """Main text of one page; blocks are joined by an empty line.

    ``sigma`` is the width of the smoothing in lines; an article of several is
    kept where it has ``share`` of the largest one's text; lines whose text is in
    links by more than ``linked`` need a ratio of their own; ``ratio_of`` gives a
    line's ratio.
    """
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.cut()
    lines = parser.lines
    open_to = lambda line: line.text and not line.frame.barred and not line.frame.talk
    if not any(open_to(line) and line.frame.weight == 1 for line in lines):
        # all text is in elements whose names lower it: one of them must frame the content
        lines = [line._replace(frame=line.frame._replace(weight=1.0, number=0)) for line in lines]
    asked = [k for k, line in enumerate(lines) if open_to(line)]
    if not asked:
        return ""
    weight = np.array([line.frame.weight if open_to(line) else 0.0 for line in lines])
    ratio = weight * np.array([ratio_of(line) for line in lines])
    frame = np.array([line.frame.number if open_to(line) else -1 for line in lines])
    smooth = _smoothed(ratio, frame, sigma)
    dense = np.where(weight == 1, smooth >= min(smooth.std(), smooth.max()), (weight > 0) & (smooth >= NEAR_BEST * smooth.max()))
    chosen = [k for k in asked if dense[k]] or asked
    kind, parent, block = parser.kind, parser.parent, [line.block for line in lines]
    mostly_links = lambda line: not line.heading and line.linked > linked * len(line.text)
    # lines without a name are content by their place, those with one by their ratio; so are links
    by_place = lambda k: dense[k] or (weight[k] == 1 and not mostly_links(lines[k]))
    for around in (parser.article, parser.main):
        size = Counter()
        for k in chosen:
            if around[block[k]]:
                size[around[block[k]]] += len(lines[k].text)
        if size:
            least = share * max(size.values())
            roots = {e for e, n in size.items() if n >= least}
            return "\n\n".join(lines[k].text for k in asked if around[block[k]] in roots and by_place(k))
    total, held = sum(len(lines[k].text) for k in chosen), [0] * len(kind)
    for k in chosen:
        held[block[k]] += len(lines[k].text)
    for e in range(len(kind) - 1, 0, -1):
        held[parent[e]] += held[e]
    root = max((e for e in range(1, len(kind)) if held[e] >= 0.8 * total and kind[e] != "p"), default=0)
    within = [root == 0] * len(kind)
    for e in range(1, len(kind)):
        within[e] = within[e] or e == root or within[parent[e]]
    first, last = min(chosen), max(chosen)
    alike = {(parent[block[k]], kind[block[k]]) for k in chosen}
    place = lambda k: first <= k <= last or lines[k].heading or (parent[block[k]], kind[block[k]]) in alike
    picked = set(chosen)
    return "\n\n".join(lines[k].text for k in asked if k in picked or (within[block[k]] and place(k) and by_place(k)))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options: float) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row.

    Null and empty html, and pages without content, give an empty text. Pages are
    read whole, whatever their length, and cut-off or badly nested ones as far
    as they go. Repeated rows come back as often; null ids and urls stay null;
    an empty table gives no rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(k, PAGES_AT_ONCE)
                texts = [extract(h, **options) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kept = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return kept.mapInArrow(run, "page_id long, url string, text string, n_chars long")
