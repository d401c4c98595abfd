"""Main text of pages: the contiguous region of highest score, words for and tags against it.

A page is one sequence of words and tags. Each has a weight by what it is and where it stands,
learnt from labelled pages: words at least a little above zero, tags below. One linear scan finds
the region of the largest sum. Of its blocks those inside menus, adverts, forms, comments and the
like are left out, and the others are the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fields, slices
from .labelled_pages import labelled
from .markup import CLOSE, IN_HEAD, OPEN, TEXT, attributes, scan

#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup
    option p pre search section select summary table tbody td tfoot th thead tr ul""".split()
)
#: Elements without content or end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never part of the text.
HIDDEN = frozenset("audio button canvas datalist head iframe map noembed noframes noscript object script select style svg template textarea title video xmp".split())
#: Elements that hold something else than the article, and those that hold it.
OTHER_ELEMENTS = frozenset("aside dialog footer form menu nav search".split())
MAIN_ELEMENTS = frozenset("article main".split())
#: Words in class, id or role that say the same.
OTHER_WORDS = frozenset(
    """ad ads adsbygoogle adsense advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment commentlist
    comments complementary consent contentinfo cookie cookies dialog discussion disqus footer footnav gdpr
    header login masthead menu menubar modal nav navbar navigation navi newsletter notice notification notifications
    outbrain overlay pager pagination popup promo promotion promotions recommended related replies reply
    respond responses search share sharing sidebar sidemenu signin signup skip social sponsor sponsored subscribe
    subscription taboola teaser teasers toolbar topbar topnav trending widget widgets""".split()
)
MAIN_WORDS = frozenset("article content entry main post story".split())
#: Words that, with a word of the article beside them, name a part of it.
PARTS = frozenset(["header"])
#: Words that, with a word of the article beside them, name what stands around it.
AROUND = frozenset("container layout wrap wrapper".split())
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Before the first of these, a name says what a page has or lacks, not what an element is.
_SAYS = re.compile(r"^(?:has|no|with|without|is|hide|js)(?=[-_A-Z])")
#: What an area holds; INNER is OTHER inside MAIN.
OTHER, INNER, MAIN, PLAIN = "other", "inner", "main", "plain"
LEFT_OUT = (OTHER, INNER)
#: The least weight of a word; items of a class that make it count; what words get and tags lose.
LEAST, SEEN, LEAN = 0.02, 5, 0.25
#: Words of a block from which it counts as a short or a long text.
SHORT, LONG = 5, 16
#: Characters that count as a word where a script has no spaces.
UNSPACED = 16


@cache
def _kind_of_name(names: str) -> str:
    """What the names in class, id and role say of an element."""
    kinds = set()
    for name in names.split():
        words = set() if _SAYS.match(name) else {w.lower() for w in _NAMES.findall(name)}
        main, other = words & MAIN_WORDS, words & OTHER_WORDS
        if other and not (main and (other <= PARTS or words & AROUND)):
            kinds.add(OTHER)
        elif main and not other:
            kinds.add(MAIN)
    return OTHER if OTHER in kinds else MAIN if MAIN in kinds else PLAIN


def kind_of(name: str, raw: str, inside: str) -> str:
    """OTHER, MAIN or PLAIN for a start tag in an area of a kind."""
    if name in ("html", "body"):
        return PLAIN
    if name in OTHER_ELEMENTS:
        return OTHER
    said = PLAIN
    if "=" in raw:
        of = attributes(raw)
        said = _kind_of_name(" ".join(filter(None, (of.get("class"), of.get("id"), of.get("role"))))[:500])
        if name in MAIN_ELEMENTS:
            comment = {w.lower() for w in _NAMES.findall(" ".join((of.get("class", ""), of.get("id", ""))))} & {"comment", "reply", "teaser", "related"}
            return OTHER if comment else MAIN
    if name in MAIN_ELEMENTS:
        return MAIN
    if name == "header":
        return PLAIN if inside == MAIN else OTHER
    return said


class Area:
    """What an element of some kind holds; ``of`` is settled when the page is read."""

    __slots__ = ("kind", "outer", "form", "of")

    def __init__(self, kind: str, outer: Area | None, form: bool = False) -> None:
        self.kind, self.outer, self.form, self.of = kind, outer, form, kind


class Page:
    """The words and tags of a page: ``items`` are (block, words, element) or (-1, mark, element)
    with their area; ``blocks`` the texts."""

    def __init__(self, page: str) -> None:
        root = Area(PLAIN, None)
        self.areas, self.blocks, self.items = [root], [], []
        open_: list[tuple[str, Area]] = []
        count: Counter[str] = Counter()
        area, hidden, block, element, links, fresh = root, 0, -1, "", 0, True

        def close(name: str) -> None:
            nonlocal area, hidden
            while count[name]:
                top, _ = open_.pop()
                count[top] -= 1
                hidden -= top in HIDDEN
                area = open_[-1][1] if open_ else root
                if top == name:
                    return

        for what, name, raw in scan(page):
            if what == TEXT:
                if hidden:
                    continue
                plain = html.unescape(name) if "&" in name else name
                words = len(plain.split())
                words = words and max(words, len(plain) // UNSPACED)
                if fresh and words:
                    self.blocks.append([])
                    block, fresh = len(self.blocks) - 1, False
                if not fresh:
                    self.blocks[block].append((name, area))
                if words:
                    self.items.append((block, words, "a" if links else element, area))
                continue
            if count["head"] and what == OPEN and name not in IN_HEAD:
                close("head")
            if name in BLOCKS:
                fresh, element = True, name if what == OPEN else ""
                links = 0
                if what == OPEN and count["p"] and open_[-1][0] == "p":
                    close("p")
                if name == "li" and what == OPEN and open_[-1:] and open_[-1][0] == "li":
                    close("li")
            if what == CLOSE:
                if name == "a":
                    links = 0
                if not hidden:
                    self.items.append((-1, "/" + name, area.kind if name in BLOCKS else "", area))
                close(name)
                continue
            if name == "a":
                links = 1
            if name in VOID:
                if not hidden:
                    self.items.append((-1, name, "", area))
                if name == "br" and not fresh:
                    self.blocks[block].append((" ", area))
                continue
            kind = PLAIN if hidden else kind_of(name, raw, area.kind)
            if not hidden:
                self.items.append((-1, name, kind, area))
            if name in HIDDEN:
                hidden += 1
            elif name not in BLOCKS and kind == PLAIN:
                continue
            if kind == MAIN or name == "h1":  # a form around the article is no form of it
                around: Area | None = area
                while around is not None and around.form:
                    around.form, around.kind = False, PLAIN
                    around = around.outer
            if kind != PLAIN:
                area = Area(kind, area, name == "form")
                self.areas.append(area)
            open_.append((name, area))
            count[name] += 1
        for a in self.areas[1:]:  # outer areas come first
            around = a.outer.of
            if around in LEFT_OUT or a.kind == PLAIN:
                a.of = around
            elif a.kind == OTHER:
                a.of = INNER if around == MAIN else OTHER
        self.sizes = [0] * len(self.blocks)
        for b, words, _, _ in self.items:
            if b >= 0:
                self.sizes[b] += words

    def classes(self, i: int) -> tuple[int, tuple]:
        """(words of item i, or -1 for a tag; its classes, the finest first)."""
        block, what, element, area = self.items[i]
        if block >= 0:
            size = "short" if self.sizes[block] < SHORT else "long" if self.sizes[block] >= LONG else "middle"
            link = element if element in ("a", "h1") else "text"
            return what, (("w", area.of, link, size), ("w", area.of, link), ("w", area.of))
        return -1, (("t", area.of, element, what), ("t", area.of, element), ("t", area.of))

    def text(self, first: int, end: int) -> str:
        """The blocks with words among items first to end that are not inside OTHER areas."""
        kept = dict.fromkeys(b for b, _, _, area in self.items[first:end] if b >= 0 and area.of not in LEFT_OUT)
        texts = ("".join(x for x, area in self.blocks[b] if area.of not in LEFT_OUT) for b in kept)
        return "\n".join(" ".join(html.unescape(x).split()) for x in texts)


def best_region(scores: list[float]) -> tuple[int, int]:
    """(first, end) of the contiguous range of the largest sum above zero, the first of equal ones,
    in one scan; (0, 0) where nothing is above zero."""
    best, found, total, first = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0.0:
            total, first = 0.0, i
        total += x
        if total > best:
            best, found = total, (first, i + 1)
    return found


class Scorer:
    """Weights of classes of items: words at least LEAST, tags at most -LEAST. An item has the
    weight of the finest of its classes that was seen often enough."""

    def __init__(self, weights: dict[tuple, float]) -> None:
        self.weights, self.known = weights, {}

    def score(self, count: int, classes: tuple) -> float:
        if classes not in self.known:
            weight = next((self.weights[c] for c in classes if c in self.weights), 0.0)
            self.known[classes] = min(-LEAST, weight) if count < 0 else max(LEAST, weight)
        return self.known[classes] * abs(count)

    def region(self, page: Page) -> tuple[int, int]:
        return best_region([self.score(*page.classes(i)) for i in range(len(page.items))])


def fit(pages: list[tuple[str, set[str]]]) -> Scorer:
    """Weights from labelled pages, (html, words that only its article has): the logarithm of how
    much more often a class stands inside the region from the article's first to its last block
    than outside, among words and among tags."""
    inside, outside = Counter(), Counter()
    for page, wanted in pages:
        p = Page(page)
        of = [i for i, x in enumerate(p.items) if x[0] >= 0 and not wanted.isdisjoint("".join(t for t, _ in p.blocks[x[0]]).split())]
        for i in range(len(p.items)):
            count, classes = p.classes(i)
            side = inside if of and of[0] <= i <= of[-1] else outside
            for c in classes:
                side[c] += abs(count)
    total = {(side, k): sum(n for c, n in of.items() if len(c) == 2 and c[0] == k) + 1 for side, of in enumerate((inside, outside)) for k in "wt"}
    seen = {c for c in [*inside, *outside] if inside[c] + outside[c] >= SEEN or len(c) == 2}
    odds = {c: math.log((inside[c] + 0.5) / total[0, c[0]]) - math.log((outside[c] + 0.5) / total[1, c[0]]) for c in seen}
    return Scorer({c: x + (LEAN if c[0] == "w" else -LEAN) for c, x in odds.items()})


@cache
def fitted() -> Scorer:
    return fit(labelled())


def main_text(page: str | None, scorer: Scorer) -> str:
    p = Page(page or "")
    return p.text(*scorer.region(p))


def _texts(batches: Iterator[pa.RecordBatch], weights: dict[tuple, float]) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(weights)
    for whole in batches:
        for batch in slices(whole, "html", 4 << 20):
            found = [main_text(x, scorer) for x in batch.column("html").to_pylist()]
            sizes = pa.array([len(x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """``pages(page_id, url, html)`` -> page_id, url, text, n_chars (code points).

    The text is the blocks of the best region, in order, joined by line breaks; inside a block
    character references are decoded and white space becomes one space, ends trimmed. Menus,
    headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles are left out
    wherever they stand. Null, empty and wordless pages give an empty text. Pages are read whole, in
    time linear in their length. Repeated and null ids are rows like others, other columns are not
    read, and an empty table gives an empty result.
    """
    weights = dict((scorer or fitted()).weights)
    kinds = fields(pages, "page_id", "url string, text string, n_chars long")
    return pages.select("page_id", "url", "html").mapInArrow(partial(_texts, weights=weights), kinds)
