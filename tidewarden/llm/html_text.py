"""Main text of HTML pages from tag ratios.

The standard library's parser reads a page piece by piece. Its events fill lines, one per block of text, each
with its characters, its tags and the elements it lies in. The ratio of characters to tags is smoothed over the
lines with a Gaussian, and a threshold found by clustering the smoothed ratios around two centres selects lines
that look like content; of these, the ones whose own ratio reaches the threshold are the core of a region.

Where ``article`` or ``main`` elements hold at least half of the selected characters, the main text is all of these
elements and the selected lines and paragraphs between them. Elsewhere the core decides: its container is the innermost element around all
core lines that are not mostly links, widened while the element around it adds nothing but paragraphs. In the container,
lines that are selected, lie between core lines or are paragraphs or headings count; all others, and everything outside,
go. Lines that are mostly links and lines that state a copyright do not count. Menus, headers of the page, footers,
sidebars, forms, notices, adverts, comments, scripts and styles never count, wherever they stand.

Class, id and role values help to name such blocks: by the whole value, or by its last word before words such as block
or box. They never name the page, its body, an article or a main element. A form with most of the characters outside of
links is content, and so is a named block with nearly all of them, as long as no article or main element outside it has text.

All walks over the elements are single passes in page order, so a page costs time in proportion to its length, however
deep its elements lie.

Pages are independent of each other, so Spark reads and extracts them in one pass without a shuffle.

Defined cases: null and empty pages, pages without text and pages that consist of left-out elements only have an
empty text. Broken markup is read as the parser reports it: an end tag closes the innermost element of its name, if
there is one; elements left open end with the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.llm.common import slices

# Names of the HTML standard, and words that sites use in class, id and role for what is not content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
LEFT_OUT = frozenset(
    "head title script style noscript template nav footer aside button select option textarea iframe object "
    "svg canvas dialog menu".split()
)
# Compared with whole values, "_" read as "-".
NOT_CONTENT = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies "
    "consent disclaimer footer form menu modal nav navbar navigation newsletter notice notices popup promo "
    "promotion related search share sharing sidebar social sponsor sponsored subscribe toolbar widget "
    "complementary contentinfo dialog alert "
    "ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper banner-ad breadcrumb-nav comment-body comment-form "
    "comment-list comments-area comments-list comments-section cookie-banner cookie-bar cookie-consent cookie-notice "
    "footer-nav left-sidebar main-menu main-nav nav-bar nav-menu newsletter-signup page-footer popup-overlay "
    "primary-nav promo-box related-articles related-links related-posts right-sidebar search-box search-form "
    "share-bar share-buttons share-links side-bar sidebar-left sidebar-right site-footer site-nav social-icons "
    "social-links social-share sponsored-content sub-menu top-menu top-nav".split()
)
# Words of a name that do not say what its block is, and words that make it say something about another block.
CONTAINERS = frozenset("area bar block box container group inner list outer panel section slot unit wrap wrapper zone".split())
ABOUT_OTHERS = frozenset("has in is no with without".split())
ARTICLE = frozenset(("article", "main"))
ARTICLE_NAMES = frozenset("main main-content articlebody article-body".split())
#: No name leaves these out.
UNNAMED = ARTICLE | {"html", "body"}
#: Share of the characters over which a form, or a block named as no content, is content all the same.
FORM_SHARE, NAMED_SHARE = 0.5, 0.9
SIGMA, REACH = 1.0, 2
PARAGRAPH = frozenset("p li td th dd dt h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption".split())
#: Elements in which an open paragraph stays open when another one starts outside them.
SCOPES = frozenset(("div", "section", "td", "th", "li", "blockquote", *ARTICLE))
#: Elements that are never a container of their own.
PAGE = frozenset(("", "html", "body"))
_COPYRIGHT = re.compile(r"\s*(©|\(c\)\s|copyright\b)|.*\ball rights reserved\b", re.I | re.S)
COPYRIGHT_CHARS = 200
PIECE = 1 << 16


@dataclass(eq=False)
class Element:
    tag: str
    parent: Element | None
    left_out: bool
    article: bool
    share: float | None = None
    counts: bool = False
    #: The innermost form or named block that the element is or lies in.
    doubtful: Element | None = None
    #: The innermost open paragraph that a new one closes.
    paragraph: Element | None = None
    #: Places in page order: the element's own, and that of the last one inside it.
    place: int = 0
    last: int = 0

    def holds(self, other: Element) -> bool:
        return self.place <= other.place <= self.last


@dataclass
class Line:
    element: Element
    parts: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0

    def is_links(self) -> bool:
        """Whether over half of the characters are links, as in a menu."""
        return 2 * self.linked > sum(len("".join(part.split())) for part in self.parts)

    def text(self) -> str:
        return " ".join("".join(self.parts).split())

    def is_copyright(self) -> bool:
        text = self.text()
        return len(text) <= COPYRIGHT_CHARS and _COPYRIGHT.match(text) is not None


def _names(attrs: list[tuple[str, str | None]]) -> set[str]:
    values = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")).lower()
    return set(values.replace("_", "-").split())


def _is_no_content(name: str) -> bool:
    """Whether a name says that its block is no content: as a whole, or by the last word that says what it is."""
    if name in NOT_CONTENT:
        return True
    words = name.split("-")
    if ABOUT_OTHERS.intersection(words):
        return False
    while words and words[-1] in CONTAINERS:
        words.pop()
    return bool(words) and words[-1] in NOT_CONTENT


class LineReader(HTMLParser):
    """Turns parser events into lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Element("", None, False, False)
        #: All elements in page order, and the open ones by tag.
        self.elements = [self.root]
        self.named: dict[str, list[Element]] = {}
        self.lines: list[Line] = []
        self.line = Line(self.root)
        self.link = False
        #: Forms and named blocks, outer ones first.
        self.doubtful: list[Element] = []

    def break_line(self) -> None:
        if self.line.parts:
            self.lines.append(self.line)
            self.line = Line(self.open)
        else:
            self.line.element = self.open

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.line.tags += 1
        if tag == "a":
            self.link = any(k == "href" for k, _ in attrs)
        if tag in VOID:
            if tag in ("br", "hr"):
                self.line.parts.append(" ")
            return
        names = _names(attrs)
        in_article = self.open.article
        left_out = self.open.left_out or tag in LEFT_OUT or (tag == "header" and not in_article)
        named = tag not in UNNAMED and any(map(_is_no_content, names))
        share = NAMED_SHARE if named else FORM_SHARE if tag == "form" else None
        article = in_article or tag in ARTICLE or bool(names & ARTICLE_NAMES)
        if tag in INLINE and (share is None or self.open.left_out):
            return
        if tag == "p" and self.open.paragraph is not None:
            # A paragraph ends the one before it.
            self.leave(self.open.paragraph)
        element = Element(tag, self.open, left_out, article, share, place=len(self.elements))
        element.paragraph = element if tag == "p" else None if tag in SCOPES else self.open.paragraph
        element.doubtful = element if share is not None and not left_out else self.open.doubtful
        self.elements.append(element)
        self.named.setdefault(tag, []).append(element)
        self.open = element
        if element.doubtful is element:
            self.doubtful.append(element)
        self.break_line()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE:
            self.handle_endtag(tag)

    def leave(self, element: Element) -> None:
        """Close an open element and all that is open inside it."""
        at = self.open
        while at is not element.parent:
            self.named[at.tag].pop()
            at = at.parent
        self.open = at
        self.break_line()

    def close(self) -> None:
        super().close()
        self.break_line()
        for element in reversed(self.elements):
            element.last = max(element.last, element.place)
            if element.parent is not None:
                element.parent.last = max(element.parent.last, element.last)

    def handle_endtag(self, tag: str) -> None:
        self.line.tags += 1
        if tag == "a":
            self.link = False
        if self.named.get(tag):
            self.leave(self.named[tag][-1])

    def handle_data(self, data: str) -> None:
        if not self.line.parts:
            self.line.element = self.open
        self.line.parts.append(data)
        if self.link:
            self.line.linked += len("".join(data.split()))


def smoothed(ratios: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    return np.convolve(np.pad(ratios, REACH, mode="edge"), kernel / kernel.sum(), "valid")


def threshold(ratios: np.ndarray) -> float:
    """Half way between two cluster centres, moved until they stay."""
    low, high = float(ratios.min()), float(ratios.max())
    for _ in range(50):
        middle = (low + high) / 2
        above = ratios > middle
        if not above.any() or above.all():
            break
        moved = float(ratios[~above].mean()), float(ratios[above].mean())
        if moved == (low, high):
            break
        low, high = moved
    return (low + high) / 2


def _selected(lines: list[Line], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines look like content, and which of them are the core: those whose own ratio reaches the threshold."""
    ratios = sizes / np.maximum(1, [line.tags for line in lines])
    smooth = smoothed(ratios)
    least = threshold(smooth)
    chosen = (smooth >= least) & (sizes > 0)
    if not chosen.any():
        chosen = sizes > 0
    core = chosen & (ratios >= least)
    return chosen, core if core.any() else chosen


def _mass(elements: list[Element], lines: list[Line], sizes: np.ndarray) -> np.ndarray:
    """The characters in each element, those of the elements inside it included."""
    mass = np.zeros(len(elements))
    np.add.at(mass, [line.element.place for line in lines], sizes)
    for element in reversed(elements):
        if element.parent is not None:
            mass[element.parent.place] += mass[element.place]
    return mass


def _out(elements: list[Element]) -> np.ndarray:
    """Whether each element lies in something left out, forms and named blocks that count apart."""
    out = np.zeros(len(elements), bool)
    for e in elements:
        out[e.place] = e.left_out or (e.share is not None and not e.counts) or (e.parent is not None and out[e.parent.place])
    return out


def _count_blocks(reader: LineReader, lines: list[Line], sizes: np.ndarray) -> None:
    """Let forms and named blocks count that hold their share of the text, unless the page has an article outside.

    All lines weigh in that are not left out by their elements or links, selected or not: long comments are no article.
    """
    if not reader.doubtful:
        return
    mass = _mass(reader.elements, lines, np.where([line.element.left_out or line.is_links() for line in lines], 0.0, sizes))
    # Text of articles by the innermost doubtful block around it. Outer blocks come first, and once an outer one counts, the
    # articles directly in it lie outside all blocks that are still to come.
    articles = {line.element.doubtful for line in lines if line.element.article and not line.element.left_out}
    outside = None in articles
    for block in reader.doubtful:
        outer = block.parent.doubtful
        if mass[block.place] > block.share * mass[0] and (outer is None or outer.counts) and not outside:
            block.counts = True
            outside = block in articles


def _container(elements: list[Element], lines: list[Line], core: np.ndarray, others: np.ndarray) -> Element:
    """The innermost element around the core, widened while the element around it adds nothing but paragraphs.

    ``others`` marks the lines that must not be added.
    """
    count = _mass(elements, lines, core.astype(float))
    around = max((e for e in elements if count[e.place] == count[0]), key=lambda e: e.place)
    if around.tag in PARAGRAPH and around.parent is not None:
        around = around.parent
    foreign = _mass(elements, lines, others.astype(float))
    while around.parent is not None and around.parent.tag not in PAGE and foreign[around.parent.place] == foreign[around.place]:
        around = around.parent
    return around


def _kept(elements: list[Element], lines: list[Line], sizes: np.ndarray) -> np.ndarray:
    """Whether each line is in the article; lines of no size never are."""
    chosen, core = _selected(lines, sizes)
    links = np.array([line.is_links() for line in lines])
    places = np.array([line.element.place for line in lines])
    in_article = np.array([line.element.article for line in lines]) & (sizes > 0)
    core = core & ~links if (core & ~links).any() else core

    def between(marked: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(marked)
        span = np.zeros(len(lines), bool)
        span[at[0] : at[-1] + 1] = True
        return span

    rights = np.array([line.is_copyright() for line in lines])
    paragraph = np.array([line.element.tag in PARAGRAPH for line in lines])
    if 2 * sizes[chosen & in_article].sum() >= sizes[chosen].sum():
        return in_article | (between(in_article) & (chosen | paragraph) & ~links & ~rights)
    container = _container(elements, lines, core, (links | (sizes == 0) | rights | ~paragraph) & ~core)
    inside = (places >= container.place) & (places <= container.last)
    return inside & (core | (~links & ~rights & (chosen | between(core) | paragraph)))


def main_text(html: str) -> str:
    """The text of the page's article."""
    reader = LineReader()
    for start in range(0, len(html), PIECE):
        reader.feed(html[start : start + PIECE])
    reader.close()
    texts = [line.text() for line in reader.lines]
    lines = [(line, text) for line, text in zip(reader.lines, texts, strict=True) if text]
    if not lines:
        return ""
    held, shown = [line for line, _ in lines], [text for _, text in lines]
    length = np.array([len(text) for text in shown], float)
    _count_blocks(reader, held, length)
    # What is left out has no content characters, whatever its length.
    out = _out(reader.elements)
    sizes = np.where(out[[line.element.place for line in held]], 0.0, length)
    if not sizes.any():
        return ""
    kept = _kept(reader.elements, held, sizes) & (sizes > 0)
    return " ".join(text for text, keep in zip(shown, kept, strict=True) if keep)


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Replace the html of each page by its main text; other columns pass through."""
    if text in pages.columns:
        raise ValueError(f"column {text} exists already")
    at = pages.columns.index(html)
    rest = [i for i in range(len(pages.columns)) if i != at]
    schema = T.StructType([*[pages.schema.fields[i] for i in rest], T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            texts = pa.array([main_text(h or "") for h in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], texts], schema.names)

    return pages.mapInArrow(run, schema)


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length in code points."""
    found = extract(pages.select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
