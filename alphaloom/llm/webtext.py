"""Main text of web pages by text-to-tag ratio.

A streaming parser (the standard library's) turns a page into lines, one for
each block of text, while it reads. A line's ratio is its characters outside
links over the tags met since the line before. The ratios are smoothed by a
Gaussian, and a threshold parts lines of content from the rest. The runs of
content lines then name the page's content region: the article that holds most
of them, or else the innermost element around nearly all of them. All that the
region holds is its text, short lines between long ones too, but for what is
furniture by its element, role or class name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Smoothing: reach on both sides in lines, and standard deviation.
REACH, SIGMA = 2, 1.0
#: The innermost element with this share of the content lines' characters is the region.
REGION_SHARE = 0.9
#: A list or line whose characters stand in links to this share is a menu.
LINK_SHARE = 0.8
FEED = 1 << 16

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never content, wherever they stand.
UNSEEN = frozenset("applet audio button canvas datalist embed head iframe input math noembed noframes noscript object option script select style svg template textarea title video".split())
FURNITURE = frozenset("aside dialog fieldset footer form menu nav search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class names and ids; those of readers' comments hold for any size, others not for what holds most of the page.
COMMENT_WORDS = frozenset("comment comments commentlist disqus discussion replies respond".split())
NAME_WORDS = frozenset(
    "ad ads adslot adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer footer gdpr header login masthead menu "
    "modal nav navbar navigation newsletter notice notices outbrain pager pagination paywall popup promo promoted promotion recommended related share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription taboola teaser toolbar topbar widget".split()
)
#: What closes an open element of the same parent when it begins: elements whose end tag may be left out.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"},
}
SCOPES = frozenset("article aside body div footer form header html main nav ol section table ul".split())
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def name_words(attrs: dict[str, str | None]) -> set[str]:
    """Lower-case words of an element's class and id: ``navBar-top`` has nav, bar and top, and navbar."""
    names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
    whole = re.split(r"[^A-Za-z]+", names)
    return {w.lower() for w in whole if w} | {w.lower() for w in _PIECES.findall(names)}


@dataclass(eq=False, slots=True)
class Element:
    """An open or closed block element: what it is, what it is in, and how much text it holds."""

    tag: str
    parent: Element | None
    kind: str = ""
    chars: int = 0
    linked: int = 0
    mass: float = 0.0
    long_lines: int = 0

    def around(self) -> Iterator[Element]:
        at: Element | None = self
        while at is not None:
            yield at
            at = at.parent


@dataclass(slots=True)
class Line:
    """One block of text: where it stands, its characters in links and the tags since the line before."""

    text: str
    place: Element
    linked: int
    tags: int

    @property
    def ratio(self) -> float:
        return (len(self.text) - self.linked) / self.tags

    def within(self, *tags: str) -> Element | None:
        """The outermost element of these tags around the line."""
        return ([e for e in self.place.around() if e.tag in tags] or [None])[-1]


class LineParser(HTMLParser):
    """Lines of a page, made while the parser reads; memory goes by the open elements and the text found."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("html", None)
        self.top, self.lines = self.root, []
        self.unseen: list[str] = []
        self.parts: list[str] = []
        self.tags, self.linked, self.link = 0, 0, None

    def updatepos(self, i: int, j: int) -> int:
        """Line and column are not kept."""
        return j

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.top, min(self.linked, len(text)), max(1, self.tags)))
            for e in self.top.around():
                e.chars += len(text)
                e.linked += min(self.linked, len(text))
            self.tags = 0
        self.parts, self.linked = [], 0

    def close_to(self, element: Element) -> None:
        """Close all that is open above ``element``, and it."""
        self.flush()
        self.top = element.parent or self.root
        if self.link is not None and element in self.link.around():
            self.link = None

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.unseen:
            if tag == self.unseen[0]:
                self.unseen.append(tag)
            if tag not in ("body", "article", "main") or self.unseen[0] != "head":
                return
            self.unseen.clear()
        self.tags += 1
        if tag in UNSEEN:
            if tag in BLOCKS:
                self.flush()
            if tag not in VOID:
                self.unseen = [tag]
            return
        if tag == "a":
            self.link = self.top
        elif tag in ("br", "wbr", "img"):
            self.parts.append(" " if tag == "br" else "")
        elif tag in BLOCKS:
            self.flush()
            if tag in VOID or tag == "html":
                return
            closing = CLOSES.get(tag, ())
            for e in self.top.around():
                if e.tag == "p" or e.tag in closing:
                    self.close_to(e)
                if e.tag in SCOPES:
                    break
            self.top = Element(tag, self.top, self.kind_of(tag, dict(attrs)))

    def kind_of(self, tag: str, attrs: dict[str, str | None]) -> str:
        """``furniture``, ``comments``, ``named`` (furniture by its name alone) or nothing."""
        if tag in FURNITURE or tag == "header" and not any(e.tag in ("article", "main") for e in self.top.around()):
            return "furniture"
        if not attrs:
            return ""
        hidden = "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or _HIDING.search(attrs.get("style") or "")
        if hidden or (attrs.get("role") or "").lower() in ROLES:
            return "furniture"
        if tag in ("html", "body", "main", "h1", "h2", "h3", "h4", "h5", "h6"):
            return ""
        words = name_words(attrs)
        if words & COMMENT_WORDS:
            return "comments"
        return "named" if words & NAME_WORDS and tag != "article" else ""

    def handle_endtag(self, tag: str) -> None:
        if self.unseen:
            if tag == self.unseen[-1]:
                self.unseen.pop()
            return
        self.tags += 1
        if tag == "a":
            self.link = None
        elif tag == "br":
            self.parts.append(" ")
        elif tag in BLOCKS:
            self.flush()
            for e in self.top.around():
                if e.tag == tag and e is not self.root:
                    self.close_to(e)
                    break
                if tag in ("p", "li", "td", "th", "tr", "dd", "dt") and e.tag in SCOPES and not (tag in ("td", "th", "tr") and e.tag != "table"):
                    break

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.parts.append(data)
            if self.link is not None:
                self.linked += len(data.strip())

    def read(self, html: str) -> list[Line]:
        for at in range(0, len(html), FEED):
            self.feed(html[at : at + FEED])
        self.close()
        self.flush()
        return self.lines


def smooth(ratios: np.ndarray) -> np.ndarray:
    """Gaussian mean of each ratio and its neighbours; at the ends over those that there are."""
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    full = np.convolve(ratios, kernel)[REACH : REACH + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[REACH : REACH + len(ratios)]


def _furniture(line: Line, whole: float) -> bool:
    """In an element that is furniture; one that only its name calls so must not wrap most of the page's content."""
    for e in line.place.around():
        if e.kind in ("furniture", "comments") or e.kind == "named" and not (e.mass > whole / 2 and e.long_lines > 2):
            return True
        if e.tag in ("ul", "ol", "dl", "table", "tr") and e.linked > LINK_SHARE * e.chars:
            return True
    return False


def _tagged_region(content: list[Line], free: list[Line]) -> Element | None:
    """The article, or else the main element, that holds most content (none has any: most text)."""
    for tag in ("article", "main"):
        for lines in (content, free):
            held: dict[Element, int] = {}
            for line in lines:
                if (e := line.within(tag)) is not None:
                    held[e] = held.get(e, 0) + len(line.text) - line.linked
            if held:
                return max(held, key=held.get)
    return None


def _untagged_lines(lines: list[Line], free: list[Line], content: list[Line], threshold: float) -> list[Line]:
    """Lines of the innermost element around nearly all content: content runs, and text blocks that stand beside them.

    Smoothing lifts lines next to long ones; bare text outside a text block stays only from the first to the last line that is long itself.
    """
    *_, whole = lines[0].place.around()
    region = whole
    for e in reversed(list(max(content, key=lambda x: len(x.text)).place.around())):
        if e.mass >= REGION_SHARE * whole.mass and e.tag in SCOPES:
            region = e
    homes = {x.place.parent if x.place.tag not in SCOPES else x.place for x in content}
    runs = {id(x) for x in content}
    own = [i for i, x in enumerate(lines) if id(x) in runs and x.ratio >= threshold]
    between = {id(x) for x in lines[min(own, default=0) : max(own, default=-1) + 1]}
    return [
        x
        for x in free
        if any(e is region for e in x.place.around())
        and (id(x) in runs and id(x) in between or x.place.tag not in SCOPES and x.place.parent in homes and x.linked <= LINK_SHARE * len(x.text))
    ]


def main_text(html: str | None) -> str:
    """The main text of one page, its blocks joined by an empty line; empty if the page has none."""
    parser = LineParser()
    lines = parser.read(html or "")
    free = [x for x in lines if not any(e.kind in ("furniture", "comments") for e in x.place.around())]
    if not free:
        return ""
    ratios = smooth(np.array([x.ratio for x in lines]))
    threshold = float(np.std(ratios)) if len(ratios) > 2 else 0.0
    high = {id(x) for x, r in zip(lines, ratios, strict=True) if r >= threshold and x.linked <= LINK_SHARE * len(x.text)}
    content = [x for x in free if id(x) in high]
    for line in content:
        for e in line.place.around():
            e.mass += len(line.text) - line.linked
            e.long_lines += 1
    region = _tagged_region(content, free)
    if region is not None:
        held = [x for x in free if any(e is region for e in x.place.around())]
    else:
        held = _untagged_lines(lines, free, content, threshold) if content else []
    return "\n\n".join(x.text for x in held if not _furniture(x, parser.root.mass))


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, from its whole html.

    Null and empty pages, and pages that hold furniture only, have an empty text;
    repeated rows are read row by row; null ids and urls stay null; other columns
    are ignored; an empty table gives an empty result. Pages of any length are
    read whole. A narrow map: no shuffle, one batch in memory at a time.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [main_text(h.as_py()) for h in batch.column("html")]
                columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
