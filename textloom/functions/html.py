"""Small HTML readers on the standard library parser; used inside Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser
from typing import NamedTuple

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Marks(NamedTuple):
    """What the open elements around a text say of it."""

    hidden: int  # open scripts and styles
    book: int  # number of the outermost open div.book-content, from 1
    pre: int  # number of the outermost open pre, from 1
    item: int  # open li.b_algo
    heading: int  # h2 open inside the outermost of these


class _Page(HTMLParser):
    """Collects text nodes with the marks of the open elements around them, and anchors.

    Every open element keeps the marks that hold inside it, so a text costs the same at any depth; an end tag is looked up
    by how many elements of its name are open, so one without a start costs nothing.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, Marks]] = []
        self.count: dict[str, int] = {}
        self.books = self.pres = 0
        self.texts: list[tuple[str, Marks]] = []
        self.anchors: list[tuple[str, str, bool]] = []
        self.hrefs: list[str] = []

    @property
    def marks(self) -> Marks:
        return self.open[-1][1] if self.open else Marks(0, 0, 0, 0, 0)

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            values = {k: v or "" for k, v in attrs}
            # In a result list: an anchor below h2 below li.b_algo.
            self.anchors.append((values.get("class", ""), values.get("href", ""), self.marks.heading > 0))
            if "href" in values:
                self.hrefs.append(values["href"])
        if tag in VOID:
            return
        m = self.marks
        if tag in ("script", "style"):
            m = m._replace(hidden=m.hidden + 1)
        elif tag == "pre":
            self.pres += 1
            m = m._replace(pre=m.pre or self.pres)
        elif tag == "h2" and m.item:
            m = m._replace(heading=m.heading + 1)
        elif tag in ("div", "li"):
            classes = next((v or "" for k, v in reversed(attrs) if k == "class"), "").split()
            if tag == "div" and "book-content" in classes:
                self.books += 1
                m = m._replace(book=m.book or self.books)
            elif tag == "li" and "b_algo" in classes:
                m = m._replace(item=m.item + 1)
        self.open.append((tag, m))
        self.count[tag] = self.count.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if not self.count.get(tag):
            return
        while True:
            name, _ = self.open.pop()
            self.count[name] -= 1
            if name == tag:
                return

    def handle_data(self, data):
        self.texts.append((data, self.marks))


def parse(html: str) -> _Page:
    page = _Page()
    page.feed(html)
    page.close()
    return page


def visible_text(html: str) -> str:
    """Text without scripts and styles; pieces between line breaks and double spaces joined by one space."""
    raw = "".join(t for t, m in parse(html).texts if not m.hidden)
    pieces = (piece.strip() for line in raw.splitlines() for piece in line.strip().split("  "))
    return " ".join(p for p in pieces if p)


def book_body(html: str) -> str:
    """Text of the first div.book-content, else of the first pre, else of the whole page."""
    page = parse(html)
    for number in (lambda m: m.book, lambda m: m.pre):
        # The first element of the kind that holds text; one inside another counts as the outer one.
        first = next((number(m) for _, m in page.texts if number(m)), 0)
        if first:
            return "".join(t for t, m in page.texts if number(m) == first)
    return "".join(t for t, _ in page.texts)


def anchors(html: str) -> list[tuple[str, str, bool]]:
    """(class, href, is a result heading) of every anchor in order."""
    return parse(html).anchors


def hrefs(html: str) -> list[str]:
    """Decoded target of every anchor that has one, however it is quoted, in order."""
    return parse(html).hrefs
