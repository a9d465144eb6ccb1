"""The HTML readers against plain walks over all open elements, and their time on deep pages."""

import random
import time
from html.parser import HTMLParser

import pytest

from textloom.functions import html


class Chains(HTMLParser):
    """Every text with the whole chain of open elements around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.texts, self.anchors, self.made = [], [], [], 0

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        if tag == "a":
            items = [i for i, (t, a, _) in enumerate(self.open) if t == "li" and "b_algo" in a.get("class", "").split()]
            below = bool(items) and any(t == "h2" for t, _, _ in self.open[items[0] + 1 :])
            self.anchors.append((values.get("class", ""), values.get("href", ""), below))
        if tag not in html.VOID:
            self.made += 1
            self.open.append((tag, values, self.made))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.texts.append((data, list(self.open)))


def walk(page):
    w = Chains()
    w.feed(page)
    w.close()
    shown = "".join(t for t, path in w.texts if not any(e[0] in ("script", "style") for e in path))
    pieces = [p.strip() for line in shown.splitlines() for p in line.strip().split("  ")]

    def body(wanted):
        first = next((e[2] for _, path in w.texts for e in path if wanted(e)), None)
        return None if first is None else "".join(t for t, path in w.texts if any(e[2] == first for e in path))

    book = body(lambda e: e[0] == "div" and "book-content" in e[1].get("class", "").split())
    book = body(lambda e: e[0] == "pre") if book is None else book
    return " ".join(p for p in pieces if p), "".join(t for t, _ in w.texts) if book is None else book, w.anchors


PARTS = [
    "text ", "\n", "two  words", "<p>", "</p>", "<div>", "</div>", '<div class="x book-content">', "<pre>", "</pre>", '<li class="b_algo">', "<li>", "</li>", "<h2>", "</h2>",
    '<a href="/u?q=1&amp;r">', "</a>", "<br>", "<script>var a = '<p>';</script>", "<style>p{}</style>", "&amp;", "<!-- c -->", "</nothing>", '<a class="result__a" href="h">', "<b", "<",
]


@pytest.mark.parametrize("seed", range(200))
def test_readers_equal_a_walk_over_all_open_elements(seed):
    rng = random.Random(seed)
    page = "".join(rng.choice(PARTS) for _ in range(rng.randrange(60)))
    text, book, anchors = walk(page)
    assert html.visible_text(page) == text and html.book_body(page) == book and html.anchors(page) == anchors


@pytest.mark.parametrize("part", ["<p>x", '<li class="b_algo"><h2><a href="u">x', "x</div>", "<div>x</p>"])
def test_deep_pages_take_linear_time(part):
    start = time.perf_counter()
    page = part * (100_000 // part.count("<"))
    html.visible_text(page), html.book_body(page), html.anchors(page)
    assert time.perf_counter() - start < 8
