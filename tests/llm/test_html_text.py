"""Selection of content lines, and the single passes over elements against walks to the root."""

import random
import time

import numpy as np
import pytest

from tidewarden.llm import html_text

A = "aaaa " * 100
SHORT = "A short line."


def text(html):
    return html_text.main_text(html).replace(A.strip(), "A")


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f'<div id=c><p>{A}</p></div><div class="advert-block">Buy now</div>', "A"),
        (f'<div id=c><p>{A}</p></div><div class="site-notice">We use cookies</div>', "A"),
        (f'<div id=c><p>{A}</p></div><div class="user-comments">{A * 3}</div>', "A"),
        (f"<div id=c><p>{A}</p></div><div>Copyright 2024 X</div><div>© y</div><p>Z. All rights reserved.</p>", "A"),
        (f"<article><p>{A}</p></article><div>© 2024</div><div>{SHORT}</div>", "A"),
        (f"<article><p>{A}</p><p>© is a sign.</p></article>", "A © is a sign."),
        (f"<div><div><h1>T</h1><p>{A}</p><p>{SHORT}</p><div>odd note</div></div><div>Some words beside</div></div>", f"T A {SHORT}"),
        (f'<div class="no-comments"><p>{A}</p></div><div class="comments-list-box"><p>{SHORT}</p></div>', "A"),
        (f'<div class="post-block"><p>{A}</p></div>', "A"),
        (f"<body><div>Home page</div><p>{A}</p><div>{SHORT}</div><p>{A}</p></body>", f"A {SHORT} A"),
    ],
)
def test_lines_that_count(html, want):
    assert text(html) == want


def test_the_clustering_decides(monkeypatch):
    """Taking every line as content, or the longest only, gives other texts."""
    pages = [
        f"<body><div>Home page</div><div><p>{A}</p><div>{SHORT}</div><p>{A}</p></div><div>Some words beside</div></body>",
        f"<body><div>{A}x</div><div>{A}</div><div>Some words beside</div></body>",
    ]
    own = [html_text.main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "_selected", lambda lines, sizes: (sizes > 0, sizes > 0))
    every = [html_text.main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "_selected", lambda lines, sizes: (sizes == sizes.max(), sizes == sizes.max()))
    longest = [html_text.main_text(p) for p in pages]
    assert all(a != b for a, b in zip(own, every, strict=True)) and own[1] != longest[1]


@pytest.mark.parametrize("html", ["<div>x" * 60_000, "<x>" * 60_000 + "<p>a</p>" * 40_000 + "</q>" * 40_000, "<form>t" * 40_000, "<p>t<div class=ad>" * 30_000])
def test_deep_pages_take_time_in_proportion(html):
    begin = time.process_time()
    html_text.main_text(html[: len(html) // 4])
    part = time.process_time() - begin
    begin = time.process_time()
    html_text.main_text(html)
    assert time.process_time() - begin < 12 * part + 0.5


def chain(element):
    while element is not None:
        yield element
        element = element.parent


def random_page():
    tags = ["div", "p", "ul", "li", "section", "article", "form", "x", "b", "a href=/l", "div class=ad", "div class=user-comments", "nav"]
    parts = []
    for _ in range(random.randrange(60)):
        roll = random.random()
        tag = random.choice(tags)
        parts.append(f"<{tag}>" if roll < 0.45 else f"</{tag.split()[0]}>" if roll < 0.7 else random.choice(("word ", A, SHORT)))
    return "".join(parts)


def test_single_passes_are_walks_to_the_root():
    random.seed(6)
    for _ in range(400):
        reader = html_text.LineReader()
        reader.feed(random_page())
        reader.close()
        lines = [line for line in reader.lines if line.text()]
        if not lines:
            continue
        sizes = np.array([len(line.text()) for line in lines], float)
        html_text._count_blocks(reader, lines, sizes)
        out = html_text._out(reader.elements)
        mass = html_text._mass(reader.elements, lines, sizes)
        assert [e.place for e in reader.elements] == list(range(len(reader.elements)))
        for e in reader.elements:
            assert out[e.place] == any(x.left_out or (x.share is not None and not x.counts) for x in chain(e))
            assert mass[e.place] == sum(n for line, n in zip(lines, sizes, strict=True) if any(x is e for x in chain(line.element)))
            assert all(e.holds(x) == any(y is e for y in chain(x)) for x in reader.elements)
        core = np.array([random.random() < 0.5 for _ in lines])
        if core.any():
            around = [list(chain(line.element)) for line, c in zip(lines, core, strict=True) if c]
            innermost = next(e for e in around[0] if all(any(e is x for x in other) for other in around))
            if innermost.tag in html_text.PARAGRAPH and innermost.parent is not None:
                innermost = innermost.parent
            assert html_text._container(reader.elements, lines, core, np.ones(len(lines), bool)).holds(innermost)


def test_blocks_that_count_are_those_of_the_slow_rule():
    """Each doubtful block by definition: enough of the text, nothing around it is out, no article outside has text."""
    random.seed(7)
    for _ in range(400):
        reader = html_text.LineReader()
        reader.feed(random_page())
        reader.close()
        lines = [line for line in reader.lines if line.text()]
        sizes = np.array([0.0 if line.element.left_out or line.is_links() else len(line.text()) for line in lines])
        html_text._count_blocks(reader, lines, np.array([float(len(line.text())) for line in lines]))
        got = [b.counts for b in reader.doubtful]
        for b in reader.doubtful:
            b.counts = False
        is_out = lambda e: any(x.left_out or (x.share is not None and not x.counts) for x in chain(e))
        for b in reader.doubtful:
            own = sum(n for line, n in zip(lines, sizes, strict=True) if any(x is b for x in chain(line.element)))
            if own > b.share * sizes.sum() and not is_out(b.parent):
                b.counts = not any(line.element.article and not is_out(line.element) and not b.holds(line.element) for line in lines)
        assert got == [b.counts for b in reader.doubtful]
