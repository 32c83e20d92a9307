"""Main text of pages: whole articles, linear time, densities against a plain version."""

from __future__ import annotations

import math
import time

import pytest

from factloom.llm import html_text
from factloom.llm.html_text import main_text

MENU = "<ul>" + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(6)) + "</ul>"
SOURCES = "<ul>" + "".join(f'<li><a href="/{i}">Source {i}</a></li>' for i in range(6)) + "</ul>"
SOURCE_LINES = "\n".join(f"Source {i}" for i in range(6))


def paragraphs(n: int, word: str = "para") -> str:
    return "".join(f"<p>{word} number {i} says a good deal about it.</p>" for i in range(n))


def lines(n: int, word: str = "para") -> str:
    return "\n".join(f"{word} number {i} says a good deal about it." for i in range(n))


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        (f"{MENU}<div>{paragraphs(6)}</div><div>{paragraphs(2, 'second')}</div>", lines(6) + "\n" + lines(2, "second")),
        (f"<div><section>{paragraphs(5)}</section><section>{paragraphs(3, 'other')}</section></div>", lines(5) + "\n" + lines(3, "other")),
        (f"<div><p>A lead.</p></div><div>{paragraphs(5)}</div>", "A lead.\n" + lines(5)),
        (f"<h1>Head</h1><div>{paragraphs(5)}</div>", "Head\n" + lines(5)),
        (f"<main><article>{paragraphs(5)}</article><article>{paragraphs(3, 'b')}</article>{MENU}</main>", lines(5) + "\n" + lines(3, "b")),
        (f"<header>Site</header><article><header><h1>Head</h1></header>{paragraphs(5)}</article>", "Head\n" + lines(5)),
        (f"<article><header><p>by someone</p></header>{paragraphs(5)}</article>", lines(5)),
        (f"<div>{paragraphs(5)}{SOURCES}</div>", lines(5) + "\n" + SOURCE_LINES),
        (f"<div>{paragraphs(5)}<h2>3 Comments</h2><p>No!</p><div><h3>x</h3><p>Yes</p></div></div>", lines(5)),
        (f"<div>{paragraphs(5)}<h3>Comments</h3><p>No!</p><h2>Method</h2><p>How it was done.</p></div>", lines(5) + "\nMethod\nHow it was done."),
        (f"Loose words. <a href='/'>Home</a><div>{paragraphs(5)}</div>", "Loose words. Home\n" + lines(5)),
    ],
)
def test_whole_article(body, expected):
    assert main_text(f"<html><body>{body}</body></html>") == expected


@pytest.mark.parametrize(
    "page",
    ["<i>" * 32000 + "</p>" * 32000, "<i><div>" + "<span>" * 32000 + "</i>" * 32000, "<p><div>" + "<i>" * 32000 + "<p>" * 32000,
     "<a " * 32000 + '"', '<a ">" ' * 32000 + '"', "<h1>" * 32000, "<td>" * 32000],
)
def test_malformed_pages_take_linear_time(page):
    def seconds(text):
        began = time.process_time()
        main_text(text)
        return time.process_time() - began

    assert seconds(page) < 5
    assert main_text(page + "<p>end</p>") is not None


def test_quotes_in_tags_end_where_the_value_ends():
    assert main_text("<body><p title=it's>one</p><p title='a > b'>two</p></body>") == "one\ntwo"


def plain_density(node, body):
    """The formula read off one node, its counts by recursion."""
    def counts(n, linked):
        linked = linked or n.tag == "a"
        c = t = lc = lt = 0
        for part in n.parts:
            if isinstance(part, str):
                size = len(part.replace(" ", "")) if part.strip() else 0
                c, lc = c + size, lc + (size if linked else 0)
            elif not part.dropped:
                below = counts(part, linked)
                c, t, lc, lt = c + below[0], t + 1 + below[1], lc + below[2], lt + below[3]
        return c, t, lc, lt + (n.tag == "a")

    c, t, lc, lt = counts(node, False)
    bc, _, blc, _ = counts(body, False)
    if not c:
        return 0.0
    t, lt = max(t, 1), max(lt, 1)
    base = math.log(c / max(c - lc, 1) * lc + blc / max(bc, 1) * c + math.e)
    return max(c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0)) / base, 0.0)


def test_densities_and_sums_agree_with_the_formula():
    page = f"<html><body>{MENU}<div>{paragraphs(4)}<p>With <a href='/'>a link</a> and <b>bold</b>.</p></div><table><tr><td>x<td>y</table></body></html>"
    root = html_text._tree(page)
    nodes = html_text._order(root)
    html_text._measure(nodes)
    body = next(n for n in nodes if n.tag == "body")
    for node in nodes:
        assert node.density == pytest.approx(plain_density(node, body))
        children = [p for p in node.parts if not isinstance(p, str) and not p.dropped]
        assert node.total == pytest.approx(sum(plain_density(p, body) for p in children) or plain_density(node, body))
    chosen, threshold = html_text._article(nodes)
    assert chosen.tag == "div" and chosen.density >= threshold
