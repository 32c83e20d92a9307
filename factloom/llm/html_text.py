"""Main text of web pages by composite text density.

Every element of a page gets a density: characters per tag, lowered by the share of link characters
and link tags below it. The density sum of an element adds up the densities of its children. The
subtree with the greatest sum, among elements at least as dense as the sparsest element on the path
from it up to ``body``, holds the article; it is widened to an enclosing ``article`` or ``main``.
Elements that are never article text (scripts, menus, forms, adverts, comments and the like, by tag,
role, class or id) are taken out before densities are counted. A class or id counts by its whole name,
and not where the element wraps the article: see :func:`_drop_named`. A header inside an ``article`` or
``main`` stays if it holds a heading. Readers' comments without a telling name go by their heading.

Work is linear in the length of a page, whatever its tags: open elements are kept by tag with their depths,
so a tag that closes nothing costs nothing.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_TOKEN = re.compile(r"[^\W\d_]+")

RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
NEVER = RAW | frozenset("head nav header footer aside form button select option input fieldset dialog menu svg canvas object audio video map".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NEVER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense banner sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus "
    "breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets notice notices cookie cookies consent gdpr popup modal overlay newsletter "
    "subscribe subscription signup login form share sharing social related recommended comment comments disqus discussion replies reply respond copyright pagination pager toolbar skip".split()
)
#: Names of what readers write; such a part may well be longer than the article.
READER_NAMES = frozenset("comment comments disqus discussion replies reply respond".split())
#: Words after a name that still say that the element is that part of a page, and words before it that say what a page has.
PART_WORDS = frozenset("area bar block box button buttons container inner item items link links list section slot unit wrap wrapper".split())
STATE_WORDS = frozenset("has have no not non with without is hide show hidden".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that hold running text, so that a block with one of them is text and not a control or a label.
PROSE = HEADINGS | frozenset("p blockquote pre ol ul dl table".split())
_READERS = re.compile(
    r"(?:(?:readers?'?s? )?comments?|\d+ (?:comments?|replies|reply|responses?)|comments? ?\(\d+\)|(?:leave|post|add) a (?:comment|reply)"
    r"|(?:\d+ )?(?:kommentare?|commentaires?|comentarios?))[:.]?", re.I)
_CLOSES = {
    "p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}), "body": frozenset({"head"}),
}
_STOPS = frozenset("ul ol dl table td th tr div section article main body blockquote".split())
_END_P = frozenset(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)


class _Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "name", "inside", "prose", "articles", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: _Node | None, dropped: bool, name: str | None = None):
        self.tag, self.parent, self.dropped, self.name = tag, parent, dropped, name
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.prose = False
        self.parts: list[_Node | str] = []


def _name(value: str) -> str | None:
    """The name in ``NEVER_NAMES`` that is a whole class or id of a value, or its last part but for ``PART_WORDS``."""
    for whole in value.split():
        parts = _TOKEN.findall(whole)
        while len(parts) > 1 and parts[-1] in PART_WORDS:
            parts.pop()
        if parts and parts[-1] in NEVER_NAMES and STATE_WORDS.isdisjoint(parts):
            return parts[-1]
    return None


def _never(tag: str, attrs: str) -> tuple[bool, str | None]:
    """Whether an element is out by tag, role or being hidden, and else its telling name, if any."""
    if tag in NEVER:
        return True, None
    if tag in ("html", "body", "article", "main") or not attrs or "=" not in attrs and "hidden" not in attrs:
        return False, None
    found = None
    for name, *values in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id"):
            found = found or _name(value)
        if name == "role" and value.strip() in NEVER_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, None
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True, None
    return False, found


def _tree(page: str) -> _Node:
    """The elements of a page; forgiving: unclosed and stray tags are closed or passed over."""
    root = _Node("#", None, False)
    stack = [root]
    # Depths of the open elements by tag.
    depths: dict[str, list[int]] = {}
    at, end = 0, len(page)

    def last(tag: str) -> int:
        own = depths.get(tag)
        return own[-1] if own else 0

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            depths[stack.pop().tag].pop()

    while at < end:
        found = _MARKUP.search(page, at)
        if found is None:
            stack[-1].parts.append(page[at:])
            break
        if found.start() > at:
            stack[-1].parts.append(page[at : found.start()])
        at = found.end()
        tag = found["tag"]
        if tag is None:
            if found["cdata"]:
                stack[-1].parts.append(html.escape(found["cdata"]))
            continue
        tag = tag.lower()
        if found["close"]:
            depth = last(tag)
            if depth and not (tag in INLINE and any(last(stop) > depth for stop in _STOPS)):
                close_to(depth)
            continue
        closes = _CLOSES.get(tag) or (_CLOSES["p"] if tag in _END_P else None)
        if tag in _END_P and closes is not _CLOSES["p"]:
            closes = closes | _CLOSES["p"]
        if closes and any(last(t) for t in closes):
            wall = max(last(stop) for stop in _STOPS - closes)
            above = [own[bisect_right(own, wall)] for own in (depths.get(t) for t in closes) if own and own[-1] > wall]
            if above:
                close_to(min(above))
        node = stack[-1]
        out, name = _never(tag, found["attrs"] or "")
        out = out and not (tag == "header" and node.inside)
        child = _Node(tag, node, node.dropped or out, "header" if tag == "header" and not out else name)
        node.parts.append(child)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if not (found["attrs"] or "").rstrip().endswith("/") or tag not in ("svg", "path"):
            depths.setdefault(tag, []).append(len(stack))
            stack.append(child)
    return root


def _order(root: _Node) -> list[_Node]:
    """All kept elements, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(p for p in reversed(node.parts) if isinstance(p, _Node) and not p.dropped)
    return out


def _drop_named(root: _Node) -> None:
    """Drops elements by class or id, but those that wrap the article.

    An element stays if it holds most of the text of the body (readers' comments excepted) and no
    ``article`` or ``main`` stands apart from it, or if it holds one and there is none outside of
    named elements. A header in an ``article`` or ``main`` stays if it holds a heading.
    """
    nodes = _order(root)
    if not any(n.name for n in nodes):
        return
    for node in reversed(nodes):
        node.chars, node.articles = 0, int(node.tag in ("article", "main"))
        node.prose = node.tag in HEADINGS
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len(part) - part.count(" ") if part.strip() else 0
            elif not part.dropped:
                node.chars += part.chars
                node.articles += part.articles
                node.prose = node.prose or part.prose
    body = next((n for n in nodes if n.tag == "body"), root)
    # Articles by the nearest named element around them.
    direct: dict[_Node | None, int] = {}
    todo: list[tuple[_Node, _Node | None]] = [(root, None)]
    while todo:
        node, around = todo.pop()
        if node.tag in ("article", "main"):
            direct[around] = direct.get(around, 0) + 1
        if node.name:
            around = node
        todo.extend((p, around) for p in node.parts if isinstance(p, _Node) and not p.dropped)
    free = direct.get(None, 0)
    walk = [(root, 0)]
    while walk:
        node, above = walk.pop()
        if node.name:
            most = 2 * node.chars > body.chars and node.name not in READER_NAMES
            heads = node.name == "header" and node.inside and node.prose
            if not (heads or most and free == above or node.articles and not free):
                node.dropped = True
                continue
            free += direct.get(node, 0)
        above += node.tag in ("article", "main")
        walk.extend((p, above) for p in reversed(node.parts) if isinstance(p, _Node) and not p.dropped)


def _heading_text(node: _Node, most: int = 64) -> str:
    """The text of a heading, empty if it has more than ``most`` pieces or characters."""
    out: list[str] = []
    todo: list[_Node | str] = [node]
    seen = length = 0
    while todo:
        part = todo.pop()
        seen += 1
        if isinstance(part, str):
            out.append(part)
            length += len(part)
        elif not part.dropped:
            if len(part.parts) > most:
                return ""
            todo.extend(reversed(part.parts))
        if seen > most or length > most:
            return ""
    return " ".join(html.unescape("".join(out)).split())


def _drop_readers(nodes: list[_Node]) -> None:
    """Drops readers' comments under a heading that says so, up to the next heading of its rank or above, or the parent's end."""
    for node in nodes:
        rank = None
        for part in node.parts:
            if isinstance(part, str):
                continue
            if part.tag in HEADINGS and (rank is None or part.tag <= rank):
                rank = part.tag if not part.dropped and _READERS.fullmatch(_heading_text(part)) else None
            if rank is not None:
                part.dropped = True


def _measure(nodes: list[_Node]) -> None:
    for node in reversed(nodes):
        chars = tags = link_chars = link_tags = 0
        node.prose = node.tag in PROSE
        for part in node.parts:
            if isinstance(part, str):
                chars += len(part) - part.count(" ") if part.strip() else 0
            elif not part.dropped:
                chars += part.chars
                tags += part.tags + 1
                link_chars += part.link_chars
                link_tags += part.link_tags
                node.prose = node.prose or part.prose
        if node.tag == "a":
            link_chars, link_tags = chars, link_tags + 1
        node.chars, node.tags, node.link_chars, node.link_tags = chars, tags, link_chars, link_tags
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    whole = body.link_chars / max(body.chars, 1)
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
        if not c:
            node.density = 0.0
            continue
        base = math.log(c / max(c - lc, 1) * lc + whole * c + math.e)
        ratio = c / max(lc, 1) * t / lt
        node.density = max(c / t * math.log(max(ratio, 1.0)) / base, 0.0)
    for node in nodes:
        node.total = sum(p.density for p in node.parts if isinstance(p, _Node) and not p.dropped)
        if not node.total:
            node.total = node.density


def _path(node: _Node) -> list[_Node]:
    out = [node]
    while node.tag != "body" and node.parent is not None:
        node = node.parent
        out.append(node)
    return out


def _article(nodes: list[_Node]) -> tuple[_Node, float]:
    """The subtree with the greatest density sum at or above the threshold, and the threshold."""
    blocks = [n for n in nodes if n.tag not in INLINE] or nodes
    first = max(blocks, key=lambda n: n.total)
    threshold = min(n.density for n in _path(first) if n.tag not in ("#", "html")) if first.tag not in ("#", "html") else 0.0
    return max((n for n in blocks if n.density >= threshold), key=lambda n: n.total, default=first), threshold


def _links(node: _Node) -> bool:
    """A block in which links hold most of the text, such as a menu without a telling name."""
    return node.tag in ("ul", "ol", "div", "section", "table") and node.link_tags >= 3 and node.link_chars >= 0.7 * node.chars


def _drop_links(node: _Node) -> None:
    """Drops blocks of links below ``node`` that lie outside of an ``article``; inside, they are lists of sources."""
    todo = [node]
    while todo:
        now = todo.pop()
        for part in now.parts:
            if isinstance(part, _Node) and not part.dropped and part.tag != "article":
                if _links(part):
                    part.dropped = True
                else:
                    todo.append(part)


def _widen(chosen: _Node, threshold: float) -> _Node:
    """The element to read, with what does not belong to the article dropped below it.

    That is the outermost ``main`` around the chosen subtree, else the outermost ``article``. Without
    either it is ``body``, and of each block beside the path to the subtree stays what is not mostly
    links and has running text (paragraphs, headings, quotes, lists, tables) or reaches the threshold;
    loose text between blocks stays unless half of it is links. Blocks of links stay in an ``article``
    and in a chosen subtree below ``body``.
    """
    path = _path(chosen)
    for tag in ("main", "article"):
        found = [n for n in path if n.tag == tag]
        if found:
            if tag == "main" and any(isinstance(p, _Node) and not p.dropped and p.tag == "article" for p in _order(found[-1])[1:]):
                _drop_links(found[-1])
            return found[-1]
    if chosen is path[-1]:
        _drop_links(chosen)
        return chosen
    for node in path[:-1]:
        run: list[_Node | str] = []
        kept: list[_Node | str] = []

        def close(run: list[_Node | str], kept: list[_Node | str]) -> None:
            nodes = [p for p in run if isinstance(p, _Node) and not p.dropped]
            chars = sum(n.chars for n in nodes) + sum(len(p) - p.count(" ") for p in run if isinstance(p, str) and p.strip())
            if 2 * sum(n.link_chars for n in nodes) < chars:
                kept.extend(run)
            run.clear()

        for part in node.parent.parts:
            if isinstance(part, str) or part.tag in INLINE and part is not node:
                run.append(part)
                continue
            close(run, kept)
            if part is node:
                kept.append(part)
            elif not part.dropped and 2 * part.link_chars < part.chars and (part.prose or part.density >= threshold):
                _drop_links(part)
                kept.append(part)
        close(run, kept)
        node.parent.parts = kept
    return path[-1]


def _blocks(chosen: _Node) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        words = html.unescape("".join(run)).split() if run else ()
        if words:
            out.append(" ".join(words))
        run.clear()

    todo: list[_Node | str | None] = [chosen]
    while todo:
        part = todo.pop()
        if part is None:
            close()
        elif isinstance(part, str):
            run.append(part)
        elif part.dropped:
            if part.tag not in INLINE:
                close()
        elif part.tag == "br":
            run.append(" ")
        elif part.tag in INLINE:
            todo.extend(reversed(part.parts))
        else:
            close()
            todo.append(None)
            todo.extend(reversed(part.parts))
    close()
    return out


def main_text(page: str | None) -> str:
    """The article of one page, a line per block; empty for null, empty or textless pages."""
    if not page:
        return ""
    root = _tree(page)
    _drop_named(root)
    _drop_readers(_order(root))
    nodes = _order(root)
    _measure(nodes)
    return "\n".join(_blocks(_widen(*_article(nodes))))


@F.pandas_udf(StringType())
def _main_texts(pages: pd.Series) -> pd.Series:
    return pages.map(main_text, na_action=None)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages(page_id, url, html)``, without a shuffle.

    ``n_chars`` counts code points. Null html gives the empty text; ids and urls are carried as they
    are (null included), repeated rows are extracted once each, other columns are not read. A very long
    or malformed page takes time and memory in proportion to its length.
    """
    rows = pages.select("page_id", "url", _main_texts("html").alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
