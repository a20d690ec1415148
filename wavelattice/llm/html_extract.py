"""Main text of web pages by tree scoring.

Each page is read into a tree of elements with the usual rules for unclosed
paragraphs, list items and cells. Elements that are boilerplate by their tag
or role, or by a class or id that names one (menus, notices, adverts,
comments, ...), are left out with all they hold; an element that is so only by
its class or id stays if it holds a main element, a heading of the first level
or an article that is not so itself (a page's wrapper "with-sidebar", say).

Each paragraph then passes points to its ancestors: one, one more for each
comma and for each hundred characters (three at most); the parent gets all,
the grandparent half, the next one a third and so on for LEVELS levels. A
container's points are discounted by its link density. The best container is
kept, wherever it lies; one that holds all the text of its parent first gives
way to the parent, so that siblings of wrappers count too. Its siblings are
kept if their points reach a fifth of its own, or if they are blocks of any
kind with few links: less than a quarter of a long one's text, none in a short
one or, inside an article or main element, less than half.

Character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by one newline in page order. Null, empty
and text-free pages give an empty text; broken markup is read as far as it
goes. Nothing is capped. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
OUT = frozenset(
    "script style noscript template iframe object svg canvas audio video nav header footer aside form button select textarea input "
    "fieldset menu dialog head title map".split()
)
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre address hr center details summary hgroup figure figcaption".split()
)
PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article".split())
LEVELS = 16
SHORT = 80
# An opening tag closes these open elements, up to the nearest of the given borders.
CLOSES = {t: ({"p"}, frozenset("button td th table body".split())) for t in BLOCK - {"html", "body"}}
CLOSES["li"] = ({"p", "li"}, frozenset("ul ol menu".split()))
CLOSES["dt"] = CLOSES["dd"] = ({"p", "dt", "dd"}, frozenset(["dl"]))
CLOSES["tr"] = ({"p", "tr", "td", "th"}, frozenset(["table"]))
CLOSES["td"] = CLOSES["th"] = ({"p", "td", "th"}, frozenset(["tr", "table"]))
CLOSES["option"] = ({"option"}, frozenset(["select"]))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())

UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|pager|pagination|footer|foot|header|masthead|"
    r"side-?bar\w*|aside|widget\w*|related|recommend\w*|comments?|commentlist|discuss\w*|disqus|respon[sd]\w*|repl(?:y|ies)|cookies?|consent|gdpr|notices?|"
    r"notification|popup|pop-?over|modal|overlay|share|sharing|social|subscribe|newsletter|signup|login|search\w*|toolbar|skip\w*|hidden|copyright|"
    r"tags?|toc)(?=$|[\s_\d-])",
    re.I,
)
_STRONG = re.compile(r"comment|side-?bar|footer|header|nav", re.I)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|content|main|body|post|entry|story|text|page)(?=$|[\s_\d-])", re.I)

_COMMENT = re.compile(r"<!--(?:>|->|.*?--!?>|.*\Z)", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>")
_OTHER = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)?([^>]*+)>")  # a declaration, or a tag with a quote that never ends
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I | re.S)
_HIDE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")


# Elements that implied ends look at, and those beyond which an inline end tag has no effect.
STRUCTURE = BLOCK | {"option", "select", "button", "menu"}
SCOPES = frozenset("td th table body".split())


class Node:
    """An element: children are nodes or text; ``out`` marks boilerplate, ``named`` that only a name says so.

    ``block`` is the nearest structural element, the node itself included.
    """

    __slots__ = ("block", "children", "links", "named", "out", "parent", "points", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, out: bool, named: bool):
        self.tag, self.parent, self.out, self.named = tag, parent, out, named
        self.block = self if parent is None or tag in STRUCTURE else parent.block
        self.children: list[Node | str] = []
        self.points, self.size, self.links = 0.0, 0, 0


class _Open:
    """The chain of open elements, with the number of each kind in all and in the innermost scope."""

    def __init__(self, root: Node):
        self.here, self.root = root, root
        self.total: Counter[str] = Counter()
        self.scopes: list[Counter[str]] = [Counter()]

    def push(self, node: Node) -> None:
        self.here = node
        self.total[node.tag] += 1
        if node.tag in SCOPES:
            self.scopes.append(Counter())
        else:
            self.scopes[-1][node.tag] += 1

    def pop(self, node: Node) -> None:
        """Close ``node`` and all that is open inside it."""
        while True:
            x = self.here
            self.total[x.tag] -= 1
            if x.tag in SCOPES:
                self.scopes.pop()
            else:
                self.scopes[-1][x.tag] -= 1
            self.here = x.parent
            if x is node:
                return

    def end(self, tag: str) -> None:
        """An end tag: closes the innermost element of its kind, if one is in reach."""
        if not (self.total[tag] if tag in BLOCK else self.scopes[-1][tag]):
            return
        node = self.here
        while node.tag != tag:
            node = node.parent
        self.pop(node)

    def make_room(self, tag: str) -> None:
        """Close the elements that an opening tag ends."""
        shut, borders = CLOSES.get(tag, ((), ()))
        node, last = self.here.block, None
        while shut and node is not self.root and node.tag not in borders:
            if node.tag in shut:
                last = node
            elif node.tag in BLOCK:
                break
            node = node.parent.block
        if last is not None:
            self.pop(last)


def _boilerplate(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element is left out by its kind, and whether its class or id says so."""
    if tag in OUT:
        return True, False
    if not attrs or tag in ("html", "body", "main"):
        return False, False
    names = []
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip()
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True, False
        if key == "style" and _HIDE.search(value):
            return True, False
        if key in ("class", "id"):
            names.append(value)
    if tag == "article":
        return False, any(UNLIKELY.match(n) for n in names)
    named = " ".join(names)
    return False, bool(UNLIKELY.search(named)) and not (LIKELY.search(named) and not _STRONG.search(named))


def _settle(root: Node) -> None:
    """Pardon named boilerplate that holds the page's main part; then leave out all that boilerplate holds."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        if not x.out:
            stack += [c for c in x.children if isinstance(c, Node)]
    holds: set[int] = set()
    for x in reversed(order):
        if not x.out and (id(x) in holds or x.tag in ("main", "h1") or x.tag == "article" and not x.named):
            x.named = x.named and x.tag == "article"
            if x.parent is not None and not x.named:
                holds.add(id(x.parent))
    for x in order:
        x.out = x.out or x.named


def parse(html: str) -> Node:
    """The tree of a page, in time proportional to its length."""
    root = Node("#root", None, False, False)
    chain, at, last = _Open(root), 0, html.rfind(">")
    while at < len(html):
        lt = html.find("<", at)
        comment = lt >= 0 and html.startswith("<!--", lt)
        if lt < 0 or not comment and lt > last:
            chain.here.children.append(html[at:])  # no tag can end any more
            break
        if lt > at:
            chain.here.children.append(html[at:lt])
        if comment:
            at = _COMMENT.match(html, lt).end()
            continue
        follows = html[lt + 1 : lt + 3]
        if not (follows[:1] in ("!", "?", "/") or follows[:1].isascii() and follows[:1].isalpha()):
            chain.here.children.append("<")
            at = lt + 1
            continue
        m = _TAG.match(html, lt) or _OTHER.match(html, lt)
        at = m.end()
        tag, attrs = (m[2] or "").lower(), m[3] or ""
        if not tag:
            continue
        if m[1]:
            chain.end(tag)
            continue
        chain.make_room(tag)
        child = Node(tag, chain.here, *_boilerplate(tag, attrs))
        chain.here.children.append(child)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            stop = end.start() if end else len(html)
            child.children.append(html[at:stop])
            at = end.end() if end else len(html)
            continue
        chain.push(child)
    _settle(root)
    return root


def blocks(node: Node) -> list[str]:
    """The texts of a node's blocks in page order, cleaned."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append(text)

    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        x, i = stack.pop()
        if i == 0 and (x.tag in BLOCK or x.tag == "#root"):
            flush()
        while i < len(x.children):
            c = x.children[i]
            i += 1
            if isinstance(c, str):
                parts.append(c)
            elif c.tag in ("br", "wbr"):
                parts.append(" ")
            elif not c.out:
                stack += [(x, i), (c, 0)]
                break
        else:
            if x.tag in BLOCK:
                flush()
    flush()
    return out


def _measure(root: Node) -> list[Node]:
    """Fill in sizes and link sizes bottom-up; the nodes that count, in page order."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in reversed(x.children) if isinstance(c, Node) and not c.out]
    for x in reversed(order):
        own = "".join(c for c in x.children if isinstance(c, str))
        x.size += len(_SPACE.sub(" ", own).strip())
        if x.tag == "a":
            x.links = x.size
        if x.parent is not None:
            x.parent.size += x.size
            x.parent.links += x.links
    return order


def _commas(x: Node) -> int:
    total, stack = 0, [x]
    while stack:
        n = stack.pop()
        for c in n.children:
            if isinstance(c, str):
                total += c.count(",")
            elif not c.out and c.tag not in BLOCK:
                stack.append(c)
    return total


def main_text(html: str | None) -> str:
    """The main text of one page."""
    root = parse(html or "")
    order = _measure(root)
    if not root.size:
        return ""
    for x in order:
        if x.tag not in PARAGRAPH:
            continue
        inner = sum(c.size for c in x.children if isinstance(c, Node) and not c.out and c.tag in BLOCK)
        own = x.size - inner
        if own < 1:
            continue
        points = 1 + _commas(x) + min(own / 100, 3)
        if x.tag[0] == "h" and len(x.tag) == 2:
            points = 0.5
        if own < 25:
            points *= own / 25
        up = x if x.tag in ("div", "section", "article") else x.parent
        for level in range(1, LEVELS + 1):
            if up is None or up.tag in ("#root", "html"):
                break
            up.points += points / level
            up = up.parent
    best = max((x for x in order if x.tag not in ("#root", "html")), key=_worth, default=root)
    if best.points <= 0:
        best = root
    while best.parent is not None and best.parent.size == best.size:
        best = best.parent
    if best.parent is None:
        return "\n".join(blocks(best))
    least, inside = _worth(best) / 5, _in_article(best.parent)
    keep = [c for c in best.parent.children if isinstance(c, Node) and not c.out and (c is best or _belongs(c, least, inside))]
    return "\n".join(b for x in keep for b in blocks(x))


def _density(x: Node) -> float:
    """The share of an element's text that stands in links."""
    return x.links / x.size if x.size else 0.0


def _worth(x: Node) -> float:
    return x.points * (1 - _density(x))


def _in_article(x: Node | None) -> bool:
    while x is not None and x.tag not in ("article", "main"):
        x = x.parent
    return x is not None


def _belongs(x: Node, least: float, inside: bool) -> bool:
    """Whether a sibling of the best container is part of the text."""
    if _worth(x) >= least:
        return True
    if x.tag not in BLOCK or not x.size:
        return False
    return _density(x) < 0.25 if x.size > SHORT else _density(x) < 0.5 if inside else not x.links


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([main_text(h.as_py()) for h in batch.column(2)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text for every row of ``pages``."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string")
