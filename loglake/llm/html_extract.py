"""Main text of web pages by tree scoring (operator 9).

A page becomes a tree of containers that hold text blocks. Every paragraph
passes points for its length and commas to its ancestors, less with each level
and discounted by the share of link text; the best container is kept. In an
article it is widened to the article, with the headings, paragraphs and further articles beside
it and the siblings that score well; on other pages all that stands around it is kept but for lists of links. Blocks inside
menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts
and styles never count. Where only a class or id says so, an element is furniture unless it holds over
HALF of the page's text and no article stands beside it; a header inside an article, or of an entry, is none.

Defined cases: null or empty html, and pages without text, give an empty text;
broken and unclosed markup is closed as browsers do; ties between containers
go to the first in page order; repeated pages are extracted row by row. Null
page_id and url pass through. No shuffle.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loglake.llm.common import table

#: Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style noscript template iframe object svg canvas form button select textarea option nav aside footer dialog menu title".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre li dt dd td th caption figcaption address summary blockquote".split())
CONTAINERS = frozenset("html body div article section main ul ol dl table thead tbody tfoot tr figure details header center hgroup".split())
ARTICLE = frozenset(("article", "main"))
#: Words of class, id and role that mark page furniture.
FURNITURE = frozenset((
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "disqus footer footnav gdpr header masthead menu modal nav navbar navigation navigation notice notices popup "
    "promo promoted promotion related respond share sharing sidebar signup skyscraper social sponsor sponsored "
    "subscribe subscription newsletter toolbar widget widgets complementary contentinfo search alert").split())
#: A start tag of the key closes an open element of these kinds.
CLOSES = {**dict.fromkeys(CONTAINERS | BLOCKS | {"hr", "form", "nav", "aside", "footer"}, frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6"))),
          "li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")),
          "tr": frozenset(("tr", "td", "th", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p"))}
#: Words that make a furniture word one about the page's state, and headers that belong to the text.
STATE = frozenset("has no with without is hide show not".split())
HEADERS = frozenset("header masthead banner".split())
ENTRY = frozenset("entry post article story content title section".split())
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^a-z]+")
HALF = 0.5
#: Levels up to which a paragraph passes points.
LEVELS = 32


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "doubtful", "inside", "score", "length", "linked", "block")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, doubtful: bool = False):
        self.tag, self.parent, self.dropped, self.doubtful = tag, parent, dropped, doubtful
        self.inside = tag in ARTICLE or parent is not None and parent.inside
        self.children: list[Node | Block] = []
        self.score, self.length, self.linked = 0.0, 0, 0
        self.block = tag in BLOCKS


class Block:
    __slots__ = ("text", "linked")

    def __init__(self, text: str, linked: int):
        self.text, self.linked = text, linked


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.node = Node("#", None, False)
        self.inline: list[str] = []
        self.link: Node | None = None  # where an open link began
        self.linked = 0
        self.open: Counter[str] = Counter()

    def flush(self) -> None:
        if self.inline:
            text = SPACE.sub(" ", "".join(self.inline)).strip()
            if text and not self.node.dropped:
                self.node.children.append(Block(text, self.linked))
            self.inline, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = self.node  # a link ends one that is open
        if tag == "br":
            self.inline.append("\n")
        if tag not in BLOCKS and tag not in CONTAINERS and tag not in DROPPED:
            if tag == "hr":
                self.flush()
            return
        if tag in DROPPED and tag in ("title", "option", "textarea") and self.node.dropped:
            return
        self.flush()
        closes = CLOSES.get(tag, ())
        if closes and self.node.tag in closes:
            # One open paragraph, or the cells of a row, end here.
            while self.node.tag in closes and self.node.parent:
                self.leave()
                if tag not in ("tr", "li", "dt", "dd", "td", "th"):
                    break
        inside = self.node.inside
        hidden = any(name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attrs)
        tokens = [t for name, value in attrs if name in ("class", "id", "role") and value for t in value.lower().split()]
        dropped = self.node.dropped or tag in DROPPED or hidden or "hidden" in tokens or tag == "header" and not inside
        doubtful = tag not in ("html", "body", "article", "main") and any(is_furniture(t, inside) for t in tokens)
        node = Node(tag, self.node, dropped, doubtful)
        self.node.children.append(node)
        self.node = node
        self.open[tag] += 1

    def leave(self) -> None:
        """Close the current element, and a link that began in it."""
        self.open[self.node.tag] -= 1
        if self.link is self.node:
            self.link = None
        self.node = self.node.parent

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = None
        if tag not in BLOCKS and tag not in CONTAINERS and tag not in DROPPED or not self.open[tag]:
            return
        self.flush()
        while self.node.tag != tag:
            self.leave()
        self.leave()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        self.inline.append(data)
        if self.link is not None:
            self.linked += len(data)


def is_furniture(token: str, inside: bool) -> bool:
    """Whether a word of a class, id or role names page furniture. ``inside``: of an article."""
    parts = [p for p in WORD.split(token) if p]
    found = FURNITURE.intersection(parts)
    if not found or STATE.intersection(parts):
        return False
    return not (found <= HEADERS and (inside or ENTRY.intersection(parts)))


def settle(root: Node) -> None:
    """Drop what is doubtful and holds no more than HALF of the text; sums up lengths on the way."""
    order = [x for x in walk(root) if isinstance(x, Node)]
    for n in reversed(order):  # children first
        for c in n.children:
            length, linked = (c.length, c.linked) if isinstance(c, Node) else (len(c.text), c.linked)
            n.length += length
            n.linked += linked
    total = root.length
    around_article: set[int] = set()
    for n in order:
        if n.tag in ARTICLE and n.length and not n.dropped:
            while n and id(n) not in around_article:
                around_article.add(id(n))
                n = n.parent
    for n in order:
        # Beside an article, what looks like furniture is some, however much text it has.
        holds = n.length > HALF * total and (not around_article or id(n) in around_article or n.inside)
        if n.doubtful and not holds or n.parent and n.parent.dropped:
            n.dropped = True
    for n in reversed(order):
        n.children = [c for c in n.children if not (isinstance(c, Node) and c.dropped)]
        n.length = sum(c.length if isinstance(c, Node) else len(c.text) for c in n.children)
        n.linked = sum(c.linked for c in n.children)


def walk(node: Node) -> Iterator[Node | Block]:
    """The tree in page order, without recursion."""
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        if isinstance(x, Node):
            stack.extend(reversed(x.children))


def add_scores(root: Node) -> list[Node]:
    """Gives every container its points; returns the containers in page order."""
    nodes = []
    stack: list[tuple[Node | Block, Node]] = [(root, root)]
    while stack:
        x, owner = stack.pop()
        if isinstance(x, Node):
            nodes.append(x)
            stack.extend((c, x) for c in reversed(x.children))
            continue
        points = 1 + x.text.count(",") + min(len(x.text) / 100, 3)
        points *= 1 - min(1.0, x.linked / len(x.text))
        holder = owner.parent if owner.block and owner.parent else owner
        level = 0
        while holder and level < LEVELS:
            holder.score += points / (1, 2)[level] if level < 2 else points / (3 * level)
            holder = holder.parent
            level += 1
    return [n for n in nodes if not n.block and n.score > 0]


def final_score(n: Node) -> float:
    return n.score * (1 - min(1.0, n.linked / max(1, n.length)))


def around(best: Node) -> deque[Node | Block]:
    """The best container, and in page order what stands beside it or beside an ancestor and is no list of links."""
    kept: deque[Node | Block] = deque([best])
    node = best
    while node.parent:
        at = node.parent.children.index(node)
        kept.extendleft(c for c in reversed(node.parent.children[:at]) if few_links(c))
        kept.extend(c for c in node.parent.children[at + 1:] if few_links(c))
        node = node.parent
    return kept


def few_links(x: Node | Block) -> bool:
    blocks = [b for b in (walk(x) if isinstance(x, Node) else [x]) if isinstance(b, Block)]
    return sum(b.linked for b in blocks) < 0.25 * max(1, sum(len(b.text) for b in blocks))


def beside(x: Node | Block, top: Node) -> bool:
    """Whether a sibling of the article belongs to it."""
    if x is top or isinstance(x, Block) or x.block or x.tag == "article":
        return x is top or few_links(x)
    return final_score(x) >= max(10.0, 0.2 * final_score(top)) and x.linked < 0.25 * max(1, x.length)


def main_blocks(root: Node) -> list[str]:
    settle(root)
    nodes = add_scores(root)
    if not nodes:
        return []
    best = max(nodes, key=final_score)  # the first of equals
    top = best
    node = best
    while node:
        if node.tag in ARTICLE:
            top = node
        node = node.parent
    if top.tag not in ARTICLE:
        return [x.text for k in around(top) for x in walk(k) if isinstance(x, Block)]
    kept = [c for c in top.parent.children if beside(c, top)] if top.parent else [top]
    return [x.text for k in kept for x in walk(k) if isinstance(x, Block)]


def extract(html: str | None) -> str:
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    builder.flush()
    return "\n".join(main_blocks(builder.root))


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select(pages["page_id"].cast("long").alias("page_id"), "url", pages[html_col].alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
