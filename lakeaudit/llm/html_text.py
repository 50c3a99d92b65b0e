"""Main text of web pages by composite text density.

For every block node of a page's tree: the characters below it per tag, lowered by the
share of characters and tags that belong to links (composite text density). A node's sum
is that of its children's densities. The node with the largest sum leads to the article:
an ``article`` element around it is kept whole. Without one, the ``main`` around it, or
else the outermost node below ``body``, is kept except for blocks beside the winner whose
characters are mostly links. Beside the path from there up to ``body``, headings,
paragraphs and bare text are kept unless mostly links, and every subtree whose density
reaches the lowest density on the path. Menus, page headers and footers, side columns,
notices, adverts, forms, scripts, styles, hidden parts and reader comments are taken out
of the tree first, by element, role and class or id names: a name of ``DROPPED_WORDS``, or
one made of such words and of ``PLACE_WORDS`` only (``site-header``, not ``has-sidebar``).

Output: character references decoded, white space inside a block made one space, blocks in
page order joined by a blank line; nothing else is dropped or cut.

Defined cases: null, empty and text-free html give the empty text; broken markup (unclosed
or unmatched tags, unbalanced quotes) is read as far as it goes, never an error; of embedded
elements (svg, math, select, object, noscript, iframe, template) that are self-closed or lack
an end tag inside their parent only the tag goes; null ids
and urls stay null; repeated rows are extracted one by one; empty tables give no rows;
other input columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.common import importable

TEXTS = "page_id long, url string, text string, n_chars long"

# Element names and the class, id and role words of parts that are no article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noframes xmp".split())  # text up to the end tag, or to the page's end
LOOSE = frozenset("noscript template iframe svg math select object".split())  # dropped up to the end tag; without one, only the tag goes
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br".split()
)
DROPPED = frozenset("head nav header footer aside form script style noscript template iframe button select option optgroup textarea menu dialog svg math object".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer comment comments reply replies respond disqus social share "
    "sharing related newsletter subscribe popup modal widget".split()
)
PLACE_WORDS = frozenset("site global main primary secondary top bottom box bar list block area links buttons icons posts section container wrapper".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog menu menubar alert".split())
BESIDE = frozenset("h1 h2 h3 h4 h5 h6 hgroup p".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


class Node:
    __slots__ = ("name", "parent", "children", "dropped", "chars", "link_chars", "tags", "link_tags", "density", "total", "link", "begin")

    def __init__(self, name: str, parent: "Node | None", dropped: bool, link: bool):
        self.name, self.parent, self.dropped, self.link = name, parent, dropped, link
        self.children: list[Node] = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def _dropped_name(name: str) -> bool:
    words = {w for w in re.split(r"[^a-z]+", name) if w}
    return not words.isdisjoint(DROPPED_WORDS) and words <= DROPPED_WORDS | PLACE_WORDS


def _dropped(name: str, attributes: str) -> bool:
    if name in ("html", "body", "main", "article"):
        return False
    if name in DROPPED:
        return True
    if not attributes.strip(" /"):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape(value.strip("\"'")).lower()
        if key in ("class", "id") and any(map(_dropped_name, value.split())):
            return True
        if key == "role" and value.strip() in DROPPED_ROLES:
            return True
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


P_SCOPE = {"table", "td", "th", "button", "article", "section", "div", "main", *LOOSE}


def parse(page: str) -> tuple[Node, list[tuple[Node, str | None]]]:
    """The root of the page's block tree, and its texts in page order; (node, None) is a block's edge.

    Loose elements found to lack an end tag inside their parent are taken as empty, and the page is read again.
    """
    empty: set[int] = set()
    while True:
        root, events, unclosed = _read(page, empty)
        if not unclosed:
            return root, events
        empty |= unclosed


def _read(page: str, empty: set[int]) -> tuple[Node, list[tuple[Node, str | None]], set[int]]:
    """As ``parse``, where loose elements whose tag ends at a place in ``empty`` have no content; and the places of those without an end."""
    unclosed: set[int] = set()
    root = Node("#root", None, False, False)
    stack: list[Node] = [root]  # with inline elements, which are no nodes of the block tree
    events: list[tuple[Node, str | None]] = []
    blocks = [root]

    def push(name: str, attributes: str) -> None:
        top, block = stack[-1], blocks[-1]
        node = Node(name, block, top.dropped or _dropped(name, attributes), top.link or name == "a")
        node.begin = at
        if not node.dropped:
            block.tags += 1
            block.link_tags += name == "a"
        stack.append(node)
        if name not in INLINE:
            block.children.append(node)
            blocks.append(node)
            events.append((node, None))

    def pop_to(depth: int) -> None:
        """Close the elements from ``depth`` on; the one at ``depth`` has its own end."""
        while len(stack) > depth:
            node = stack.pop()
            if node.name in LOOSE and len(stack) > depth:
                unclosed.add(node.begin)
            if node.name not in INLINE:
                blocks.pop()
                events.append((node, None))

    def close(names: set[str], scope: set[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name in names:
                pop_to(depth)
                return close(names, scope)
            if stack[depth].name in scope:
                return

    def text(raw: str) -> None:
        if raw and not stack[-1].dropped:
            raw = html.unescape(raw)
            block = blocks[-1]
            count = len(raw) - raw.count(" ")
            block.chars += count
            if stack[-1].link:
                block.link_chars += count
            events.append((block, raw))

    at, size = 0, len(page)
    while at < size:
        token = TOKEN.search(page, at)
        if token is None:
            text(page[at:])
            break
        text(page[at : token.start()])
        at = token.end()
        name = (token[2] or token[5] or "").lower()
        if not name:
            continue
        attributes = token[3] or token[6] or ""
        if token[1] or token[4]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    pop_to(depth)
                    break
            continue
        if name in ENDS_P:
            close({"p", "option", "optgroup"}, P_SCOPE)
        if name in CLOSES:
            close(*CLOSES[name])
        closed = attributes.endswith("/")
        if name in RAW and not (closed and any(n.name in ("svg", "math") for n in stack)):
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            if name not in INLINE:
                events.append((blocks[-1], " "))
            continue
        if name in VOID:
            if name == "br":
                text(" ")
            elif name == "hr":
                events.append((blocks[-1], None))
            continue
        if name in LOOSE and (closed or at in empty):
            events.append((blocks[-1], " "))
            continue
        push(name, attributes)
        if closed and name not in INLINE and name not in ENDS_P:
            pop_to(len(stack) - 1)
    unclosed.update(node.begin for node in stack if node.name in LOOSE)
    pop_to(1)
    return root, events, unclosed


def _measure(root: Node) -> list[Node]:
    """Sums over subtrees, densities and density sums; the block nodes in page order."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack += reversed(node.children)
    for node in reversed(nodes):
        if node.parent is not None and not node.dropped:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
            node.parent.tags += node.tags
            node.parent.link_tags += node.link_tags
    body_chars, body_links = max(root.chars, 1), root.link_chars
    for node in nodes:
        if node.dropped or not node.chars:
            continue
        chars, tags = node.chars, max(node.tags, 1)
        links, plain = max(node.link_chars, 1), max(chars - node.link_chars, 1)
        base = math.log(chars * node.link_chars / plain + body_links * chars / body_chars + math.e)
        rate = chars * tags / (links * max(node.link_tags, 1))
        # Without links the factor is one, so the density is that of characters per tag.
        factor = math.log(max(rate, 1.0000001)) / base / math.log(max(chars * tags, 2)) if node.link_chars else 1.0
        node.density = chars / tags * factor
    for node in nodes:
        node.total = sum(c.density for c in node.children) if any(c.density for c in node.children) else node.density
    return nodes


def main_text(page: str | None) -> str:
    """The article's blocks joined by blank lines."""
    if not page:
        return ""
    root, events = parse(page)
    read: list[Node] = [root]
    for node in read:
        read += node.children
    own_chars, own_links = {id(n): n.chars for n in read}, {id(n): n.link_chars for n in read}  # before they are summed
    nodes = [n for n in _measure(root) if not n.dropped and n.chars]
    if not nodes:
        return ""
    best = max(nodes, key=lambda n: n.total)  # the first, so the outermost, of equals
    path, node = [], best
    while node is not None:
        path.append(node)
        if node.name == "body":
            break
        node = node.parent
    threshold = min(n.density for n in path)
    articles = [n for n in path if n.name == "article"]
    inner = [n for n in path if n.name not in ("body", "html", "#root")]
    mains = [n for n in inner if n.name == "main"]
    top = (articles or mains or inner or [best])[-1]  # the outermost
    # Whole subtrees: the article, or the winner. Nodes of the path have only their own texts kept.
    whole = top if articles else best
    kept, own = {id(whole)}, set(map(id, path))
    below = set(map(id, path[: path.index(top) + 1]))
    for node in nodes:  # parents come before children
        if id(node.parent) in kept:
            kept.add(id(node))
        elif id(node) not in own:
            plain = node.link_chars * 2 <= node.chars
            beside = id(node.parent) in below or id(node.parent) in own and node.name in BESIDE
            if plain and beside or node.density >= threshold:
                kept.add(id(node))
    # Bare texts of a path node stay unless they are mostly links.
    bare = {i for i in own if own_links[i] * 2 <= own_chars[i]}
    blocks, words = [], []
    for node, raw in events:
        if raw is None:
            if words:
                blocks.append(" ".join("".join(words).split()))
                words = []
        elif id(node) in kept or id(node) in bare:
            words.append(raw)
    if words:
        blocks.append(" ".join("".join(words).split()))
    return "\n\n".join(b for b in blocks if b)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    importable(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, TEXTS)
