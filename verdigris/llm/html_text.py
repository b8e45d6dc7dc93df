"""Main text of a page by composite text density.

The page becomes a tree. Every node has its characters C and tags T, those in links LC and LT, and a
composite density: characters per tag, lowered the more of the characters and tags are links
(Sun, Song and Liao 2011). A node's density sum adds its children's densities. The node with the
largest sum below the body is where the article is; the least density on its path to the body is the
threshold. From the body down, a node that reaches the threshold yields the subtree with the largest
density sum in it; the nodes above are searched further down. A block of text that is found stands for
the element that holds it, and what is found in an article element for that element.

What is something else than the article by its tag (menus, asides, footers and so on) or hidden has no
part in the densities or the text. Nor have forms and what is named as something else by class, id, role
or itemtype, unless it is a wrapper (``has-sidebar``, a page in one form), about which the densities
decide: it holds, outside articles, an article or main element that is not so named itself, or it holds
most of the body's text and no such article stands elsewhere.

Text: character references decoded, white space within a block made one space, blocks trimmed and
joined in page order by one newline. A line break ends a block.

Defined results: null and empty pages, and pages without text, give an empty text; repeated rows are
read each; pages of any size are read whole; broken markup is closed where the page or the parent
ends; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
HINT = re.compile(r"(?i)\s(?:class|id|role|hidden|style|aria-hidden|itemtype)\b")

#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
NOT_ARTICLE = frozenset("nav aside footer menu dialog button select option input label canvas svg math audio video object applet head".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 hgroup header ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption br hr address center".split())
FORMS = frozenset("form fieldset".split())
WHOLE = frozenset("html body article main".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt tr td th thead tbody".split())
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"},
}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
#: Words in classes, ids and roles of what isn't the article.
OTHER_WORDS = frozenset(
    """ad ads adbox advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promoted promotion
    nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc
    sidebar side aside complementary related recommended recommendations trending popular widget widgets
    comment comments disqus discussion respond replies reply
    cookie cookies consent gdpr notice notices notification alert alertdialog popup modal overlay paywall newsletter subscribe subscription signup login
    footer contentinfo copyright masthead siteheader topbar toolbar search share sharing social follow
    hidden form""".split()
)
SPLIT_NAME = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "other", "parent", "children", "link", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.other, self.parent, self.children = tag, False, parent, []
        self.link = tag == "a" or (parent is not None and parent.link)
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def is_other(tag: str, attributes: str, inside_article: bool) -> bool:
    """Whether the element is something else than the article, whatever it holds."""
    if tag in NOT_ARTICLE or tag == "header" and not inside_article:
        return True
    if not attributes or tag in WHOLE or not HINT.search(attributes):
        return False
    for name, value in values(attributes):
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def is_named_other(tag: str, attributes: str) -> bool:
    """Whether the element is a form, or named as something else than the article."""
    if tag in FORMS:
        return True
    if not attributes or not HINT.search(attributes):
        return False
    named = (value for name, value in values(attributes) if name in ("class", "id", "role", "itemtype"))
    return any(w.lower() in OTHER_WORDS for value in named for w in SPLIT_NAME.split(html.unescape(value)))


def values(attributes: str) -> Iterator[tuple[str, str]]:
    for m in ATTRIBUTE.finditer(attributes):
        yield m[1].lower(), m[2] or m[3] or m[4] or ""


def parse(page: str) -> Node:
    """The page's tree, without what is something else; text is a str among a node's children."""
    root = Node("#page", None)
    at, here, end, some_other = 0, root, len(page), False
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            here.children.append(page[at:])
            break
        if m.start() > at:
            here.children.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            here = closed(here, tag)
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in CLOSES_P:
            here = implied_end(here, {"p"}, HOLDS.get(tag, set()) | {"#page", "body", "article", "section", "div", "main", "td", "th", "li", "blockquote", "button"})
        if tag in CLOSED_BY:
            here = implied_end(here, CLOSED_BY[tag], HOLDS[tag] | {"#page", "body"})
        node = Node(tag, here)
        here.children.append(node)
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        inside = tag != "header" or any(n.tag in ("article", "main") for n in ancestors(here))  # asked of headers only
        if is_other(tag, m[3], inside):
            here.children.pop()
            if tag not in INLINE:  # what stands before and after it are two blocks still
                here.children.append(Node("br", here))
            node.tag = "#other " + tag
        elif is_named_other(tag, m[3]):
            node.other = some_other = True
        here = node
    return without_others(root) if some_other else root


def without_others(root: Node) -> Node:
    """Takes away what is named as something else, but for wrappers of the article."""
    nodes = in_order(root)
    chars: dict[int, int] = {}
    holds: set[int] = set()  # an article or main element that is not named as something else
    articles = 0
    for node in reversed(nodes):
        chars[id(node)] = sum(chars[id(c)] if isinstance(c, Node) else text_chars(c) for c in node.children)
        articles += node.tag == "article" and not node.other and chars[id(node)] > 0
        if any(isinstance(c, Node) and (id(c) in holds or c.tag in ("article", "main") and not c.other and chars[id(c)]) for c in node.children):
            holds.add(id(node))
    most = chars[id(next((n for n in nodes if n.tag == "body"), root))] / 2
    stack = [(root, False)]
    while stack:
        node, in_article = stack.pop()
        kept = []
        for child in node.children:
            wrapper = isinstance(child, Node) and (id(child) in holds and not in_article or chars[id(child)] > most and (in_article or not articles))
            if isinstance(child, Node) and child.other and child.tag not in WHOLE and not wrapper:
                if child.tag not in INLINE:
                    kept.append(Node("br", node))
                continue
            kept.append(child)
            if isinstance(child, Node):
                stack.append((child, in_article or child.tag == "article"))
        node.children = kept
    return root


def ancestors(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def name(node: Node) -> str:
    return node.tag.removeprefix("#other ")


def closed(here: Node, tag: str) -> Node:
    """Where the page goes on after an end tag; one that closes nothing is passed over."""
    for node in ancestors(here):
        if name(node) == tag and node.parent is not None:
            return node.parent
        if tag in INLINE and name(node) not in INLINE:
            return here
    return here


def implied_end(here: Node, ended: set[str], fence: set[str]) -> Node:
    """Where the page goes on if elements ``ended`` end here; not beyond the first of ``fence``."""
    place = here
    for node in ancestors(here):
        if name(node) in ended and node.parent is not None:
            place = node.parent
        elif name(node) in fence:
            break
    return place


def in_order(root: Node) -> list[Node]:
    """All nodes, parents first; no recursion, as broken pages can be thousands deep."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed([c for c in node.children if isinstance(c, Node)]))
    return out


def text_chars(text: str) -> int:
    return len("".join(html.unescape(text).split()))


def weigh(root: Node) -> list[Node]:
    """Fills in counts, densities and density sums from the leaves up."""
    nodes = in_order(root)
    for node in reversed(nodes):
        for child in node.children:
            if isinstance(child, Node):
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags + (child.tag == "a")
            else:
                n = text_chars(child)
                node.chars += n
                node.link_chars += n * node.link
    body = next((n for n in nodes if n.tag == "body"), root)
    of_body = body.link_chars / max(1, body.chars)
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        if c:
            ratio = max(c / max(1, lc) * t / lt, 1.0)
            base = math.log(c / max(1, c - lc) * lc + of_body * c + math.e)
            node.density = c / t * (math.log(ratio, base) if base > 1 else math.log(ratio) if lc else 1.0)
    for node in nodes:
        node.sum = sum(c.density for c in node.children if isinstance(c, Node))
    return nodes


def main_nodes(root: Node) -> list[Node]:
    """The subtrees that hold the article, in page order: what the densities mark below the body, or below
    the main element that the largest sum is in. A marked block of text (a paragraph, a list, a heading)
    stands for the element that holds it, and what is marked in an article element for that element. Where
    the largest sum is in an article element, what is marked outside such elements doesn't count."""
    nodes = weigh(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    if not body.chars:
        return []
    below = in_order(body)
    top = max(below, key=lambda n: n.sum)
    path = [n for n in ancestors(top) if within(n, body)]
    threshold = min(n.density for n in path)
    whole = next((n for n in reversed(path) if n.tag == "main"), body)
    best: dict[int, Node] = {}
    for node in reversed(below):  # the largest sum in each subtree
        best[id(node)] = max([node, *(best[id(c)] for c in node.children if isinstance(c, Node))], key=lambda n: n.sum)
    marked: dict[int, Node] = {}
    stack = [whole]
    while stack:
        node = stack.pop()
        if node.chars and node.density >= threshold:
            chosen = holder(best[id(node)], whole)
            marked[id(chosen)] = chosen
            stack.extend(c for c in node.children if isinstance(c, Node) and id(node) not in marked)
    if top_article := any(n.tag == "article" for n in path):
        marked = {k: n for k, n in marked.items() if n.tag == "article" or n is whole}
    if whole.tag != "main" and id(whole) in marked and (len(marked) > 1 or top_article):
        del marked[id(whole)]  # text that stands in the body itself, beside what holds the article
    found, stack = [], [whole]
    while stack:  # the topmost marked ones, in page order
        node = stack.pop()
        if id(node) in marked:
            found.append(node)
        else:
            stack.extend(reversed([c for c in node.children if isinstance(c, Node)]))
    return titled(found, whole)


def holder(node: Node, whole: Node) -> Node:
    """The element that a marked node stands for, not above ``whole``: the outermost article around it, else
    the nearest element that is no block of text."""
    path = []
    for n in ancestors(node):
        path.append(n)
        if n is whole:
            break
    article = next((n for n in reversed(path) if n.tag == "article"), None)
    return article or next((n for n in path if n.tag not in TEXT_BLOCKS and n.tag not in INLINE), path[-1])


def titled(found: list[Node], whole: Node) -> list[Node]:
    """Articles, after the h1 that stand before the first of them in their main element."""
    if whole.tag != "main" or not any(n.tag == "article" for f in found for n in in_order(f)):
        return found
    titles = []
    for node in in_order(whole):
        if node is found[0]:
            return [*titles, *found]
        if node.tag == "h1" and node.chars and not any(a.tag == "article" for a in ancestors(node)):
            titles.append(node)
    return found


def within(node: Node, other: Node) -> bool:
    return any(n is other for n in ancestors(node))


def text_of(roots: list[Node]) -> str:
    blocks, open_block = [], []

    def end_block() -> None:
        if open_block:
            line = " ".join("".join(open_block).split())
            if line:
                blocks.append(line)
            open_block.clear()

    for root in roots:
        stack: list[Node | str | None] = [root]
        while stack:
            item = stack.pop()
            if item is None:
                end_block()
            elif isinstance(item, str):
                open_block.append(html.unescape(item))
            else:
                block = item.tag not in INLINE
                if block:
                    end_block()
                    stack.append(None)
                stack.extend(reversed(item.children))
        end_block()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    return text_of(main_nodes(parse(page))) if page else ""


def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([main_text(p) for p in pages], dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html)."""
    read = F.pandas_udf(texts, "string")
    return pages.select("page_id", "url", read("html").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
