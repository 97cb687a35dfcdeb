"""Main text of web pages by composite text density.

A page is read into a tree of elements, in which only scripts, styles, controls and markup are without text.  The
characters-per-tag density of every node is adjusted by its links:

    density = (C / T) * log(C * T / (L * K)) / log(log(C * L / N + C * l / c + e))

with C characters and T tags below the node, L characters and K tags of links, N = C - L, and l, c the L and C of the
body; counts of 0 divide as 1, and the divisor is at least 1.  A node's density sum adds the densities of its children
(a node without children has its own).

Choice.  Of the nodes outside page furniture, the one with the largest density sum is found.  The body's density is the
threshold of the path from there up: the text is the topmost node on the path that every step up to it reaches at or above
the threshold, so more paragraphs are taken in and menus aren't; where the body holds several such nodes of one tag, the
body.  A page with little text has its largest sum at the
body; then the choice goes down while just one child holds nearly all text outside furniture and is at the threshold.
An <article> or <main> with less than half its text in links counts as at the threshold; it is no answer by itself.

Furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) is told by tag, by role, or, for
containers only, by a class or id that is as a whole one of NAMES, unless it holds the page's <main>, <article> or <h1>.  Inside the chosen
node furniture is left out, and so are containers of links: two or more, four fifths of the characters, a density below the threshold.
No other text of the chosen node is dropped, whatever its class and however short.

Blocks.  Character references are decoded; block elements end a block; white space inside a block becomes one space and
is trimmed; blocks are joined in page order by one newline; <br> counts as white space.

Defined cases: null and empty pages, and pages without prose, give an empty text; pages cut off anywhere are read to
their end; a tag with an unpaired quote ends at its first '>'; unclosed and stray tags are tolerated; a page whose body
is text without elements is that text; repeated rows are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import math
import re

from pyspark.sql import DataFrame, SparkSession

from .common import table

NAME = "op9_html_main_text"
ORACLE_SQL = None

# Fixed values of HTML: elements without content, raw text, implied ends, blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
STOPS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "tbody": ("table",), "tfoot": ("table",), "p": ("td", "th", "table", "button", "body")}
#: Elements whose content is never read as text.
SILENT = frozenset("head script style noscript template svg math canvas object iframe audio video select option button input textarea datalist map".split())

#: Elements nested deeper become siblings, as in browsers; their texts stay.
DEEPEST = 512
#: Share of a container's characters in links that makes it a list of links, and of a body's text that one child must hold to stand for it.
LINKED, NEARLY_ALL = 0.8, 0.9

# Fixed values of page furniture: tags, roles, and whole class names or ids (of containers).
TAGS = frozenset("nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CONTAINERS = frozenset("div section ul ol dl table td header center details fieldset span".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements adsense banner breadcrumb breadcrumbs comment-list comments comments-area commentlist consent cookie cookie-banner cookie-consent cookie-notice cookies disqus-thread footer main-menu main-nav masthead menu nav navbar navigation newsletter notice notices notification notifications page-footer page-header pager pagination popup promo promotion related-articles related-posts respond share share-buttons sharing sidebar site-footer site-header skip-link social social-links sponsored subscribe toolbar topbar widget widgets".split()
)
CHOSEN = ("article", "main")

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?][^>]*>|</[^>]*>|<[A-Za-z/!?][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element: its children are elements and texts in page order."""

    __slots__ = ("aside", "chars", "children", "density", "depth", "link_chars", "link_tags", "parent", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, aside: bool = False):
        self.tag, self.parent, self.aside = tag, parent, aside
        self.depth: int = parent.depth + 1 if parent else 0
        self.children: list[Node | str] = []

    def below(self) -> list[Node]:
        return [x for x in self.children if isinstance(x, Node) and x.tag not in SILENT]

    def path(self):
        """The node and those that it is in."""
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent


def _furniture(tag: str, attributes: str, parent: Node) -> bool:
    if tag in TAGS:
        return True
    if tag == "header" and not any(x.tag in CHOSEN for x in parent.path()):
        return True
    if tag in ("html", "body", "main") or not attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "role" and value in ROLES:
            return True
        if key == "style" and _UNSEEN.search(value):
            return True
        if key in ("class", "id") and tag in CONTAINERS and not NAMES.isdisjoint(value.replace("_", "-").split()):
            return True
    return False


def parse(page: str) -> Node:
    """The tree of a page."""
    root = at = Node("html", None)
    place, size = 0, len(page)
    while place < size:
        m = _TAG.search(page, place)
        text = page[place : m.start()] if m else page[place:]
        if text:
            at.children.append(text)
        if not m:
            break
        place = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:  # an end tag closes its element and what is open inside; a stray one closes nothing
            node = next((x for x in at.path() if x.tag == tag), None)
            if node is not None and node.parent is not None:
                at = node.parent
            elif tag == "p":
                at.children.append(Node("p", at))
            continue
        if tag == "html" or tag == "body" and any(x.tag == "body" for x in at.path()):
            continue
        if tag in ENDS_P:
            at = _closed(at, ("p",), STOPS["p"])
        if tag in IMPLIED:
            at = _closed(at, IMPLIED[tag], STOPS[tag])
        if tag == "body":
            at = root
        node = Node(tag, at, _furniture(tag, attributes, at))
        at.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, place)
            place = end.end() if end else size
        elif tag not in VOID and not attributes.endswith("/") and node.depth < DEEPEST:
            at = node
    _spare(root)
    return root


def _spare(root: Node) -> None:
    """A wrapper that is furniture by its name and holds the page's <main>, <article> or <h1> is none."""
    todo: list[tuple[Node, list[Node]]] = [(root, [])]
    while todo:
        node, named = todo.pop()
        if node.aside and (node.tag in TAGS or node.tag == "header"):
            continue
        if not node.aside and named and node.tag in ("main", "article", "h1"):
            for x in named:
                x.aside = False
        held = [*named, node] if node.aside else named
        todo += [(x, held) for x in node.below()]


def _closed(at: Node, ends: tuple, stops: tuple) -> Node:
    """Where parsing goes on if an open element of ``ends``, inside the nearest of ``stops``, is closed."""
    out = at
    for node in at.path():
        if node.tag in stops or node.parent is None:
            break
        if node.tag in ends:
            out = node.parent
    return out


def score(root: Node) -> list[Node]:
    """Fill in density and density sum of every node with text; each comes before its children."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += reversed(node.below())
    for node in reversed(nodes):
        own = node.below()
        node.chars = sum(len(" ".join(x.split())) for x in node.children if isinstance(x, str)) + sum(x.chars for x in own)
        node.tags = len(own) + sum(x.tags for x in own)
        node.link_chars = node.chars if node.tag == "a" else sum(x.link_chars for x in own)
        node.link_tags = (node.tag == "a") + sum(x.link_tags for x in own)
    body = next((x for x in nodes if x.tag == "body"), root)
    share = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        base = math.log(c / max(1, c - node.link_chars) * node.link_chars + share * c + math.e)
        node.density = max(0.0, c / t * math.log(c * t / (lc * lt)) / max(1.0, math.log(base))) if c else 0.0
        own = [x for x in node.below() if not x.aside]
        node.sum = sum(x.density for x in own) if own else node.density
    return nodes


def select(root: Node) -> tuple[Node | None, float]:
    """The node that holds the main text, and the path's threshold."""
    nodes = score(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    threshold = body.density
    reaches = lambda x: x.density >= threshold or x.tag in CHOSEN and 2 * x.link_chars < x.chars
    outside, full = {id(root)}, []
    for x in nodes:  # those not in furniture
        if x is root or id(x.parent) in outside and not x.aside:
            outside.add(id(x))
            if x.chars:
                full.append(x)
    best = max(full, key=lambda x: x.sum, default=None)
    if best is None:
        return None, threshold
    if any(x is body for x in best.path()):
        while best is not body and best.parent is not body and reaches(best.parent):
            best = best.parent
        if best is not body and not reaches(best):  # a line of its own
            best = body if best.tag not in BLOCKS or best.tag == "p" else best
        if best.parent is body and any(x is not best and x.tag == best.tag and not x.aside and reaches(x) and 2 * x.link_chars < x.chars for x in body.below() if x.chars):
            best = body  # one of several like parts
    while True:
        own = [x for x in best.below() if not x.aside and x.chars]
        lone = sum(len(" ".join(x.split())) for x in best.children if isinstance(x, str))
        one = [x for x in own if reaches(x) and x.tag in BLOCKS and x.tag not in ("p", "h1")]
        if best.tag not in ("body", "html") or len(one) != 1 or lone or one[0].chars < NEARLY_ALL * sum(x.chars for x in own):
            return best, threshold
        best = one[0]


def _links_only(node: Node, threshold: float) -> bool:
    return node.tag in CONTAINERS and node.link_tags > 1 and node.link_chars >= LINKED * node.chars and node.density < threshold


def text_of(node: Node, threshold: float = 0.0) -> str:
    """The node's blocks, without furniture and lists of links, joined by newlines."""
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line:
            text = " ".join(_html.unescape("".join(line)).split())
            if text:
                blocks.append(text)
            line.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif x is node or x.tag not in SILENT and not x.aside and not _links_only(x, threshold):
            if x.tag in BLOCKS:
                end()
                todo.append(None)
            todo += reversed(x.children)
    end()
    return "\n".join(blocks)


def main_text(page: str) -> str:
    if not page:
        return ""
    node, threshold = select(parse(page))
    return text_of(node, threshold) if node else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
