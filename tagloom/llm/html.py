"""Main text of web pages by composite text density.

A page becomes a tree of elements. Each element has the characters of its text, of its text inside links, its tags and
its link tags; the composite density is characters per tag, adjusted by how much of them are links against the page's
share. An element's density sum adds the densities of its children. The element with the largest sum lies in the main
text; the smallest density on the path from it to the body is the threshold, and every element of at least that
density contributes the subtree with the largest sum below it.

Elements that never hold an article (menus, page headers and footers, asides, scripts, styles, what is hidden) are left
out of the tree before densities are computed. So are elements whose class or id names an advert, notice, sidebar or
reader comments, however much text they hold; they count only on a page that has no other text, or where they hold its
main heading. Forms, widgets and names of a place (header, footer) may also be what wraps an article: they are left out
unless one, or all of one name together, hold most of the other text outside links; then the densities decide. Names of
what consists of links or fields (menus, search, social) count only for elements whose text is in links, or that have
fields. Beside the one article or main element of a page noise is always left out. A header that its class names as that
of an entry belongs to the article, and its headings to the text. Formulas are text of the line that they stand in.

Open elements are kept on a stack with a count of each name, so the time follows the length of a page, however deep.

Defined results: null, empty or text-less pages give an empty text; unclosed and unknown tags are tolerated and cut-off
pages give what is there; repeated pages get a row each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from .common import map_texts

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe noembed noframes xmp svg annotation annotation-xml".split())
#: Elements that end a line of text; all others are part of one.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
NEVER = set("head nav footer aside button select menu dialog object canvas audio video".split())
ROLES = set("navigation banner contentinfo complementary menu menubar alert dialog alertdialog".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HOMES = {"article", "main"}
#: Whole names in a class or id, or heads of names, that mark what is not the article. A word of place may stand before
#: them (site-footer, left-sidebar); other names before them say what stands beside an element or what made it.
NOISE = re.compile(
    r"[^a-z]*(?:(?:site|page|global|main|primary|secondary|left|right|top|bottom|post|entry|article|blog)[-_]+)*"
    r"(ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promo(?:tion|s)?|banners?|"
    r"nav|navbar|navigation|menus?|breadcrumbs?|pagination|pager|side-?bars?|sidenav|aside|related|recommend(?:ed|ations)?|"
    r"widgets?|footers?|(?:site|page)-?header|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|notifications?|alerts?|"
    r"popups?|pop-up|modal|overlay|newsletter|subscribe|subscription|signup|sign-up|login|search|"
    r"shar(?:e|ing)|social|comments?|commentlist|respond|replies|disqus|discussion|skip-?link)"
    r"(?![a-z]|[-_](?:open|closed|enabled|disabled|on|off)(?![a-z]))"  # such names tell what is switched on
)
#: The kind of noise that is left out however much text it holds.
ALWAYS = "always"
#: Elements that hold a paragraph or are one.
PARAGRAPHS = {"p", "td", "th", "li"}
#: An open element is closed by the start of these.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
}

#: Names of what consists of links or fields, and the elements that are fields.
LINKED = set("nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager social search toolbar login".split())
FIELDS = {"input", "select", "button", "textarea"}
#: Names of what may wrap an article; all other noise is left out however much text it holds.
WRAPPERS = LINKED | set("form widget widgets header site-header siteheader page-header pageheader footer footers masthead topbar".split())
#: Elements that no noise holds, whatever its name.
HEADS = {"h1", "main"}
#: Classes of a header that belongs to an article.
OWN_HEADER = re.compile(r"(?<![a-z])(?:entry|post|article|story|content|single)[-_]+(?:header|heading|title|top)(?![a-z])")

#: One attribute: a quote begins a value only where the value begins, elsewhere it is a character like any other.
_ATTR = r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*))?)?"
ATTR = re.compile(_ATTR)
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|{re.sub(r'[(](?![?])', '(?:', _ATTR)})*+)(?:>|\Z)",
    re.S,
)


class Node:
    __slots__ = ("name", "parent", "children", "chars", "links", "tags", "link_tags", "density", "total", "block", "own", "noise", "home")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent, self.children = name, parent, []
        self.chars = self.links = self.tags = self.link_tags = self.own = 0
        self.noise = ""
        self.home = self if name in HOMES else parent and parent.home  # the nearest article, if any
        self.density = self.total = 0.0
        self.block = name in BLOCKS


def noise(name: str, attrs: str, in_article: bool, by_class: bool) -> str:
    """Whether an element and all below it are no part of an article: ALWAYS, the name that says so, or nothing."""
    if name in NEVER or name == "header" and not in_article and not OWN_HEADER.search(attrs.lower()):
        return ALWAYS
    if not by_class or name in ("html", "body", "article", "main"):
        return ""
    found = ""
    for key, *values in ATTR.findall(attrs):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id"):
            for word in value.split():
                if m := NOISE.match(word):
                    found = found or m[1]
                elif word == "header" and not in_article:
                    found = found or word
        elif key == "role" and value in ("form", "search"):
            found = found or value
        elif (key, value) == ("aria-hidden", "true") or key == "role" and value in ROLES:
            return ALWAYS
        elif key == "style" and re.search(r"display\s*:\s*none", value):
            return ALWAYS
    if re.search(r"(?<!\S)hidden(?!\S)", attrs):
        return ALWAYS
    return found or ("form" if name == "form" else "")


class Open:
    """The open elements, outermost first."""

    def __init__(self, root: Node):
        self.root = root
        self.restart()

    def restart(self) -> None:
        self.stack, self.count = [self.root], Counter()
        self.lines: list[Node] = []  # those that end or hold a paragraph

    @property
    def last(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.count[node.name] += 1
        if node.name in PARAGRAPHS:
            self.lines.append(node)

    def pop(self) -> Node:
        node = self.stack.pop()
        self.count[node.name] -= 1
        if node.name in PARAGRAPHS:
            self.lines.pop()
        return node

    def close(self, name: str) -> None:
        """Ends the nearest element of that name and all within it; nothing where none is open."""
        while self.count[name]:
            if self.pop().name == name:
                break


def parse(page: str, by_class: bool = True) -> Node:
    """The tree of the page with its noise marked; texts are children of their element."""
    root = Node("html", None)
    open_, at, end = Open(root), 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if text := (page[at : m.start() if m else end]):
            open_.last.children.append(text)
        if not m:
            break
        at, (closing, name, attrs) = m.end(), m.groups()
        if name is None:
            if m[0].startswith("<![CDATA["):
                open_.last.children.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if closing:
            open_.close(name)
            continue
        if name in RAW:  # its content is no markup
            close = _raw_end(name).search(page, at)
            at = close.end() if close else end
            if close and (gt := page.find(">", at)) >= 0:
                at = gt + 1
            continue
        if name in ("html", "body"):
            if name == "body" and not open_.count["body"]:
                open_.restart()  # a head that was never closed ends here
                root.children.append(body := Node("body", root))
                open_.push(body)
            continue
        if open_.last.name == "math":  # a formula is one piece of text; a block ends one that was never closed
            if name not in BLOCKS:
                continue
            open_.pop()
        while name in CLOSES.get(open_.last.name, ()):
            open_.pop()
        if name in BLOCKS and open_.lines and open_.lines[-1].name == "p":
            open_.close("p")
        parent = open_.last
        parent.children.append(child := Node(name, parent))
        if name not in VOID:
            child.noise = noise(name, attrs, parent.home is not None, by_class)
            if name == "header" and not child.noise and child.home is None:
                child.home = parent  # the header of an entry
            open_.push(child)
    return root


@functools.cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I)


def walk(root: Node) -> list[Node]:
    """Every element, children before their parents, without recursion."""
    order, stack = [], [root]
    while stack:
        order.append(node := stack.pop())
        stack += [c for c in node.children if isinstance(c, Node)]
    return order[::-1]


def prune(nodes: list[Node]) -> None:
    """Counts the characters of every element's own text and takes the noise out of the tree; the last one is the root."""
    plain: dict[Node, int] = {}  # characters outside links and outside what is left out
    whole: dict[Node, int] = {}
    fields: dict[Node, int] = {}
    heads: dict[Node, bool] = {}
    for node in nodes:
        inner = [c for c in node.children if isinstance(c, Node)]
        node.own = sum(len(" ".join(html.unescape(c).split())) for c in node.children if isinstance(c, str))
        whole[node] = node.own + sum(whole[c] for c in inner)
        fields[node] = sum(fields[c] + (c.name in FIELDS) for c in inner)
        heads[node] = node.noise != ALWAYS and any(c.name in HEADS or heads[c] for c in inner)
        within = node.own + sum(plain[c] for c in inner)
        if node.noise and node.noise not in WRAPPERS:
            node.noise = "form" if heads[node] and node.noise != ALWAYS else ALWAYS
        plain[node] = 0 if node.name == "a" or node.noise == ALWAYS else within
    most = plain[nodes[-1]] / 2
    held, largest = Counter(), Counter()  # by all elements of one name together, and by one of them
    around: dict[Node | None, frozenset] = {None: frozenset()}
    homes = 0
    for node in reversed(nodes):
        names = around[node.parent]
        if ALWAYS in names:
            plain[node] = 0
        kind = ALWAYS if node.name == "a" else node.noise
        if kind and kind not in names:
            held[kind] += plain[node]
            largest[kind] = max(largest[kind], plain[node])
            names = names | {kind}
        elif node.name in HOMES and not names and plain[node]:
            homes += 1
            names = frozenset({"article"})
        around[node] = names

    def stays(node: Node) -> bool:
        if not node.noise:
            return True
        if node.noise == ALWAYS or homes == 1 and "article" not in around[node]:
            return False
        if node.noise in LINKED and not fields[node] and plain[node] > whole[node] / 2:
            return True
        return plain[node] > most or held[node.noise] > most >= largest[node.noise]

    for node in nodes:
        node.children = [c for c in node.children if isinstance(c, str) or stays(c)]


def densities(nodes: list[Node]) -> None:
    """Counts, composite densities and density sums of all elements; the last one is the root."""
    for node in nodes:
        node.chars += node.own
        node.links += node.own if node.name == "a" else 0
        for child in node.children:
            if isinstance(child, Node):
                node.chars += child.chars
                node.links += child.chars if node.name == "a" else child.links
                node.tags += child.tags + 1
                node.link_tags += child.link_tags + (child.name == "a")
                node.block = node.block or child.block
    share = nodes[-1].links / max(1, nodes[-1].chars)
    for node in nodes:
        node.density = density(node.chars, node.links, node.tags, node.link_tags, share)
        # formatting inside a line is no part of the structure: a line of text counts as its own only child
        node.total = sum(child.density for child in node.children if isinstance(child, Node) and child.block) or node.density


def density(chars: int, links: int, tags: int, link_tags: int, share: float) -> float:
    """Characters per tag, times the logarithm of how rare links are, to a base that grows with the linked text."""
    if not chars:
        return 0.0
    per_tag = chars / max(1, tags)
    base = math.log(chars / max(1, chars - links) * links + share * chars + math.e)
    rarity = chars / max(1, links) * max(1, tags) / max(1, link_tags)
    if not share:  # a page without links: nothing to adjust by
        return per_tag
    return per_tag * max(0.0, math.log(rarity)) / math.log(base)


def chosen(nodes: list[Node]) -> list[Node]:
    """The subtrees that hold the main text."""
    nodes = [n for n in nodes if n.block]
    best = max(reversed(nodes), key=lambda n: n.total)  # of equal ones the outermost
    threshold, node = best.density, best
    while node is not None and node.name != "html":
        threshold, node = min(threshold, node.density), node.parent
    below: dict[Node, Node] = {}
    for node in nodes:  # the largest sum below each element
        tops = (below[child] for child in node.children if isinstance(child, Node) and child.block)
        below[node] = max([node, *tops], key=lambda n: n.total)
    return [below[n] for n in nodes if n.density >= threshold > 0] or [best]


def main_text(page: str | None, by_class: bool = True) -> str:
    tree = parse(page or "", by_class)
    prune(walk(tree))
    nodes = walk(tree)
    densities(nodes)
    root = nodes[-1]
    if not root.chars:
        # a page whose every element looks like noise is read again without regard to class names
        return main_text(page, False) if by_class and page else ""
    marked = set(chosen(nodes))
    above: set[Node] = set()
    for node in marked:  # every element that holds some of the text
        while node is not None and node not in above:
            above.add(node)
            node = node.parent
    blocks: list[list[str]] = [[]]
    stack: list = [(root, False)]
    while stack:  # in page order; None ends the block of an element
        item, taken = stack.pop()
        if item is None:
            blocks.append([])
        elif isinstance(item, str):
            if taken:
                blocks[-1].append(html.unescape(item))
        elif item.name == "br":
            blocks[-1].append(" ")
        else:
            taken = taken or item in marked or item.name in HEADINGS and item.home in above
            if item.name in BLOCKS:
                blocks.append([])
                stack.append((None, False))
            stack += [(child, taken) for child in reversed(item.children)]
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of the main text of every page."""
    kind = {f.name: f.dataType.simpleString() for f in pages.schema}

    def one(i, url, page):
        text = main_text(page)
        return i, url, text, len(text)

    schema = f"`{id_col}` {kind[id_col]}, `{url_col}` {kind[url_col]}, text string, n_chars long"
    return map_texts(pages, [id_col, url_col, html_col], one, schema)
