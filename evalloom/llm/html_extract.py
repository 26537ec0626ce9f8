"""Main text of web pages by tree scoring.

A page becomes a tree; paragraphs pass points for their length and commas to parent (whole), grandparent (half) and further
ancestors (less), a container's score is discounted by its link density, and the best container is kept with those of its
siblings that score or read like it. Subtrees that can only be furniture (navigation, headers, footers, asides, forms,
scripts, comment sections, adverts, notices) neither score nor show. Elements are furniture by what they are, or by words in
their class and id; the latter are kept all the same where they hold the page's article or most of its text.

Each page is one row: it is parsed and scored where it is read, without a shuffle, and tree and text are bounded by the page.

Defined results
* null or empty html, or a page without text: text '' and n_chars 0.
* text that no markup wraps (no tags at all) is one block.
* ties: the container that comes first in the page, the deeper one of two nested.
* repeated rows are extracted each on its own; extra columns are dropped, and ``page_id``, ``url`` pass through as they are.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.session import ship

# Elements of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object xmp noframes noembed".split())
DROP = frozenset("script style textarea title noscript iframe template svg math object head nav footer aside form button select option input label fieldset dialog menu audio video canvas map xmp noframes noembed applet".split())
BLOCK = frozenset(
    "address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
CELL = frozenset(("td", "th", "dt", "dd"))
PARAGRAPH = frozenset("p pre blockquote td li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
CLOSES_P = BLOCK - frozenset(("br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"))
SELF_NESTING = {"li": frozenset(("ul", "ol", "menu", "dir")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")), "option": frozenset(("select",))}
INLINE_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# Words of class and id names (whole parts between -, _ and spaces, or camel-case humps).
FURNITURE = frozenset(
    """ad ads advert adverts advertisement advertising adsense adslot banner banners billboard breadcrumb breadcrumbs byline-share comment comments
    commentlist commenting consent cookie cookies copyright discuss disqus dropdown extra foot footer footnav form gdpr header hidden infobar legal login
    masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup popular
    promo promos promoted promotion recommended register related remark replies reply respond rss search share sharing shares shoutbox sidebar sidenav
    sidebars signup skip skyscraper social sponsor sponsored sponsors subscribe subscription syndication tagcloud tags teaser toc toolbar topbar tracking
    trending widget widgets warning alert dialog disclaimer""".split()
)
#: Of these, those that make furniture of a paragraph inside an article, too, where one is a whole class of it.
ADVERT = frozenset("ad ads advert adverts advertisement advertising adsense adslot comment comments cookie cookies consent gdpr hidden newsletter promo promos promoted sponsor sponsored sponsors".split())
CONTENT = frozenset("article articlebody body content entry hentry main maincontent page post postbody story text blog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split())

#: Inline elements end inside these; the search for an open paragraph ends at those.
FENCES = frozenset(("td", "th", "table", "article"))
P_STOPS = frozenset("td th table div article section button body li blockquote".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_REST = re.compile(r"<!--.*\Z|<!\[CDATA\[.*\Z|<[!?][^>]*\Z()()()()()()", re.S)
#: The end tag of a raw element, in ASCII case: lower-casing a page may change its length.
_RAW_END = {tag: re.compile(f"</{tag}(?![a-z0-9])", re.I | re.A) for tag in RAW}
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


HARD, NAMED = 2, 1


class Node:
    __slots__ = ("tag", "names", "parent", "children", "own", "dropped", "score", "scored", "order", "sizes", "story")

    def __init__(self, tag: str, parent: Node | None, names: frozenset[str], own: int, order: int):
        #: 2 in an article or main, 1 in a container that its names call content, 0 elsewhere
        self.story = 2 if tag in ("article", "main") else max(parent.story if parent else 0, int(tag in ("div", "section") and bool(names & CONTENT)))
        self.tag, self.parent, self.names, self.order = tag, parent, names, order
        #: Furniture of its own: HARD by what it is, NAMED by its class and id only.
        self.own = own
        self.dropped = bool(own) or parent is not None and parent.dropped
        self.children: list[Node | str] = []
        self.score, self.scored, self.sizes = 0.0, False, None


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw and not raw.isspace() else {}


def _names(attributes: dict[str, str]) -> frozenset[str]:
    said = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    if said == " ":
        return frozenset()
    return frozenset(w.lower() for w in re.split(r"[\s_-]+", said) if w) | frozenset(w.lower() for w in _PARTS.findall(said))


def _furniture(tag: str, attributes: dict[str, str], names: frozenset[str], parent: Node) -> int:
    if tag in DROP or "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in ROLES or _HIDDEN.search(attributes.get("style", "")):
        return HARD
    if tag == "header":  # an article's own header holds its headline
        return HARD * (parent.story < 2)
    if parent.story and (tag in PARAGRAPH or tag not in BLOCK):  # such words on a paragraph of the story, or on a part of one
        return HARD * (bool(names & ADVERT) and not ADVERT.isdisjoint(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()))
    return NAMED * (bool(names & FURNITURE) and not names & CONTENT and tag not in ("body", "html", "article", "main"))


class _Open:
    """Open elements by name, so that no tag looks for a partner that is not there: in all, and inside the innermost cell,
    table or article; and open paragraphs inside the innermost element that ends the search for one."""

    def __init__(self) -> None:
        self.all: dict[str, int] = {}
        self.near: list[dict[str, int]] = [{}]
        self.paragraphs = [0]

    def enter(self, tag: str) -> None:
        self.all[tag] = self.all.get(tag, 0) + 1
        self.near[-1][tag] = self.near[-1].get(tag, 0) + 1
        if tag in FENCES:
            self.near.append({})
        if tag in P_STOPS:
            self.paragraphs.append(0)
        self.paragraphs[-1] += tag == "p"

    def leave(self, here: Node, to: Node) -> Node:
        """Close all elements from ``here`` up to below ``to``."""
        while here is not to:
            tag = here.tag
            self.paragraphs[-1] -= tag == "p"
            if tag in P_STOPS:
                self.paragraphs.pop()
            if tag in FENCES:
                self.near.pop()
            self.near[-1][tag] -= 1
            self.all[tag] -= 1
            here = here.parent
        return here


def parse(page: str) -> Node:
    """The tree of a page; unclosed and crossed tags are closed as browsers close them, as far as blocks are concerned."""
    root, opened = Node("#root", None, frozenset(), 0, 0), _Open()
    at, here, order, n = 0, root, 0, len(page)
    closed = page.rfind(">")  # beyond it no tag ends; looked for at every "<", that would take the square of the page
    while at < n:
        m = _TOKEN.search(page, at) if at <= closed else _REST.search(page, at)
        if m is None:
            here.children.append(page[at:])
            break
        if m.start() > at:
            here.children.append(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                here.children.append(m[0][9:-3].replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            there = (opened.all if tag in BLOCK or tag in FENCES else opened.near[-1]).get(tag, 0)
            if there:
                up = here
                while up.tag != tag:
                    up = up.parent
                here = opened.leave(here, up.parent)
            elif tag == "p":
                here.children.append(Node("p", here, frozenset(), 0, order))
            continue
        raw = m[3] or m[6] or ""
        if tag in CLOSES_P and opened.paragraphs[-1]:  # a block ends an open paragraph
            up = here
            while up.tag != "p":
                up = up.parent
            here = opened.leave(here, up.parent)
        if tag in SELF_NESTING:
            up, stop = here, SELF_NESTING[tag]
            same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            if any(opened.all.get(x) for x in same):
                while up is not root and up.tag not in stop:
                    if up.tag in same:
                        here = opened.leave(here, up.parent)
                        break
                    up = up.parent
        attributes = _attributes(raw)
        names = _names(attributes)
        order += 1
        node = Node(tag, here, names, _furniture(tag, attributes, names, here), order)
        here.children.append(node)
        if tag in VOID or raw.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else n
            continue
        opened.enter(tag)
        here = node
    _keep_stories(root)
    return root


def _keep_stories(root: Node) -> None:
    """Names alone never cost a page its story: containers that are furniture by their names only are kept after all where
    they hold the page's article, or most of its text."""
    nodes, stack = [], [root]
    while stack:
        here = stack.pop()
        nodes.append(here)
        stack += [c for c in reversed(here.children) if isinstance(c, Node) and c.own != HARD]
    if not any(n.own == NAMED for n in nodes):
        return
    story = lambda n: n.tag in ("article", "main") and (not n.names & FURNITURE or bool(n.names & CONTENT))
    size: dict[int, int] = {}
    holds: dict[int, bool] = {}
    for here in reversed(nodes):
        inner = [c for c in here.children if isinstance(c, Node) and c.own != HARD]
        size[id(here)] = sum(len(c.strip()) for c in here.children if isinstance(c, str)) + sum(size[id(c)] for c in inner)
        holds[id(here)] = story(here) or any(holds[id(c)] and c.own == 0 for c in inner)
    every = size[id(root)]
    # An article, or a container that its names call content, with a paragraph at least, stands outside of all of them.
    told = any(not n.dropped and (story(n) or n.story and size[id(n)] >= 140) for n in nodes)
    for here in nodes:  # parents first
        if here is root:
            continue
        if here.own == NAMED and not here.parent.dropped:
            # what may be a list of comments or an advert counts as the story only where next to nothing else is there
            share = 0.9 if here.names & ADVERT else 0.5
            if not told and (holds[id(here)] or size[id(here)] > share * every):
                here.own = 0
        here.dropped = bool(here.own) or here.parent.dropped


def _blocks(node: Node, out: list[list[str]]) -> None:
    """Text of ``node`` in blocks: inline elements stay in the block they are in."""
    stack: list[tuple[Node, int]] = [(node, 0)]
    if node.tag in BLOCK:
        out.append([])
    while stack:
        here, k = stack.pop()
        if k == len(here.children):
            if here.tag in BLOCK:
                out.append([])
            continue
        stack.append((here, k + 1))
        child = here.children[k]
        if isinstance(child, str):
            out[-1].append(child)
        elif not child.dropped:
            if child.tag in BLOCK:
                out.append([])
            if child.children:
                stack.append((child, 0))


def clean(parts: list[str]) -> str:
    return _SPACE.sub(" ", html_lib.unescape("".join(parts))).strip()


def text_of(nodes: list[Node]) -> str:
    blocks: list[list[str]] = [[]]
    for node in nodes:
        if node.tag not in BLOCK:
            blocks.append([])
        _blocks(node, blocks)
        blocks.append([])
    return "\n".join(t for t in map(clean, blocks) if t)


def measure(node: Node) -> tuple[int, int]:
    """(characters of text, of them in links) below ``node``, bottom up; remembered in the nodes."""
    order, stack = [], [node]
    while stack:
        here = stack.pop()
        order.append(here)
        stack += [c for c in here.children if isinstance(c, Node) and not c.dropped]
    for here in reversed(order):
        text = links = 0
        for c in here.children:
            if isinstance(c, str):
                text += len(c.strip())
            elif not c.dropped:
                text += c.sizes[0]
                links += c.sizes[1]
        here.sizes = (text, text if here.tag == "a" else links)
    return node.sizes


def own_text(node: Node) -> str:
    """Text of a paragraph without that of block elements inside it."""
    out, stack = [], list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            out.append(c)
        elif not c.dropped and c.tag not in PARAGRAPH and (c.tag not in BLOCK or c.tag == "br"):
            stack += reversed(c.children)
    return clean(out)


def density(node: Node) -> float:
    text, links = node.sizes
    return links / text if text else 0.0


def walk(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped]


def best(root: Node) -> list[Node]:
    """The nodes to keep, in page order."""
    measure(root)
    for node in walk(root):
        if node.tag not in PARAGRAPH and not (node.tag in BLOCK and any(isinstance(c, str) and c.strip() for c in node.children)):
            continue
        text = own_text(node)
        if len(text) < 25 or density(node) > 0.5:
            continue
        points = 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 3)
        up, level = node.parent, 0
        if node.tag not in PARAGRAPH:
            up, level = node, 0  # text directly in a container is that container's paragraph
        while up is not None and level < 6:
            if up.tag in BLOCK and up.tag not in PARAGRAPH or up.tag in ("#root", "blockquote"):
                up.score += points / (1, 2, 6, 9, 12, 15)[level]
                up.scored = True
                level += 1
            up = up.parent
    candidates = [n for n in walk(root) if n.scored]
    if not candidates:
        return [root]
    for n in candidates:
        n.score += 25 * bool(n.names & CONTENT) + 30 * (n.tag == "article") + 20 * (n.tag == "main")
        n.score *= 1 - density(n)
    top = max(candidates, key=lambda n: (n.score, -n.order))
    # text of one article may be spread over sections: take the ancestor while it gathers several good containers
    while top.parent is not None and top.parent.tag not in ("#root", "html", "body") and top.tag not in ("article", "main"):
        good = [c for c in top.parent.children if isinstance(c, Node) and c.scored and c.score >= 0.25 * top.score]
        if len(good) < 2 and top.parent.tag not in ("article", "main"):
            break
        top = top.parent
    if top.parent is None:
        return [top]
    limit = max(10.0, 0.2 * top.score)
    keep = []
    for c in top.parent.children:
        if not isinstance(c, Node) or c.dropped:
            continue
        if c is top:
            keep.append(c)
        elif c.tag in INLINE_HEADING and top.tag not in ("article", "main"):
            keep.append(c)
        elif c.tag == top.tag and c.tag not in ("article", "main") and density(c) < 0.3 and (c.names == top.names if c.names or c.tag != "section" else not top.names):
            keep.append(c)  # another part of the same kind
        elif c.scored and c.score >= limit and density(c) < 0.3 and (top.tag not in ("article", "main") or c.tag == top.tag):
            keep.append(c)
        elif c.tag == "p" and top.tag not in ("article", "main"):
            n = len(own_text(c))
            if n > 80 and density(c) < 0.25 or 0 < n <= 80 and density(c) == 0 and own_text(c).rstrip()[-1:] in ".!?":
                keep.append(c)
    return keep


def main_text(page: str | None) -> str:
    if not page or not page.strip():
        return ""
    root = parse(page)
    return text_of(best(root))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    ship(pages.sparkSession)
    rest = [pages.schema["page_id"], pages.schema["url"]]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col(f"`{html}`").cast("string")).mapInArrow(run, kinds)
