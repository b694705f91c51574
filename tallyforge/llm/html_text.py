"""Main text of web pages by composite text density.

A tolerant parser builds each page's tree. Elements that by name, role or
class are menus, headers, footers, notices, adverts, forms, scripts or comments
are left out, unless they wrap the page's main text (see resolve). Every other
node gets its composite density: characters per tag, adjusted by the share of
its characters and tags in links and by the body's.
The node with the largest sum of child densities is the core, taken whole; the
least density of the nodes above it on its path to the body is the threshold.
The core is then widened to the body, or, where an article or main element
stands on that path, to the body's child. Of what the nodes on the path have
beside it, blocks that reach the threshold are kept; of others only the blocks
inside that reach it. Headings are kept, and runs of own text and inline
elements that are not mostly links. Inside an article or main element that holds
the core nothing is left out by its density, since all of it is the article.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul option".split())
DROPPED = frozenset("head script style noscript template nav header footer aside button select textarea input iframe object embed svg math canvas audio video dialog menu title label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMS = frozenset("form fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Whole words of class or id (split at - _ and capitals) that mark other parts.
NOISE = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination sidebar sidebars sidenav footer header masthead topbar toolbar comment comments commentlist discussion disqus replies respond cookie cookies consent gdpr notice notices notification notifications alert newsletter subscribe subscription signup login popup modal overlay share sharing social related recommended recommendations widget widgets skip copyright legal disclaimer".split())
#: Words beside those of NOISE that leave a name as clear as it is (comment-list),
#: and words that tell of a page's layout, not of what an element is (has-sidebar).
PLACES = frozenset("area areas list lists section sections wrap wrapper container box block inner outer item items body row col text user site post page entry top bottom left right global primary secondary the my js".split())
STATES = frozenset("has with no without is not show hide".split())
#: Marks: an article of such a name (a comment, say), none, a word among others
#: (or a form), a name of such words, certain.
OTHER, PLAIN, WORD, NAME, SURE = range(-1, 4)
#: Opening one of these closes an open one of those, up to a container.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
ENDS_P = BLOCKS - {"br", "body", "html", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
P_SCOPE = frozenset({"body", "html", "table", "td", "th", "caption", "article", "div", "section", "li", "blockquote", "main"})
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Node:
    """An element. block: itself or the nearest block around it; of a block,
    inline has how many inline elements of a name are open in it."""

    __slots__ = ("name", "up", "parts", "mark", "dropped", "chars", "tags", "link_chars", "link_tags", "density", "total", "block", "inline")

    def __init__(self, name: str, up: Node | None, mark: int = 0):
        self.name, self.up, self.mark, self.dropped, self.parts = name, up, mark, mark == SURE, []
        self.block = self if up is None or name in BLOCKS else up.block
        self.inline: dict[str, int] | None = {} if self.block is self else None
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def mark(name: str, attrs: str) -> int:
    if name in DROPPED:
        return SURE
    out = WORD if name in FORMS else PLAIN
    if not attrs or name in ("html", "body"):
        return out
    if name in ("article", "main"):
        return OTHER if mark("div", " ".join(m[0] for m in ATTR.finditer(attrs) if m[1].lower() in ("class", "id"))) == NAME else PLAIN
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), html.unescape((m[2] or "").strip("\"'"))
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return SURE
        if key == "role" and value.lower() in ROLES:
            if name not in FORMS or value.lower() != "form":
                return SURE
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return SURE
        if key in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in WORDS.findall(token)]
                if not NOISE.isdisjoint(words) and STATES.isdisjoint(words):
                    clear = all(w in NOISE or w in PLACES or w.isdigit() for w in words) and "page" not in words[:1]
                    out = max(out, NAME if clear else WORD)
    return out


def resolve(body: Node) -> None:
    """Says which marked elements are left out. One that holds the page's main
    article (an article, or else a main element, with at least half of the text
    in such elements, and half as much as is outside elements marked by name) is kept,
    whatever its name. So is one marked by a word among others, or a form, with
    more than half of the page's text outside links; without a main article,
    also the largest marked by name, if there is hardly any text outside such."""
    nodes, todo = [], [body]
    while todo:
        n = todo.pop()
        nodes.append(n)
        todo.extend(p for p in n.parts if isinstance(p, Node) and p.mark != SURE)
    if all(n.mark <= PLAIN for n in nodes):
        return
    for n in reversed(nodes):
        n.chars = 0 if n.name == "a" else sum(len(" ".join(p.split())) if isinstance(p, str) else p.chars if p.mark < NAME else 0 for p in n.parts)
    found, inside = [], 0
    for n in nodes:
        if n.name in ("article", "main"):
            found.append(n)
            up = n.up
            while up is not None and up.name not in ("article", "main"):
                up = up.up
            inside += n.chars if up is None else 0
    # Articles before main elements, larger ones before smaller.
    found = [n for n in found if n.mark == PLAIN and n.chars and 2 * n.chars >= max(inside, body.chars)]
    n = max(found, key=lambda n: (n.name == "article", n.chars), default=None)
    if n is None:
        n = max((n for n in nodes if n.mark == NAME and 20 * body.chars < n.chars), key=lambda n: n.chars, default=None)
    holding, text = set(), max(body.chars, n.chars if n is not None else 0)
    while n is not None:
        holding.add(n)
        n = n.up
    for n in nodes:
        n.dropped = n.mark > PLAIN and n not in holding and not (n.mark == WORD and 2 * n.chars > text)
    for n in nodes:
        n.chars = 0


def tree(page: str) -> Node:
    root = Node("html", None)
    body = here = Node("body", root)
    root.parts.append(body)
    blocks: dict[str, int] = {}  # open blocks by name

    def closed(node: Node, to: Node) -> Node:
        """to, with all from node up to it closed."""
        while node is not to:
            if node.block is node:
                blocks[node.name] -= 1
            else:
                node.block.inline[node.name] -= 1
            node = node.up
        return to

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None or m.start() > at:
            stop = end if m is None else m.start()
            if stop > at:
                here.parts.append(html.unescape(page[at:stop]))
            if m is None:
                break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                here.parts.append(m[0][9:].removesuffix("]]>"))
            continue
        name = m[2].lower()
        if m[1]:
            # An inline element is closed within its block only.
            if blocks.get(name) if name in BLOCKS else here.block.inline.get(name):
                node = here
                while node.name != name:
                    node = node.up
                here = closed(here, node.up)
            continue
        if name in ("html", "body"):
            continue
        if name in CLOSES:
            mine, scope = CLOSES[name]
            if any(blocks.get(x) for x in mine):
                node, last = here.block, None
                while node is not body and node.name not in scope:
                    if node.name in mine:
                        last = node
                    node = node.up.block
                here = closed(here, last.up) if last is not None else here
        elif name in ENDS_P and blocks.get("p"):
            node = here.block
            while node.name != "p" and node.name not in P_SCOPE:
                node = node.up.block
            if node.name == "p":
                here = closed(here, node.up)
        new = Node(name, here, mark(name, m[3]))
        here.parts.append(new)
        if name in RAW and not m[0].endswith("/>"):
            stop = re.compile(rf"</{name}\s*[^>]*>", re.I).search(page, at)
            if name not in ("script", "style"):
                new.parts.append(html.unescape(page[at : stop.start() if stop else end]))
            at = stop.end() if stop else end
        elif name not in VOID and not m[0].endswith("/>"):
            here = new
            open_ = blocks if new.block is new else new.block.inline
            open_[name] = open_.get(name, 0) + 1
    resolve(body)
    return body


def kept(node: Node) -> list[Node]:
    """Nodes that are not left out, parents first."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(p for p in reversed(n.parts) if isinstance(p, Node) and not p.dropped)
    return out


def measure(body: Node) -> list[Node]:
    nodes = kept(body)
    for n in reversed(nodes):
        for p in n.parts:
            if isinstance(p, str):
                n.chars += len(" ".join(p.split()))
            elif not p.dropped:
                n.chars += p.chars
                n.tags += p.tags + 1
                n.link_chars += p.chars if p.name == "a" else p.link_chars
                n.link_tags += p.link_tags + (p.name == "a")
    share = body.link_chars / max(1, body.chars)
    for n in nodes:
        if n.chars:
            tags, links, link_tags = max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
            base = math.log(n.chars / max(1, n.chars - n.link_chars) * n.link_chars + share * n.chars + math.e)
            n.density = n.chars / tags * math.log(max(math.e, n.chars / links * tags / link_tags)) / max(1.0, base)
    for n in nodes:
        n.total = sum(p.density for p in n.parts if not isinstance(p, str) and not p.dropped)
    return nodes


def linked(part: Node | str) -> tuple[int, int]:
    """Characters of an inline part, and those in links."""
    if isinstance(part, str):
        return len(" ".join(part.split())), 0
    return part.chars, part.chars if part.name == "a" else part.link_chars


def sift(node: Node, on_path: Node | None, limit: float) -> None:
    """Leaves out what stands in node, beside the path, below the limit."""
    todo = [(node, on_path)]
    while todo:
        x, down = todo.pop()
        run: list = []
        parts = []
        for p in [*x.parts, None]:
            if isinstance(p, str) or p is not None and p.name not in BLOCKS and p is not down:
                run.append(p)
                continue
            chars, links = map(sum, zip(*map(linked, run), strict=True)) if run else (0, 0)
            # Below a block that misses the limit, only blocks that reach it count.
            if down is not None and 2 * links <= chars:
                parts += run
            run = []
            if p is None:
                break
            parts.append(p)
            if p is not down and not p.dropped and p.density < limit and not (down is not None and p.name in HEADINGS):
                todo.append((p, None))
        x.parts = parts


def core(body: Node, scale: float = 1.0) -> Node | None:
    """The node whose text is the page's. scale: of the threshold, for tests."""
    nodes = measure(body)
    if not body.chars:
        return None
    best = max(nodes, key=lambda n: n.total)
    if not best.total:
        return body
    path, n = [], best
    while n is not None and n.name != "html":
        path.append(n)
        n = n.up
    limit = scale * min((x.density for x in path[1:]), default=0.0)
    whole = max((i for i, x in enumerate(path) if x.name in ("article", "main")), default=None)
    if whole is not None:
        path = path[: max(whole + 1, len(path) - 1)]
    for down, x in zip(path[whole or 0 :], path[(whole or 0) + 1 :]):
        sift(x, down, limit)
    return path[-1]


def text_of(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.name in BLOCKS:
            out.append(" ")
            todo.append(" ")
            todo.extend(p for p in reversed(n.parts) if isinstance(p, str) or not p.dropped)
        else:
            todo.extend(p for p in reversed(n.parts) if isinstance(p, str) or not p.dropped)
    return " ".join("".join(out).split())


def main_text(page: str, scale: float = 1.0) -> str:
    found = core(tree(page), scale)
    return text_of(found) if found is not None else ""


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x.as_py()) for x in b.column("html")]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of pages (page_id, url, html).
    Null or empty html, and pages without text, have an empty text. Of nodes
    with equal sums the first in the page is the core. Pages may be of any
    length and depth: work grows with their length. Repeated rows get equal
    results, an empty table has none, extra columns are ignored."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
