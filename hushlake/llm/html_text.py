"""Operator 10: main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.llm.common import fresh

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; the last two may hold character references.
RAW = {"script", "style", "noscript", "template", "iframe", "noembed", "noframes", "xmp", "plaintext", "textarea", "title"}
#: Never part of the main text.
SKIP = RAW | set("head nav footer aside button select option menu dialog svg math canvas object audio video map fieldset datalist".split())
BLOCK = set(
    "address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table "
    "tbody td tfoot th thead tr ul caption".split()
)
PARAGRAPH = set("p pre blockquote li td dd h1 h2 h3 h4 h5 h6".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key closes an open element of the values, up to the barrier.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = {"ul", "ol", "dl", "table", "div", "article", "section", "body", "menu", "select"}
#: Words of a class or id that mark what is not the article. A name that is just such a word takes its node out with all
#: below it; one made of it and others (has-comments, ad-free) is weighed, as it may be the layout's or a state's name.
APART = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|comments?|commentlist|consent|cookies?|disqus|newsletter|popup|promo\w*|related|replies|reply|respond|shoutbox|"
    r"sponsor\w*|subscribe|teaser)(?=$|[\s_-])", re.I,
)
#: Words that mark what is around an article, or a layout that has such things: what they mark may hold the article.
AROUND = re.compile(
    r"(?:^|[\s_-])(?<!has-)(?<!with-)(?<!no-)(?:banner|breadcrumbs?|disclaimer|footer|footnav|header|masthead|menu|modal|nav|navbar|navigation|notice|notification|pager|"
    r"pagination|share|sharing|sidebar|social|toolbar|widget)(?=$|[\s_-])", re.I,
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar"}

#: Words that name an article's own container, or a state.
OWN = re.compile(
    r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text|accepted|closed|disabled|enabled|free|has|layout|no|off|on|open|with|without)(?=$|[\s_-])", re.I
)

#: A container stays the best one, though another has more against it (cost 1; 2 or more), if it scores this part of the other's.
DOUBT = (1 / 3, 0.1)

#: What a container around the article must score less than, as a part of one in a marked node, for that node to count.
RESCUE = 1 / 3

#: A tag ends at the first > outside quoted values; a quote that is never closed is an ordinary character.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|/|$)""", re.I)
SPACE = re.compile(r"\s+")


#: Whether a node is part of the main text: FREE ones may be, HELD ones only if the text is found in them, DOUBTFUL ones
#: only if next to nothing is found elsewhere, GONE ones never.
FREE, HELD, DOUBTFUL, GONE = 0, 1, 2, 3


@dataclass(eq=False)
class Node:
    tag: str
    parent: Node | None = None
    mark: int = FREE
    inside: bool = False
    cost: int = 0
    children: list[Node | str] = field(default_factory=list)
    score: float = 0.0
    chars: int = 0
    link_chars: int = 0


def _mark(tag: str, attributes: str, inside: bool) -> tuple[int, int]:
    """What a node's tag and attributes say, and how much they speak against it. A header is apart unless it is an
    article's own; a form may stand round a whole page."""
    if tag in SKIP or (tag == "header" and not inside):
        return GONE, 0
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return GONE, 0
    names = (found.get("class", ""), found.get("id", ""))
    if tag != "main":
        if tag != "form" and found.get("role", "").lower() in ROLES:
            return GONE, 0
        apart = any(map(APART.search, names))
        if apart and tag != "article" and any(APART.fullmatch(w) for n in names for w in n.split()):
            return GONE, 0
        if apart or tag == "form":
            return DOUBTFUL, 1 if tag == "article" or not apart or any(map(OWN.search, names)) else 2
    # Articles may name the layout around them in their class.
    if tag not in ("main", "article") and any(map(AROUND.search, names)):
        return HELD, int(any(AROUND.fullmatch(w) for n in names for w in n.split()))
    return FREE, 0


class _Open:
    """The elements that are open, and where those of each tag are among them."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def close(self, place: int) -> None:
        """Close the element at ``place`` and all within it."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()


def parse(page: str) -> Node:
    """A tree of the page; end tags that fit nothing are left out, open elements end with their parent. Each tag costs
    the same, however many are open or do not fit."""
    root = Node("html")
    open_, at, endless = _Open(root), 0, set()
    while at < len(page):
        node = open_.nodes[-1]
        m = TAG.search(page, at)
        if not m:
            node.children.append(page[at:])
            break
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            place = open_.last([tag])
            if place:
                open_.close(place)
            elif tag == "p":
                node.children.append(Node("p", node))
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCK:
            paragraph = open_.last(["p"])
            if paragraph:  # a block ends an open paragraph
                open_.close(paragraph)
        if tag in CLOSES:
            place = open_.last(CLOSES[tag])
            if place > open_.last(BARRIER):
                open_.close(place)
        node = open_.nodes[-1]
        inside = node.inside or node.tag in ("article", "main")
        mark, cost = _mark(tag, m[3] or "", inside)
        new = Node(tag, node, mark, inside, cost)
        node.children.append(new)
        if tag in RAW:
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if end:
                at = end.end()
                continue
            endless.add(tag)
            if tag in ("script", "style"):
                at = len(page)
            else:
                open_.push(new)
        elif tag not in VOID and not (m[3] or "").endswith("/"):
            open_.push(new)
    return root


def _up(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _walk(root: Node, most: int = FREE) -> list[Node]:
    """Nodes that may be part of the main text, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.mark > most:
            continue
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def _density(node: Node) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def measure(nodes: list[Node]) -> None:
    """Characters and characters in links of each node, from the leaves up."""
    for node in reversed(nodes):
        own = sum(len(SPACE.sub(" ", html.unescape(c)).strip()) for c in node.children if isinstance(c, str))
        node.chars += own
        if node.tag == "a":
            node.link_chars = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars


def blocks(top: list[Node]) -> list[str]:
    """The text of each block in page order, white space made one space."""
    out, held = [], []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(held)).strip()
        if text:
            out.append(text)
        held.clear()

    stack: list[Node | str | None] = list(reversed(top))
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            held.append(html.unescape(item))
        elif item.tag == "br":
            held.append(" ")
        elif item.mark == FREE:
            own = item.tag in BLOCK
            if own:
                flush()
                stack.append(None)
            stack.extend(reversed(item.children))
    flush()
    return out


def _score(nodes: list[Node], apart: bool = False) -> list[Node]:
    """Points of paragraphs go to what holds them (``apart``: up to a node that something speaks against); the nodes that got some."""
    scored: dict[int, Node] = {}
    for node in nodes:
        node.score = 0.0
    for node in nodes:
        if node.tag not in PARAGRAPH and not (node.tag in BLOCK and any(isinstance(c, str) and c.strip() for c in node.children)):
            continue
        if node.chars < 25 or node.tag in HEADING:
            continue
        commas = sum(c.count(",") for c in node.children if isinstance(c, str))
        points, share = 1 + commas + min(node.chars // 100, 3), 1.0
        for depth, x in enumerate(_up(node.parent if node.tag in PARAGRAPH else node)):
            x.score += points * share
            scored[id(x)] = x
            share = 0.5 if depth == 0 else share / 3
            if depth == 3 or (apart and x.cost):
                break
    return [n for n in nodes if id(n) in scored]


def _worth(node: Node) -> float:
    return node.score * (1 - _density(node))


def free_doubtful(root: Node) -> None:
    """Decide on doubtful nodes. Points stay within a node that something speaks against. The container with the least
    against it is taken, unless it scores next to nothing beside the best one with more against it (see DOUBT). Doubtful
    nodes around the one taken stay; all others go, those within it too."""
    nodes = _walk(root, DOUBTFUL)
    if all(n.mark != DOUBTFUL for n in nodes):
        return
    measure(nodes)
    against: dict[int, int] = {}
    best: dict[int, Node] = {}
    for n in nodes:
        against[id(n)] = max(n.cost, against[id(n.parent)] if n.parent is not None else 0)
    for n in _score(nodes, apart=True):
        held = best.get(against[id(n)])
        if _worth(n) > (_worth(held) if held else 0.0):
            best[against[id(n)]] = n
    chosen = None
    for cost in sorted(best, reverse=True):
        if all(_worth(best[cost]) >= DOUBT[min(c, 2) - 1] * _worth(best[c]) for c in best if c > cost):
            chosen = best[cost]
    for up in _up(chosen):
        if up.mark == DOUBTFUL:
            up.mark = FREE
    for n in nodes:
        n.chars = n.link_chars = 0


def free_held(root: Node) -> None:
    """Decide on nodes that name a layout: what holds the page's article or main elements, or the best container by far, stays."""
    nodes = _walk(root, HELD)
    if all(n.mark == FREE for n in nodes):
        return
    if not any(n.tag in ("article", "main") for n in _walk(root)):
        seen: set[int] = set()
        for node in nodes:
            if node.tag in ("article", "main") and not node.inside:
                for up in _up(node.parent):
                    if id(up) in seen:
                        break
                    seen.add(id(up))
                    up.mark = FREE
    held = [n for n in nodes if n.mark == HELD]
    if not held:
        return
    measure(nodes)
    scored = _score(nodes)
    below, stack = set(), list(held)
    while stack:
        node = stack.pop()
        if id(node) not in below:
            below.add(id(node))
            stack.extend(c for c in node.children if isinstance(c, Node))
    in_held = [n for n in scored if id(n) in below]
    best = max(in_held, key=_worth, default=None)
    if best is None or not _worth(best):
        return
    # Points that came up from marked nodes do not count for what is around them.
    free = [n for n in nodes if id(n) not in below]
    for n in nodes:
        n.chars = n.link_chars = 0
    most = _worth(best)
    measure(_walk(root))
    _score(_walk(root))
    if max(map(_worth, free), default=0.0) < RESCUE * most:
        for up in _up(best):
            up.mark = FREE


def main_text(page: str) -> str:
    """The main text of a page.

    Each paragraph of 25 characters or more scores 1, its commas and one for each 100 characters up to 3; its parent
    gets all of that, the one above half, those above less. A container's score is cut by its link density, and the
    best one holds the text. Siblings stay too if they score a fifth of it, or are paragraphs or headings with few
    links. A best container inside an article or main element stands for that whole element. Menus, scripts, hidden nodes,
    adverts, comments and so on never count; forms and nodes whose class or id only has such a word as a part (has-comments,
    ad-free) count where what is outside them scores little beside what is in them. A node whose class or id names a layout (sidebar, header,
    share ..) counts where the page's only article or main elements are in it, or where the best container by far is. A page without
    a paragraph that scores gives its articles, or else all that is left, unless most of it is links.
    """
    root = parse(page)
    free_doubtful(root)
    free_held(root)
    nodes = _walk(root)
    for node in nodes:
        node.chars = node.link_chars = 0
    measure(nodes)
    scored = _score(nodes)
    if not scored:
        marked = [n for n in nodes if n.tag in ("article", "main") and n.chars and not n.inside]
        return " ".join(blocks(marked or [root])) if _density(root) < 0.5 or marked else ""
    best = max(scored, key=_worth)
    if not _worth(best):
        return ""  # nothing but links
    for up in _up(best):
        if up.tag in ("article", "main"):
            up.score = max(up.score, best.score)
            best = up
    if best.parent is None:
        return " ".join(blocks([best]))
    limit = 0.2 * _worth(best)
    keep: list[Node | str] = []
    for c in best.parent.children:
        if isinstance(c, str) or c is best or c.mark != FREE:
            if c is best:
                keep.append(c)
            continue
        if _worth(c) >= max(limit, 1e-9) or (c.tag in PARAGRAPH and c.chars and _density(c) < 0.25):
            keep.append(c)
    return " ".join(blocks(keep))


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with ``out_col``, the main text of ``html_col`` (see main_text), and n_chars, its code points.

    A null or empty page, and one without text, gives an empty string. Pages are read whole, however long, each on its
    own; broken markup and cut-off pages are read as far as they go. Repeated rows give equal texts; empty input gives
    no rows. Columns of these names that ``pages`` has already are replaced.
    """

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([main_text(p) for p in part.to_pylist()], pa.string())

    source = fresh(pages, "_html")
    rows = pages.withColumn(source, F.coalesce(F.col(html_col), F.lit("")))
    rows = rows.withColumn(out_col, F.arrow_udf(run, "string")(F.col(source))).drop(source)
    return rows.withColumn("n_chars", F.length(out_col).cast("long"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
