"""Main text of HTML pages by composite text density.

Every element gets its characters per tag, adjusted for how many of them are links.
An element's sum is that of its children's densities; the element with the greatest
sum holds the article. The least density on its path to the body is the threshold
that any element off that path must reach to belong to it. An <article> or <main> on
the path or below it is taken instead, with its like siblings.

Elements that are no article text by kind, role or name are left out first, whatever
they hold, unless they lie around the article. Names that may go either way are
decided by the threshold that the rest of the page gives.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

#: How HTML elements are written and laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol option p pre section summary table tbody tfoot thead tr ul".split()
)
CLOSES = {  # a start tag ends an open element of these, up to the given border
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "body": (("head",), ()),
}
P_BORDER = frozenset("article aside blockquote body button caption dd div dl dt fieldset figure footer form header html li main nav section table td th tr ul ol".split())

#: Elements without article text, by name, by role and by words of class or id.
DROPPED = frozenset(
    "head nav header footer aside form button select input textarea script style noscript template "
    "iframe svg canvas object audio video dialog menu title noembed noframes xmp".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words that a class or id ends with, but for words of place and form. The first ones
#: name what is never article text. The others may name a part of the article as well,
#: which then is told by its density.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead comment comments disqus cookie cookies "
    "consent notice notices newsletter pagination pager login signup".split()
)
DOUBTFUL_WORDS = frozenset(
    "promo promotion banner header share sharing social related recommended subscribe subscription "
    "widget popup modal overlay toolbar".split()
)
FORM_WORDS = frozenset(
    "left right top bottom inner outer wrapper wrap container content box block area section list item "
    "items group bar panel body thread form link links button buttons icons".split()
)
#: With one of these in front a name says what is not there, or what is around it.
OTHER_WORDS = frozenset("no has with without is hide show".split())
HEADLINES = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"))
NEVER_BY_WORD = frozenset(("html", "body", "main"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*>?|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)*)>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?")
_WORD = re.compile(r"[a-zA-Z0-9]+")


class Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "doubtful", "chars", "tags", "link_chars", "link_tags", "density", "total", "like")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, like: str = ""):
        self.tag, self.parent, self.dropped, self.like = tag, parent, dropped, like
        self.doubtful = False
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _named(marks: str, words: frozenset[str]) -> bool:
    """Whether one of the names, class or id, ends with one of the words."""
    for name in marks.split():
        parts = _WORD.findall(name)
        while len(parts) > 1 and (parts[-1] in FORM_WORDS or parts[-1].isdigit()):
            parts.pop()
        if parts and parts[-1] in words and parts[0] not in OTHER_WORDS:
            return True
    return False


def _unwanted(tag: str, attributes: str) -> tuple[bool, bool, bool, str]:
    """Dropped for sure, dropped by a name, doubtful by a name, and the class."""
    if tag in DROPPED:
        return True, False, False, ""
    if not attributes.strip(" /\n\t\r"):
        return False, False, False, ""
    got = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    style = got.get("style", "").replace(" ", "").lower()
    sure = (
        "hidden" in got
        or got.get("aria-hidden", "").lower() == "true"
        or "display:none" in style
        or "visibility:hidden" in style
        or got.get("role", "").lower() in DROPPED_ROLES
    )
    marks = f"{got.get('class', '')} {got.get('id', '')}".lower()
    if tag in NEVER_BY_WORD or not marks.strip():
        return sure, False, False, got.get("class", "")
    return sure, _named(marks, DROPPED_WORDS), _named(marks, DOUBTFUL_WORDS), got.get("class", "")


def parse(page: str) -> Node:
    """The element tree of a page, however badly its tags are closed."""
    root = Node("#root", None)
    stack, marked = [root], []
    at = 0

    def close(names: tuple[str, ...] | frozenset[str], borders) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return
            if stack[i].tag in borders:
                return

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "p" and not any(n.tag == "p" for n in stack):
                continue
            if tag in ("body", "html"):
                continue
            borders = () if tag in BLOCK else ("td", "th", "article", "section", "main", "body")
            close((tag,), borders)
            continue
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        if tag in BLOCK:
            close(("p",), P_BORDER)
        if tag in CLOSES:
            close(*CLOSES[tag])
        sure, by_name, doubtful, like = _unwanted(tag, m[4])
        node = Node(tag, stack[-1], sure, like)
        stack[-1].parts.append(node)
        if (by_name or doubtful) and not sure:
            node.dropped, node.doubtful = by_name, doubtful and not by_name
            marked.append(node)
        if tag in VOID or m[4].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        stack.append(node)
    for node in reversed(marked):  # those within others first
        if _is_wrapper(node):
            node.dropped = node.doubtful = False
    return root


def _is_wrapper(node: Node) -> bool:
    """Whether an element lies around an article, whatever its name says: it holds an
    <article> or <main>, or the page's first headline and paragraphs."""
    if node.tag == "article":
        return False
    headline = paragraph = False
    todo = [x for x in node.parts if isinstance(x, Node)]
    while todo:
        x = todo.pop()
        if x.dropped:
            continue
        if x.tag in ("article", "main"):
            return True
        headline, paragraph = headline or x.tag == "h1", paragraph or x.tag == "p"
        todo.extend(y for y in x.parts if isinstance(y, Node))
    return headline and paragraph


def _order(root: Node) -> list[Node]:
    """All kept elements, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(x for x in node.parts if isinstance(x, Node) and not x.dropped)
    return out


def _measure(root: Node) -> list[Node]:
    """Count characters and tags, all and those in links, of each element."""
    nodes = _order(root)
    for node in nodes:
        node.chars = sum(len("".join(x.split())) for x in node.parts if isinstance(x, str))
        node.tags = node.link_chars = node.link_tags = 0
    for node in reversed(nodes):
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        up = node.parent
        if node is not root:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    return nodes


def _densities(body: Node, nodes: list[Node]) -> None:
    link_share = body.link_chars / max(body.chars, 1)
    for node in nodes:
        node.density = 0.0
        c, lc, t, lt = node.chars, node.link_chars, max(node.tags, 1), max(node.link_tags, 1)
        if c:
            base = math.log(c / max(c - lc, 1) * lc + link_share * c + math.e)
            ratio = c / max(lc, 1) * t / lt
            node.density = max(c / t * math.log(max(ratio, 1.0)) / math.log(max(base, 2.0)), 0.0)
    for node in nodes:
        node.total = sum(x.density for x in node.parts if isinstance(x, Node) and not x.dropped)
        if any(isinstance(x, str) and x.strip() for x in node.parts):
            node.total = max(node.total, node.density)


def _reaching(body: Node, top: Node, threshold: float) -> list[Node]:
    """`top`, the outermost elements off its path that reach the threshold, and the
    headlines before any of them under the same parent, in page order."""
    path, up = {body}, top.parent
    while up is not body and up is not None:
        path.add(up)
        up = up.parent
    out, todo = [], [body]
    while todo:
        node = todo.pop()
        if node is top or node not in path and node.density >= threshold:
            out.append(node)
        else:
            todo.extend(x for x in reversed(node.parts) if isinstance(x, Node) and not x.dropped)
    chosen = set(out)
    for parent in {x.parent for x in out}:
        later = False
        for x in reversed(parent.parts):
            if x in chosen:
                later = True
            elif later and isinstance(x, Node) and not x.dropped and x.tag in HEADLINES:
                chosen.add(x)
    if len(chosen) == len(out):
        return out
    return [x for x in _order_in_page(body) if x in chosen]


def _order_in_page(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(x for x in reversed(node.parts) if isinstance(x, Node) and not x.dropped)
    return out


def _best(body: Node) -> tuple[Node | None, float]:
    """The element with the greatest sum of densities, the first of equal ones, and
    the least density on its path to the body; none if the body has no text."""
    nodes = _measure(body)
    if not body.chars:
        return None, 0.0
    _densities(body, nodes)
    best = max(nodes, key=lambda n: n.total)
    threshold, up = best.density, best
    while up is not body:
        up = up.parent
        threshold = min(threshold, up.density)
    return best, threshold


def content_nodes(root: Node) -> list[Node]:
    """The elements that hold the article, in page order."""
    body = next((n for n in _order(root) if n.tag == "body"), root)
    doubtful = [n for n in _order(body) if n.doubtful]
    if doubtful:
        # what is beyond doubt gives the threshold that the others have to reach
        for node in doubtful:
            node.dropped = True
        beyond, threshold = _best(body)
        for node in doubtful:
            node.dropped = False
        _, threshold_of_all = _best(body)
        threshold = threshold_of_all if beyond is None else threshold
        for node in doubtful:
            node.dropped = node.density < threshold
    best, threshold = _best(body)
    if best is None:
        return []
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    holder = next((n for n in reversed(path) if n.tag == "article"), None)
    holder = holder or next((n for n in path if n.tag == "main"), None)
    if holder is None:
        below = [n for n in _order(best) if n.tag in ("article", "main") and n.chars]
        holder = max(below, key=lambda n: n.chars, default=None)
    semantic = holder is not None
    if holder is None and best.tag not in BLOCK | {"#root"}:
        holder = next(n for n in path if n.tag in BLOCK or n is body)
    if holder is None and best.tag in ("p", "h1", "h2", "h3", "li", "pre", "blockquote") and best is not body:
        holder = best.parent
    top = holder or best
    if top is body:
        return [top]
    if not semantic:
        return _reaching(body, top, threshold)
    found = [
        x
        for x in top.parent.parts
        if isinstance(x, Node)
        and (x is top or not x.dropped and x.tag == top.tag and x.like == top.like and x.density >= threshold)
    ]
    return found


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below an element, in page order, each trimmed."""
    out: list[str] = []
    open_parts: list[str] = []

    def flush() -> None:
        if open_parts:
            text = " ".join(html.unescape("".join(open_parts)).split())
            if text:
                out.append(text)
            open_parts.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            open_parts.append(x)
        elif not x.dropped or x is node:
            if x.tag in ("br", "td", "th"):
                open_parts.append(" ")
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(x.parts))
    flush()
    return out


def main_text(page: str | None) -> str:
    """Main text of one page; empty for a null or empty page."""
    if not page:
        return ""
    return "\n".join(b for node in content_nodes(parse(page)) for b in blocks(node))


def extract_text(df: DataFrame, page: str = "html", text: str = "text") -> DataFrame:
    """`df` with its page column replaced by `text` and `n_chars` (code points).

    Rows stay one to one and in their partitions. Columns named like a result are
    replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in (page, text, "n_chars")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(text, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(x) for x in part.column(part.schema.get_field_index(page)).to_pylist()]
                columns = [part.column(part.schema.get_field_index(n)) for n in names]
                columns += [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*names, text, "n_chars"])

    return df.select(*[f"`{n}`" for n in names], f"`{page}`").mapInArrow(run, schema)
