"""The main text of web pages by composite text density.

For every element of a page the characters per tag of its subtree are taken and adjusted for links: the more of its text
and tags are links, the less it counts.  An element's density sum adds up the densities of its block children, so the block
that holds the running text has the largest one.  The least density on the way from that block to the body is the threshold.

Elements that are never running text (menus, forms, scripts and the like, by tag, role, class or id) are left out first.  If
the block of largest sum lies in an ``article`` or ``main`` element, that element is the main text.  Else the main text is
that block, the best blocks of all other subtrees that reach the threshold, and headings beside the way to the body.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: element names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEAD = frozenset("base link meta noscript script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot "
    "th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: start tag -> open elements that it ends, and elements beyond which it does not look
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
KEEPS_P = frozenset("option caption td th tr tbody thead tfoot legend body html".split())
CELLS = frozenset("td th caption table".split())
TABLE_PARTS = frozenset("table tr td th tbody thead tfoot caption".split())

# elements, roles and words of classes and ids that are no running text
NOISE_TAGS = frozenset(
    "nav footer aside form script style noscript template svg math canvas iframe object embed audio video map select button textarea "
    "datalist dialog search menu head title xmp noembed noframes input".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies disclaimer footer gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup "
    "promo promotion recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "toolbar widget".split()
)
COMMENT_WORDS = frozenset("comment comments disqus discussion replies reply respond responses".split())
UNLESS = frozenset("has is no with without".split())

_QUOTED = re.compile(r"""(?>[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>""")
_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    __slots__ = ("tag", "parent", "children", "noise", "comment", "holds", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False, comment: bool = False):
        self.tag, self.parent, self.noise, self.comment = tag, parent, noise, comment
        self.children: list[Node | str] = []
        self.holds = False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _noise(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is no running text, and whether it holds readers' comments."""
    if tag in NOISE_TAGS or (tag == "header" and not in_article):
        return True, False
    if not attributes or tag in ("body", "html", "main"):
        return False, False
    noise = comment = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape("".join(values))
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value.lower())):
            noise = True
        elif name == "role":
            noise |= value.lower() in NOISE_ROLES
        elif name in ("class", "id"):
            for label in value.split():
                words = {w.lower() for w in _WORDS.findall(label)}
                if not words & UNLESS:
                    comment |= bool(words & COMMENT_WORDS)
                    noise |= bool(words & NOISE_WORDS) and not (in_article and words & {"header"} and tag in HEADINGS | {"header", "hgroup"})
    return noise or comment, comment


def parse(page: str) -> Node:
    """The element tree below the body.  Unclosed and stray tags are mended as browsers do for the cases that matter to text."""
    body = Node("body", None)
    at, end, stack, opened = 0, len(page), [body], {}
    quoted = True

    def pop_to(place: int) -> None:
        for node in stack[place:]:
            opened[node.tag] -= 1
        del stack[place:]

    while at < end:
        start = page.find("<", at)
        if start < 0:
            stack[-1].children.append(html.unescape(page[at:]))
            break
        if start > at:
            stack[-1].children.append(html.unescape(page[at:start]))
        after = page[start + 1 : start + 2]
        closing = after == "/"
        first = page[start + 2 : start + 3] if closing else after
        if not (first.isascii() and first.isalpha()):
            if page.startswith("<!--", start):
                if page.startswith((">", "->"), start + 4):
                    at = page.find(">", start + 4) + 1
                else:
                    stop = page.find("-->", start + 4)
                    at = stop + 3 if stop >= 0 else end
            elif after in ("!", "?") or closing:
                stop = page.find(">", start)
                at = stop + 1 if stop >= 0 else end
            else:
                stack[-1].children.append("<")
                at = start + 1
            continue
        name = _NAME.match(page, start + 1 + closing)
        match = _QUOTED.match(page, name.end()) if quoted else None
        if match:
            stop = match.end() - 1
        else:  # a quote that never ends: from here on, tags end at the next ">"
            quoted, stop = False, page.find(">", name.end())
            if stop < 0:
                break
        tag, attributes, at = name[0].lower(), page[name.end() : stop], stop + 1

        if closing:
            if tag == "br":
                stack[-1].children.append(" ")
            elif opened.get(tag) and tag != "body":
                barrier = BLOCK if tag not in BLOCK else frozenset() if tag in TABLE_PARTS else CELLS
                for place in range(len(stack) - 1, 0, -1):
                    if stack[place].tag == tag:
                        pop_to(place)
                        break
                    if stack[place].tag in barrier:
                        break
            continue
        if tag in ("html", "body"):
            if opened.get("head"):
                pop_to(next(i for i, n in enumerate(stack) if n.tag == "head"))
            continue
        if opened.get("head") and stack[-1].tag == "head" and tag not in HEAD:
            pop_to(len(stack) - 1)
        if tag in BLOCK and tag not in KEEPS_P and opened.get("p"):
            for place in range(len(stack) - 1, 0, -1):
                if stack[place].tag == "p":
                    pop_to(place)
                    break
                if stack[place].tag in CELLS or (stack[place].tag in BLOCK and stack[place].tag != "p"):
                    break
        if tag in CLOSES and any(opened.get(t) for t in CLOSES[tag][0]):
            ends, barrier = CLOSES[tag]
            cut = None
            for place in range(len(stack) - 1, 0, -1):
                if stack[place].tag in barrier:
                    break
                if stack[place].tag in ends:
                    cut = place
                    if tag in ("li", "dt", "dd", "option"):
                        break
            if cut is not None:
                pop_to(cut)
        in_article = bool(opened.get("article") or opened.get("main"))
        node = Node(tag, stack[-1], *_noise(tag, attributes, in_article))
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = close.start() if close else end
            if close:
                stop = page.find(">", at)
                at = stop + 1 if stop >= 0 else end
        elif tag not in VOID and not (attributes.endswith("/") and tag in ("svg", "math", "path")):
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    return body


def _ordered(body: Node) -> list[Node]:
    """Elements in page order, without those that are no running text."""
    out, todo = [], [body]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.noise)
    return out


def _spare(body: Node) -> None:
    """Elements that look like noise but hold an article or main element are kept; readers' comments are not spared by
    comments that are articles of their own."""
    every, todo = [], [body]
    while todo:
        node = todo.pop()
        every.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(every):
        holds = node.tag in ("article", "main") and not node.comment
        node.holds |= holds
        if node.holds and node.parent is not None and not (node.tag in ("script", "template", "head")):
            node.parent.holds = True
        if node.noise and node.tag != "article" and any(c.holds for c in node.children if isinstance(c, Node)):
            node.noise = node.comment and not any(c.holds and c.tag == "main" for c in node.children if isinstance(c, Node))


def _densities(nodes: list[Node]) -> None:
    """Link-adjusted characters per tag of each element, and the sum over its block children."""
    for node in reversed(nodes):
        node.chars += sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        if node.parent is not None:
            p = node.parent
            p.chars += node.chars
            p.tags += node.tags + 1
            p.link_chars += node.link_chars
            p.link_tags += node.link_tags
    body = nodes[0]
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if c:
            base = math.log(c / max(1, c - node.link_chars) * lc + share * c + math.e)
            node.density = c / t * max(0.0, math.log(c / lc * t / lt)) / math.log(base)
        if node.parent is not None and node.tag in BLOCK:
            node.parent.total += node.density


def _blocks(root: Node, out: list[str], only: set[int] | None = None) -> None:
    """Texts of blocks in page order; with ``only``, those inside the elements of these ids."""
    todo: list = [(root, only is None)]
    held: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    while todo:
        item = todo.pop()
        if item is None:
            flush()
            continue
        node, inside = item
        if isinstance(node, str):
            if inside:
                held.append(node)
            continue
        inside = inside or (only is not None and id(node) in only)
        if node.tag == "br" and inside:
            held.append(" ")
        if node.tag in BLOCK:
            flush()
            todo.append(None)
        todo.extend((c, inside) for c in reversed(node.children) if isinstance(c, str) or not c.noise)
    flush()


def main_text(page: str) -> str:
    """Main text of one page; blocks are joined by a line feed, white space inside a block is one space."""
    body = parse(page)
    _spare(body)
    nodes = _ordered(body)
    _densities(nodes)
    if not body.chars:
        return ""
    blocks = [n for n in nodes if n.tag in BLOCK]
    best = max(blocks, key=lambda n: n.total)  # the first of equal ones
    if best.total <= 0:
        best = body
    way = []
    node = best
    while node is not None:
        way.append(node)
        node = node.parent
    out: list[str] = []
    named = [n for n in way if n.tag == "article"] or [n for n in way if n.tag == "main"]
    if not named and best.tag == "body":  # an article whose parts are no denser than itself
        articles = [n for n in nodes if n.tag == "article"] or [n for n in nodes if n.tag == "main"]
        named = [max(articles, key=lambda n: n.density)] if articles else []
    if named:
        _blocks(named[-1], out)
        return "\n".join(out)
    threshold = min(n.density for n in way)
    chosen = {id(best)}
    on_way = {id(n) for n in way}
    place = {id(n): i for i, n in enumerate(nodes)}
    size: dict[int, int] = {}
    for n in reversed(nodes):
        size[id(n)] = 1 + sum(size.get(id(c), 0) for c in n.children if isinstance(c, Node))
    for n in way[1:]:
        for c in n.children:
            if not isinstance(c, Node) or c.noise or id(c) in on_way:
                continue
            if c.tag in HEADINGS:
                chosen.add(id(c))
            elif c.tag in BLOCK and c.density >= threshold:
                inner = [m for m in nodes[place[id(c)] : place[id(c)] + size[id(c)]] if m.tag in BLOCK]
                peak = max(inner, key=lambda m: m.total)
                chosen.add(id(peak if peak.total > 0 else c))
    _blocks(body, out, chosen)
    return "\n".join(out)


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), page: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The columns ``keep`` with ``text``, the main text of the whole page, and ``n_chars``, its code points.

    Character references are decoded once, white space inside a block (Unicode's, so no-break spaces too) becomes one space,
    a line break tag counts as white space, blocks are joined by one line feed.  Null and empty pages, and pages without
    text, give an empty text; repeated rows stay; other columns are not read.  Rows are independent of each other.
    """
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + f", `{text}` string, `{n_chars}` long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [main_text(p.as_py() or "") for p in part.column(len(keep))]
                columns = [part.column(i) for i in range(len(keep))] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*keep, text, n_chars])

    return pages.select(*keep, F.col(page).cast("string")).mapInArrow(run, schema)
