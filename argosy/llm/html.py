"""Main-text extraction from web pages by scoring the element tree.

Each paragraph gives points for its length and commas to its parent and fewer to each ancestor above;
an element's points are discounted by the share of its text that lies in links. The best container
and those siblings that score like it are kept, without boilerplate and blocks of links inside them.
Paragraphs, lists, tables and text runs beside it or beside what holds it are judged by their own
length, commas and links, and headings stay that lie before or between kept blocks. Within an
article element all stays but marked parts and lists of short links without a heading of their own.

A name in class or id marks an element only as a whole word ("related", "comment-list"; not "related-work"),
and one that names a gadget (share, tags, menu) only if its text scores low. A form is one only if most of
the page stands outside it; else it wraps the page, and only its controls go.

Pages are independent: one scan, no shuffle; a page's tree is the only state, and the work grows with
the page's length.

Defined cases: null or empty html, and a page without paragraphs, give an empty text; repeated rows
are extracted each by itself; broken nesting, missing end tags and stray brackets are read as
browsers do, so a tag that never ends takes the rest of its page; an empty table gives no rows; a
column with the name of a result column is replaced.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from argosy.llm.common import kept, map_batches

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag up to its end; a quote counts only behind an equals sign.
REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""")
ATTRIBUTE = re.compile(r"""(?<![^\s="'>/])([^\s="'>/]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)""")
SPACE = re.compile(r"\s+")
DIGIT = re.compile(r"\d")

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg noframes xmp annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
DROPPED = frozenset("nav aside footer button label datalist select input menu dialog head object canvas audio video fieldset search".split())
CONTAINER = frozenset("article main section div td body blockquote".split())
#: What a start tag ends: elements of the same kind, up to the nearest of the bounds. (start tags, what they end, bounds)
ENDS = [
    ({"li"}, {"li"}, {"ul", "ol", "menu"}),
    ({"dt", "dd"}, {"dt", "dd"}, {"dl"}),
    ({"tr"}, {"tr", "td", "th"}, {"table"}),
    ({"td", "th"}, {"td", "th"}, {"tr", "table"}),
    ({"option"}, {"option"}, {"select"}),
]
#: Words in class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle banner breadcrumb breadcrumbs comment comments disqus respond replies"
    " cookie cookies consent gdpr disclaimer footer masthead topbar menu nav navbar navigation pagination pager newsletter subscribe subscription signup"
    " promo promoted promotion related recommended recommendations share sharing social sidebar widget widgets skip sponsor sponsored popup modal"
    " overlay paywall login toolbar tags complementary contentinfo".split()
)
#: Of these, gadgets: an element of such a name with a text of its own is part of the article.
GADGETS = frozenset("share sharing social menu nav navbar navigation tags login toolbar skip popup modal overlay respond".split())
#: What may stand beside a mark in a hyphenated name.
NEUTRAL = frozenset(
    "area bar block body bottom box button buttons card cell col column container content count feed footer form global grid group header heading holder icon icons"
    " inner item items label large layout left link links list local main message mini mobile module notice outer page panel post posts primary region right row"
    " secondary section site slot small space sticky story stories tag text thread title toggle top unit view wrap wrapper zone js wp div id ul li".split()
)
#: These count only without a word that speaks for the article.
WEAK_MARKS = frozenset("header notice notices alert side search reply foot".split())
KEEP_MARKS = frozenset("article main content post entry story body text".split())
#: In a class such as "has-sidebar" these describe the page.
LAYOUT = frozenset("sidebar nav navbar footer header comments menu banner widget ads".split())
NOT_ARTICLE = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo promoted related recommended teaser widget".split())


class Node:
    """An element. ``soft`` marks are settled by judge; ``headed``: a heading stands directly before it; ``block`` is the nearest block around it, ``scope`` the inline elements open in its block, ``p`` the open
    paragraph around it within its block and ``outer`` the outermost open element of each of ENDS within its bounds."""

    __slots__ = ("name", "parent", "parts", "marked", "soft", "headed", "wrapper", "in_article", "block", "scope", "p", "outer", "hidden", "score", "size", "linked", "links", "heads", "figures", "own", "own_linked", "commas")

    def __init__(self, name: str, parent: Node | None, marked: bool = False) -> None:
        self.name, self.parent, self.marked, self.parts, self.wrapper, self.score = name, parent, marked, [], False, 0.0
        self.soft = self.headed = False
        self.size = self.linked = self.links = self.heads = self.figures = self.own = self.own_linked = self.commas = 0
        blocky = name in BLOCK
        if parent is None:
            self.in_article, self.block, self.scope, self.p, self.outer = False, None, {}, None, (None,) * len(ENDS)
            return
        self.in_article = parent.in_article or parent.name in ("article", "main")
        self.block = parent if parent.name in BLOCK else parent.block
        self.scope = {} if blocky else parent.scope
        self.p = self if name == "p" else None if blocky else parent.p
        self.outer = parent.outer
        if name in ENDING:
            self.outer = tuple(None if name in bounds else at or (self if name in ended else None) for at, (_, ended, bounds) in zip(parent.outer, ENDS, strict=True))

    def dense(self) -> bool:
        """Is a block like a menu: short links and hardly a word besides? Headings never are, nor what holds one, nor figures
        in a table; items go with their list, and a paragraph is if it is one short link."""
        if self.name in HEADINGS or self.name in ITEMS or self.name not in BLOCK or not self.links or self.heads:
            return False
        if self.name in ("p", "pre"):
            return self.linked >= self.size and self.linked < SHORT_LINE
        if 5 * (self.size - self.linked) > self.size or self.linked >= SHORT_LINK * self.links or self.name == "table" and self.figures:
            return False
        return self.links < 2 or not self.headed


#: Code points: a paragraph that is one link is an article's from here on, and a list if its links have so many on average.
SHORT_LINE, SHORT_LINK = 25, 40
ENDING = frozenset(x for rule in ENDS for names in rule for x in names)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dt dd tr td th tbody thead tfoot caption".split())


def words_of_names(value: str) -> set[str]:
    """The words of class names, without names of which a word is neither a mark nor neutral."""
    out: set[str] = set()
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        known = [w in MARKS or w in WEAK_MARKS or w in NEUTRAL or w in KEEP_MARKS or w in ("has", "with", "no") for w in words]
        if all(known):
            out.update(words)
    return out


def mark_of(name: str, attributes: str, in_article: bool) -> str:
    """Does the name, class, id or role say that an element is not the article? "hard", "soft" (unless its text says otherwise) or ""."""
    if name in DROPPED or name in RAW or name == "header" and not in_article:
        return "hard"
    if name in ("main", "body", "html") or not attributes:
        return ""
    words: set[str] = set()
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            words |= words_of_names(value)
        elif key == "role" and value in MARKS:
            return "hard"
        elif key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return "hard"
    if re.search(r"(?:^|\s)hidden(?:\s|$)", re.sub(r"=\s*(\"[^\"]*\"|'[^']*'|\S+)", "", attributes)):
        return "hard"
    if words & {"has", "with", "no"}:
        words -= LAYOUT
    if name == "article":
        return "hard" if words & NOT_ARTICLE else ""
    found = words & MARKS
    if found:
        return "soft" if found <= GADGETS else "hard"
    return "hard" if words & WEAK_MARKS and not words & KEEP_MARKS else ""


def parse(html: str) -> list[Node]:
    """The elements in page order, the root first; text stands between elements, its references still encoded.

    Each character is looked at a bounded number of times: open elements are found by what their inner ones inherit, and
    whatever an end tag passes is closed for good.
    """
    root = Node("html", None)
    nodes, here, at, seek, size, blocks_open = [root], root, 0, 0, len(html), {}

    def close(node: Node) -> None:
        nonlocal here
        while here is not node.parent:
            count = blocks_open if here.name in BLOCK else here.scope
            count[here.name] -= 1
            here = here.parent

    while seek < size:
        begin = html.find("<", seek)
        if begin < 0:
            break
        if html.startswith(("<!", "<?"), begin):
            mark = "-->" if html.startswith("<!--", begin) else "]]>" if html.startswith("<![CDATA[", begin) else ">"
            end = html.find(mark, begin + 2)
            here.parts.append(html[at:begin])
            at = seek = size if end < 0 else end + len(mark)
            continue
        tag = NAME.match(html, begin)
        if not tag:
            seek = begin + 1
            continue
        here.parts.append(html[at:begin])
        rest = REST.match(html, tag.end())
        # a tag without an end takes the rest of the page, as in browsers
        at = seek = rest.end() if rest else size
        if not rest:
            break
        name = tag[2].lower()
        if tag[1]:
            if (blocks_open if name in BLOCK else here.scope).get(name):
                node = here
                while node.name != name:
                    node = node.parent
                close(node)
            continue
        if name in ("html", "body"):
            continue
        if name in CLOSES_P and here.p is not None:
            close(here.p)
        for i, (starts, _, _) in enumerate(ENDS) if name in ENDING else ():
            if name in starts and here.outer[i] is not None:
                close(here.outer[i])
        if name == "head" or name in VOID:
            if name == "br" or name in BLOCK:
                here.parts.append(Node(name, here))
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>", re.I).search(html, at)
            at = seek = end.end() if end else size
            here.parts.append(" ")
            continue
        node = Node(name, here)
        mark = mark_of(name, rest[1], node.in_article)
        node.marked, node.soft = bool(mark), mark == "soft" or name == "form" and not mark
        here.parts.append(node)
        nodes.append(node)
        if name in ("article", "main", "h1") and (node.soft or not node.marked):
            # what holds the article or its heading is a wrapper, whatever its class says
            up = here
            while up is not None and not up.wrapper:
                up.wrapper = True
                up.marked = up.marked and (up.name in DROPPED or up.name in ("header", "article"))
                up.soft = up.soft and up.name == "form"
                up = up.parent if not up.marked else None
        if not rest[1].endswith("/") or name in BLOCK:
            here = node
            count = blocks_open if name in BLOCK else node.scope
            count[name] = count.get(name, 0) + 1
    here.parts.append(html[at:])
    return nodes


def judge(nodes: list[Node]) -> None:
    """Settle soft marks: a gadget with a text of its own is none; a form is one if most of the page stands outside it."""
    total: dict[Node, int] = {}
    linked: dict[Node, int] = {}
    linking = set()
    for x in nodes:
        if x.name == "a" or x.parent in linking:
            linking.add(x)
    for x in reversed(nodes):
        n = sum(len(p.strip()) if isinstance(p, str) else total.get(p, 0) for p in x.parts if isinstance(p, str) or p.soft or not p.marked)
        total[x] = n
        linked[x] = n if x in linking else sum(linked.get(p, 0) for p in x.parts if isinstance(p, Node) and (p.soft or not p.marked))
    for x in nodes:
        if x.soft:
            if x.name == "form":
                x.marked = 2 * total[x] <= total[nodes[0]]
            else:
                x.marked = total[x] < TEXT or 4 * linked[x] > total[x]


#: Code points of a gadget from which its text, if it is not in links, is the article's.
TEXT = 80


def measure(nodes: list[Node]) -> None:
    """Characters of each element's text and of its links, in all (size, linked, with links and heads as numbers of links and
    headings, and figures of digits outside links) and outside inner blocks (own, own_linked, with commas); marked elements
    count for nothing. Inner elements come later in page order, so they are summed first."""
    judge(nodes)
    linking = set()
    for x in nodes:
        x.hidden = x.marked or x.parent is not None and x.parent.hidden
        if x.name == "a" or x.parent in linking:
            linking.add(x)
    for x in reversed(nodes):
        if x.hidden:
            continue
        heading = False
        for part in x.parts:
            if isinstance(part, str):
                n = len(part.strip())
                heading = heading and not n
                x.size, x.own, x.commas = x.size + n, x.own + n, x.commas + part.count(",")
                if x in linking:
                    x.linked, x.own_linked = x.linked + n, x.own_linked + n
                elif n:
                    x.figures += len(DIGIT.findall(part))
            elif not part.marked:
                part.headed, heading = heading, part.name in HEADINGS
                x.size, x.linked, x.links, x.heads, x.figures = x.size + part.size, x.linked + part.linked, x.links + part.links, x.heads + part.heads, x.figures + part.figures
                if part.name not in BLOCK:
                    x.own, x.own_linked, x.commas = x.own + part.own, x.own_linked + part.own_linked, x.commas + part.commas
        x.links += x.name == "a" and x.size > 0
        x.heads += x.name in HEADINGS and x.size > 0


def points(size: int, linked: int, commas: int) -> float:
    """Points of a paragraph for its length and commas, discounted by the share of its text in links."""
    return (1 + min(size / 100, 30) + commas) * (1 - linked / size) if size else 0.0


def blocks(nodes: list[Node | str | None]) -> list[str]:
    """The text blocks below some nodes in page order, without what is marked and blocks of links; None ends a block."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.name == "br":
            run.append(" ")
        elif x.marked or x.dense():
            if x.name in BLOCK:
                flush()
            else:
                run.append(" ")
        else:
            if x.name in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(x.parts))
    flush()
    return out


def is_paragraph(x: Node) -> bool:
    """Is an element a block of text by itself? A container is if it holds no blocks but headings and paragraphs."""
    return x.name not in ("div", "section", "td") or not any(isinstance(p, Node) and p.name in BLOCK - HEADINGS - {"p", "pre"} for p in x.parts)


def group_points(group: list[Node | str]) -> float:
    """Points of some neighbours by all their text; none if half of it lies in links."""
    size = linked = commas = 0
    for x in group:
        if isinstance(x, str):
            size, commas = size + len(x.strip()), commas + x.count(",")
        elif not x.marked:
            size, linked, commas = size + x.size, linked + x.linked, commas + x.commas
    return points(size, linked, commas) if 2 * linked < size else 0.0


def beside(parent: Node, inner: Node, chosen: list, least: float) -> list:
    """The parts of ``parent`` to keep in page order, with ``chosen`` in the place of ``inner``; None ends a block.

    Inside an article all stays but marked parts and blocks of links. Elsewhere a sibling stays if it scored ``least`` or
    is a paragraph with points of its own, and a heading if it lies before or between kept blocks.
    """
    if parent.in_article or parent.name in ("article", "main"):
        return [y for x in parent.parts for y in (chosen if x is inner else [x])]
    groups: list[list] = []
    for x in parent.parts:
        alone = isinstance(x, Node) and x.name in BLOCK
        if alone or not groups or isinstance(groups[-1][-1], Node) and groups[-1][-1].name in BLOCK:
            groups.append([x])
        else:
            groups[-1].append(x)
    keep: list[bool | None] = []
    for group in groups:
        x = group[0]
        if inner in group:
            keep.append(True)
        elif isinstance(x, Node) and x.name in BLOCK:
            if x.name in HEADINGS:
                keep.append(None if not x.marked else False)
            else:
                keep.append(not x.marked and (x.score >= least or is_paragraph(x) and group_points(group) >= 1))
        else:
            keep.append(group_points(group) >= 1)
    last = max(i for i, k in enumerate(keep) if k)
    out: list = []
    for i, (group, k) in enumerate(zip(groups, keep, strict=True)):
        if k or k is None and i < last:
            for x in group:
                out += chosen if x is inner else [x]
            out.append(None)
    return out


def choose(nodes: list[Node]) -> list[Node | str | None]:
    """The best-scored container with what belongs to it beside it and beside its holders; nothing if there is no paragraph."""
    measure(nodes)
    for x in nodes:
        if x.hidden or not x.own or x.name not in BLOCK and x.parent is not None:
            continue
        worth = points(x.own, x.own_linked, x.commas)
        # a container with text of its own is its own paragraph
        up, weight = (x if x.name in CONTAINER or x.block is None else x.block), 1.0
        while up is not None and weight > 0.05:
            up.score += worth * weight
            up, weight = up.block, weight / 2
    best, top = None, 0.0
    for x in nodes:
        x.score *= (1 - x.linked / x.size if x.size else 0.0) * (1.5 if x.name in ("article", "main") else 1.0)
        if x.score > top and not x.hidden:
            best, top = x, x.score
    if best is None:
        return []
    if best.parent is None:
        return list(best.parts)
    chosen, node = [best], best
    while node.parent is not None:
        chosen = beside(node.parent, node, chosen, 0.2 * top)
        node = node.parent
    return chosen


def main_text(html: str | None) -> str:
    """The article's blocks, joined by a blank line."""
    return "\n\n".join(blocks(choose(parse(html)))) if html else ""


FIELDS = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Pages with text and n_chars (code points). keep: the page columns that go on (all if None)."""

    def run(batch: pa.RecordBatch) -> list:
        found = [main_text(x) for x in batch.column(html).to_pylist()]
        return [found, [len(x) for x in found]]

    return map_batches(pages, run, FIELDS, kept(pages, keep, []))
