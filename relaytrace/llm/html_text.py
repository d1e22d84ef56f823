"""Main text of web pages by composite text density.

Every node of the DOM gets a link-adjusted density of characters per tag; its
density sum is the sum over its children.  The node with the largest sum is
the article, or the <article> or <main> around it.  Without such an element
the thinnest node on the path from the body to the densest one is the threshold
for the whole body: all blocks at or above it are kept in page order.  Blocks
whose class or id names menus, adverts or notices, and forms, are left out,
unless they hold the article.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaytrace.session import ship_package

# HTML's fixed element classes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split())
#: What an open element ends when one of the named elements starts.
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "dd", "dt", "li"}
ITEM_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
             "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
             "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
             "option": ({"option"}, {"select", "datalist"})}
#: Elements and ARIA roles that are never article text.
NOT_TEXT = frozenset(
    "head script style noscript template nav aside footer button select option input textarea iframe object embed "
    "svg canvas audio video map dialog menu xmp noembed noframes title".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id names that mark menus, adverts, notices and reader comments.
NOT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification pagination pager paywall popup promo promoted promotion related replies reply respond share "
    "sharing sidebar signup skyscraper social sponsor sponsored subscribe toolbar widget widgets".split())
#: Those of them that name text of its own, which may be longer than the article.
OWN_TEXT = frozenset(
    "ad ads adv advert adverts advertisement advertising comment comments commentlist consent cookie cookies disclaimer "
    "disqus footer gdpr newsletter notice notices notification promo promoted promotion related replies reply respond "
    "signup sponsor sponsored subscribe".split())
#: Those that also stand in the names of an article's own blocks; with prose they are text there.
WEAK = frozenset("banner share sharing social widget widgets".split())
#: Words of a name that turn what follows: has-sidebar is no sidebar.
TURNS = frozenset("has no with".split())
#: Characters outside such a block from which the page has an article besides it.
OUTSIDE = 200
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Whole class or id names of page headers (an article's own header stays).
NOT_HEADERS = frozenset("header site-header page-header top-header main-header global-header".split())

_OPEN = re.compile(r"<!--|<!\[CDATA\[|<(/?)([A-Za-z][^\s/>\x00]*)|<[!?/]", re.I)
#: What stands in a tag after its name; a quoted value may hold any character.
_REST = re.compile(r"(?:[^>\"']+|\"[^\"]*\"|'[^']*')*")
_ATTR = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "kids", "parent", "skip", "soft", "chars", "tags", "link_chars", "link_tags", "density", "total", "ends")

    def __init__(self, tag: str, parent: Node | None, skip: bool, soft: str = ""):
        # soft: left out for its name alone, "layout", "weak" (layout, unless it is prose of an article) or "text"
        self.tag, self.parent, self.skip, self.soft = tag, parent, skip or bool(soft), "" if skip else soft
        self.kids: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _unwanted(tag: str, attrs: str, within_article: bool) -> bool:
    if tag in NOT_TEXT or tag == "header" and not within_article:
        return True
    if not attrs:
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true":
            return True
        if key == "role" and NOT_ROLES & set(value.lower().split()):
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def _names(value: str) -> set[str]:
    """Words of class or id names, without those that has, no or with turns."""
    out = set()
    for name in value.split():
        for x in _NAME.findall(name):
            if x.lower() in TURNS:
                break
            out.add(x.lower())
    return out


def _soft(tag: str, attrs: str, within_article: bool) -> str:
    """Whether the tag or its names make an element unwanted, unless it holds the article."""
    if tag in ("body", "html", "article", "main"):
        return ""
    found = "layout" if tag == "form" else ""
    for m in _ATTR.finditer(attrs) if attrs else ():
        if m[1].lower() in ("class", "id"):
            value = html.unescape(m[2] or m[3] or m[4] or "")
            names = _names(value) & NOT_NAMES
            if names & OWN_TEXT:
                return "text"
            if names or NOT_HEADERS & set(value.lower().split()):
                found = "weak" if within_article and names and names <= WEAK and found != "layout" else "layout"
    return found


class _Tags:
    """Markup of a page in order: ``(start, end, closing, name, attributes)``, the
    name empty for comments and the like.

    Each character is passed a bounded number of times: where a quote never
    closes, tags end at their first > from then on, and nothing is looked for
    behind its last occurrence."""

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True
        self.last_section = page.rfind("]]>")

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        page = self.page
        while (m := _OPEN.search(page, at)) is not None:
            start, after = m.span()
            if m[0] == "<!--":
                end = page.find("-->", after)
                return start, len(page) if end < 0 else end + 3, False, "", ""
            if after > self.last:
                return None  # no tag ends any more
            if m[2] is None:
                section = m[0].startswith("<![") and after <= self.last_section
                return start, page.find("]]>", after) + 3 if section else page.index(">", after) + 1, False, "", ""
            end = _REST.match(page, after).end() if self.quotes else page.index(">", after)
            if end == len(page) or page[end] != ">":
                self.quotes = False
                end = page.index(">", after)
            return start, end + 1, bool(m[1]), m[2].lower(), page[after:end]
        return None


# For each kind of implied end: the elements that end, and those behind which none does.
_KINDS = [({"p"}, BLOCK - {"p"}), *[x for i, x in enumerate(ITEM_ENDS.values()) if x not in list(ITEM_ENDS.values())[:i]]]
_KIND_OF = {**dict.fromkeys(CLOSES_P, 0), **{tag: _KINDS.index(x) for tag, x in ITEM_ENDS.items()}}
_EFFECT = {tag: [(i, tag in ends) for i, (ends, stop) in enumerate(_KINDS) if tag in ends or tag in stop]
           for tag in {t for ends, stop in _KINDS for t in ends | stop}}


def _outermost(above: tuple, node: Node) -> tuple:
    """Per kind, the outermost open element that it would end below ``node``."""
    effect = _EFFECT.get(node.tag)
    if not effect:
        return above
    out = list(above)
    for kind, ends in effect:
        if not ends:
            out[kind] = None
        elif out[kind] is None:
            out[kind] = node
    return tuple(out)


def parse(page: str) -> Node:
    """A forgiving DOM: unknown end tags are ignored, open elements end where HTML implies it."""
    root = node = Node("#root", None, False)
    root.ends = (None,) * len(_KINDS)
    tags, at, n = _Tags(page), 0, len(page)
    open_: Counter[str] = Counter()  # open elements by name
    while at < n:
        found = tags.next(at)
        if found is None:
            node.kids.append(page[at:])
            break
        start, end, closing, tag, attrs = found
        if start > at:
            node.kids.append(page[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if open_[tag]:
                while True:
                    open_[node.tag] -= 1
                    done, node = node.tag == tag, node.parent
                    if done:
                        break
            elif tag == "br":
                node.kids.append(Node("br", node, False))
            continue
        last = node.ends[_KIND_OF[tag]] if tag in _KIND_OF else None
        while last is not None and node is not last.parent:
            open_[node.tag] -= 1
            node = node.parent
        within = open_["article"] + open_["main"] > 0
        kid = Node(tag, node, _unwanted(tag, attrs, within), _soft(tag, attrs, within))
        node.kids.append(kid)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            kid.kids.append(page[at:close.start() if close else n])
            at = close.end() if close else n
            continue
        kid.ends = _outermost(node.ends, kid)
        open_[tag] += 1
        node = kid
    return root


def _restore_prose(body: Node) -> None:
    """Weak names are no reason to leave out elements that are mostly text outside links, and enough of it."""
    order, stack = [], [body]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(k for k in x.kids if not isinstance(k, str) and (not k.skip or k.soft))
    if not any(x.soft == "weak" for x in order):
        return
    size: dict[int, tuple[int, int]] = {}  # characters outside and inside links
    for x in reversed(order):
        inside, outside = 0, sum(len(_SPACE.sub(" ", k).strip()) for k in x.kids if isinstance(k, str))
        for k in x.kids:
            if not isinstance(k, str) and not k.skip:
                outside, inside = outside + size[id(k)][0], inside + size[id(k)][1]
        if x.soft == "weak" and outside >= OUTSIDE and outside > 4 * inside:
            x.skip, x.soft = False, ""
        size[id(x)] = (0, outside + inside) if x.tag == "a" else (outside, inside)


def _restore(body: Node) -> None:
    """Soft nodes that hold the article are wanted after all: layout with more
    of the text outside links than all wanted nodes, or with the only article
    element and half as much, and anything else if next to nothing is outside."""
    _restore_prose(body)
    order, above, stack = [], {}, [(body, body)]
    while stack:
        x, over = stack.pop()
        order.append(x)
        if x.soft:
            above.setdefault(id(over), []).append(x)
            over = x
        stack.extend((k, over) for k in x.kids if not isinstance(k, str) and (not k.skip or k.soft))
    if not above:
        return
    own: dict[int, tuple[int, bool]] = {}  # characters, and whether an article has some, without soft nodes below
    full: dict[int, tuple[int, bool]] = {}  # with layout below
    for x in reversed(order):
        here = sum(len(_SPACE.sub(" ", k).strip()) for k in x.kids if isinstance(k, str))
        kids = [k for k in x.kids if not isinstance(k, str) and id(k) in own and k.tag != "a"]
        for of, some in ((own, [k for k in kids if not k.soft]), (full, [k for k in kids if k.soft != "text"])):
            chars = here + sum(of[id(k)][0] for k in some)
            of[id(x)] = (chars, x.tag in ("article", "main") and chars > 0 or any(of[id(k)][1] for k in some))
    outside, article = own[id(body)]
    soft = above.get(id(body), [])

    def only(x: Node) -> bool:
        return x.soft != "text" and full[id(x)][1] and not article and 2 * full[id(x)][0] > outside

    while True:
        found = [x for x in soft if only(x) or full[id(x)][0] > outside and (x.soft != "text" or outside < OUTSIDE)]
        if not found:
            return
        x = max(found, key=lambda x: (only(x), full[id(x)][0]))
        x.skip = False
        outside, article = outside + own[id(x)][0], article or own[id(x)][1]
        soft = [k for k in soft if k is not x] + above.get(id(x), [])


def _measure(root: Node) -> list[Node]:
    """Characters, tags and their share in links, from the leaves up."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(k for k in x.kids if not isinstance(k, str) and not k.skip)
    for x in reversed(order):
        for k in x.kids:
            if isinstance(k, str):
                x.chars += len(_SPACE.sub(" ", k).strip())
            elif not k.skip:
                x.chars += k.chars
                x.tags += k.tags + 1
                x.link_chars += k.link_chars
                x.link_tags += k.link_tags + (k.tag == "a")
        if x.tag == "a":
            x.link_chars = x.chars
    return order


def _densities(order: list[Node], body: Node) -> None:
    of_body = body.link_chars / max(body.chars, 1)
    for x in order:
        c, t, lc, lt = max(x.chars, 0), max(x.tags, 1), max(x.link_chars, 1), max(x.link_tags, 1)
        if not c:
            continue
        # the larger the share of links, the larger the logarithm's base and the lower the density
        base = math.log(c / max(c - x.link_chars, 1) * lc + of_body * c + math.e)
        inside = max(c / lc * t / lt, 1.0)
        x.density = c / t * math.log(inside) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else c / t
    for x in order:
        x.total = sum(k.density for k in x.kids if not isinstance(k, str) and not k.skip)


def _select(body: Node, path: list[Node], threshold: float) -> dict[int, list[Node | str]]:
    """Kids to keep of every node that is not kept whole, by the node's id.

    A block counts as dense by its density or, since that grows with a block's
    length, by its characters outside links a tag against the path's least.
    Blocks without links between two kept ones, and a heading before one,
    are kept with them; a thin block is looked into."""
    plain = min((x.chars - x.link_chars) / max(x.tags, 1) for x in path)
    on_path = {id(x) for x in path}
    chosen: dict[int, list[Node | str]] = {}
    stack = [body]
    while stack:
        x = stack.pop()
        # a unit is a block, or text and inline elements between blocks
        units: list[list[Node | str]] = []
        inline = False
        for k in x.kids:
            if not isinstance(k, str) and k.skip:
                continue
            block = not isinstance(k, str) and (k.tag in BLOCK or id(k) in on_path)
            if block or not inline:
                units.append([])
            units[-1].append(k)
            inline = not block
        state = []  # 2: kept, 1: no links, 0: neither
        for unit in units:
            nodes = [k for k in unit if not isinstance(k, str)]
            chars = sum(len(_SPACE.sub(" ", k).strip()) if isinstance(k, str) else k.chars for k in unit)
            links = sum(k.link_chars for k in nodes)
            one = len(unit) == 1 and bool(nodes) and (nodes[0].tag in BLOCK or id(nodes[0]) in on_path)
            tags = nodes[0].tags if one else sum(k.tags + 1 for k in nodes)
            dense = one and (id(nodes[0]) in on_path or nodes[0].density >= threshold) or (chars - links) / max(tags, 1) >= plain
            state.append(2 if chars and dense else 0 if links else 1)
        kept = [i for i, s in enumerate(state) if s == 2]
        out: list[Node | str] = []
        for i, unit in enumerate(units):
            first = unit[0]
            node = None if isinstance(first, str) else first
            near = bool(kept) and kept[0] < i < kept[-1] and state[i] == 1
            title = node is not None and node.tag in HEADINGS and any(
                state[j] == 2 for j in range(i + 1, len(units)) if all(_blank(units[h]) or _heading(units[h]) for h in range(i + 1, j)))
            if state[i] == 2 or near or title or _blank(unit):
                out += unit
                if node is not None and id(node) in on_path and node is not path[0]:
                    stack.append(node)
            elif node is not None and node.tag in BLOCK and node.chars:
                out.append(node)
                stack.append(node)
        chosen[id(x)] = out
    return chosen


def _blank(unit: list[Node | str]) -> bool:
    return not any(k.strip() if isinstance(k, str) else k.chars for k in unit)


def _heading(unit: list[Node | str]) -> bool:
    return not isinstance(unit[0], str) and unit[0].tag in HEADINGS


def _siblings(x: Node, threshold: float) -> list[Node]:
    """The chosen article and those beside it that are as dense as its path and
    no mere cards: enough of their text, and most of it, stands outside links."""
    if x.tag != "article" or x.parent is None:
        return [x]
    return [k for k in x.parent.kids if k is x or not isinstance(k, str) and k.tag == "article" and not k.skip
            and k.density >= threshold and k.chars - k.link_chars >= OUTSIDE and 2 * k.link_chars < k.chars]


def _blocks(top: Node, threshold: float | None, chosen: dict[int, list[Node | str]] | None = None) -> list[str]:
    """Texts of the blocks below ``top`` in page order; ``chosen`` has the kids
    of nodes that are not kept whole, and link lists below ``threshold`` go."""
    chosen = chosen or {}
    out: list[str] = []
    buf: list[str] = []

    def flush() -> None:
        t = _SPACE.sub(" ", html.unescape("".join(buf))).strip()
        buf.clear()
        if t:
            out.append(t)

    stack: list[tuple[Node | str | None, bool]] = [(top, False)]
    while stack:
        x, after = stack.pop()
        if isinstance(x, str):
            buf.append(x)
        elif after:
            flush()
        elif x.tag == "br":
            buf.append(" ")
        elif not x.skip and not (x is not top and id(x) not in chosen and threshold is not None and _aside(x, threshold)):
            if x.tag in BLOCK:
                flush()
                stack.append((x, True))
            stack.extend((k, False) for k in reversed(chosen.get(id(x), x.kids)))
    flush()
    return out


def _aside(x: Node, threshold: float) -> bool:
    """A list or box inside the article that is mostly links and below the path's threshold."""
    return x.tag in BLOCK and x.tag != "p" and x.density < threshold and x.link_tags > 1 and 2 * x.link_chars > x.chars


def _body(root: Node) -> Node:
    stack = [root]
    while stack:
        x = stack.pop()
        if x.tag == "body":
            return x
        stack.extend(k for k in x.kids if not isinstance(k, str) and not k.skip)
    return root


def main_text(page: str) -> str:
    """The article's blocks, one a line; empty if the page has no text."""
    root = parse(page)
    body = _body(root)
    _restore(body)
    order = _measure(root)
    below = set()
    stack = [body]
    while stack:
        x = stack.pop()
        below.add(id(x))
        stack.extend(k for k in x.kids if not isinstance(k, str) and not k.skip)
    order = [x for x in order if id(x) in below]
    _densities(order, body)
    top = max(order, key=lambda x: x.total, default=body)  # the first of equals in page order
    if top.total <= 0:
        top = body
    path, x = [top], top
    while x is not body:
        x = x.parent
        path.append(x)
    named = next((x for x in path if x.tag in ("article", "main")), None)
    # the body-path threshold: what is as dense as the thinnest node on the way belongs to the article
    threshold = min(x.density for x in path)
    if named is not None:
        # an article keeps all its blocks, however full of links; <main> may hold lists besides it
        parts = _siblings(named, threshold)
        return "\n".join(t for x in parts for t in _blocks(x, threshold if x.tag == "main" else None))
    # a line's inline parts and paragraphs are not told apart
    while len(path) > 1 and (path[0].tag not in BLOCK or path[0].tag in HEADINGS or path[0].tag == "p"):
        del path[0]
    return "\n".join(_blocks(body, threshold, _select(body, path, threshold) if len(path) > 1 else None))


def page_text(html_col: Column) -> Column:
    """Column of the main text of a page; see ``extract``."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(v.as_py() or "") for v in batch], pa.string())

    return run.asNondeterministic()(html_col)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text)``: the main text of every whole page.

    A null, empty or textless page has an empty text; null ids and urls stay
    null; repeated rows are extracted each; an empty table gives no rows.
    """
    ship_package(df.sparkSession)
    src = df.select(F.col(f"`{id_col}`"), F.col(f"`{url_col}`"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("_page"))
    return src.select(id_col, url_col, page_text(F.col("_page")).alias("text"))
