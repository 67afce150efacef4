"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, less the further away; a container's points are discounted by its link density. The best container says what the article is: the article or main part around it; without one, all blocks of prose that are like its own, wherever they lie, and what is between and beside them. Every pass over a page, parsing included, is linear in its length, however deep its elements lie."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh, slices, table, with_fields

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul xmp".split()
)
#: Elements that stand apart from the text around them. All others, unknown ones too, are part of it.
BLOCKS = ENDS_P | frozenset("html head body frameset caption col colgroup legend optgroup option tbody td tfoot th thead tr".split())
#: Part of the text around them, but a block within ends no paragraph around.
WALLS = frozenset("applet button marquee math object select svg template".split())
#: A start tag of the key ends open elements of these kinds, up to one of the kinds in SCOPE.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "thead": {"tr", "td", "th", "tbody", "thead"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}, "body": {"head"},
}
SCOPE = frozenset("table ul ol dl select html body div article section main".split())
#: These never hold the article's text.
DROPPED = RAW | frozenset("head nav aside footer form button select input svg math canvas object audio video menu dialog fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Of these, wrappers that some pages put around all they have.
FORMS = frozenset("form fieldset".split())
#: Characters of a paragraph that counts as the article's when nothing else marks it, and how many such make an article.
LONG, MANY = 80, 3
#: Words in class and id of parts that aren't the article.
OTHER_NAMES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay sidebar aside rail widget widgets comment comments commentlist discussion disqus respond reply replies footer header masthead menu menus nav navbar navigation topbar breadcrumb breadcrumbs pagination pager paging related recommended recommendations share sharing social newsletter subscribe subscription signup login search toolbar skip legal copyright".split()
)
#: Of these, reader comments, adverts and notices: such a part goes from an article whatever its text is like.
NEVER_TEXT = frozenset("ad ads adbox adsense advert adverts advertisement advertising sponsored cookie cookies consent gdpr notice notices notification comment comments commentlist discussion disqus reply replies".split())
#: Names of quotes that an article shows again beside its text.
QUOTE_NAMES = frozenset("pullquote quote quotation blockquote".split())
CONTROLS = frozenset("form input textarea select button".split())
#: How lines start or end that aren't text, wherever they stand.
BOILERPLATE = re.compile(r"^(?:©|\(c\)|copyright\b)|\ball rights reserved\W*$", re.I)
#: Of these, the ones that stand for links: such a part goes if it has links or next to no text.
LINK_NAMES = frozenset("related recommended recommendations share sharing social menu menus nav navbar navigation topbar breadcrumb breadcrumbs pagination pager paging toolbar skip rail widget widgets".split())
#: Words that may stand beside those above and change nothing.
PLAIN_NAMES = frozenset(
    "area bar block box bottom btn button buttons container content form group holder icons inner item items label left link links list module outer panel placeholder posts right section site slot stories text thread title top unit wrap wrapper".split()
)
#: Words that turn a name round.
NO_NAMES = frozenset("has no non with without".split())
#: Words in class and id of parts that may be the article whatever else they are called.
TEXT_NAMES = frozenset("article articlebody body content entry main post story text page blog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A list or an item of one isn't the article, but what they are in.
LISTS = frozenset("li ul ol dt dd dl".split())
#: A block of these tags is a piece of what it is in.
PARTS = HEADINGS | frozenset("p pre blockquote li dt dd".split())
CONTAINER_POINTS = {"article": 10, "main": 8, "div": 5, "section": 5, "pre": 3, "blockquote": 3, "td": 3, "ol": -3, "ul": -3, "dl": -3, "li": -3, "th": -5}

# A quote opens a value right after "=" only; elsewhere it is a character like others. What isn't closed ends with the page.
ATTRIBUTES = r"""(?:[\s/]++|=?+[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++)?+)?+|=)*+"""
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})>?", re.S)
ATTRIBUTE = re.compile(r"""(=?+[^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))?+)?+""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: How a class or id speaks of its element: not at all; of the article; of other parts for sure, of links, or in passing.
NOTHING, TEXT, SURE, LINKS, PASSING = range(5)


class LinkText(str):
    """Text within a link."""

    __slots__ = ()


class Node:
    """An element. text_chars and link_chars: of the text in it, links apart; marked: holds an article, a main part or a first heading; article: holds one of the first two; within: lies in one; controls: holds fields or buttons; gone: not shown; prose: blocks of prose in it."""

    __slots__ = ("article", "children", "controls", "dropped", "gone", "kind", "link_chars", "marked", "names", "parent", "points", "prose", "tag", "text_chars", "within", "wraps")

    def __init__(self, tag: str, parent: Node | None, names: frozenset = frozenset(), kind: int = NOTHING, dropped: bool = False, wraps: str = "") -> None:
        self.tag, self.parent, self.names, self.kind, self.dropped, self.wraps = tag, parent, names, kind, dropped, wraps
        self.children: list[Node | str] = []
        self.points = 0.0
        self.text_chars = self.link_chars = self.prose = 0
        self.article = self.marked = self.within = self.controls = self.gone = False

    def density(self) -> float:
        return self.link_chars / self.text_chars if self.text_chars else 0.0


def _kind(value: str) -> int:
    """What one word of a class or id says. Its last part is what it is: article-comments are comments, a related-note is a note."""
    parts = [x.lower() for x in NAME_PART.findall(value)]
    others = [x for x in parts if x in OTHER_NAMES]
    if not others or NO_NAMES.intersection(parts):
        return TEXT if TEXT_NAMES.intersection(parts) else NOTHING
    if parts[-1] not in OTHER_NAMES and not all(x in OTHER_NAMES or x in PLAIN_NAMES or x in TEXT_NAMES or x.isdigit() for x in parts):
        return TEXT if parts[-1] in TEXT_NAMES else PASSING
    return LINKS if all(x in LINK_NAMES for x in others) else SURE


def _marks(tag: str, attributes: str) -> tuple[frozenset, int, bool, str]:
    """Words in class and id, what they say, whether the element is none of the article's whatever its names, and "form", "hidden" or "aside" if only for that."""
    names: set[str] = set()
    kinds: set[int] = set()
    form = tag in FORMS
    hidden, dropped = False, tag in DROPPED and not form and tag != "aside"
    if attributes and not attributes.isspace():
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                for word in unescape(value).split():
                    names.update(x.lower() for x in NAME_PART.findall(word))
                    kinds.add(_kind(word))
            elif key == "role":
                form |= value.lower() == "form"
                dropped |= value.lower() in DROPPED_ROLES and value.lower() != "form"
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                hidden = True
    kind = next((k for k in (TEXT, SURE, LINKS, PASSING) if k in kinds), NOTHING)
    aside = tag == "aside"
    return frozenset(names), kind, dropped or form or hidden or aside, "" if dropped or (aside and (hidden or form)) else "aside" if aside else "hidden" if hidden else "form" if form else ""


_short_marks = lru_cache(4096)(_marks)


class _Open:
    """The open elements: the path from the root, and by kind the places on it."""

    def __init__(self, root: Node) -> None:
        self.path, self.at, self.blocks, self.scopes = [root], {root.tag: [0]}, [0], [0]

    def push(self, node: Node) -> None:
        i = len(self.path)
        self.path.append(node)
        self.at.setdefault(node.tag, []).append(i)
        if node.tag in BLOCKS or node.tag in WALLS:
            self.blocks.append(i)
            if node.tag in SCOPE:
                self.scopes.append(i)

    def cut(self, i: int) -> None:
        """Closes the elements from place i on."""
        while len(self.path) > i:
            self.at[self.path.pop().tag].pop()
        for places in (self.blocks, self.scopes):
            while places[-1] >= i:
                places.pop()

    def last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else -1


def parse(html: str) -> tuple[Node, list[Node]]:
    """A tree of the page, and its nodes in page order. Missing and stray end tags are mended: a block starts after an open paragraph, items and cells end those before, an end tag without its start is passed over, the end of an element of text closes no block around which it isn't. A CDATA section is passed over whole. A link ends at its end tag, at the next link, or with the block that it is in."""
    root = Node("html", None)
    open_, nodes = _Open(root), [root]
    link: Node | None = None  # the open one
    depth = 0  # its place
    pos, n, cdata = 0, len(html), html.rfind("]]>")
    search = TOKEN.search
    while pos < n:
        m = search(html, pos)
        end = n if m is None else m.start()
        if end > pos:
            text = html[pos:end]
            open_.path[-1].children.append(text if link is None else LinkText(text))
        if m is None:
            break
        pos = m.end()
        if m[2] is None:
            if m.start() < cdata and html.startswith("<![CDATA[", m.start()):
                pos = html.find("]]>", m.start()) + 3
            continue
        tag = m[2].lower()
        if m[1]:
            i = open_.last(tag)
            if tag == "a":
                link = None
            if i > 0 and (tag in BLOCKS or tag in WALLS or "-" in tag or i > open_.blocks[-1]):
                open_.cut(i)
        elif tag != "html":
            if tag in ENDS_P:  # it ends an open paragraph, a heading ends an open one
                i = open_.blocks[-1]
                around = open_.path[i].tag
                if around == "p" or (around in HEADINGS and tag in HEADINGS):
                    open_.cut(i)
            if tag in ENDS:
                above = open_.scopes[-1]
                ended = [p[k] for t in ENDS[tag] if (p := open_.at.get(t)) and (k := bisect_right(p, above)) < len(p)]
                if ended:
                    open_.cut(min(ended))
            marks = _short_marks(tag, m[3]) if len(m[3]) < 200 else _marks(tag, m[3])
            child = Node(tag, open_.path[-1], *marks)
            child.parent.children.append(child)
            nodes.append(child)
            if tag in RAW:
                raw = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, pos)
                pos = raw.end() if raw else n
            elif tag not in VOID and not (tag in ("svg", "math") and m[3].endswith("/")):  # a slash means nothing on other elements
                open_.push(child)
                if tag == "a" and re.search(r"\bhref\b", m[3], re.I):
                    link, depth = child, len(open_.path) - 1
        if link is not None and (len(open_.path) <= depth or open_.path[depth] is not link):
            link = None
    return root, nodes


def _shown(nodes: list[Node], wrappers: bool = False) -> list[Node]:
    """Nodes in page order, without dropped ones and what is in them; with `wrappers`, those that only wrap count as shown."""
    out = []
    for node in nodes:
        node.gone = (node.dropped and not (wrappers and node.wraps in ("form", "hidden"))) or (node.parent is not None and node.parent.gone)
        if not node.gone:
            out.append(node)
    return out


def _keep_text_boxes(nodes: list[Node]) -> None:
    """Keeps fieldsets without a field, and quotes in asides of an article."""
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.controls |= node.controls or node.tag in CONTROLS
    for node in nodes:
        if node.parent is not None:
            node.within = node.parent.within or node.parent.tag in ("article", "main")
        if node.tag == "fieldset" and node.wraps == "form" and not node.controls:
            node.dropped = False
        elif node.wraps == "aside" and node.within:
            inner = [c for c in node.children if isinstance(c, Node)]
            node.dropped = not (node.names & QUOTE_NAMES or any(c.tag in ("blockquote", "q") for c in inner)) or any(c.tag in ("a", "ul", "ol") for c in inner)


def _is_prose(node: Node) -> bool:
    """Whether a paragraph with a telling name is the article's all the same: sentences without links or fields, and no comment, advert or notice."""
    if node.tag not in ("p", "blockquote", "li", "dd") or node.link_chars or node.controls or node.names & NEVER_TEXT:
        return False
    own = [c.strip() for c in node.children if isinstance(c, str) and not c.isspace()]
    if own and (BOILERPLATE.search(own[0]) or BOILERPLATE.search(own[-1])):
        return False
    return node.text_chars >= LONG or (node.text_chars >= LONG / 2 and bool(own) and own[-1].endswith((".", "!", "?")))


def _keep_wrappers(root: Node, nodes: list[Node]) -> None:
    """Keeps forms and fieldsets around an article, a main part or a first heading. If that leaves a page without any, hidden parts around one are kept too, and forms around some long paragraphs."""
    if not any(n.wraps for n in nodes):
        return
    order = _shown(nodes, True)
    for last in (False, True):
        long: dict[int, int] = {}  # paragraphs in a node
        for node in order:
            node.marked = False
        for node in reversed(order):
            own = node.marked = node.marked and node.tag != "header"
            paragraphs = long.pop(id(node), 0) + (node.tag == "p" and sum(len(c.strip()) for c in node.children if isinstance(c, str)) >= LONG)
            if node.dropped and (own and (last or node.wraps == "form") or last and node.wraps == "form" and paragraphs >= MANY):
                node.dropped = False
            if not node.dropped and node.parent is not None:
                node.parent.marked |= own or node.tag in ("article", "main", "h1")
                long[id(node.parent)] = long.get(id(node.parent), 0) + paragraphs
        if root.marked:
            break


def _drop_others(nodes: list[Node]) -> None:
    """Drops parts by their names, but for those that hold an article, a main part or a page's first heading, and for paragraphs of prose in an article or beside two others of prose; a header is dropped unless it is the article's. Names that stand for links, or are there in passing, count only where links agree: no text goes for such a name alone."""
    order = _shown(nodes)
    for node in order:
        node.marked = False
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                n = len(c.strip())
                node.text_chars += n
                if isinstance(c, LinkText):
                    node.link_chars += n
        if node.tag == "main" or (node.tag == "article" and node.kind not in (SURE, LINKS)):
            node.article = True
        if node.article or node.tag in ("h1", "body"):
            node.marked = True
        up = node.parent
        if up is not None:
            up.prose += node.tag == "p" and node.kind in (NOTHING, TEXT) and node.text_chars >= LONG and node.density() < 0.25
            up.article |= node.article
            up.marked |= node.marked
            up.text_chars += node.text_chars
            up.link_chars += node.link_chars
    for node in order:
        if node.kind < SURE and node.tag != "header":
            continue
        links = node.density()
        if node.tag in ("html", "body", "main"):
            pass
        elif node.tag == "article":
            node.dropped = node.kind == SURE or (node.kind == LINKS and links >= 0.3)
        elif node.tag == "header" or (node.kind == SURE and node.names & {"header", "masthead"}):
            node.dropped = not node.within and not node.article
        elif node.kind == SURE:
            node.dropped = not node.marked and not ((node.within or (node.parent is not None and node.parent.prose >= 2)) and _is_prose(node))
        elif node.kind == LINKS:
            node.dropped = not node.marked and (links >= 0.3 or (node.text_chars < LONG and node.tag not in ("p", "li") and node.tag not in HEADINGS))
        elif node.kind == PASSING:
            node.dropped = not node.marked and links >= 0.5
    for node in order:
        node.text_chars = node.link_chars = node.prose = 0


def _pieces(root: Node) -> list[tuple[Node, str, int]]:
    """(block element, text, characters within links) of each run of inline content, in page order; white space as one space, runs of it alone left out."""
    out: list[tuple[Node, str, int]] = []
    run: list[str] = []
    links = 0

    def flush(block: Node) -> None:
        nonlocal links
        if run:
            text = " ".join("".join(run).split())
            if text:
                out.append((block, text, min(links, len(text))))
            run.clear()
        links = 0

    # [node, place among its children, nearest block]
    stack: list[list] = [[root, 0, root]]
    while stack:
        frame = stack[-1]
        node, i, block = frame
        if i == len(node.children):
            stack.pop()
            if node is block:
                flush(block)
            continue
        frame[1] += 1
        child = node.children[i]
        if isinstance(child, str):
            text = unescape(child) if "&" in child else str(child)
            run.append(text)
            if isinstance(child, LinkText):
                links += len(" ".join(text.split()))
        elif child.tag == "br":
            run.append(" ")
        elif child.tag in BLOCKS:
            flush(block)
            if not child.dropped and child.tag not in VOID:
                stack.append([child, 0, child])
        elif not child.dropped and child.tag not in VOID:
            stack.append([child, 0, block])
    return out


def _score(pieces: list[tuple[Node, str, int]], nodes: list[Node]) -> list[Node]:
    """Containers that got points, in the order in which they did."""
    found: dict[int, Node] = {}
    for block, text, links in pieces:
        block.text_chars += len(text)
        block.link_chars += links
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - links / len(text))
        up = block if block.tag not in HEADINGS and block.tag != "p" else block.parent
        for level in range(4):
            if up is None or up.tag == "html":
                break
            if id(up) not in found:
                found[id(up)] = up
                up.points = CONTAINER_POINTS.get(up.tag, 0) + 5 * bool(up.names & TEXT_NAMES)
            up.points += points / (1, 2, 6, 9)[level]
            up = up.parent
    for node in reversed(nodes):  # children come after their parents
        if node.parent is not None:
            node.parent.text_chars += node.text_chars
            node.parent.link_chars += node.link_chars
    return list(found.values())


def _marked(node: Node) -> Node | None:
    """The article or main part around node."""
    for wanted in ("article", "main"):
        up: Node | None = node
        while up is not None:
            if up.tag == wanted:
                return up
            up = up.parent
    return None


def _is_menu(block: Node, text: str, links: int) -> bool:
    """Whether a piece is one of a list of links."""
    if links < 0.9 * len(text) or block.tag not in ("li", "ul", "ol", "div", "td"):
        return False
    around = block.parent if block.tag == "li" and block.parent is not None else block
    return around.density() >= 0.9 and sum(isinstance(c, Node) for c in around.children[:50]) >= 2


def _home(block: Node) -> Node:
    """What a piece is a part of."""
    return block.parent if block.tag in PARTS and block.parent is not None else block


def _look(node: Node) -> tuple:
    """How a container is marked, and the one around it."""
    up = node.parent
    return (node.tag, node.names, up.tag, up.names) if up is not None else (node.tag, node.names)


def _named(best: Node) -> Node | None:
    """The outermost part around best whose names say that it is the article."""
    found, up = None, best
    while up is not None and up.tag not in ("html", "body"):
        if up.kind == TEXT:
            found = up
        up = up.parent
    return found


def _prose(pieces: list[tuple[Node, str, int]], nodes: list[Node], best: Node) -> list[int]:
    """Places of the pieces that are the article's for sure where no article or main part is marked: paragraphs of some length, hardly links, in a container that is like the best one or has few links, and in the part with a telling name if the best one lies in such."""
    own: dict[int, list[int]] = {}
    for block, text, links in pieces:
        counts = own.setdefault(id(_home(block)), [0, 0])
        counts[0] += len(text)
        counts[1] += links
    plain = [i for i, (block, text, links) in enumerate(pieces) if block.tag not in HEADINGS and 4 * links < len(text)]
    least = min(LONG, max((len(pieces[i][1]) for i in plain), default=0) // 2)
    named, look = _named(best), _look(best)
    inside: set[int] = set()
    if named is not None:
        for node in nodes:
            if (node.tag == named.tag and node.names == named.names) or (node.parent is not None and id(node.parent) in inside):
                inside.add(id(node))
    out = []
    for i in plain:
        block, text, _ = pieces[i]
        home = _home(block)
        chars, links = own[id(home)]
        if len(text) >= least and (named is None or id(block) in inside) and (home is best or 5 * links < chars or _look(home) == look) and not BOILERPLATE.search(text):
            out.append(i)
    return out


def _under(pieces: list[tuple[Node, str, int]], keep: set[int]) -> list[bool]:
    """Whether each piece lies in one of the nodes of keep."""
    known: dict[int, bool] = {}
    out = []
    for block, _, _ in pieces:
        up: Node | None = block
        path, found = [], False
        while up is not None:
            if id(up) in known:
                found = known[id(up)]
                break
            path.append(id(up))
            if id(up) in keep:
                found = True
                break
            up = up.parent
        known.update(dict.fromkeys(path, found))
        out.append(found)
    return out


def _chosen(root: Node, nodes: list[Node]) -> list[str]:
    """Texts of the article's pieces. They are those of the article or main part around the best container; without one, those from the first to the last block of prose, and what else is in the containers of prose, or in ones marked like them. Menus count only amid a container's text."""
    pieces = _pieces(root)
    found = _score(pieces, nodes)
    if not found:
        return [t for _, t, _ in pieces]
    best = max(found, key=lambda x: x.points * (1 - x.density()))
    menus = [_is_menu(*piece) for piece in pieces]
    marked = _marked(best)
    if marked is not None:
        core = _under(pieces, {id(marked)})
        if marked.tag == "article":
            return [pieces[i][1] for i in range(len(pieces)) if core[i]]
        of_text = [i for i, (_, t, _) in enumerate(pieces) if core[i] and not menus[i] and len(t) >= LONG]
        first, last = (of_text[0], of_text[-1]) if of_text else (len(pieces), -1)
        return [pieces[i][1] for i in range(len(pieces)) if core[i] and (not menus[i] or first < i < last)]
    prose = _prose(pieces, nodes, best)
    if not prose:
        core = _under(pieces, {id(best)})
        return [pieces[i][1] for i in range(len(pieces)) if core[i] and not menus[i]]
    first, last = prose[0], prose[-1]
    homes = {id(h): h for i in prose for h in (_home(pieces[i][0]),)}
    looks = {_look(h) for h in homes.values()}
    for i in prose:
        pieces[i][0].prose += 1
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.prose += node.prose
    top: Node = pieces[first][0]
    while top.parent is not None and top.prose < len(prose):
        top = top.parent
    # a list isn't an article, but what it is in
    while top.parent is not None and top.tag in LISTS:
        top = top.parent
        homes[id(top)] = top
    core = _under(pieces, set(homes))
    titles = [i for i in range(first) if pieces[i][0].tag == "h1"][-1:]
    i = first
    while i > 0 and pieces[i - 1][0].tag in HEADINGS:
        i -= 1
        titles.append(i)
    out = []
    for i, (block, text, links) in enumerate(pieces):
        few = 4 * links < len(text)
        if menus[i]:
            kept = core[i] and first < i < last
        elif core[i] or (i in titles and few) or (first < i < last and 2 * links < len(text)):
            kept = True
        else:
            beside = block.parent is top.parent and block.tag in ("p", "h1", "h2", "pre", "blockquote")
            kept = few and (beside or _look(_home(block)) in looks) and not BOILERPLATE.search(text)
        if kept:
            out.append(text)
    return out


def extract(html: str | None) -> str:
    """The main text: its blocks joined by newlines; empty if there is none."""
    if not html:
        return ""
    root, nodes = parse(html)
    _keep_text_boxes(nodes)
    _keep_wrappers(root, nodes)
    _drop_others(nodes)
    text = "\n".join(_chosen(root, nodes))
    for node in nodes:  # parents and children hold each other; so a page's tree is freed at once
        node.parent = None
        node.children.clear()
    return text


def main_text(pages: DataFrame, html_col: str = "html", out_col: str = "main_text", keep_html: bool = True) -> DataFrame:
    """pages with the main text of each whole page, and without the html unless keep_html. Row by row, no shuffle; null or empty html gives an empty text."""
    (out_col,) = fresh(pages, out_col)
    schema = with_fields(pages, (out_col, "string"))
    if not keep_html:
        schema = StructType([f for f in schema.fields if f.name != html_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pages_ = batch.column(batch.schema.get_field_index(html_col))
            out = batch.append_column(out_col, pa.array([extract(x.as_py()) for x in pages_], pa.string()))
            yield out if keep_html else out.select([n for n in out.schema.names if n != html_col])

    return pages.mapInArrow(run, schema)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages.

    Null or empty html, or none but menus and the like: an empty text of 0 characters. Repeated rows are read again. No pages: no rows."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = main_text(pages, keep_html=False)
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


#: DuckDB, for the form that the given pages share: one article of h1 and p, inline tags within. Written apart from the operator, which knows nothing of that form.
OP4_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, unnest(regexp_split_to_array(replace(body, '<br>', ' '), '</?(?:p|h1)>')) AS t, generate_subscripts(regexp_split_to_array(replace(body, '<br>', ' '), '</?(?:p|h1)>'), 1) AS i FROM a),
c AS (SELECT page_id, i, regexp_replace(t, '<[^>]*>', '', 'g') AS t FROM b),
d AS (SELECT page_id, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS t FROM c),
e AS (SELECT page_id, i, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM d),
f AS (SELECT page_id, string_agg(t, chr(10) ORDER BY i) AS text FROM e WHERE t <> '' GROUP BY page_id)
SELECT a.page_id, a.url, coalesce(f.text, '') AS text, length(coalesce(f.text, ''))::BIGINT AS n_chars FROM a LEFT JOIN f USING (page_id)
"""
