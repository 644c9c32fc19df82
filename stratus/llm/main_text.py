"""Main text of HTML pages by tree scoring.

A page is cut into tags and text once, tolerant of broken markup, and becomes
a tree of its block elements. Parts that are never article text (menus, page
headers and footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments; told by element, role, class and id words, or hidden) are set
aside; such a part ends where HTML ends it, also without its own end tag. A
wrapper that only a class or id word names is judged by what it holds: it stays
if it holds an article or main element, or most of the page's paragraph
points while no such element stands elsewhere. Every paragraph then passes points to its ancestors: one, one for
each comma and one for each hundred characters (three at most), less its share
of link text; its parent gets all of them, the grandparent half, the ones above a
third, a quarter and a fifth. A container's score is discounted by its own
link density. The best container is kept, widened to the article element
around it. Without one, it is kept with those siblings that score a fifth of it,
are a heading or read like text (under a quarter of it link text, however
short) and with the text between them; so on for the siblings of its parent, as
long as the parent's own text reads like text. Outside of article elements, lists and boxes
that are mostly links are left out.

Character references are decoded; white space inside a block becomes one
space; blocks are joined in page order by one space. Nothing else is dropped
or cut.

Defined results: a null or empty page gives an empty text, as does one without
article text; markup that never ends runs to the end of the page, a comment
that never ends only to the next ``>``, and a quote that never ends is a sign like any other; repeated rows give repeated
results; other columns pass through. Work and memory are linear in the page.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict, deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stratus.llm.common import map_table

# --- Fixed values: elements and name words of HTML pages -----------------------
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark "
                   "nobr q rp rt ruby s samp small span strike strong sub sup time tt u var "
                   "wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template "
                "svg math select object audio video canvas".split())
ASIDE = frozenset("nav footer aside form button dialog menu fieldset label head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert "
                  "alertdialog menu menubar toolbar".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner banners "
                  "breadcrumb breadcrumbs combx comment comments consent cookie cookies disqus "
                  "footer footnav gdpr hidden masthead menu menus modal nav navbar navigation "
                  "newsletter notice notices notification pager pagination popup promo promos "
                  "promotion related remark replies respond rss share sharing shoutbox sidebar "
                  "sidebars skyscraper social sponsor sponsored sponsors subscribe toolbar "
                  "widget widgets".split())
GOOD = frozenset("article articlebody blog body content entry hentry main page post story "
                 "text".split())
COMMENTS = frozenset("combx comment comments disqus remark replies respond shoutbox".split())
ROW = frozenset("tr td th caption colgroup".split())
ROWS = ROW | {"tbody", "thead", "tfoot"}
CELL = frozenset("td th caption colgroup".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": ROW, "td": CELL,
          "th": CELL, "tbody": ROWS, "thead": ROWS, "tfoot": ROWS, "option": {"option"},
          "button": {"button"}}
LISTS = frozenset("ul ol dl menu table select".split())
IN_HEAD = frozenset("base basefont bgsound head link meta".split())
P_ENDS = frozenset("address article aside blockquote center dd details dialog dir div dl dt "
                   "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li "
                   "main menu nav ol p pre search section summary table tbody td tfoot th thead "
                   "tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WALLS = frozenset("article main body table".split())
TAG_POINTS = {"article": 25, "main": 25, "div": 5, "section": 2, "pre": 3, "td": 3,
              "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "th": -5}
# -------------------------------------------------------------------------------

#: A paragraph shorter than this counts by its length alone.
SHORT = 25
#: From this share of link text on, a sibling is links, not text.
LINKED = 0.25
#: What each further ancestor gets of a paragraph's points.
SHARES = (1.0, 0.5, 1 / 3, 1 / 4, 1 / 5)

#: Above this share of the page's points a named wrapper is the article: its name
#: only mentions a part (has-sidebar), or is that of a part (sidebar).
MENTIONS, NAMES = 2 / 3, 0.95

_TOKEN = re.compile(r"<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)|<!--|<[!?/][^>]*(?:>|\Z)")
_COMMENT_END = re.compile(r"--!?>")
#: The end of a tag, or a quoted value in it.
_IN_TAG = re.compile(r">|=\s*([\"'])")
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
_ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAMES = re.compile(r"[a-z]+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    __slots__ = ("tag", "parent", "parts", "size", "links", "commas", "own", "own_links",
                 "score", "candidate", "article", "soft", "share", "nested", "proper", "points",
                 "holds", "gone", "depth", "within")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.parts = tag, parent, []
        self.size = self.links = self.commas = self.own = self.own_links = 0
        self.score, self.candidate, self.article, self.soft = 0.0, False, False, False
        self.share = None             # of a named wrapper: the share above which it stays
        self.nested = False           # inside an article element
        self.proper = False           # an article or main element without a name of WORDS
        self.points, self.holds, self.gone = 0.0, False, False
        self.depth = 0                # place among the open elements
        self.within = False           # an article or main element stands inside

    def density(self) -> float:
        return self.links / self.size if self.size else 0.0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape((m[2] or "").strip("\"'")).lower()
            for m in _ATTR.finditer(text)}


def _set_aside(tag: str, attrs: dict[str, str], inside_article: bool) -> bool:
    """Whether a part is never article text, whatever it holds."""
    if tag in ASIDE or tag == "header" and not inside_article:
        return True
    return bool(attrs) and bool(
        attrs.get("role") in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true"
        or "style" in attrs and _NOT_SHOWN.search(attrs["style"]))


def _named(attrs: dict[str, str]) -> list[list[str]]:
    """Words of the class and id names that tell a part to set aside."""
    found = []
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = _NAMES.findall(name)
        if WORDS.intersection(words) and not (GOOD.intersection(words) and words[-1] in GOOD):
            found.append(words)
    return found


def _judge(node: Node, attrs: dict[str, str], named: list[list[str]]) -> None:
    """What a named wrapper must hold to stay."""
    good = GOOD.intersection(_NAMES.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}"))
    own = [words for words in named if words[0] in WORDS]
    node.share = NAMES if own and not good else MENTIONS
    # an article element inside reader comments, or inside an article, is a comment
    node.nested |= not good and any(words[0] in COMMENTS for words in own)


def _bonus(tag: str, attrs: dict[str, str]) -> float:
    names = _NAMES.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}") if attrs else ()
    return TAG_POINTS.get(tag, -5 if tag in HEADINGS else 0) + (25 if GOOD.intersection(names) else 0)


class Tree:
    """Block elements of a page, in page order."""

    def __init__(self, page: str):
        self.root = self.here = Node("#root", None)
        self.nodes = [self.root]
        self.link = 0                 # open links
        self.inlines: Counter[str] = Counter()        # open inline elements of the block
        self.top: Node | None = None  # the part set aside that is open
        self.inside: Counter[str] = Counter()         # its open elements
        # the open elements, and the places among them of each tag, of those that
        # stray end tags don't pass and of those that end a search in a part set aside
        self.path = [self.root]
        self.at: dict[str, list[int]] = defaultdict(list)
        self.walls: list[int] = []
        self.solid: list[int] = []
        self.unquoted: set[str] = set()               # quotes that don't occur any more
        at, comments = 0, True
        for m in iter(lambda: _TOKEN.search(page, at), None):
            if m.start() > at:
                self._text(page[at:m.start()])
            at = m.end()
            if m[0] == "<!--":
                end = _COMMENT_END.search(page, at) if comments else None
                comments = end is not None
                at = end.end() if end else page.find(">", at) + 1 or len(page)
                continue
            if m["name"] is None:
                continue
            attrs, at = self._rest_of_tag(page, at)
            tag = m["name"].lower()
            if m["close"]:
                self._close(tag)
                continue
            if tag in RAW:
                if not attrs.rstrip().endswith("/"):
                    end = _RAW_END[tag].search(page, at)
                    at = end.start() if end else len(page)
                self._text(" ")
                continue
            self._open(tag, attrs)
        if at < len(page):
            self._text(page[at:])

    def _rest_of_tag(self, page: str, start: int) -> tuple[str, int]:
        """A tag's attributes and where it ends. A quote that never ends is a sign
        like any other."""
        at = start
        while (m := _IN_TAG.search(page, at)) and m[0] != ">":
            at, quote = m.end(), m[1]
            if quote not in self.unquoted:
                end = page.find(quote, at)
                if end < 0:
                    self.unquoted.add(quote)
                else:
                    at = end + 1
        return (page[start:m.start()], m.end()) if m else (page[start:], len(page))

    def _enter(self, node: Node) -> None:
        node.depth = len(self.path)
        self.path.append(node)
        self.at[node.tag].append(node.depth)
        if node.tag in WALLS:
            self.walls.append(node.depth)
        if node.tag not in INLINE and node.tag not in ("address", "div", "p"):
            self.solid.append(node.depth)
        self.here = node

    def _leave(self, parent: Node) -> None:
        """End all that is open inside ``parent``."""
        while self.path[-1] is not parent:
            node = self.path.pop()
            self.at[node.tag].pop()
            for places in (self.walls, self.solid):
                if places and places[-1] == node.depth:
                    places.pop()
        self.here = parent

    def _last(self, tags) -> int:
        """Place of the innermost open element of ``tags``; 0 without one."""
        return max((self.at[t][-1] for t in tags if self.at[t]), default=0)

    def _text(self, text: str) -> None:
        if self.top is not None:
            if self.top.tag != "head" or not text.strip():
                return
            self._up(self.top)                        # text begins the body
        if "&" in text:
            text = unescape(text)
        here = self.here
        here.parts.append(text)
        n = len(text.strip())
        here.own += n
        here.commas += text.count(",") + text.count("，") + text.count("、")
        if self.link:
            here.own_links += n

    def _open(self, tag: str, attrs: str) -> None:
        if self.top is not None and self.top.tag == "head":
            if tag in IN_HEAD:
                return
            self._up(self.top)
        if tag not in INLINE and (tag not in VOID or tag == "hr"):
            self._imply(tag)
        elif self.top is not None and (self.top.tag == tag == "a" or tag in ("rt", "rp")
                                       and self.top.tag in ("rt", "rp")):
            self._up(self.top)
        if self.top is not None:
            if tag not in VOID:
                self.inside[tag] += 1
                if tag not in INLINE:
                    self._enter(Node(tag, self.here))
            return
        if tag == "br" or tag == "hr":
            self.here.parts.append(" ")
            return
        if tag in VOID:
            return
        attributes = _attributes(attrs) if attrs.strip(" /") else {}
        aside = _set_aside(tag, attributes, self.here.article)
        named = _named(attributes) if attributes and tag not in ("html", "body") else []
        if tag != "form" and (aside or named and (
                tag in INLINE or tag == "p" or tag in HEADINGS)):
            self.here.parts.append(" ")
            self._enter(Node(tag, self.here))
            self.top, self.inside = self.here, Counter([tag])
            return
        if tag in INLINE:
            self.inlines[tag] += 1
            self.link += tag == "a"
            return
        node = Node(tag, self.here)
        node.score = _bonus(tag, attributes)
        node.article = self.here.article or tag in ("article", "main")
        node.nested = self.here.nested or self.here.tag == "article"
        node.soft = tag == "form"
        if tag in ("article", "main"):
            node.proper = not named and not node.nested
        elif named and tag != "form":
            _judge(node, attributes, named)
        self.here.parts.append(node)
        self.nodes.append(node)
        self._enter(node)

    def _imply(self, tag: str) -> None:
        """End tags that a start tag implies."""
        node = self.here
        if node is self.top and node.tag in INLINE:
            node = node.parent
        if node.tag == "p" and (self.top is None or tag in P_ENDS):
            self._up(node)
        elif node.tag in HEADINGS and tag in HEADINGS:
            self._up(node)
        if tag not in CLOSES:
            return
        found, stop = self._last(CLOSES[tag]), self._last(("table",))
        if tag not in ROWS:
            stop = max(stop, self._last(LISTS))
            if self.top is not None and self.solid:
                stop = max(stop, self.solid[-1])
        if not found or stop > found:
            return
        node = self.path[found]
        while node.parent.tag in CLOSES[tag]:
            node = node.parent
        self._up(node)

    def _up(self, node: Node) -> None:
        """End ``node`` and what is open in it."""
        at = self.here
        if self.top is not None:
            while self.top is not None and at is not node.parent:
                self.inside[at.tag] -= 1
                if at is self.top:
                    self.top = None
                at = at.parent
            if at is node.parent:
                self._leave(at)
                return
        self._leave(node.parent)
        self.link = 0
        self.inlines.clear()

    def _close(self, tag: str) -> None:
        if tag in INLINE:
            self._close_inline(tag)
            return
        if self.here.tag in HEADINGS and tag in HEADINGS:
            tag = self.here.tag
        if self.top is not None:
            if self.inside[tag] > 0:
                self._up(self.path[self._last((tag,))])
                return
            if tag in ("body", "html"):
                self._up(self.top)
            elif self.inside["table"] > 0:
                return                                # a stray end tag
        found = self._last((tag,))
        # nor does one end what stands around an article
        if found and (tag in WALLS or tag == "html" or not self._walls_above(found)):
            self._up(self.path[found])

    def _walls_above(self, place: int) -> bool:
        """Whether an article, main, body or table stands open inside ``place``, apart
        from the part that is set aside."""
        limit = self.top.depth if self.top is not None else len(self.path)
        i = bisect_left(self.walls, limit)
        return i > 0 and self.walls[i - 1] > place

    def _close_inline(self, tag: str) -> None:
        if self.top is not None:
            if self.inside[tag] > 0:
                if tag == self.top.tag and self.inside[tag] == 1:
                    self._up(self.top)
                else:
                    self.inside[tag] -= 1
                return
            if self.top.tag not in INLINE or self.inlines[tag] <= 0:
                return
            self._up(self.top)                        # an element around it ends
        if self.inlines[tag] > 0:
            self.inlines[tag] -= 1
        if tag == "a" and self.link:
            self.link -= 1


def _measure(nodes: list[Node]) -> None:
    for node in nodes:
        node.size, node.links = node.own, node.own_links
    for node in reversed(nodes):                      # children come after their parents
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.links += node.links
            node.parent.within |= node.within or node.tag in ("article", "main")


def _points(node: Node) -> float:
    """Points of the text that stands in ``node`` itself."""
    if not node.own or node.tag in HEADINGS or node.tag == "title":
        return 0.0
    points = node.own / 100
    if node.own >= SHORT:
        points = 1 + node.commas + min(points, 3)
    return points * (1 - node.own_links / node.own)


def _leave_out(nodes: list[Node]) -> list[Node]:
    """Nodes without the named wrappers that are not the article."""
    if not any(node.share for node in nodes):
        return nodes
    for node in reversed(nodes):
        node.points += _points(node)
        if node.parent is not None:
            node.parent.points += node.points
            node.parent.holds |= node.holds or node.proper
    open_to = {}                      # node: not in a wrapper that is still to be judged
    for node in nodes:
        if node.share and node.holds and not node.nested:
            node.share = None
        open_to[node] = not node.share and (node.parent is None or open_to[node.parent])
    clear = sum(n.proper and open_to[n] and n.points > 0 for n in nodes)
    above = {}                        # node: how many of those stand around it
    for node in nodes:
        up = node.parent
        above[node] = (above[up] + (up.proper and open_to[up] and up.points > 0)
                       if up is not None else 0)
        node.gone = up is not None and up.gone or bool(node.share) and (
            above[node] < clear or node.points <= node.share * nodes[0].points)
    return [node for node in nodes if not node.gone]


def _give_points(nodes: list[Node]) -> None:
    for node in nodes:
        points = _points(node)
        if not node.own or node.tag in HEADINGS or node.tag == "title":
            continue
        # text that stands in a container itself counts for the container
        up = node.parent if node.tag in ("p", "pre", "li", "dd", "dt", "td", "th") else node
        for share in SHARES:
            if up is None:
                break
            up.score += points * share
            up.candidate = True
            up = up.parent


def _kept(node: Node, best: Node, floor: float) -> bool:
    if node.gone:
        return False
    if node.candidate and node.tag not in ("p",) and node.score * (1 - node.density()) >= floor:
        return True
    if node.tag in HEADINGS:
        return True
    # articles beside an article are pages of their own
    return (best.tag != "article" and not node.soft and node.size > 0
            and node.density() < LINKED)


def _collect(start: Node, out: list[str] | deque[str]) -> None:
    held: list = [start]
    while held:
        part = held.pop()
        if isinstance(part, str):
            out.append(part)
            continue
        if part is not start:
            if part.gone or part.soft and not part.within:
                out.append(" ")
                continue
            # inside an article, what is no part of it is set aside by name or kind
            if (not part.article and part.tag in ("ul", "ol", "dl", "div", "section", "table")
                    and part.size and part.density() > 0.5):
                continue
        out.append(" ")
        held.append(" ")
        held.extend(reversed(part.parts))


def _add_siblings(best: Node, floor: float, out: deque[str]) -> None:
    """Put the text beside ``best`` that belongs to it around its own."""
    level = best
    while True:
        around = level.parent
        between = best.tag != "article" and around.own_links < LINKED * around.own
        before: list[str] = []
        to: list[str] | deque[str] = before
        for part in around.parts:
            if part is level:
                to = out
            elif isinstance(part, str):
                to.append(part if between else " ")
            elif _kept(part, best, floor) and (best.tag != "article" or part.tag == "article"):
                _collect(part, to)
        out.extendleft(reversed(before))
        if (best.tag == "article" or around.parent is None or around.tag in ("html", "body")
                or around.size > level.size and around.density() >= LINKED):
            return
        level = around


def main_text(page: str | None) -> str:
    """The article's text of one page."""
    if not page:
        return ""
    tree = Tree(page)
    nodes = _leave_out(tree.nodes)
    _measure(nodes)
    _give_points(nodes)
    best, most = tree.root, 0.0
    for node in nodes[1:]:
        if node.candidate and node.tag not in ("html", "body"):
            score = node.score * (1 - node.density())
            if score > most:
                best, most = node, score
    wide = best
    while wide.parent is not None and wide.tag not in ("article", "main"):
        wide = wide.parent
    if wide.parent is not None:
        best = wide
    out: deque[str] = deque()
    _collect(best, out)
    if best.parent is not None and best.tag != "main":
        _add_siblings(best, max(10.0, most * 0.2), out)
    return " ".join("".join(out).split())


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with its HTML column replaced by ``out``, the main text."""
    at = pages.columns.index(html_col)
    places = [i for i, f in enumerate(pages.schema.fields) if i != at and f.name.lower() != out.lower()]
    fields = [*(pages.schema.fields[i] for i in places), T.StructField(out, T.StringType())]

    def run(batches):
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(at)]
            yield [*(batch.column(i) for i in places), pa.array(texts, pa.string())]

    return map_table(pages, run, fields)
