"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element is a node with a hidden state, content or other. Node potentials are a logistic function of the element's
own signs (tag, words of class, id and role, link share, text length, markup inside); edge potentials couple parents and
children. Sum-product messages pass up and down the tree and give each node's marginal of being content; text blocks of
content nodes make the main text. Both potentials are trained on labelled pages that this module writes by rules of
its own: many layouts, with their articles marked.

Elements whose text is never shown (script, style, head and the like) are cut before the model.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidetrace.llm.common import prepare

HIDDEN = frozenset("script style head noscript template svg iframe object canvas audio video math textarea select option datalist title".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul hr".split())
#: Opening one of these ends an open paragraph; opening a key ends open elements of its set, up to a list or table.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"}}
#: Elements whose end tag may be left out, and all that may stand in a head.
UNCLOSED = frozenset("head p li dt dd tr td th tbody thead tfoot option optgroup".split())
IN_HEAD = frozenset("title meta link base style script noscript template basefont bgsound".split())
WALLS = frozenset("ul ol dl table menu html body td th".split())
INLINE_CLOSED = frozenset("b i em strong a span small u s font code mark sub sup q cite abbr time".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
#: Attributes whose words are signs.
NAMED = frozenset(("class", "id", "role", "itemprop", "aria-label"))
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")

#: Words in class, id or role, as signs of what an element is for. Fixed values.
SIGNS = {
    "menu": "nav navigation menu menubar breadcrumb breadcrumbs toolbar tabs pager pagination skip toc sitemap",
    "head": "header masthead banner topbar logo branding sitehead",
    "foot": "footer foot colophon copyright legal bottom",
    "side": "sidebar aside side related recommended trending popular widget rail promo teaser more",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter signup paywall privacy banner dialog toast",
    "advert": "ad ads advert adverts advertisement sponsor sponsored adsense promoted dfp gpt taboola outbrain",
    "form": "form search login signin contact poll survey",
    "comment": "comment comments disqus replies reply respond discussion feedback reader",
    "share": "share social sharing follow facebook twitter tags tag byline meta author rating print",
    "article": "article content main post entry story body text blog page prose articlebody mainentity",
}
_SIGN = {w: i for i, ws in enumerate(SIGNS.values()) for w in ws.split()}
TAGS = "article main section div p h1 h2 h3 h4 h5 h6 ul ol li blockquote pre table tr td th figure figcaption nav header footer aside form button label a span b i em strong dl dt dd body html address dialog menu fieldset details summary".split()
_TAG = {t: i for i, t in enumerate(TAGS)}
_ALWAYS_OTHER = frozenset("nav form button dialog menu fieldset label".split())
N_SIGNS, N_TAGS = len(SIGNS), len(TAGS)
#: Tags whose presence above a node is a sign of its own, as are the signs of all elements above it.
ABOVE = "article main section nav aside header footer form table".split()
_ABOVE = {t: i for i, t in enumerate(ABOVE)}
N_FEATURES = 1 + N_TAGS + 1 + N_SIGNS + 6 + N_SIGNS + len(ABOVE) + 5


class Node:
    __slots__ = ("children", "content", "features", "links", "order", "parent", "signs", "tag", "text")

    def __init__(self, tag: str, parent: Node | None, signs: frozenset[int] = frozenset()) -> None:
        self.tag, self.parent, self.signs = tag, parent, signs
        self.children: list[Node] = []
        self.text: list[str | Node] = []  # in order: strings and children
        self.content = False


@lru_cache(maxsize=8192)
def told(attributes: str) -> tuple[bool, frozenset[int]]:
    """Whether an element with these attributes is hidden, and its signs. Only whole attributes count, never words in their values."""
    hidden, words = False, []
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        hidden = hidden or name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and bool(_UNSEEN.search(value)))
        if name in NAMED:
            words += _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())
    return hidden, frozenset(_SIGN[w] for w in words if w in _SIGN)


def above(at: Node | None, name: str) -> bool:
    while at and at.tag != name:
        at = at.parent
    return at is not None


def ends_hidden(hidden: str, name: str, opened: list[str]) -> bool:
    """Whether the start of an element ends a hidden one whose end tag is left out; opened are the blocks open inside it."""
    if hidden == "head":
        return name not in IN_HEAD and name not in ("head", "html") and not opened
    if hidden == "p":
        return name in BLOCKS and not opened
    return hidden in ENDS.get(name, ()) and not WALLS.intersection(opened)


def parse(page: str) -> Node:
    """The element tree of a page, whatever is wrong with it; hidden elements are left out."""
    root = at = Node("html", None)
    pos, n = 0, len(page)
    skip_to = None
    depth = 0
    opened: list[str] = []  # blocks inside the hidden element

    def text(raw: str) -> None:
        if raw and depth == 0:
            at.text.append(entities.unescape(raw) if "&" in raw else raw)

    while pos < n:
        m = _TOKEN.search(page, pos)
        if not m:
            text(page[pos:])
            break
        text(page[pos : m.start()])
        pos = m.end()
        name = m[2]
        if not name:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        name = name.lower()
        if m[1]:
            if depth:
                if name == skip_to:
                    depth -= 1
                    continue
                if name in opened:
                    del opened[len(opened) - 1 - opened[::-1].index(name) :]
                    continue
                if not (skip_to in UNCLOSED and name in BLOCKS and above(at, name)):
                    continue
                depth = 0  # the end of an element around it
            found = at
            while found and found.tag != name and not (found.tag in WALLS and name in ("li", "p", "td", "tr", "dd", "dt")):
                found = found.parent
            if found and found.tag == name and found.parent:
                at = found.parent
            continue
        attributes = m[3]
        closed = attributes.endswith("/") and name not in BLOCKS
        if name in RAW and not closed:
            end = re.compile(f"</{name}[\\s/>]", re.I).search(page, pos)
            if end is None:
                pos = n
            else:
                close = page.find(">", end.start())
                pos = n if close < 0 else close + 1
            continue
        if depth and ends_hidden(skip_to, name, opened):
            depth = 0
        if depth:
            if name == skip_to and not closed:
                depth += 1
            elif name in BLOCKS and name not in VOID:
                opened.append(name)
            continue
        if name in VOID:
            if name in ("br", "hr"):
                at.text.append(" ")
            continue
        hidden, signs = told(attributes) if attributes.strip(" /") else (False, frozenset())
        if name in HIDDEN or hidden:
            if not closed:
                skip_to, depth, opened = name, 1, []
            continue
        if name in ("html", "body"):
            if name == "body" and at.tag == "html" and at.parent is None:
                child = Node("body", at)
                at.children.append(child)
                at.text.append(child)
                at = child
            continue
        if name in BLOCKS:
            found = at
            while found.tag in INLINE_CLOSED and found.parent:
                found = found.parent
            if found.tag == "p" and found.parent:  # a block ends the paragraph, with what is open in it
                at = found.parent
            ended = ENDS.get(name)
            if ended:
                found = at
                while found.parent and found.tag not in WALLS:
                    if found.tag in ended:
                        at = found.parent
                    found = found.parent
                if found.tag in ended and found.parent:
                    at = found.parent
        child = Node(name, at, signs)
        at.children.append(child)
        at.text.append(child)
        if not closed:
            at = child
    return root


def nodes_of(root: Node) -> list[Node]:
    """All nodes, parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        x.order = len(out)
        out.append(x)
        stack.extend(reversed(x.children))
    return out


def potentials(nodes: list[Node]) -> np.ndarray:
    """The features of each node."""
    n = len(nodes)
    size, linked, words, tags = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    own = np.zeros(n)
    for x in reversed(nodes):
        i = x.order
        for t in x.text:
            if t.__class__ is str:
                own[i] += len(t.strip())
                words[i] += t.count(" ")
        size[i] += own[i]
        if x.tag == "a":
            linked[i] = size[i]
        tags[i] += 1
        if x.parent:
            p = x.parent.order
            size[p] += size[i]
            linked[p] += linked[i]
            words[p] += words[i]
            tags[p] += tags[i]
    out = np.zeros((n, N_FEATURES))
    out[:, 0] = 1
    for x in nodes:
        out[x.order, 1 + _TAG.get(x.tag, N_TAGS)] = 1
        for s in x.signs:
            out[x.order, 2 + N_TAGS + s] = 1
    rest = 2 + N_TAGS + N_SIGNS
    out[:, rest] = linked / np.maximum(1, size)
    out[:, rest + 1] = np.log1p(size) / 10
    out[:, rest + 2] = size / np.maximum(1, size[0])
    out[:, rest + 3] = size == 0
    out[:, rest + 4] = np.minimum(1, size / tags / 200)
    out[:, rest + 5] = (size < 25) & (size > 0)
    above = rest + 6
    for x in nodes:
        i = x.order
        if x.parent:
            p = x.parent.order
            out[i, above : above + N_SIGNS + len(ABOVE)] = out[p, above : above + N_SIGNS + len(ABOVE)]
            for s in x.parent.signs:
                out[i, above + s] = 1
            k = _ABOVE.get(x.parent.tag)
            if k is not None:
                out[i, above + N_SIGNS + k] = 1
    inside = out[:, above + N_SIGNS] + out[:, 1 + _TAG["article"]]  # an article's header is not the site's
    out[:, -5] = own / np.maximum(1, size[0])
    out[:, -4] = np.log1p(own) / 10
    out[:, -3] = out[:, -4] * (out[:, 1 + _TAG["body"]] + out[:, 1 + _TAG["html"]])  # loose text
    out[:, -2] = (inside == 0) * out[:, above + N_SIGNS + _ABOVE["header"]]
    out[:, -1] = not any(x.tag in ("article", "main") for x in nodes)
    return out


class Model:
    def __init__(self, weights: np.ndarray, edges: np.ndarray) -> None:
        self.weights, self.edges = weights, edges  # edges[parent state, child state], log

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        """P(content) of each node: messages from the leaves up, then from the root down."""
        n = len(nodes)
        unary = (potentials(nodes) @ self.weights).tolist()
        (e00, e01), (e10, e11) = np.exp(self.edges).tolist()
        own0, own1 = [1.0] * n, [1.0] * n
        to0, to1 = [1.0] * n, [1.0] * n
        for i, u in enumerate(unary):
            own1[i] = 1 / (1 + exp(-max(-30.0, min(30.0, u))))
            own0[i] = 1 - own1[i] + 1e-13
        parents = [x.parent.order if x.parent else -1 for x in nodes]
        for i in range(n - 1, 0, -1):
            a, b = own0[i], own1[i]
            m0, m1 = e00 * a + e01 * b, e10 * a + e11 * b
            s = m0 + m1
            to0[i], to1[i] = m0 / s, m1 / s
            p = parents[i]
            own0[p] *= to0[i]
            own1[p] *= to1[i]
            s = own0[p] + own1[p]
            own0[p] /= s
            own1[p] /= s
        down0, down1 = [1.0] * n, [1.0] * n
        out = np.zeros(n)
        for i in range(n):
            p = parents[i]
            if p >= 0:
                a, b = own0[p] * down0[p] / to0[i], own1[p] * down1[p] / to1[i]
                s = a + b
                a, b = a / s, b / s
                d0, d1 = a * e00 + b * e10, a * e01 + b * e11
                down0[i], down1[i] = d0 / (d0 + d1), d1 / (d0 + d1)
            a, b = own0[i] * down0[i], own1[i] * down1[i]
            out[i] = b / (a + b)
        return out


def blocks_of(root: Node, content: np.ndarray) -> str:
    """Text of the content nodes: block elements cut it, white space inside a block is one space, blocks are lines."""
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        line = _SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if line:
            out.append(line)

    stack: list[str | Node | None] = [root]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif x.__class__ is str:
            held.append(x)
        else:
            block = x.tag in BLOCKS
            if block:
                close()
                stack.append(None)
            mine = content[x.order]
            stack.extend(t for t in reversed(x.text) if t.__class__ is not str or mine)
    close()
    return "\n".join(out)


def extract(page: str | None, model: Model) -> str:
    """The main text of a page; a null or empty page has none."""
    if not page:
        return ""
    root = parse(page)
    nodes = nodes_of(root)
    content = model.marginals(nodes) >= 0.5
    for x in nodes:  # markup inside a block belongs to it; nothing inside an element of a set role is the article's
        if x.parent:
            p = x.parent.order
            if x.tag in INLINE_CLOSED and not x.signs:
                content[x.order] = content[p]
            elif x.tag in _ALWAYS_OTHER:
                content[x.order] = False
    return blocks_of(root, content)


# Labelled pages


def _prose(r: random.Random, low: int, high: int) -> str:
    parts = ["ka", "lo", "mi", "tren", "sul", "der", "pon", "ve", "rit", "as", "on", "que", "bel", "th", "ing", "er", "du", "fa"]
    words = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
    return " ".join(words).capitalize() + r.choice(".,!?&;") * r.choice([0, 1, 1])


def _labelled(r: random.Random) -> Node:
    """A page of one of many layouts, whose nodes carry their state."""
    root = Node("html", None)

    def add(parent: Node, tag: str, names: str = "", text: str = "", content: bool = False) -> Node:
        x = Node(tag, parent, frozenset(_SIGN[w] for w in names.split() if w in _SIGN))
        x.content = content
        parent.children.append(x)
        parent.text.append(x)
        if text:
            x.text.append(text)
        return x

    def links(parent: Node, n: int, long: bool = False) -> None:
        ul = add(parent, r.choice(["ul", "ol", "div"]))
        for _ in range(n):
            add(add(ul, "li") if ul.tag != "div" else ul, "a", "", _prose(r, 3, 9) if long else _prose(r, 1, 3))

    body = add(root, "body")
    if r.random() < 0.35:
        _bare(r, body, add, links)
        return root
    frame = add(body, "div", r.choice(["", "page", "wrapper"])) if r.random() < 0.4 else body
    plain = r.random() < 0.25

    def name(tag: str, words: str) -> tuple[str, str]:
        word = r.choice(words.split())
        return (tag, "" if plain else r.choice(["", word])) if r.random() < 0.6 else ("div", word)

    def before() -> None:
        if r.random() < 0.6:
            h = add(frame, *name("header", SIGNS["head"]))
            add(h, r.choice(["h1", "a", "p", "span", "div"]), "", _prose(r, 1, 6))
        if r.random() < 0.9:
            links(add(frame, *name("nav", SIGNS["menu"])), r.randint(3, 9))
        if r.random() < 0.3:
            add(add(frame, *name("dialog", SIGNS["notice"])), r.choice(["p", "span", "div"]), "", _prose(r, 5, 40))
        if r.random() < 0.6:
            add(frame, "div", r.choice(SIGNS["advert"].split()), _prose(r, 2, 30))

    def after() -> None:
        if r.random() < 0.5:
            s = add(frame, *name("aside", SIGNS["side"]))
            if r.random() < 0.5:
                add(s, r.choice(["h2", "h3", "h4"]), "", _prose(r, 1, 4))
            if r.random() < 0.6:
                links(s, r.randint(2, 8), True)
            else:
                add(s, "p", "", _prose(r, 5, 40))
        if r.random() < 0.4:
            c = add(frame, r.choice(["section", "div", "ul"]), r.choice(SIGNS["comment"].split()))
            for _ in range(r.randint(1, 5)):
                one = add(c, r.choice(["div", "li", "article"]), r.choice(["comment", "comment", "reply", ""]))
                add(one, r.choice(["p", "div"]), "", _prose(r, 4, 60))
        if r.random() < 0.4:
            f = add(frame, "form", r.choice(["", *SIGNS["form"].split()]))
            add(f, "label", "", _prose(r, 1, 5))
            add(f, "button", "", _prose(r, 1, 2))
        if r.random() < 0.3:
            add(frame, "div", r.choice(SIGNS["advert"].split()), _prose(r, 2, 30))
        if r.random() < 0.9:
            f = add(frame, *name("footer", SIGNS["foot"]))
            if r.random() < 0.5:
                f.text.append(_prose(r, 3, 40))
            else:
                add(f, "p", "", _prose(r, 3, 40))
            if r.random() < 0.4:
                links(f, r.randint(2, 5))

    before()
    holder, tiny = frame, r.random() < 0.25
    if r.random() < 0.4:
        holder = add(frame, *name("main", SIGNS["article"]), content=True)
        if r.random() < 0.2:
            add(holder, "div", r.choice(SIGNS["notice"].split()), _prose(r, 2, 12))
    layout = r.random()
    if layout < 0.1:
        art = holder  # no article element at all
    else:
        art = add(holder, *(("article", "" if r.random() < 0.6 else "article post entry") if layout < 0.78 else ("div", r.choice(SIGNS["article"].split()))), content=True)
    outer = art
    for _ in range(r.choice([0, 0, 0, 1, 2])):
        art = add(art, "div", r.choice(["", "", *SIGNS["article"].split()]), "", True)
    if r.random() < 0.7:
        head = add(art, "header", "", "", True) if r.random() < 0.2 and layout >= 0.1 else art
        add(head, r.choice(["h1", "h1", "h2"]), "", _prose(r, 1, 3 if tiny else 14), True)
    for _ in range(r.choice([1, 2]) if tiny else r.choice([1, 2, 4, 8, 15])):
        kind = r.random()
        if kind < 0.7:
            p = add(art, "p", "", _prose(r, 1, 3 if tiny else r.choice([4, 30, 120, 500])), True)
            if r.random() < 0.3:
                add(p, r.choice(["b", "i", "em", "a", "span", "strong"]), "", _prose(r, 1, 3 if tiny else 12), True)
        elif kind < 0.77:
            add(art, r.choice(["h2", "h3", "h4"]), "", _prose(r, 1, 8), True)
        elif kind < 0.84:
            ul = add(art, r.choice(["ul", "ol"]), "", "", True)
            for _ in range(r.randint(1, 5)):
                add(ul, "li", "", _prose(r, 1, 15), True)
        elif kind < 0.88:
            if r.random() < 0.6:
                add(art, r.choice(["blockquote", "pre"]), "", _prose(r, 3, 40), True)
            else:
                add(add(art, "figure", "", "", True), "figcaption", "", _prose(r, 1, 8), True)
        elif kind < 0.91:
            t = add(art, "table", "", "", True)
            for _ in range(r.randint(1, 3)):
                tr = add(t, "tr", "", "", True)
                for _ in range(2):
                    add(tr, r.choice(["td", "th"]), "", _prose(r, 1, 5), True)
        elif kind < 0.94:
            add(art, "div", r.choice((SIGNS["advert"] + " " + SIGNS["notice"]).split()), _prose(r, 2, 20))
        elif kind < 0.97:
            s = add(art, *(("aside", "") if r.random() < 0.5 else ("div", r.choice((SIGNS["side"] + " " + SIGNS["share"]).split()))))
            if r.random() < 0.5:
                s.text.append(_prose(r, 1, 12))
            links(s, r.randint(1, 4), True)
        else:
            f = add(art, "form", r.choice(["", *SIGNS["form"].split()]))
            add(f, "label", "", _prose(r, 1, 5))
    if r.random() < 0.3:
        add(art, "div", r.choice((SIGNS["advert"] + " " + SIGNS["notice"] + " " + SIGNS["share"]).split()), _prose(r, 2, 25))
    if r.random() < 0.2:
        c = add(outer, r.choice(["section", "div"]), r.choice(SIGNS["comment"].split()))
        for _ in range(r.randint(1, 4)):
            one = add(c, r.choice(["div", "article", "p"]), r.choice(["comment", "", ""]))
            if one.tag == "p":
                one.text.append(_prose(r, 1, 40))
            else:
                add(one, "p", "", _prose(r, 1, 40))
    after()
    return root


def _bare(r: random.Random, body: Node, add: Callable[..., Node], links: Callable[..., None]) -> None:
    """Fills a body whose article has no signs: paragraphs or loose text in the body, in plain divs or in a table cell."""

    def menu(at: Node) -> None:
        if r.random() < 0.5:
            links(add(at, r.choice(["nav", "div", "div", "ul"])), r.randint(2, 8))
        else:
            for _ in range(r.randint(1, 6)):
                add(at, "a", "", _prose(r, 1, 3))

    def article(at: Node) -> None:
        if r.random() < 0.8:
            add(at, r.choice(["h1", "h1", "h2"]), "", _prose(r, 1, 10), True)
        kind, n = r.random() + 0.3 * (at.tag == "body"), r.choice([1, 1, 2, 3, 6])
        for _ in range(n):
            text = _prose(r, r.choice([2, 10, 30]), r.choice([40, 150, 500]))
            if r.random() < 0.15:
                add(at, r.choice(["div", "div", "p", "aside"]), r.choice((SIGNS["advert"] + " " + SIGNS["notice"] + " " + SIGNS["share"]).split()), _prose(r, 2, 25))
            if kind < 0.55:
                add(at, "p", "", text, True)
            elif kind < 0.75:
                add(at, "div", "", text, True)
            else:  # loose text, cut by breaks
                at.content = True
                at.text.append(text + " ")
                if r.random() < 0.3:
                    add(at, r.choice(["b", "i", "a", "span"]), "", _prose(r, 1, 4), True)
        if r.random() < 0.2:
            ul = add(at, "ul", "", "", True)
            for _ in range(r.randint(1, 4)):
                add(ul, "li", "", _prose(r, 2, 15), True)

    def foot(at: Node) -> None:
        f = add(at, r.choice(["footer", "footer", "div"]), r.choice(SIGNS["foot"].split()), "")
        if r.random() < 0.5:
            add(f, "p", "", _prose(r, 2, 20))
        else:
            f.text.append(_prose(r, 2, 20))

    layout = r.random()
    if layout < 0.3:  # a table
        t = add(body, "table")
        if r.random() < 0.4:
            add(add(add(t, "tr"), "td"), r.choice(["a", "h1", "b"]), "", _prose(r, 1, 3))
        tr = add(t, "tr")
        cells = r.random() < 0.7
        if cells:
            menu(add(tr, "td"))
        article(add(tr, "td", "", "", True))
        if not cells:
            menu(add(tr, "td"))
        if r.random() < 0.5:
            cell = add(add(t, "tr"), "td", r.choice(SIGNS["foot"].split()))
            cell.text.append(_prose(r, 2, 12))
        return
    if r.random() < 0.5:
        menu(body if r.random() < 0.3 else add(body, r.choice(["div", "header", "nav"]), r.choice(["", *SIGNS["menu"].split()])))
    at = body
    for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
        at = add(at, "div", r.choice(["", "", "page", "wrapper"]), "", True)
    if r.random() < 0.25:
        at = add(at, r.choice(["article", "main", "section"]), "", "", True)
    article(at)
    if r.random() < 0.2:
        add(body, "aside", r.choice(["", *SIGNS["side"].split()]), _prose(r, 3, 30))
    if r.random() < 0.6:
        foot(body)


@lru_cache(maxsize=2)
def trained(pages: int = 1500, seed: int = 7) -> Model:
    """Fits node weights by ridge logistic regression and edge potentials by smoothed counts, on generated labelled pages."""
    r = random.Random(seed)
    x, y, edges = [], [], np.ones((2, 2))
    for _ in range(pages):
        nodes = nodes_of(_labelled(r))
        x.append(potentials(nodes))
        y.extend(n.content for n in nodes)
        for n in nodes[1:]:
            edges[int(n.parent.content), int(n.content)] += 1
    x, y = np.concatenate(x), np.array(y, float)
    w = np.zeros(N_FEATURES)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        d = p * (1 - p) + 1e-6
        w += np.linalg.solve((x * d[:, None]).T @ x + 1.0 * np.eye(N_FEATURES), x.T @ (y - p) - 1.0 * w)
    # edges as conditional probabilities over the children's shares, so that they add only what the nodes don't say
    share = edges.sum(axis=0) / edges.sum()
    return Model(w, np.log(edges / edges.sum(axis=1, keepdims=True) / share))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars) for pages (page_id, url, html); other columns are not read.

    A null or empty page has an empty text; repeated rows are answered each.
    """
    prepare(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [extract(x.as_py(), model) for x in batch["html"]]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(make, "page_id long, url string, text string, n_chars long")
