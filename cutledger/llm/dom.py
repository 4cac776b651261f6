"""A page as a tree of blocks, with features of every node. One page at a time, no state."""

from __future__ import annotations

import html
import re
from math import log1p

#: Kinds of elements, fixed values. What is in none of them is inline.
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head script style noscript template textarea title iframe select button object canvas audio video datalist".split())
#: Start tags that may stand in a head; any other one, and text, ends it.
IN_HEAD = set("html head base basefont bgsound link meta title noscript noframes script style template".split())
#: Blocks that stand in an unseen element and do not end it when its end tag is missing.
OPTIONS = {"option", "optgroup", "hr"}
#: A start tag ends an open element of these, unless one of the walls lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
_WALLS = {"table", "td", "th", "div", "article", "section", "main", "aside", "nav", "header", "footer", "li", "body", "html", "blockquote", "form"}
GROUPS = [
    {"p", "pre", "blockquote"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "ul", "ol", "dl", "dt", "dd"}, {"table", "tbody", "tr", "td", "th", "caption"},
    {"article", "main"}, {"div", "section"}, {"nav", "menu"}, {"aside"}, {"footer"}, {"header"}, {"form", "fieldset", "legend", "label"}, {"figure", "figcaption"},
]
#: Parts of class, id and role names, and words of a text, that tell what a node is for.
TOKENS = [
    set("article content entry post story main body text page prose blog news single detail".split()),
    set("nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead top topbar footer foot bottom copyright legal sidebar side aside rail widget related recommended more links toc pagination pager tags meta".split()),
    set("ad ads adv advert advertisement advertising banner promo promotion sponsor sponsored sponsors cookie cookies consent notice alert warning popup modal overlay newsletter subscribe subscription signup login register form search share sharing social gdpr".split()),
    set("comment comments commentlist reply replies respond discussion disqus thread feedback reader review reviews".split()),
]
CUES = set("cookie cookies copyright rights reserved subscribe newsletter advertisement sponsored login comment comments reply share menu search privacy terms ©".split())
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_MARK = re.compile(r"data-main\s*=\s*\"?([01])")
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?]")


class Node:
    __slots__ = ("tag", "parent", "children", "text", "names", "mark", "link", "n_tags", "chars", "words", "links", "leaves", "stops", "cues", "before", "place")

    def __init__(self, tag: str, parent: Node | None, names: frozenset = frozenset(), mark: int | None = None):
        self.tag, self.parent, self.names, self.mark = tag, parent, names, mark
        self.children: list[Node] = []
        self.text: list[str] | str | None = None  # of a leaf
        self.link = 0


def _without_end(tags: list[tuple[int, int, bool, str, str]]) -> set[int]:
    """Places of the start tags of unseen elements whose end tag is missing: an outer element ends before it."""
    opened: list[tuple[str, int]] = []
    n, out = dict.fromkeys(BLOCKS | HIDDEN, 0), set()
    for k, (_, _, closing, tag, attrs) in enumerate(tags):
        if tag not in n or tag == "p" or tag == "hr" or tag == "html":
            continue
        if not closing:
            if tag in BLOCKS or not attrs.endswith("/"):
                opened.append((tag, k))
                n[tag] += 1
        elif n[tag]:
            while True:
                other, at = opened.pop()
                n[other] -= 1
                if other == tag:
                    break
                if other in HIDDEN:
                    out.add(at)
    return out | {at for tag, at in opened if tag in HIDDEN}


def parse(page: str) -> Node:
    """The page's block elements as a tree; its leaves are runs of text with no block between.

    Comments, scripts, styles and other unseen elements are dropped, inline elements melt into
    their run, character references are decoded, white space becomes single blanks. Ill-formed
    markup is taken as it comes: unclosed elements end with their parent, a paragraph with the
    next block, a tag or entity cut off by the end of the page is dropped or stays as text. A head
    ends with the first thing that may not stand in it; an unseen element without an end tag ends
    with the next block.
    """
    root = Node("html", None)
    here, at, anchor = root, 0, 0
    # Open blocks from the page down, and the depths at which each kind is open, so that nothing is searched for.
    chain: list[Node] = []
    depths: dict[str, list[int]] = {t: [] for t in BLOCKS}
    hidden: list[tuple[str, bool]] = []  # open unseen elements, and whether their end tag is missing
    unseen = dict.fromkeys(HIDDEN, 0)
    tags = []
    for m in _TAG.finditer(page):
        name = m.group(3) or m.group(6)
        tags.append((m.start(), m.end(), bool(m.group(2) or m.group(5)), name.lower() if name else "", m.group(4) or m.group(7) or ""))
    missing = _without_end(tags)
    run: list[tuple[str, bool]] = []

    def end_run() -> None:
        if not run:
            return
        texts = " ".join(html.unescape("".join(x for x, _ in run)).split())
        if texts:
            leaf = Node("#", here)
            leaf.text = texts
            leaf.link = min(len(texts), sum(len(x) for x, inside in run if inside))
            here.children.append(leaf)
        run.clear()

    def close(depth: int) -> None:
        nonlocal here
        while len(chain) > depth:
            depths[chain.pop().tag].pop()
        here = chain[-1] if chain else root

    def show() -> str:
        tag = hidden.pop()[0]
        unseen[tag] -= 1
        return tag

    def add_text(start: int, end: int) -> None:
        if len(hidden) == 1 and hidden[0][0] == "head" and not page[start:end].isspace():
            show()
        if not hidden:
            run.append((page[start:end], anchor > 0))

    for k, (start, end, closing, tag, attrs) in enumerate(tags):
        if start > at:
            add_text(at, start)
        at = end
        if not tag:
            continue
        if hidden:
            if closing and unseen.get(tag):
                while show() != tag:
                    pass
                continue
            while hidden and hidden[-1][1] and hidden[-1][0] != "head" and tag in BLOCKS and tag not in OPTIONS:
                show()
            if len(hidden) == 1 and hidden[0][0] == "head" and not closing and tag not in IN_HEAD:
                show()
        if tag in HIDDEN:
            if not closing and not attrs.endswith("/"):
                hidden.append((tag, k in missing))
                unseen[tag] += 1
            continue
        if hidden:
            continue
        if tag == "a":
            anchor = 0 if closing else 1
        if tag == "br":
            run.append((" ", False))
        if tag not in BLOCKS:
            continue
        end_run()
        if tag == "hr":
            continue
        if closing:
            if depths[tag]:
                close(depths[tag][-1])
            continue
        anchor = 0
        if tag == "html":
            continue
        ends, walls = ENDS.get(tag, (set(), set()))
        for these, stop in ((ends, walls), ({"p"}, _WALLS)):
            last = max((depths[x][-1] for x in these if depths.get(x)), default=-1)
            if last > max((depths[x][-1] for x in stop if depths.get(x)), default=-1):
                close(last)
        names = frozenset(x.lower() for g in _NAMES.findall(attrs) for x in _SPLIT.split(" ".join(g)) if x) if attrs else frozenset()
        mark = _MARK.search(attrs) if attrs else None
        node = Node(tag, here, names, int(mark.group(1)) if mark else None)
        here.children.append(node)
        depths[tag].append(len(chain))
        chain.append(node)
        here = node
    if at < len(page):
        add_text(at, len(page))
    end_run()
    return root


def walk(root: Node) -> list[Node]:
    """All nodes, each before its children, in page order; sums over subtrees are set on the way."""
    root.place = 0
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        for i, child in enumerate(node.children):
            child.place = i
        stack.extend(reversed(node.children))
    before = 0
    for node in out:
        node.before = before
        if node.text is not None:
            before += len(node.text)
    for node in reversed(out):
        if node.text is not None:
            words = node.text.split(" ")
            node.n_tags, node.chars, node.words, node.links, node.leaves = 0, len(node.text), len(words), node.link, 1
            node.stops, node.cues = len(_PUNCTUATION.findall(node.text)), sum(w.lower().strip(".,:!") in CUES for w in words)
        else:
            c = node.children
            node.n_tags = 1 + sum(x.n_tags for x in c)
            node.chars, node.words, node.links, node.leaves = sum(x.chars for x in c), sum(x.words for x in c), sum(x.links for x in c), sum(x.leaves for x in c)
            node.stops, node.cues = sum(x.stops for x in c), sum(x.cues for x in c)
    return out


FEATURES = 19 + len(GROUPS) * 2 + len(TOKENS) * 2


def features(nodes: list[Node]) -> list[list[float]]:
    """One row per node: density of its subtree, its place, its siblings, its and its ancestors' kinds."""
    total = max(1, nodes[0].chars)
    facts: dict[int, tuple] = {}
    rows = []
    for v in nodes:
        up, depth, kinds_up, names_up = v.parent, 0, [0.0] * len(GROUPS), [0.0] * len(TOKENS)
        own = v if v.text is None else v.parent
        kinds, hits = [float(own.tag in g) for g in GROUPS], [float(len(own.names & t)) for t in TOKENS]
        if up is not None:
            depth, above, above_names, kinds_p, hits_p = facts[id(up)]
            depth += 1
            kinds_up = [max(x, y) for x, y in zip(above, kinds_p, strict=True)]
            names_up = [max(x, y) for x, y in zip(above_names, hits_p, strict=True)]
        if v.text is None:
            facts[id(v)] = (depth, kinds_up, names_up, kinds, hits)
        family = up.children if up is not None else [v]
        i, n = v.place, len(family)
        prev, nxt = (family[i - 1] if i else None), (family[i + 1] if i + 1 < n else None)
        chars = max(1, v.chars)
        rows.append(
            [
                float(v.text is not None), log1p(v.chars), log1p(v.words), v.links / chars, log1p(v.chars / (1 + v.n_tags)), v.stops / max(1, v.words), v.words / max(1, v.leaves),
                log1p(v.leaves), float(depth), v.chars / total, v.before / total, i / n, log1p(n), sum(x.tag == v.tag for x in family[max(0, i - 3) : i + 4]) / len(family[max(0, i - 3) : i + 4]),
                log1p(prev.chars) if prev else -1.0, log1p(nxt.chars) if nxt else -1.0, float(v.cues), v.cues / max(1, v.words), up.links / max(1, up.chars) if up is not None else 0.0,
                *kinds, *kinds_up, *hits, *names_up,
            ]
        )
    return rows


def decode(nodes: list[Node], scores: list[float]) -> list[str]:
    """Texts of the leaves that belong to the main text, in page order.

    `scores` are log odds. A node belongs only if its parent does, and a node is dropped with all
    below it: from below, a node's gain is its own score and what its children gain, if that is
    positive; from above, the first node without a gain closes its branch.
    """
    gain = {}
    for v, s in zip(reversed(nodes), reversed(scores), strict=True):
        gain[id(v)] = max(0.0, s + sum(gain[id(c)] for c in v.children))
    out, stack = [], [nodes[0]]
    while stack:
        v = stack.pop()
        if v.text is not None:
            out.append(v.text)
        stack.extend(c for c in reversed(v.children) if gain[id(c)] > 0)
    return out
