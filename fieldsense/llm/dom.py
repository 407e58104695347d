"""Block tree of an HTML page and the features of its nodes.

The reader is forgiving: unclosed and stray tags, cut-off pages and broken
attributes give a tree as browsers do. Inline elements do not make nodes; text
that stands directly beside blocks or a rule gets a node of its own. Scripts, styles,
comments, form controls and the title never enter the tree. Only raw text
(``RAW``) without its end tag runs to the end of the page; any other skipped
element whose end tag does not come before its parent's end stops at the first
block tag, and a head stops where its tags and the title do.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_left

import numpy as np

OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
STOP = re.compile("[>\"']")
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# fixed values: element names by their part in HTML
RAW = frozenset("script style textarea title".split())
SKIPPED = frozenset("noscript template svg iframe object canvas audio video select button datalist annotation "
                    "annotation-xml".split())            # annotations: source of a formula, not its text
UNNESTED = frozenset("button select noscript iframe".split())        # a second start ends the first
# inline tags that end an open svg, as block tags do
NOT_SVG = frozenset("b big br code em embed i img nobr ruby s small span strike strong sub sup tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("html body article main section header footer nav aside div p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl "
                   "dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset "
                   "legend address details summary dialog menu center hr search".split())
# a block start that ends an open element of the named kinds, up to the nearest of the limits
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"})}

KINDS = ("#text", "p", "div", "section", "article", "main", "h", "list", "li", "nav", "header", "footer", "aside",
         "form", "table", "quote", "other")
_KIND = {"#text": 0, "p": 1, "div": 2, "section": 3, "article": 4, "main": 5, "ul": 7, "ol": 7, "dl": 7, "menu": 7,
         "li": 8, "dt": 8, "dd": 8, "nav": 9, "header": 10, "hgroup": 10, "footer": 11, "aside": 12, "form": 13,
         "fieldset": 13, "search": 13, "table": 14, "thead": 14, "tbody": 14, "tfoot": 14, "tr": 14, "td": 14,
         "th": 14, "blockquote": 15, "pre": 15, "figure": 15, "figcaption": 15} | {f"h{i}": 6 for i in range(1, 7)}
BUCKETS = 1 << 20                  # attribute words are known by a hash modulo this


def bucket(word: str) -> int:
    """The number of a word of a class, id or role attribute."""
    return zlib.crc32(word.lower().encode()) % BUCKETS


class Node:
    __slots__ = ("tag", "parent", "children", "text", "link", "words", "at", "label", "depth")

    def __init__(self, tag, parent, at, words=(), label=False):
        self.tag, self.parent, self.at, self.words, self.label = tag, parent, at, words, label
        self.depth = parent.depth + 1 if parent else 0
        self.children: list = []        # nodes and, while reading, pieces of text and None for a rule
        self.text, self.link = "", 0


def attributes(raw: str) -> tuple[tuple[int, ...], bool, bool]:
    """Buckets of the attribute words, whether the element is hidden, and the
    training mark."""
    words, hidden, label = [], False, False
    for name, a, b, c in ATTR.findall(raw):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            words += [bucket(w) for w in TOKEN.findall(value)]
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
        elif name == "data-main":
            label = True
    return tuple(dict.fromkeys(words)), hidden, label


class Tags:
    """The tags of a page, each looked up from any place on, in time linear in
    the page however it is cut off or quoted.

    A tag ends at the first ``>`` outside quotes, or if there is none, at the
    first ``>`` at all; without that either, ``<`` is text. What a search that
    failed went through is remembered, so no later search goes through it again.
    """

    def __init__(self, page: str):
        self.page = page
        self.last_end = page.rfind(">")
        self.bare = len(page)                        # nothing ends or opens quotes from here on
        self.unclosed = {'"': len(page), "'": len(page)}     # no such quote from here on
        self.dead: set[int] = set()                  # quotes no end was found behind

    def _end(self, pos: int) -> int:
        """The first ``>`` outside quotes, or -1."""
        page, passed = self.page, []
        while pos < self.bare:
            m = STOP.search(page, pos)
            if m is None:
                self.bare = pos
                break
            at = m.start()
            if page[at] == ">":
                return at
            if at in self.dead:
                break
            passed.append(at)
            quote = page[at]
            close = page.find(quote, at + 1) if at + 1 < self.unclosed[quote] else -1
            if close < 0:
                self.unclosed[quote] = min(self.unclosed[quote], at + 1)
                break
            pos = close + 1
        self.dead.update(passed)
        return -1

    def find(self, pos: int):
        """``(start, end, name or None, closing, attributes)`` of the first tag or
        comment at or after ``pos``, or None."""
        page = self.page
        while True:
            # without a ``>`` ahead only a comment can follow
            start = page.find("<", pos) if pos <= self.last_end else page.find("<!--", pos)
            if start < 0:
                return None
            m = OPEN.match(page, start)
            if m is None:
                pos = start + 1
                continue
            if m[1]:
                end = page.find("-->", start + 4)
                return start, (end + 3 if end >= 0 else len(page)), None, False, ""
            end = -1 if m[2] else self._end(m.end())
            if end < 0:
                end = page.find(">", m.end())
                if end < 0:
                    pos = start + 1
                    continue
            if m[2]:
                return start, end + 1, None, False, ""
            return start, end + 1, m[4].lower(), bool(m[3]), page[m.end():end]


def raw_end(page: str, pos: int, tag: str, or_tag: str = "") -> int:
    """Where the raw text that starts at ``pos`` ends, its end tag included."""
    names = f"({tag})|{or_tag}" if or_tag else f"({tag})"
    end = re.compile(rf"</(?:{names})(?=[\s/>])", re.I).search(page, pos)
    if end is None:
        return len(page)
    if end[1] is None:
        return end.start()
    return page.find(">", end.end()) + 1 or len(page)


def skipped_ends(tags: Tags) -> dict[int, int]:
    """End of every skipped element by the end of its start tag: after its end
    tag, or at the first block tag if there is none before its parent's end."""
    page = tags.page
    stack: list[tuple[str, int]] = []
    n_open: dict[str, int] = {}
    ends: dict[int, int] = {}
    unclosed: list[tuple[str, int]] = []
    blocks, not_svg, pos = [], [], 0

    def leave(entry: tuple[str, int]) -> None:
        n_open[entry[0]] -= 1
        if entry[0] in SKIPPED and entry[1] not in ends:
            unclosed.append(entry)

    while (found := tags.find(pos)) is not None:
        start, pos, tag, closing, raw = found
        if tag is None:
            continue
        if tag in RAW:
            if not closing and not raw.endswith("/"):
                pos = raw_end(page, pos, tag, "svg" if n_open.get("svg") else "")
            continue
        if tag in BLOCKS:
            blocks.append(start)
        elif tag in NOT_SVG:
            not_svg.append(start)
        if tag not in BLOCKS and tag not in SKIPPED or tag == "hr":
            continue
        if closing:
            if n_open.get(tag):
                while stack[-1][0] != tag:
                    leave(stack.pop())
                if tag in SKIPPED:
                    ends[stack[-1][1]] = pos
                leave(stack.pop())
        elif tag in BLOCKS or not raw.endswith("/"):
            if tag in UNNESTED and n_open.get(tag):
                i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                leave(stack.pop(i))
            stack.append((tag, pos))
            n_open[tag] = n_open.get(tag, 0) + 1
    while stack:
        leave(stack.pop())
    if unclosed:
        spans = list(ends.items())
        # block tags inside elements that have their end tag end nothing
        free: list[list[int]] = [[], []]
        for out, starts in zip(free, (blocks, sorted(blocks + not_svg))):
            closed, i, hi = sorted(spans), 0, 0
            for at in starts:
                while i < len(closed) and closed[i][0] <= at:
                    hi, i = max(hi, closed[i][1]), i + 1
                if at >= hi:
                    out.append(at)
        for tag, at in unclosed:
            starts = free[tag == "svg"]
            i = bisect_left(starts, at)
            ends[at] = starts[i] if i < len(starts) else len(page)
    return ends


def read(page: str) -> list[Node]:
    """Nodes of the page in document order, leaves with their text."""
    tags, root = Tags(page), Node("html", None, 0)
    here, pos, in_link, hidden, bodies = root, 0, 0, 0, 0
    n_open: dict[str, int] = {}          # elements of a name from the root to here

    def put(piece: str) -> None:
        if piece and not hidden:
            here.children.append((piece, in_link > 0))

    def leave(to: Node) -> None:
        """Go up to ``to``."""
        nonlocal here, hidden, hidden_node
        while here is not to:
            n_open[here.tag] -= 1
            if here is hidden_node:
                hidden, hidden_node = 0, None
            here = here.parent

    hidden_node = ends = None
    while (found := tags.find(pos)) is not None:
        put(page[pos:found[0]])
        start, pos, tag, closing, raw = found
        if tag is None:
            continue                             # comment, doctype
        if tag in RAW or tag in SKIPPED:
            if not closing and not raw.endswith("/"):
                if tag in RAW:
                    pos = raw_end(page, pos, tag)
                else:
                    if ends is None:
                        ends = skipped_ends(tags)
                    pos = ends.get(pos, pos)
            continue
        if tag in VOID and tag != "hr":
            if tag != "wbr":
                put(" ")
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag not in BLOCKS:
            continue
        if closing:
            if n_open.get(tag):
                n = here
                while n.tag != tag:
                    n = n.parent
                leave(n.parent)
            continue
        if tag == "html" or tag == "body" and bodies:
            continue
        bodies += tag == "body"
        # what this start ends
        kinds, limits = ENDS.get(tag, ((), ()))
        n = here
        while n is not root:
            if n.tag == "p" and here is n or n.tag in kinds:
                leave(n.parent)
            elif n.tag in limits or n.tag not in ("p", *kinds):
                break
            n = n.parent
        if tag == "hr":
            here.children.append(None)           # ends the run of text, makes no node
            continue
        words, hides, label = attributes(raw)
        new = Node(tag, here, start, words, label)
        here.children.append(new)
        here, n_open[tag] = new, n_open.get(tag, 0) + 1
        if hides and hidden_node is None:
            hidden, hidden_node = 1, new
    put(page[pos:])
    return settle(root)


def settle(root: Node) -> list[Node]:
    """Give every leaf its text; text beside blocks becomes a leaf of its own.
    Nodes without text below them go."""
    order: list[Node] = []
    stack = [root]
    while stack:
        n = stack.pop()
        order.append(n)
        runs: list = []
        kids: list[Node] = []

        def close(node=n):
            if runs:
                text = " ".join(html.unescape("".join(t for t, _ in runs)).split())
                if text:
                    leaf = Node("#text", node, node.at)
                    leaf.text, leaf.link = text, sum(len(t.strip()) for t, a in runs if a)
                    kids.append(leaf)
                runs.clear()

        for c in n.children:
            if c is None:
                close()
            elif isinstance(c, Node):
                close()
                kids.append(c)
            else:
                runs.append(c)
        close()
        if len(kids) == 1 and kids[0].tag == "#text":
            n.text, n.link, kids = kids[0].text, kids[0].link, []
        n.children = kids
        stack += reversed(kids)
    full = set()
    for n in reversed(order):
        if n.text or any(id(c) in full for c in n.children):
            full.add(id(n))
    out = [n for n in order if id(n) in full]
    for n in out:
        n.children = [c for c in n.children if id(c) in full]
    return out


NUMBERS = ("depth", "n_siblings", "place", "page_place", "len", "words", "link_share", "page_share", "parent_share",
           "children", "leaf_mean", "stops", "longest_leaf", "same_tag", "sibling_mean", "to_sibling_mean",
           "parent_kind", "link_children", "link_siblings", "before_kind", "after_kind", "before_link_share", "headed",
           "headed_above", "sibling_place_from_end")
FEATURES = NUMBERS + tuple([f"kind_{k}" for k in KINDS] + [f"above_kind_{k}" for k in KINDS])


def features(nodes: list[Node], known: dict[int, int]) -> np.ndarray:
    """One row of numbers per node: density of its subtree, place, siblings, and
    for each of the ``known`` attribute words (bucket: place from 0) whether the node
    has it and whether one of its ancestors has."""
    n, width = len(nodes), len(known)
    if not n:
        return np.zeros((0, len(FEATURES) + 2 * width), dtype=np.float32)
    index = {id(x): i for i, x in enumerate(nodes)}
    size, words, link, leaves, stops, longest = ([0] * n for _ in range(6))
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        if t := x.text:
            size[i] = longest[i] = len(t)
            words[i], link[i], leaves[i] = t.count(" ") + 1, min(x.link, len(t)), 1
            stops[i] = t.count(".") + t.count(",") + t.count("!") + t.count("?")
        if x.parent is not None and (p := index.get(id(x.parent))) is not None:
            for v in (size, words, link, leaves, stops):
                v[p] += v[i]
            longest[p] = max(longest[p], longest[i])
    total, end = max(1, size[0]), max(1, nodes[-1].at)
    last = len(KINDS) - 1
    kind = [_KIND.get(x.tag, last) for x in nodes]
    own = [sum(1 << known[w] for w in x.words if w in known) for x in nodes]
    above, above_kind = [0] * n, [0] * n
    beside = [(1, 0.0, 1.0, 1, 0.0, 0, 0.0, 0, 0, -1, -1, 0.0)] * n      # what a node has from its parent and siblings
    headed = [0] * n                     # whether a node stands right behind a heading
    heading = _KIND["h1"]
    rows = []
    for i, x in enumerate(nodes):
        kids = [index[id(c)] for c in x.children]
        s, linked = max(1, size[i]), 0.0
        if kids:
            mean = sum(size[k] for k in kids) / len(kids)
            tags: dict[str, int] = {}
            for k in kids:
                tags[nodes[k].tag] = tags.get(nodes[k].tag, 0) + 1
                linked += link[k] * 2 > max(1, size[k])
            linked /= len(kids)
            for place, k in enumerate(kids):
                left, right = kids[place - 1] if place else -1, kids[place + 1] if place + 1 < len(kids) else -1
                headed[k] = int(left >= 0 and kind[left] == heading)
                beside[k] = (len(kids), place / max(1, len(kids) - 1), size[k] / s, tags[nodes[k].tag], mean, kind[i],
                             linked, headed[k], max(headed[i], beside[i][8]), kind[left] if left >= 0 else -1,
                             kind[right] if right >= 0 else -1,
                             link[left] / max(1, size[left]) if left >= 0 else 0.0)
                above[k] = above[i] | own[i]
                above_kind[k] = above_kind[i] | 1 << kind[i]
        sib, place, share, same, mean, parent_kind, link_sib, behind, above_behind, before, after, before_link = beside[i]
        rows.append((x.depth, sib, place, x.at / end, size[i], words[i], link[i] / s, size[i] / total, share, len(kids),
                     size[i] / max(1, leaves[i]), stops[i] / max(1, words[i]), longest[i], same, mean,
                     (1 + size[i]) / (1 + mean), parent_kind, linked, link_sib, before, after, before_link, behind,
                     above_behind, round((sib - 1) * (1 - place))))

    def bits(masks, width):
        size = -(-width // 8)
        cells = np.frombuffer(b"".join(m.to_bytes(size, "little") for m in masks), dtype=np.uint8).reshape(n, size)
        return np.unpackbits(cells, axis=1, count=width, bitorder="little")

    return np.hstack([np.array(rows, dtype=np.float32), np.eye(len(KINDS), dtype=np.float32)[kind],
                      bits(above_kind, len(KINDS)), bits(own, width), bits(above, width)]).astype(np.float32)
