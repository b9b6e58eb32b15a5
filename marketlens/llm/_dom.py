"""Pages as trees of blocks, and their alignment by simple tree matching.

A tree has block elements as nodes and texts as leaves; inline elements belong to the text around them. Runs of like
siblings are folded into one node, so that lists of any length align. Trees are merged into one (a wrapper) by the
matching of their children in order that pairs most nodes; what has no partner is put in behind its last paired sibling.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

#: Elements deeper than this hang from the one at this depth.
DEPTH = 150
#: Tags that could not be read before a page is read on with the plainest pattern.
PATIENCE = 50
#: Open elements among which the end of an inline one looks for its start.
NEAR = 100

_TAG = re.compile(r"""<(?:!--|[!?][^>]*>|(/?)([A-Za-z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>)""")
_PLAIN_TAG = re.compile(r"<(?:!--|[!?][^<>]*>|(/?)([A-Za-z][^\s/<>]*)([^<>]*)>)")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp template noscript svg math object select canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var output progress meter picture map".split())
REPEATED = frozenset("p li tr td th dt dd option blockquote pre".split())
#: What the start of an element closes, and the elements beyond which it closes nothing.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tr td th thead tbody", "table"), "option": ("option", "select")}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
#: Elements that are never part of an article.
ASIDE = frozenset("head nav footer aside form dialog menu button fieldset header".split())
#: Words in classes, ids and roles of what is around an article.
CUES = frozenset(
    """ad ads advert adverts advertisement advertising adsense adslot adbox banner banners promo promotion sponsor sponsored nav navbar navigation menu menus
    breadcrumb breadcrumbs footer masthead sidebar sidebars complementary contentinfo cookie cookies consent gdpr notice notices notification popup modal overlay
    newsletter subscribe signup login search share sharing social related recommended pagination pager widget widgets toolbar skip copyright disclaimer form paywall
    comment comments commentlist disqus respond reply replies discussion reactions alert dialog""".split()
)
#: Cues that hold even around an article, as each of a page's comments may be one.
TALK = frozenset("comment comments commentlist disqus respond reply replies discussion reactions".split())


class Node:
    """A block element, or a text (tag ``#``) with the numbers of the texts that it stands for."""

    __slots__ = ("tag", "sig", "kids", "leaves", "shape")

    def __init__(self, tag: str, sig: str = "", kids: list[Node] | None = None, leaves: list[int] | None = None):
        self.tag, self.sig, self.kids, self.leaves, self.shape = tag, sig, kids if kids is not None else [], leaves if leaves is not None else [], 0


class _Open:
    __slots__ = ("tag", "node", "aside", "cue", "talk", "article", "main", "depth", "number")

    def __init__(self, tag: str, node: Node, aside: bool, cue: tuple, article: int, main: int, depth: int, number: int, talk: bool = False):
        self.tag, self.node, self.aside, self.cue, self.article, self.main, self.depth, self.number, self.talk = tag, node, aside, cue, article, main, depth, number, talk


class Page:
    """The tree of a page and its texts in order: which of them may be the article's, and which lie in one."""

    def __init__(self, html: str):
        self.root = Node("#root")
        self.texts: list[str] = []
        self._where: list[tuple[tuple, int, int]] = []  # cue elements around, article, main
        self._exempt: set[int] = set()
        self._headed: set[int] = set()
        self._read(html)
        fold(self.root)
        self.allowed, self.main = self._judge()

    def _judge(self) -> tuple[list[bool], list[bool]]:
        free = [all(c in self._exempt for c in cues) for cues, *_ in self._where]
        of = [(article if ok else 0, main if ok else 0) for ok, (_, article, main) in zip(free, self._where, strict=True)]
        articles = {a for a, _ in of if a}
        if articles & self._headed:
            articles &= self._headed
        inside = [a in articles for a, _ in of] if articles else [m > 0 for _, m in of]
        if any(inside):
            return inside, inside
        return free, [False] * len(free)

    def _read(self, html: str) -> None:
        stack = [_Open("#root", self.root, False, (), 0, 0, 0, 0)]
        count: Counter = Counter()
        buffer: list[str] = []
        pattern, failures, at, end, number = _TAG, 0, 0, html.rfind(">") + 1, 0
        low = None
        find = html.find

        def say(text: str) -> None:
            if text:
                buffer.append(unescape(text) if "&" in text else text)

        def flush() -> None:
            if buffer:
                text = " ".join("".join(buffer).split())
                buffer.clear()
                top = stack[-1]
                if text and not top.aside:
                    top.node.kids.append(Node("#", leaves=[len(self.texts)]))
                    self.texts.append(text)
                    self._where.append((top.cue, top.article, top.main))

        def pop() -> None:
            top = stack.pop()
            count[top.tag] -= 1

        while at < len(html):
            lt = find("<", at)
            if lt < 0 or lt >= end:
                break
            m = pattern.match(html, lt)
            if m is None:
                if html[lt + 1 : lt + 2].isalpha() or html[lt + 1 : lt + 2] == "/":
                    failures += 1
                    if failures > PATIENCE:
                        pattern = _PLAIN_TAG
                say(html[at : lt + 1])
                at = lt + 1
                continue
            say(html[at:lt])
            at = m.end()
            tag = m.group(2)
            if tag is None:
                if m.group(0) == "<!--":
                    close = find("-->", at - 2)
                    at = close + 3 if close >= 0 else (find(">", at) + 1 or len(html))
                continue
            tag = tag.lower()
            if m.group(1):
                if tag in INLINE:
                    for k in range(len(stack) - 1, max(0, len(stack) - NEAR), -1) if count[tag] > 0 else ():
                        if stack[k].tag == tag:
                            if stack[k].aside != stack[k - 1].aside or stack[k].cue != stack[k - 1].cue:
                                flush()
                            while len(stack) > k:
                                pop()
                            break
                        if stack[k].tag not in INLINE:
                            break
                    continue
                if tag == "br":
                    buffer.append(" ")
                    continue
                flush()
                if count[tag] > 0:
                    while stack[-1].tag != tag:
                        pop()
                    pop()
                continue
            attributes = m.group(3)
            if tag in VOID:
                if tag == "br":
                    buffer.append(" ")
                elif tag == "hr":
                    flush()
                continue
            if tag in RAW:
                if attributes.endswith("/") and tag in ("svg", "math"):
                    continue
                if low is None:
                    low = html.lower()
                    if len(low) != len(html):  # letters whose small form is longer
                        low = re.sub("[A-Z]+", lambda x: x[0].lower(), html)
                close = low.find("</" + tag, at)
                if close < 0:
                    if tag in ("script", "style", "textarea", "title", "iframe", "xmp"):
                        at = len(html)
                        end = 0
                    continue
                at = (find(">", close) + 1) or len(html)
                continue
            # Only these attributes matter.
            values: dict[str, str] = {}
            if attributes and not attributes.isspace():
                for name, a, b, c in _ATTRIBUTE.findall(attributes):
                    name = name.lower()
                    if name in ("class", "id", "role", "hidden", "style", "itemprop", "aria-hidden"):
                        values.setdefault(name, a or b or c)
            inline = tag in INLINE
            if inline and not values:
                top = stack[-1]
                count[tag] += 1
                stack.append(_Open(tag, top.node, top.aside, top.cue, top.article, top.main, top.depth, 0))
                continue
            if not inline:
                flush()
                if count["p"] > 0:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag == "p":
                            while len(stack) > k:
                                pop()
                            break
                        if stack[k].tag not in INLINE:
                            break
                if tag in _CLOSES:
                    closes, bound = _CLOSES[tag]
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag in closes:
                            while len(stack) > k:
                                pop()
                        elif stack[k].tag in bound or stack[k].tag not in INLINE:
                            break
            top = stack[-1]
            number += 1
            names = f"{values.get('class', '')} {values.get('id', '')} {values.get('role', '')}" if values else ""
            cues = CUES.intersection(w.lower() for w in _WORD.findall(names)) if names else ()
            aside, cue, article, main = top.aside, top.cue, top.article, top.main
            if tag == "header" and article:
                # Of an article's own header its headings stay.
                cue = (*cue, -number)
            elif tag in ASIDE:
                aside = True
            elif "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", ""):
                aside = True
            elif cues and tag not in ("html", "body", "main"):
                cue = (*cue, number)
            if tag in ("h1", "h2", "h3"):
                cue = tuple(c for c in cue if c > 0)
            whole = tag == "main" or "main" in values.get("role", "").split() or "articleBody" in values.get("itemprop", "").split()
            if not aside and (whole or tag == "h1" or (tag == "article" and not cues)):
                # What holds the article is not beside it, whatever it is called.
                for o in stack[1:]:
                    if o.number and o.number in o.cue and not o.talk:
                        self._exempt.add(o.number)
                if tag == "h1" and article:
                    self._headed.add(article)
            if tag == "article" and not article and not aside and not cues:
                article = number
            if whole and not main and not aside:
                main = number
            if inline:
                if aside != top.aside or cue != top.cue:
                    flush()
                new = _Open(tag, top.node, aside, cue, article, main, top.depth, number)
            else:
                sig = re.sub(r"\d+", "0", names).strip() if names else ""
                node = Node(tag, sig)
                if top.depth < DEPTH:
                    top.node.kids.append(node)
                else:
                    node = top.node
                new = _Open(tag, node, aside, cue, article, main, top.depth + 1, number)
            new.talk = not TALK.isdisjoint(cues)
            count[tag] += 1
            stack.append(new)
        if at < len(html) and end >= 0:
            say(html[at:])
        flush()


def fold(node: Node) -> None:
    """Merge runs of like children: always those that repeat by nature, others if three or more have one shape."""
    for k in node.kids:
        if k.tag != "#":
            fold(k)
        k.shape = shape(k)
    out: list[Node] = []
    kids, i = [k for k in node.kids if k.tag == "#" or k.kids], 0
    while i < len(kids):
        a, j = kids[i], i + 1
        if a.tag in REPEATED:
            while j < len(kids) and kids[j].tag == a.tag and kids[j].sig == a.sig:
                j += 1
        elif a.tag != "#":
            while j < len(kids) and kids[j].shape == a.shape:
                j += 1
            if j - i < 3:
                j = i + 1
        for b in kids[i + 1 : j]:
            absorb(a, b, _join, _same)
        a.shape = shape(a)
        out.append(a)
        i = j
    node.kids = out
    node.shape = shape(node)


def shape(node: Node) -> int:
    return hash((node.tag, node.sig, *(k.shape for k in node.kids)))


def _join(a: Node, b: Node) -> None:
    a.leaves += b.leaves


def _same(b: Node) -> Node:
    return b


def size(node: Node) -> int:
    todo, n = [node], 0
    while todo:
        x = todo.pop()
        n += 1
        todo += x.kids
    return n


def _score(a: Node, b: Node, known: dict) -> int:
    """How many nodes two trees pair at best, in order; equal attributes count as one more."""
    if a.tag != b.tag:
        return 0
    key = (id(a), id(b))
    out = known.get(key)
    if out is None:
        out = 1 + (a.sig == b.sig)
        if a.kids and b.kids:
            out += _table(a.kids, b.kids, known)[-1][-1]
        known[key] = out
    return out


def _table(xs: list[Node], ys: list[Node], known: dict) -> list[list[int]]:
    rows = [[0] * (len(ys) + 1)]
    for x in xs:
        last, row = rows[-1], [0]
        for j, y in enumerate(ys):
            best = last[j + 1] if last[j + 1] >= row[j] else row[j]
            if x.tag == y.tag:
                pair = last[j] + _score(x, y, known)
                if pair > best:
                    best = pair
            row.append(best)
        rows.append(row)
    return rows


def absorb(a: Node, b: Node, pair, fresh, known: dict | None = None) -> None:
    """Merge ``b`` into ``a``: ``pair(x, y)`` for texts that are aligned, ``fresh(y)`` gives what is put in for others."""
    if a.tag == "#":
        pair(a, b)
        return
    known = {} if known is None else known
    xs, ys = a.kids, b.kids
    if len(xs) == len(ys) and all(x.shape == y.shape and x.shape for x, y in zip(xs, ys, strict=True)):
        for x, y in zip(xs, ys, strict=True):
            absorb(x, y, pair, fresh, known)
        return
    rows, i, j, matched = _table(xs, ys, known), len(xs), len(ys), []
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            matched.append((i, j))
    of = {j: i for i, j in matched}
    for i, j in matched:
        absorb(xs[i], ys[j], pair, fresh, known)
    out, at = [], 0
    for j, y in enumerate(ys):
        if j in of:
            out += xs[at : of[j] + 1]
            at = of[j] + 1
        else:
            out.append(fresh(y))
    a.kids = out + xs[at:]
    a.shape = shape(a)


def slots(tree: Node) -> int:
    """How many texts a wrapper has places for."""
    todo, n = [tree], 0
    while todo:
        x = todo.pop()
        n = max(n, max(x.leaves, default=-1) + 1)
        todo += x.kids
    return n


def merge(wrapper: Node, tree: Node, new_slot) -> dict[int, int]:
    """Merge a tree into a wrapper; the place in the wrapper of each of the tree's texts. ``new_slot`` numbers new places."""
    place: dict[int, int] = {}

    def pair(x: Node, y: Node) -> None:
        for n in y.leaves:
            place[n] = x.leaves[0]

    def fresh(y: Node) -> Node:
        out = Node(y.tag, y.sig)
        if y.tag == "#":
            out.leaves = [new_slot()]
            pair(out, y)
        out.kids = [fresh(k) for k in y.kids]
        out.shape = shape(out)
        return out

    absorb(wrapper, tree, pair, fresh)
    return place


def order(tree: Node) -> list[int]:
    """The numbers of a tree's texts, node by node."""
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        out += x.leaves
        todo += x.kids
    return out


def dump(node: Node) -> list:
    return [node.tag, node.sig, node.leaves, [dump(k) for k in node.kids]]


def load(data: list) -> Node:
    out = Node(data[0], data[1], [load(k) for k in data[3]], data[2])
    out.shape = shape(out)
    return out
