"""Main text of web pages by wrappers that are inferred for each host.

A wrapper is a regular expression without unions over a host's token streams:
tags in nesting order, text slots, optional groups and repeated groups. It
starts as the tokens of one page and is aligned with one page after another:

* texts that differ become a slot, which keeps the digests of those texts that
  it has had on every page, as the root does for the whole page; a slot that
  never differed is a constant;
* tags on one side only become optional;
* neighbours of one kind, and runs of up to MAX_PERIOD kinds that repeat,
  become a repeated group.

Wrappers align with each other in the same way, so each task folds the pages
that it reads and the results are folded by host in two rounds: no task holds
a host's pages, only one wrapper, and pages stay where they are. An element
with more kinds of children than MAX_CHILDREN is left open: the wrapper then
keeps only the digests of the texts that it has had on every page, so what is
known to be the same everywhere doesn't depend on how many children there are.

Every text of a page takes the verdict of the slot that it aligns with, inside
article (or main) elements and on pages without one alike. Tags and roles of
menus, notices, forms and the like decide at once. What the host's pages tell
goes next: a text that is the same on all of them is the template's, however
its elements are called, and so is a list or line of links. Names of classes
are hints only: what they speak against goes if something else is left to be
the article.
"""

from __future__ import annotations

import html as entities
import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestar.llm.common import HOT_KEYS, attach, materialize

#: Depth below which elements are siblings that keep what their parents were, kinds in a repeated run, children beyond which a node is left open.
MAX_DEPTH, MAX_PERIOD, MAX_CHILDREN = 150, 4, 256
#: Pages that must have a text for it to be the template's: outside articles, and inside.
PAGES_OUTSIDE, PAGES_INSIDE = 2, 4
#: Share of characters in links, and mean characters of an item, of a list in an article that is a menu.
MENU_SHARE, MENU_ITEM = 0.8, 40
#: Table cells compared at most when children are aligned; beyond, kinds that both sides have once are anchors.
CELLS = 1 << 12
#: Hosts whose wrappers a task holds at once, and parts of a host in the first round.
HELD, PARTS = 1000, 16
#: Bytes of all wrappers up to which they are broadcast; beyond, pages are joined by host.
BROADCAST_BYTES = 16 << 20

#: Fixed values of the markup language and of common page templates.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul video audio object".split()
)
CLOSES_P = BLOCK - frozenset("button option optgroup select svg template noscript canvas object video audio body head html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNSEEN = frozenset("head script style noscript template iframe svg canvas object video audio select textarea title button noembed noframes xmp dialog".split())
OUTSIDE = frozenset("nav footer aside form menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
PARTS_OF_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation "
    "newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended recommendations related respond share sharing sidebar signup sitemap social "
    "sponsor sponsored subscribe subscription toolbar topbar widget widgets replies discussion".split()
)
PARTS_OF_LAYOUT = frozenset("area block body bottom box col column container content footer global group inner item items left list main outer page panel primary right row secondary section site top wrap wrapper".split()) - PARTS_OF_NAMES
NAMES_OF_ARTICLES = frozenset("ad advert advertisement comment promo promoted related recommended reply sponsored teaser widget".split())
LISTS = frozenset("ul ol dl menu dir".split())
ENDS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)(?![\w-])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

OPTIONAL, REPEATED, VARIES = 1, 2, 4


class Node:
    """An element of a page: children are nodes and texts (text, characters in links)."""

    __slots__ = ("tag", "sign", "children")

    def __init__(self, tag: str, sign: str) -> None:
        self.tag, self.sign, self.children = tag, sign, []


def _sign(tag: str, attributes: str) -> str:
    """What tells elements apart: the tag with class, id, role and whether it shows; digits count alike."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return tag
    found = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    marks = [f".{c}" for c in sorted(set(found.get("class", "").split()))]
    if found.get("id"):
        marks.append(f"#{found['id']}")
    if found.get("role"):
        marks.append(f"@{found['role'].lower()}")
    if found.get("itemprop", "").lower() == "articlebody":
        marks.append("@main")
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        marks.append("@hidden")
    return tag + re.sub(r"\d+", "N", "".join(marks))


@lru_cache(100_000)
def kind(sign: str) -> str:
    """What a sign says of its element: unseen, outside, suspect, header, main or plain.

    Of the parts of a class or id, the first and the last tell what it names,
    but for numbers and words of the layout around them.
    """
    tag, roles = re.split(r"[.#@]", sign)[0], re.findall(r"@(\w+)", sign)
    names = re.findall(r"[.#]([^.#@]+)", sign)
    if tag in UNSEEN or "hidden" in roles:
        return "unseen"
    if tag in ("html", "body"):
        return "plain"
    if tag in ("article", "main"):
        return "outside" if any(n.lower() in NAMES_OF_ARTICLES for n in names) else "main"
    if tag in OUTSIDE or ROLES.intersection(roles):
        return "outside"
    if "main" in roles:
        return "main"
    parts = [[p.lower() for p in _NAME_PARTS.findall(n) if p != "N"] for n in names]  # N stands for digits
    telling = [[k for k, p in enumerate(n) if p not in PARTS_OF_LAYOUT] for n in parts]
    ends = {n[k] for n, at in zip(parts, telling) if at for k in (at[0], at[-1])}
    if ends & PARTS_OF_NAMES:
        return "suspect"
    return "header" if tag == "header" or ends & {"header", "masthead"} else "plain"


def _sunk(parent: Node, sign: str) -> str:
    """The sign of an element that becomes a sibling of its parent, with what that is."""
    what = kind(parent.sign)
    return sign + {"unseen": "@hidden", "outside": "@hidden", "suspect": ".widget", "main": "@main"}.get(what, "")


def parse(html: str) -> Node:
    """The block elements of a page; inline elements are part of the text around them."""
    root = Node("#", "#")
    stack: list[Node] = [root]
    saved: list[tuple[list[str], int] | None] = [None]  # what an inline element that is left out interrupts
    run: list[str] = []
    linked = depth_of_links = 0
    at, size, unescape = 0, len(html), entities.unescape
    places: dict[str, list[int]] = {}  # where in the stack the open elements of a tag are

    def flush() -> None:
        nonlocal run, linked
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                stack[-1].children.append((text, min(linked, len(text))))
            run, linked = [], 0

    def pop_to(depth: int) -> None:
        nonlocal run, linked
        while len(stack) > depth:
            flush()
            places[stack.pop().tag].pop()
            kept = saved.pop()
            if kept is not None:
                run, linked = kept

    def push(node: Node, inline: bool) -> None:
        nonlocal run, linked
        if inline:
            kept: tuple[list[str], int] | None = (run, linked)
            run, linked = [], 0
        else:
            flush()
            kept = None
        if len(stack) > MAX_DEPTH:
            node.sign = _sunk(stack[-1], node.sign)
        stack[min(len(stack), MAX_DEPTH) - 1].children.append(node)
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)
        saved.append(kept)

    def find(tags: tuple[str, ...], stops: tuple[str, ...]) -> int:
        found = 0
        for t in tags:
            if places.get(t) and places[t][-1] > found:
                found = places[t][-1]
        if found:
            for t in stops:
                if places.get(t) and places[t][-1] > found:
                    return 0
        return found

    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            run.append(html[at:])
            break
        if m.start() > at:
            text = html[at : m.start()]
            run.append(text)
            if depth_of_links:
                linked += len(text.strip())
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag == "a":
                depth_of_links = 0
            k = find((tag,), ENDS.get(tag, ()))
            if k:
                pop_to(k)
            elif tag == "p":
                flush()
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag == "a":
            depth_of_links = 1
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            stop = end.start() if end else size
            node = Node(tag, tag)
            if html[at:stop].strip():
                node.children.append((" ".join(html[at:stop].split()), 0))
            if not run:  # within a line of text it is no part of the structure
                stack[-1].children.append(node)
            close = html.find(">", stop)
            at = size if not end or close < 0 else close + 1
            continue
        if tag in BLOCK:
            if tag in CLOSES_P:
                k = find(("p",), ("article", "aside", "body", "button", "div", "footer", "header", "main", "nav", "section", "table", "td", "th"))
                if k:
                    pop_to(k)
            if tag in ENDED_BY:
                k = find(ENDED_BY[tag], ENDS[tag])
                while k:
                    pop_to(k)
                    k = find(ENDED_BY[tag], ENDS[tag])
            depth_of_links = 0 if tag != "a" else depth_of_links
            push(Node(tag, _sign(tag, attributes)), False)
        elif attributes and "=" in attributes or "hidden" in attributes:
            sign = _sign(tag, attributes)
            if kind(sign) in ("unseen", "outside", "suspect") and not attributes.rstrip().endswith("/"):
                push(Node(tag, sign), True)
    flush()
    pop_to(1)
    flush()
    return root


# A wrapper's element is [sign, mode, pages, children, digests, numbers] and its text ["", mode, pages, digests, characters,
# characters in links, texts, numbers]. digests are those of texts that every page has had there. A repeated run of kinds
# is an element whose sign starts with "(". numbers are those of a page's texts while it is aligned. children is None
# where the wrapper is left open; elements have digests and numbers only there, but for the root, which has the digests of
# all texts that every page has, wherever they stand.


def digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest())


def _leaf(text: tuple[str, int], number: int, mark: int) -> list:
    return ["", 0, 1, {mark}, len(text[0]), text[1], 1, [number]]


def form(root: Node) -> tuple[list, list[str]]:
    """A page as a wrapper of its own, and its texts by number."""
    texts: list[str] = []
    marks: list[int] = []

    def shape(node: Node) -> list:
        children = []
        for child in node.children:
            if isinstance(child, Node):
                children.append(shape(child))
            else:
                marks.append(digest(child[0]))
                children.append(_leaf(child, len(texts), marks[-1]))
                texts.append(child[0])
        return _closed([node.sign, 0, 1, _repeats(children), None, []])

    whole = shape(root)
    whole[4] = set(marks)
    return whole, texts


def _numbers(node: list) -> list[int]:
    """Numbers of the texts in an element."""
    if not node[0]:
        return node[7]
    return node[5] if node[3] is None else [n for c in node[3] for n in _numbers(c)]


def _everywhere(node: list) -> set[int]:
    """Digests of the texts that an element has had on every page."""
    if not node[0]:
        return node[3]
    if node[3] is None:
        return node[4]
    return set().union(*(_everywhere(c) for c in node[3] if c[2] >= node[2] and not c[1] & OPTIONAL))


def _closed(node: list) -> list:
    """The element, left open if it has too many kinds of children."""
    if node[3] is not None and len(node[3]) > MAX_CHILDREN:
        node[4], node[5] = _everywhere(node) if node[4] is None else node[4], _numbers(node)
        node[3] = None
    return node


def _same(a: list, b: list) -> list:
    """Two neighbours of one kind in one page as one that repeats; a is used up."""
    out = merge(a, b, True)
    out[1] |= REPEATED
    out[2] = max(a[2], b[2])
    return out


def _repeats(children: list[list]) -> list[list]:
    """Children with neighbours of one kind, and runs of kinds that repeat, as repeated groups."""
    out: list[list] = []
    for child in children:
        if out and out[-1][0] == child[0]:
            out[-1] = _same(out[-1], child)
        else:
            out.append(child)
    for period in range(2, MAX_PERIOD + 1):
        if 2 * period > len(out):
            break
        k, signs, new = 0, [c[0] for c in out], []
        while k < len(out):
            kinds = signs[k : k + period]
            if kinds != signs[k + period : k + 2 * period] or len(set(kinds)) < 2:
                new.append(out[k])
                k += 1
                continue
            run, k = out[k : k + period], k + period
            while signs[k : k + period] == kinds:
                run = [_same(a, b) for a, b in zip(run, out[k : k + period])]
                k += period
            for element in run:
                element[1] &= ~REPEATED
            new.append(["(" + " ".join(kinds) + ")", REPEATED, 1, run, None, []])
        out = new
    return out


def _pairs(a: list[list], b: list[list]) -> list[tuple[int | None, int | None]]:
    """Positions of two lists of children that align, in order: a longest common subsequence of their kinds.

    Where CELLS don't suffice for the plain table, kinds that both sides have
    once and that are in one order on both (the longest such run) split the
    rest; what has no such kind aligns with the next of its kind.
    """
    x, y = [c[0] for c in a], [c[0] for c in b]
    out: list[tuple[int | None, int | None]] = []
    waiting = [(0, len(x), 0, len(y))]
    while waiting:
        i, m, j, n = waiting.pop()
        tail = []
        while i < m and j < n and x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and x[m - 1] == y[n - 1]:
            m, n = m - 1, n - 1
            tail.append((m, n))
        if (m - i) * (n - j) <= CELLS:
            out += _table(x, y, i, m, j, n) + tail[::-1]
            continue
        once = _anchors(x, y, i, m, j, n) or _following(x, y, i, m, j, n)
        parts, (p, q) = [], (i, j)
        for r, t in [*once, *tail[::-1]]:
            parts += [(p, r, q, t), (r, r + 1, t, t + 1)]
            p, q = r + 1, t + 1
        if not tail:
            parts.append((p, m, q, n))
        if not once:
            out += [(r, None) for r in range(i, m)] + [(None, t) for t in range(j, n)] + tail[::-1]
        else:
            waiting += parts[::-1]
    return out


def _table(x: list[str], y: list[str], i: int, m: int, j: int, n: int) -> list[tuple[int | None, int | None]]:
    """The alignment of x[i:m] and y[j:n] by the table of common subsequences."""
    table = [[0] * (n - j + 1) for _ in range(m - i + 1)]
    for p in range(m - i - 1, -1, -1):
        row, below = table[p], table[p + 1]
        for q in range(n - j - 1, -1, -1):
            row[q] = below[q + 1] + 1 if x[i + p] == y[j + q] else max(below[q], row[q + 1])
    out, p, q = [], 0, 0
    while i + p < m or j + q < n:
        if i + p < m and j + q < n and x[i + p] == y[j + q]:
            out.append((i + p, j + q))
            p, q = p + 1, q + 1
        elif j + q == n or i + p < m and table[p + 1][q] >= table[p][q + 1]:
            out.append((i + p, None))
            p += 1
        else:
            out.append((None, j + q))
            q += 1
    return out


def _anchors(x: list[str], y: list[str], i: int, m: int, j: int, n: int) -> list[tuple[int, int]]:
    """Pairs of kinds that x[i:m] and y[j:n] both have once: the longest run in rising order on both sides."""
    here, there = Counter(x[i:m]), Counter(y[j:n])
    place = {s: t for t, s in enumerate(y[j:n], j) if there[s] == 1}
    ends: list[int] = []
    chain: list[tuple[int, int, int]] = []  # position in x and y, and the link before in the chain
    tops: list[int] = []
    for r in range(i, m):
        if here[x[r]] == 1 and x[r] in place:
            at = bisect_left(ends, place[x[r]])
            chain.append((r, place[x[r]], tops[at - 1] if at else -1))
            ends[at : at + 1], tops[at : at + 1] = [place[x[r]]], [len(chain) - 1]
    out, k = [], tops[-1] if tops else -1
    while k >= 0:
        out.append(chain[k][:2])
        k = chain[k][2]
    return out[::-1]


def _following(x: list[str], y: list[str], i: int, m: int, j: int, n: int) -> list[tuple[int, int]]:
    """Pairs of x[i:m] with the next of the kind in y[j:n], in order."""
    places: dict[str, list[int]] = {}
    for t in range(j, n):
        places.setdefault(y[t], []).append(t)
    out, at = [], j
    for r in range(i, m):
        some = places.get(x[r], [])
        k = bisect_left(some, at)
        if k < len(some):
            out.append((r, some[k]))
            at = some[k] + 1
    return out


def merge(a: list, b: list, within: bool = False) -> list:
    """The wrapper of what either of two wrappers of one kind matches, on two pages or within one; a is used up."""
    mode, pages = a[1] | b[1], a[2] + b[2]
    if not a[0]:
        if within:
            a[3] |= b[3]
        else:
            mode |= VARIES if a[3] != b[3] else 0
            a[3] = a[3] & b[3]
        a[7] += b[7]
        return ["", mode, pages, a[3], a[4] + b[4], a[5] + b[5], a[6] + b[6], a[7]]
    if a[3] is None or b[3] is None:
        x, y = _everywhere(a), _everywhere(b)
        return [a[0], mode | (0 if within or x == y else VARIES), pages, None, x | y if within else x & y, _numbers(a) + _numbers(b)]
    everywhere = a[4] & b[4] if a[4] is not None and b[4] is not None else None
    children: list[list] = []
    for i, j in _pairs(a[3], b[3]):
        if i is not None and j is not None:
            child = merge(a[3][i], b[3][j], within)
        else:
            child = list(a[3][i] if j is None else b[3][j])
            child[1] |= OPTIONAL
        if children and children[-1][0] == child[0]:
            top = max(children[-1][2], child[2])
            children[-1] = merge(children[-1], child)
            children[-1][1] |= REPEATED
            children[-1][2] = top
        else:
            children.append(child)
    return _closed([a[0], mode, pages, children, everywhere, []])


def expression(wrapper: list) -> str:
    """A wrapper as text: ? is optional, + repeats, TEXT a slot, "..." a constant."""
    mark = {0: "", OPTIONAL: "?", REPEATED: "+", OPTIONAL | REPEATED: "*"}[wrapper[1] & ~VARIES]
    if not wrapper[0]:
        return ("TEXT" if wrapper[1] & VARIES or len(wrapper[3]) > 1 else '"..."') + mark
    inside = "ANY" if wrapper[3] is None else " ".join(map(expression, wrapper[3]))
    return f"({inside}){mark}" if wrapper[0][0] == "(" else f"<{wrapper[0]}>[{inside}]{mark}"


def _has_main(node: list) -> bool:
    return bool(node[0]) and (kind(node[0]) == "main" or any(map(_has_main, node[3] or ())))


@dataclass(frozen=True)
class Verdict:
    """What a slot says of its texts: content within main, content without one, and what weakens it."""

    inside: bool
    outside: bool
    heading: bool
    suspect: bool
    pages: int
    same: set[int]


@dataclass(frozen=True)
class _Place:
    """Where a text stands in a page."""

    in_main: bool = False
    gone: bool = False
    in_header: bool = False
    heading: bool = False
    suspect: bool = False
    menu: bool = False


def _links(node: list) -> tuple[int, int, int]:
    """Characters, characters in links, and texts of an element."""
    if not node[0]:
        return node[4], node[5], node[6]
    return tuple(map(sum, zip(*map(_links, node[3] or ())))) or (0, 0, 0)


def _verdicts(node: list, out: dict[int, Verdict], at: _Place, pages: int) -> None:
    """The verdict of each text of a wrapper of so many pages, by the identity of its list; pages = 0 if they don't differ."""
    for child in node[3] or ():
        if child[0].startswith("("):
            _verdicts(child, out, at, pages)
        elif not child[0]:
            out[id(child)] = Verdict(
                at.in_main and (not at.in_header or at.heading) and not at.menu,
                not at.gone and not at.in_header and 2 * child[5] < max(1, child[4]),
                at.heading,
                at.suspect,
                child[2] if pages and 2 * child[2] >= pages else 0,
                child[3],
            )
        else:
            _verdicts(child, out, _place(child, at), pages)


def _place(child: list, at: _Place) -> _Place:
    what, tag = kind(child[0]), re.split(r"[.#@]", child[0])[0]
    main_inside = what in ("outside", "suspect", "header") and _has_main(child)
    gone = what == "unseen" or what == "outside" and not main_inside
    menu = at.menu
    if tag in LISTS and not menu:
        chars, linked, texts = _links(child)
        menu = texts > 1 and linked >= MENU_SHARE * chars and chars <= MENU_ITEM * texts
    return _Place(
        (at.in_main or what == "main") and not gone,
        at.gone or gone,
        at.in_header and what != "main" or what == "header" and not main_inside,
        tag in HEADINGS,
        at.suspect and what != "main" or what == "suspect" and not main_inside,
        menu,
    )


def _has_slot(node: list) -> bool:
    if not node[0] or node[3] is None:
        return bool(node[1] & VARIES)
    return kind(node[0]) not in ("unseen", "outside") and any(map(_has_slot, node[3]))


@lru_cache(256)
def _opened(packed: bytes) -> tuple[list, dict[int, Verdict], int]:
    """A wrapper, its verdicts, and its pages, none if these don't differ."""
    return _judged(pickle.loads(packed))


def _judged(wrapper: list) -> tuple[list, dict[int, Verdict], int]:
    out: dict[int, Verdict] = {}
    pages = wrapper[2] if wrapper[2] >= 2 and _has_slot(wrapper) else 0
    _verdicts(wrapper, out, _Place(), pages)
    return wrapper, out, pages


def _aligned(wrapper: list, page: list, texts: dict[int, list]) -> None:
    """For each number of a page's texts, the text of the wrapper that it aligns with, or the open element that it is in."""
    if not page[0] or wrapper[3] is None:
        texts.update(dict.fromkeys(_numbers(page), wrapper))
    elif page[3] is not None:
        for i, j in _pairs(wrapper[3], page[3]):
            if i is not None and j is not None:
                _aligned(wrapper[3][i], page[3][j], texts)


def main_text(html: str | None, packed: bytes | None = None) -> str:
    """Main text of a page by its host's wrapper; by its own, if there is none."""
    if not html:
        return ""
    root = parse(html)
    page, texts = form(root)
    wrapper, verdicts, pages = _judged(page) if packed is None else _opened(packed)
    known: dict[int, list] = {}
    _aligned(wrapper, page, known)
    alone = [] if len(known) == len(texts) and not any(slot[0] for slot in known.values()) else _plain_verdicts(root)
    main = _has_main_text(root)
    least = PAGES_INSIDE if main else PAGES_OUTSIDE
    picked = []
    for number, text in enumerate(texts):
        slot = known.get(number)
        if slot is not None and not slot[0]:
            verdict = verdicts[id(slot)]
        elif slot is None:
            verdict = alone[number]
        else:
            # In an element that is left open the page's own elements speak, with the texts that every page has there.
            verdict = replace(alone[number], pages=slot[2] if pages and 2 * slot[2] >= pages else 0, same=slot[4])
        if verdict.inside if main else verdict.outside:
            sets = [same for of, same in ((pages, wrapper[4]), (verdict.pages, verdict.same)) if same and of >= least]
            mark = digest(text) if sets else 0
            picked.append((text, verdict.heading, verdict.suspect, any(mark in same for same in sets)))
    # Without suspects and the template's texts; if that leaves nothing but headings, hints give way to what there is.
    for suspects, template in ((0, 0), (0, 1), (1, 0), (1, 1)) if main else ((0, 0), (1, 0)):
        kept = [p for p in picked if p[2] <= suspects and p[3] <= template]
        if any(not p[1] for p in kept):
            break
    else:
        kept = [p for p in picked if not p[2] and not p[3]]
    return "\n".join(p[0] for p in kept)


def _plain_verdicts(root: Node) -> list[Verdict]:
    """Verdicts of a page's texts by their own elements, in order of number."""
    order: list[int] = []

    def plain(node: Node) -> list:
        children = []
        for c in node.children:
            children.append(plain(c) if isinstance(c, Node) else ["", 0, 1, frozenset(), len(c[0]), c[1], 1, []])
            if not isinstance(c, Node):
                order.append(id(children[-1]))
        return [node.sign, 0, 1, children, None, []]

    found: dict[int, Verdict] = {}
    whole = plain(root)
    _verdicts(whole, found, _Place(), 0)
    return [found[k] for k in order]


def _has_main_text(root: Node) -> bool:
    """Whether a page has an article or main element that is not itself left out."""

    def walk(node: Node) -> bool:
        for child in node.children:
            if isinstance(child, Node):
                what = kind(child.sign)
                if what == "main" or what != "unseen" and walk(child):
                    return True
        return False

    return walk(root)


def _bare(wrapper: list) -> list:
    """A wrapper without the numbers of one page's texts."""
    if not wrapper[0]:
        return [*wrapper[:7], []]
    return [*wrapper[:3], None if wrapper[3] is None else [_bare(c) for c in wrapper[3]], wrapper[4], []]


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold sorted rows (host, part, wrapper) into a row (host, part, wrapper) for each host and part."""
    now: tuple[str, int] | None = None
    held: list | None = None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int32()), pa.array([pickle.dumps(held)])], ["host", "part", "wrapper"])

    for batch in batches:
        for host, part, packed in zip(*[c.to_pylist() for c in batch.columns]):
            if (host, part) != now:
                if held is not None:
                    yield out()
                now, held = (host, part), None
            wrapper = pickle.loads(packed)
            held = wrapper if held is None else merge(held, wrapper)
    if held is not None:
        yield out()


def wrappers(pages: DataFrame) -> DataFrame:
    """A row (host, wrapper, pages, bytes) per host of rows (host, html); a null host has none."""
    schema = "host string, part int, wrapper binary"

    def start(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            rows = [(h, blake2b(h.encode() + bytes([w[2] % 251]), digest_size=4).digest()[0] % PARTS, pickle.dumps(w)) for h, w in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary()))], ["host", "part", "wrapper"])

        for batch in batches:
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = _bare(form(parse(text.as_py()))[0])
                held[host] = merge(held[host], page) if host in held else page
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    parts = pages.where("host is not null and html is not null").select("host", "html").mapInArrow(start, schema)
    some = parts.repartition("host", "part").sortWithinPartitions("host", "part", "wrapper").mapInArrow(_fold, schema)
    one = some.withColumn("part", F.lit(0)).repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_fold, schema)
    return one.select("host", "wrapper", F.octet_length("wrapper").alias("bytes"))


def hosted(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Rows (page_id, url, html, host); the host is lower-cased, null if the URL has none."""
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    ).withColumn("host", F.lower(F.try_parse_url(F.col("url"), F.lit("HOST"))))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row (page_id, url, text, n_chars) per page: its main text, and its length in code points.

    Blocks are in page order with one line feed between; white space within a
    block is one space; nothing is cut off. A null or empty page has an empty
    text; a page whose URL has no host is a host of its own. Repeated rows
    each give a row; other columns are ignored. Markup may be broken: elements
    that are left open end where their parents do; below MAX_DEPTH elements
    become siblings, each still of what its parents were.
    """
    rows = hosted(pages, id_col, url_col, html_col)
    counts = rows.where("host is not null and html is not null").groupBy("host").agg(F.count("*").alias("n"))
    known = materialize(wrappers(rows).join(counts, "host"), "wrappers")
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), w.as_py()) for h, w in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    size = known.agg(F.sum("bytes")).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(known.select("host", "wrapper")), "host", "left")
    else:
        joined = attach(rows, known, "host", "n", "left", rows=HOT_KEYS)
    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(run, schema)
