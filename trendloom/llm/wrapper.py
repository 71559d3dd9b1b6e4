"""Main text of web pages: the pages of a host are aligned with each other, and what stays the same is template."""

from __future__ import annotations

import html as entities
import math
import re
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.session import cut

CONSTANT = 0.5  # share of the pages of a host, or of a layout of it, in which a node says the same, from which it is template
CONSTANT_INSIDE = 0.9  # the same for a node inside the article, where pages may be copies
LEAST_PAGES = 3
LEVELS = 2  # levels of containers below the body that make a layout
CONTAINERS = set("div section article main header footer nav aside form table center".split())
CELLS = 250_000  # the table that matches the children of two nodes is held whole up to this size, beyond it computed again in parts

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}
BLOCK = set(
    "html body p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption section article main header footer nav "
    "aside blockquote pre figure figcaption hr address form fieldset legend details summary center dialog menu hgroup".split()
)
# Which open elements a start tag ends, up to the element that holds them.
ENDS = {t: {"p"} for t in BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}}
ENDS |= {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
HOLDS_ANY = {"table", "article", "main", "section", "aside", "nav", "footer", "header", "form", "body", "td", "th", "div", "blockquote"}

# Elements, roles and words of a class or id that mark what is no part of an article.
OTHER_TAGS = set("head script style noscript template nav footer aside button select option textarea input iframe svg canvas object video audio map dialog menu title".split())
OTHER_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OTHER_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar nav navbar navigation menu "
    "breadcrumb breadcrumbs footer cookie cookies consent notice gdpr popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comments comment disqus replies reply search pagination pager toolbar masthead "
    "copyright disclaimer widget".split()
)
OTHER_ARTICLES = set("comment comments reply ad advert sponsored related promo".split())


@dataclass(slots=True)
class Node:
    tag: str
    label: str
    other: bool = False  # no part of an article, by itself or by what it is in
    inside: bool = False  # in an article or main element
    kind: str = ""  # article or main
    words: str = ""  # words of its class or id that speak against it
    around: int = 0  # number of the nearest element with a kind or such words, itself included
    outer: int = 0  # the same for what such an element is in
    children: list[Node] = field(default_factory=list)
    blocks: list[str] = field(default_factory=list)  # texts of the blocks right in this node
    places: list[int] = field(default_factory=list)  # their places among all blocks of the page
    number: int = 0  # place in the page


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)}


def _kind(tag: str, attributes: dict[str, str]) -> str:
    role = attributes.get("role", "").lower()
    return tag if tag in ("article", "main") else role if role in ("article", "main") else ""


def _is_other(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    if tag in OTHER_TAGS or (tag == "header" and not inside) or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    role = attributes.get("role", "").lower()
    return (role in OTHER_ROLES and not (tag == "form" and role == "form")) or bool(re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I))


def _other_words(tag: str, kind: str, attributes: dict[str, str], inside: bool) -> str:
    """What in the class or id of an element, or in its being a form, speaks against it; whether that counts is seen from the whole page."""
    if tag in ("html", "body") or kind == "main":
        return ""
    words = set(re.split(r"[^a-z0-9]+", f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()))
    if kind == "article":
        return " ".join(sorted(words & OTHER_ARTICLES))
    found = words & OTHER_WORDS
    if tag == "form":
        found.add("form")
    if not inside and "header" in words and words.isdisjoint(("article", "post", "entry", "story", "content")):
        found.add("header")
    return " ".join(sorted(found))


TELLING = re.compile("class|id|role|hidden|style", re.I)  # attributes without any of these say nothing about an element


@lru_cache(maxsize=4096)
def _element(tag: str, marks: str, inside: bool) -> tuple[str, str, bool, str]:
    """Label, kind, whether it is no part of an article, and words against it."""
    attributes = _attributes(marks) if marks else {}
    kind, other = _kind(tag, attributes), _is_other(tag, attributes, inside)
    first = attributes.get("class", "").split()
    return f"{tag}.{first[0]}" if first else tag, kind, other, "" if other else _other_words(tag, kind, attributes, inside)


def parsed(page: str) -> tuple[Node, list[Node]]:
    """The tree of a page, and its nodes in page order.

    Text goes to the innermost element that begins a block; inline elements are nodes of their own only for their marks. A block
    is a run of text between borders of block elements: references decoded, white space made one blank, trimmed.
    """
    root = Node("#root", "#root")
    nodes, stack, holders = [root], [root], [root]
    pieces: list[str] = []
    count = 0

    def close() -> None:
        nonlocal count
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            holders[-1].blocks.append(text)
            holders[-1].places.append(count)
            count += 1

    def pop() -> None:
        node = stack.pop()
        if node is holders[-1]:
            close()
            holders.pop()

    at, end = 0, len(page)
    while at < end:
        tag = TOKEN.search(page, at)
        stop = tag.start() if tag else end
        if stop > at:
            pieces.append(entities.unescape(page[at:stop]))
        if not tag:
            break
        at = tag.end()
        if tag[1]:
            name = tag[1].lower()
            if stack[-1].tag == name:
                pop()
            elif any(n.tag == name for n in stack[1:]):
                while stack[-1].tag != name:
                    pop()
                pop()
        elif tag[2]:
            name, marks = tag[2].lower(), tag[3]
            if name == "br":
                pieces.append(" ")
            ends = ENDS.get(name)
            for i in range(len(stack) - 1, 0, -1) if ends else ():
                if stack[i].tag in ends:
                    while len(stack) > i:
                        pop()
                elif stack[i].tag in HOLDS.get(name, HOLDS_ANY):
                    break
            up = stack[-1]
            label, kind, other, words = _element(name, marks if TELLING.search(marks) else "", up.inside)
            if up.other:
                other, words = True, ""
            node = Node(name, label, other, up.inside or kind != "", kind, words, len(nodes) if kind or words else up.around, up.around, number=len(nodes))
            holds = name in BLOCK or words != "" or (other and not up.other)
            if holds:
                close()
            nodes.append(node)
            up.children.append(node)
            if name in RAW:
                closing = RAW[name].search(page, at)
                at = closing.end() if closing else end
            elif name not in VOID and not marks.endswith("/"):
                stack.append(node)
                if holds:
                    holders.append(node)
    while len(stack) > 1:
        pop()
    close()
    return root, nodes


class _Shapes:
    """Subtrees of two pages by shape: label, text if both pages have it, and shapes of the children.

    How many nodes two subtrees have in common, and which, follows from their shapes, so it is found once for each two shapes.
    """

    def __init__(self, *pages: Node):
        self.label: list[str] = []
        self.text: list[int] = []  # 0 for none and for what only one page says
        self.children: list[tuple[int, ...]] = []
        self.size: list[int] = []  # weight of a shape with itself
        self.of: list[dict[int, int]] = []  # by page, shape of each node
        self.weights: dict[tuple[int, int], int] = {}
        self.found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        orders, said = [], []
        for page in pages:
            order, todo = [], [page]
            while todo:
                node = todo.pop()
                order.append(node)
                todo += node.children
            orders.append(order)
            said.append({tuple(n.blocks) for n in order if n.blocks})
        texts = {t: i for i, t in enumerate(set.intersection(*said), 1)}
        known: dict[tuple, int] = {}
        for order in orders:
            shapes: dict[int, int] = {}
            for node in reversed(order):
                children = tuple([shapes[c.number] for c in node.children])
                text = texts.get(tuple(node.blocks), 0) if node.blocks else 0
                key = node.label, text, children
                shape = known.get(key)
                if shape is None:
                    shape = known[key] = len(self.size)
                    self.label.append(node.label)
                    self.text.append(text)
                    self.children.append(children)
                    self.size.append(1 + (text > 0) + sum([self.size[c] for c in children]))
                shapes[node.number] = shape
            self.of.append(shapes)

    def own(self, x: int, y: int) -> int:
        return 1 + (self.text[x] > 0 and self.text[x] == self.text[y])

    def weight(self, x: int, y: int) -> int:
        """Nodes in common, and nodes that say the same; 0 if the labels differ. Of two inner nodes it must have been found before."""
        if x == y:
            return self.size[x]
        if self.label[x] != self.label[y]:
            return 0
        return self.weights[x, y] if self.children[x] and self.children[y] else self.own(x, y)

    def middle(self, x: int, y: int) -> tuple[int, int, int]:
        """Lengths of the equal starts and equal ends of the children, which belong to a best matching, and of the shorter list."""
        left, right = self.children[x], self.children[y]
        n = min(len(left), len(right))
        start = end = 0
        while start < n and left[start] == right[start]:
            start += 1
        while end < n - start and left[-1 - end] == right[-1 - end]:
            end += 1
        return start, end, n

    def find(self, x: int, y: int) -> None:
        """Weights of two shapes and of all inner nodes in them that may meet, children first."""
        todo = [(x, y, False)]
        while todo:
            x, y, ready = todo.pop()
            if x == y or (x, y) in self.weights:
                continue
            start, end, _ = self.middle(x, y)
            left, right = self.children[x], self.children[y]
            left, right = left[start : len(left) - end], right[start : len(right) - end]
            if not ready:
                todo.append((x, y, True))
                inner: dict[str, list[int]] = {}
                for d in set(right):
                    if self.children[d]:
                        inner.setdefault(self.label[d], []).append(d)
                todo += [(c, d, False) for c in set(left) if self.children[c] for d in inner.get(self.label[c], ()) if c != d]
                continue
            ends = sum([self.size[c] for c in self.children[x][:start]]) + sum([self.size[c] for c in self.children[x][len(self.children[x]) - end :]])
            total, chosen = self.best(left, right)
            self.weights[x, y] = self.own(x, y) + ends + total
            self.found[x, y] = chosen

    def pairs(self, x: int, y: int) -> list[tuple[int, int]]:
        """Places of the children of two shapes that are matched."""
        n, m = len(self.children[x]), len(self.children[y])
        if x == y:
            return [(i, i) for i in range(n)]
        if not n or not m:
            return []
        start, end, _ = self.middle(x, y)
        return [(i, i) for i in range(start)] + [(start + i, start + j) for i, j in self.found[x, y]] + [(n - i, m - i) for i in range(1, end + 1)]

    def best(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, list[tuple[int, int]]]:
        """Largest weight of matching two lists in order, and the places matched.

        Only every ``step``-th row of the table is kept; the rows between are computed again on the way back.
        """
        if not left or not right:
            return 0, []
        if len(left) * len(right) <= CELLS:
            step, row = len(left), self._row
            first = [0] * (len(right) + 1)
        else:
            step, row = math.isqrt(len(left)) + 1, self._long_row
            first = np.zeros(len(right) + 1, np.int64)
        held: dict[int, list[int]] = {}
        kept, above = [first], first
        for i, x in enumerate(left, 1):
            above = row(above, x, right, held)
            if i % step == 0 or step == len(left):
                kept.append(above)
        total = int(above[-1])
        rows, low = (kept, 0) if step == len(left) else ([], len(left) + 1)
        chosen, i, j = [], len(left), len(right)
        while i and j:
            if i - 1 < low:
                low = (i - 1) // step * step
                rows = [kept[low // step]]
                for x in left[low:i]:
                    rows.append(row(rows[-1], x, right, held))
            here, above = rows[i - low], rows[i - 1 - low]
            if here[j] == above[j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                chosen.append((i, j))
        return total, chosen

    def _row(self, above: list[int], x: int, right: tuple[int, ...], held: dict) -> list[int]:
        weights = held.get(x)
        if weights is None:
            weights = held[x] = [self.weight(x, y) for y in right]
        row, last = [0], 0
        for j, w in enumerate(weights):
            if above[j + 1] > last:
                last = above[j + 1]
            if w and above[j] + w > last:
                last = above[j] + w
            row.append(last)
        return row

    def _long_row(self, above: np.ndarray, x: int, right: tuple[int, ...], held: dict) -> np.ndarray:
        if "shapes" not in held:
            shapes, held["places"] = np.unique(np.array(right), return_inverse=True)
            held["shapes"] = shapes.tolist()
            names: dict[str, int] = {}
            held["names"] = names
            held["labels"] = np.array([names.setdefault(self.label[y], len(names)) for y in held["shapes"]])
            held["texts"] = np.array([self.text[y] for y in held["shapes"]])
            held["inner"] = [k for k, y in enumerate(held["shapes"]) if self.children[y]]
            held["at"] = {y: k for k, y in enumerate(held["shapes"])}
        equal = held["labels"] == held["names"].get(self.label[x], -1)
        weights = equal.astype(np.int64)
        if self.text[x]:
            weights += equal & (held["texts"] == self.text[x])
        if self.children[x]:
            for k in held["inner"]:
                if equal[k]:
                    weights[k] = self.weight(x, held["shapes"][k])
        if x in held["at"]:
            weights[held["at"][x]] = self.size[x]
        row = np.zeros_like(above)
        np.maximum(above[1:], above[:-1] + weights[held["places"]], out=row[1:])
        return np.maximum.accumulate(row, out=row)


def matched(page: Node, pivot: Node) -> dict[int, int]:
    """Simple tree matching: which node of the pivot each node of the page is aligned with.

    Nodes match if their labels do and their parents match, children in order; of all such matchings one with most nodes, and
    most nodes that say the same, at every size.
    """
    shapes = _Shapes(page, pivot)
    ours, theirs = shapes.of
    shapes.find(ours[page.number], theirs[pivot.number])
    out, todo = {}, [(page, pivot)]
    while todo:
        a, b = todo.pop()
        out[a.number] = b.number
        if a.children and b.children:
            todo += [(a.children[i], b.children[j]) for i, j in shapes.pairs(ours[a.number], theirs[b.number])]
    return out


@lru_cache(maxsize=64)
def _pivot(page: str) -> tuple[Node, list[Node]]:
    return parsed(page)


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) or 1


def layout_and_keys(page: str) -> tuple[int, list[int]]:
    """Hash of the label paths of a page's upper containers, and of every node with text the hash of its label path and text."""
    _, nodes = parsed(page)
    upper, keys = set(), set()
    todo = [(nodes[0], "", 0)]
    while todo:
        node, path, level = todo.pop()
        if node.blocks:
            keys.add(_hash("\0".join([path, *node.blocks])))
        for child in node.children:
            below = f"{path}/{child.label}"
            deep = level if child.tag in ("html", "body") else level + 1 if child.tag in CONTAINERS else LEVELS + 1
            if level < deep <= LEVELS:
                upper.add(below)
            todo.append((child, below, deep))
    return _hash("\n".join(sorted(upper))), list(keys)


def layouts_and_keys(html: Column) -> Column:
    """``layout_and_keys`` of every page; nulls for none."""

    @F.arrow_udf("struct<layout: bigint, keys: array<bigint>>")
    def hashed(pages: pa.Array) -> pa.Array:
        both = [(None, []) if page is None else layout_and_keys(page) for page in pages.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in both], pa.int64()), pa.array([y for _, y in both], pa.list_(pa.int64()))], ["layout", "keys"])

    return hashed(html)


FOUND = (
    "struct<marks: array<struct<number: int, outer: int, kind: string, words: string>>, "
    "blocks: array<struct<text: string, said: array<bigint>, other: boolean, inside: boolean, around: int>>>"
)


def _lists(sizes: list[int], **columns: pa.Array) -> pa.ListArray:
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def aligned_blocks(html: Column, pivots: Column, layout_pivots: Column) -> Column:
    """Blocks of a page in page order; ``said`` has the nodes of the pivots that they are aligned with and that say the same.

    A node is its place in the pivot, plus 2^32 times the place of the pivot among the host's; for the pivots of the layout
    all that counts down from -1. ``marks`` are the articles, main elements and elements with words against them; ``around``
    is the nearest of these.
    """

    @F.arrow_udf(FOUND)
    def blocks(pages: pa.Array, pivots: pa.Array, layout_pivots: pa.Array) -> pa.Array:
        marks, rows, sizes = [], [], ([], [])
        for page, *references in zip(pages.to_pylist(), pivots.to_pylist(), layout_pivots.to_pylist(), strict=True):
            root, nodes = parsed(page or "")
            said: dict[int, list[int]] = {}
            for of_layout, pages_there in enumerate(references):
                for k, reference in enumerate(pages_there or ()):
                    other_root, there = _pivot(reference)
                    for number, at in matched(root, other_root).items():
                        if there[at].blocks and nodes[number].blocks == there[at].blocks:
                            said.setdefault(number, []).append(-1 - (k << 32 | at) if of_layout else k << 32 | at)
            own = []
            for node in nodes:
                if node.blocks:
                    own += [(place, text, said.get(node.number, ()), node.other, node.inside, node.around) for place, text in zip(node.places, node.blocks, strict=True)]
            own.sort(key=lambda row: row[0])
            held = [(n.number, n.outer, n.kind, n.words) for n in nodes if n.kind or n.words]
            rows += own
            marks += held
            sizes[0].append(len(held))
            sizes[1].append(len(own))
        number, outer, kind, words = zip(*marks, strict=True) if marks else [()] * 4
        _, text, same, other, inside, around = zip(*rows, strict=True) if rows else [()] * 6
        whole, flag, string = pa.int32(), pa.bool_(), pa.string()
        return pa.StructArray.from_arrays(
            [
                _lists(sizes[0], number=pa.array(number, whole), outer=pa.array(outer, whole), kind=pa.array(kind, string), words=pa.array(words, string)),
                _lists(sizes[1], text=pa.array(text, string), said=pa.array(same, pa.list_(pa.int64())), other=pa.array(other, flag), inside=pa.array(inside, flag), around=pa.array(around, whole)),
            ],
            ["marks", "blocks"],
        )

    return blocks(html, pivots, layout_pivots)


def _standing(marks: list[tuple], content: list[tuple]) -> set[int]:
    """Numbers of the elements whose words stand, and of all elements in them.

    ``marks`` are (number, outer, kind, words), outer ones first, ``content`` (length, constant, inside, around) of the blocks.
    Words do not count against an element that holds a main element or the article with most text, nor against articles'
    holders of the same words; nor against one that holds most of the varying text, unless the constant text of the article
    outside it is longer still, as with the comments of copied pages.
    """
    outer = {number: up for number, up, _, _ in marks}
    varying, length, still = dict.fromkeys(outer, 0), dict.fromkeys(outer, 0), dict.fromkeys(outer, 0)
    for size, constant, inside, around in content:
        if around:
            length[around] += size
            varying[around] += 0 if constant else size
            still[around] += size if constant and inside else 0
    for number, up, _, _ in reversed(marks):
        if up:
            for sums in (varying, length, still):
                sums[up] += sums[number]
    all_varying = sum(size for size, constant, _, _ in content if not constant)
    all_still = sum(size for size, constant, inside, _ in content if constant and inside)
    articles = [number for number, _, kind, words in marks if kind == "article" and not words]
    held, free = set(), {number for number, _, kind, _ in marks if kind == "main"}
    if articles:
        free.add(max(articles, key=lambda n: (varying[n], length[n], -n)))
    todo = list(free)
    while todo:
        if (up := outer[todo.pop()]) and up not in free:
            free.add(up)
            todo.append(up)
    for number, up, kind, _ in reversed(marks):
        if number in held or (kind == "article" and number in articles):
            held |= {number, up}
    spared = {words for number, _, kind, words in marks if words and number in free}
    standing = set()
    for number, up, _, words in marks:
        most = 2 * varying[number] > all_varying and length[number] >= all_still - still[number]
        if up in standing or (words and not (number in free or (number in held and words in spared) or most)):
            standing.add(number)
    return standing


def _chosen(marks: list[tuple], blocks: list[tuple]) -> list[int]:
    """Places of the blocks (length, constant, inside, around, other) that are the page's main text."""
    content = [i for i, b in enumerate(blocks) if not b[4]]
    if not any(words for _, _, _, words in marks):
        levels = (set(),)
    else:
        levels = _standing(marks, [blocks[i][:4] for i in content]), set()
    for left_out in levels:
        left = [i for i in content if blocks[i][3] not in left_out]
        varies = [i for i in left if not blocks[i][1]]
        chosen = [i for i in varies if blocks[i][2]] or [i for i in left if blocks[i][2]] or varies
        if chosen:
            return chosen
    return []


def main_text(found: Column, constant: Column) -> Column:
    """The main text of a page as found by ``aligned_blocks``, given for each block whether it is template."""

    @F.arrow_udf("string")
    def text(pages: pa.Array, constants: pa.Array) -> pa.Array:
        out = []
        marks, blocks = pages.field("marks"), pages.field("blocks")
        mark_ends, block_ends = marks.offsets.to_pylist(), blocks.offsets.to_pylist()
        mark, block = marks.values, blocks.values
        all_marks = list(zip(*(mark.field(c).to_pylist() for c in ("number", "outer", "kind", "words")), strict=True))
        texts = block.field("text").to_pylist()
        flags = constants.values.to_pylist()
        first = constants.offsets[0].as_py() - block_ends[0]
        other, inside, around = (block.field(c).to_pylist() for c in ("other", "inside", "around"))
        for i in range(len(pages)):
            a, b = block_ends[i], block_ends[i + 1]
            rows = [(len(texts[j]), flags[j + first], inside[j], around[j], other[j]) for j in range(a, b)]
            out.append("\n\n".join(texts[a + j] for j in _chosen(all_marks[mark_ends[i] : mark_ends[i + 1]], rows)))
        return pa.array(out, pa.string())

    return text(found, constant)


def host_of(url: Column) -> Column:
    """Host of an address in lower case; null where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#\s]+)", 1))
    return F.when(host != "", host)


def _common(n: Column, pages: Column, share: Column) -> Column:
    return n >= F.greatest(F.lit(LEAST_PAGES), share * pages)


def _scopes(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Number of pages of each (site, scope) that can have a template, and (site, scope, h, keys) of each page in its scopes.

    Scope 0 is the host, the others are layouts that only some of its pages have.
    """
    layouts = keyed.groupBy("site", "layout").agg(F.count(F.lit(1)).alias("pages"))
    hosts = layouts.groupBy("site").agg(F.sum("pages").alias("pages"))
    some = layouts.join(hosts.withColumnRenamed("pages", "all"), "site").where((F.col("pages") < F.col("all")) & (F.col("pages") >= LEAST_PAGES))
    sizes = cut(hosts.where(F.col("pages") >= LEAST_PAGES).select("site", F.lit(0).cast("long").alias("scope"), "pages").union(some.select("site", "layout", "pages")))
    of_layouts = sizes.where("scope != 0").select("site", F.col("scope").alias("layout"), F.col("scope"))
    scopes = F.filter(F.array(F.lit(0).cast("long"), F.col("scope")), lambda x: x.isNotNull())
    return sizes, keyed.join(of_layouts, ["site", "layout"], "left").select("site", F.explode(scopes).alias("scope"), "h", "keys")


def pivots_of(filled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(site, scope, pages), and the pages (site, scope, html) that the pages of a host or layout are aligned with.

    What enough pages say at the same label path may be template, and of each such text the page that holds most of them is a
    pivot. So one page is enough where it has all, and no text is missed because a page drawn lacks it. A layout has pivots for
    what is common in it and not on the whole host.
    """
    keyed = cut(filled.select("site", F.xxhash64("html").alias("h"), layouts_and_keys(F.col("html")).alias("k")).select("site", "h", "k.layout", "k.keys"))
    sizes, scoped = _scopes(keyed)
    counts = scoped.select("site", "scope", F.explode("keys").alias("key")).groupBy("site", "scope", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAGES)
    common = counts.join(sizes, ["site", "scope"]).where(_common(F.col("n"), F.col("pages"), F.lit(CONSTANT)))
    everywhere = F.max(F.col("scope") == 0)
    common = common.groupBy("site", "key").agg(F.collect_list("scope").alias("scopes"), everywhere.alias("host"))
    common = common.select("site", "key", F.explode(F.when(F.col("host"), F.array(F.lit(0).cast("long"))).otherwise(F.col("scopes"))).alias("scope"))
    sets = cut(common.groupBy("site", "scope").agg(F.collect_set("key").alias("common")))
    held = scoped.join(sets, ["site", "scope"]).select("site", "scope", "h", F.array_intersect("keys", "common").alias("held"))
    best = held.select("site", "scope", F.explode("held").alias("key"), F.struct(F.size("held").alias("n"), "h").alias("page")).groupBy("site", "scope", "key").agg(F.max("page").alias("page"))
    drawn = cut(best.select("site", "scope", F.col("page.h").alias("h")).distinct())
    found = filled.select("site", "html", F.xxhash64("html").alias("h")).join(drawn, ["site", "h"])
    return sizes, found.groupBy("site", "scope", "h").agg(F.min("html").alias("html"))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html): the text of the article.

    Every page of a host is aligned by simple tree matching with the host's pivots, pages that hold between them all that may
    be template, and with those of its layout (``pivots_of``). Over all pages of the host, or of the layout, it is counted in
    how many a node of the pivot says the same: from half of them on, and at least three, it is template (nine tenths inside an
    article or main element, where pages may be copies of each other). Other
    slots vary and are content, unless an element or role marks them as menu, header, footer, sidebar or notice, or a class or
    id as such or as advert, form or comment. A class, id or form does not count where it holds a main element, the largest
    article or most of the page's varying text, nor where nothing would be left. If content is left inside an article or main
    element, what is outside goes. If the template would take all there is inside, the page is a copy and keeps it.

    Blocks are joined by two line feeds; white space in a block is one blank, references are decoded. Null and empty html give
    an empty text. Pages without a host in their url, and hosts of fewer than three pages, have no template. Repeated rows come
    out each. An empty table gives an empty one; other columns are not read.
    """
    host = host_of(F.col("url"))
    own = pages.select("page_id", "url", "html", F.when(host.isNotNull(), F.xxhash64(host)).alias("site"))
    sizes, drawn = pivots_of(own.where(F.col("site").isNotNull() & (F.length("html") > 0)))
    pivots = cut(drawn.groupBy("site", "scope").agg(F.transform(F.sort_array(F.collect_list(F.struct("h", "html"))), lambda x: x.html).alias("pivots")))
    of_hosts = pivots.where("scope = 0").select(F.col("site").alias("of"), "pivots")
    of_layouts = pivots.where("scope != 0").select(F.col("site").alias("of_site"), F.col("scope").alias("of_layout"), F.col("pivots").alias("layout_pivots"))
    several = of_layouts.select(F.col("of_site").alias("several")).distinct()
    dressed = own.join(of_hosts, F.col("site") == F.col("of"), "left").join(several, F.col("site") == F.col("several"), "left")
    dressed = dressed.withColumn("layout", layouts_and_keys(F.when(F.col("several").isNotNull(), F.col("html")))["layout"])
    dressed = dressed.join(of_layouts, (F.col("site") == F.col("of_site")) & (F.col("layout") == F.col("of_layout")), "left")
    found = cut(dressed.select("page_id", "url", "site", "layout", aligned_blocks(F.col("html"), F.col("pivots"), F.col("layout_pivots")).alias("page")))

    nodes = F.flatten(F.transform("page.blocks", lambda b: F.transform(b.said, lambda n: F.struct(n.alias("node"), b.inside.alias("inside")))))
    said = found.select("site", "layout", F.explode(F.array_distinct(nodes)).alias("n")).withColumn("scope", F.when(F.col("n.node") < 0, F.col("layout")).otherwise(F.lit(0).cast("long")))
    counts = said.groupBy("site", "scope", "n.node", "n.inside").agg(F.count(F.lit(1)).alias("n"))
    share = F.when(F.col("inside"), CONSTANT_INSIDE).otherwise(CONSTANT)
    constant = counts.join(sizes, ["site", "scope"]).where(_common(F.col("n"), F.col("pages"), share))
    # written, so that Spark knows its size before it deals out the pages
    templates = cut(constant.groupBy("site", "scope").agg(F.collect_set("node").alias("template")))

    of_hosts = templates.where("scope = 0").select(F.col("site").alias("of"), "template")
    of_layouts = templates.where("scope != 0").select(F.col("site").alias("of_site"), F.col("scope").alias("of_layout"), F.col("template").alias("layout_template"))
    marked = found.join(of_hosts, F.col("site") == F.col("of"), "left").join(of_layouts, (F.col("site") == F.col("of_site")) & (F.col("layout") == F.col("of_layout")), "left")
    none = F.array().cast("array<bigint>")
    marked = marked.withColumn("template", F.concat(F.coalesce("template", none), F.coalesce("layout_template", none)))
    constant = F.transform("page.blocks", lambda b: F.arrays_overlap(b.said, F.col("template")))
    return marked.select("page_id", "url", main_text(F.col("page"), constant).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
