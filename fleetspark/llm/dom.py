"""A forgiving HTML reader, simple tree matching, and the text blocks of a tree."""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from heapq import nsmallest
from html import unescape
from itertools import accumulate

import numpy as np
import xxhash

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
UNSEEN = RAW | VOID
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody tfoot thead tr ul".split())
ENDS_PARAGRAPH = BLOCK - frozenset("body html option legend caption tbody tfoot thead tr".split())
#: What a start tag ends if it is open, and what shields an open element from that.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
ENDED = {tag: (("p",) if tag in ENDS_PARAGRAPH else ()) + ENDS.get(tag, ()) for tag in ENDS_PARAGRAPH | frozenset(ENDS)}
SHIELDS = frozenset("article aside blockquote body button caption div dl figure footer form header html main nav ol section table ul".split())
#: What isn't the article, by element, by role and by words of class or id.
DROPPED = frozenset("nav footer aside form script style noscript template iframe button select svg canvas audio video object dialog menu title head textarea".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
DROPPED_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: Names that parts of an article have too: inside it the host's template decides on them.
IN_ARTICLE = DROPPED_WORDS - frozenset("banner header masthead notice notices".split())
#: Elements that any text may have or not.
CONTENT = frozenset("a abbr b blockquote code dd dl dt em figcaption figure h1 h2 h3 h4 h5 h6 i li ol p pre small span strong sub sup table tbody td th thead tr u ul".split())
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][^\s=>/"']*)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)", re.I) for tag in RAW}
_PHRASES = re.compile(r"[^\s。！？，、]{7,}(?: \S{1,6}(?!\S))*")
_WORDS = re.compile(r"[a-z]+")
_BARE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)>")


class Node:
    __slots__ = ("tag", "attributes", "children", "parts")

    def __init__(self, tag: str, attributes: dict):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.parts: list[tuple[str, Node]] | None = None  # what ``named`` has found


def _attributes(raw: str) -> dict:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in reversed(_ATTRIBUTE.findall(raw))} if "=" in raw else {}


def _tag_end(html: str, at: int) -> int:
    """Where a tag's ``>`` is, past quoted values; -1 if the text ends before."""
    end = html.find(">", at)
    while end >= 0:
        inside = html[at:end]
        if inside.count('"') % 2 == 0 and inside.count("='") * 2 <= inside.count("'") or "<" in inside:
            return end
        end = html.find(">", end + 1)
    return html.find(">", at)


def parse(html: str) -> Node:
    """The tree of a page. Missing and stray end tags are put right as browsers do for
    paragraphs, lists and tables; a tag or comment that the text breaks off is left out.
    Elements may be nested to any depth."""
    root = Node("#root", {})
    stack = [root]
    opened: defaultdict[str, int] = defaultdict(int)  # open elements of a tag

    def close(k: int) -> None:
        for n in stack[k:]:
            opened[n.tag] -= 1
        del stack[k:]

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            stack[-1].children.append(html[at:])
            break
        if lt > at:
            stack[-1].children.append(html[at:lt])
        if bare := _BARE.match(html, lt):  # most tags have no more than a name
            closing, inside = bare.groups()
            at, tag, raw = bare.end(), inside.lower(), ""
        else:
            after = html[lt + 1 : lt + 2]
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = size if end < 0 else end + 3
                continue
            if after in ("!", "?") or (after == "/" and not html[lt + 2 : lt + 3].isalpha()):
                end = html.find(">", lt)
                at = size if end < 0 else end + 1
                continue
            if not (after == "/" or (after.isascii() and after.isalpha())):
                stack[-1].children.append("<")
                at = lt + 1
                continue
            end = _tag_end(html, lt + 1)
            if end < 0:
                break
            at = end + 1
            closing = after == "/"
            inside = html[lt + 1 + closing : end]
            parts = inside.split(None, 1)
            tag = parts[0].rstrip("/").lower() if parts else ""
            raw = parts[1] if len(parts) > 1 else ""
        if closing:
            if opened[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        ended = ENDED.get(tag)
        if ended and any(map(opened.get, ended)):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ended:
                    close(k)
                elif stack[k].tag in SHIELDS:
                    break
        node = Node(tag, _attributes(raw) if raw else {})
        stack[-1].children.append(node)
        if tag in RAW:
            found = _RAW_END[tag].search(html, at)
            node.children.append(html[at : found.start() if found else size])
            end = html.find(">", found.start()) if found else -1
            at = size if end < 0 else end + 1
        elif tag not in VOID and not inside.endswith("/"):
            stack.append(node)
            opened[tag] += 1
    return root


def _names(node: Node) -> str:
    if node.tag in ("html", "body"):
        return ""
    return f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}".lower()


def boilerplate(node: Node, in_article: bool, holds: bool = False) -> bool:
    """Whether an element says of itself that it isn't the article.

    Its class and id count by any word in them, inside the article only as whole
    names. They don't count, nor does being a form or a header, for an element
    that ``holds`` a marked article.
    """
    if node.tag in DROPPED and not (holds and node.tag == "form") or (node.tag == "header" and not in_article and not holds):
        return True
    if not node.attributes or node.tag in ("html", "body"):
        return False
    own = node.attributes
    if own.get("role", "").lower() in DROPPED_ROLES and not (holds and own["role"].lower() == "form") or "hidden" in own or own.get("aria-hidden") == "true":
        return True
    if holds:
        return False
    return not (IN_ARTICLE.isdisjoint(_names(node).split()) if in_article else DROPPED_WORDS.isdisjoint(_WORDS.findall(_names(node))))


def _is_article(node: Node) -> bool:
    return node.tag == "article" or node.attributes.get("itemprop") == "articleBody"


def _is_main(node: Node) -> bool:
    return node.tag == "main" or node.attributes.get("role") == "main"


def holders(root: Node) -> set[int]:
    """The elements that are or contain what a page marks as article or main part."""
    found: set[int] = set()
    above: dict[int, Node] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main") or node.attributes and (_is_article(node) or _is_main(node)):
            up: Node | None = node
            while up and id(up) not in found:
                found.add(id(up))
                up = above.get(id(up))
        for child in node.children:
            if type(child) is not str:
                above[id(child)] = node
                todo.append(child)
    return found


def articles(root: Node, holding: set[int] | None = None) -> list[Node]:
    """The outermost elements that the page marks as its article, else as its main part.

    Those in elements wholly named as boilerplate (teasers in a box) count only
    if there are no others and they hold half of the page's text.
    """
    holding = holders(root) if holding is None else holding
    if not holding:
        return []
    if found := _marked(root, holding, True):
        return found
    found = _marked(root, holding, False)
    return found if 2 * sum(len(text_of(n)) for n in found) >= len(text_of(root)) else []


def _marked(root: Node, holding: set[int], by_name: bool) -> list[Node]:
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, str) or id(node) not in holding or boilerplate(node, False, True):
            continue
        if by_name and not DROPPED_WORDS.isdisjoint(_names(node).split()):
            continue
        if _is_article(node):
            found["article"].append(node)
            continue
        if _is_main(node):
            found["main"].append(node)
        todo += node.children[::-1]
    if found["article"]:
        return found["article"]
    inner = {id(n) for m in found["main"] for n in _elements(m) if n is not m}
    return [m for m in found["main"] if id(m) not in inner]


def _elements(node: Node):
    todo = [node]
    while todo:
        node = todo.pop()
        if not isinstance(node, str):
            yield node
            todo += node.children


def text_of(node: Node) -> str:
    """All text of a subtree, white space as one blank."""
    out, todo = [], [node]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.tag not in RAW:
            todo += node.children[::-1]
    return " ".join(unescape(" ".join(out)).split())


def digest(path: int, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\n{text}".encode("utf-8", "replace")) - (1 << 63)


def label(node: Node) -> str:
    return f"{node.tag}.{node.attributes['class']}" if node.attributes and "class" in node.attributes else node.tag


def tag_of(name: str) -> str:
    """The tag of a label."""
    return name if name.startswith("#") else name.split(".")[0].split("#")[0]


def named(node: Node, longest: int = 12) -> list[tuple[str, Node]]:
    """The elements below a node, but for raw and void ones, each with its label.

    Bare containers side by side that hold different kinds of blocks are parts
    of a page that only lack names: they are numbered, so each can be told by its
    place. If they hold the same, or are more than ``longest``, they are a list.
    """
    if node.parts is None:
        node.parts = [(label(c), c) for c in node.children if not isinstance(c, str) and c.tag not in UNSEEN]
        bare = [i for i, (name, _) in enumerate(node.parts) if name in CONTAINERS] if len(node.parts) > 1 else ()
        if len(bare) > 1:
            _number(node.parts, bare, longest)
    return node.parts


def _number(parts: list[tuple[str, Node]], bare: list[int], longest: int) -> None:
    by_name: dict[str, list[int]] = defaultdict(list)
    for i in bare:
        by_name[parts[i][0]].append(i)
    for name, places in by_name.items():
        if 1 < len(places) <= longest and len({frozenset(c.tag for c in parts[i][1].children if not isinstance(c, str) and c.tag in BLOCK) for i in places}) > 1:
            for k, i in enumerate(places):
                parts[i] = f"{name}#{k}", parts[i][1]


@lru_cache(1 << 16)
def step(path: int, name: str) -> int:
    """The path of a child with the label ``name``."""
    return digest(path, name)


class Texts:
    """``text_of`` for every element of a page, and how much of it is outside links, from one walk over it."""

    def __init__(self, root: Node):
        pieces: list[str] = []
        plain: list[int] = []
        span: dict[int, list[int]] = {}
        links = 0
        todo: list[Node | str | tuple[Node]] = [root]  # a tuple is an element whose end is reached
        while todo:
            node = todo.pop()
            kind = type(node)
            if kind is str:
                if words := (unescape(node) if "&" in node else node).split():
                    pieces.append(" ".join(words))
                    plain.append(0 if links else len(pieces[-1]))
            elif kind is tuple:
                links -= node[0].tag == "a"
                span[id(node[0])].append(len(pieces))
            elif node.tag not in RAW:
                links += node.tag == "a"
                span[id(node)] = [len(pieces)]
                if node.children:
                    todo.append((node,))
                    todo += node.children[::-1]
                else:
                    links -= node.tag == "a"
                    span[id(node)].append(len(pieces))
        self._text, self._span = " ".join(pieces), span
        self._at = [0, *accumulate(len(p) + 1 for p in pieces)]
        self._plain = [0, *accumulate(plain)]

    def of(self, node: Node) -> str:
        if id(node) not in self._span:
            return ""
        a, b = self._span[id(node)]
        return self._text[self._at[a] : self._at[b] - 1] if b > a else ""

    def plain(self, node: Node) -> int:
        """Characters of its text that no link has."""
        a, b = self._span.get(id(node), (0, 0))
        return self._plain[b] - self._plain[a]


#: What a node of an outline is: it holds a marked article, is one, is in one, is boilerplate by its own account.
HOLDS, MARKED, WITHIN, DULL = 1, 2, 4, 8


class Part:
    """A node of an outline: neighbours with the same label, at ``depth``, with the digest of their path and text."""

    __slots__ = ("depth", "label", "path", "digest", "kind", "mass", "nodes")

    def __init__(self, depth: int, label_: str, path: int, found: int, kind: int, mass: int, nodes: list[Node]):
        self.depth, self.label, self.path, self.digest, self.kind, self.mass, self.nodes = depth, label_, path, found, kind, mass, nodes


def outline(root: Node, texts: Texts, marked: set[int], holding: set[int]) -> list[Part]:
    """The elements of a page in its order; runs of neighbours with the same label are one part, and not looked into."""
    out: list[Part] = []
    todo: list[tuple[str, list[Node], int, int, bool]] = [(label(root), [root], 0, 0, False)]
    while todo:
        name, nodes, depth, path, within = todo.pop()
        here = step(path, name)
        if len(nodes) > 1:
            kind = HOLDS * any(id(n) in holding for n in nodes) | MARKED * any(id(n) in marked for n in nodes) | WITHIN * within
            kind |= DULL * all(boilerplate(n, within, id(n) in holding) for n in nodes)
            out.append(Part(depth, name, here, digest(here, "\n".join(map(texts.of, nodes))), kind, sum(map(texts.plain, nodes)), nodes))
            continue
        node = nodes[0]
        holds = id(node) in holding
        kind = HOLDS * holds | MARKED * (id(node) in marked) | WITHIN * within | DULL * boilerplate(node, within, holds)
        out.append(Part(depth, name, here, digest(here, texts.of(node)), kind, texts.plain(node), nodes))
        groups: list[tuple[str, list[Node]]] = []
        for below, child in named(node):
            if groups and groups[-1][0] == below:
                groups[-1][1].append(child)
            else:
                groups.append((below, [child]))
        todo += [(below, g, depth + 1, here, within or bool(kind & MARKED)) for below, g in groups[::-1]]
    return out


def elements_by_path(root: Node, path: int | None = None):
    """(path, element) of an element and all below, outer ones first, in page order; ``path`` is the element's own."""
    todo = [(root, step(0, label(root)) if path is None else path)]
    while todo:
        node, path = todo.pop()
        yield path, node
        if node.children:
            todo += [(c, step(path, name)) for name, c in named(node)[::-1]]


def block_digests(root: Node, texts: Texts, path: int | None = None):
    """(path, digest, element) of every block with text, each alone."""
    for at, node in elements_by_path(root, path):
        if node.tag in BLOCK and (text := texts.of(node)):
            yield at, digest(at, text), node


def skeleton(root: Node) -> list[tuple[int, str, int]]:
    """(depth, label, digest) of the page's ``outline``."""
    return [(p.depth, p.label, p.digest) for p in page(root)[0]]


def page(root: Node) -> tuple[list[Part], bool, int, list[tuple[int, int]], list[int]]:
    """A page's outline, whether it marks an article, the digest of its main text as the page alone tells it, the
    (path, digest) of its blocks, and that text's ``sample``."""
    holding = holders(root)
    marked = articles(root, holding)
    texts = Texts(root)
    out = outline(root, texts, {id(n) for n in marked}, holding)
    text = "\n".join(map(texts.of, marked or [root]))
    blocks_ = list(dict.fromkeys((path, found) for path, found, _ in block_digests(root, texts)))
    return out, bool(marked), digest(0, text), blocks_, sample(text) if marked else []


#: Elements that may hold a page's main part alone.
CONTAINERS = frozenset("#root html body div section article main center table tbody tr td".split())
#: Slots that hold everything, so they tell nothing.
WHOLE = frozenset("#root html body".split())


def induced(parts: list[tuple[int, str, int, int]], masses: dict[int, int], most: float = 0.5, lead: float = 0.75, own: float = 0.1) -> int | None:
    """The path of the slot that holds a layout's content; null if that is no less than the page.

    ``parts``: (depth, label, path, kind) of the first page's outline. ``masses``:
    by place in it, the plain text that other pages have there and that differs.
    From the root, it goes down into the one child that varies; or into a child
    that leads, with ``lead`` of all that varies, named or not, unless headings or
    paragraphs vary beside it; or into one with ``most`` of it if that holds a
    marked article, or else all others do, which are teasers then. Names only
    have a veto: what calls itself boilerplate is neither gone into nor counted. It
    stops at a marked article, and where over ``own`` of the varying text is a
    node's own, or no child leads.
    """
    below = _children([(depth, name, 0) for depth, name, _, _ in parts])
    at = 0
    while not parts[at][3] & MARKED:
        varying = [c for c in below[at] if masses.get(c) and not parts[c][3] & DULL]
        if not varying or sum(masses.get(c, 0) for c in below[at]) < (1 - own) * masses.get(at, 0):
            break
        best = max(varying, key=masses.__getitem__)
        share = masses[best] / sum(masses[c] for c in varying)
        marked = [c for c in varying if parts[c][3] & (HOLDS | MARKED)]
        leads = share >= lead and not any(tag_of(parts[c][1]) in CONTENT for c in varying if c != best)
        alone = len(varying) == 1 or leads or share >= most and (best in marked or len(varying) == 1 + len(marked))
        if not alone or tag_of(parts[best][1]) not in CONTAINERS:
            break
        at = best
    return None if tag_of(parts[at][1]) in WHOLE else parts[at][2]


def sample(text: str, size: int = 32) -> list[int]:
    """The ``size`` smallest digests of a text's phrases, each cut before a long word; of the text if it has none."""
    data = text.encode("utf-8", "replace").decode()  # what can't be encoded is replaced once, not phrase by phrase
    hashed = set(map(xxhash.xxh64_intdigest, set(_PHRASES.findall(data))))
    return [x - (1 << 63) for x in nsmallest(size, hashed or {xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))})]


def likeness(a: list[int], b: list[int]) -> float:
    """Estimated share of phrases that two texts have in common, from their samples."""
    both = nsmallest(min(len(a), len(b)), set(a) | set(b))
    return len(set(both) & set(a) & set(b)) / max(1, len(both))


def layout(parts: list[Part]) -> int:
    """What pages of one layout share: a digest of the labels outside marked articles, but for bare content elements, whose use varies."""
    return digest(0, "\n".join(sorted({f"{p.depth} {p.label}" for p in parts if p.label.split("#")[0] not in CONTENT and not p.kind & WITHIN})))


def matched(a: list[tuple[int, str, int]], b: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """Simple tree matching: the largest order-keeping match of two skeletons, as pairs of positions.

    Nodes match only under matched parents and with the same label; children
    are aligned by dynamic programming, weighted by what matches below. What two
    nodes score depends on their shapes alone (labels below them), so each pair
    of shapes is worked out once.
    """
    if not a or not b or a[0][1] != b[0][1]:
        return []
    if len(a) == len(b) and all(p[1] == q[1] and p[0] == q[0] for p, q in zip(a, b, strict=True)):
        return [(i, i) for i in range(len(a))]  # one and the same tree
    shapes = Shapes()
    below = _children(a), _children(b)
    own = shapes.of(a, below[0]), shapes.of(b, below[1])
    out, todo = [], [(0, 0)]
    while todo:
        i, j = todo.pop()
        out.append((i, j))
        todo += [(below[0][i][x], below[1][j][y]) for x, y in shapes.aligned(own[0][i], own[1][j])]
    return sorted(out)


class Shapes:
    """Shapes of trees by number: a label and the shapes of the children; and the best matches of two."""

    def __init__(self):
        self.numbers: dict[tuple[str, tuple[int, ...]], int] = {}
        self.label: list[str] = []
        self.below: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.scores: dict[tuple[int, int], int] = {}

    def of(self, nodes: list[tuple[int, str, int]], below: list[list[int]]) -> list[int]:
        found = [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):  # children come after their parent
            key = nodes[i][1], tuple(found[c] for c in below[i])
            if key not in self.numbers:
                self.numbers[key] = len(self.label)
                self.label.append(key[0])
                self.below.append(key[1])
                self.size.append(1 + sum(self.size[c] for c in key[1]))
            found[i] = self.numbers[key]
        return found

    def known(self, x: int, y: int) -> int | None:
        """The score of two shapes where no alignment is needed, or once it is done."""
        if self.label[x] != self.label[y]:
            return 0
        if x == y:
            return self.size[x]
        if not self.below[x] or not self.below[y]:
            return 1
        return self.scores.get((x, y))

    def score(self, x: int, y: int) -> int:
        waiting = [(x, y)]
        while waiting:  # a pair is scored after all pairs of shapes below it
            p, q = waiting[-1]
            if self.known(p, q) is None:
                missing = [(u, v) for u in set(self.below[p]) for v in set(self.below[q]) if self.known(u, v) is None]
                if missing:
                    waiting += missing
                    continue
                self.scores[p, q] = 1 + int(self._table(p, q)[-1, -1])
            waiting.pop()
        return self.known(x, y)

    def _table(self, x: int, y: int) -> np.ndarray:
        """Best scores of the first children of one with the first children of the other."""
        p, q = self.below[x], self.below[y]
        rows = {u: np.array([self.known(u, v) for v in q], np.int64) for u in set(p)}
        table = np.zeros((len(p) + 1, len(q) + 1), np.int64)
        for k, u in enumerate(p):
            table[k + 1, 1:] = np.maximum.accumulate(np.maximum(table[k, 1:], table[k, :-1] + rows[u]))
        return table

    def aligned(self, x: int, y: int) -> list[tuple[int, int]]:
        """Places of the children that match in a best match of two shapes with one label."""
        p, q = self.below[x], self.below[y]
        if x == y:
            return [(k, k) for k in range(len(p))]
        if not p or not q:
            return []
        self.score(x, y)
        table = self._table(x, y)
        out, u, v = [], len(p), len(q)
        while u and v:
            if table[u, v] == table[u - 1, v]:
                u -= 1
            elif table[u, v] == table[u, v - 1]:
                v -= 1
            else:
                u, v = u - 1, v - 1
                out.append((u, v))
        return out


def _children(nodes: list[tuple[int, str, int]]) -> list[list[int]]:
    below: list[list[int]] = [[] for _ in nodes]
    stack: list[int] = []
    for i, (depth, _, _) in enumerate(nodes):
        del stack[depth:]
        if stack:
            below[stack[-1]].append(i)
        stack.append(i)
    return below


def main_part(root: Node, wrappers: set[int]) -> list[tuple[int | None, Node]]:
    """(path, element) of what holds the page's content: what is at the host's wrapper, else what the page marks, else the root.

    Of several wrappers it is the one with the most text outside links. The path
    is null for the root.
    """
    found: dict[int, list[tuple[int, Node]]] = {}
    todo = [(step(0, label(root)), root)] if wrappers else []
    while todo:
        path, node = todo.pop()
        if path in wrappers:
            found.setdefault(path, []).append((path, node))
        else:
            todo += [(step(path, name), c) for name, c in named(node)[::-1]]
    if found:
        return max(found.values(), key=lambda nodes: sum(Texts(n).plain(n) for _, n in nodes)) if len(found) > 1 else next(iter(found.values()))
    marked = {id(n) for n in articles(root)}
    return [(path, n) for path, n in elements_by_path(root) if id(n) in marked] if marked else [(None, root)]


def blocks(root: Node, template: set[int] = frozenset(), wrappers: set[int] = frozenset()) -> list[str]:
    """The article's blocks in page order.

    What the host's ``wrappers`` hold (paths of slots; else what the page marks,
    else the whole page), but for boilerplate and constant nodes (digests in
    ``template``).
    """
    out: list[str] = []
    text: list[str] = []
    main = main_part(root, wrappers)
    starts = {id(n) for _, n in main}
    proper = main[0][0] is not None
    holding = set() if proper else holders(root)
    constant: set[int] = set()
    for path, node in main if template else ():
        texts = Texts(node)
        constant |= {id(n) for _, found, n in block_digests(node, texts, path) if found in template}
        if not proper:
            constant |= {id(n) for part in outline(root, texts, set(), holding) if part.digest in template for n in part.nodes}

    def flush() -> None:
        block = " ".join(unescape("".join(text)).split())
        if block:
            out.append(block)
        text.clear()

    # None ends a block.
    todo: list[Node | str | None] = [n for _, n in main[::-1]]
    while todo:
        node = todo.pop()
        if node is None:
            flush()
            continue
        if isinstance(node, str):
            text.append(node)
            continue
        if id(node) in constant:
            continue
        if id(node) not in starts and boilerplate(node, proper, not proper and id(node) in holding):
            flush()
            continue
        if node.tag in ("br", "td", "th"):
            text.append(" ")
        edge = [None] if node.tag in BLOCK else []
        todo += edge + [c for c in node.children[::-1] if isinstance(c, str) or c.tag not in RAW] + edge
    flush()
    return out
