"""Pages as trees of block elements, for the tree-structured content model."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?:[!?])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""", re.S
)
_MARKED = re.compile(r"""\b(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAMES = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Element names by their part in a page, as the HTML standard has them.
RAW = frozenset("script style textarea title".split())  # hold no elements; an unclosed one reaches to the end
HIDDEN = frozenset("template iframe".split())  # not shown; skipped to the matching end, and an unclosed one is no element
FOREIGN = frozenset("svg math".split())  # inside, a slash closes an element
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html head body address article aside blockquote button center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("html head body button option select legend td th tr tbody thead tfoot".split())
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"},
}
SCOPES = frozenset("ul ol dl table select body html article section div".split())


@dataclass
class Node:
    """A block element, or an inline one that carries a class or an id."""

    tag: str
    names: tuple[str, ...]
    parent: int
    marked: str | None = None
    own: int = 0  # characters of text directly inside
    text: int = 0  # characters below
    linked: int = 0  # of these, inside links


@dataclass
class Page:
    """Nodes in document order (a parent before its children) and the pieces of text in page order."""

    nodes: list[Node] = field(default_factory=list)
    pieces: list[tuple[int, bool, str]] = field(default_factory=list)  # node, whether a new block begins, raw text


def _attributes(raw: str) -> tuple[tuple[str, ...], str | None]:
    names: list[str] = []
    marked = None
    for name, *values in _MARKED.findall(raw):
        value = next((v for v in values if v), "")
        if name.lower() == "data-main":
            marked = value
        else:
            names += _NAMES.findall(_CAMEL.sub(" ", value).lower())
    return tuple(dict.fromkeys(names)), marked


def _past(html: str, tag: str, at: int) -> int:
    """Where the element that begins before `at` has ended, nested ones of its kind counted; `at` if it never ends."""
    depth = 1
    for found in re.compile(rf"<(/?){tag}\b[^>]*(?:>|\Z)", re.I).finditer(html, at):
        depth += -1 if found.group(1) else 1 if tag == "template" else 0
        if not depth:
            return found.end()
    return at


def parse(html: str) -> Page:
    """The tree of a page; unclosed and misplaced tags are repaired as browsers do in the common cases."""
    page = Page([Node("#page", (), -1)])
    nodes, pieces = page.nodes, page.pieces
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements and the node that holds their text
    links, fresh, at, n = 0, True, 0, len(html)

    def put(raw: str) -> None:
        nonlocal fresh
        if raw:
            pieces.append((stack[-1][1], fresh, raw))
            fresh = False
            size = len(raw.strip())
            if size:
                node = nodes[stack[-1][1]]
                node.own += size
                node.linked += size if links else 0

    def close(depth: int) -> None:
        nonlocal links, fresh
        for tag, _ in stack[depth:]:
            links -= tag == "a"
            fresh = fresh or tag in BLOCKS
        del stack[depth:]

    def nearest(tags: frozenset[str] | set[str], stops: frozenset[str] = frozenset()) -> int:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in tags:
                return depth
            if stack[depth][0] in stops:
                return 0
        return 0

    while at < n:
        found = _MARKUP.search(html, at)
        if found is None:
            put(html[at:])
            break
        put(html[at : found.start()])
        at = found.end()
        ends, name, raw = found.group(1), found.group(2), found.group(3)
        if name is None:
            continue
        tag = name.lower()
        if ends:
            depth = nearest({tag})
            if depth:
                close(depth)
            elif tag == "br":
                fresh = True
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag in HIDDEN:
            at = _past(html, tag, at)
            continue
        if tag in VOID:
            fresh = fresh or tag in ("br", "hr")
            continue
        if tag in CLOSES_P and (depth := nearest({"p"}, SCOPES)):
            close(depth)
        if tag in SIBLINGS and (depth := nearest(SIBLINGS[tag], SCOPES)):
            close(depth)
        if tag == "body" and (depth := nearest({"head"})):
            close(depth)
        names, marked = _attributes(raw) if "=" in raw else ((), None)
        inner = stack[-1][1]
        if tag in BLOCKS or names or marked:
            nodes.append(Node(tag, names, inner, marked))
            inner = len(nodes) - 1
            fresh = fresh or tag in BLOCKS
        if not raw.endswith("/") or tag not in ("p", "div") and tag not in FOREIGN and not nearest(FOREIGN):
            stack.append((tag, inner))
            links += tag == "a"
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        node.text += node.own
        if node.parent >= 0:
            nodes[node.parent].text += node.text
            nodes[node.parent].linked += node.linked
    return page


def joined(page: Page, chosen: list[bool]) -> str:
    """The text of the chosen nodes: blocks in page order, white space as single spaces; a character reference ends where its piece of text does."""
    blocks: list[list[str]] = []
    begins = True
    for node, fresh, raw in page.pieces:
        begins = begins or fresh
        if chosen[node]:
            if begins or not blocks:
                blocks.append([])
                begins = False
            blocks[-1].append(unescape(raw))
    return " ".join(" ".join("".join(block) for block in blocks).split())


def look(node: Node) -> str:
    """How much text a node has, directly and below, and how much of that is links."""

    def bucket(value: int) -> int:
        return min((value.bit_length() + 1) // 2, 6)

    share = int(3.999 * node.linked / node.text) if node.text else 0
    return f"{node.tag},{bucket(node.own)},{bucket(node.text)},{share}"
