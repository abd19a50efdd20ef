"""A small forgiving HTML tree: enough of the parsing rules to find blocks, containers and media.

A node is a list [tag, attributes, children]; a child is a node or a piece of text. Comments,
declarations and processing instructions are dropped; script, style and the like keep their raw
text, which may hold tags. Elements nested deeper than DEPTH become siblings. Character references in text and attributes are decoded.
"""

from __future__ import annotations

import re
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td template tfoot th thead title tr ul video audio picture".split()
)
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
WALLS = frozenset("article section div main body table td th li aside nav footer header form figure blockquote".split())

DEPTH = 200
_tag = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_attr = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _attr.findall(raw):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        out.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return out


def parse(html: str) -> list:
    """The root node of a whole page; every text is kept somewhere in the tree."""
    root: list = ["#root", {}, []]
    stack = [root]
    flat: dict[str, int] = {}
    at, n = 0, len(html)
    search = _tag.search
    while at < n:
        m = search(html, at)
        end = m.start() if m else n
        if end > at:
            text = html[at:end]
            stack[-1][2].append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                stack[-1][2].append(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if m[1]:
            if flat.get(name):
                flat[name] -= 1
                continue
            _close(stack, name)
            continue
        raw = m[3]
        _imply(stack, name)
        node: list = [name, attributes(raw) if raw and not raw.isspace() else {}, []]
        stack[-1][2].append(node)
        if name in RAW and not (raw or "").endswith("/"):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            inner = html[at : close.start() if close else n]
            if inner:
                node[2].append(inner)
            at = close.end() if close else n
        elif name not in VOID:
            if len(stack) < DEPTH:
                stack.append(node)
            else:
                flat[name] = flat.get(name, 0) + 1
    return root


def _imply(stack: list, name: str) -> None:
    """Close what the start of `name` ends: an open paragraph, or an earlier list item or cell."""
    if name in SIBLINGS:
        ends, walls = SIBLINGS[name]
        last = 0
        for i in range(len(stack) - 1, 0, -1):
            tag = stack[i][0]
            if tag in walls:
                break
            if tag in ends:
                last = i
        if last:
            del stack[last:]
            return
    if name in CLOSES_P:
        for i in range(len(stack) - 1, 0, -1):
            tag = stack[i][0]
            if tag == "p":
                del stack[i:]
                return
            if tag in WALLS:
                return


def _close(stack: list, name: str) -> None:
    block = name in BLOCK
    for i in range(len(stack) - 1, 0, -1):
        tag = stack[i][0]
        if tag == name:
            del stack[i:]
            return
        if (not block and tag in BLOCK) or (name in ("p", "li", "dd", "dt") and tag in WALLS):
            return
