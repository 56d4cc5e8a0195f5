"""Small HTML reader used inside Spark tasks (stdlib ``html.parser`` only).

It builds a light element tree and renders text the way a browser's
``innerText`` does for simple pages: text outside script/style/template,
blanks collapsed, block elements on their own lines, two line breaks around
paragraphs, ``<br>`` as a line break. Tree rules: void elements have no
content; a new paragraph or block closes an open paragraph; an element left
unclosed ends where its parent ends.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style template noscript head title".split())
BLOCK = frozenset(("address article aside blockquote body dd details dialog div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table "
                   "tbody thead tfoot tr ul html").split())
CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "tbody", "thead", "tfoot", "tr"}
# The elements the extension reads as headings and as styled text.
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
STYLED_TAGS = ("em", "mark", "cite", "dfn", "i", "strong", "b", "u")
# End of fixed values.

_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "children", "order")

    def __init__(self, tag: str, order: int):
        self.tag = tag
        self.children: list = []
        self.order = order


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", -1)
        self.stack = [self.root]
        self.open: Counter = Counter()  # open elements by tag: no scan of the stack for an absent tag
        self.count = 0
        self.elements: list[Node] = []

    def _close(self, tag: str) -> None:
        """Pop up to the innermost open ``tag``; each element is pushed and popped once."""
        if not self.open[tag]:
            return
        while True:
            closed = self.stack.pop().tag
            self.open[closed] -= 1
            if closed == tag:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close("p")
        if tag == "li":
            self._close("li")
        node = Node(tag, self.count)
        self.count += 1
        self.elements.append(node)
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        node = Node(tag, self.count)
        self.count += 1
        self.elements.append(node)
        self.stack[-1].children.append(node)

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def parse(html: str) -> _TreeBuilder:
    b = _TreeBuilder()
    b.feed(html or "")
    b.close()
    return b


def inner_text(node: Node) -> str:
    """Rendered text of ``node`` (see module notes)."""
    items: list = []
    todo: list = node.children[::-1]  # nodes and texts still to visit; an int is a required break
    while todo:
        n = todo.pop()
        if isinstance(n, (str, int)):
            items.append(n)
        elif n.tag == "br":
            items += (1, "\n")
        elif n.tag not in SKIP:
            req = 2 if n.tag == "p" else (1 if n.tag in BLOCK else 0)
            if req:
                items.append(req)
                todo.append(req)
            todo.extend(reversed(n.children))
    # merge text runs, collapse blanks, then resolve required line breaks
    out: list[str] = []
    pending = 0
    buf: list[str] = []

    def flush():
        nonlocal pending
        if not buf:
            return
        text = "".join(buf)
        buf.clear()
        lines = text.split("\n")
        parts = [_SPACE.sub(" ", ln) for ln in lines]
        text = "\n".join(parts)
        if not text.strip(" "):
            if "\n" not in text:
                return
        if out and pending:
            out.append("\n" * pending)
        pending = 0
        out.append(text)

    for it in items:
        if isinstance(it, int):
            flush()
            pending = max(pending, it) if out else 0
        else:
            buf.append(it)
    flush()
    text = "".join(out)
    return "\n".join(ln.strip(" ") for ln in text.split("\n")).strip("\n")


def page_fields(html: str) -> tuple[str | None, str, list[str], list[str]]:
    """(title, body text, heading texts, styled texts) of one page, in document order."""
    tree = parse(html)
    title = None
    body = None
    heads, styled = [], []
    for el in tree.elements:
        if el.tag == "title" and title is None:
            title = "".join(c for c in el.children if isinstance(c, str)) or None
        elif el.tag == "body" and body is None:
            body = el
        elif el.tag in HEADING_TAGS:
            heads.append(inner_text(el))
        elif el.tag in STYLED_TAGS:
            styled.append(inner_text(el))
    texts = inner_text(body if body is not None else tree.root)
    return title, texts, heads, styled


def plain_text(html: str) -> str:
    """All text nodes joined without a separator (script and style content excluded)."""
    out: list[str] = []
    todo: list = [parse(html).root]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag not in ("script", "style"):
            todo.extend(reversed(n.children))
    return "".join(out)


class _Outline(HTMLParser):
    """Title and start-tag names; no tree."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.title: list[str] | None = None
        self.inside = False

    def handle_starttag(self, tag, attrs):
        self.tags.append(tag)
        if tag == "title" and self.title is None:
            self.title, self.inside = [], True

    def handle_startendtag(self, tag, attrs):
        self.tags.append(tag)

    def handle_endtag(self, tag):
        if tag == "title":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.title.append(data)


def outline(html: str) -> tuple[str | None, list[str]]:
    """(title, start-tag names in document order); the title is null when absent or empty."""
    o = _Outline()
    o.feed(html or "")
    o.close()
    return "".join(o.title or ()) or None, o.tags
