"""A tolerant tree of HTML or XML, with normalised text and CSS selectors, on the standard library alone."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol "
    "option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_HEAD = frozenset("base link meta noscript script style title".split())
_RAW = frozenset(["script", "style"])
#: An opening tag ends these open ones, up to the given containers.
_CLOSES = {
    **{t: ({"p"}, {"td", "th", "li", "div", "body", "blockquote"}) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split()},
    "li": ({"li", "p"}, {"ul", "ol"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "p"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th", "p"}, {"tr"}), "th": ({"td", "th", "p"}, {"tr"}),
    **{t: ({"tr", "td", "th", "caption", "thead", "tbody", "tfoot", "p"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
}
_BLANKS = re.compile(r"[ \t\r\n\f]+")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag", "xml")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None, xml: bool = False):
        self.tag, self.attrs, self.parent, self.children, self.xml = tag, attrs or {}, parent, [], xml

    def add(self, child):
        if isinstance(child, str) and self.children and isinstance(self.children[-1], str):
            self.children[-1] += child
        else:
            self.children.append(child)
        return child

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def descendants(self):
        """Elements below this one in document order; without recursion, so depth doesn't matter."""
        todo = self.elements()[::-1]
        while todo:
            e = todo.pop()
            yield e
            todo += e.elements()[::-1]

    def find_all(self, *tags: str):
        return (e for e in self.descendants() if e.tag in tags)

    def text(self) -> str:
        """Text below this element, blanks collapsed, with a blank where a block begins or ends."""
        out: list[str] = []
        todo: list = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in _RAW:
                apart = x.xml or x.tag in BLOCK
                todo += [*([" "] if apart else []), *x.children[::-1], *([" "] if apart else [])]
        return _BLANKS.sub(" ", "".join(out)).strip()

    def selector(self) -> str:
        """By id where there is one, else by tag, classes and place among the parent's children."""
        parts = []
        e = self
        while e.parent is not None:
            if e.attrs.get("id"):
                parts.append("#" + e.attrs["id"])
                return " > ".join(parts[::-1])
            own = ".".join([e.tag.replace(":", "|"), *e.attrs.get("class", "").split()])
            parent = e.parent
            if parent.parent is not None:
                classes = set(e.attrs.get("class", "").split())
                siblings = parent.elements()
                alike = sum(1 for x in parent.descendants() if x.tag == e.tag and classes <= set(x.attrs.get("class", "").split())) if len(siblings) < 50 else 2
                if alike > 1:
                    own += f":nth-child({next(i for i, x in enumerate(siblings, 1) if x is e)})"
            parts.append(own)
            e = parent
        return " > ".join(parts[::-1]) or "#root"


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.html = self.root.add(Node("html", parent=self.root))
        self.head = self.html.add(Node("head", parent=self.html))
        self.body = self.html.add(Node("body", parent=self.html))
        self.at, self.in_body = self.head, False

    def _enter_body(self):
        if not self.in_body:
            self.at, self.in_body = self.body, True

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag in ("html", "head", "body"):
            {"html": self.html, "head": self.head, "body": self.body}[tag].attrs.update(attrs)
            if tag == "body":
                self._enter_body()
            return
        if not self.in_body and tag not in _HEAD:
            self._enter_body()
        if tag in _CLOSES:
            ends, within = _CLOSES[tag]
            e, last = self.at, None
            while e is not self.body and e is not self.head and e.tag not in within and e.parent is not None:
                if e.tag in ends:
                    last = e
                e = e.parent
            if last is not None:
                self.at = last.parent
        node = self.at.add(Node(tag, attrs, self.at))
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag not in ("html", "head", "body"):
            self.at = self.at.parent

    def handle_endtag(self, tag):
        if tag == "head":
            self._enter_body()
        if tag in ("html", "head", "body"):
            return
        e = self.at
        while e.tag not in ("body", "head") and e.parent is not None:
            if e.tag == tag:
                self.at = e.parent
                return
            e = e.parent

    def handle_data(self, data):
        if not self.in_body and self.at is self.head:
            if not data.strip():
                return
            self._enter_body()
        self.at.add(data)


def parse_html(source: str) -> Node:
    b = _Builder()
    b.feed(source)
    b.close()
    return b.root


def parse_xml(source: str) -> Node:
    """Well-formed XML as it is; anything else as tolerant HTML."""
    try:
        tree = ET.fromstring(source.encode("utf-8", "replace") if "encoding" not in source[:200] else re.sub(r'(<\?xml[^>]*?)\s+encoding=["\'][^"\']*["\']', r"\1", source, count=1).encode("utf-8", "replace"))
    except ET.ParseError:
        return parse_html(source)
    root = Node("#root", xml=True)
    _copy(tree, root)
    return root


def _copy(e, parent: Node) -> None:
    """Children in order with their tails, by a stack of iterators."""
    node = Node(e.tag.rpartition("}")[2] if isinstance(e.tag, str) else "#other", dict(e.attrib), parent, True)
    parent.children.append(node)
    if e.text:
        node.add(e.text)
    stack = [(iter(e), node)]
    while stack:
        it, here = stack[-1]
        child = next(it, None)
        if child is None:
            stack.pop()
            continue
        new = Node(child.tag.rpartition("}")[2] if isinstance(child.tag, str) else "#other", dict(child.attrib), here, True)
        here.children.append(new)
        if child.text:
            new.add(child.text)
        if child.tail:
            here.add(child.tail)
        stack.append((iter(child), new))


def parse(source: str) -> Node:
    """XML where the source declares itself so, else HTML."""
    return parse_xml(source) if source.lstrip("\ufeff \t\r\n").startswith("<?xml") else parse_html(source)


def body_of(root: Node) -> Node:
    return next(root.find_all("body"), root)


def title_of(root: Node) -> str:
    found = next(root.find_all("title"), None)
    return found.text() if found else ""
