"""A small element tree over ``html.parser``, enough for the card selectors.

Tags and attributes are read without regard to case or quoting, entities are
decoded, an element ends at its own closing tag (or where HTML lets it end).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset("address article aside blockquote dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header li main nav ol p section table td th tr ul".split())
_SILENT = frozenset("script style template noscript head".split())
#: An opening tag that ends an open element of these.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Element]:
        """Descendants in document order."""
        stack = [iter(self.children)]
        while stack:
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
            elif isinstance(node, Element):
                yield node
                stack.append(iter(node.children))

    def first(self, test: Callable[[Element], bool]) -> Element | None:
        return next((e for e in self.walk() if test(e)), None)

    def get(self, name: str) -> str:
        return self.attrs.get(name) or ""

    def classes(self) -> list[str]:
        return self.get("class").split()

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def siblings_after(self) -> list[Element]:
        if self.parent is None:
            return []
        own = self.parent.elements()
        return own[own.index(self) + 1:]

    def ancestors(self) -> Iterator[Element]:
        e = self.parent
        while e is not None:
            yield e
            e = e.parent

    def text(self) -> str:
        """Rendered text: blanks collapsed, line breaks at ``br`` and blocks, stripped."""
        out: list[str] = []
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag == "br":
                out.append("\n")
            elif node.tag not in _SILENT:
                inside = [c if isinstance(c, Element) else re.sub(r"[ \t\n\r\f]+", " ", c) for c in node.children]
                if node.tag in _BLOCK and node is not self:
                    inside = ["\n", *inside, "\n"]
                stack.extend(reversed(inside))
        return re.sub(r"\n+", "\n", re.sub(r" *\n *", "\n", re.sub(r" {2,}", " ", "".join(out)))).strip()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.at.tag in _ENDS.get(tag, ()) or (self.at.tag == "p" and tag in _BLOCK):
            self.at = self.at.parent
        node = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.at.tag == tag and tag not in _VOID and tag in ("svg", "path"):
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        e = self.at
        while e is not None and e.tag != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Element:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root
