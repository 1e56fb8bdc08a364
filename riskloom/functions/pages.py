"""Text of a page by its element tree, in one pass over the markup.

The reader keeps the open elements as a stack, with the places of each name in it, so a start or end tag is dealt with
in steps that do not depend on how deep the stack is, and every element is left once. Nothing is looked for twice: a
tag, comment or raw text that has no end takes the rest of the page, as it does in a browser.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html.entities import name2codepoint

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

# The reader travels inside the tasks, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements whose content is not prose, and elements that end a piece of text.
SILENT = frozenset("head script style code pre".split())
BLOCKS = frozenset(
    "p div article section main body html header footer nav aside h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
    "table thead tbody tr td th blockquote figure form br hr".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is text up to their own end tag.
_RAW = frozenset("script style title textarea".split())
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Start tags that end an open paragraph.
_ENDS_PARAGRAPH = (BLOCKS | {"pre"}) - {"body", "html", "li", "dt", "dd", "thead", "tbody", "tr", "td", "th", "br"}
#: Elements that a start tag ends, if they are open inside what keeps them apart.
_ENDS = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "tr": (("tr",), ("table",)),
    "option": (("option",), ("select",)), "thead": (("tr", "tbody"), ("table",)),
    "tbody": (("tr", "thead", "tbody"), ("table",))}
#: End tags and paragraphs do not reach beyond these, apart from the tables' own.
_BARRIERS = ("td", "th", "table", "caption", "object", "button")
_OF_TABLE = frozenset("table thead tbody tr td th caption".split())
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: The rest of a tag: a quote counts only as the beginning of a value.
_TAG_REST = re.compile(r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|(?=[^"']))[^>=]*+)*+>""")
_REFERENCE = re.compile(r"&(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z][A-Za-z0-9]*));")


def _resolved(found: re.Match) -> str:
    decimal, hexadecimal, name = found.groups()
    if name:
        return chr(name2codepoint[name]) if name in name2codepoint else found[0]
    code = int(decimal) if decimal else int(hexadecimal, 16)
    return chr(code) if 0 < code < 0xD800 or 0xE000 <= code <= 0x10FFFF else "�"


def squeezed(text: str) -> str:
    """References resolved once, white space runs as one blank, none at the ends."""
    return " ".join((_REFERENCE.sub(_resolved, text) if "&" in text else text).split())


class _Tree:
    """The open elements. ``code`` is open until its own end tag, as formatting is; others end with what holds them."""

    def __init__(self):
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.silent = 0
        self.listings = 0

    def last(self, *names: str) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def push(self, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.silent += name in SILENT

    def cut(self, size: int) -> None:
        while len(self.names) > size:
            name = self.names.pop()
            self.places[name].pop()
            self.silent -= name in SILENT

    def start(self, name: str) -> None:
        if self.last("head") >= 0 and name not in _IN_HEAD and name != "head":
            self.cut(self.last("head"))
        if name in _ENDS_PARAGRAPH and self.last("p") > self.last(*_BARRIERS):
            self.cut(self.last("p"))
        if name in _ENDS:
            ended, apart = _ENDS[name]
            if (at := self.last(*ended)) > self.last(*apart):
                # Of several, all go: a row's cells with the row.
                self.cut(min(self.places[n][-1] for n in ended if self.places.get(n) and self.places[n][-1] > self.last(
                    *apart)) if at >= 0 else at)
        if name == "code":
            self.listings += 1
        elif name not in _VOID:
            self.push(name)

    def end(self, name: str) -> None:
        if name == "code":
            self.listings = max(0, self.listings - 1)
            return
        at = self.last(name)
        if at >= 0 and at >= self.last(*(("table",) if name in _OF_TABLE else _BARRIERS)):
            self.cut(at)

    @property
    def quiet(self) -> bool:
        return self.silent > 0 or self.listings > 0


def _parts(html: str) -> Iterator[tuple[str, bool]]:
    """Text and tag names of what is not silent: (text, False), (name, True)."""
    tree, at, size = _Tree(), 0, len(html)
    while at < size:
        tag = html.find("<", at)
        if tag < 0:
            tag = size
        if tag > at and not tree.quiet:
            yield html[at:tag], False
        if tag == size:
            return
        if html.startswith("<!--", tag):
            end = html.find("-->", tag + 4)
            at = end + 3 if end >= 0 else size
            continue
        closing = html.startswith("/", tag + 1)
        name = _NAME.match(html, tag + 1 + closing)
        if not name:
            if closing or html[tag + 1:tag + 2] in ("!", "?"):
                end = html.find(">", tag)
                at = end + 1 if end >= 0 else size
            else:
                if not tree.quiet:
                    yield "<", False
                at = tag + 1
            continue
        rest = _TAG_REST.match(html, name.end())
        if not rest:
            return
        at, element = rest.end(), name[0].lower()
        before = tree.quiet
        (tree.end if closing else tree.start)(element)
        # A listing's own tags say nothing; a tag that ends one by standing outside of it does.
        if not tree.quiet and not (before and element in SILENT):
            yield element, True
        if element in _RAW and not closing:
            end = re.compile(rf"</{element}(?=[\s/>])", re.IGNORECASE).search(html, at)
            stop = end.start() if end else size
            if not tree.quiet:
                yield html[at:stop], False
            at = stop


def read(html: str) -> tuple[list[str], str]:
    """The pieces between block elements, longer than 10 characters, and all text on one line."""
    pieces, piece, body = [], [], []

    def ended() -> None:
        if len(text := squeezed("".join(piece))) > 10:
            pieces.append(text)
        piece.clear()

    for part, tag in _parts(html):
        if not tag:
            piece.append(part)
            body.append(part)
        else:
            body.append(" ")
            if part in BLOCKS:
                ended()
    ended()
    return pieces, squeezed("".join(body))


def page_text(html: Column) -> Column:
    """The pieces, one per line; all text where there is none; null for null."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def chosen(page: str) -> str:
            pieces, body = read(page)
            return "\n".join(pieces) or body

        for batch in batches:
            yield pd.Series([None if page is None else chosen(page) for page in batch], dtype=object)

    return text(html)


def page_body(html: Column) -> Column:
    """All text on one line; null for null."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if page is None else read(page)[1] for page in batch], dtype=object)

    return text(html)
