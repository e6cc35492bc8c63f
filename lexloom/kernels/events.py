"""Text of HTML without Markdown: a walk over the parser's events, which keeps no tree, so that depth does not matter."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from html.parser import HTMLParser

from .html import _CLOSES_P, _SKIP, _VOID

#: Elements that begin a line of their own, and those with a blank line around them. Fixed values.
_LINES = _CLOSES_P | frozenset("html body li title option legend caption thead tbody tfoot summary details fieldset".split())
_APART = frozenset("p".split())
_CELLS = frozenset("td th".split())
_HIDDEN = _SKIP | {"title"}


class _Walk(HTMLParser):
    """Collects pieces: one for each element of the split tags, from its start to the next start or end of such an element, and
    one without a name for what is between them."""

    def __init__(self, tags: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.tags, self.pieces = tags, []
        self.name, self.text, self.breaks, self.space = "", [], 0, False
        self.open, self.counts, self.skipped, self.pre = [], Counter(), 0, 0

    def cut(self, name: str) -> None:
        text = "".join(self.text).strip()
        if text or self.name:
            self.pieces.append((self.name, text))
        self.name, self.text, self.breaks, self.space = name, [], 0, False

    def line(self, n: int) -> None:
        self.breaks = max(self.breaks, n)

    def say(self, text: str) -> None:
        if self.text and self.breaks:
            self.text.append("\n" * self.breaks)
        elif self.text and self.space:
            self.text.append(" ")
        self.breaks, self.space = 0, False
        self.text.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P and self.counts["p"] and self.open and self.open[-1] == "p" or tag == "li" and self.open and self.open[-1] == "li":
            self.handle_endtag(self.open[-1])
        if tag in self.tags and not self.skipped:
            self.cut(tag)
        if tag == "br":
            self.say("\n") if self.text else None
            self.space = False
        elif tag in _LINES:
            self.line(2 if tag in _APART else 1)
        elif tag in _CELLS and self.text and not self.breaks:
            self.say("\t")
        if tag not in _VOID:
            self.open.append(tag)
            self.counts[tag] += 1
            self.skipped += tag in _HIDDEN
            self.pre += tag == "pre"
        elif tag in self.tags and not self.skipped:
            self.cut("")

    def handle_endtag(self, tag):
        if not self.counts[tag]:
            return
        while True:
            last = self.open.pop()
            self.counts[last] -= 1
            self.skipped -= last in _HIDDEN
            self.pre -= last == "pre"
            if last in _LINES:
                self.line(2 if last in _APART else 1)
            if last in self.tags and not self.skipped:
                self.cut("")
            if last == tag:
                return

    def handle_data(self, data):
        if self.skipped:
            return
        if self.pre:
            self.say(data) if data else None
            return
        for i, word in enumerate(re.split(r"[ \t\n\r\f]+", data)):
            self.space |= i > 0
            if word:
                self.say(word)


def tag_texts(html: str | None, tags: Sequence[str] = ("h1", "h2", "h3", "p")) -> list[tuple[str, str]]:
    """(tag, text) of the elements of some tags and of what is between them, in order, trimmed; pieces that are empty and have no
    tag are left out. An element inside another one ends the outer one's piece; what follows it has no tag."""
    walk = _Walk(frozenset(t.lower() for t in tags))
    walk.feed(html or "")
    walk.close()
    walk.cut("")
    return walk.pieces


def plain_text(html: str | None) -> str:
    """The text of a page, with line breaks where its elements have them."""
    return "\n".join(t for _, t in tag_texts(html, ()))
