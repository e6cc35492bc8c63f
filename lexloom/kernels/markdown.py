"""Block structure of Markdown (CommonMark with tables and footnotes): nodes with code point ranges (from 1, inclusive)."""

from __future__ import annotations

import re
from typing import NamedTuple

_ATX = re.compile(r"(#{1,6})(?:[ \t]+|$)")
_SETEXT = re.compile(r"(=+|-+)[ \t]*$")
_FENCE = re.compile(r"(`{3,}(?=[^`]*$)|~{3,})")
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_MARK = re.compile(r"([-+*]|(\d{1,9})([.)]))(?=[ \t]|$)")
_NOTE = re.compile(r"\[\^[^\]\s]+\]:[ \t]*")
_DEFINITION = re.compile(r"\[(?!\^)[^\[\]]*[^\[\]\s][^\[\]]*\]:[ \t]*(?:<[^<>]*>|[^\s<]\S*)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
_DELIMITERS = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_CELL = re.compile(r"(?:\\.|[^|\\]|\\$)*+")
#: Elements that start a block of HTML. Fixed values.
_HTML_BLOCKS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p "
    "param search section summary table tbody td tfoot th thead title tr track ul"
)
#: Starts of HTML blocks -> what ends them; None: a blank line. The last can't interrupt a paragraph.
_HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{'|'.join(_HTML_BLOCKS.split())})(?:\s|/?>|$)", re.I), None),
    (re.compile(r"(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$"), None),
]


class Node(NamedTuple):
    kind: str  # heading, paragraph, code_block, html_block, thematic_break, block_quote, list, item, table, table_row, table_cell, footnote_definition
    tag: str  # of its HTML element; '' for paragraphs of tight lists, HTML and footnotes
    start: int
    end: int
    level: int  # of headings with marks: their number; 0 else


class Block(NamedTuple):
    kind: str  # heading, paragraph or code_block
    start: int
    end: int
    level: int


class _Open:
    """A container or leaf that is not closed yet."""

    def __init__(self, order: int, kind: str, tag: str, start: int, **more):
        self.order, self.kind, self.tag, self.start = order, kind, tag, start
        self.loose = self.child = False
        self.__dict__ |= more


def _spaces(line: str, at: int, col: int, most: int = 1 << 30) -> tuple[int, int]:
    """Position and column after white space from `at` on, at most so many columns (a tab is taken whole)."""
    end = col + most
    while at < len(line) and line[at] in " \t" and col < end:
        col += 4 - col % 4 if line[at] == "\t" else 1
        at += 1
    return at, col


def _cells(row: str) -> list[tuple[int, int]]:
    """(start, end) of the trimmed cells of a table's row; pipes after a backslash are no borders."""
    at, end = len(row) - len(row.lstrip()), len(row.rstrip())
    at += row.startswith("|", at)
    out = []
    while at < end:
        stop = min(_CELL.match(row, at, end).end(), end)
        cell = row[at:stop]
        first = at + len(cell) - len(cell.lstrip()) if cell.strip() else at
        out.append((first, first + len(cell.strip())))
        at = stop + 1
    return out


class _Walk:
    """One pass over the lines with a stack of open containers and at most one open leaf."""

    def __init__(self, footnotes: bool):
        self.footnotes = footnotes
        self.stack: list[_Open] = []
        self.leaf: _Open | None = None
        self.out: list[tuple] = []  # start, -end, order, kind, tag, level, list of a paragraph in an item
        self.last = self.order = 0  # end of the last line with content
        self.gap = False  # a blank line came since

    def emit(self, o: _Open, end: int, level: int = 0) -> None:
        self.out.append((o.start, -end, o.order, o.kind, o.tag, level, getattr(o, "owner", None)))

    def new(self, kind: str, tag: str, start: int, **more) -> _Open:
        """A child of the deepest container; blank lines between children make a list loose."""
        self.order += 1
        up = self.stack[-1] if self.stack else None
        if up:
            if self.gap and up.child and up.kind in ("item", "list"):
                (up if up.kind == "list" else self.stack[-2]).loose = True
            up.child = True
        return _Open(self.order, kind, tag, start, **more)

    def shut_leaf(self) -> None:
        leaf, self.leaf = self.leaf, None
        if leaf is None:
            return
        if leaf.kind == "paragraph":
            while leaf.lines and _DEFINITION.match(leaf.lines[0][1]):
                leaf.lines.pop(0)
            if not leaf.lines:
                return
            leaf.start = leaf.lines[0][0]
        self.emit(leaf, leaf.end)

    def shut(self, keep: int, mark: str | None = None) -> None:
        """Closes the leaf and the containers above `keep`; and a list there that doesn't go on with an item of this mark."""
        self.shut_leaf()
        while len(self.stack) > keep:
            self.emit(self.stack.pop(), self.last)
        if self.stack and self.stack[-1].kind == "list" and self.stack[-1].mark != mark:
            self.emit(self.stack.pop(), self.last)

    def within(self, line: str) -> tuple[int, int, int]:
        """How many open containers go on in this line, and position and column after their marks."""
        at = col = kept = 0
        to, tocol = _spaces(line, at, col)
        for c in self.stack:
            if at > to:
                to, tocol = _spaces(line, at, col)
            blank, indent = to == len(line), tocol - col
            if c.kind == "block_quote":
                if blank or indent > 3 or line[to] != ">":
                    break
                at, col = _spaces(line, to + 1, tocol + 1, 1)
            elif c.kind != "list":
                if not (c.child if blank else indent >= c.indent):
                    break
                at, col = _spaces(line, at, col, c.indent)
            kept += 1
        return kept, at, col

    def row(self, here: int, line: str, at: int, cell: str) -> None:
        """A row of the open table."""
        body = line[at:].rstrip()
        begin = here + at + len(body) - len(body.lstrip())
        for kind, tag, start, end in [("table_row", "tr", begin, here + at + len(body)), *(("table_cell", cell, here + at + a, here + at + z) for a, z in _cells(body))]:
            self.order += 1
            self.emit(_Open(self.order, kind, tag, start), end)

    def table(self, here: int, line: str, at: int) -> bool:
        """Whether the open paragraph's last line and this one start a table; then it is open."""
        if not ("|" in line or "|" in self.leaf.lines[-1][1]) or not _DELIMITERS.match(line, at):
            return False
        begin, head = self.leaf.lines[-1]
        if len(_cells(head)) != len(_cells(line[at:])):
            return False
        self.leaf.lines.pop()
        if self.leaf.lines:
            a, x = self.leaf.lines[-1]
            self.leaf.end = a + len(x)
        self.shut_leaf()
        self.leaf = self.new("table", "table", begin, end=here + len(line.rstrip()))
        self.row(begin, head, 0, "th")
        return True

    def goes_on(self, here: int, line: str, at: int, col: int) -> bool:
        """Whether the open leaf, whose containers all go on, takes the line by itself."""
        leaf = self.leaf
        to, tocol = _spaces(line, at, col)
        if leaf.kind == "code_block" and leaf.fence:
            m = _FENCE.match(line, to) if tocol - col < 4 else None
            self.last = leaf.end = here + len(line)
            if m and m[1][0] == leaf.fence[0] and len(m[1]) >= len(leaf.fence) and not line[m.end() :].strip():
                self.shut_leaf()
            return True
        if leaf.kind == "html_block" and (leaf.until or to < len(line)):
            self.last = leaf.end = here + len(line.rstrip())
            if leaf.until and leaf.until.search(line, at):
                self.shut_leaf()
            return True
        if leaf.kind == "code_block":
            if to < len(line) and tocol - col >= 4:
                self.last = leaf.end = here + len(line)
                return True
            return to == len(line)
        return False

    def opens(self, here: int, line: str, kept: int, at: int, col: int) -> tuple[int, int, bool, bool]:
        """Opens what starts in the line: position, column, whether something did, and whether the line is used up."""
        opened, no_rule, last = False, "", len(line.rstrip())
        while True:
            to, tocol = _spaces(line, at, col)
            if to == len(line) or tocol - col > 3:
                return at, col, opened, False
            begin, end, ch = here + to, here + last, line[to]
            para = self.leaf is not None and self.leaf.kind == "paragraph" and not opened and kept == len(self.stack)
            keep = len(self.stack) if opened else kept
            if ch == ">":
                self.shut(keep)
                self.stack.append(self.new("block_quote", "blockquote", begin))
                at, col = _spaces(line, to + 1, tocol + 1, 1)
            elif m := _ATX.match(line, to):
                self.shut(keep)
                self.emit(self.new("heading", f"h{len(m[1])}", begin), end, len(m[1]))
                return at, col, True, True
            elif m := _FENCE.match(line, to):
                self.shut(keep)
                self.leaf = self.new("code_block", "pre", begin, end=here + len(line), fence=m[1])
                return at, col, True, True
            elif ch == "<" and (until := next((u for i, (p, u) in enumerate(_HTML) if p.match(line, to) and not (i == 6 and self.leaf is not None and self.leaf.kind == "paragraph" and not opened)), ch)) != ch:
                self.shut(keep)
                self.leaf = self.new("html_block", "", begin, end=end, until=until)
                if until and until.search(line, to):
                    self.shut_leaf()
                return at, col, True, True
            elif para and (m := _SETEXT.match(line, to)) and not all(_DEFINITION.match(x) for _, x in self.leaf.lines):
                leaf, self.leaf = self.leaf, None
                leaf.kind, leaf.tag, leaf.owner = "heading", "h1" if m[1][0] == "=" else "h2", None
                self.emit(leaf, end)
                return at, col, True, True
            elif ch in "*-_" and ch not in no_rule and _RULE.match(line, to):
                self.shut(keep)
                self.emit(self.new("thematic_break", "hr", begin), end)
                return at, col, True, True
            elif self.footnotes and not para and (m := _NOTE.match(line, to)):
                self.shut(keep)
                self.stack.append(self.new("footnote_definition", "", begin, indent=4))
                at, col = m.end(), tocol + m.end() - to
            elif (m := _MARK.match(line, to)) and not (para and (not line[m.end() :].strip() or m[2] and int(m[2]) != 1)):
                mark = m[3] or m[1]
                after = tocol + len(m[1])
                body, bodycol = _spaces(line, m.end(), after)
                wide = 1 if body == len(line) or bodycol - after > 4 else bodycol - after
                self.shut(keep, mark)
                if not self.stack or self.stack[-1].kind != "list":
                    self.stack.append(self.new("list", "ol" if m[2] else "ul", begin, mark=mark))
                self.stack.append(self.new("item", "li", begin, indent=after + wide - col))
                at, col = _spaces(line, m.end(), after, wide)
                no_rule += ch  # what follows is no rule of this mark either
            else:
                return at, col, opened, False
            opened = True

    def line(self, here: int, line: str) -> None:
        if not line and self.gap and self.leaf is None:
            return
        kept, at, col = self.within(line)
        whole = kept == len(self.stack)
        if self.leaf and whole and self.goes_on(here, line, at, col):
            return
        to, tocol = _spaces(line, at, col)
        if to == len(line):
            self.shut(kept, self.stack[kept - 1].mark if kept and self.stack[kept - 1].kind == "list" else None)
            self.gap = True
            return
        at, col, opened, used = self.opens(here, line, kept, at, col)
        to, tocol = _spaces(line, at, col)
        end = here + len(line.rstrip())
        if used or to == len(line):
            pass
        elif self.leaf and self.leaf.kind == "table" and whole and not opened:
            self.row(here, line, to, "td")
            self.leaf.end = end
        elif self.leaf and self.leaf.kind == "paragraph" and not opened:
            if not (whole and tocol - col < 4 and self.table(here, line, to)):
                self.leaf.lines.append((here + to, line[to:].rstrip()))
                self.leaf.end = end
        else:
            self.shut(len(self.stack) if opened else kept)
            up = self.stack[-1] if self.stack else None
            if tocol - col > 3:
                self.leaf = self.new("code_block", "pre", here + to, end=here + len(line), fence=None)
            else:
                owner = self.stack[-2] if up and up.kind == "item" else None
                self.leaf = self.new("paragraph", "p", here + to, end=end, lines=[(here + to, line[to:].rstrip())], owner=owner)
        self.last, self.gap = here + len(line.rstrip()), False


def nodes(text: str, footnotes: bool = True) -> list[Node]:
    """The block nodes of a document with line feeds only, by start, containers before what they hold. A range goes from the
    first mark to the end of the last line with content; empty text has no nodes. Definitions of links are no nodes."""
    walk, here = _Walk(footnotes), 0
    for line in text.split("\n") if text else []:
        walk.line(here, line)
        here += len(line) + 1
    walk.shut(0)
    found = sorted(walk.out, key=lambda x: x[:3])
    return [Node(kind, "" if owner and not owner.loose else tag, start + 1, -end, level) for start, end, _, kind, tag, level, owner in found]


def blocks(text: str) -> list[Block]:
    """The headings, paragraphs and code blocks of a document, in order, those inside lists and quotes too. Underlined
    headings have level 0."""
    return [Block(n.kind, n.start, n.end, n.level) for n in nodes(text) if n.kind in ("heading", "paragraph", "code_block")]


def segments(text: str, tags: list[str], trim: bool = False, omit_empty: bool = False) -> list[tuple[str, str]]:
    """(tag, text) pieces of a document cut where elements of the tags (h1..h6, p, pre, blockquote, ul, ol, li, table, tr, th, td,
    hr) start and end. A piece has the tag of the outermost of them that starts with it, or ''.

    Empty pieces at either end are dropped; omit_empty drops all that are empty and have no tag.
    """
    found = [n for n in nodes(text, footnotes=False) if n.tag in tags and n.tag]
    tag_of: dict[int, str] = {}
    for n in found:
        tag_of.setdefault(n.start - 1, n.tag)
    cuts = sorted({*tag_of, *(n.end for n in found)})
    bounds = [0, *cuts, len(text)]
    out = [(tag_of.get(a, "") if i else "", text[a:b]) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    ends = {i for i in (0, len(out) - 1) if not out[i][1]}
    if trim:
        out = [(t, x.strip()) for t, x in out]
    return [(t, x) for i, (t, x) in enumerate(out) if ((t or x) if omit_empty else i not in ends)]
