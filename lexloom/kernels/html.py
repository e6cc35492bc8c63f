"""HTML to Markdown for articles: an event handler over the standard parser, with a subset of CSS selectors."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SKIP = frozenset("script style noscript template head".split())
_BLOCK = frozenset("p div section article main header footer nav aside ul ol table tr figure form address dl dt dd".split())
_CLOSES_P = _BLOCK | frozenset("h1 h2 h3 h4 h5 h6 pre blockquote hr li".split())


#: Containers that are nested deeper are passed over and what is in them belongs to the one at this depth, as browsers have it;
#: elements with a text of their own are kept for a few levels more.
DEPTH, MORE = 200, 20
_OWN = frozenset("h1 h2 h3 h4 h5 h6 p pre a code".split())


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", {}, None)
        self.depth, self.deeper, self.of = 0, [], Counter()

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P and self.now.tag == "p" or tag == "li" and self.now.tag == "li":
            self.leave(self.now, 1)
        if tag not in _VOID and self.depth >= DEPTH + MORE * (tag in _OWN):
            self.deeper.append((tag, self.depth))
            self.of[tag] += 1
            return
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(node)
        if tag not in _VOID:
            self.now, self.depth = node, self.depth + 1

    def handle_endtag(self, tag):
        if self.of[tag] and self.now.tag != tag:
            while True:
                last, _ = self.deeper.pop()
                self.of[last] -= 1
                if last == tag:
                    return
        at, up = self.now, 1
        while at.parent and at.tag != tag:
            at, up = at.parent, up + 1
        if at.parent:
            self.leave(at, up)

    def leave(self, node, up):
        """Goes up to the parent of a node; what was passed over inside it is closed too."""
        self.now, self.depth = node.parent, self.depth - up
        while self.deeper and self.deeper[-1][1] > self.depth:
            self.of[self.deeper.pop()[0]] -= 1

    def handle_data(self, data):
        self.now.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


_SIMPLE = re.compile(r"([#.]?)([\w-]+)|\[([\w-]+)(?:=[\"']?([^\]\"']*)[\"']?)?\]|\*")


def _fits(node: Node, simple: str) -> bool:
    for mark, name, attr, value in _SIMPLE.findall(simple):
        if attr:
            if attr not in node.attrs or value and node.attrs[attr] != value:
                return False
        elif mark == "#" and node.attrs.get("id") != name or mark == "." and name not in node.attrs.get("class", "").split() or not mark and name and node.tag != name:
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Nodes that match tag, .class, #id, [attr=value], descendants, children (>) and lists of these (,)."""
    out = []
    for node in root.walk():
        for one in selector.split(","):
            parts = re.sub(r"\s*>\s*", " > ", one.strip()).split()
            at, ok = node, bool(parts) and _fits(node, parts[-1])
            i = len(parts) - 2
            while ok and i >= 0:
                direct = parts[i] == ">"
                i -= direct
                at = at.parent
                while at is not None and at.tag and not _fits(at, parts[i]) and not direct:
                    at = at.parent
                ok = at is not None and bool(at.tag) and _fits(at, parts[i])
                i -= 1
            if ok:
                out.append(node)
                break
    return out


def _inline(node: Node) -> str:
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
        elif c.tag in _SKIP:
            continue
        else:
            x = _inline(c)
            mark = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`", "del": "~~", "s": "~~"}.get(c.tag)
            if c.tag == "br":
                out.append("\n")
            elif c.tag == "img":
                out.append(f"![{c.attrs.get('alt', '')}]({c.attrs.get('src', '')})")
            elif c.tag == "a" and c.attrs.get("href") and x.strip():
                out.append(f"[{x.strip()}]({c.attrs['href']})")
            elif mark and x.strip():
                out.append(f"{mark}{x.strip()}{mark}")
            else:
                out.append(x)
    return "".join(out)


def _plain(node: Node) -> str:
    return "".join(c if isinstance(c, str) else "\n" if c.tag == "br" else _plain(c) for c in node.children)


def _blocks(node: Node, out: list[str], depth: int = 0) -> None:
    held: list = []

    def flush() -> None:
        text = _inline(_holder(held)).strip()
        if text:
            out.append(text)
        held.clear()

    for c in node.children:
        tag = "" if isinstance(c, str) else c.tag
        if tag in _SKIP:
            continue
        if re.fullmatch("h[1-6]", tag):
            flush()
            out.append("#" * int(tag[1]) + " " + _inline(c).strip().replace("\n", " "))
        elif tag == "pre":
            flush()
            text = _plain(c).strip("\n")
            fence = "`" * max([3, *(len(m) + 1 for m in re.findall("`{3,}", text))])
            out.append(f"{fence}\n{text}\n{fence}")
        elif tag == "hr":
            flush()
            out.append("---")
        elif tag == "blockquote":
            flush()
            inner: list[str] = []
            _blocks(c, inner, depth)
            out.append("\n".join(("> " + x).rstrip() for x in "\n\n".join(inner).split("\n")))
        elif tag in ("ul", "ol"):
            flush()
            items = []
            for n, li in enumerate((x for x in c.children if isinstance(x, Node) and x.tag == "li"), 1):
                inner = []
                _blocks(li, inner, depth + 1)
                mark = "- " if tag == "ul" else f"{n}. "
                items.append(mark + "\n".join(inner).replace("\n", "\n" + " " * len(mark)))
            out.append("\n".join(items))
        elif tag == "table":
            flush()
            rows = [[_inline(cell).strip().replace("\n", " ").replace("|", r"\|") for cell in r.children if isinstance(cell, Node) and cell.tag in ("td", "th")] for r in c.walk() if r.tag == "tr"]
            rows = [r for r in rows if r]
            if rows:
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                out.append("\n".join([lines[0], "|" + " --- |" * len(rows[0]), *lines[1:]]))
        elif tag in _BLOCK or tag in ("html", "body", "li"):
            flush()
            _blocks(c, out, depth)
        else:
            held.append(c)
    flush()


def _holder(children: list) -> Node:
    n = Node("", {}, None)
    n.children = children
    return n


def to_markdown(html: str | None, extract: tuple[str, ...] = ("main",), zap: tuple[str, ...] = ("nav",)) -> str:
    """Markdown of a page. Each extract selector that matches narrows the page to its first match; all matches of the
    zap selectors are dropped. The page's title comes first as a heading, unless the text starts with it."""
    root = parse(html or "")
    title = next((_plain(n).strip() for n in root.walk() if n.tag == "title"), "")
    for s in extract:
        root = next(iter(select(root, s)), root)
    for s in zap:
        for n in select(root, s):
            n.parent.children = [c for c in n.parent.children if c is not n]
    out: list[str] = []
    _blocks(root, out)
    text = "\n\n".join(out).replace("\f", "\n\n---\n\n").strip()
    if title and not text.removeprefix("# ").startswith(title):
        text = f"# {title}\n\n{text}".rstrip()
    return text
