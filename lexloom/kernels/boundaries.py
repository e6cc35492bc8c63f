"""Boundaries in text: sentences, lines, words; and greedy cuts at them."""

from __future__ import annotations

import re
from bisect import bisect_right

#: Abbreviations after which a full stop ends no sentence. Fixed values.
ABBREVIATIONS = frozenset("mr mrs ms dr prof sr jr st vs etc e.g i.e inc ltd co corp fig no vol dept est approx bzw usw z.b d.h ca".split())
_SENTENCE = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*(\s+)|\n")
_BREAK = re.compile(r"\s+|(?<=[\w])[-–—]+(?=\w)")


def sentence_starts(text: str) -> list[int]:
    """Positions (from 1) where sentences start: after a terminator and space, not before a small letter nor after
    an abbreviation; and after line feeds."""
    out = [1] if text else []
    for m in _SENTENCE.finditer(text):
        if m[1] is not None and "\n" not in m[1]:
            if text[m.end() : m.end() + 1].islower():
                continue
            word = re.search(r"[\w.]*$", text[max(0, m.start() - 12) : m.start()])[0].lower()
            if text[m.start()] == "." and word in ABBREVIATIONS:
                continue
        if m.end() < len(text):
            out.append(m.end() + 1)
    return out


def word_starts(text: str) -> list[int]:
    """Positions where a line may be broken: after white space and after hyphens inside words."""
    return ([1] if text else []) + [m.end() + 1 for m in _BREAK.finditer(text) if m.end() < len(text)]


def line_feeds(text: str) -> list[int]:
    return [m.start() + 1 for m in re.finditer("\n", text)]


def cut_positions(candidates: list[int], size: int) -> list[int]:
    """Greedy: the first, then always the farthest candidate within size of the last one taken, or the next if none
    is; the last one always."""
    points = sorted(set(candidates))
    out, i = points[:1], 0
    while i < len(points) - 1:
        i = max(i + 1, bisect_right(points, out[-1] + size) - 1)
        out.append(points[i])
    return out


#: Boundary types of the recursive splitter -> positions after which a piece may end.
def ends(text: str, kind: str) -> list[int]:
    """Ends (from 1) of pieces by paragraph, line_break, sentence, word, character, or a regular expression."""
    if kind == "sentence":
        return [s - 1 for s in sentence_starts(text)[1:]]
    if kind == "word":
        return [s - 1 for s in word_starts(text)[1:]]
    if kind == "character":
        return list(range(1, len(text) + 1))
    pattern = {"paragraph": "\n\n", "line_break": "\n"}.get(kind, kind)
    return [m.end() for m in re.finditer(pattern, text) if m.end() > m.start()]


def split(text: str | None, size: int, boundaries: list[str], trim: bool = True) -> list[str | None]:
    """Pieces of at most about size characters, cut at the first boundary type; longer pieces again at the next.

    None stays None, and a text that fits stays as it is; empty pieces are dropped.
    """
    if text is None:
        return [None]
    if len(text) <= size or not boundaries:
        return [text]
    cuts = cut_positions([1, *ends(text, boundaries[0]), len(text)], size)
    if cuts[-1] != len(text):
        cuts.append(len(text))
    out: list[str | None] = []
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        piece = text[a if i else 0 : b]
        out += split(piece, size, boundaries[1:], trim)
    out = [x.strip() if trim and x is not None else x for x in out]
    return [x for x in out if x]


def pieces(text: str | None, kinds: list[str], trim: bool = False) -> list[str]:
    """The pieces of a text between all boundaries of the kinds, in order; together they are the text, unless trimmed."""
    if not text:
        return []
    at = sorted({0, len(text), *(e for k in kinds for e in ends(text, k))})
    out = [text[a:b] for a, b in zip(at, at[1:])]
    return [x for x in (x.strip() for x in out) if x] if trim else out


def packed(parts: list[str | None], size: int, glue: str = "") -> list[str]:
    """Neighbouring parts put together while they fit in size; a longer part stands alone. None and '' are left out."""
    out: list[str] = []
    for x in parts:
        if not x:
            continue
        if out and len(out[-1]) + len(glue) + len(x) <= size:
            out[-1] += glue + x
        else:
            out.append(x)
    return out
