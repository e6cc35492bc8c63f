"""Overlapping chunks whose ends snap to boundaries, with the headings in whose scope they start."""

from __future__ import annotations

import math
from bisect import bisect_left

from .boundaries import line_feeds, sentence_starts, word_starts
from .markdown import blocks


def targets(length: int, size: float, overlap: float, breaks: list[int]) -> list[tuple[int, int]]:
    """(start, end) of evenly spaced ranges of `size` in each segment; the last one of a segment ends with it."""
    starts = sorted({1, *breaks})
    out = []
    for a, z in zip(starts, [*[s - 1 for s in starts[1:]], length]):
        last = z - size + 1
        if last < a:
            out.append((a, z))
            continue
        step = size * (1 - overlap)
        own = [round(a + i * step) for i in range(math.floor((last - a) / step + 1e-10) + 1)]
        if own[-1] != last:
            own.append(int(last))
        out += [(s, s + int(size) - 1) for s in own]
    return out


def snap(points: list[int], candidates: list[int], most: float) -> list[int | None]:
    """The nearest candidate of each point within `most`; of two equally near, the right one."""
    out: list[int | None] = []
    for p in points:
        i = bisect_left(candidates, p)
        near = [c for c in candidates[max(i - 1, 0) : i + 1] if abs(c - p) <= most]
        out.append(min(near, key=lambda c: (abs(c - p), -c)) if near else None)
    return out


def scope(headings: list[tuple[int, int, str]], at: int) -> list[str]:
    """Texts of the headings (start, level, text) over position `at`: of each level the last one before it, as far as
    the level is above that of a heading that starts there, or not below that of the last heading before."""
    before = [h for h in headings if h[0] < at]
    exact = [h[1] for h in headings if h[0] == at]
    most = exact[0] - 1 if exact else before[-1][1] if before else 99
    last = {h[1]: h for h in before}
    return [h[2] for _, h in sorted(last.items()) if 1 <= h[1] <= most]


def chunk(text: str, size: float | None = 1600, overlap: float = 0.5, max_snap: float | None = None, segment_levels: tuple[int, ...] = ()) -> list[tuple[int, int, str, str]]:
    """(start, end, context, text) of the chunks of a document, by start.

    size None: one chunk per segment. overlap must be at least 0 and below 1. An empty document has no chunks.
    """
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be at least 0 and below 1")
    if size is not None and size < 1:
        raise ValueError("size must be at least 1")
    size = math.inf if size is None else size
    if not text:
        return []
    most = size * (1 - overlap) / 3 if max_snap is None else max_snap
    found = blocks(text)
    headings = [(b.start, b.level, text[b.start - 1 : b.end]) for b in found if b.kind == "heading"]
    wanted = targets(len(text), size, overlap, [h[0] for h in headings if h[1] in segment_levels])
    points = sorted({p for s, e in wanted for p in (s, e + 1)})
    to: dict[int, int | None] = dict.fromkeys(points)
    to[points[0]], to[points[-1]] = 1, len(text) + 1
    kinds = (
        lambda: [h[0] for h in headings], lambda: sorted(b.start for b in found if b.kind != "heading"),
        lambda: sentence_starts(text), lambda: line_feeds(text), lambda: word_starts(text),
    )
    for candidates in kinds:
        left = [p for p in points if to[p] is None]
        if not left:
            break
        to.update(zip(left, snap(left, candidates(), most)))
    to = {p: p if t is None else t for p, t in to.items()}
    snapped = sorted(to.values())
    ranges = []
    for s, e in wanted:
        a, z = to[s], to[e + 1] - 1
        if a > z:  # both ends went to the same boundary: on to the next
            z = next((t for t in snapped if t > z + 1), 1) - 1
        ranges.append((a, z))
    widest = {}
    for a, z in ranges:
        widest[a] = max(z, widest.get(a, z))
    longest = {}
    for a, z in widest.items():
        longest[z] = min(a, longest.get(z, a))
    out = sorted((a, z) for z, a in longest.items())
    reach = 0
    for a, z in out:
        if a > reach + 1 or z < a:
            raise ValueError(f"characters {reach + 1} to {a - 1} are in no chunk")
        reach = max(reach, z)
    if reach != len(text):
        raise ValueError(f"characters from {reach + 1} on are in no chunk")
    return [(a, z, "\n".join(scope(headings, a)), text[a - 1 : z]) for a, z in out]
