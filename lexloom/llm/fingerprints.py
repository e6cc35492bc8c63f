"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into pieces at line ends and after words chosen by their hash, so that an edit changes only the pieces
that it touches. There are levels: pieces have about two words at level 0 and four times as many at each further one. A
fingerprint holds, from the finest level with at most MOST different pieces up to the level where the text is one piece, a sketch of
the set of piece digests: cells (count, sum of keys, sum of checks), three for each digest.

Two fingerprints are compared by themselves. The cells of the finest level that both have are subtracted, folded to a
small number; peeling takes pure cells out one after another until all digests that differ are recovered. Where it gets
stuck it is tried again with twice as many cells, up to the whole sketch, and then at the next level, whose sets are
smaller. The likeness is the Jaccard likeness of the two digest sets, from the recovered difference.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, text_of

#: Different pieces of the finest level of a fingerprint at most, of so many in all; the last level, which any text may have.
MOST, SEEN, LAST = 40, 2_048, 14
#: Up to this level each line end ends a piece; further on it takes a hash that as many words have at a level two finer.
LINE_LEVELS = 2
#: Cells in each of the three parts of a sketch at least, a power of two; only those that aren't empty are stored.
LEAST_PART = 64
HEAD = np.dtype([("level", "u1"), ("log_part", "u1"), ("n", "<u4"), ("cells", "<u4")])
CELL = np.dtype([("at", "<u2"), ("count", "<u2"), ("key", "<u8"), ("check", "<u4")])
#: Text bytes that are worked on at once in a task; words longer than LONG_WORD bytes are hashed by themselves.
CHUNK, LONG_WORD = 1 << 20, 1 << 16
#: Bytes of text for a range of ids, which one task reads in parts of CHUNK: RANGE_BYTES up to MANY_RANGES, then as many
#: more up to LARGE_RANGE, and then more ranges; inner ranges of a block of ranges.
RANGE_BYTES, MANY_RANGES, LARGE_RANGE, FAN = 8 << 20, 200_000, 512 << 20, 1_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64 bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and its inverse; those that a usual part of texts needs are kept."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    made = []
    for b in (_BASE, _INVERSE):
        x = np.full(max(n, 2 * CHUNK), b, np.uint64)
        x[0] = 1
        made.append(np.cumprod(x))
    if n <= 2 * CHUNK:
        _powers[:] = made
    return made[0], made[1]


def _windows(texts: list[bytes]) -> Iterator[tuple[bytes, int, int]]:
    """(bytes, first text, texts in them or 0 for a part of one): texts joined by line ends, long ones in several parts."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        if held and size + len(t) > CHUNK:
            yield b"\n".join(held), first, len(held)
            held, size = [], 0
        if len(t) > CHUNK:
            at = 0
            while at < len(t):
                m = re.compile(rb"[ \t-\r]").search(t, min(at + CHUNK, len(t)))
                end = m.end() if m else len(t)
                yield t[at:end], i, 0
                at = end
            continue
        if not held:
            first = i
        held.append(t)
        size += len(t)
    if held:
        yield b"\n".join(held), first, len(held)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, does a line end follow) of each word; words are what ASCII white space parts.

    Works on about CHUNK bytes at once, so that a text takes memory for its words, not many times its bytes.
    """
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for window, first, count in _windows(texts):
        data = np.frombuffer(window, np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        word = np.zeros(len(starts), np.uint64)
        usual = ends - starts <= LONG_WORD
        for i in np.flatnonzero(~usual).tolist():
            word[i] = int.from_bytes(hashlib.blake2b(window[starts[i] : ends[i]], digest_size=8).digest())
        if usual.all() and len(data) <= 4 * CHUNK:
            up, down = _powers_to(len(data) + 1)
            sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
            word = _mix((sums[ends] - sums[starts]) * down[starts])
        else:  # long words are rare: the others one by one
            for i in np.flatnonzero(usual).tolist():
                part = data[starts[i] : ends[i]].astype(np.uint64) + np.uint64(1)
                word[i] = _mix(np.array([(part * _powers_to(len(part))[0][: len(part)]).sum(dtype=np.uint64)]))[0]
        lines = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int32)])
        after = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
        owner = np.full(len(starts), first, np.int32)
        if count > 1:
            begin = np.cumsum([len(t) + 1 for t in texts[first : first + count]])
            owner = first + np.searchsorted(begin, starts, "right").astype(np.int32)
        parts.append((word, owner, lines[after] > lines[ends]))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*parts))


def pieces(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, texts that have a set there, owners, digests): of each level, the distinct digests by text, ascending.

    A text without words has none. Others have a set at each level from the finest with at most MOST different pieces (and
    SEEN in all) to the first with one piece.
    """
    word, owner, line = words_of(texts)
    up, down = _powers_to(len(word) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((word + np.uint64(1)) * up[: len(word)])])
    first = np.searchsorted(owner, np.arange(len(texts)))
    at, last = np.arange(len(word)), np.ones(len(word), bool)  # words that may end a piece; the last of its text
    last[:-1] = owner[1:] != owner[:-1]
    begun = np.zeros(len(texts), bool)
    for level in range(LAST + 1):
        cut = last[at] | (word[at] >> np.uint64(7) & np.uint64((2 << 2 * level) - 1) == 0)
        kind = np.uint64((2 << 2 * (level - 2)) - 1 if level > LINE_LEVELS else 0)
        cut |= line[at] & (word[at] >> np.uint64(7) & kind == 0)
        at = at[cut]
        of = owner[at]
        count = np.bincount(of, minlength=len(texts))
        now = ((count > 0) & (begun | (count <= SEEN) | (level == LAST)))[of]
        ends = at[now] + 1
        own = of[now]
        begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        fresh = np.ones(len(own), bool)
        fresh[1:] = own[1:] != own[:-1]
        begin = np.where(fresh, first[own], begin)
        digest = _mix((sums[ends] - sums[begin]) * down[begin] + (ends - begin).astype(np.uint64))
        order = np.lexsort((digest, own))
        digest, own = digest[order], own[order]
        new = np.ones(len(own), bool)
        new[1:] = (digest[1:] != digest[:-1]) | (own[1:] != own[:-1])
        own, digest = own[new], digest[new]
        different = np.bincount(own, minlength=len(texts))
        begun |= (different > 0) & ((different <= MOST) | (level == LAST))
        there = begun & (different > 0)
        if there.any():
            stays = there[own]
            yield level, np.flatnonzero(there), own[stays], digest[stays]
        at = at[count[of] > 1]
        if not len(at):
            return


def _check(keys: np.ndarray) -> np.ndarray:
    return _mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & np.uint64(0xFFFFFFFF)


def _slots(keys: np.ndarray, part: np.ndarray) -> list[np.ndarray]:
    """The cell of each key in each of three parts of `part` cells, a power of two: that of a part half as big is its rest."""
    return [j * part + (_mix(keys + np.uint64(j + 1)) & (part - 1).astype(np.uint64)).astype(np.int64) for j in range(3)]


class Sketch:
    """Sketches of many sets side by side; set i has three parts of part[i] cells from at[i] on."""

    def __init__(self, part: np.ndarray):
        self.part = np.asarray(part, np.int64)
        self.at = np.concatenate([[0], np.cumsum(3 * self.part)])
        n = int(self.at[-1])
        self.count, self.keys, self.checks = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    def add_cells(self, at: np.ndarray, count: np.ndarray, keys: np.ndarray, checks: np.ndarray, sign: int) -> None:
        np.add.at(self.count, at, count * sign)
        np.add.at(self.keys, at, keys if sign > 0 else np.uint64(0) - keys)
        np.add.at(self.checks, at, checks if sign > 0 else np.uint64(0) - checks)

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray | int = 1) -> None:
        sign = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        signed, checks = keys * sign.astype(np.uint64), _check(keys) * sign.astype(np.uint64)
        for slot in _slots(keys, self.part[owner]):
            cell = self.at[owner] + slot
            np.add.at(self.count, cell, sign)
            np.add.at(self.keys, cell, signed)
            np.add.at(self.checks, cell, checks)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys, owners, signs) recovered, and by set whether all was. Checks count by their lower 32 bits."""
        of_cell = np.repeat(np.arange(len(self.part)), 3 * self.part)
        low = np.uint64(0xFFFFFFFF)
        found = []
        live = np.flatnonzero(np.abs(self.count) == 1)
        while len(live):
            sign = self.count[live]
            keys = self.keys[live] * sign.astype(np.uint64)
            pure = (self.checks[live] * sign.astype(np.uint64)) & low == _check(keys)
            keys, owner, sign = keys[pure], of_cell[live[pure]], sign[pure]
            if not len(keys):
                break
            order = np.lexsort((keys, owner))
            keys, owner, sign = keys[order], owner[order], sign[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            keys, owner, sign = keys[new], owner[new], sign[new]
            self.add(keys, owner, -sign)
            found.append((keys, owner, sign))
            if len(found) > 64 + int(self.part.max()) * 3:  # a wrong key may come and go
                break
            touched = np.unique(np.concatenate([self.at[owner] + x for x in _slots(keys, self.part[owner])]))
            live = touched[np.abs(self.count[touched]) == 1]
        left = np.bincount(of_cell[(self.count != 0) | (self.keys != 0) | (self.checks & low != 0)], minlength=len(self.part))
        parts = [np.concatenate(x) if found else np.zeros(0, t) for x, t in zip(zip(*found) if found else [()] * 3, (np.uint64, np.int64, np.int64))]
        return (*parts, left == 0)


def _part(n: np.ndarray) -> np.ndarray:
    """Cells of a part for n digests: with twice as many or more, two digests seldom share all three cells."""
    return np.maximum(LEAST_PART, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))


def prints(texts: list[bytes]) -> list[str]:
    """The fingerprint of each text: number of levels, a head for each level, then the cells that aren't empty; base64."""
    head, body = [], []
    for level, which, owner, digest in pieces(texts):
        at = np.searchsorted(which, owner)
        n = np.bincount(at, minlength=len(which))
        s = Sketch(_part(n))
        s.add(digest, at)
        full = np.flatnonzero(s.count)
        of = np.searchsorted(s.at, full, "right") - 1
        h = np.zeros(len(which), HEAD)
        h["level"], h["log_part"], h["n"], h["cells"] = level, np.log2(s.part).round().astype(int), n, np.bincount(of, minlength=len(which))
        c = np.zeros(len(full), CELL)
        c["at"], c["count"], c["key"], c["check"] = full - s.at[of], s.count[full], s.keys[full], s.checks[full] & np.uint64(0xFFFFFFFF)
        head.append((which, h))
        body.append((which[of], c))
    levels, cells = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for which, h in head:
        levels[which] += 1
        cells[which] += h["cells"]
    heads, data = (b"", b"") if not head else tuple(np.concatenate([x for _, x in part])[np.argsort(np.concatenate([w for w, _ in part]), kind="stable")].tobytes() for part in (head, body))
    a, b = (np.concatenate([[0], np.cumsum(x)]).tolist() for x in (levels * HEAD.itemsize, cells * CELL.itemsize))
    return [base64.b64encode(bytes([int(levels[i])]) + heads[a[i] : a[i + 1]] + data[b[i] : b[i + 1]]).decode() for i in range(len(texts))]


class Prints:
    """Fingerprint strings as arrays: heads and cells of all of them, and where each begins."""

    def __init__(self, strings: list[str]):
        raw = [base64.b64decode(x) for x in strings]
        self.levels = np.array([x[0] for x in raw], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.levels)])
        self.head = np.frombuffer(b"".join(x[1 : 1 + x[0] * HEAD.itemsize] for x in raw), HEAD)
        self.cell = np.frombuffer(b"".join(x[1 + x[0] * HEAD.itemsize :] for x in raw), CELL)
        self.begin = np.concatenate([[0], np.cumsum(self.head["cells"].astype(np.int64))])
        self.n, self.log = self.head["n"].astype(np.int64), self.head["log_part"].astype(np.int64)
        some = self.levels > 0
        self.finest, self.coarsest = np.full(len(raw), -1), np.full(len(raw), -1)
        self.finest[some] = self.head["level"][self.first[:-1][some]]
        self.coarsest[some] = self.head["level"][self.first[1:][some] - 1]

    def at(self, which: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The head of each fingerprint at a level; beyond its coarsest it is that, the whole text as one piece."""
        return self.first[which] + np.minimum(level, self.coarsest[which]) - self.finest[which]

    def into(self, s: Sketch, sets: np.ndarray, heads: np.ndarray, sign: int) -> None:
        """Adds the cells of heads[i] to set sets[i] of s, folded to its size."""
        n = self.head["cells"][heads].astype(np.int64)
        owner = np.repeat(sets, n)
        c = self.cell[np.repeat(self.begin[heads] - (np.cumsum(n) - n), n) + np.arange(len(owner))]
        at, log, part = c["at"].astype(np.int64), np.repeat(self.log[heads], n), s.part[owner]
        slot = s.at[owner] + (at >> log) * part + (at & (part - 1))
        s.add_cells(slot, c["count"].astype(np.int64), c["key"].astype(np.uint64), c["check"].astype(np.uint64), sign)


def compare(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(likeness, level) of each pair of fingerprints, and (digest, pair, side) of what differs: side 1 is only in a, -1 in b.

    Two empty texts have likeness 1, an empty and another one 0 (all digests of the other differ). A pair that no level
    resolves has likeness 0 and level -1: at the last level both texts are single pieces, which differ.
    """
    x, y = Prints(a), Prints(b)
    out, level = np.zeros(len(a)), np.maximum(x.finest, y.finest)
    out[level < 0] = 1.0
    todo = np.flatnonzero(level >= 0)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = np.zeros(len(a), np.int64)  # cells of a part now; 0 at the start of a level
    while len(todo):
        some, heads, counts, logs = [], [], np.zeros((2, len(todo)), np.int64), np.full((2, len(todo)), 62)
        for k, z in enumerate((x, y)):
            there = z.levels[todo] > 0
            own = z.at(todo[there], level[todo[there]])
            counts[k, there], logs[k, there] = z.n[own], z.log[own]
            some.append(there)
            heads.append(own)
        most = 1 << np.minimum(logs[0], logs[1])
        fits = most >> 2
        size[todo] = np.where(size[todo] == 0, fits, np.minimum(2 * size[todo], most))
        s = Sketch(size[todo])
        for z, there, own, sign in ((x, some[0], heads[0], 1), (y, some[1], heads[1], -1)):
            z.into(s, np.flatnonzero(there), own, sign)
        keys, owner, sign, done = s.peel()
        ok = done[owner]
        found.append((keys[ok], todo[owner[ok]], sign[ok]))
        d = np.bincount(owner, minlength=len(todo))
        common = (counts.sum(0) - d) / 2
        out[todo[done]] = np.clip(common / np.maximum(counts.sum(0) - common, 1), 0, 1)[done]
        whole = size[todo] >= most
        top = np.maximum(x.coarsest[todo], y.coarsest[todo])
        end = ~done & whole & (level[todo] >= top)
        level[todo[end]] = -1
        nxt = todo[~done & whole & ~end]
        level[nxt] += 1
        size[nxt] = 0
        todo = todo[~done & ~end]
    parts = [np.concatenate(z) if found else np.zeros(0, t) for z, t in zip(zip(*found) if found else [()] * 3, (np.uint64, np.int64, np.int64))]
    return (out, level, *parts)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """The likeness of each pair of fingerprints, from nothing but the strings."""
    return compare(a, b)[0]


OUT = "doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """text, with its last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(ids: list, texts: list[str], following: str, kind: pa.DataType) -> pa.RecordBatch:
    """One row for each text; the text after the last is `following`."""
    new = [edited(a, b) for a, b in zip(texts, [*texts[1:], following])]
    plain, versions = prints([t.encode() for t in [*texts, following]]), prints([t.encode() for t in new])
    own = plain[:-1]
    rows = [pa.array(ids, kind), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]), pa.array(own), pa.array(versions), pa.array(likeness(own, versions)), pa.array(likeness(own, plain[1:]))]
    return pa.RecordBatch.from_arrays(rows, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _compare_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (range, id); the row after the last of a range is a guest from the next range."""
    ids: list = []
    texts: list[str] = []
    now, held, kind = None, 0, None
    for b in batches:
        kind = b.schema.field("id").type
        for pid, guest, i, t in zip(b.column("pid").to_pylist(), b.column("guest").to_pylist(), b.column("id").to_pylist(), b.column("text").to_pylist()):
            if pid != now:
                ids, texts, now, held = [], [], pid, 0  # what was left is a guest
            elif texts and (guest or held >= CHUNK):
                yield _compared(ids, texts, t, kind)
                ids, texts, held = [], [], 0
            if not guest:
                ids.append(i)
                texts.append(t)
                held += len(t)


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) per input row. Null texts count as empty; equal texts have equal fingerprints."""
    kind = docs.schema[id_col].dataType.simpleString()
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lo = [t.encode() for t in b.column("text").to_pylist()], 0
            while lo < len(texts):
                hi, held = lo, 0
                while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= CHUNK):
                    held += len(texts[hi])
                    hi += 1
                yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo), pa.array(prints(texts[lo:hi]), pa.string())], ["id", "fingerprint"])
                lo = hi

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, fingerprint string")


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, likeness, level, side, digest) of two tables (id, fingerprint) of versions: a row for each paragraph digest that
    peeling recovers, side ``before`` or ``after``, as 16 hex digits; a version pair that differs in nothing has one row
    without side and digest.

    Rows meet by id (null meets null). An id that only one table has is compared with the empty text. Of rows with the same
    id, the one with the greatest fingerprint counts. Level -1 marks pairs that no level resolves; they have no digests.
    Only fingerprints are shuffled. Empty tables give no rows.
    """
    kind = before.schema["id"].dataType.simpleString()
    one = lambda df, name: df.groupBy("id").agg(F.max("fingerprint").alias(name))
    old, new = one(before, "old"), one(after, "new").withColumnRenamed("id", "new_id")
    empty = F.lit(prints([b""])[0])
    both = old.join(new, F.col("id").eqNullSafe(F.col("new_id")), "full").select(F.coalesce("id", "new_id").alias("id"), F.coalesce("old", empty).alias("old"), F.coalesce("new", empty).alias("new"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2_000):
                part = b.slice(lo, 2_000)
                near, level, digest, pair, side = compare(part.column("old").to_pylist(), part.column("new").to_pylist())
                same = np.setdiff1d(np.arange(part.num_rows), pair)
                at = pa.array(np.concatenate([pair, same]))
                names = pa.array([f"{d:016x}" for d in digest.tolist()] + [None] * len(same), pa.string())
                sides = pa.array(["before" if x > 0 else "after" for x in side.tolist()] + [None] * len(same), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id").take(at), pa.array(near).take(at), pa.array(level.astype(np.int32)).take(at), sides, names], ["id", "likeness", "level", "side", "digest"])

    return both.mapInArrow(run, f"id {kind}, likeness double, level int, side string, digest string")


def compare_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with the likeness to the edited and the next text.

    Order: ascending ids (numbers; null ids first), ties by a hash of the text; the text after the last is the first. Null
    texts count as empty; two texts without words have likeness 1. A single row is followed by itself. Repeated rows
    follow each other. White space other than line ends doesn't count in pieces. An empty table gives no rows. A very long
    text takes memory for a few numbers a word, beside the text itself.

    The rows are dealt to ranges by approximate quantiles of (id, hash), so that rows with one id are dealt too. There are
    as many ranges as the bytes of text ask for, found in two steps. The first row of a range also goes, as a guest, to the
    range before, so that each range has what follows its last row.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    ready(spark)
    least = F.lit(-(1 << 63)).cast("long")
    h = F.shiftrightunsigned(F.xxhash64("text"), 12)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), least).alias("key"), text_of(text_col).alias("text")).withColumn("h", h)
    order = F.col("key").cast("double") + F.col("h").cast("double") / float(1 << 52)  # never falls as (key, h) rises
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0]
    schema = OUT.format(kind=kind)
    if size is None:
        return spark.createDataFrame([], schema)
    ranges = int(max(min(size // RANGE_BYTES, MANY_RANGES), size // LARGE_RANGE, 1))
    blocks = -(-ranges // FAN)
    inside = -(-ranges // blocks)
    v = rows.select(order.alias("v"))
    outer = F.array().cast("array<double>")
    if blocks > 1:
        found = v.agg(F.percentile_approx("v", [i / blocks for i in range(1, blocks)], 10 * blocks)).first()[0]
        outer = F.array(*[F.lit(float(x)) for x in sorted(set(found))])
    block = lambda c: F.size(F.filter(outer, lambda x: x <= c))
    inner = F.percentile_approx("v", [i / inside for i in range(1, inside)], 10 * inside) if inside > 1 else F.array().cast("array<double>")
    found = v.groupBy(block(F.col("v")).alias("b")).agg(inner.alias("cuts")).collect()  # a number for each range; quantiles found anew may differ
    cuts = F.broadcast(spark.createDataFrame(found, "b int, cuts array<double>"))
    placed = rows.withColumn("v", order).withColumn("block", block(F.col("v")))
    pid = F.col("b") * F.lit(inside).cast("long") + F.size(F.filter("cuts", lambda x: x <= F.col("v")))
    placed = placed.join(cuts, F.col("block") == F.col("b")).select("id", "key", "h", "text", pid.alias("pid"))
    narrow = rows.select("key", "h").withColumn("v", order).withColumn("block", block(F.col("v"))).join(cuts, F.col("block") == F.col("b")).select(pid.alias("pid"), "key", "h")
    firsts = sorted((r["pid"], r["f"]["key"], r["f"]["h"]) for r in narrow.groupBy("pid").agg(F.min(F.struct("key", "h")).alias("f")).collect())  # three numbers for each range
    there = spark.createDataFrame([(p, k, x, firsts[i - 1][0], int(i == 0)) for i, (p, k, x) in enumerate(firsts)], "p long, first_key long, first_h long, before long, late int")
    own = F.struct(F.col("pid").alias("pid"), F.lit(False).alias("guest"), F.lit(0).alias("late"))
    away = F.struct(F.col("before").alias("pid"), F.lit(True).alias("guest"), F.col("late").alias("late"))
    opens = (F.col("key") == F.col("first_key")) & (F.col("h") == F.col("first_h"))
    dealt = placed.join(F.broadcast(there), F.col("pid") == F.col("p")).select("id", "key", "h", "text", F.explode(F.when(opens, F.array(own, away)).otherwise(F.array(own))).alias("to"))
    dealt = dealt.select("to.pid", "to.guest", "to.late", "key", "h", "id", "text")
    ordered = dealt.repartition(len(firsts), "pid").sortWithinPartitions("pid", "late", "key", "h", "guest", "text")
    return ordered.select("pid", "guest", "id", "text").mapInArrow(_compare_ranges, schema)
