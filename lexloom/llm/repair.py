"""Conversation structure repair: a weighted edit automaton, determinised lazily, with an audit of the cheapest edits.

A repaired conversation has role initials `(s?(ua)+)?`. The edit automaton has four states: nothing yet, after a system row,
after a user row, after an assistant row; its arcs keep, rerole, delete or insert a row. Rows are symbols (initial, truncated
or not, or one that has to go). What the rows after a place cost at least from each state is a vector of four numbers; less
its least number it is a state of the determinised automaton, of which there are a few dozen. States and arcs are made when
they are first met and kept in a table, so that a scan over a conversation, last row first, is a look-up a row. The audit is
traced against the direction of the scan: from the first row on, the ASCII-least of the arcs that are tight.

Rows go to tasks in order of conversation and turn, in parts of bounded size, so that a conversation of any length is spread.
A part of a longer conversation is a min-plus matrix: products give what follows each part, then the states that each part
leads to are chained, and only then is it traced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ready, small, written

#: Rows and bytes of text in a part, about; a longer row is a part by itself.
PART_ROWS, PART_BYTES = 4096, 2 << 20
#: Costs of the edits; TRUNCATED is added where a truncated row stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLE = {"u": "user", "a": "assistant"}
#: Arcs by state: what an insertion or a new role gives, and where each initial leads.
NEXT = [("u", 2), ("u", 2), ("a", 3), ("u", 2)]
KEPT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
#: Cost of what has to be inserted after the last row, by state.
END = (0, 2 * INSERT, INSERT, 0)
#: Symbols: 2 * initial + truncated; GONE for rows that have to be deleted.
INITIALS, GONE = "sua?", 8
BIG = 1 << 40


def _arcs(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the arcs that consume a row, ASCII-least first."""
    out = [("D", DELETE, state)]
    if symbol != GONE:
        initial, more = INITIALS[symbol // 2], TRUNCATED * (symbol % 2)
        if initial in KEPT[state]:
            out.append(("K", more, KEPT[state][initial]))
        out.append(("R", REROLE + more, NEXT[state][1]))
    return out


def _before(symbol: int, after: tuple[int, ...]) -> list[int]:
    """The vector before a row, from that after it."""
    cost = [min(c + after[to] for _, c, to in _arcs(symbol, q)) for q in range(4)]
    for _ in range(3):  # insertions: no way needs more than two, and costs are positive
        cost = [min(cost[q], INSERT + cost[NEXT[q][1]]) for q in range(4)]
    return cost


class Automaton:
    """The determinised automaton as far as it was needed: normalised vectors and tables of arcs between them."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.table: list[list[tuple[int, int] | None]] = []
        self.moves: dict[tuple[int, int, int], tuple[str, str, int]] = {}

    def state(self, vector) -> tuple[int, int]:
        """(number of the normalised vector, what was taken off)."""
        least = min(vector)
        key = tuple(min(int(v - least), BIG) if v - least < BIG // 2 else BIG for v in vector)
        if key not in self.numbers:
            self.numbers[key] = len(self.vectors)
            self.vectors.append(key)
            self.table.append([None] * (GONE + 1))
        return self.numbers[key], int(least)

    def scan(self, symbols: bytes, end) -> tuple[list[int], int]:
        """(state after each row and before the first, last one first; cost taken off in all)."""
        at, total = self.state(end)
        seen, table = [at], self.table
        for s in reversed(symbols):
            arc = table[at][s]
            if arc is None:
                arc = table[at][s] = self.state(_before(s, self.vectors[at]))
            at = arc[0]
            total += arc[1]
            seen.append(at)
        return seen, total

    def move(self, after: int, symbol: int, state: int) -> tuple[str, str, int]:
        """(letters, roles of the rows that they leave, next state) by the ASCII-least tight arcs up to and over a row."""
        key = (after, symbol, state)
        if key not in self.moves:
            vector, letters, roles = self.vectors[after], "", ""
            before, q = _before(symbol, vector), state
            while True:
                inserted = [("I", INSERT + before[NEXT[q][1]], NEXT[q][1])]
                ways = [(letter, c + vector[to], to) for letter, c, to in _arcs(symbol, q)]
                letter, _, to = min((w for w in ways + inserted if w[1] == before[q]), key=lambda w: w[0])
                letters += letter
                roles += "=" if letter == "K" else "" if letter == "D" else NEXT[q][0]
                q = to
                if letter != "I":
                    break
            self.moves[key] = letters, roles, q
        return self.moves[key]

    def matrix(self, symbols: bytes) -> np.ndarray:
        """Least cost from state to state over these rows."""
        out = np.full((4, 4), BIG, np.int64)
        for to in range(4):
            seen, total = self.scan(symbols, [0 if q == to else BIG for q in range(4)])
            out[:, to] = np.minimum(np.array(self.vectors[seen[-1]], np.int64) + total, BIG)
        return out


def _through(automaton: Automaton, symbols: bytes, seen: list[int], state: int) -> int:
    for i, s in enumerate(symbols):
        state = automaton.move(seen[len(symbols) - 1 - i], s, state)[2]
    return state


def _trace(automaton: Automaton, symbols: bytes, more, roles, texts, seen: list[int], state: int, last: bool) -> tuple[str, list[str]]:
    """(audit, repaired rows) of a part from a state on."""
    audit, rows = [], []
    for i, s in enumerate(symbols):
        letters, made, state = automaton.move(seen[len(symbols) - 1 - i], s, state)
        audit.append(letters)
        if more[i]:
            audit.append("D" * more[i])
        for j, role in enumerate(made):
            name = roles[i] if role == "=" else ROLE[role]
            inserted = j < len(made) - 1 or letters[-1] == "D"
            rows.append(name + ":" + ("" if inserted else texts[i]))
    while last and END[state]:
        role, state = NEXT[state]
        audit.append("I")
        rows.append(ROLE[role] + ":")
    return "".join(audit), rows


def damaged(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text, n): the rows after damage, n times each. Nulls of role and text count as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))), F.lit(20))
    rows = turns.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.when(F.col("code") == 3, 2).otherwise(1).cast("long").alias("n"))


def _faults() -> tuple[Column, Column]:
    """(blank, truncated)"""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return blank, ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")


PARTS = "seg int, part int, first string, last string, blank long, duplicate long, truncated long, illegal long, symbols binary, more array<long>, roles array<string>, texts array<string>"


def _parts(kind: pa.DataType):
    """Cuts a partition's rows, which are in order, into parts of one conversation each."""
    legal = {"su", "ua", "au"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, number = TaskContext.get().partitionId(), 0
        conv, rows, size = None, [], 0
        names = ["conv", "seg", "part", "first", "last", "blank", "duplicate", "truncated", "illegal", "symbols", "more", "roles", "texts"]
        longs, strings = pa.list_(pa.int64()), pa.list_(pa.string())
        fields = [kind, pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.binary(), longs, strings, strings]

        def part():
            nonlocal number
            roles, texts, ns, kinds = zip(*rows)
            initials = [r[:1] for r in roles]
            symbols = bytes(GONE if k in "bd" else 2 * "sua".find(i) + (k == "t") if i and i in "sua" else 6 + (k == "t") for k, i in zip(kinds, initials))
            count = lambda which: sum(n for n, k in zip(ns, kinds) if k == which)
            illegal = sum(n - 1 for n in ns) + sum(a + b not in legal for a, b in zip(initials, initials[1:]))
            again = sum(n - 1 for n, k in zip(ns, kinds) if k in "t.")
            row = (conv, seg, number, initials[0], initials[-1], count("b"), count("d") + again, sum(k == "t" for k in kinds), illegal, symbols, [n - 1 for n in ns], list(roles), list(texts))
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, fields)], names)

        for b in batches:
            for c, role, text, n, k in zip(*(b.column(x).to_pylist() for x in ("conv", "role", "text", "n", "kind"))):
                if rows and (c != conv or len(rows) >= PART_ROWS or size >= PART_BYTES):
                    yield part()
                    rows, size = [], 0
                conv = c
                rows.append((role, text, n, k))
                size += len(role) + len(text)
        if rows:
            yield part()

    return run


def parts(rows: DataFrame) -> DataFrame:
    """The rows of damaged() in order and in parts of bounded size, with each row's first fault."""
    spark = rows.sparkSession
    ready(spark)
    kind = rows.schema["conv"].dataType
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = written(rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("said", said), "repair-rows")
    blank, truncated = _faults()
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = rows.groupBy("conv", "said").agg(F.count("*").alias("times"), F.min(when).alias("first")).where("times > 1")
    again = small(written(again.select(F.col("conv").alias("c"), F.col("said").alias("s"), "first"), "repair-again"))
    joined = rows.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    later = F.col("s").isNotNull() & ~when.eqNullSafe(F.col("first"))
    named = F.when(blank, "b").when(later, "d").when(truncated, "t").otherwise(".").alias("kind")
    order = ["conv", "turn", "role", "text"]
    dealt = joined.select(*order, "n", named).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(_parts(to_arrow_type(kind)), f"conv {kind.simpleString()}, {PARTS}"), "repair-parts")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for b in batches:
        made = [automaton.matrix(s).reshape(-1).tolist() for s in b.column("symbols").to_pylist()]
        kept = ["of", "seg", "part", "first", "last"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(made, pa.list_(pa.int64()))], [*kept, "matrix"])


def _ends(group: pd.DataFrame) -> pd.DataFrame:
    """What follows each part of a conversation, at least, from each state; and faults between parts."""
    group = group.sort_values(["seg", "part"], ignore_index=True)
    out, vector = [None] * len(group), np.array(END, np.int64)
    for i in range(len(group) - 1, -1, -1):
        out[i] = vector.tolist()
        vector = (np.array(group["matrix"][i], np.int64).reshape(4, 4) + vector).min(axis=1)
    between = [0, *((a + b not in ("su", "ua", "au")) for a, b in zip(group["last"][:-1], group["first"][1:]))]
    return group[["of", "seg", "part"]].assign(rank=np.arange(len(group)), parts=len(group), end=out, between=np.array(between, np.int64))


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where a part leads from each state, given what follows."""
    automaton, kept = Automaton(), ["of", "seg", "part", "rank"]
    for b in batches:
        to = []
        for symbols, end in zip(b.column("symbols").to_pylist(), b.column("end").to_pylist()):
            seen, _ = automaton.scan(symbols, end)
            to.append([_through(automaton, symbols, seen, q) for q in range(4)])
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(to, pa.list_(pa.int32()))], [*kept, "leads"])


def _starts(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("rank", ignore_index=True)
    state, out = 0, []
    for leads in group["leads"]:
        out.append(state)
        state = int(leads[state])
    return pd.DataFrame({"seg": group["seg"], "part": group["part"], "start": np.array(out, np.int32)})


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for b in batches:
        audits, repaired, costs = [], [], []
        for symbols, more, roles, texts, end, start, last in zip(*(b.column(c).to_pylist() for c in ("symbols", "more", "roles", "texts", "end", "start", "last"))):
            seen, total = automaton.scan(symbols, end)
            audit, rows = _trace(automaton, symbols, more, roles, texts, seen, start, last)
            audits.append(audit)
            repaired.append("\n".join(rows) if rows else None)
            costs.append(total + automaton.vectors[seen[-1]][start])
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(audits), pa.array(repaired, pa.string()), pa.array(costs, pa.int64())], ["key", "audit", "repaired", "cost"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of conversations whose parts come one after the other; a part is held at a time."""
    at, digest, any_row, audit = None, None, False, []

    def done():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], ["of", "audit", "sha"])

    for b in batches:
        for of, piece, text in zip(*(b.column(c).to_pylist() for c in ("of", "audit", "repaired"))):
            if of != at:
                if at is not None:
                    yield done()
                at, digest, any_row, audit = of, hashlib.sha256(), False, []
            audit.append(piece)
            if text is not None:
                digest.update((("\n" if any_row else "") + text).encode())
                any_row = True
    if at is not None:
        yield done()


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, n_rows, n_parts) of every conv_id of
    turns(conv_id, turn, role, text), as they are; damaged() makes the query's rows.

    See repair_rows(). Columns other than the four are not looked at. Null conv_ids are one conversation.
    """
    plain = turns.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(1).cast("long").alias("n"))
    return repair_rows(plain, turns.select(F.col("conv_id").alias("conv")))


def repair_rows(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """As repair(), of rows(conv, turn, role, text, n) that stand n times each; convs(conv) names the conversations to return.

    Rows of a conversation are in order of turn (nulls first), role and text, so that ties have one order; repeated rows are
    duplicates. An empty text is a blank row. Very long texts are parts by themselves. A conversation without rows has zeros,
    an empty audit and the hash of nothing. An empty table gives no rows. The hash of one conversation is sequential by its
    nature: texts of a conversation of several parts pass through one task as a stream, a part at a time.
    """
    cut = parts(rows)
    kind = rows.schema["conv"].dataType.simpleString()
    counted = cut.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.count("*").alias("n_parts"), F.sum(F.length("symbols")).alias("firsts"), F.sum(F.aggregate("more", F.lit(0).cast("long"), lambda a, x: a + x)).alias("repeats"))
    counted = written(counted, "repair-counts")
    longer = counted.where("n_parts > 1").select(F.col("conv").alias("c"), F.xxhash64("conv").alias("of"))
    longer = small(written(longer, "repair-longer"))
    whole = cut.join(longer, F.col("conv").eqNullSafe(F.col("c")), "left_anti")
    ends = F.array(*[F.lit(x).cast("long") for x in END])
    key = F.struct(F.col("conv").alias("conv"), F.lit(0).alias("rank"))
    traced_type = f"key struct<conv: {kind}, rank: int>, audit string, repaired string, cost long"
    ready_rows = whole.select(key.alias("key"), "symbols", "more", "roles", "texts", ends.alias("end"), F.lit(0).alias("start"), F.lit(True).alias("last"))
    done = ready_rows.mapInArrow(_traced, traced_type)
    sha = F.sha2(F.coalesce("repaired", F.lit("")), 256)
    done = done.select("key.conv", "cost", "audit", sha.alias("sha"), F.lit(0).cast("long").alias("between"))
    if not longer.isEmpty():
        done = done.unionByName(_repair_longer(cut, longer, kind, traced_type))
    turns = rows.where("turn is not null").select("conv", "turn").distinct().groupBy("conv")
    gaps = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    out = convs.distinct()
    for i, side in enumerate((gaps, counted, done)):
        side = side.withColumnRenamed("conv", f"conv{i}")
        out = out.join(side, F.col("conv").eqNullSafe(F.col(f"conv{i}")), "left").drop(f"conv{i}")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        F.col("conv").alias("conv_id"),
        zero(F.col("gaps")).alias("gaps"),
        *[zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated")],
        (zero(F.col("illegal")) + zero(F.col("between"))).alias("illegal"),
        (zero(F.col("cost")) + DELETE * zero(F.col("repeats"))).alias("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        (zero(F.col("firsts")) + zero(F.col("repeats"))).alias("n_rows"),
        zero(F.col("n_parts")).alias("n_parts"),
    )


def _repair_longer(cut: DataFrame, longer: DataFrame, kind: str, traced_type: str) -> DataFrame:
    """(conv, cost, audit, sha, between) of the conversations of several parts."""
    split, at = cut.join(longer, F.col("conv").eqNullSafe(F.col("c"))).drop("c"), ["seg", "part"]
    heads = split.select("of", *at, "first", "last", "symbols").mapInArrow(_matrices, "of long, seg int, part int, first string, last string, matrix array<long>")
    ends = heads.groupBy("of").applyInPandas(_ends, "of long, seg int, part int, rank int, parts int, end array<long>, between long")
    ends = written(ends, "repair-ends")
    leads = split.select(*at, "symbols").join(ends, at).select("of", *at, "rank", "symbols", "end").mapInArrow(_leads, "of long, seg int, part int, rank int, leads array<int>")
    starts = written(leads.groupBy("of").applyInPandas(_starts, "seg int, part int, start int"), "repair-starts")
    rows = split.drop("first", "last", "of").join(ends, at).join(starts, at)
    key = F.struct("of", "conv", "rank")
    rows = rows.select(key.alias("key"), "symbols", "more", "roles", "texts", "end", "start", (F.col("rank") == F.col("parts") - 1).alias("last"))
    pieces = rows.mapInArrow(_traced, traced_type.replace("struct<", "struct<of: bigint, ")).select("key.*", "audit", "repaired", "cost")
    pieces = written(pieces, "repair-pieces")
    hashed = pieces.select("of", "rank", "audit", "repaired").repartition("of").sortWithinPartitions("of", "rank").mapInArrow(_hashed, "of long, audit string, sha string")
    between = ends.groupBy("of").agg(F.sum("between").alias("between"))
    first = pieces.where("rank = 0").select("conv", "of", "cost")  # what follows a part is in its cost
    return first.join(between, "of").join(hashed, "of").select("conv", "cost", "audit", "sha", "between")
