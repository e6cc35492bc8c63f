"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

States are roles, each as the first line of a turn or a later one. A line's observation joins the speaker marker
that it starts with to features of the line. Transitions and emissions are counted on turns with known roles.
A transcript comes in parts of bounded size. Each part gives a matrix of best log scores from the state before it
to its last state; the few matrices of a transcript give the states at the parts' borders, and each part is then
decoded between its borders. The result is that of Viterbi over the whole transcript.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import changes
from .common import small, written

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # 2 * role: first line of a turn; 2 * role + 1: later line
#: Speaker markers. Fixed values.
MARKERS = {
    "system": ("system", "sys", "instruction", "context"),
    "user": ("user", "human", "you", "q", "question", "customer", "me", "prompt"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "agent", "model", "gpt"),
}
_NAMES = {name: i + 1 for i, role in enumerate(ROLES) for name in MARKERS[role]}
_MARKER = re.compile(r"^\s{0,3}(?:[#>*\-]{1,3}\s*)?[\[<(|*]{0,2}\s*([A-Za-z]{1,12})\s*[\]>)|*]{0,2}\s*:\s?|^\s{0,3}<\|([a-z]{1,12})\|>\s?")
#: Observation: marker (none, three roles, other name), blank line before, length class, ending.
SHAPE = (5, 2, 4, 3)
SMOOTH = 0.5
#: Observations that a role gets from the average of all roles.
POOLED = 20.0
#: Turn numbers of a part of `transcripts`; rows from which a part is dealt to several, and so many at most.
PART_TURNS, MOST_ROWS, SUBPARTS = 256, 4_096, 1 << 20


def observe(lines: list[str], blank_before: bool = True) -> tuple[np.ndarray, list[str]]:
    """(observation of each line, the lines without speaker markers). Other names before a colon stay in the line."""
    out, plain, blank = np.empty(len(lines), np.int64), [], blank_before
    for i, line in enumerate(lines):
        m = _MARKER.match(line)
        marker = 0
        if m:
            marker = _NAMES.get((m[1] or m[2]).lower(), 4)
            if marker < 4:
                line = line[m.end() :]
        n, end = len(line.strip()), line.rstrip()[-1:]
        size = 0 if n == 0 else 1 if n < 120 else 2 if n < 320 else 3
        out[i] = ((marker * 2 + blank) * 4 + size) * 3 + (1 if end == "?" else 2 if end in ".!" and end else 0)
        plain.append(line)
        blank = n == 0
    return out, plain


def style_of(seed: int, role: str, first: bool, turn_seed: int) -> str:
    """The marker that a transcript of some style has before a turn; a quarter of the turns after the first has none."""
    if turn_seed % 4 == 0 and not first:
        return ""
    name = {0: role.capitalize() + ": ", 1: MARKERS[role][seed // 7 % len(MARKERS[role])].capitalize() + ": ", 2: f"[{role}]: ", 3: f"<|{role}|> "}[seed % 4]
    return name


def transcripts(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", with_truth: bool = False) -> DataFrame:
    """(id, part, text[, truth]): plain transcripts of turns, as people paste them: speaker markers in one of several
    styles, missing from some turns, and blank lines between turns. A part has PART_TURNS turn numbers.

    truth has the state of each line. Null roles count as user, null texts as empty; turns with a null number come first.
    Where turn numbers are shared by so many rows that a part would have more than MOST_ROWS rows, its rows are numbered in order
    of turn and of a hash of role and text, and cut after each PART_TURNS rows, so that the transcript stays in order of turn.
    `part` counts in steps of SUBPARTS. Other columns are ignored; an empty table gives no rows.
    """
    kind = turns.schema[id_col].dataType.simpleString()
    rows = turns.select(F.col(id_col).alias("id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("turn"), F.coalesce(F.lower(F.col(role_col).cast("string")), F.lit("user")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"part": F.floor(F.col("turn") / PART_TURNS) * SUBPARTS, "seed": F.pmod(F.xxhash64("id"), F.lit(1 << 20)), "own": F.pmod(F.xxhash64("id", "turn"), F.lit(1 << 20))})
    crowded = rows.groupBy("id", "part").agg(F.count("*").alias("n")).where(F.col("n") > MOST_ROWS)
    crowded = written(crowded.select(F.col("id").alias("many"), F.col("part").alias("of")), "chat-crowded")
    if not crowded.isEmpty():
        crowded, same = small(crowded), F.col("id").eqNullSafe(F.col("many")) & (F.col("part") == F.col("of"))
        many = rows.join(crowded, same, "left_semi").withColumn("h", F.xxhash64("role", "text"))
        many = written(changes.numbered(many, ["id", "part", "turn", "h"], "number"), "chat-numbered")
        first = many.groupBy(F.col("id").alias("many"), F.col("part").alias("of")).agg(F.min("number").alias("first"))
        sub = F.least(F.floor((F.col("number") - F.col("first")) / PART_TURNS), F.lit(SUBPARTS - 1))
        cut = many.join(small(first), same).withColumn("part", F.col("part") + sub).select(*rows.columns)
        rows = rows.join(crowded, same, "left_anti").unionByName(cut)
    parts = rows.groupBy("id", "part").agg(F.first("seed").alias("seed"), F.array_sort(F.collect_list(F.struct("turn", "role", "text", "own"))).alias("turns"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, truths = [], []
            for seed, part, said in zip(*(b.column(c).to_pylist() for c in ("seed", "part", "turns"))):
                lines, truth = [], []
                for k, t in enumerate(said):
                    role = t["role"] if t["role"] in ROLES else "user"
                    body = t["text"].split("\n")
                    body[0] = style_of(seed, role, k == 0 and part <= 0, t["own"]) + body[0]
                    lines += body + [""]
                    truth += [2 * ROLES.index(role)] + [2 * ROLES.index(role) + 1] * len(body)
                texts.append("\n".join(lines[:-1]))
                truths.append(truth[:-1])
            columns = [b.column("id"), b.column("part"), pa.array(texts, pa.string())] + [pa.array(truths, pa.list_(pa.int32()))] * with_truth
            yield pa.RecordBatch.from_arrays(columns, ["id", "part", "text"] + ["truth"] * with_truth)

    return parts.mapInArrow(render, f"id {kind}, part long, text string" + ", truth array<int>" * with_truth)


def held_out(id_col: str = "id") -> Column:
    """Conversations that are not learnt from: a fifth, by a hash of the id; null ids are learnt from."""
    return F.col(id_col).isNotNull() & (F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(13)), F.lit(5)) == 0)


def train(known: DataFrame) -> dict[str, np.ndarray]:
    """Log start, transition and emission scores from (id, part, text, truth), by counting in Spark. Rows with null text or
    truth count as an empty line or not at all; without any rows the scores are those of the smoothing alone.

    What comes to the driver is a table of STATES squared and one of STATES times the observations.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int, int], int] = {}
        for b in batches:
            for part, text, truth in zip(*(b.column(c).to_pylist() for c in ("part", "text", "truth"))):
                obs, _ = observe((text or "").split("\n"))
                before = STATES if part <= 0 else -1
                for s, o in zip(truth or [], obs.tolist()):
                    for key in (("e", s, o), ("t", before, s)):
                        if key[1] >= 0:
                            total[key] = total.get(key, 0) + 1
                    before = s
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())], ["kind", "a", "b", "n"])

    rows = known.mapInArrow(count, "kind string, a int, b int, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    move, emit = np.full((STATES + 1, STATES), SMOOTH), np.zeros((STATES, int(np.prod(SHAPE))))
    move[:, 1::2] = 1e-6
    for s in range(STATES):
        move[s, s | 1] = SMOOTH  # a later line follows a line of the same role
    for r in rows:
        (move if r["kind"] == "t" else emit)[r["a"], r["b"]] += r["n"]
    cube = emit.reshape(STATES, *SHAPE)
    parts = [cube.sum(axis=tuple(j for j in range(1, 5) if j != i)) + SMOOTH for i in range(1, 5)]
    parts[1] = cube.sum(axis=(3, 4)) + SMOOTH  # marker and blank line before
    # what rare roles have too little of is added from all roles: how turns go on, and markers as none, own, wrong, other
    starts, later = np.arange(0, STATES, 2), np.arange(1, STATES, 2)
    for first in (0, 1):
        group = later if first else starts
        own = np.array([parts[1][s, s // 2 + 1] for s in group]).sum(0)
        none, other = parts[1][group, 0].sum(0), parts[1][group, 4].sum(0)
        wrong = parts[1][group, 1:4].sum((0, 1)) - own
        total = own.sum() + none.sum() + other.sum() + wrong.sum()
        on = sum(move[s, s | 1] for s in group) / move[group].sum()
        for s in group:
            parts[1][s, 0] += POOLED * none / total
            parts[1][s, 4] += POOLED * other / total
            for m in range(1, 4):
                parts[1][s, m] += POOLED * (own if m == s // 2 + 1 else wrong / 2) / total
            move[s, s | 1] += POOLED * on
            move[s, starts] += POOLED * (1 - on) / len(starts)
    shape = np.log(parts[2] / parts[2].sum(1, keepdims=True))[:, None, None, :, None] + np.log(parts[3] / parts[3].sum(1, keepdims=True))[:, None, None, None, :]
    log_emit = np.log(parts[1] / parts[1].sum((1, 2), keepdims=True))[:, :, :, None, None] + shape
    return {"move": np.log(move / move.sum(1, keepdims=True)), "emit": log_emit.reshape(STATES, -1)}


def through(obs: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """(STATES + 1, STATES): best log score from the state before (the last: start of a transcript) to the last state."""
    best = model["move"] + model["emit"][:, obs[0]]
    move = model["move"][:STATES]
    for o in obs[1:].tolist():
        best = (best[:, :, None] + move).max(1) + model["emit"][:, o]
    return best


def decode(obs: np.ndarray, model: dict[str, np.ndarray], before: int, last: int | None) -> np.ndarray:
    """The best states from the state before to the last one (None: any); ties go to the lower state."""
    best = model["move"][before] + model["emit"][:, obs[0]]
    move, back = model["move"][:STATES], np.zeros((len(obs), STATES), np.int64)
    for i, o in enumerate(obs[1:].tolist(), 1):
        both = best[:, None] + move
        back[i] = both.argmax(0)
        best = both.max(0) + model["emit"][:, o]
    out = np.empty(len(obs), np.int64)
    out[-1] = int(best.argmax()) if last is None else last
    for i in range(len(obs) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def render(role: str, text: str) -> str:
    """The canonical turn."""
    return f"<|{role}|>\n{text.strip()}\n<|end|>\n"


def parse(parts: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(id, part, turn, role, n_lines, continued, text, rendered): the turns of transcripts (id, part, text), in parts.

    Parts of a transcript are in the order of part, cut at line ends. Turns count from 0 in a part; `continued`
    marks lines at the start of a part that belong to the turn before. Null and empty texts are one empty line.
    Repeated (id, part) rows are decoded each. A transcript's matrices (a row of at most 42 numbers for each part)
    come together, its lines never do.
    """
    kind = parts.schema["id"].dataType.simpleString()
    parts = parts.select("id", F.coalesce(F.col("part").cast("long"), F.lit(0)).alias("part"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [through(observe(t.split("\n"))[0], model).reshape(-1) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("part"), b.column("h"), pa.array(out, pa.list_(pa.float64()))], ["id", "part", "h", "m"])

    spread = parts.groupBy("id").agg(F.min(F.struct("part", "h")).alias("lo"), F.max(F.struct("part", "h")).alias("hi")).where("lo <> hi").select(F.col("id").alias("many"))
    spread = written(spread, "chat-long")
    long = parts.join(small(spread), F.col("id").eqNullSafe(F.col("many")), "left_semi")
    cut = long.mapInArrow(matrices, f"id {kind}, part long, h long, m array<double>").distinct()

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "h"]).reset_index(drop=True)
        score, back = None, []
        for m in pdf["m"]:
            m = np.asarray(m).reshape(STATES + 1, STATES)
            both = m[STATES:] if score is None else score[:, None] + m[:STATES]
            back.append(both.argmax(0))
            score = both.max(0)
        last = [int(score.argmax())]
        for b in back[:0:-1]:
            last.append(int(b[last[-1]]))
        last.reverse()
        return pd.DataFrame({"b_id": pdf["id"], "b_part": pdf["part"], "b_h": pdf["h"], "before": [STATES, *last[:-1]], "last": last})

    edges = cut.groupBy("id").applyInPandas(borders, f"b_id {kind}, b_part long, b_h long, before int, last int")
    same = F.col("id").eqNullSafe(F.col("b_id")) & (F.col("part") == F.col("b_part")) & (F.col("h") == F.col("b_h"))
    ready = parts.join(edges, same, "left").select("id", "part", "text", F.coalesce("before", F.lit(STATES)).alias("before"), "last")

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [None, pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.string()]
        for b in batches:
            kinds[0], rows = b.schema.field("id").type, []
            for i, part, text, before, last in zip(*(b.column(c).to_pylist() for c in ("id", "part", "text", "before", "last"))):
                obs, lines = observe(text.split("\n"))
                states = decode(obs, model, before, last)
                starts = sorted({0, *np.flatnonzero(states % 2 == 0).tolist()})
                for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(lines)])):
                    role, body = ROLES[states[a] // 2], "\n".join(lines[a:z]).strip("\n")
                    rows.append((i, part, k, role, z - a, bool(states[a] % 2), body, render(role, body)))
            columns = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["id", "part", "turn", "role", "n_lines", "continued", "text", "rendered"])

    return ready.mapInArrow(turns, f"id {kind}, part long, turn int, role string, n_lines int, continued boolean, text string, rendered string")
