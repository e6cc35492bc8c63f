import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lexloom.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        text = " " if text is None else text
        role = " " if role is None else role
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if code == 3 else 1)
    return out


def brute(rows):
    """What repair() gives for one conversation's rows, by a dynamic program over strings."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    turns = {r[1] for r in rows if r[1] is not None}
    blank = duplicate = truncated = 0
    seen, marks = set(), []
    for _, _, role, text in rows:
        if not text.strip(WHITE):
            blank += 1
            marks.append("gone")
        elif (role, text) in seen:
            duplicate += 1
            marks.append("gone")
        else:
            cut = text.rstrip(WHITE)[-1] not in ".!?"
            truncated += cut
            marks.append("cut" if cut else "")
        seen.add((role, text))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def insertions(best):
        best, todo = dict(best), list(best)
        while todo:
            q = todo.pop()
            c, audit, out = best[q]
            for role in after[q].replace("s", ""):
                new = (c + 2, audit + "I", (*out, ("user:" if role == "u" else "assistant:")))
                if role not in best or new[:2] < best[role][:2]:
                    best[role] = new
                    todo.append(role)
        return best

    for (_, _, role, text), mark in zip(rows, marks):
        following = {}

        def offer(q, new):
            if q not in following or new[:2] < following[q][:2]:
                following[q] = new

        for q, (c, audit, out) in insertions(best).items():
            offer(q, (c + 3, audit + "D", out))
            if mark != "gone":
                more = mark == "cut"
                if role[:1] and role[:1] in after[q]:
                    offer(role[:1], (c + more, audit + "K", (*out, f"{role}:{text}")))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if r in after[q]:
                        offer(r, (c + 2 + more, audit + "R", (*out, f"{name}:{text}")))
        best = following
    c, audit, out = min((v for q, v in insertions(best).items() if q in ("", "a")), key=lambda v: v[:2])
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, blank, duplicate, truncated, illegal, c, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def expected(rows, do_damage=True):
    kept = damage(rows) if do_damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    return {conv: brute([r for r in kept if r[0] == conv]) for conv in {r[0] for r in rows}}


def got(df):
    return {r["conv_id"]: tuple(r[n] for n in NAMES) for r in df.collect()}


def conversations(n, seed, long=0):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(long or rng.randint(1, 9)):
            text = rng.choice(["Hi.", "What?", "no end", "", " \n", "So!  ", "a", "x" * 50 + "."]) + (str(turn) + "." if rng.random() < 0.5 else "")
            rows.append((conv, None if rng.random() < 0.05 else turn + (rng.random() < 0.1), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "u", None]), text))
    return rows


def test_the_query_against_a_brute_version(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.QUERIES["op11_structure_repair"](spark, sf)) == expected(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rows = conversations(150, seed)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(repair.repair_rows(repair.damaged(df), df.select(F.col("conv_id").alias("conv")))) == expected(rows)
    assert got(repair.repair(df)) == expected(rows, do_damage=False)


def test_conversations_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(repair, "PART_ROWS", 7)
    rows = conversations(6, 5, long=60) + [(None, i, "user", f"t{i}.") for i in range(40)] + [(99, 1, "user", "same.")] * 50
    df = spark.createDataFrame(rows, SCHEMA)
    out = repair.repair(df)
    assert got(out) == expected(rows, do_damage=False)
    assert out.where("n_parts > 1").count() == 7
    assert out.where("conv_id = 99").first()["n_rows"] == 50


def test_the_audit_repairs(spark):
    """Audits applied to the rows give what the pattern asks for, at the stated cost."""
    for symbols in itertools.product(range(9), repeat=3):
        automaton = repair.Automaton()
        seen, total = automaton.scan(bytes(symbols), repair.END)
        audit, rows = repair._trace(automaton, bytes(symbols), [0] * 3, ["sua?"[min(s // 2, 3)] for s in symbols], ["t"] * 3, seen, 0, True)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in rows))
        kept = re.sub("I", "", audit)
        stay = sum(s % 2 for s, k in zip(symbols, kept) if k in "KR" and s != 8)
        assert total + automaton.vectors[seen[-1]][0] == 2 * audit.count("R") + 3 * audit.count("D") + 2 * audit.count("I") + stay
        assert all(k == "D" for s, k in zip(symbols, kept) if s == 8)


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (2, None, "user", "q?"), (2, None, "assistant", "a" * 3_000_000 + "."), (None, None, "USER", "x"), (3, -5, "", ""), (4, 2**40, "system", "."), (5, 0, "user", "Ünï 日本."), (5, 1, "assistant", " ")]
    df = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], SCHEMA + ", conv long, kind string, seg string")
    assert got(repair.repair(df)) == expected(rows, do_damage=False)
    assert repair.repair(df.where("false")).count() == 0
    gone = repair.repair_rows(repair.damaged(df).where("false"), df.select(F.col("conv_id").alias("conv"))).where("conv_id = 5").first()
    assert (gone["cost"], gone["audit"], gone["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())
    strings = df.withColumn("conv_id", F.concat(F.lit("c"), "conv_id"))
    assert repair.repair(strings).count() == 6
