import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexloom.llm import queries, spelling


def near(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute(counts):
    """{word: (form, root, n, n_near, form_n)}"""
    by_ends = {}
    for w in counts:
        for i in range(len(w)):
            by_ends.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    form, n_near, out = {}, {}, {}
    for w, n in counts.items():
        some = set(by_ends.get(w, ())) | {v for i in range(len(w)) for v in by_ends[w[:i] + w[i + 1 :]]} | {w[:i] + w[i + 1 :] for i in range(len(w)) if w[:i] + w[i + 1 :] in counts}
        around = [v for v in some if v != w and near(v, w)]
        n_near[w] = len(around)
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, n_near[w], counts[form[w]] if form[w] else None)
    return out


def words_of(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def got(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_the_query_against_a_brute_version(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(words_of(rows))
    assert got(queries.QUERIES["op13_spelling_variants"](spark, sf)) == want and any(v[0] for v in want.values())


@pytest.mark.parametrize("block", [1, 3, 512])
def test_divided_blocks_give_the_same(spark, monkeypatch, block):
    """Words of two letters, so that blocks are hot; each pair is found once whatever is divided."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(block)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(400)}
    counts = {w: rng.choice([5, 6, 30, 200, 2000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = [(r["word"], r["near"]) for r in spelling.near_pairs(df).collect()]
    assert sorted(pairs) == sorted((x, y) for x, y in itertools.permutations(words, 2) if near(x, y))
    assert got(spelling.variants(df)) == brute(counts)


def test_every_single_edit(spark):
    base = "abcdefgh"
    edits = {base[:i] + c + base[j:] for i in range(9) for j in (i, i + 1) for c in ("x", "", base[i : i + 1]) if j <= 8} - {base}
    counts = {base: 100} | {w: 5 for w in edits if len(w) >= 6}
    want = brute(counts)
    assert got(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == want
    assert want[base][3] == len(counts) - 1


def test_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    df = spelling.variants(spelling.dictionary(spelling.damaged(spelling.runs(odd))))
    assert got(df) == brute(words_of(rows))
    assert spelling.variants(spelling.dictionary(spelling.damaged(spelling.runs(none)))).count() == 0
    long = "Q" * 70_000 + "ÿ"
    texts = [(i, long + ("" if i % 2 else "z") + " ×÷abcéÀ NAME_name") for i in range(20)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit("w"))
    assert got(spelling.variants(spelling.dictionary(spelling.damaged(spelling.runs(df))))) == brute(words_of(texts))
