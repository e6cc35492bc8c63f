import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import pitman, queries

SMALL = {"SLICE": 4000, "BUCKET": 1500, "WORD_ROWS": 700, "RANGE": 300, "HOT": 20}


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), ""]


def apart(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def brute(rows, burn_in=pitman.BURN_IN, samples=pitman.SAMPLES):
    """[(id, held_out, n_tokens, n_known, base_score, score)] in one process, with one array of all pairs; and the model."""
    learnt = [words_of(t) for d, t in rows if not apart(d)]
    counts = Counter(w for words in learnt for w in words)
    listed = sorted(counts, key=lambda w: (-counts[w], w.encode()))
    number = {w: i for i, w in enumerate(listed)}
    pairs = Counter((number[a], number[b]) for words in learnt for a, b in zip(["", *words], words))
    key = np.array(sorted(a << 32 | b for a, b in pairs), np.int64)
    n = np.array([pairs[k >> 32, k & 0xFFFFFFFF] for k in key.tolist()], np.int64)
    context, word, v = key >> 32, key & 0xFFFFFFFF, len(listed)
    d2 = pitman._discount(int((n == 1).sum()), int((n == 2).sum()))
    t, t_sum, p_sum = np.ones(len(n), np.int64), np.zeros(len(n)), np.zeros(v)
    tables = np.ones(v, np.int64)
    customers = np.bincount(word, t, v).astype(np.int64)
    d1 = pitman._discount(int((customers == 1).sum()), int((customers == 2).sum()))
    predict = lambda: (customers - d1 * tables + (1 + d1 * tables.sum()) / (v + 1)) / (1 + customers.sum())
    none = 0.0
    for sweep in range(1, burn_in + samples + 1):
        opened = np.bincount(context, t, v).astype(np.int64)
        t = pitman.seat(n, opened[context] - t, predict()[word], d2, key, 2 * sweep)
        customers = np.bincount(word, t, v).astype(np.int64)
        tables = pitman.seat(customers, tables.sum() - tables, np.full(v, 1 / (v + 1)), d1, np.arange(v), 2 * sweep + 1)
        if sweep > burn_in:
            t_sum += t
            p_sum += predict()
            none += (1 + d1 * tables.sum()) / (v + 1) / (1 + customers.sum())
    opened = np.bincount(context, t_sum, v) / samples
    own = {(int(a), int(b)): x for a, b, x in zip(context, word, n - d2 * t_sum / samples)}
    total = sum(counts.values())

    def p(a, b):
        below = p_sum[number[b]] / samples if b in number else none_average
        if a not in number:
            return below
        return (own.get((number[a], number.get(b)), 0.0) + (1 + d2 * opened[number[a]]) * below) / (1 + counts[a])

    none_average = 1 - (p_sum / samples).sum()
    out = []
    for d, text in rows:
        words = words_of(text)
        base = sum(math.log10((counts[w] + 1) / (total + v + 1)) for w in words)
        score = sum(math.log10(p(a, b)) for a, b in zip(["", *words], words))
        out.append((d, apart(d), len(words), sum(w in number for w in words), total, base, score))
    return out, p, listed


def same(df, want):
    got = sorted(([*r][:7] for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    want = sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert [tuple(r[:5]) for r in got] == [tuple(r[:5]) for r in want]
    # the discount of a row of documents without words is that of unknown ones
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert np.allclose([r[6] for r in got], [r[6] for r in want], rtol=2e-4, atol=1e-4)


def test_the_query_against_a_brute_version(spark, sf, monkeypatch):
    for name, value in SMALL.items():
        monkeypatch.setattr(pitman, name, value * 100)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want, _, _ = brute(rows)
    df = queries.QUERIES["op12_pitman_yor"](spark, sf)
    same(df, want)
    held = [r for r in df.collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"])) for r in held)


def test_probabilities_sum_to_one():
    rows = [(i, t) for i, t in enumerate(["the cat sat. the dog sat.", "a cat ran", "the the the", "", None, "dog a cat"] * 3)]
    _, p, listed = brute(rows)
    for a in ("the", "cat", "", "never"):
        assert sum(p(a, b) for b in [*listed, "never seen"]) == pytest.approx(1)


def test_pieces_of_any_size_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    names = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(names, rng.integers(1, 60), p=np.arange(400, 0, -1) / 80200)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate([*texts, "hot pair " * 3000, "hot pair " * 40])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, _, _ = brute(rows)
    same(pitman.score(df), want)
    for name, value in SMALL.items():
        monkeypatch.setattr(pitman, name, value)
    same(pitman.score(df), want)


@pytest.mark.parametrize("discount, strength, others, p", [(0.5, 1.0, 3, 0.2), (0.8, 1.0, 40, 0.05), (0.1, 2.0, 0, 0.9)])
def test_seats_are_drawn_from_their_distribution(discount, strength, others, p):
    """Against all seatings of five customers, each with its probability."""
    c, weight = 5, Counter()
    for seats in itertools.product(range(c), repeat=c):
        if any(s > max(seats[:i], default=-1) + 1 for i, s in enumerate(seats)):
            continue
        w, sizes = 1.0, []
        for s in seats:
            if s == len(sizes):
                w *= (strength + discount * (others + len(sizes))) * p
                sizes.append(1)
            else:
                w *= sizes[s] - discount
                sizes[s] += 1
        weight[len(sizes)] += w
    n = 200_000
    t = pitman.seat(np.full(n, c), np.full(n, others), np.full(n, p), discount, np.arange(n), 1, strength)
    total = sum(weight.values())
    for k in range(1, c + 1):
        assert np.mean(t == k) == pytest.approx(weight[k] / total, abs=0.005)


@pytest.mark.parametrize("c, others, p, discount", [(65, 50, 0.05, 0.7), (300, 50, 0.05, 0.7), (2000, 3000, 0.02, 0.75), (2000, 20, 0.3, 0.2)])
def test_many_customers(c, others, p, discount):
    """Beyond EXACT, against the exact distribution of as many."""
    n = 4000
    t = pitman.seat(np.full(n, c), np.full(n, others), np.full(n, p), discount, np.arange(n), 1)
    score = pitman.stirling(discount, c)[c, 1:] + np.cumsum(np.log(1 + discount * (others + np.arange(c)))) + np.log(p) * np.arange(1, c + 1)
    share = np.exp(score - score.max())
    share /= share.sum()
    mean = (share * np.arange(1, c + 1)).sum()
    spread = math.sqrt((share * (np.arange(1, c + 1) - mean) ** 2).sum())
    assert t.mean() == pytest.approx(mean, rel=0.03)
    assert t.std() == pytest.approx(spread, rel=0.15)


def test_a_very_frequent_dish():
    t = pitman.seat(np.array([10**12]), np.array([10**6]), np.array([1e-3]), 0.7, np.array([1]), 1)
    assert 500 < t[0] < 2000


def test_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    same(pitman.score(odd), brute(rows)[0])
    assert pitman.score(none).count() == 0
    only_apart = spark.createDataFrame([(d, "a b c") for d in range(200) if apart(d)], "doc_id long, text string")
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in pitman.score(only_apart).collect()} == {(4, 0, 0, 0.0, None)}
