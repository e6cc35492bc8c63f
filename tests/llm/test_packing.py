import itertools
import random

import numpy as np

from lexloom.llm import packing


def padding(lengths, cuts):
    return sum(min(c for c in cuts if c >= n) - n for n in lengths)


def test_boundaries_are_optimal():
    random.seed(5)
    for _ in range(40):
        lengths = [random.randint(1, 30) for _ in range(random.randint(1, 40))]
        top = sorted(set(lengths))
        count = [lengths.count(x) for x in top]
        for k in (1, 2, 3):
            cuts = packing.boundaries(np.array(top), np.array(count), k)
            best = min(padding(lengths, (*c, top[-1])) for m in range(min(k, len(top))) for c in itertools.combinations(top[:-1], m))
            assert len(cuts) <= k and cuts[-1] == top[-1] and padding(lengths, cuts) == best
    assert packing.boundaries(np.array([], np.int64), np.array([], np.int64), 4) == []


def plain_program(top, count, buckets):
    """The least padding, by the plain dynamic program."""
    m, best = len(top), {0: 0}
    for _ in range(buckets):
        nxt = dict(best)
        for i in range(1, m + 1):
            cost, c, t = [], 0, 0
            for j in range(i - 1, -1, -1):
                c, t = c + count[j], t + count[j] * top[j]
                if j in best:
                    cost.append(best[j] + c * top[i - 1] - t)
            if cost:
                nxt[i] = min([*cost, nxt.get(i, min(cost))])
        best = nxt
    return best[m]


def test_boundaries_of_many_long_lengths_are_optimal():
    random.seed(6)
    for m, k in ((150, 4), (200, 7), (250, 16)):
        top = sorted(random.sample(range(1, 60_000), m))
        count = [random.choice([1, 2, 50, 3000]) for _ in top]
        cuts = packing.boundaries(np.array(top), np.array(count), k)
        assert sum(c * (min(x for x in cuts if x >= n) - n) for n, c in zip(top, count)) == plain_program(top, count, k)


def test_the_query_against_a_brute_version(spark, sf):
    """Every document once, in the bucket of its length, whose bounds are the best; batches within the budget, full but for
    the last of a shard."""
    from lexloom.llm import queries

    got = queries.QUERIES["op4_length_buckets"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {d["doc_id"]: len((d["text"] or "").split()) + 1 for d in docs}
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted(want.items())
    lengths = sorted(set(want.values()))
    count = [list(want.values()).count(n) for n in lengths]
    cuts = sorted({r["bucket_len"] for r in got})
    assert all(r["bucket_len"] == min(c for c in cuts if c >= r["n_tokens"]) and r["bucket"] == cuts.index(r["bucket_len"]) + 1 for r in got)
    assert sum(r["padding"] for r in got) == plain_program(lengths, count, packing.BUCKETS)
    batches = {}
    for r in got:
        batches.setdefault(r["batch_id"], []).append(r)
    for name, rows in batches.items():
        cap = max(1, packing.TOKEN_BUDGET // rows[0]["bucket_len"])
        shard, number = name.rsplit("-", 1)
        assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and len(rows) <= cap
        assert len(rows) == cap or f"{shard}-{int(number) + 1}" not in batches


def test_batches(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = packing.pack(docs, budget=4000, buckets=5).collect()
    want = {r["doc_id"]: len(r["text"].split()) + 1 for r in docs.collect()}
    assert len(got) == len(want) and all(abs(r["n_tokens"] - want[r["id"]]) <= 1 for r in got)
    batches = {}
    for r in got:
        assert 0 <= r["padding"] == r["bucket_len"] - r["n_tokens"]
        batches.setdefault(r["batch_id"], []).append(r)
    for rows in batches.values():
        assert len({r["bucket"] for r in rows}) == 1
        assert len(rows) == 1 or len(rows) * rows[0]["bucket_len"] <= 4000
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))


def test_hot_buckets_are_dealt_to_shards(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(packing, "ROWS_PER_SHARD", 50)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("the same length each").alias("text"))
    got = packing.pack(docs, budget=50).collect()
    assert len(got) == 2000 and max(r["slot"] for r in got) < 10
    assert len({r["batch_id"].split("-")[1] for r in got}) > 20


def test_odd_rows(odd, none):
    got = packing.pack(odd).collect()
    assert len(got) == odd.count()
    assert all(r["n_tokens"] == 1 for r in got if r["id"] in (3, 4, 5))
    assert max(r["n_tokens"] for r in got) == 120_002
    assert packing.pack(none).count() == 0
