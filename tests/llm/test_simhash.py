import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import simhash
from lexloom.llm.components import components

from .test_brute import classes, fingerprint


def test_golay_code_is_perfect():
    rng = np.random.default_rng(0)
    info = rng.integers(0, 1 << 12, 200)
    words = np.array([(i << 11) ^ simhash._remainder(int(i) << 11) for i in info])
    assert (simhash._ERROR > 0).sum() == 2047
    for flips in ([], [3], [0, 22], [5, 9, 17]):
        assert (simhash.codeword_index(words ^ sum(1 << f for f in flips)) == info).all()


def test_segments_within_two_bits_share_an_index():
    random.seed(2)
    for _ in range(300):
        a = random.getrandbits(64)
        b = a
        for bit in random.sample(range(64), random.choice([1, 2])):
            b ^= 1 << bit
        at, keys = simhash.keys_of(np.array([a, b], np.uint64))
        assert set(keys[at == 0]) & set(keys[at == 1])


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "one Two", "A b\tc\x0bd\u00a0e É", "x " * 50, "The Cat sat on the mat " * 9])
def test_fingerprint(text):
    assert simhash.simhash(text) == fingerprint(text)


def test_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want = classes([(r["doc_id"], fingerprint(r["text"])) for r in rows])
    got = simhash.near_duplicates(docs).collect()
    assert {r["id"]: (r["fp"] % (1 << 64), r["component"]) for r in got} == want


@pytest.mark.parametrize("most", [simhash.PAIRS_UP_TO, 2])
def test_links_of_large_buckets(spark, monkeypatch, most):
    """Chains of near fingerprints, more than a bucket takes pair by pair."""
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", most)
    random.seed(3)
    fps = set()
    for _ in range(6):
        x = random.getrandbits(64)
        for _ in range(60):
            fps.add(x)
            for bit in random.sample(range(64), random.choice([1, 2, 2, 3])):
                x ^= 1 << bit
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] for r in components(simhash.links(df)).collect()}
    want = classes([(i, x) for i, x in enumerate(fps)])
    mine = {}
    for i, x in enumerate(fps):
        mine.setdefault(roots.get(x, f"alone{x}"), set()).add(i)
    theirs = {}
    for i, (_, c) in want.items():
        theirs.setdefault(c, set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 202), (202, 200)]
    random.Random(4).shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 131)}, **{i: 200 for i in range(200, 203)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows_and_one_document_of_each_group(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r["component"] for r in got if r["fp"] == 0} == {3}  # null, empty and blank texts
    assert {r["component"] for r in got if r["id"] in (1, 2)} == {1}
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted({r["component"] or 0 for r in got})
    assert simhash.deduplicated(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_a_hot_group_of_copies(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text over and over again").otherwise(F.concat(F.lit("a text of its own "), F.md5(F.col("id").cast("string")), F.lit(" "), F.sha1(F.col("id").cast("string")))).alias("text"))
    got = simhash.near_duplicates(rows).groupBy("component").count().orderBy(F.desc("count")).first()
    assert (got["component"], got["count"]) == (0, 1000)
