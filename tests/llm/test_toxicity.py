import itertools
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.llm import toxicity
from lexloom.llm.toxicity import Trie


def osa(a, b):
    """Edit distance with swaps of neighbours."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i, j in itertools.product(range(len(a)), range(len(b))):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
        if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_automata_against_edit_distance():
    words = ["".join(w) for n in range(4, 8) for w in itertools.islice(itertools.product("abc", repeat=n), 0, 700, 7)]
    terms = [("abcab", False), ("aabbcca", True), ("bcab", True), ("cabcabc", False), ("cccc", False)]
    trie = Trie(terms)
    edits = lambda t, stem: int(len(t) >= (toxicity.FUZZY_STEM if stem else toxicity.FUZZY_WORD))
    got = trie.hits(pa.array(words))
    for w, h in zip(words, got.tolist()):
        near = []
        for i, (t, stem) in enumerate(terms):
            d = min(osa(t, w[:n]) for n in range(len(w) + 1)) if stem else osa(t, w)
            if d <= edits(t, stem):
                near.append((d, i))
        assert h == (2 * min(near)[1] + min(near)[0] if near else -1), (w, near)


def test_misspellings():
    trie = Trie([("idiot", False), ("worthless", False)])
    for w in ("idiot", "idoit", "idi0t", "idiiot", "idit", "worthles", "w0rthless"):
        assert trie.search(w), w
    for w in ("idea", "it", "riot", "worth", ""):
        assert trie.search(w) is None, w


@pytest.mark.parametrize("window, at, factor", [(["you", "idiot"], 1, 1.5), (['"idiot"'], 0, 0.3), (["“such", "an", "idiot”"], 2, 0.3), (["he", "called", "him", "idiot"], 3, 0.7), (["an", "idiot", "there"], 1, 1.0)])
def test_context(window, at, factor):
    assert toxicity.context_factor(window, at) == factor


def test_quotation_scores_lower_than_abuse():
    model = {"terms": [("idiot", False)], "values": [0.95, 0.75], "base": 0.01}
    texts = ["you are an idiot", "the report said the word was unusual", 'the word "idiot" is old', "you are an idoit", "", None, "IDIOT!!"]
    score = toxicity._scores(pa.array(texts), Trie(model["terms"]), model)[0].tolist()
    assert score[0] > 0.95 and score[3] > 0.75 and score[6] > 0.9
    assert score[1] == score[4] == score[5] == pytest.approx(0.01) and 0.2 < score[2] < 0.4


def test_learns_terms_and_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = toxicity.training_rows(docs, labels)
    seen = {r["text"] for r in train.select("text").collect()}
    out = docs.join(labels, "doc_id").where(toxicity.held_out()).select("text").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in labels.where(toxicity.held_out()).collect())
    assert sum(r["text"] in seen for r in out) < 0.2 * len(out)  # but for copies
    model = toxicity.fit(train)
    assert {"idiot", "moron"} & {t for t, _ in model["terms"]}
    got = toxicity.score(docs, model).join(labels, F.col("id") == F.col("doc_id")).groupBy("toxic").agg(F.avg((F.col("score") >= 0.5).cast("int")).alias("p")).collect()
    p = {r["toxic"]: r["p"] for r in got}
    assert p[0] < 0.06 and p[1] > 0.6


def test_copies_of_one_toxic_text_do_not_make_terms(spark):
    rows = [(i, f"unique copied wording here is moronic number {i % 3}" if i < 60 else f"plain text {i} about nothing {i * 7}", int(i < 60)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(toxicity.training_rows(docs, docs.select("doc_id", F.lit(1).alias("quality"), "toxic")))
    assert model["terms"] == []


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (6, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.training_rows(odd, labels))
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    empty = toxicity.fit(toxicity.training_rows(none, labels))
    assert toxicity.score(none, empty).count() == 0
    assert len({r["score"] for r in toxicity.score(odd, empty).collect()}) == 1


def test_two_edits_against_edit_distance():
    rng = random.Random(5)
    terms = [("worthless", False), ("abcabcab", False), ("stupi", True), ("abca", True), ("cabb", False)]
    words = set()
    for term, _ in terms:
        for _ in range(300):
            w = term + rng.choice(["", "", "ab"])
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(w) + 1)
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abc0") + w[i:], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]])
            words.add(w)
    words = sorted(words - {""})
    trie = Trie(terms)
    for w, h in zip(words, trie.hits(pa.array(words)).tolist()):
        near = []
        for i, ((t, stem), most) in enumerate(zip(terms, (2, 2, 1, 0, 0))):
            d = min(osa(t, w[:n]) for n in range(len(w) + 1)) if stem else osa(t, w)
            if d <= most:
                near.append((d, i))
        assert h == (trie.code(min(near)[1], min(near)[0]) if near else -1), (w, near)


def test_misspellings_of_a_word_whose_stem_was_chosen(spark):
    rng = random.Random(3)
    filler = lambda: " ".join("".join(rng.choice("bdfglmnprt") + rng.choice("aeu") for _ in range(3)) for _ in range(12))
    insults = ["idiot", "idiots", "idiotic", "idiocy"]
    rows = [(i, f"{filler()} {insults[i % 4] if i < 160 else 'worthless'} {filler()}" if i < 240 else filler(), int(i < 240)) for i in range(1_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(toxicity.training_rows(docs, docs.select("doc_id", F.lit(1).alias("quality"), "toxic")))
    assert any(stem and "idiot".startswith(w) for w, stem in model["terms"])  # the inflected forms make the stem win
    texts = [f"some {w} here" for w in ("idiot", "idoit", "iidiot", "1diot", "idi0tic", "w0rthless", "w0rthl3ss", "plain", "window")]
    score = toxicity._scores(pa.array(texts), Trie(model["terms"]), model)[0]
    assert (score[:7] >= 0.5).all() and (score[7:] < 0.5).all(), score


def test_the_query_on_held_out_labels(spark):
    """The registered query over whole tables: labels that weren't learnt from, and the contract's columns."""
    from lexloom.llm import queries

    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op6_toxicity"](spark, sf)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels.select("doc_id", "toxic"), "doc_id", "left").collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    apart = [(r["toxic"], r["predicted"]) for r in rows if r["held_out"] and r["toxic"] is not None]
    found, wrong = [p for t, p in apart if t], [p for t, p in apart if not t]
    assert sum(found) / len(found) >= 0.8 and sum(wrong) / len(wrong) <= 0.03


def test_only_copies_are_dropped_from_training(spark):
    texts = ["alpha beta gamma delta epsilon zeta eta theta iota kappa", "alpha beta gamma delta epsilon zeta eta theta iota lambda", "another text", "another text", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 20)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(0).alias("toxic"))
    kept = [r["text"] for r in toxicity.training_rows(docs, labels).collect()]
    assert kept.count("another text") == 1 and kept.count("") == 1 and 1 <= sum(t.startswith("alpha") for t in kept) <= 2
