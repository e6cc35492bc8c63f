import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.llm import quality
from lexloom.llm.quality import ORDER

TEXTS = ["abra cadabra abba", "a bad cab", "dab dab dab", "cabbage bag", "abc"]


def brute(texts, words):
    """Log probabilities of words by interpolated modified Kneser-Ney, from the definition."""
    seen = Counter()
    for t in texts:
        before = None
        for w in t.split():
            seen[quality.REPEAT if w == before else w] += 1
            before = w
    grams = Counter()
    for w, n in seen.items():
        s = ["^"] * (ORDER - 1) + list(w) + ["^"]
        for i in range(ORDER - 1, len(s)):
            grams[tuple(s[i - ORDER + 1 : i + 1])] += n
    counts = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut = {}
    for k, c in counts.items():
        d = quality.discounts([sum(1 for v in c.values() if v == i) for i in range(1, 5)])
        cut[k] = lambda v, d=d: d[min(v, 3) - 1]
    context = {k: {} for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            t, h = context[k].get(g[:-1], (0, 0.0))
            context[k][g[:-1]] = (t + v, h + cut[k](v))

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / quality.SYMBOLS
        if g[:-1] not in context[k]:
            return lower
        total, held = context[k][g[:-1]]
        v = counts[k].get(g, 0)
        return (max(v - cut[k](v), 0) if v else 0) / total + held / total * lower

    out = []
    for w in words:
        s = ["^"] * (ORDER - 1) + list(w) + ["^"]
        out.append(sum(math.log(p(tuple(s[i - ORDER + 1 : i + 1]))) for i in range(ORDER - 1, len(s))))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return quality.train(spark.createDataFrame([(t,) for t in TEXTS], "text string"))


def log_p(m, words):
    out, n = m.log_probabilities(pa.array(words))
    return out - n * math.log(quality.SYMBOLS), n


def test_probabilities_against_the_definition(model):
    words = ["abra", "cab", "dab", quality.REPEAT, "zzz", "abz", "b", "cabbages", "a", "a日b", "🎉"]
    got, n = log_p(quality.Model(model.toArrow()), words)
    assert n.tolist() == [len(w) + 1 for w in words]
    assert np.allclose(got, brute(TEXTS, words), atol=1e-4)
    again = quality.Model(model.toArrow(), whole=False)
    assert np.allclose(log_p(again, words)[0], got)


def test_the_symbols_of_a_context_sum_to_one(model):
    m = quality.Model(model.toArrow())
    seen = sorted(set("".join(TEXTS)) - {" "}) + [quality.REPEAT]
    for start in ("", "a", "ca", "abra", "q"):
        words = [*(start + c for c in seen), start, start + "ß"]  # a symbol, the boundary, a symbol never seen
        p = [math.exp(symbol(m, *quality._grams(pa.array([w]))[:2], len(start))) for w in words]
        assert sum(p) + p[-1] * (quality.SYMBOLS - len(words)) == pytest.approx(1, abs=1e-4)


def symbol(m, hi, lo, at):
    """Log probability of one symbol of a word."""
    total = -math.log(quality.SYMBOLS)
    h, x = int(hi[at]), int(lo[at])
    context = (h >> 21, x >> 21 | (h & quality.MASK) << 42)
    for (a, b), tables, start in (((h, x), m.tables[0], 1), (context, m.tables[1], 0)):
        for k, (index, value) in enumerate(tables, start):
            own = quality._key(np.array([a & ((1 << 21 * max(k - 3, 0)) - 1)]), np.array([b & ((1 << 21 * min(k, 3)) - 1)]))
            i = index.find(own)[0]
            total += float(value[i]) if i >= 0 else 0.0
    return total


def test_the_query_against_a_brute_version(spark, sf):
    """Perplexities of whole documents from the definition, over the documents that are trained on; thresholds; decisions."""
    from lexloom.llm import queries

    got = {r["doc_id"]: r for r in queries.QUERIES["op1_quality_classifier"](spark, sf).collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("id")).withColumn("apart", quality.for_threshold()).collect()
    assert sorted(got) == sorted(docs)
    texts = [docs[r["id"]]["text"] or "" for r in labels if not r["apart"] and r["id"] in docs]
    some = sorted(docs)[::20]
    tokens = []
    for i in some:
        before, words = None, []
        for w in (docs[i]["text"] or "").split():
            words.append(quality.REPEAT if w == before else w)
            before = w
        tokens.append(words)
    known = sorted({w for words in tokens for w in words})
    p = dict(zip(known, brute(texts, known)))
    for i, words in zip(some, tokens):
        n = sum(len(w) + 1 for w in words)
        assert got[i]["n_symbols"] == n
        assert got[i]["perplexity"] == (pytest.approx(math.exp(-sum(p[w] for w in words) / n), rel=1e-3) if n else None)
    longer = lambda r: math.exp(quality.SPREAD / math.sqrt(max(r["n_symbols"], 1)))
    apart = [got[r["id"]] for r in labels if r["apart"] and r["id"] in got and got[r["id"]]["perplexity"] is not None]
    for r in got.values():
        own = [x for x in apart if x["lang"] == r["lang"]]
        own = sorted(x["perplexity"] / longer(x) for x in (own if len(own) >= quality.LEAST_TRUSTED else apart))
        assert r["threshold"] == pytest.approx(own[math.ceil(quality.QUANTILE * len(own)) - 1] * quality.LEEWAY * longer(r), rel=1e-6)
        assert r["keep"] == (r["perplexity"] is None or r["perplexity"] <= r["threshold"])


def test_shards_add_up(spark, model, monkeypatch):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "en"), (9, None, None)], "doc_id long, text string, lang string")
    key = lambda r: (r["id"], r["lang"], r["n_symbols"], r["perplexity"] and round(r["perplexity"], 5))
    whole = sorted(map(key, quality.perplexities(docs, model).collect()), key=repr)
    monkeypatch.setattr(quality, "SHARD_ROWS", model.count() // 3)
    assert sorted(map(key, quality.perplexities(docs, model).collect()), key=repr) == whole


def test_held_out_accuracy(spark):
    """Trained on four fifths of the labels, the classifier keeps good documents and finds most others."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = quality.trusted_ids(labels.where("doc_id % 5 <> 0"))
    got = quality.classify(docs, known).join(labels.where("doc_id % 5 = 0"), F.col("id") == F.col("doc_id")).groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    kept = {r["quality"]: r["kept"] for r in got}
    assert kept[1] >= 0.99 and kept[0] <= 0.04


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd, quality.trusted_ids(labels)).collect()
    assert len(got) == odd.count()
    assert all(r["keep"] and r["perplexity"] is None for r in got if r["id"] in (3, 4, 5))
    assert all(r["keep"] for r in quality.classify(odd, quality.trusted_ids(labels.where("false"))).collect())
    assert quality.classify(none, quality.trusted_ids(labels)).count() == 0


def test_any_number_of_partitions_gives_the_same(spark, model, monkeypatch):
    """More partitions than shards, or fewer, leave no row of the model unread."""
    from pyspark.sql import DataFrame

    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    found = lambda: {r["id"]: r["perplexity"] for r in quality.perplexities(docs, model).collect()}
    whole, given = found(), DataFrame.repartition
    for rows in (quality.SHARD_ROWS, model.count() // 4):
        monkeypatch.setattr(quality, "SHARD_ROWS", rows)
        for n in (1, 97):
            monkeypatch.setattr(DataFrame, "repartition", lambda self, k, *by, n=n: given(self, n, *by))
            assert found() == pytest.approx(whole, rel=1e-5)
            monkeypatch.setattr(DataFrame, "repartition", given)


def test_rows_that_are_missing_are_told(spark, model):
    path, counts = quality.model_shards(model)
    with pytest.raises(OSError):
        quality.shard_rows(path, 0, [counts[0] + 1], quality.MODEL)
