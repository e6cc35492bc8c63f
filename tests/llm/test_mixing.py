import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import mixing
from lexloom.llm.common import written


def test_raking_reaches_the_margins():
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 1000, (4, 3, 5)).astype(float)
    targets = [rng.random(n) for n in (4, 3, 5)]
    out = mixing.rake(tokens, targets)
    for axis, t in enumerate(targets):
        own = out.sum(axis=tuple(i for i in range(3) if i != axis))
        assert np.allclose(own, t / t.sum(), atol=1e-8)
    # raking keeps the odds ratios of the start
    odds = lambda x: x[0, 0, 0] * x[1, 1, 0] / (x[0, 1, 0] * x[1, 0, 0])
    assert odds(out) == pytest.approx(odds(tokens))


def test_empty_categories_and_tables():
    tokens = np.zeros((2, 1, 2))
    assert mixing.rake(tokens, [np.ones(2), np.ones(1), np.ones(2)]).sum() == 0
    tokens[0, 0, 1] = 5
    assert mixing.rake(tokens, [np.ones(2), np.ones(1), np.ones(2)])[0, 0, 1] == pytest.approx(1)


def margins_of(cells, codes, n):
    return [np.bincount(c, cells, m) for c, m in zip(codes, n)]


def test_drawn_tokens_meet_the_margins_without_drawing_more_than_there_is():
    rng = np.random.default_rng(3)
    shape = (6, 4, 5)
    codes = [x.reshape(-1) for x in np.indices(shape)]
    for power in (0.3, 0.7, 1.0):
        tokens = rng.pareto(1.0, shape).reshape(-1) * 1000
        shares = mixing.rake_cells(tokens, codes, [m**power for m in margins_of(tokens, codes, shape)])
        for keep in (0.1, 0.5, 0.9):
            drawn = mixing.drawn_tokens(tokens, codes, shares, keep * tokens.sum())
            assert (drawn <= tokens * (1 + 1e-12)).all() and 0 < drawn.sum() <= keep * tokens.sum() * (1 + 1e-4)
            for own, want in zip(margins_of(drawn, codes, shape), margins_of(shares, codes, shape)):
                assert np.abs(own / drawn.sum() - want).max() < 1e-4
    # a budget that fits is used whole, and a scarce category bounds it
    assert mixing.drawn_tokens(np.array([10.0, 90.0]), [np.array([0, 1])] * 3, np.array([0.1, 0.9]), 50).tolist() == pytest.approx([5, 45])
    assert mixing.drawn_tokens(np.array([10.0, 90.0]), [np.array([0, 1])] * 3, np.array([0.5, 0.5]), 50).tolist() == pytest.approx([10, 10])


def shares(rows, axis):
    out, total = {}, sum(r["tokens"] for r in rows) or 1
    for r in rows:
        out[r[axis]] = out.get(r[axis], 0) + r["tokens"] / total
    return out


def test_drawn_margins_are_near_the_targets(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("one two three "), F.col("id").cast("string")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"),
        F.when(F.col("id") % 5 == 0, "de").otherwise("en").alias("lang"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("topic"),
    )
    targets = {"source": {"hot": 0.1, **{f"s{i}": 0.9 / 7 for i in range(7)}}, "lang": {"de": 0.3, "en": 0.7}, "topic": {"x": 0.4, "y": 0.6}}
    plan = mixing.planned(rows, targets, keep=0.3, topic=F.col("topic"))
    drawn = [r for r in plan.collect() if r["selected"]]
    for axis, want in targets.items():
        got = shares(drawn, axis)
        assert max(abs(got[k] - w) for k, w in want.items()) < 0.005
    assert abs(sum(r["tokens"] for r in drawn) / 100_000 - 0.3) < 0.005
    got = mixing.mix(rows, targets, keep=0.3, topic=F.col("topic"))
    again = mixing.mix(rows.repartition(3), targets, keep=0.3, topic=F.col("topic"))
    assert got.columns == rows.columns and got.count() == len(drawn)
    assert again.exceptAll(got).count() == got.exceptAll(again).count() == 0


def bounded(own, total):
    """Tokens to the power POWER as shares, at most what the budget can take of each."""
    lo, hi = 0.0, 10.0
    for _ in range(200):  # the scale at which they add up to one
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(n**mixing.POWER * mid, n / (mixing.KEEP * total)) for n in own.values()) < 1 else (lo, mid)
    return {v: min(n**mixing.POWER * hi, n / (mixing.KEEP * total)) for v, n in own.items()}


def test_the_query_against_a_brute_version(spark):
    """Every row once; tokens, topics, weights and probabilities as counted and raked here; drawn margins within 0.01."""
    from lexloom.llm import queries

    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_mix_sources"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    assert sorted(got) == sorted(d["doc_id"] for d in docs)
    rows = []
    for d in docs:
        r, text = got[d["doc_id"]], d["text"] or ""
        assert r["tokens"] == len(re.findall(r"[^ \t-\r]+", text)) + 1
        assert (r["cell_source"], r["cell_lang"]) == (d["source"], d["lang"])
        n, count = max(len(text), 1), lambda cs: sum(text.count(c) for c in cs)
        form = (
            "empty" if not text else "table" if count("|") / n > 0.01 else "marked" if count("#$%&*@=<>{}[]^~\\") / n > 0.04
            else "shouted" if sum("A" <= c <= "Z" for c in text) / n > 0.3 else "numeric" if sum("0" <= c <= "9" for c in text) / n > 0.05
            else "note" if n < 400 else "prose" if n < 8_000 else "long prose"
        )
        assert r["cell_topic"] == form
        rows.append({**r.asDict(), "source": d["source"], "lang": d["lang"], "topic": form})
    cells = {}
    for r in rows:
        c = (r["source"], r["lang"], r["topic"])
        cells[c] = cells.get(c, 0) + r["tokens"]
    total = sum(cells.values())
    want = [{}, {}, {}]
    for c, n in cells.items():
        for k in range(3):
            want[k][c[k]] = want[k].get(c[k], 0) + n
    want = [bounded(w, total) for w in want]
    share = {c: n / total for c, n in cells.items()}
    for _ in range(400):
        for k in range(3):
            own = {}
            for c, x in share.items():
                own[c[k]] = own.get(c[k], 0) + x
            share = {c: x * want[k][c[k]] / own[c[k]] for c, x in share.items()}
    drawn, expected = [r for r in rows if r["selected"]], 0.0
    for r in rows:
        c = (r["source"], r["lang"], r["topic"])
        assert r["weight"] == pytest.approx(share[c] * total / cells[c], rel=1e-5)
        assert 0 <= r["probability"] <= 1
        expected += r["tokens"] * r["probability"]
    for k, axis in enumerate(("source", "lang", "topic")):
        calibrated, real = {}, shares(drawn, axis)
        for r in rows:
            calibrated[r[axis]] = calibrated.get(r[axis], 0) + r["tokens"] * r["probability"] / expected
        for v, w in want[k].items():
            assert calibrated[v] == pytest.approx(w, abs=1e-4)
            assert real.get(v, 0) == pytest.approx(w, abs=0.01)
    assert 0.6 * total < sum(r["tokens"] for r in drawn) <= 0.82 * total


def test_odd_rows(odd, none):
    got = mixing.planned(odd).collect()
    assert len(got) == odd.count() and all(r["probability"] is not None for r in got)
    assert {r["source"] for r in got if r["id"] == 3} == {mixing.NONE}
    assert mixing.planned(none).count() == 0 and mixing.mix(none).count() == 0
    drawn = mixing.mix(odd)
    assert drawn.columns == odd.columns and drawn.exceptAll(odd).count() == 0
    assert len({r["selected"] for r in got if r["id"] == 1}) == 1
    whole = mixing.mix(odd, keep=1.0, targets={k: {v: float(n) for v, n in counted(got, k).items()} for k in mixing.AXES})
    assert whole.count() == odd.count()


def counted(rows, axis):
    out = {}
    for r in rows:
        out[r[axis]] = out.get(r[axis], 0) + r["tokens"]
    return out


def many(spark):
    """585 sources of different sizes, 80 languages and 30 topics."""
    rows = spark.range(6_000).withColumn("s", F.floor(F.sqrt(F.col("id") * 60)))
    return rows.select(
        F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.concat(F.lit("s"), "s").alias("source"),
        F.concat(F.lit("l"), (F.col("id") * 7919 % 80).cast("string")).alias("lang"), F.concat(F.lit("t"), (F.col("id") * 104729 % 30).cast("string")).alias("topic"),
    )


def test_every_category_has_its_own_margin(spark):
    got = mixing.planned(many(spark), topic=F.col("topic")).select("source", "lang", "topic", "tokens", "weight").toPandas()
    assert [got[k].nunique() for k in ("source", "lang", "topic")] == [585, 80, 30]
    got["share"] = got["tokens"] * got["weight"] / got["tokens"].sum()
    margin = got.groupby("topic")[["share", "tokens"]].sum()
    wanted = bounded(dict(margin["tokens"]), got["tokens"].sum())
    assert np.allclose(margin["share"], [wanted[k] for k in margin.index], atol=1e-6)


@pytest.mark.parametrize("targets", [None, {"topic": {f"t{i}": i for i in range(20)}, "lang": {"gone": 1.0}}])
def test_raking_in_spark_gives_what_the_driver_gives(spark, monkeypatch, targets):
    monkeypatch.setattr(mixing, "SWEEPS", 2)
    monkeypatch.setattr(mixing, "DRAWN_ERROR", 1.0)
    rows = written(many(spark).where("doc_id % 10 < 3"), "test")
    out = []
    for cells in (10**6, 0):
        monkeypatch.setattr(mixing, "LOCAL_CELLS", cells)
        out.append(mixing.planned(rows, targets, topic=F.col("topic")).select("id", "weight", "probability").toPandas().sort_values("id"))
    here, there = out
    assert len(here) == len(there) == 1_800 and not there.isna().any().any()
    assert np.allclose(here["weight"], there["weight"], rtol=1e-6) and np.allclose(here["probability"], there["probability"], rtol=1e-6)


def test_a_hot_cell_is_ranked_in_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 100)
    rows = spark.range(5_000).selectExpr("id as doc_id", "'a b c' as text", "if(id % 3 = 0, 'hot', concat('s', id % 5)) as source", "'en' as lang")
    got = mixing.planned(rows, {"source": {"hot": 0.2, **{f"s{i}": 0.16 for i in range(5)}}}, keep=0.4).collect()
    drawn = shares([r for r in got if r["selected"]], "source")
    assert abs(drawn["hot"] - 0.2) < 0.01 and len(got) == 5_000
