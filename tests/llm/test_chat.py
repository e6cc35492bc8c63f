import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import chat


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    model = {"move": np.log(rng.dirichlet(np.ones(6), 7)), "emit": np.log(rng.dirichlet(np.ones(9), 6))}
    obs = rng.integers(0, 9, 5)
    score = lambda path: model["move"][6, path[0]] + sum(model["move"][a, b] for a, b in zip(path, path[1:])) + sum(model["emit"][s, o] for s, o in zip(path, obs))
    best = max(itertools.product(range(6), repeat=5), key=score)
    assert tuple(chat.decode(obs, model, 6, None)) == best
    # parts: the matrices give the same as the whole
    first, second = chat.through(obs[:2], model), chat.through(obs[2:], model)
    assert (first[6][:, None] + second[:6]).max() == pytest.approx(score(best))


def test_markers():
    obs, lines = chat.observe(["User: hi", "**Assistant**: yes?", "[system]: x", "<|assistant|> a", "> Q: b", "Note: c", "10:30 start"])
    marker = [o // 24 for o in obs.tolist()]
    assert marker == [2, 3, 1, 3, 2, 4, 0]
    assert lines[0] == "hi" and lines[3] == "a" and lines[5] == "Note: c"


@pytest.fixture(scope="module")
def model(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").where("conv_id % 2 = 0")
    return chat.train(chat.transcripts(turns, with_truth=True))


def test_recovers_roles_and_texts(spark, model):
    """Held out: the model has not seen these conversations."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").where("conv_id % 2 = 1")
    got = {(r["id"], r["turn"], r["role"], r["text"]) for r in chat.parse(chat.transcripts(turns), model).collect()}
    want = {(r["conv_id"], r["turn"], r["role"], r["text"]) for r in turns.collect()}
    assert len(got & want) >= 0.98 * len(want)


def test_parts_decode_like_the_whole(spark, model, monkeypatch):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"text {i}\nmore" + ("?" if i % 2 == 0 else ".")) for i in range(40)], "conv_id long, turn long, role string, text string")
    whole = [(r["role"], r["text"]) for r in chat.parse(chat.transcripts(turns), model).orderBy("part", "turn").collect()]
    monkeypatch.setattr(chat, "PART_TURNS", 7)
    parts = chat.transcripts(turns)
    assert parts.count() == 6
    assert [(r["role"], r["text"]) for r in chat.parse(parts, model).orderBy("part", "turn").collect()] == whole


def test_odd_rows(spark, model):
    rows = [(1, 0, "user", None, 1), (1, 0, "user", None, 1), (1, 1, None, "", 1), (None, 0, "weird", "x\n\ny", 1), (2, None, "assistant", "a" * 100_000, 1), (3, -5, "USER", "User: User: q?", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    got = chat.parse(chat.transcripts(turns), model).collect()
    assert {r["id"] for r in got} == {1, 2, 3, None} and all(r["rendered"].startswith("<|") for r in got)
    assert chat.parse(chat.transcripts(turns.where("false")), model).count() == 0
    texts = spark.createDataFrame([(1, None, None), (2, 0, ""), (2, 0, "User: hi\nAssistant: yo")], "id long, part long, text string")
    out = chat.parse(texts, model).collect()
    assert {r["id"] for r in out} == {1, 2}


def test_training_on_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    model = chat.train(chat.transcripts(none, with_truth=True))
    assert np.isfinite(model["emit"]).all()


def test_a_hot_conversation(spark, model):
    turns = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("line "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    got = chat.parse(chat.transcripts(turns), model)
    assert got.count() == 3000 and got.where("role = 'user'").count() == 1500


def test_turn_numbers_that_many_rows_share(spark, model, monkeypatch):
    monkeypatch.setattr(chat, "MOST_ROWS", 100)
    monkeypatch.setattr(chat, "PART_TURNS", 50)
    turns = spark.range(1500).select(F.lit(1).cast("long").alias("conv_id"), F.when(F.col("id") % 3 > 0, F.lit(7)).cast("long").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("line "), F.col("id").cast("string"), F.lit("?")).alias("text"))
    parts = chat.transcripts(turns, with_truth=True).withColumn("turns", F.size(F.filter("truth", lambda s: s % 2 == 0)))
    rows = parts.collect()
    assert sum(r["turns"] for r in rows) == 1500 and max(r["turns"] for r in rows) < 150
    assert chat.parse(chat.transcripts(turns), model).agg(F.sum("n_lines")).first()[0] >= 1500


def test_the_query_recovers_held_out_conversations(spark):
    """Every turn of the table, against what was said; the figures are of conversations that weren't learnt from."""
    from lexloom.llm import queries

    sf = "/root/testdata/sf0.01"
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    got = {(r["conv_id"], r["turn"], r["role"], r["text"]) for r in queries.QUERIES["op9_chat_transcripts"](spark, sf).collect()}
    rows = turns.withColumn("apart", chat.held_out("conv_id")).collect()
    apart = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows if r["apart"]]
    assert 0 < len(apart) < len(rows) / 2
    assert sum(r in got for r in apart) >= 0.98 * len(apart)
    assert {r["conv_id"] for r in rows} == {g[0] for g in got}


def test_crowded_parts_stay_in_order_of_turn(spark, model, monkeypatch):
    """Turn numbers of many rows each: parts follow the turns, and are of bounded size."""
    monkeypatch.setattr(chat, "MOST_ROWS", 100)
    monkeypatch.setattr(chat, "PART_TURNS", 50)
    turns = spark.range(800).select(F.lit(1).cast("long").alias("conv_id"), F.floor(F.col("id") / 20).alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("turn "), F.floor(F.col("id") / 20), F.lit(" row "), F.col("id")).alias("text"))
    parts = sorted((r["part"], r["text"]) for r in chat.transcripts(turns).collect())
    said = [int(line.split("turn ")[1].split()[0]) for _, text in parts for line in text.split("\n") if "turn " in line]
    assert len(said) == 800 and said == sorted(said) and 16 <= len(parts) <= 18
