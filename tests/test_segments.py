import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import bm25, segments

FIELDS = ["text"]


def chunks(spark, n, seed=1, start=0):
    rng, words = random.Random(seed), [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    rows = [(start + i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(200)], k=rng.randint(0, 60)))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, text string")


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(0, "wdz wec"), (1, "waa"), (2, "waa wab wac wgx"), (3, "nothing"), (4, None)], "query_id int, text string")


def rows(df):
    return {(r["query_id"], r["id"]): round(r["metric_value"], 9) for r in df.collect()}


def test_the_top_is_that_of_all_scores(spark, tmp_path, asked, monkeypatch):
    monkeypatch.setattr(segments, "FIRST", 2)
    strong = spark.range(40).select((F.col("id") + 50_000).alias("id"), F.concat(F.lit("wdz wec waa wgx "), F.repeat(F.lit("wdz waa wgx "), (F.col("id") % 5 + 3).cast("int"))).alias("text"))
    docs = chunks(spark, 20_000).repartition(4).union(strong)
    index = segments.write_segment(docs, str(tmp_path / "a"), "id", FIELDS)
    whole = bm25.build(docs, "id", FIELDS)
    for k, b in ((1.2, 0.75), (2.0, 0.3)):
        counts = {}
        want = rows(bm25.best(bm25.score(whole, asked, k=k, b=b), 7))
        assert rows(index.top(asked, 7, k=k, b=b, counts=counts)) == want
        assert 0 < counts["scored"] < counts["blocks"]
    assert rows(bm25.score(index.index(), asked)) == rows(bm25.score(whole, asked))


def test_blocks_are_bounded_and_hot_terms_cut(spark, tmp_path):
    docs = spark.range(5000).select("id", F.concat(F.lit("hot word "), F.when(F.col("id") % 2 == 0, "even").otherwise("odd")).alias("text")).repartition(3)
    index = segments.write_segment(docs, str(tmp_path / "a"), "id", FIELDS)
    found = index._read("blocks").where("term = 'hot'").select(F.size("ids").alias("n")).collect()
    assert sum(r["n"] for r in found) == 5000 and max(r["n"] for r in found) <= segments.PART and len(found) >= 5
    assert index.totals.first()["n"] == 5000 and index.frequencies.where("term = 'even'").first()["df"] == 2500


def test_segments_with_removed_documents_score_like_a_new_index(spark, tmp_path, asked):
    base = chunks(spark, 3000)
    index = segments.write_segment(base, str(tmp_path / "0"), "id", FIELDS)
    live = base
    for step in range(1, 5):
        new, gone = chunks(spark, 40, step, 10_000 * step), live.where(f"id % 97 = {step}")
        index = index.add(str(tmp_path / str(step)), new, gone, "id", FIELDS)
        live = live.where(f"id % 97 <> {step}").union(new)
        whole = bm25.build(live, "id", FIELDS)
        assert rows(bm25.score(index.index(), asked)) == rows(bm25.score(whole, asked))
    want = rows(bm25.best(bm25.score(whole, asked), 9))
    assert rows(index.top(asked, 9)) == want
    some = index.to_merge()
    assert some == index.paths[1:]
    merged = index.merge(str(tmp_path / "m"), some)
    assert len(merged.paths) == 2 and rows(merged.top(asked, 9)) == want and rows(bm25.score(merged.index(), asked)) == rows(bm25.score(whole, asked))
    again = merged.add(str(tmp_path / "x"), chunks(spark, 10, 9, 90_000), live.where("id >= 20000 and id < 20010"), "id", FIELDS)
    live = live.where("not (id >= 20000 and id < 20010)").union(chunks(spark, 10, 9, 90_000))
    assert rows(again.top(asked, 9)) == rows(bm25.best(bm25.score(bm25.build(live, "id", FIELDS), asked), 9))
    with pytest.raises(ValueError):
        again.merge(str(tmp_path / "no"), again.paths[:1])


def test_stems_and_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Running horses"), (2, None), (3, ""), (4, "the a"), (5, "RUN run café"), (6, "x " * 5000)], "id long, text string")
    asked = spark.createDataFrame([(0, "runs cafe")], "query_id int, text string")
    index = segments.write_segment(docs, str(tmp_path / "s"), "id", FIELDS, stemmed=True, stop_words=True)
    whole = bm25.build(docs, "id", FIELDS, stemmed=True, stop_words=True)
    assert rows(index.top(asked, 3)) == rows(bm25.best(bm25.score(whole, asked), 3)) != {}
    none = segments.write_segment(docs.where("false"), str(tmp_path / "n"), "id", FIELDS)
    assert none.top(asked, 3).count() == 0
    grown = none.add(str(tmp_path / "g"), docs, docs.where("false"), "id", FIELDS)
    assert rows(grown.top(asked, 3)) == rows(bm25.best(bm25.score(bm25.build(docs, "id", FIELDS), asked), 3))
    text_ids = docs.withColumn("id", F.concat(F.lit("k"), "id"))
    assert segments.write_segment(text_ids, str(tmp_path / "t"), "id", FIELDS).top(asked.withColumn("text", F.lit("run")), 3).first()["id"] == "k5"


def test_blocks_are_written_by_the_task_that_cuts_them(spark, tmp_path):
    """Texts are cut once and blocks are not shuffled; each file is in order of term, nulls first."""
    once = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            once.add(b.num_rows)
            yield b

    docs = chunks(spark, 3000).repartition(3).localCheckpoint().mapInArrow(seen, "id long, text string")
    segments._write(segments.blocks(docs, "id", FIELDS, False, False), str(tmp_path / "b"))
    assert once.value == 3000
    each = spark.read.parquet(str(tmp_path / "b" / "blocks")).select(F.col("_metadata.file_path").alias("file"), "term", "part")
    files = {}
    for r in each.collect():
        files.setdefault(r["file"], []).append((r["term"] or "", r["part"]))
    assert len(files) == 3 and all(x == sorted(x) for x in files.values())
    assert sum(("waa" in {t for t, _ in x}) for x in files.values()) == 3
