import glob
import os

import pytest

from lexloom.llm import queries
from lexloom.llm.common import fresh, only, scratch, shared_dir, without, written

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Rows that each stage gets and gives."""
    sf = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, sf), "test")
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_columns_and_drop_rows(stages):
    assert [n for n, *_ in stages] == ["toxicity", "quality", "near-duplicates", "mixing", "packing"]
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns == COLUMNS
        assert 0 < after.count() < before.count()
        assert after.exceptAll(before).count() == 0
    assert stages[-1][1].count() == stages[-1][2].count()


def test_decisions_take_effect(spark, stages):
    from lexloom.llm import simhash

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").dropDuplicates(["doc_id"])
    for k, bad, least in ((0, "toxic = 1", 0.6), (1, "quality = 0", 0.6)):
        _, before, after = stages[k]
        there, left = (x.join(labels.where(bad), "doc_id", "left_semi").count() for x in (before, after))
        assert left <= (1 - least) * there
        good = "toxic = 0" if k == 0 else "quality = 1"
        there, left = (x.join(labels.where(good), "doc_id", "left_semi").count() for x in (before, after))
        assert left >= 0.95 * there
    _, before, after = stages[2]
    classes = simhash.near_duplicates(before).select("component").distinct()
    assert sorted(r[0] for r in classes.collect()) == sorted(r[0] for r in after.select("doc_id").collect())


def test_odd_rows_go_through(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    none = odd.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_every_operator_has_one_query():
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in queries.QUERIES) == 1
    assert os.path.exists(corpus_pipeline.__file__)


def test_names_that_operators_use_are_kept(spark, odd):
    from pyspark.sql import functions as F

    docs = odd.withColumns({n: F.lit("mine") for n in ("__row_hash", "__listed_id", "__listed_h", "id", "tokens", "probability")})
    assert fresh(docs, "__row_hash", "new") == ["___row_hash", "new"]
    for _, stage in corpus_pipeline.STAGES[2:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.where("`__row_hash` = 'mine' and id = 'mine'").count() == out.count() > 0
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("h")).where("id is null or id = 1")
    assert without(docs, rows).count() == docs.count() - 3
    assert only(docs, rows).count() == 2 and only(docs, rows, once=False).count() == 3


def test_intermediate_tables_are_deleted(spark, odd):
    kept = written(odd.select("doc_id"), "kept")
    with scratch(spark):
        gone = written(odd.select("doc_id"), "gone")
        assert gone.count() == odd.count()
    folder = shared_dir(spark).removeprefix("file:")
    assert not glob.glob(f"{folder}/gone-*") and kept.count() == odd.count()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
