"""From raw documents to training batches: toxicity, quality, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with all their columns; the last
returns a row for each document with its batch. `run` writes what a stage returns and reads it again for the next.

Of all stages: docs has the columns doc_id, text, lang and source, any of them null, and may have others, whatever their
names, which are kept. Null texts count as empty. Rows with the same doc_id and text are judged alike. An empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import mixing, packing, quality, simhash, toxicity
from lexloom.llm.common import new_folder, scratch, table, without


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half. Learns from the labels of `labels` that are not held out; without
    toxic ones among them, and for empty texts, the score is below it and all stay."""
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return without(docs, toxicity.score(docs, model).where("score >= 0.5").select("id", "h"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold. Texts without words stay, and all without trusted
    documents in `labels`."""
    judged = quality.classify(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))
    return without(docs, judged.where("not keep").select("id", "h"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least doc_id, of rows with that id one. Texts without
    words are a group too; a group without ids keeps one row."""
    return simhash.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their calibrated probabilities, the same ones on every run."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch of each document, repeated rows each: doc_id, n_tokens, bucket, bucket_len, batch_id, slot, padding."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", clean), ("quality", good), ("near-duplicates", distinct), ("mixing", mixed), ("packing", packed)]

#: The stages learn models from the data, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What a stage needs besides its result is deleted once that is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
