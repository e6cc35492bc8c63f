"""Vectors that were computed before, by embedder and text."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embedders import Embedder, Transport, with_embeddings

_ROW = "digest string, embedding array<float>"


class EmbeddingCache:
    """A folder with a table of (digest of a text, vector) for each embedder's specification.

    Only texts that it has not are sent, each of them once however often it occurs; what comes back is added before it is
    used, so that a job that fails later need not ask again. Writers at once may add a text twice, which does no harm.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def folder(self, spec: Embedder) -> str:
        """Where an embedder's vectors are: by provider, model and settings, but not by headers, which hold credentials."""
        kept = {k: v for k, v in spec.settings.items() if k not in ("headers", "batch_size", "base_url")}
        name = Embedder(spec.provider, spec.model, kept).to_json()
        return f"{self.path}/{hashlib.sha256(name.encode()).hexdigest()[:32]}"

    def known(self, spec: Embedder) -> DataFrame:
        try:
            rows = self.spark.read.schema(_ROW).parquet(self.folder(spec))
        except AnalysisException:
            return self.spark.createDataFrame([], _ROW)
        return rows.groupBy("digest").agg(F.first("embedding").alias("embedding"))

    def with_embeddings(self, df: DataFrame, spec: Embedder, text_col: str = "text", transport: Transport | None = None) -> DataFrame:
        """df with the column embedding, as embedders.with_embeddings() gives it."""
        digest = F.sha2(F.col(text_col).cast("string"), 256)
        texts = df.select(digest.alias("digest"), F.col(text_col).cast("string").alias("said")).where("said is not null")
        new = texts.join(self.known(spec).select("digest"), "digest", "left_anti").groupBy("digest").agg(F.first("said").alias("said"))
        made = with_embeddings(new, spec, "said", transport).select("digest", "embedding")
        made.write.mode("append").parquet(self.folder(spec))
        mark = "_digest"
        while mark in df.columns:
            mark = "_" + mark
        rows = df.drop("embedding").withColumn(mark, digest)
        return rows.join(self.known(spec).withColumnRenamed("digest", mark), mark, "left").select(*[c for c in df.columns if c != "embedding"], "embedding")
