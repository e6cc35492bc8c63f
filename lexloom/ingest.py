"""From documents to a store: prepare in parallel, update in bulk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.chunk import markdown_chunk
from .store import Store

#: documents(doc_key, origin, text) -> chunks(doc_key, start, end, context, extra columns)
Prepare = Callable[[DataFrame], DataFrame]


def default_prepare(documents: DataFrame) -> DataFrame:
    return markdown_chunk(documents.select("doc_key", "text"))


def ingest(store: Store, documents: DataFrame, prepare: Prepare = default_prepare, build_index: bool = True) -> tuple[int, DataFrame]:
    """Brings documents(origin, text[, problem]) into a store: (changed documents, problems(origin, problem)).

    Of rows with the same origin the greatest text counts. Documents with a problem, without origin or without text
    are left out and listed; the others go on. Chunks that are stored already are not embedded again.
    """
    problem = F.col("problem") if "problem" in documents.columns else F.lit(None).cast("string")
    rows = documents.select("origin", "text", F.coalesce(problem, F.when(F.col("origin").isNull(), "no origin").when(F.col("text").isNull(), "no text")).alias("problem"))
    good = rows.where("problem is null").groupBy("origin").agg(F.max("text").alias("text")).select(F.col("origin").alias("doc_key"), "origin", "text")
    chunks = prepare(good)
    if not {"doc_key", "start", "end", "context"} <= set(chunks.columns):
        raise TypeError("prepare must return the columns doc_key, start, end, context")
    n = store.update(good, chunks)
    if build_index and n:
        store.build_index()
    return n, rows.where("problem is not null").select("origin", "problem")
