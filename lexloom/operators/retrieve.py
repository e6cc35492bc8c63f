"""Retrieval from chunks: vector and BM25 results side by side, several queries, merging of overlapping ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import slice_text


def hybrid(vector: DataFrame, bm25: DataFrame, keys: Sequence[str], method: str = "cosine_distance", by: Sequence[str] = ()) -> DataFrame:
    """Results of both kinds (metric_name, metric_value) in one row per key: the columns `method` and bm25, null where
    a kind did not find the row. Rows are not ranked again; `rank` keeps vector results before BM25-only ones. Results of
    several queries are ranked for each by the columns `by`, which are keys."""
    rest = [c for c in vector.columns if c not in (*keys, "metric_name", "metric_value")]
    each = Window.partitionBy(*by) if by else Window  # both sides have at most k rows a query
    order = each.orderBy(F.asc_nulls_last("metric_value"), *keys)
    a = vector.withColumn("_ra", F.row_number().over(order)).withColumnRenamed("metric_value", method).drop("metric_name")
    b = bm25.withColumn("_rb", F.row_number().over(each.orderBy(F.desc_nulls_last("metric_value"), *keys))).withColumnRenamed("metric_value", "bm25").drop("metric_name")
    b = b.withColumnsRenamed({c: f"_b_{c}" for c in rest if c in b.columns})
    both = a.join(b, list(keys), "full_outer")
    columns = [F.coalesce(c, f"_b_{c}").alias(c) if f"_b_{c}" in b.columns else F.col(c) for c in rest]
    rank = F.row_number().over(each.orderBy(F.asc_nulls_last("_ra"), F.asc_nulls_last("_rb")))
    return both.select(*keys, *columns, method, "bm25", rank.alias("rank"))


def first_of_each(found: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key by `order`: what several queries found, each chunk once."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def deoverlap(found: DataFrame, documents: DataFrame, merge: str = "last", drop: Sequence[str] = ("embedding",)) -> DataFrame:
    """Overlapping chunks of a document as one row: start, end, context of the first, text cut from the document, and
    an array of each other column.

    A row opens a new range if it starts after the end of the row before (by start, end); ranges that only touch stay
    apart. merge "last" ends a range with its last row, "max" with the farthest. Rows are distinct by doc_id and
    chunk_id first. found has doc_id, chunk_id, start, end, context, origin and more; documents doc_id and text.
    """
    keys = ("origin", "doc_id")
    rest = [c for c in found.columns if c not in (*keys, "start", "end", "context", "text", *drop)]
    rows = first_of_each(found.drop(*drop, "text"), ["doc_id", "chunk_id"], ["start", "end"])
    w = Window.partitionBy("doc_id").orderBy("start", "end", "chunk_id")
    opens = F.col("start") > F.lag("end", 1, -1).over(w)
    rows = rows.withColumn("_open", opens.cast("int"))
    rows = rows.withColumn("_range", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("start", "end", "chunk_id")
    listed = F.array_sort(F.collect_list(F.struct(at.alias("at"), *rest)))
    ends = F.max("end") if merge == "max" else F.max_by("end", at)
    merged = rows.groupBy(*keys, "_range").agg(F.min("start").alias("start"), ends.alias("end"), F.min_by("context", at).alias("context"), listed.alias("_all"))
    merged = merged.select(*keys, *[F.col("_all")[c].alias(c) for c in rest], "start", "end", "context")
    texts = documents.select("doc_id", F.col("text").alias("_text"))
    out = merged.join(texts, "doc_id").withColumn("text", slice_text(F.col("_text"), F.col("start"), F.col("end"))).drop("_text")
    order = [c for c in found.columns if c not in drop]
    return out.select(*order, *[c for c in ("text",) if c not in order])
