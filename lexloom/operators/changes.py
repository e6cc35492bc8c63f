"""What a load changes: new chunks, replaced documents, ids, plans of work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import checkpointed


def unknown(new: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new that stored has not, by all keys; null equals null."""
    old = stored.select(*[F.col(k).alias(f"_o_{k}") for k in keys]).distinct()
    same = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_o_{k}"))
        same = c if same is None else same & c
    return new.join(old, same, "left_anti")


def replaced(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored without the keys that new has, and all of new. Null keys of stored stay."""
    gone = new.select(F.col(key).alias("_gone")).distinct()
    return stored.join(gone, F.col(key) == F.col("_gone"), "left_anti").unionByName(new, allowMissingColumns=True)


def numbered(rows: DataFrame, order: Sequence[str], name: str, after: int = 0) -> DataFrame:
    """rows with ids from after + 1 on, in order. Rows are counted by range partition first, so no task gets them all.

    The ranges are checkpointed, so that the counts and the numbers are of the same ranges; the order must tell rows
    apart for the numbers to be the same on every run.
    """
    ordered = checkpointed(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = sorted(ordered.groupBy("_p").count().collect())  # a row for each partition
    total, starts = after, {}
    for p, n in counts:
        starts[p], total = total, total + n
    if not starts:
        return rows.withColumn(name, F.lit(None).cast("long"))
    start = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("_p")).cast("long")
    w = Window.partitionBy("_p").orderBy(*order)
    return ordered.withColumn(name, start + F.row_number().over(w)).drop("_p")


def interleaved(paths: DataFrame, documents: DataFrame) -> DataFrame:
    """Distinct origins of paths with is_new_origin and `position` from 0 to 1 among its kind, by origin, so that
    an order by position alternates new and known ones evenly."""
    known = documents.select("origin").where("origin is not null").distinct().withColumn("_known", F.lit(True))
    rows = paths.select("origin").distinct().join(known, "origin", "left").select("origin", F.col("_known").isNull().alias("is_new_origin"))
    out = None
    for kind in (rows.where("is_new_origin"), rows.where("not is_new_origin")):
        last = max(kind.count() - 1, 1)
        placed = numbered(kind, ["origin"], "position").withColumn("position", (F.col("position") - 1) / last)
        out = placed if out is None else out.union(placed)
    return out
