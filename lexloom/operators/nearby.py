"""Joins on order: the last row before a time, the nearest row within a distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_before(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], prefix: str = "last_", bucket: Column | None = None) -> DataFrame:
    """left with the values of the last row of right strictly before it, by keys; null without one.

    One window over the union of both: no range join. Of right rows at the same time, the greatest values count.
    bucket, a function of `at` that never falls as it rises, splits hot keys: rows look within their bucket first, and
    what earlier buckets hand on is found from one row for each key and bucket.
    """
    both = left.withColumn("_left", F.lit(True)).unionByName(right.select(*keys, at, F.struct(*values).alias("_values")).withColumn("_left", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("_bucket", F.lit(0) if bucket is None else bucket)
    w = Window.partitionBy(*keys, "_bucket").orderBy(F.col(at), F.col("_left").desc(), "_values").rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("_seen", F.last("_values", ignorenulls=True).over(w)).where("_left")
    if bucket is not None:
        last = F.max(F.when(~F.col("_left"), F.struct(F.col(at).alias("at"), F.col("_values").alias("v")))).alias("_last")
        ends = both.groupBy(*keys, "_bucket").agg(last)
        earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        handed = ends.withColumn("_before", F.last("_last", ignorenulls=True).over(earlier)["v"]).drop("_last")
        handed = handed.withColumnsRenamed({c: f"_k_{c}" for c in (*keys, "_bucket")})
        same = F.lit(True)
        for c in (*keys, "_bucket"):
            same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        seen = seen.join(handed, same, "left").withColumn("_seen", F.coalesce("_seen", "_before"))
    return seen.select(*left.columns, *[F.col("_seen")[v].alias(prefix + v) for v in values])


def nearest_within(points: DataFrame, candidates: DataFrame, most: int, point: str = "point", candidate: str = "candidate", keys: Sequence[str] = ()) -> DataFrame:
    """points with the nearest candidate (whole numbers) within `most`; of two equally near, the greater; else null.

    Both sides meet in buckets of width `most`, so a point looks at three buckets and not at all candidates.
    """
    width = max(int(most), 1)
    bucket = lambda c: F.floor(c / width)
    asked = points.select(*keys, point).distinct()
    looked = asked.withColumn("_b", F.explode(F.array(*[bucket(F.col(point)) + d for d in (-1, 0, 1)])))
    there = candidates.select(*keys, candidate).distinct().withColumn("_b", bucket(F.col(candidate)))
    near = looked.join(there, [*keys, "_b"]).where(F.abs(F.col(point) - F.col(candidate)) <= most)
    best = near.groupBy(*keys, point).agg(F.min_by(candidate, F.struct(F.abs(F.col(point) - F.col(candidate)), -F.col(candidate))).alias("nearest"))
    return points.join(best, [*keys, point], "left")


def coverage_gaps(ranges: DataFrame, keys: Sequence[str], length: Column) -> DataFrame:
    """The keys whose ranges (start, end) leave a position of 1..length uncovered."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = ranges.withColumns({"_hole": (F.col("start") > reach + 1).cast("int"), "_length": length})
    found = rows.groupBy(*keys).agg(F.max("_hole").alias("hole"), F.max("end").alias("last"), F.max("_length").alias("n"))
    return found.where("hole = 1 or last < n").select(*keys)
