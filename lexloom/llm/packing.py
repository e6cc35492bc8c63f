"""Optimal length buckets and token-budget batches.

The global histogram of document lengths goes to the driver: two numbers for each length that occurs, of which there are
few (D different ones need more than D * D / 2 tokens). Dynamic programming chooses the bucket boundaries that make the
padding least, exactly. Batches form inside each bucket: a batch of a bucket
padded to L tokens has max(1, budget // L) documents. A bucket is dealt to shards in proportion to its rows, so
that no task has to hold a bucket, and each shard cuts its own batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import row_hash, text_of, written

BUCKETS, TOKEN_BUDGET, ROWS_PER_SHARD = 16, 65_536, 4_096


def word_tokens(text: Column) -> Column:
    """Default token count: runs of non-space characters, and one for the end of the document."""
    return (F.regexp_count(text, F.lit(r"\S+")) + 1).cast("long")


def boundaries(top: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most `buckets` buckets with the least padding, for `count` documents of each length in `top`
    (ascending). Ties go to fewer, then lower boundaries.

    Exact. The best last boundary but one never falls as the last one rises, so that each row of the dynamic program is
    found by halving: a level looks at each candidate about once, all of its rows in one NumPy step.
    """
    m = len(top)
    if not m:
        return []
    n, t = (np.concatenate([[0], np.cumsum(x)]).astype(np.int64) for x in (count, top * count))
    best = np.full(m + 1, np.iinfo(np.int64).max // 4, np.int64)
    best[0], back = 0, []
    for _ in range(min(buckets, m)):
        nxt, arg = best.copy(), np.full(m + 1, -1)
        lo, hi, first, last = (np.array([x]) for x in (1, m, 0, m - 1))
        while len(lo):
            i = (lo + hi) // 2
            size = np.minimum(last, i - 1) - first + 1
            start = np.cumsum(size) - size
            j = np.repeat(first - start, size) + np.arange(int(size.sum()))
            row = np.repeat(i, size)
            cost = best[j] + top[row - 1] * (n[row] - n[j]) - (t[row] - t[j])
            least = np.minimum.reduceat(cost, start)
            at = np.where(cost == np.repeat(least, size), np.arange(len(j)), len(j))
            found = j[np.minimum.reduceat(at, start)]
            better = least < nxt[i]
            nxt[i[better]], arg[i[better]] = least[better], found[better]
            lo, hi, first, last = (np.concatenate(x) for x in ((lo, i + 1), (i - 1, hi), (first, found), (found, last)))
            some = lo <= hi
            lo, hi, first, last = lo[some], hi[some], first[some], last[some]
        back.append(arg)
        best = nxt
    out, i = [], m
    for arg in reversed(back):
        if arg[i] >= 0:
            out.append(int(top[i - 1]))
            i = int(arg[i])
        if not i:
            break
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """(id, n_tokens, bucket, bucket_len, batch_id, slot, padding): one row per input row.

    Null texts count as empty and have one token; null or negative given counts too. A document longer than the
    budget is a batch of its own. batch_id is ``bucket-shard-number``; slots of a batch count from 0.
    Repeated rows are packed as often as they occur. An empty table gives no rows.
    """
    n = F.greatest(F.coalesce(word_tokens(text_of(text_col)) if tokens is None else tokens.cast("long"), F.lit(1).cast("long")), F.lit(1).cast("long"))
    lengths = written(docs.select(F.col(id_col).alias("id"), n.alias("n_tokens"), row_hash(id_col, text_col).alias("h")), "packing")
    rows = sorted(lengths.groupBy("n_tokens").agg(F.count("*").alias("n")).collect())  # two numbers for each different length
    cuts = boundaries(*(np.array([r[i] for r in rows], np.int64) for i in range(2)), buckets)
    held = [sum(r[1] for r in rows if lo < r[0] <= hi) for lo, hi in zip([0, *cuts], cuts)]
    if not cuts:
        cuts, held = [1], [0]
    longs = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
    bucket = F.array_position(F.transform(longs(cuts), lambda c: c >= F.col("n_tokens")), F.lit(True)).cast("int")
    shards = F.element_at(longs([max(1, -(-x // ROWS_PER_SHARD)) for x in held]), F.col("bucket"))
    placed = lengths.withColumn("bucket", bucket).withColumn("bucket_len", F.element_at(longs(cuts), F.col("bucket")))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("h"), shards)).withColumn("cap", F.greatest(F.lit(1).cast("long"), F.expr(f"{int(budget)}L div bucket_len")))
    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("id", "h")) - 1
    ranked = placed.withColumn("rank", rank.cast("long"))
    number = F.expr("rank div cap")
    return ranked.select(
        "id", "n_tokens", "bucket", "bucket_len", F.concat_ws("-", "bucket", "shard", number).alias("batch_id"),
        F.expr("rank % cap").cast("int").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
