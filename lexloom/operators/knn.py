"""Exact nearest neighbours of vectors, for one query and for many."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vector import literal, metric
from ..shared import checkpointed

#: Rows of a block of items and of queries at most, numbers in a block's vectors, blocks of queries in a partition.
ITEM_BLOCK, QUERY_BLOCK, NUMBERS, QUERY_PART = 2_048, 1_024, 1 << 20, 8
#: Rows that a task holds of the best so far, and pairs of vectors that are laid side by side.
HELD, SIDE = 1 << 20, 1 << 13
#: Beyond so many rows it is looked whether the limit cuts anything; if not, the rows are sorted by ranges instead.
MANY = 1_000_000


def nearest(items: DataFrame, vector: Sequence[float], k: int, method: str = "cosine_distance", id_col: str = "vec_id", vector_col: str = "embedding", where: Column | str | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """The k rows of items nearest to a vector, with metric_name and metric_value, nearest first.

    The filter and `exclude` (ids already seen) hold before the k rows are taken, so k rows come back if as many
    fit. Ties go to the smaller id; null distances come last. Only the id and the vector take part until the
    rows are found.
    """
    value = metric(method)(F.col(vector_col), literal(vector))
    found = items if where is None else items.where(where)
    if exclude is not None:
        found = found.join(exclude.select(id_col).distinct(), id_col, "left_anti")
    found = found.withColumns({"metric_name": F.lit(method), "metric_value": value})
    ranked = found.orderBy(F.asc_nulls_last("metric_value"), id_col)
    return ranked if k > MANY and k >= found.count() else ranked.limit(k)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _distances(q: np.ndarray, x: np.ndarray, method: str) -> np.ndarray:
    """Of each row of q to the same row of x; equal pairs have equal distances, wherever they stand."""
    if method == "euclidean_distance":
        return np.sqrt(((x - q) ** 2).sum(1))
    product = (x * q).sum(1)
    if method == "negative_inner_product":
        return -product
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - product / np.sqrt((x * x).sum(1) * (q * q).sum(1))


def _near(q: np.ndarray, x: np.ndarray, k: int, method: str, limit: np.ndarray, digits: int | None) -> np.ndarray:
    """Places in the matrix (queries, items) that can be among the k nearest and within the limit of their query: one matrix
    product in the order of the distances, with room for its rounding and for digits that do not count."""
    qq, xx = (q * q).sum(1), (x * x).sum(1)
    most = np.fmax.reduce(xx)
    far = q @ x.T
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        if method == "cosine_distance":
            far /= -np.sqrt(xx)[None, :]
            far /= np.sqrt(qq)[:, None]
            slack = np.full(len(q), 1e-12)
        elif method == "euclidean_distance":
            far *= -2
            far += xx[None, :]
            far += qq[:, None]
            slack = 1e-12 * (qq + most)
        else:
            np.negative(far, out=far)
            slack = 1e-12 * np.sqrt(qq * most)
        if np.isnan(far.min()):
            far[np.isnan(far)] = np.inf
        if len(x) > k and np.isinf(limit).any():
            here = np.partition(far, k - 1, axis=1)[:, k - 1] + np.nan_to_num(slack)
            limit = np.minimum(limit, here + 1 if method == "cosine_distance" else np.sqrt(np.maximum(here, 0)) if method == "euclidean_distance" else here)
        limit = limit if digits is None else limit + 10.0**-digits
        limit = limit - 1 if method == "cosine_distance" else limit * limit if method == "euclidean_distance" else limit
    return np.flatnonzero(far <= (limit + np.nan_to_num(slack))[:, None])


class _Best:
    """The k best so far of each query of a block."""

    def __init__(self, queries: pa.Array, ids: pa.DataType, k: int):
        self.queries, self.k = queries.take(pa.array(np.arange(len(queries)))), k  # a copy, so that its batch can go
        self.row, self.value, self.key, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), pa.array([], ids)
        self.limit = np.full(len(queries), np.inf)

    def add(self, row: np.ndarray, value: np.ndarray, key: np.ndarray, ids: pa.Array) -> None:
        row, value, key = (np.concatenate(x) for x in ((self.row, row), (self.value, value), (self.key, key)))
        ids = pa.concat_arrays([self.ids, ids])
        order = np.lexsort((pc.rank(ids, null_placement="at_start", tiebreaker="dense").to_numpy(), key, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        order, place = order[place < self.k], place[place < self.k]
        self.row, self.value, self.key, self.ids = row[order], value[order], key[order], ids.take(pa.array(order))
        last = place == self.k - 1
        self.limit[self.row[last]] = np.where(np.isnan(self.key[last]), np.inf, self.key[last])

    def batch(self, names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.queries.take(pa.array(self.row)), self.ids, pa.array(self.value), pa.array(self.key)], names)


def blocks(rows: DataFrame, size: int, kind: str, more: str = "", added=None) -> DataFrame:
    """Rows (id, v) of at most `size` as one row (block, ids, v): the ids as a list, the vectors as one list.

    With `added`, a batch is put in order and cut by it first: it gives (rows in order, where a block must end, a function
    that gives the columns `more` of a block of these rows).
    """
    of_id = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            if not b.num_rows:
                continue
            width = len(b.column("v")[0])
            if (np.diff(b.column("v").offsets.to_numpy()) != width).any():
                raise ValueError("vectors differ in length")
            order, ends, columns = (None, [b.num_rows], None) if added is None else added(b)
            b = b if order is None else b.take(pa.array(order))
            n, at = max(1, min(size, NUMBERS // max(width, 1))), 0
            for end in ends:
                for lo in range(at, end, n):
                    hi = min(lo + n, end)
                    part = b.slice(lo, hi - lo)
                    own = [] if columns is None else columns(lo, hi)
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (part.column("id"), part.column("v").flatten())]
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, *own], names)
                    number += 1
                at = end

    schema = f"block long, ids array<{of_id}>, v {kind}{more}"
    names = ["block", "ids", "v", *(x.split()[0] for x in more.split(",")[1:])]
    return rows.select("id", "v", *(c for c in rows.columns if c not in ("id", "v"))).mapInArrow(run, schema)


def dealt(queries: DataFrame, k: int) -> DataFrame | None:
    """Queries in as few partitions as their blocks need; None if there is none."""
    n = queries.count()
    return queries.repartition(-(-n // (block_size(k) * QUERY_PART))) if n else None


def block_size(k: int) -> int:
    """Queries of a block: fewer if each has many results."""
    return max(1, min(QUERY_BLOCK, HELD // (4 * k)))


def matched(items: DataFrame, asked: DataFrame, k: int, method: str, names: tuple[str, str], kinds: tuple[str, str], digits: int | None = None, on: Column | None = None) -> DataFrame:
    """(query, id, metric_value, rank) of the k nearest items of each query, from blocks of items and of queries.

    Each pair of blocks (on which `on` holds) meets in a task once. A task keeps the k best of the queries that it has, and
    a window over what tasks leave takes the k best of all. If the blocks have `cell` and `probes` (for each query as many
    bits as there are cells), a query meets only items of its cells.
    """
    schema = f"{names[0]} {kinds[0]}, {names[1]} {kinds[1]}, metric_value double, _key double"
    out = [names[0], names[1], "metric_value", "_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Best] = {}
        for b in batches:
            masks = "probes" in b.schema.names
            for i, block in enumerate(b.column("block").to_pylist()):
                ids, queries = b.column("ids")[i].values, b.column("queries")[i].values
                best = held.pop(block, None) or _Best(queries, ids.type, k)
                held[block] = best  # the last one used is the last to go
                x, q = _matrix(b.column("v")[i].values, len(ids)), _matrix(b.column("q")[i].values, len(queries))
                here = np.arange(len(q))
                if masks:
                    bits, cell = np.frombuffer(b.column("probes")[i].as_buffer(), np.uint8).reshape(len(q), -1), b.column("cell")[i].as_py()
                    here = np.flatnonzero(bits[:, cell >> 3] >> (7 - (cell & 7)) & 1)
                    if not len(here):
                        continue
                    q = q[here]
                near = _near(q, x, k, method, best.limit[here], digits)
                for lo in range(0, len(near), SIDE):
                    row, col = np.divmod(near[lo : lo + SIDE], len(x))
                    value = _distances(q[row], x[col], method)
                    best.add(here[row], value, value if digits is None else np.round(value, digits) + 0.0, ids.take(pa.array(col)))
                while len(held) > 1 and sum(len(x.row) for x in held.values()) > HELD:
                    yield held.pop(next(iter(held))).batch(out)
        for best in held.values():
            yield best.batch(out)

    asked = asked.withColumnsRenamed({"ids": "queries", "v": "q"}).hint("shuffle_replicate_nl")
    pairs = items.drop("block").crossJoin(asked) if on is None else items.drop("block").join(asked, on)
    found = pairs.drop("cells").mapInArrow(run, schema)
    w = Window.partitionBy(names[0]).orderBy(F.asc_nulls_last("_key"), names[1])
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_key")


def nearest_many(items: DataFrame, queries: DataFrame, k: int, method: str = "cosine_distance", id_col: str = "vec_id", vector_col: str = "embedding", query_col: str = "query_id", digits: int | None = None) -> DataFrame:
    """(query, id, metric_value, rank): for each row of queries(query_col, vector_col) its k nearest items.

    Items and queries meet in the tasks in blocks, whose distances are one matrix product; neither side passes the driver, and
    what a task holds does not grow with them. Items and queries without a vector take no part. Ties go to the
    smaller id; with `digits`, distances that are the same when rounded to these are ties.
    """
    metric(method)
    kinds = queries.schema[query_col].dataType.simpleString(), items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v is not null")
    asked = queries.select(F.col(query_col).alias("id"), F.col(vector_col).alias("v")).where("v is not null")
    asked = dealt(asked, k) if k > 0 else None
    if asked is None:
        return items.sparkSession.createDataFrame([], f"{query_col} {kinds[0]}, {id_col} {kinds[1]}, metric_value double, rank int")
    asked = checkpointed(blocks(asked, block_size(k), queries.schema[vector_col].dataType.simpleString()))
    return matched(blocks(rows, ITEM_BLOCK, items.schema[vector_col].dataType.simpleString()), asked, k, method, (query_col, id_col), kinds, digits)
