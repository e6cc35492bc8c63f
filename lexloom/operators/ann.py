"""Approximate nearest neighbours by cells: k-means over the vectors, rows written by cell, searches that read few cells."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import literal, metric
from ..shared import checkpointed
from .knn import ITEM_BLOCK, NUMBERS, block_size, blocks, dealt, matched, nearest, nearest_many

#: Rows for each cell that centroids are fitted on, rounds of k-means, bytes of all centroids at most.
PER_CELL, ROUNDS, CENTROID_BYTES = 256, 8, 64 << 20
#: Distances to centroids that a task has at once.
DISTANCES = 1 << 20
#: Share of the cells that is read unless a search says how many.
PROBED = 0.1


def _space(x: np.ndarray, method: str, longest: float) -> np.ndarray:
    """Vectors in the space of the cells, where nearest means nearest in Euclidean distance: of length one for cosine; for
    inner products, with one more number that makes all as long as the longest."""
    x = np.asarray(x, np.float32)
    square = (x.astype(np.float64) ** 2).sum(1)
    if method == "cosine_distance":
        return (x / np.sqrt(np.maximum(square, 1e-30))[:, None]).astype(np.float32)
    if method == "negative_inner_product":
        return np.hstack([x, np.sqrt(np.maximum(longest**2 - square, 0))[:, None].astype(np.float32)])
    return x


def _order(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centroids of each vector, nearest first. Vectors are taken a few at a time, for memory."""
    centroids = centroids.astype(np.float64)
    square, out, step = (centroids**2).sum(1)[None, :], np.zeros((len(x), n), np.int64), max(1, DISTANCES // len(centroids))
    for lo in range(0, len(x), step):
        far = square - 2 * x[lo : lo + step].astype(np.float64) @ centroids.T
        out[lo : lo + step] = np.argmin(far, 1)[:, None] if n == 1 else np.argsort(far, 1, kind="stable")[:, :n]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def _usable(rows: DataFrame, vector_col: str) -> Column:
    """Vectors that have a place: not null, no null or NaN inside."""
    return F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda v: v.isNull() | F.isnan(v.cast("double")))


def _fit(vectors: DataFrame, cells: int, method: str, longest: float, rounds: int) -> np.ndarray:
    """Centroids of vectors(v, h) by Lloyd's rounds: each task sums its vectors by cell, a grouped sum adds these."""
    start = vectors.orderBy("h", "v").limit(cells).select("v").toArrow().column("v").combine_chunks()
    centroids = np.unique(_space(_matrix(start), method, longest), axis=0)

    def sums(now: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(now.shape), np.zeros(len(now), np.int64)
            for b in batches:
                if b.num_rows:
                    x = _space(_matrix(b.column("v")), method, longest)
                    cell = _order(x, now, 1)[:, 0]
                    np.add.at(total, cell, x)
                    n += np.bincount(cell, minlength=len(now))
            there = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(list(total[there]), pa.list_(pa.float64())), pa.array(n[there])], ["cell", "total", "n"])

        return run

    def added(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": [key[0]], "mean": [np.stack(group["total"].to_list()).sum(0) / group["n"].sum()]})

    for _ in range(rounds):
        found = vectors.mapInArrow(sums(centroids), "cell int, total array<double>, n long").groupBy("cell").applyInPandas(added, "cell int, mean array<double>").collect()  # a row for each cell
        moved = centroids.copy()
        for r in found:
            moved[r["cell"]] = r["mean"]
        if np.allclose(moved, centroids, atol=1e-6):
            break
        centroids = moved.astype(np.float32)
    return centroids


@dataclass
class VectorIndex:
    """Rows of (id, vector) in folders by cell under a path, with the centroids."""

    spark: SparkSession
    path: str
    method: str
    id_col: str
    vector_col: str
    longest: float
    centroids: np.ndarray

    @property
    def rows(self) -> DataFrame:
        """All rows with their cell. Only the folders of the cells that a filter on `cell` names are read."""
        return self.spark.read.parquet(f"{self.path}/cells")

    def add(self, items: DataFrame) -> None:
        """Writes rows of items to the cells that they belong to. Rows without a usable vector are left out."""
        longest, method, centroids, kind = self.longest, self.method, self.centroids, items.schema[self.id_col].dataType.simpleString()

        def cell_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = _order(_space(_matrix(b.column("v")), method, longest), centroids, 1)[:, 0] if b.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

        rows = items.where(_usable(items, self.vector_col)).select(F.col(self.id_col).alias("id"), F.col(self.vector_col).cast("array<float>").alias("v"))
        dealt = rows.mapInArrow(cell_of, f"id {kind}, v array<float>, cell int").hint("rebalance", "cell")  # a hot cell gives several files
        dealt.select(F.col("id").alias(self.id_col), F.col("v").alias(self.vector_col), "cell").write.mode("append").partitionBy("cell").parquet(f"{self.path}/cells")

    def cells_of(self, vector: Sequence[float], probes: int | None = None) -> list[int]:
        """The cells nearest to a vector."""
        if probes is None:
            probes = max(1, math.ceil(PROBED * len(self.centroids)))
        x = np.asarray([vector], np.float32)
        longest = self.longest if self.method == "negative_inner_product" else 0.0
        q = np.hstack([x, [[0]]]) if self.method == "negative_inner_product" else _space(x, self.method, longest)
        return _order(q.astype(np.float32), self.centroids, min(probes, len(self.centroids)))[0].tolist()

    def nearest(self, vector: Sequence[float], k: int, probes: int | None = None, where: Column | str | None = None, exclude: DataFrame | None = None) -> DataFrame:
        """The k nearest of the rows in the cells nearest to a vector, as knn.nearest() gives them; with as many probes as
        cells, the k nearest of all."""
        near = self.rows.where(F.col("cell").isin(self.cells_of(vector, probes))).drop("cell")
        return nearest(near, vector, k, self.method, self.id_col, self.vector_col, where, exclude)

    def nearest_many(self, queries: DataFrame, k: int, probes: int | None = None, query_col: str = "query_id", digits: int | None = None) -> DataFrame:
        """(query, id, metric_value, rank): for each row of queries(query_col, vector_col) the k nearest of its cells.

        Queries and the rows of a cell meet in blocks, as in knn.nearest_many(), where a query takes part if it probes the
        cell. Only the folders of the cells that some query probes are read; neither side passes the driver. Ties go to the
        smaller id (`digits` as there); queries without a usable vector take no part.
        """
        index, centroids, method = self, self.centroids, self.method
        n = max(1, math.ceil(PROBED * len(centroids))) if probes is None else min(probes, len(centroids))
        asked = queries.where(_usable(queries, index.vector_col)).select(query_col, F.col(index.vector_col).cast("array<float>").alias(index.vector_col))
        if n == len(centroids):
            return nearest_many(self.rows.drop("cell"), asked, k, method, self.id_col, self.vector_col, query_col, digits)
        kinds = queries.schema[query_col].dataType.simpleString(), self.rows.schema[self.id_col].dataType.simpleString()
        asked = dealt(asked.toDF("id", "v"), k) if k > 0 and n > 0 else None
        if asked is None:
            return self.spark.createDataFrame([], f"{query_col} {kinds[0]}, {self.id_col} {kinds[1]}, metric_value double, rank int")

        def probed(b: pa.RecordBatch):
            def columns(lo: int, hi: int) -> list[pa.Array]:
                x = _matrix(b.column("v").slice(lo, hi - lo))
                x = np.hstack([x, np.zeros((len(x), 1), np.float32)]) if method == "negative_inner_product" else _space(x, method, 0.0)
                bits = np.zeros((len(x), len(centroids)), bool)
                np.put_along_axis(bits, _order(x, centroids, n), True, 1)
                return [pa.array([np.flatnonzero(bits.any(0)).astype(np.int32)], pa.list_(pa.int32())), pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary())]

            return None, [b.num_rows], columns

        def by_cell(b: pa.RecordBatch):
            cell = b.column("cell").to_numpy()
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            return order, [*(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)], lambda lo, hi: [pa.array([cell[lo]], pa.int32())]

        asked = checkpointed(blocks(asked, min(block_size(k), max(1, 8 * NUMBERS // len(centroids))), "array<float>", ", cells array<int>, probes binary", probed))
        rows, read = self.rows, [r[0] for r in asked.select(F.explode("cells")).distinct().collect()]  # numbers of cells
        if len(read) < len(centroids):
            rows = rows.where(F.col("cell").isin(read))
        rows = rows.select(F.col(self.id_col).alias("id"), F.col(self.vector_col).alias("v"), "cell")
        items = blocks(rows, ITEM_BLOCK, "array<float>", ", cell int", by_cell)
        return matched(items, asked, k, method, (query_col, self.id_col), kinds, digits, F.array_contains("cells", F.col("cell")))

    def write_description(self) -> None:
        row = (self.method, self.id_col, self.vector_col, self.longest, self.centroids.shape[1], [c.tolist() for c in self.centroids])
        self.spark.createDataFrame([row], _DESCRIPTION).coalesce(1).write.parquet(f"{self.path}/description")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> VectorIndex:
        r = spark.read.schema(_DESCRIPTION).parquet(f"{path}/description").first()
        return cls(spark, path, r["method"], r["id_col"], r["vector_col"], r["longest"], np.array(r["centroids"], np.float32).reshape(-1, r["width"]))


_DESCRIPTION = "method string, id_col string, vector_col string, longest double, width int, centroids array<array<float>>"


def build(items: DataFrame, path: str, method: str = "cosine_distance", cells: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", rounds: int = ROUNDS) -> VectorIndex:
    """An index of items(id_col, vector_col) under a new path. By default there are as many cells as the root of the rows.

    Centroids are fitted on PER_CELL rows for each cell, about, chosen by a hash of the id; every row is written. What the
    driver holds are the centroids, CENTROID_BYTES at most.
    """
    metric(method)
    spark, good = items.sparkSession, items.where(_usable(items, vector_col))
    square = F.aggregate(vector_col, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    n, longest, width, least = good.agg(F.count("*"), F.max(square), F.max(F.size(vector_col)), F.min(F.size(vector_col))).first()
    if not n:
        raise ValueError("there is no vector to index")
    if width != least:
        raise ValueError(f"vectors have {least} to {width} numbers")
    cells = max(1, min(cells or math.ceil(math.sqrt(n)), n, CENTROID_BYTES // (4 * (width + 1))))
    h = F.xxhash64(id_col)
    share = min(1.0, 1.05 * PER_CELL * cells / n)
    sample = good.select(F.col(vector_col).cast("array<float>").alias("v"), h.alias("h")).where(F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30)))
    centroids = _fit(checkpointed(sample), cells, method, math.sqrt(longest), rounds)
    index = VectorIndex(spark, path.rstrip("/"), method, id_col, vector_col, math.sqrt(longest), centroids)
    index.add(items.select(id_col, vector_col))
    index.write_description()
    return index


def recall(found: DataFrame, exact: DataFrame, query_col: str = "query_id", id_col: str = "vec_id") -> float:
    """Share of the exact (query, id) rows that were found."""
    keys = [query_col, id_col]
    return found.select(*keys).join(exact.select(*keys), keys).count() / max(exact.count(), 1)
