"""Helpers shared by the training-data operators: tables, shared storage, joins by proven size."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has at most so many rows of a few fixed-size columns.
BROADCAST_ROWS = 2_000_000
#: Column of the row hash while rows are told apart; another name is taken where documents have one of this name.
ROW_HASH = "__row_hash"


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is used from a checkout and not installed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset: a new one in local mode, as
    in tests; elsewhere a ValueError, since executors would write to their own disks."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not sc.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


#: Folders of intermediate tables that this process has made, newest last.
_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A name in the shared folder that nothing else has."""
    _made.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: cuts the lineage and survives lost executors."""
    ready(df.sparkSession)
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing needs any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the intermediate tables made inside it. Results that read them must be written before."""
    before = len(_made)
    try:
        yield
    finally:
        while len(_made) > before:
            dropped(spark, _made.pop())


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder; Spark removes the files once nothing refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it is counted to be small; otherwise as it is, for a shuffled join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def text_of(name: str) -> Column:
    """A text column where null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_hash(id_col: str, text_col: str) -> Column:
    """A hash of id and text, which tells rows with the same id apart."""
    return F.xxhash64(F.col(id_col), text_of(text_col))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has: the given ones, with underscores in front where they are taken."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, rejected: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id and row hash are in rejected(id, h). Texts are shuffled only if the list is long.

    Any columns of docs stay as they are, whatever their names. Null ids match null ids; rows with the same id and text
    go together. An empty list leaves docs as it is.
    """
    mark, listed_id, listed_h = fresh(docs, ROW_HASH, "__listed_id", "__listed_h")
    listed = small(written(rejected.select(F.col("id").alias(listed_id), F.col("h").alias(listed_h)).distinct(), "rejected"))
    marked = docs.withColumn(mark, row_hash(id_col, text_col))
    return marked.join(listed, (F.col(mark) == F.col(listed_h)) & F.col(id_col).eqNullSafe(F.col(listed_id)), "left_anti").drop(mark)


def only(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text", once: bool = True) -> DataFrame:
    """The rows of docs whose id and row hash are in wanted(id, h); of rows with the same id and text one if `once`."""
    mark, listed_id, listed_h = fresh(docs, ROW_HASH, "__listed_id", "__listed_h")
    listed = small(written(wanted.select(F.col("id").alias(listed_id), F.col("h").alias(listed_h)).distinct(), "wanted"))
    marked = docs.withColumn(mark, row_hash(id_col, text_col))
    found = marked.join(listed, (F.col(mark) == F.col(listed_h)) & F.col(id_col).eqNullSafe(F.col(listed_id)), "left_semi")
    return (found.dropDuplicates([mark]) if once else found).drop(mark)
