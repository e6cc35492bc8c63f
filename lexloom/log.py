"""What a store's changes need: numbers that one writer gets, and descriptions of files that tell which to read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGE = "number long, base long, documents array<string>, chunks array<string>, gone array<string>, manifests array<string>, last_doc long, last_chunk long"
MANIFEST = "kind string, file string, low string, high string, rows long, bloom binary"
#: File systems on which creating a file that must not exist is atomic.
ATOMIC = ("hdfs", "viewfs", "abfs", "abfss")
#: Option of stores that create a file only if there is none.
CONDITIONAL = "fs.option.create.conditional.overwrite"
#: Bits of a Bloom filter for a key, and places that a key sets.
BITS, PLACES = 12, 5
#: Keys of a load up to which files are looked up in the manifests; beyond, all are read.
FEW = 50_000


def file_system(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def claimed(spark: SparkSession, folder: str, number: int) -> bool:
    """Whether this call, and no other, made the file that claims a number.

    On a local disk the operating system sees to that, on HDFS and Azure the file system; object stores have to support
    conditional creation, and those that don't raise instead of letting two writers commit.
    """
    system, path = file_system(spark, f"{folder}/claims/{number}")
    scheme = system.getUri().getScheme()
    system.mkdirs(path.getParent())
    try:
        if scheme == "file":
            return bool(spark._jvm.java.io.File(path.toUri().getPath()).createNewFile())
        if scheme in ATOMIC:
            system.create(path, False).close()
        else:
            system.createFile(path).overwrite(False).must(CONDITIONAL, True).build().close()
        return True
    except Py4JJavaError as e:
        said = str(e.java_exception)
        if "FileAlreadyExists" in said or "already exists" in said or "412" in said:
            return False
        if "IllegalArgument" in said or "UnsupportedOperation" in said:
            raise ValueError(f"{scheme} cannot create a file conditionally: use another file system for a store with several writers") from e
        raise


@dataclass
class State:
    """A store as of a change: folders since the last compaction (`base`), oldest first, and the ids that were given last."""

    number: int
    base: int
    documents: list[str]
    chunks: list[str]
    gone: list[str]
    manifests: list[str]
    last_doc: int
    last_chunk: int

    def __getitem__(self, name: str):
        return getattr(self, name)


def state(spark: SparkSession, root: str, at: int | None = None) -> State | None:
    """The state after change `at`, or the last one. Read are the changes since its compaction."""
    rows = spark.read.schema(CHANGE).parquet(f"{root}/changes")
    last = (rows if at is None else rows.where(F.col("number") == at)).orderBy(F.desc("number")).first()
    if last is None:
        return None
    some = sorted(rows.where(F.col("number").between(last["base"], last["number"])).collect())  # one for each change since
    listed = lambda kind: [x for r in some for x in r[kind]]
    return State(last["number"], last["base"], *(listed(k) for k in ("documents", "chunks", "gone", "manifests")), last["last_doc"], last["last_chunk"])


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    h = h.view(np.uint64)
    one, two = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return ((one[:, None] + np.arange(PLACES, dtype=np.uint64) * two[:, None]) % np.uint64(bits)).astype(np.int64)


def bloom(hashes: np.ndarray) -> bytes:
    field = np.zeros(max(64, BITS * len(hashes)) // 8 + 1, np.uint8)
    at = _places(hashes, 8 * len(field)).reshape(-1)
    np.bitwise_or.at(field, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return field.tobytes()


def may_hold(field: bytes, hashes: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(field, np.uint8)
    at = _places(hashes, 8 * len(bits))
    return (bits[at >> 3] >> (at & 7) & 1).all(axis=1)


def described(rows: DataFrame, kind: str, key: str) -> DataFrame:
    """MANIFEST rows of the files that rows were read from: range and Bloom filter of their keys. Null keys are not in them."""
    keys = rows.select(F.col("_metadata.file_path").alias("file"), F.col(key).cast("string").alias("k"), F.xxhash64(F.col(key).cast("string")).alias("h")).distinct()

    def of_file(name: tuple, group: pd.DataFrame) -> pd.DataFrame:
        known = group[group["k"].notna()]
        low, high = (known["k"].min(), known["k"].max()) if len(known) else (None, None)
        return pd.DataFrame([[kind, name[0], low, high, len(group), bloom(known["h"].to_numpy(np.int64))]], columns=["kind", "file", "low", "high", "rows", "bloom"])

    return keys.groupBy("file").applyInPandas(of_file, MANIFEST)


def files_with(manifests: DataFrame, kind: str, keys: DataFrame) -> list[str] | None:
    """The files of a kind that may hold one of keys(key); None if there are more keys than FEW."""
    some = keys.select(F.col("key").cast("string").alias("k"), F.xxhash64(F.col("key").cast("string")).alias("h")).where("k is not null").distinct().limit(FEW + 1).toPandas()
    if len(some) > FEW:
        return None
    asked, hashes = some["k"].to_numpy(object), some["h"].to_numpy(np.int64)

    def holding(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = []
            for low, high, field in zip(f["low"], f["high"], f["bloom"]):
                inside = low is not None and len(asked) and may_hold(field, hashes)
                keep.append(bool(low is not None and len(asked) and any(low <= k <= high for k in asked[inside])))
            yield f.loc[keep, ["file"]]

    found = manifests.where(F.col("kind") == kind).mapInPandas(holding, "file string")
    return [r["file"] for r in found.collect()]
