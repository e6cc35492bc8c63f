"""SimHash near-dedup with Golay-code keys.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Of two fingerprints at a distance of at most
two, one segment is equal (pigeonhole) and the next one differs in at most two bits. Each segment is decoded
to codewords of the binary Golay code [23,12,7]: the segment and all its one-bit neighbours decode to one or
six 12-bit codeword indices, and two segments at a distance of at most two share one of these, since the point
between them is a neighbour of both. So a key is (which segment is equal, its bits, an index of the next), and
each fingerprint has about sixteen keys. Fingerprints that share a key are compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, row_hash, text_of, without, written
from .components import components

SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1. Fixed value.
GOLAY = 0b110001110101
#: Buckets up to this size are compared pair by pair; larger ones by the points between their members.
PAIRS_UP_TO = 24
SHINGLE = 3


def _remainder(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GOLAY << (i - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes by byte of a 23-bit word, and the error pattern of up to three bits for each syndrome."""
    unit = [_remainder(1 << i) for i in range(23)]
    by_byte = np.zeros((3, 256), np.int64)
    for k in range(3):
        for v in range(256):
            for i in range(8):
                if v >> i & 1 and 8 * k + i < 23:
                    by_byte[k, v] ^= unit[8 * k + i]
    error = np.zeros(2048, np.int64)
    for i in range(23):
        error[unit[i]] = 1 << i
        for j in range(i):
            error[unit[i] ^ unit[j]] = 1 << i | 1 << j
            for k in range(j):
                error[unit[i] ^ unit[j] ^ unit[k]] = 1 << i | 1 << j | 1 << k
    return by_byte, error


_BY_BYTE, _ERROR = _tables()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12 information bits of the codeword nearest to each 23-bit word."""
    syndrome = _BY_BYTE[0, words & 255] ^ _BY_BYTE[1, words >> 8 & 255] ^ _BY_BYTE[2, words >> 16 & 255]
    return (words ^ _ERROR[syndrome]) >> 11


def keys_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For unsigned fingerprints: (position of the fingerprint, key), each key once for a fingerprint."""
    parts = [(fingerprints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        nxt = (i + 1) % 3
        flips = np.array([0] + [1 << b for b in range(SEGMENTS[nxt][1])], np.int64)
        found = np.sort(codeword_index(parts[nxt][:, None] ^ flips), axis=1)
        new = np.ones(found.shape, bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        at, col = np.nonzero(new)
        rows.append(at)
        keys.append(i << 34 | parts[i][at] << 12 | found[at, col])
    return np.concatenate(rows), np.concatenate(keys)


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(text: str | None) -> int:
    """The 64-bit fingerprint of a text, unsigned; 0 for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    k = min(SHINGLE, len(words))
    starts, ends = (ends - sizes)[: len(words) - k + 1], ends[k - 1 :]
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, len(starts), 1 << 16):
        spans = zip(starts[lo : lo + (1 << 16)].tolist(), ends[lo : lo + (1 << 16)].tolist())
        h = np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            total[8 * byte : 8 * byte + 8] += np.bincount(h[:, byte], minlength=256) @ _BITS
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((simhash(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), pa.array(fp.view(np.int64))], ["id", "h", "fp"])


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for lo in range(0, len(fp), 20_000):
            part = fp[lo : lo + 20_000]
            at, keys = keys_of(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[at].view(np.int64))], ["k", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, fp): one row per input row; fp is the fingerprint as a signed long, h a hash of id and text.
    Null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), row_hash(id_col, text_col).alias("h"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_fingerprint_batches, f"id {kind}, h long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that join all fingerprints at a distance of 1 or 2 in distinct(fp), directly or over others linked.

    Buckets of a key with up to PAIRS_UP_TO members give their verified pairs. Members of larger buckets are
    grouped by the points between fingerprints instead: each fingerprint names itself and its 64 one-bit
    neighbours, two of them name a common point exactly if they differ in at most two bits, and no point has
    more than 65 names. That takes time in proportion to the bucket and loses no link.
    """
    keys = distinct.select("fp").mapInArrow(_key_batches, "k long, fp long")
    shared = keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keys.join(shared.withColumnRenamed("k", "k2"), F.col("k") == F.col("k2")).select("k", "fp", "n"), "simhash-buckets")
    few = members.where(F.col("n") <= PAIRS_UP_TO).groupBy("k").agg(F.array_sort(F.collect_list("fp")).alias("m"))
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= 2
    pairs = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (x < y) & near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    direct = few.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    points = (
        members.where(F.col("n") > PAIRS_UP_TO).select("fp").distinct()
        .select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
        .groupBy("point").agg(F.collect_list("fp").alias("m")).where(F.size("m") > 1)
        .select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b")
    )
    return direct.union(points)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, fp, component, root): one row per input row; component is the least id that links reach, itself
    included, and root names the component (its least fingerprint).

    Links: fingerprints that differ in at most 2 of 64 bits. Empty and null texts have fingerprint 0 and link
    like others. Null ids are never the least while another id is there. An empty table gives no rows.
    """
    fps = written(fingerprints(docs, id_col, text_col), "simhash")
    distinct = written(fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = components(links(distinct))
    grouped = distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "root", "least")
    least = grouped.groupBy("root").agg(F.min("least").alias("of_root"))
    named = grouped.join(least.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select("fp", "root", "of_root")
    classes = distinct.join(named.withColumnRenamed("fp", "f"), F.col("fp") == F.col("f"), "left")
    classes = classes.select(F.col("fp").alias("class_fp"), F.when(F.col("f").isNull(), F.col("least")).otherwise(F.col("of_root")).alias("component"), F.coalesce("root", "fp").alias("root"))
    return fps.join(classes, F.col("fp") == F.col("class_fp")).select("id", "h", "fp", "component", "root")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: that with the least id, of rows with that id one.

    A component whose ids are all null keeps one row too.
    """
    found = written(near_duplicates(docs, id_col, text_col), "simhash-classes")
    first = found.where(F.col("id").eqNullSafe(F.col("component"))).groupBy("root").agg(F.min("h").alias("first_h"), F.count("*").alias("c"))
    first = first.withColumnRenamed("root", "r")
    beside = found.join(first, F.col("root") == F.col("r"))
    stays = F.col("id").eqNullSafe(F.col("component")) & (F.col("h") == F.col("first_h"))
    left = without(docs, beside.where(~stays).select("id", "h"), id_col, text_col)
    several = written(beside.where(stays & (F.col("c") > 1)).groupBy("id", "h").agg(F.count("*").alias("n")).where("n > 1").select("id", "h"), "simhash-repeated")
    if several.isEmpty():
        return left
    return without(left, several, id_col, text_col).union(only(left, several, id_col, text_col))
