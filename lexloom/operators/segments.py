"""A full-text index in segments: postings in blocks with a bound of what they can score, changes as segments of their own."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.text import terms
from ..kernels.porter import stem
from ..shared import checkpointed
from .bm25 import B, K, Index, asked_terms, best, in_blocks, sendable, top_of_parts, weighted

#: Documents of a part: a block has the postings of a term in a part.
PART = 512
#: Parts of each query that are scored first, for the threshold.
FIRST = 8
#: Parts up to which their numbers are sent to the blocks, so that others are not moved.
PLACES = 1 << 16
#: Segments of about one size (a factor of TIER) that are merged into one.
MERGED, TIER = 4, 8
#: Segments that an index must not exceed, whatever their sizes.
MOST = 24


def _cut(stemmed: bool, kind: pa.DataType):
    """Parts of documents (id, words) as blocks (term, part, ids, tf, len, top_tf, top_len); the block of no term has all of the
    part's documents. top_tf and top_len are of the postings that no other beats in both, a few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known = TaskContext.get().partitionId() << 32, {}
        for b in batches:
            for lo in range(0, b.num_rows, PART):
                part = b.slice(lo, PART)
                words = part.column("words")
                long = np.diff(words.offsets.to_numpy())
                coded = words.flatten().dictionary_encode()
                listed, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                if stemmed:
                    for w in listed:
                        if w not in known:
                            known[w] = stem(w)
                    names = sorted({known[w] for w in listed})
                    place = {t: i for i, t in enumerate(names)}
                    codes = np.array([place[known[w]] for w in listed], np.int64)[codes] if listed else codes
                    listed = names
                pairs, tf = np.unique(codes * PART + np.repeat(np.arange(part.num_rows), long), return_counts=True)
                term, doc = pairs // PART, pairs % PART
                first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
                tf, doc_len = tf.astype(np.int32), long[doc].astype(np.int32)
                order = np.lexsort((-tf, doc_len, term))
                most = np.maximum.accumulate(term[order] * (1 << 32) + tf[order]) if len(order) else order
                best_yet = np.concatenate([[True], most[1:] > most[:-1]]) if len(order) else np.zeros(0, bool)
                tops = order[best_yet]  # a new term is greater than all before
                of_top = pa.array(np.concatenate([np.searchsorted(term[tops], term[first]), [len(tops), len(tops)]]).astype(np.int32))
                every = np.arange(part.num_rows)
                at = pa.array(np.concatenate([first, [len(doc), len(doc) + len(every)]]).astype(np.int32))
                lists = lambda values: pa.ListArray.from_arrays(at, values)
                all_tf = np.concatenate([tf, np.zeros(len(every), np.int32)])
                columns = [
                    pa.array([*(listed[t] for t in term[first].tolist()), None], pa.string()),
                    pa.array(np.full(len(first) + 1, number)),
                    lists(part.column("id").take(pa.array(np.concatenate([doc, every])))),
                    lists(pa.array(all_tf)),
                    lists(pa.array(np.concatenate([doc_len, long.astype(np.int32)]))),
                    *(pa.ListArray.from_arrays(of_top, pa.array(x[tops])) for x in (tf, doc_len)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["term", "part", "ids", "tf", "len", "top_tf", "top_len"])
                number += 1

    return run


def _words(chunks: DataFrame, id_col: str, fields: Sequence[str], stemmed: bool, stop_words: bool) -> DataFrame:
    words = F.concat(*[terms(F.col(f), stop_words, accents=stemmed) for f in fields])
    return chunks.select(F.col(id_col).alias("id"), words.alias("words"))


def _types(kind: str) -> str:
    return f"term string, part long, ids array<{kind}>, tf array<int>, len array<int>, top_tf array<int>, top_len array<int>"


def blocks(chunks: DataFrame, id_col: str, fields: Sequence[str], stemmed: bool, stop_words: bool) -> DataFrame:
    """Blocks of chunks as they are read; texts are not shuffled."""
    each = _words(chunks, id_col, fields, stemmed, stop_words)
    kind = each.schema["id"].dataType
    return each.mapInArrow(_cut(stemmed, to_arrow_type(kind)), _types(kind.simpleString()))


def _write(found: DataFrame, path: str) -> None:
    """Blocks in order of term in each file, so that look-ups of terms skip the rest. They stay with the task that made them:
    blocks are most of the index, and a hot term has them in all files."""
    found.sortWithinPartitions("term", "part").write.parquet(f"{path}/blocks")


@dataclass
class SegmentIndex:
    """Segments under their paths: blocks/, frequencies/(term, df), totals/(n, length) as what they add, gone/(id) removed by them.

    What a segment takes away is in its frequencies and totals too, with a minus, so that sums over all segments are those of
    the documents that are there.
    """

    spark: SparkSession
    paths: list[str]
    stemmed: bool = False
    stop_words: bool = False
    _kept: dict = field(default_factory=dict)

    def _read(self, what: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{p}/{what}" for p in self.paths])

    @property
    def gone(self) -> DataFrame:
        return self._read("gone").distinct()

    def _any_gone(self) -> bool:
        if "gone" not in self._kept:
            self._kept["gone"] = not self._read("gone").isEmpty()
        return self._kept["gone"]

    def _postings(self, found: DataFrame) -> DataFrame:
        """(term, id, tf, len, columns of found) of blocks, without removed documents."""
        keep = [c for c in found.columns if c not in ("part", "ids", "tf", "len", "top_tf", "top_len")]
        rows = found.select(*keep, F.explode(F.arrays_zip("ids", "tf", "len")).alias("p")).select(*keep, F.col("p.ids").alias("id"), F.col("p.tf").cast("long").alias("tf"), F.col("p.len").cast("long").alias("len"))
        return rows.join(self.gone, "id", "left_anti") if self._any_gone() else rows

    @property
    def totals(self) -> DataFrame:
        sums = self._read("totals").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
        return sums.select("n", F.try_divide(F.col("length").cast("double"), F.col("n")).alias("average"))

    @property
    def frequencies(self) -> DataFrame:
        found = self._read("frequencies")
        return found if len(self.paths) == 1 else found.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def index(self) -> Index:
        """As an index that bm25.score() reads whole."""
        return Index(self._postings(self._read("blocks").where("term is not null")), self.totals, self.stemmed, self.stop_words, self.frequencies)

    def top(self, queries: DataFrame, top_k: int, query_col: str = "query_id", text_col: str = "text", k: float = K, b: float = B, counts: dict | None = None, digits: int | None = None) -> DataFrame:
        """(query, id, metric_value): the top_k documents of each query, as bm25.best() of all scores gives them (`digits` as there).

        Blocks tell what one of their postings scores at most, so the sum of what a query's terms can score at most in a part is
        known from these alone. The FIRST parts by that are scored; their top_k-th score is the threshold that the
        other parts have to reach to be scored. With `counts`, the numbers of blocks of the queries' terms and of those that
        are scored go there.
        """
        asked = asked_terms(queries, query_col, text_col, self.stemmed, self.stop_words)
        sent = sendable(asked)
        weights = weighted(asked, self.frequencies, self.totals, k, sent)

        def sendable_side(df: DataFrame) -> DataFrame:
            return F.broadcast(df) if sent else df

        def part_of(tf: Column, length: Column) -> Column:
            return tf / (tf + k * (1 - b + b * length / F.col("average")))

        # which segment a part is of is told by its path, since numbers of parts repeat
        all_blocks = self._read("blocks").withColumn("segment", F.substring_index(F.col("_metadata.file_path"), "/blocks/", 1))
        place = ["segment", "part"]
        heads = all_blocks.select("term", *place, "top_tf", "top_len").join(sendable_side(weights), "term")
        most = F.array_max(F.transform(F.arrays_zip("top_tf", "top_len"), lambda x: part_of(x["top_tf"], x["top_len"])))
        heads = heads.groupBy(query_col, *place).agg(F.sum(F.col("weight") * most).alias("most"), F.count("*").alias("blocks"))
        heads = checkpointed(heads)
        order = Window.partitionBy(query_col).orderBy(F.desc("most"), *place)
        some = Window.partitionBy(query_col, F.pmod(F.xxhash64(*place), F.lit(32))).orderBy(F.desc("most"), *place)
        first = heads.withColumn("_n", F.row_number().over(some)).where(F.col("_n") <= FIRST).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= FIRST).drop("_n")
        hit = all_blocks.select(*place, "term", "ids", "tf", "len").join(sendable_side(weights.select("term").distinct()), "term", "left_semi")
        many = in_blocks(weights)

        def scores(wanted: DataFrame) -> DataFrame:
            """The top_k of each query in each of its parts. Blocks meet what their part's queries ask for, and a task leaves no
            more than that."""
            wanted = checkpointed(wanted.select(query_col, *place))
            places = wanted.select(*place).distinct()
            blocks = hit.join(F.broadcast(places), place, "left_semi") if places.count() <= PLACES else hit
            each = wanted.withColumnRenamed(query_col, "_asked").join(sendable_side(weights), F.col("_asked").eqNullSafe(F.col(query_col))).drop("_asked")
            lost = None
            if self._any_gone():
                lost = all_blocks.where("term is null").join(places, place, "left_semi").select(*place, F.explode("ids").alias("lost"))
                lost = lost.join(self.gone.withColumnRenamed("id", "lost"), "lost", "left_semi")
            return top_of_parts(blocks, each, place, top_k, query_col, many, k, b, digits, lost)

        head = checkpointed(best(scores(first), top_k, query_col, digits))
        limit = head.groupBy(F.col(query_col).alias("_asked")).agg(F.count("*").alias("have"), F.min("metric_value").alias("least")).where(F.col("have") >= top_k)
        # sums of floats may differ in their last digits
        done = first.select(F.col(query_col).alias("_asked"), *(F.col(c).alias(f"_{c}") for c in place))
        same = F.col(query_col).eqNullSafe(F.col("_asked"))
        rest = heads.join(done, same & (F.col("segment") == F.col("_segment")) & (F.col("part") == F.col("_part")), "left_anti")
        rest = rest.join(limit, same, "left").where(F.col("least").isNull() | (F.col("most") >= F.col("least") * (1 - 1e-9) - (0.0 if digits is None else 10.0**-digits)))
        if counts is not None:
            rest = checkpointed(rest)
            counts["blocks"], counts["scored"] = (x.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0] for x in (heads, first.select("blocks").union(rest.select("blocks"))))
        return best(head.unionByName(scores(rest)), top_k, query_col, digits)

    def add(self, path: str, chunks: DataFrame, removed: DataFrame, id_col: str, fields: Sequence[str]) -> SegmentIndex:
        """The index with a segment at path for chunks that are new and those that were removed (with their texts)."""
        write_segment(chunks, path, id_col, fields, self.stemmed, self.stop_words, removed)
        return SegmentIndex(self.spark, [*self.paths, path], self.stemmed, self.stop_words)

    def sizes(self) -> list[int]:
        """Postings of each segment."""
        return [self.spark.read.parquet(f"{p}/blocks").agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0] for p in self.paths]

    def to_merge(self) -> list[str]:
        """Segments that merge() should take: the last ones, while MERGED or more of them are of about one size."""
        sizes = self.sizes()
        for i in range(len(sizes)):
            last = sizes[i:]
            if len(last) >= MERGED and max(last) <= TIER * max(1, sorted(last)[len(last) // 2]):
                return self.paths[i:]
        return self.paths[-MOST // 2 :] if len(sizes) > MOST else []

    def merge(self, path: str, some: Sequence[str]) -> SegmentIndex:
        """The index with the segments `some`, which must be its last ones, made one at path; removed documents of theirs leave."""
        some = list(some)
        if not some or self.paths[-len(some) :] != some:
            raise ValueError("only the last segments are merged")
        these = SegmentIndex(self.spark, some, self.stemmed, self.stop_words)
        found = these._read("blocks")
        if these._any_gone():
            gone = these.gone
            each = found.select("term", "part", F.substring_index(F.col("_metadata.file_path"), "/blocks/", 1).alias("segment"), "top_tf", "top_len", F.explode(F.arrays_zip("ids", "tf", "len")).alias("p"))
            each = each.join(gone, F.col("p.ids") == F.col("id"), "left_anti")  # blocks stay as small as they were
            made = each.groupBy("segment", "part", "term").agg(F.collect_list("p").alias("p"), F.first("top_tf").alias("top_tf"), F.first("top_len").alias("top_len"))
            lists = [F.col(f"p.{c}").alias(c) for c in ("ids", "tf", "len")]
            found = made.select("term", "part", "segment", *lists, "top_tf", "top_len")
        else:
            found = found.withColumn("segment", F.substring_index(F.col("_metadata.file_path"), "/blocks/", 1))
        numbers = self.spark.createDataFrame([(p.rsplit("/", 1)[-1], i) for i, p in enumerate(some)], "name string, number long")
        found = found.withColumn("name", F.substring_index("segment", "/", -1)).join(F.broadcast(numbers), "name")
        # parts of different segments stay apart: their numbers use 52 bits at most
        _write(found.withColumn("part", F.col("part") + F.shiftleft("number", 52)).drop("segment", "name", "number"), path)
        these._read("frequencies").groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").write.parquet(f"{path}/frequencies")
        these._read("totals").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).write.parquet(f"{path}/totals")
        these.gone.write.parquet(f"{path}/gone")  # these may be in earlier segments
        return SegmentIndex(self.spark, [*self.paths[: -len(some)], path], self.stemmed, self.stop_words)


def write_segment(chunks: DataFrame, path: str, id_col: str, fields: Sequence[str], stemmed: bool = False, stop_words: bool = False, removed: DataFrame | None = None) -> SegmentIndex:
    """A segment of chunks under a new path. Null texts count as empty; chunks without terms count in the averages.

    `removed` are chunks of other segments that are no more: their terms are taken off the frequencies.
    """
    spark = chunks.sparkSession
    _write(blocks(chunks, id_col, fields, stemmed, stop_words), path)
    found = spark.read.parquet(f"{path}/blocks")
    counted = found.where("term is not null").groupBy("term").agg(F.sum(F.size("ids")).alias("df"))
    length = lambda: F.aggregate("len", F.lit(0).cast("long"), lambda a, x: a + x)
    sums = [F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum(length()), F.lit(0)).alias("length")]
    totals = found.where("term is null").agg(*sums)
    gone = chunks.select(F.col(id_col).alias("id")).where("false")
    if removed is not None:
        lost = checkpointed(blocks(removed, id_col, fields, stemmed, stop_words))
        counted = counted.union(lost.where("term is not null").groupBy("term").agg(-F.sum(F.size("ids")))).groupBy("term").agg(F.sum("df").alias("df"))
        totals = totals.union(lost.where("term is null").agg(*sums).select(-F.col("n"), -F.col("length"))).agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
        gone = removed.select(F.col(id_col).alias("id"))
    counted.select("term", F.col("df").cast("long").alias("df")).write.parquet(f"{path}/frequencies")
    totals.write.parquet(f"{path}/totals")
    gone.write.parquet(f"{path}/gone")
    return SegmentIndex(spark, [path], stemmed, stop_words)
