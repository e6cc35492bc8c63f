"""A store of documents, chunk ranges and vectors in Parquet, with indexes and retrieval.

A store is a folder. `changes` has a row for each committed change with what it adds: folders of documents and chunks, of the
ids of documents that it replaces, and of manifests, which tell by range and Bloom filter which files may have an origin or a
document. Rows bear the number of the change that wrote them; a replaced document's rows from before are passed over when
reading, until `compact` leaves them out. So a change writes what it brings and nothing else, new folders first and then its
row: readers see all of it or nothing, and any earlier state can be read until `vacuum` removes its folders.

A change claims its number by a file that only one writer can make. A writer that finds its number taken waits for that change
and, if it has no origin in common with it, moves its own ids and number behind it and tries the next number.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .cache import EmbeddingCache
from .embedders import Embedder, Transport, embed_texts, with_embeddings
from .functions.text import embed_input, slice_text
from .log import CHANGE, MANIFEST, State, claimed, described, file_system, files_with, state
from .operators import ann, bm25, changes, knn, retrieve, segments

RESERVED = ("chunk_id", "doc_id", "doc_key", "origin", "text", "start", "end", "context", "embedding")
_META = "format int, name string, title string, embedder string, size int, extra string, root string"
_INDEX = "number long, folders array<string>, stemmed boolean"
_VECTORS = "number long, folder string, method string"
_GONE = "doc_id long, at long"
#: Column with the number of the change that wrote a row.
_AT = "_change"


class StoreConflict(RuntimeError):
    """Another change of the same origins was committed since this one began, or one is not being finished: run it again."""


#: Seconds that a writer waits for a change whose number is claimed.
PATIENCE = 60


def cast_lossless(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of schema from df. A missing column is a ValueError; a value that a cast would change fails the job."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    out = []
    for f in schema:
        have, c = df.schema[f.name].dataType, F.col(f.name)
        if have == f.dataType or have == T.NullType():
            out.append(c.cast(f.dataType).alias(f.name))
            continue
        if isinstance(have, T.StringType) != isinstance(f.dataType, T.StringType):
            raise ValueError(f"column {f.name} is {have.simpleString()}, not {f.dataType.simpleString()}")
        cast = c.try_cast(f.dataType)
        same = c.isNull() | (cast.cast(have) == c)
        out.append(F.when(same, cast).otherwise(F.raise_error(F.lit(f"column {f.name} loses values as {f.dataType.simpleString()}"))).alias(f.name))
    return df.select(*out)


class Store:
    """documents(doc_id, origin, text) and chunks(doc_id, chunk_id, start, end, context, extra columns, embedding)."""

    def __init__(self, spark: SparkSession, path: str, transport: Transport | None = None, cache: EmbeddingCache | None = None):
        self.spark, self.path, self.transport, self.cache = spark, path.rstrip("/"), transport, cache
        try:
            meta = spark.read.schema(_META).parquet(f"{self.path}/metadata").first()
        except AnalysisException:
            meta = None
        if meta is None:
            raise ValueError(f"not a store: {path}")
        self.name, self.title, self.size = meta["name"], meta["title"], meta["size"]
        self.embedder = Embedder.from_json(meta["embedder"]) if meta["embedder"] else None
        self.extra, self.root = T.StructType.fromJson(json.loads(meta["extra"])), f"{self.path}/{meta['root']}"

    @classmethod
    def create(cls, spark: SparkSession, path: str, embedder: Embedder | None = Embedder(), extra_cols: T.StructType | str = T.StructType(), name: str = "store", title: str | None = None, overwrite: bool = False, transport: Transport | None = None, cache: EmbeddingCache | None = None) -> Store:
        """A new store. An existing one is an error unless overwrite. Reserved names among extra_cols are left out.

        Its tables are in a folder of their own, which the metadata name: one that is overwritten is never seen half.
        """
        if not re.fullmatch("[a-zA-Z0-9_-]+", name):
            raise ValueError("a name has letters, digits, _ and - only")
        if isinstance(extra_cols, str):
            extra_cols = T.StructType.fromDDL(extra_cols)
        extra = T.StructType([f for f in extra_cols if f.name not in RESERVED])
        size = len(embed_texts(embedder, ["foo"], transport)[0]) if embedder else None
        mode, root = "overwrite" if overwrite else "errorifexists", f"tables-{uuid.uuid4().hex}"
        spark.createDataFrame([(0, 0, [], [], [], [], 0, 0)], CHANGE).coalesce(1).write.parquet(f"{path}/{root}/changes")
        try:
            row = (2, name, title, embedder.to_json() if embedder else None, size, json.dumps(extra.jsonValue()), root)
            spark.createDataFrame([row], _META).coalesce(1).write.mode(mode).parquet(f"{path}/metadata")
        except AnalysisException as e:
            if "PATH_ALREADY_EXISTS" in str(e):
                raise ValueError(f"File already exists: {path}") from e
            raise
        return cls(spark, path, transport, cache)

    # tables

    @property
    def _documents(self) -> T.StructType:
        return T.StructType.fromDDL("doc_id long, origin string, text string")

    @property
    def _chunks(self) -> T.StructType:
        base = T.StructType.fromDDL("doc_id long, chunk_id long, start int, end int, context string")
        return T.StructType([*base, *self.extra, *([T.StructField("embedding", T.ArrayType(T.FloatType()))] if self.embedder else [])])

    def _now(self, at: int | None = None) -> State:
        found = state(self.spark, self.root, at)
        if found is None:
            raise ValueError(f"the store has no change {at}")
        return found

    def _read(self, now: State, kind: str, files: list[str] | None = None, numbered: bool = False) -> DataFrame:
        """The rows of documents or chunks that no later change replaced; of some files only, if these are given."""
        schema = self._documents if kind == "documents" else self._chunks
        known = T.StructType([*schema, T.StructField(_AT, T.LongType())])
        folders = now[kind] if files is None else files
        rows = self.spark.read.schema(known).parquet(*folders) if folders else self.spark.createDataFrame([], known)
        if now["gone"] and folders:
            gone = self.spark.read.schema(_GONE).parquet(*now["gone"]).groupBy(F.col("doc_id").alias("_gone")).agg(F.max("at").alias("_at"))
            rows = rows.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.col(_AT) < F.col("_at")), "left_anti")
        return rows if numbered else rows.drop(_AT)

    def files(self, kind: str, keys: DataFrame, now: State | None = None) -> list[str] | None:
        """Files that may have one of keys(key): origins for documents, doc_ids for chunks. None stands for all, where there are
        too many keys to look up."""
        now = now or self._now()
        return files_with(self.spark.read.schema(MANIFEST).parquet(*now["manifests"]), kind, keys) if now["manifests"] else []

    def table(self, name: str = "chunks", at: int | None = None) -> DataFrame:
        """documents, embeddings (chunk ranges without text) or chunks (with origin and text cut from the document), as they are
        or as they were after change `at`."""
        if name not in ("documents", "embeddings", "chunks"):
            raise ValueError(f"no table {name!r}")
        now = self._now(at)
        if name != "chunks":
            return self._read(now, "documents" if name == "documents" else "chunks")
        return self._cut(self._read(now, "chunks"), self._read(now, "documents"))

    def changes(self) -> DataFrame:
        """(number, base, last_doc, last_chunk) of all changes that were committed."""
        return self.spark.read.schema(CHANGE).parquet(f"{self.root}/changes").select("number", "base", "last_doc", "last_chunk")

    def feed(self, after: int, to: int | None = None, kind: str = "embeddings") -> DataFrame:
        """What changed in documents or embeddings after change `after` up to change `to` (the last one by default): rows with
        `_kind`, insert or delete. Deleting and then inserting them turns the one state into the other.

        Read are the folders that these changes wrote, and of the state before only files with a replaced document.
        """
        if kind not in ("documents", "embeddings"):
            raise ValueError(f"no feed of {kind!r}")
        own, now, then = "documents" if kind == "documents" else "chunks", self._now(to), self._now(after)
        log = self.spark.read.schema(CHANGE).parquet(f"{self.root}/changes").where(F.col("number").between(after + 1, now["number"]) & (F.col("number") > F.col("base"))).collect()
        gone = [f for r in log for f in r["gone"]]
        new = State(now["number"], now["base"], [f for r in log for f in r["documents"]], [f for r in log for f in r["chunks"]], gone, [], 0, 0)
        added = self._read(new, own).withColumn("_kind", F.lit("insert"))
        if not gone:
            return added
        ids = self.spark.read.schema(_GONE).parquet(*gone).select("doc_id").distinct()
        files = None
        if own == "chunks":
            files = self.files("chunks", ids.select(F.col("doc_id").alias("key")), then)
        lost = self._read(then, own, files).join(ids, "doc_id", "left_semi")
        return lost.withColumn("_kind", F.lit("delete")).unionByName(added)

    def follow(self, apply: Callable[[DataFrame, int], None], checkpoint: str, kind: str = "embeddings", **trigger) -> StreamingQuery:
        """Calls apply(feed, number) for what each micro-batch of new changes brings, from the store's beginning on; `number` is
        that of the last change. The log of changes is the stream, so that a restart goes on where the last one ended; after
        a failure a feed may come again, from the same number on. trigger: as in writeStream.trigger."""

        def batch(changes_of: DataFrame, _: int) -> None:
            found = changes_of.agg(F.min("number"), F.max("number")).first()
            if found[1]:
                apply(self.feed(max(found[0], 1) - 1, found[1], kind), found[1])

        log = self.spark.readStream.schema(CHANGE).parquet(f"{self.root}/changes")
        return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def _cut(self, chunks: DataFrame, documents: DataFrame) -> DataFrame:
        joined = chunks.join(documents.withColumnRenamed("text", "_text"), "doc_id")
        return joined.select("origin", *chunks.columns, slice_text(F.col("_text"), F.col("start"), F.col("end")).alias("text"))

    def _claim(self, number: int) -> bool:
        return claimed(self.spark, self.root, number)

    def _committed(self, number: int) -> State:
        """The state after a change that another writer has claimed; waits for it."""
        until = time.monotonic() + PATIENCE
        while True:
            found = state(self.spark, self.root, number)
            if found is not None:
                return found
            if time.monotonic() > until:
                raise StoreConflict(f"change {number} of {self.path} is another writer's, who does not finish it; release() takes it back")
            time.sleep(0.2)

    def _commit(self, now: State, documents: str | None, chunks: str | None, gone: str | None, last_doc: int, last_chunk: int) -> None:
        """Commits folders that were written for the number after `now`; behind other changes, if these are of other origins."""
        number, since = now["number"] + 1, now
        while not self._claim(number):
            other = self._committed(number)
            new = [f for f in other["documents"] if f not in since["documents"]]
            if other["base"] != number and documents and new:  # a compaction touches no origin
                mine, theirs = (self.spark.read.schema(self._documents).parquet(*x).select("origin").where("origin is not null") for x in ([documents], new))
                if mine.join(theirs, "origin", "left_semi").first():
                    raise StoreConflict(f"change {number} of {self.path} has origins of this one")
            number, moved = number + 1, (other["last_doc"] - since["last_doc"], other["last_chunk"] - since["last_chunk"])

            def behind(folder, kind, number=number, moved=moved, last=since["last_doc"]):
                if folder is None:
                    return None
                rows = self.spark.read.parquet(folder)
                rows = rows.withColumn("at" if kind == "gone" else _AT, F.lit(number).cast("long"))
                if kind != "gone":
                    rows = rows.withColumn("doc_id", F.when(F.col("doc_id") > last, F.col("doc_id") + moved[0]).otherwise(F.col("doc_id")))
                if kind == "chunks":
                    rows = rows.withColumn("chunk_id", F.col("chunk_id") + moved[1])
                return self._write(rows, kind)

            documents, chunks, gone = behind(documents, "documents"), behind(chunks, "chunks"), behind(gone, "gone")
            last_doc, last_chunk, since = last_doc + moved[0], last_chunk + moved[1], other
        self._log(number, since["base"], documents, chunks, gone, last_doc, last_chunk)

    def _log(self, number: int, base: int, documents: str | None, chunks: str | None, gone: str | None, last_doc: int, last_chunk: int) -> None:
        some = [described(self.spark.read.parquet(f), kind, key) for f, kind, key in ((documents, "documents", "origin"), (chunks, "chunks", "doc_id")) if f]
        manifest = None
        if some:
            manifest = self._write(some[0].union(some[-1]).distinct().coalesce(1), "manifests")
        row = (number, base, *([f] if f else [] for f in (documents, chunks, gone, manifest)), last_doc, last_chunk)
        self.spark.createDataFrame([row], CHANGE).coalesce(1).write.mode("append").parquet(f"{self.root}/changes")

    def release(self) -> bool:
        """Takes back the claim of a writer that died before its change was committed; whether there was one."""
        system, path = file_system(self.spark, f"{self.root}/claims/{self._now()['number'] + 1}")
        return bool(system.delete(path, False))

    def _write(self, df: DataFrame, kind: str, number: int | None = None) -> str:
        """Documents are written in ranges of origin, chunks in ranges of document, so that few files have one."""
        folder = f"{self.root}/{kind}/{uuid.uuid4().hex}"
        df = df if number is None else df.withColumn(_AT, F.lit(number).cast("long"))
        by = {"documents": "origin", "chunks": "doc_id"}.get(kind)
        (df.repartitionByRange(by) if by else df).write.parquet(folder)
        return folder

    # changes

    def _checked(self, documents: DataFrame, chunks: DataFrame) -> DataFrame:
        """Chunks with their text cut from the documents; a text of their own must equal it."""
        texts = documents.select("doc_key", F.col("text").alias("_doc"))
        rows = chunks.join(texts, "doc_key")
        cut = slice_text(F.col("_doc"), F.col("start"), F.col("end"))
        if "text" in chunks.columns:
            cut = F.when(F.col("text").eqNullSafe(cut), cut).otherwise(F.raise_error(F.lit("changing a chunk's text is not supported")))
        return rows.withColumn("text", cut).drop("_doc")

    def _prepared(self, chunks: DataFrame) -> DataFrame:
        """Chunks of the store's columns, embedded unless they bring vectors."""
        if self.embedder and "embedding" not in chunks.columns:
            made = self.cache.with_embeddings if self.cache else with_embeddings
            chunks = made(chunks.withColumn("_input", embed_input(F.col("context"), F.col("text"))), self.embedder, "_input", self.transport).drop("_input")
        return cast_lossless(chunks, self._chunks)

    def insert(self, documents: DataFrame, chunks: DataFrame) -> None:
        """Adds documents(doc_key, origin, text) and chunks(doc_key, start, end, context, extra columns[, text][, embedding]).

        An origin that the store or the load has already is an error; null origins may repeat.
        """
        now = self._now()
        number = now["number"] + 1
        known = documents.select("origin").where("origin is not null")
        stored = self._read(now, "documents", self.files("documents", known.select(F.col("origin").alias("key")), now)).select("origin")
        twice = known.groupBy("origin").count().where("count > 1").select("origin").union(known.join(stored, "origin", "left_semi")).first()
        if twice:
            raise ValueError(f"duplicate key: origin {twice[0]!r}")
        ids = changes.numbered(documents.select("doc_key", "origin", "text"), ["doc_key"], "doc_id", now["last_doc"])
        docs = self._write(ids, "staged")
        ids = self.spark.read.parquet(docs)
        rows = self._checked(documents, chunks).join(ids.select("doc_key", "doc_id"), "doc_key")
        rows = changes.numbered(rows, ["doc_id", "start", "end"], "chunk_id", now["last_chunk"])
        written = self._write(self._prepared(rows), "chunks", number)
        folder = self._write(ids.select("doc_id", "origin", "text"), "documents", number)
        top = self.spark.read.parquet(folder).agg(F.max("doc_id")).first()[0], self.spark.read.parquet(written).agg(F.max("chunk_id")).first()[0]
        self._commit(now, folder, written, None, top[0] or now["last_doc"], top[1] or now["last_chunk"])

    def update(self, documents: DataFrame, chunks: DataFrame) -> int:
        """Replaces the documents of which a chunk is new, keeping their ids, and adds those with new origins; gives
        their number. A null origin is an error. Only what changes is embedded and written, and of the store, only the files
        are read that may have the load's origins, by their manifests; without a new chunk nothing is done.
        """
        if documents.where("origin is null").first():
            raise ValueError("update needs an origin for each document")
        now = self._now()
        number = now["number"] + 1
        keys = ["origin", "start", "end", "context", *self.extra.names, "text"]
        rows = self._checked(documents, chunks).join(documents.select("doc_key", "origin"), "doc_key")
        origins = documents.select("origin").distinct()
        stored = self._read(now, "documents", self.files("documents", origins.select(F.col("origin").alias("key")), now))
        same = stored.join(origins, "origin", "left_semi")
        of_these = self._read(now, "chunks", self.files("chunks", same.select(F.col("doc_id").alias("key")), now))
        changed = changes.unknown(rows, self._cut(of_these, same), keys).select("doc_key").distinct()
        changed = self.spark.read.parquet(self._write(changed, "staged"))
        n = changed.count()
        if not n:
            return 0
        some = documents.join(changed, "doc_key", "left_semi")
        old = some.join(stored.select("origin", "doc_id"), "origin").select("doc_key", "origin", "text", "doc_id")
        new = changes.numbered(some.join(stored, "origin", "left_anti").select("doc_key", "origin", "text"), ["doc_key"], "doc_id", now["last_doc"])
        ids = self.spark.read.parquet(self._write(old.unionByName(new), "staged"))
        rows = rows.drop("origin").join(ids.select("doc_key", "doc_id"), "doc_key")
        rows = changes.numbered(rows, ["doc_id", "start", "end"], "chunk_id", now["last_chunk"])
        fresh = self._write(self._prepared(rows), "chunks", number)
        doc_folder = self._write(ids.select("doc_id", "origin", "text"), "documents", number)
        gone = self._write(ids.where(F.col("doc_id") <= now["last_doc"]).select("doc_id", F.lit(number).cast("long").alias("at")), "gone")
        top = self.spark.read.parquet(fresh).agg(F.max("chunk_id")).first()[0] or now["last_chunk"]
        last = max(now["last_doc"], ids.agg(F.max("doc_id")).first()[0])
        self._commit(now, doc_folder, fresh, gone, last, top)
        return n

    def compact(self) -> None:
        """Writes documents and chunks anew without the replaced ones, into one folder each. Old folders stay for readers."""
        now = self._now()
        number = now["number"] + 1
        folders = [self._write(self._read(now, kind, numbered=True), kind) if now[kind] else None for kind in ("documents", "chunks")]
        if not self._claim(number):
            raise StoreConflict(f"change {number} of {self.path} came before the compaction")
        self._log(number, number, *folders, None, now["last_doc"], now["last_chunk"])

    def vacuum(self, since: int | None = None, seconds: float = 86_400) -> int:
        """Deletes folders that no state from change `since` on needs (by default, since the last compaction) and that are older
        than `seconds`, so that changes which are being written keep theirs; gives their number."""
        base = self._now(since)["base"] if since is not None else self._now()["base"]
        rows = self.spark.read.schema(CHANGE).parquet(f"{self.root}/changes").where(F.col("number") >= base).collect()
        kinds = ("documents", "chunks", "gone", "manifests")
        used, n = {f.rsplit("/", 1)[-1] for r in rows for k in kinds for f in r[k]}, 0
        for kind in (*kinds, "staged"):
            system, path = file_system(self.spark, f"{self.root}/{kind}")
            for found in system.listStatus(path) if system.exists(path) else []:
                old = time.time() - found.getModificationTime() / 1000 >= seconds
                if found.getPath().getName() not in used and old:
                    n += bool(system.delete(found.getPath(), True))
        return n

    # retrieval

    def build_index(self, stemmed: bool = True) -> None:
        """The full-text index over context and text of the chunks as they are now, as one segment; later changes are brought
        in by `refresh_index`."""
        now, folder = self._now(), f"{self.root}/index/{uuid.uuid4().hex}"
        chunks = self._cut(self._read(now, "chunks"), self._read(now, "documents"))
        segments.write_segment(chunks, folder, "chunk_id", ["context", "text"], stemmed, stop_words=stemmed)
        self._indexed(now["number"], [folder], stemmed)

    def _indexed(self, number: int, folders: list[str], stemmed: bool) -> None:
        self.spark.createDataFrame([(number, folders, stemmed)], _INDEX).coalesce(1).write.mode("append").parquet(f"{self.root}/indexes")

    def _index(self):
        try:
            return self.spark.read.schema(_INDEX).parquet(f"{self.root}/indexes").orderBy(F.desc("number"), F.size("folders"), "folders").first()
        except AnalysisException:
            return None

    def index_age(self) -> int | None:
        """Changes since the index was built: 0 for a current one, None without one."""
        found = self._index()
        return None if found is None else self._now()["number"] - found["number"]

    def _since(self, number: int, now: State) -> tuple[DataFrame, DataFrame] | None:
        """(chunks that are new, chunks that are no more) since a change, with their texts; None after a compaction. Only the
        folders written since are read for the new ones, only files with a replaced document for the others."""
        if now["base"] > number:
            return None
        then = self._now(number)
        new = {k: [f for f in now[k] if f not in then[k]] for k in ("documents", "chunks", "gone")}
        added = self._cut(self._read(now, "chunks", new["chunks"]), self._read(now, "documents", new["documents"]))
        if not new["gone"]:
            return added, added.where("false")
        gone = self.spark.read.schema(_GONE).parquet(*new["gone"]).select("doc_id").distinct()
        chunks = self._read(then, "chunks", self.files("chunks", gone.select(F.col("doc_id").alias("key")), then)).join(gone, "doc_id", "left_semi")
        ids = chunks.select("doc_id").distinct()
        # documents of a change are in its folder like their chunks; the manifest knows them by origin
        origins = self._read(now, "documents", new["documents"]).join(gone, "doc_id", "left_semi").select(F.col("origin").alias("key"))
        documents = self._read(then, "documents", self.files("documents", origins, then)).join(ids, "doc_id", "left_semi")
        return added, self._cut(chunks, documents)

    def refresh_index(self, stemmed: bool = True) -> bool:
        """Brings the index up to date by a segment of what changed, merging segments of one size; whether it was stale. Built
        anew are an index of the other kind and one from before a compaction."""
        found, now = self._index(), self._now()
        if found is not None and found["number"] == now["number"]:
            return False
        changed = self._since(found["number"], now) if found is not None and found["stemmed"] == stemmed else None
        if changed is None:
            self.build_index(stemmed)
            return True
        folder = lambda: f"{self.root}/index/{uuid.uuid4().hex}"
        index = self._segments(found).add(folder(), *changed, "chunk_id", ["context", "text"])
        some = index.to_merge()
        if some:
            index = index.merge(folder(), some)
        self._indexed(now["number"], index.paths, stemmed)
        return True

    def _segments(self, found) -> segments.SegmentIndex:
        return segments.SegmentIndex(self.spark, list(found["folders"]), found["stemmed"], found["stemmed"])

    def segments(self) -> segments.SegmentIndex:
        found = self._index()
        if found is None:
            raise ValueError("the store has no full-text index: build_index() makes one")
        return self._segments(found)

    def index(self) -> bm25.Index:
        return self.segments().index()

    def build_vectors(self, method: str = "cosine_distance", cells: int | None = None) -> None:
        """The vector index over the chunks as they are now. `probes` of retrieve_vss() reads it; refresh_vectors() adds to it."""
        now, folder = self._now(), f"{self.root}/vectors/{uuid.uuid4().hex}"
        ann.build(self._read(now, "chunks"), folder, method, cells, "chunk_id", "embedding")
        self.spark.createDataFrame([(now["number"], folder, method)], _VECTORS).coalesce(1).write.mode("append").parquet(f"{self.root}/vector_indexes")

    def _vectors(self, method: str):
        try:
            rows = self.spark.read.schema(_VECTORS).parquet(f"{self.root}/vector_indexes")
        except AnalysisException:
            rows = None
        found = rows.where(F.col("method") == method).orderBy(F.desc("number"), "folder").first() if rows is not None else None
        if found is None:
            raise ValueError(f"the store has no vector index for {method}: build_vectors() makes one")
        return found

    def refresh_vectors(self, method: str = "cosine_distance") -> bool:
        """Writes vectors that are new since to their cells; whether the index was stale. After a compaction it is built anew."""
        found, now = self._vectors(method), self._now()
        if found["number"] == now["number"]:
            return False
        if now["base"] > found["number"]:
            self.build_vectors(method)
            return True
        then = self._now(found["number"])
        new = [f for f in now["chunks"] if f not in then["chunks"]]
        if new:
            ann.VectorIndex.read(self.spark, found["folder"]).add(self._read(now, "chunks", new))
        self.spark.createDataFrame([(now["number"], found["folder"], method)], _VECTORS).coalesce(1).write.mode("append").parquet(f"{self.root}/vector_indexes")
        return True

    def retrieve_vss(self, text: str | Sequence[float], top_k: int = 3, method: str = "cosine_distance", where: Column | str | None = None, probes: int | None = None) -> DataFrame:
        """The top_k chunks nearest to a text or vector. Texts are joined to the rows found, not before, unless the
        filter needs them. With `probes`, only so many cells of the vector index are searched; changes since it was
        refreshed are not found, and what they replaced isn't either."""
        vector = embed_texts(self.embedder, [text], self.transport)[0] if isinstance(text, str) else text
        items = self.table("chunks") if where is not None else self.table("embeddings")
        if probes is not None:
            index = ann.VectorIndex.read(self.spark, self._vectors(method)["folder"])
            near = index.rows.where(F.col("cell").isin(index.cells_of(vector, probes))).select("chunk_id", "embedding")
            items = items.drop("embedding").join(near, "chunk_id")
        found = knn.nearest(items, vector, top_k, method, "chunk_id", where=where)
        if where is None:
            docs = self.table("documents").withColumnRenamed("text", "_text")
            cut = slice_text(F.col("_text"), F.col("start"), F.col("end"))
            found = docs.join(F.broadcast(found), "doc_id").select("origin", *found.columns, cut.alias("text"))  # top_k rows
        return found.orderBy(F.asc_nulls_last("metric_value"), "chunk_id")

    def retrieve_bm25(self, text: str, top_k: int = 3, k: float = bm25.K, b: float = bm25.B, conjunctive: bool = False, where: Column | str | None = None) -> DataFrame:
        chunks = self.table("chunks").drop("embedding")
        if where is not None or conjunctive or self.index_age():  # then not all that is in the index counts
            return bm25.retrieve(self.index(), chunks, text, top_k, "chunk_id", k, b, conjunctive, where)
        query = self.spark.createDataFrame([(0, text)], "query_id int, text string")
        found = self.segments().top(query, top_k, k=k, b=b).select(F.col("id").alias("chunk_id"), "metric_value")
        return chunks.join(F.broadcast(found), "chunk_id").withColumn("metric_name", F.lit("bm25")).orderBy(F.desc_nulls_last("metric_value"), "chunk_id")  # top_k rows

    def retrieve(self, texts: str | Sequence[str], top_k: int = 3, merge: bool = True, where: Column | str | None = None, exclude: DataFrame | None = None) -> DataFrame:
        """What vectors and BM25 find for one text or several, each chunk once, with overlapping ranges merged. The filter and
        `exclude` (chunk_ids already seen) hold before the top_k are taken."""
        keys = ["origin", "doc_id", "chunk_id", "start", "end", "context", *self.extra.names]
        texts = [texts] if isinstance(texts, str) else list(texts)
        items = self.table("chunks").drop("embedding")
        items = items if where is None else items.where(where)
        unseen = lambda rows: rows if exclude is None else rows.join(exclude.select("chunk_id"), "chunk_id", "left_anti")
        items = unseen(items)
        asked = self.spark.createDataFrame(list(enumerate(texts)), "_query int, text string")
        scored = bm25.score(self.index(), asked, "_query")
        if where is not None or exclude is not None:
            scored = scored.join(items.select(F.col("chunk_id").alias("id")), "id", "left_semi")
        said = bm25.best(scored, top_k, "_query").withColumnRenamed("id", "chunk_id")
        near = said.where("false")
        if self.embedder and texts:
            vectors = unseen(self.table("embeddings") if where is None else self.table("chunks").where(where))
            of = self.spark.createDataFrame(list(enumerate(embed_texts(self.embedder, texts, self.transport))), "_query int, embedding array<float>")
            near = knn.nearest_many(vectors, of, top_k, id_col="chunk_id", query_col="_query").select("_query", "chunk_id", "metric_value")
        both = retrieve.hybrid(near.withColumn("metric_name", F.lit("cosine_distance")), said.withColumn("metric_name", F.lit("bm25")), ["_query", "chunk_id"], by=["_query"])
        found = items.select(*keys).join(both, "chunk_id").select("_query", *keys, "cosine_distance", "bm25", "rank")
        once = retrieve.first_of_each(found, ["doc_id", "chunk_id"], ["_query", "rank"])
        docs = self.table("documents")
        if merge:
            return retrieve.deoverlap(once.drop("_query", "rank"), docs)
        texts_of = docs.select("doc_id", F.col("text").alias("_text"))
        out = once.join(texts_of, "doc_id").withColumn("text", slice_text(F.col("_text"), F.col("start"), F.col("end")))
        return out.orderBy("_query", "rank").drop("_text", "_query", "rank")

    def inspect(self, text: str = "", method: str = "bm25", top: int = 100) -> DataFrame:
        """Chunks to look at: the first ones for an empty text, otherwise the best by method."""
        if not text:
            return self.table("chunks").drop("embedding").orderBy("chunk_id").limit(top)
        return self.retrieve_bm25(text, top) if method == "bm25" else self.retrieve_vss(text, top).drop("embedding")

    def atlas(self) -> DataFrame:
        """(chunk_id, text, x, y): the chunks' vectors on their two principal components."""
        from pyspark.ml.feature import PCA
        from pyspark.ml.functions import array_to_vector, vector_to_array

        rows = self.table("chunks").withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))
        found = PCA(k=2, inputCol="_v", outputCol="_xy").fit(rows).transform(rows).withColumn("_xy", vector_to_array("_xy"))
        return found.select("chunk_id", "text", F.col("_xy")[0].alias("x"), F.col("_xy")[1].alias("y"))


def connect(spark: SparkSession, path: str, transport: Transport | None = None, **flat) -> Store | FlatStore:
    """The store at a path, whichever format it has; `flat` are FlatStore's further settings. Anything else is a ValueError."""
    there = lambda name: (lambda system, at: system.exists(at))(*file_system(spark, f"{path.rstrip('/')}/{name}"))
    if there("metadata"):
        return Store(spark, path, transport)
    if there("changes"):
        return FlatStore(spark, path, transport=transport, **flat)
    raise ValueError(f"not a store: {path}")


class FlatStore:
    """The first store format: one table chunks(chunk_id, origin, hash, text, extra columns[, embedding]) without documents.

    A change writes its own rows; origins that it replaces are passed over in rows from before, as in Store.
    """

    _CHANGE = "number long, folders array<string>, gone array<string>, last_chunk long"

    def __init__(self, spark: SparkSession, path: str, extra_cols: T.StructType | str = T.StructType(), embedder: Embedder | None = None, transport: Transport | None = None):
        extra = T.StructType.fromDDL(extra_cols) if isinstance(extra_cols, str) else extra_cols
        if "chunk_id" in extra.names:
            raise ValueError("chunk_id is the store's own column")
        self.spark, self.path, self.embedder, self.transport = spark, path.rstrip("/"), embedder, transport
        base = T.StructType.fromDDL("origin string, hash string, text string")
        self.schema = T.StructType([*base, *[f for f in extra if f.name not in base.names]])

    def _now(self):
        try:
            return self.spark.read.schema(self._CHANGE).parquet(f"{self.path}/changes").orderBy(F.desc("number")).first()
        except AnalysisException:
            return None

    def _rows(self) -> DataFrame:
        """All columns, chunk_id among them."""
        now = self._now()
        vector = [T.StructField("embedding", T.ArrayType(T.FloatType()))] if self.embedder else []
        schema = T.StructType([T.StructField("chunk_id", T.LongType()), *self.schema, *vector])
        if now is None:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(T.StructType([*schema, T.StructField(_AT, T.LongType())])).parquet(*now["folders"])
        if now["gone"]:
            gone = self.spark.read.schema("origin string, at long").parquet(*now["gone"]).groupBy(F.col("origin").alias("_gone")).agg(F.max("at").alias("_at"))
            rows = rows.join(gone, (F.col("origin") == F.col("_gone")) & (F.col(_AT) < F.col("_at")), "left_anti")
        return rows.drop(_AT)

    def table(self) -> DataFrame:
        return self._rows().drop("chunk_id")

    def _add(self, rows: DataFrame, replace: bool) -> None:
        now = self._now()
        number, last = (now["number"] + 1, now["last_chunk"]) if now else (1, 0)
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(staged)
        rows, folder, gone = self.spark.read.schema(rows.schema).parquet(staged), f"{self.path}/chunks/{uuid.uuid4().hex}", []
        changes.numbered(rows, ["origin", "hash", "text"], "chunk_id", last).withColumn(_AT, F.lit(number).cast("long")).write.parquet(folder)
        if replace:
            gone = [f"{self.path}/gone/{uuid.uuid4().hex}"]
            rows.where("origin is not null").select("origin", F.lit(number).cast("long").alias("at")).distinct().write.parquet(gone[0])
        top = self.spark.read.parquet(folder).agg(F.max("chunk_id")).first()[0] or last
        if not claimed(self.spark, self.path, number):
            raise StoreConflict(f"change {number} of {self.path} is another writer's")
        row = (number, [*(now["folders"] if now else []), folder], [*(now["gone"] if now else []), *gone], top)
        self.spark.createDataFrame([row], self._CHANGE).coalesce(1).write.mode("append").parquet(f"{self.path}/changes")

    def _prepared(self, chunks: DataFrame) -> DataFrame:
        for name, c in (("origin", F.lit(None).cast("string")), ("hash", F.md5("text"))):
            chunks = chunks if name in chunks.columns else chunks.withColumn(name, c)
        if chunks.where("text is null").first():
            raise ValueError("a chunk without text")
        out = cast_lossless(chunks, self.schema)
        return with_embeddings(out, self.embedder, "text", self.transport) if self.embedder else out

    def insert(self, chunks: DataFrame) -> None:
        """Adds chunks as they are, repeats included; a missing origin is null and a missing hash that of the text."""
        self._add(self._prepared(chunks), replace=False)

    def update(self, chunks: DataFrame) -> None:
        """Replaces the origins of which an (origin, hash) is new, with the chunks that are new; equal hashes are
        taken for equal texts."""
        if not {"origin", "hash"} <= set(chunks.columns):
            raise ValueError("update needs the columns origin and hash")
        new = changes.unknown(chunks, self.table(), ["origin", "hash"])
        if new.first() is None:
            return
        self._add(self._prepared(new), replace=True)

    def build_index(self, stemmed: bool = True) -> None:
        """The full-text index over the texts as they are now, in a new folder."""
        now, folder = self._now(), f"{self.path}/index/{uuid.uuid4().hex}"
        segments.write_segment(self._rows(), folder, "chunk_id", ["text"], stemmed, stop_words=stemmed)
        self.spark.createDataFrame([(now["number"] if now else 0, [folder], stemmed)], _INDEX).coalesce(1).write.mode("append").parquet(f"{self.path}/indexes")

    def retrieve_vss(self, text: str | Sequence[float], top_k: int = 3, method: str = "cosine_distance", where: Column | str | None = None) -> DataFrame:
        """The top_k chunks nearest to a text or vector, nearest first, with metric_name and metric_value."""
        vector = embed_texts(self.embedder, [text], self.transport)[0] if isinstance(text, str) else text
        return knn.nearest(self._rows(), vector, top_k, method, "chunk_id", where=where)

    def retrieve_bm25(self, text: str, top_k: int = 3, k: float = bm25.K, b: float = bm25.B, conjunctive: bool = False, where: Column | str | None = None) -> DataFrame:
        """The top_k chunks by BM25, best first, by the index built last."""
        try:
            found = self.spark.read.schema(_INDEX).parquet(f"{self.path}/indexes").orderBy(F.desc("number"), "folders").first()
        except AnalysisException as e:
            raise ValueError("the store has no full-text index: build_index() makes one") from e
        index = segments.SegmentIndex(self.spark, list(found["folders"]), found["stemmed"], found["stemmed"]).index()
        return bm25.retrieve(index, self._rows().drop("embedding"), text, top_k, "chunk_id", k, b, conjunctive, where)

    def retrieve(self, text: str, top_k: int = 3, where: Column | str | None = None) -> DataFrame:
        """What vectors and BM25 find for a text, a chunk once, with both scores and `rank`: vector results first."""
        keys = ["chunk_id", *self.schema.names]
        said = self.retrieve_bm25(text, top_k, where=where).select(*keys, "metric_name", "metric_value")
        near = self.retrieve_vss(text, top_k, where=where).select(*keys, "metric_name", "metric_value") if self.embedder else said.where("false")
        return retrieve.hybrid(near, said, ["chunk_id"]).orderBy("rank")
