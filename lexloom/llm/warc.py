"""WARC archives with a two-level capture index.

Records (one gzip member each) fill archive files in the shared folder. The index has a line per capture, sorted by
reversed-host URL key, in compressed blocks; after each run of blocks its index file has a page that names their first
and last keys, offsets and lengths. The sparse directory has one entry per page and a proven bound. A lookup
binary-searches the directory, then the page, then the block, and reads from storage only the pages, blocks and record
ranges that these name: no archive or index file is read whole and none of their bytes are shuffled.

A task names its files after its own attempt, and the rows that Spark commits name the files: what a lost or repeated
attempt wrote is never referred to.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_folder, ready, text_of, written
from .files import create, reader
from .urls import url_host

#: Payloads from this size on are stored once; smaller ones always.
LEAST_REVISIT = 1_000
#: Bytes of an archive file; lines of an index block; blocks of a page at least; entries of the directory (besides one
#: more for each index file).
ARCHIVE_BYTES, BLOCK_LINES, PAGE_BLOCKS, DIRECTORY = 256 << 20, 256, 256, 200_000
#: Rows of the table of repeated payloads up to which it is broadcast (about 60 bytes each).
BROADCAST_DIGESTS = 200_000
#: Adjacent ranges of an archive are read together up to so many bytes.
READ_BYTES = 1 << 20
DATE = "2020-01-01T00:00:00Z"

LINES = pa.schema([("key", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
PAGES = pa.schema([("first", pa.string()), ("last", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("blocks", pa.int64())])
CAPTURES = pa.schema([("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {'long' if f.type == pa.int64() else 'string'}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def url_key(url: Column) -> Column:
    """Reversed host, ``)``, and what follows the host: ``com,example,www)/a?b``. Null counts as empty."""
    url = F.coalesce(url, F.lit(""))
    host = url_host(url)
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3) + F.length(host), F.length(url))).otherwise(url)
    return F.concat(F.concat_ws(",", F.reverse(F.split(host, "\\."))), F.lit(")"), rest)


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, key, html, n, digest, keeper): keeper is the id of the response that a row revisits, else null.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, those with the largest id are responses. Null ids
    are never the largest; if all are null, all are responses. Null payloads count as empty.
    """
    html = text_of(html_col)
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), url_key(F.col(url_col)).alias("key"), html.alias("html"), F.octet_length(html).cast("long").alias("n"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    again = rows.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("c")).where("c > 1").select(F.col("digest").alias("d"), "keeper")
    again = written(again, "warc-repeated")
    again = F.broadcast(again) if again.count() <= BROADCAST_DIGESTS else again
    joined = rows.join(again, (F.col("digest") == F.col("d")) & (F.col("n") >= LEAST_REVISIT), "left")
    keeper = F.when(~F.col("id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return joined.select("id", "url", "key", F.when(keeper.isNull(), F.col("html")).alias("html"), "n", "digest", keeper.alias("keeper"))


def record(page_id, url: str, html: str | None, n: int, digest: str, keeper) -> bytes:
    """A WARC/1.0 response or revisit record."""
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = head + (html.encode() if keeper is None else b"")
    name = hashlib.md5(f"{page_id}|{url}|{digest}".encode()).hexdigest()
    fields = [
        ("WARC-Type", "response" if keeper is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}>"),
        ("WARC-Target-URI", url), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"),
    ] + ([] if page_id is None else [("X-Page-Id", quote(str(page_id)))])
    if keeper is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("X-Refers-To-Page", quote(str(keeper)))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one record; a record that breaks off raises ValueError."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if not lines[0].startswith("WARC/") or len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _attempt() -> str:
    """Names a task's attempt: another one has other files."""
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}"


def _fill(folder: str, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows into archive files of about `most` bytes; gives the lines of a file once it is closed."""
    out, size, lines, number = None, 0, [], 0
    for b in batches:
        for i in range(b.num_rows):
            r = {c: b.column(c)[i].as_py() for c in b.schema.names}
            member = gzip.compress(record(r["id"], r["url"], r["html"], r["n"], r["digest"], r["keeper"]), 1, mtime=0)
            if out is None:
                name = f"{folder}/{_attempt()}-{number:06d}.warc.gz"
                out, size, number = create(name), 0, number + 1
            out.write(member)
            lines.append((r["key"], name, size, len(member)))
            size += len(member)
            if size >= most:
                out.close()
                yield _batch(lines, LINES)
                out, lines = None, []
    if out is not None:
        out.close()
        yield _batch(lines, LINES)


def _index(folder: str, block_lines: int, page_blocks: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lines into an index file of blocks and pages; gives a row for each page."""
    name, out, at, held, blocks, pages = f"{folder}/{_attempt()}.idx", None, 0, [], [], []

    def put(data: bytes) -> tuple[int, int]:
        nonlocal out, at
        out = out or create(name)
        out.write(data)
        at += len(data)
        return at - len(data), len(data)

    def block() -> None:
        where = put(zlib.compress("\n".join("\t".join(map(str, x)) for x in held).encode(), 6))
        blocks.append((held[0][0], held[-1][0], *where))
        held.clear()

    def page() -> None:
        where = put(zlib.compress(json.dumps(blocks).encode(), 6))
        pages.append((blocks[0][0], blocks[-1][1], name, *where, len(blocks)))
        blocks.clear()

    for b in batches:
        for line in zip(*(b.column(c).to_pylist() for c in LINES.names)):
            held.append(line)
            if len(held) >= block_lines:
                block()
                if len(blocks) >= page_blocks:
                    page()
    if held:
        block()
    if blocks:
        page()
    if out is not None:
        out.close()
    yield _batch(pages, PAGES)


@dataclass
class Archives:
    """The captures (key, archive, offset, length), the pages of the index, and the type of the ids."""

    records: DataFrame
    pages: DataFrame
    kind: str


def _quoted(key: Column) -> Column:
    """Keys without the characters that part the fields and lines of the index."""
    return F.regexp_replace(F.regexp_replace(key, "\t", "%09"), "[\r\n]", "%0A")


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, block_lines: int = BLOCK_LINES, page_blocks: int = PAGE_BLOCKS, entries: int = DIRECTORY) -> Archives:
    """Writes a record for each row, then the index over them.

    Null payloads and URLs count as empty, repeated rows have a record each, and rows with a null id have records without
    one. Ids of any simple type come back as they were. Other columns are ignored, whatever their names. An empty table
    gives no files. Of records with one key, the index has them by archive and offset.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    ready(spark)
    rows = decided(pages, id_col, url_col, html_col).withColumns({"key": _quoted(F.col("key")), "id": F.col("id").cast("string"), "keeper": F.col("keeper").cast("string")})
    records = written(rows.mapInArrow(partial(_fill, new_folder(spark, "warc-archives"), archive_bytes), _ddl(LINES)), "warc-captures")
    lines = records.count()
    page_blocks = max(page_blocks, -(-lines // (block_lines * entries)))
    order = ["key", "archive", "offset"]
    sorted_lines = records.repartitionByRange(*order).sortWithinPartitions(*order)
    index = written(sorted_lines.mapInArrow(partial(_index, new_folder(spark, "warc-index"), block_lines, page_blocks), _ddl(PAGES)), "warc-directory")
    return Archives(records, index, kind)


def directory(archives: Archives) -> list[tuple[bytes, bytes, str, int, int]]:
    """(first key, last key, index file, offset, length) of each page, in order of the keys. `write` sees to its bound."""
    rows = archives.pages.select("first", "last", "file", "offset", "length").collect()
    return sorted((r["first"].encode(), r["last"].encode(), r["file"], r["offset"], r["length"]) for r in rows)


def _none(n: int) -> None:
    """Counts nothing."""


def locate(archives: Archives, keys: DataFrame, requests: Callable[[int], None] = _none) -> DataFrame:
    """(key, archive, offset, length) of all captures of the distinct keys(key); null keys and such that aren't there
    give none. `requests` is called with 1 for each page or block that is read.

    A key asks for the pages whose range has it; keys are dealt to tasks in ranges of (page, key), so that a page or a
    block is read once by a task, a key with very many captures is dealt by its pages, and many keys of one page by key.
    """
    spark = keys.sparkSession
    shared = spark.sparkContext.broadcast(directory(archives))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = [e[0] for e in shared.value], [e[1] for e in shared.value]
        for b in batches:
            names, pages = [], []
            for key in b.column("key").to_pylist():
                lo, hi = bisect.bisect_left(lasts, key.encode()), bisect.bisect_right(firsts, key.encode())
                names += [key] * (hi - lo)
                pages += range(lo, hi)
            yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(names, pa.string())], ["page", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, number, blocks, open_block, lines, out = reader(), None, [], None, [], []
        for b in batches:
            for page, key in zip(b.column("page").to_pylist(), b.column("key").to_pylist()):
                key, file = key.encode(), shared.value[page][2]
                if page != number:
                    number, open_block = page, None
                    blocks = json.loads(zlib.decompress(read(*shared.value[page][2:])))
                    firsts, lasts = [x[0].encode() for x in blocks], [x[1].encode() for x in blocks]
                    requests(1)
                for i in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    if i != open_block:
                        open_block = i
                        lines = [x.split("\t") for x in zlib.decompress(read(file, *blocks[i][2:])).decode().split("\n")]
                        names = [x[0].encode() for x in lines]
                        requests(1)
                    for x in lines[bisect.bisect_left(names, key) : bisect.bisect_right(names, key)]:
                        out.append((x[0], x[1], int(x[2]), int(x[3])))
                    if len(out) >= 10_000:
                        yield _batch(out, LINES)
                        out = []
        yield _batch(out, LINES)

    asked = keys.select("key").where("key is not null").distinct().mapInArrow(ask, "page long, key string")
    return asked.repartitionByRange("page", "key").sortWithinPartitions("page", "key").mapInArrow(search, _ddl(LINES))


def fetch(archives: Archives, ranges: DataFrame, requests: Callable[[int], None] = _none) -> DataFrame:
    """Captures read from the (archive, offset, length) ranges: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Only these ranges are read; `requests` is called with the bytes of each read. A range given twice comes twice. A payload
    that differs from its digest raises ValueError.
    """

    def captures(name: str, run: list[tuple[int, int]], read) -> list[tuple]:
        data, out = memoryview(read(name, run[0][0], run[-1][0] + run[-1][1] - run[0][0])), []
        requests(len(data))
        for offset, length in run:
            at = offset - run[0][0]
            fields, http, payload = parse(gzip.decompress(data[at : at + length]))
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
                raise ValueError(f"the payload of record {fields['WARC-Record-ID']} differs from its digest")
            known = [unquote(fields[k]) if k in fields else None for k in ("X-Page-Id", "X-Refers-To-Page")]
            out.append((known[0], int(http["Content-Length"]), digest, fields["WARC-Type"], known[1]))
        return out

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Ranges that follow each other in an archive, together."""
        name, run, size = None, [], 0
        for b in batches:
            for archive, offset, length in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if run and (archive != name or offset != run[-1][0] + run[-1][1] or size + length > READ_BYTES):
                    yield name, run
                    run, size = [], 0
                name, size = archive, size + length
                run.append((offset, length))
        if run:
            yield name, run

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, out = reader(), []
        for name, run in runs(batches):
            out += captures(name, run, read)
            if len(out) >= 10_000:
                yield _batch(out, CAPTURES)
                out = []
        yield _batch(out, CAPTURES)

    dealt = ranges.select("archive", "offset", "length").repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    rows = dealt.mapInArrow(load, _ddl(CAPTURES))
    return rows.withColumns({"page_id": F.col("page_id").cast(archives.kind), "refers_to": F.col("refers_to").cast(archives.kind)})


def lookup(archives: Archives, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The captures of the distinct URLs' keys, through directory, index pages, blocks and archive ranges.

    A null URL asks for the key of an empty one. URLs that were never captured give no rows; an empty table gives none.
    """
    return fetch(archives, locate(archives, urls.select(_quoted(url_key(F.col(url_col))).alias("key"))))
