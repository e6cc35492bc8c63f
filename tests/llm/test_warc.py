import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from lexloom.llm import warc

SCHEMA = "page_id long, url string, html string, `key` string, id long, digest string"


@pytest.fixture(scope="module")
def pages(spark):
    big = "x" * 1000
    rows = [
        (1, "http://a.com/1", big), (2, "http://a.com/2", big), (5, "http://b.com/", big), (5, "http://b.com/", big), (3, "http://a.com/1", "small"),
        (4, "http://a.com/1", "small"), (6, None, None), (7, "", ""), (8, "http://ü.com/ä\tb\nc", "é" * 500), (9, "http://ü.com/", "é" * 500),
        (None, "http://n.com", "y" * 2000), (None, "http://n.com", "y" * 2000), (10, "http://www.A.com/x?q#f", "\r\n\r\nWARC/1.0\r\n" * 100), (11, "http://z.com", "long " * 100_000),
    ]
    return spark.createDataFrame([(*r, "k", 1, "d") for r in rows], SCHEMA)


def brute(rows):
    keep = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 1000:
            ids = keep.setdefault(h, [])
            if i is not None:
                ids.append(i)
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        k = max(keep.get(h) or [i or 0]) if keep.get(h) else i
        same = len(h) < 1000 or k == i
        out.append((i, len(h), hashlib.sha1(h).hexdigest(), "response" if same else "revisit", None if same else k))
    return sorted(out, key=repr)


def test_round_trip_through_the_index(pages):
    got = warc.lookup(warc.write(pages), pages)
    want = brute([tuple(r)[:3] for r in pages.collect()])
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_lookups_of_some_urls(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    archives = warc.write(pages, archive_bytes=20_000, block_lines=4, page_blocks=2, entries=5)
    assert archives.records.select("archive").distinct().count() > 3
    files = archives.pages.select("file").distinct().count()
    assert len(warc.directory(archives)) <= 5 + files < archives.pages.agg(F.sum("blocks")).first()[0]
    some = pages.where("page_id % 5 = 0")
    asked = some.select("url").union(spark.createDataFrame([("http://not.there/",), (None,)], "url string"))
    got = {r["page_id"] for r in warc.lookup(archives, asked).collect()}
    assert got == {r["page_id"] for r in pages.join(some.select("url").distinct(), "url", "left_semi").collect()}
    assert warc.lookup(archives, pages).count() == pages.count()


def test_records():
    data = warc.record(7, "http://a/\r\nX: y", "é", 2, "d", None)
    fields, http, payload = warc.parse(data)
    assert fields["WARC-Type"] == "response" and "\n" not in fields["WARC-Target-URI"] and payload == "é".encode() and http["Content-Length"] == "2"
    fields, http, payload = warc.parse(warc.record(7, "u", None, 5000, "d", 9))
    assert (fields["WARC-Type"], fields["X-Refers-To-Page"], http["Content-Length"], payload) == ("revisit", "9", "5000", b"")
    with pytest.raises(ValueError):
        warc.parse(data[:-1])
    assert gzip.decompress(gzip.compress(data, 1)) == data


def test_keys(spark):
    rows = spark.createDataFrame([("http://www.A.com:80/x?q#f",), ("nothing",), (None,)], "url string").select(warc.url_key(F.col("url"))).collect()
    assert [r[0] for r in rows] == ["com:80,a,www)/x?q#f", ")nothing", ")"]


def test_empty_table(pages):
    none = pages.where("false")
    assert warc.lookup(warc.write(none), pages).count() == 0


def test_a_hot_payload_and_url(spark):
    rows = spark.range(900).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://hot.com/").otherwise(F.concat(F.lit("http://h.com/"), F.col("id").cast("string"))).alias("url"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("p"), 1500)).otherwise(F.repeat(F.col("id").cast("string"), 600)).alias("html"))
    got = warc.lookup(warc.write(rows), rows)
    assert got.count() == 900 and got.where("record_type = 'revisit' and refers_to = 897").count() == 299


def test_a_lookup_reads_only_what_the_index_names(spark):
    """10^5 keys, a directory of a few entries: a key asks for one page, at most two blocks, and its own record."""
    rows = spark.range(100_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 1000, F.lit(".com/"), F.col("id")).alias("url"), F.repeat(F.col("id").cast("string"), 20).alias("html"))
    archives = warc.write(rows, block_lines=64, page_blocks=4, entries=20)
    files = archives.pages.select("file").distinct().count()
    assert len(warc.directory(archives)) <= 20 + files
    asked = rows.where("page_id % 25000 = 7").select("url")
    requests, size = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    found = warc.locate(archives, asked.select(warc.url_key(F.col("url")).alias("key")), requests.add).collect()
    assert len(found) == 4 and requests.value <= 4 * 3
    ranges = spark.createDataFrame(found)
    got = warc.fetch(archives, ranges, size.add).collect()
    assert sorted(r["page_id"] for r in got) == [7, 25007, 50007, 75007]
    assert size.value == sum(r["length"] for r in found) < 3000


def test_ids_of_any_type_come_back(spark):
    rows = spark.createDataFrame([("", "http://a/1", "x"), (None, "http://a/2", "y"), ("é\r\nX: y", "http://a/3", "z" * 1000), ("b", "http://a/4", "z" * 1000)], "page_id string, url string, html string")
    got = warc.lookup(warc.write(rows), rows).select("page_id", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("", None), (None, None), ("é\r\nX: y", None), ("b", "é\r\nX: y")], key=repr)


def test_the_query_against_its_sql(spark, sf):
    import duckdb

    from lexloom.llm import queries

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    name = "op8_warc_capture_index"
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
