import random

import pytest
from pyspark.sql import functions as F

from lexloom.llm import urls


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    n = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_rules_against_brute_force(spark):
    random.seed(1)
    hosts = ["com", "example.com", "EXAMPLE.com", "a.b.example.net", "net", "org", "xcom", "x.org:80", "", "notexample.com", "é.com"]
    paths = ["", "/", "/en/", "/en/7", "/en/77", "/de/8x", "/de/", "/es/1", "/EN/", "/en"]
    rows = [(i, f"http://{random.choice(hosts)}{random.choice(paths)}{random.choice(['', '?q=http://a/b', '#x?y', '?'])}") for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "no scheme/en/"), (1003, "://"), (1004, "a://b://com/en/"), (7, rows[7][1]), (7, rows[7][1])]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.rule_table(spark)).collect()
    want = sorted((i, *brute(u, urls.RULES)) for i, u in rows)
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == sorted(want, key=lambda x: x)


def test_many_rules_and_both_ways_of_the_filter(spark, monkeypatch):
    rules = [(f"h{i}.example.org", f"/p{i % 7}", "block" if i % 2 else "allow") for i in range(3000)]
    rows = [(i, f"https://www.h{i}.example.org/p{i % 5}/x") for i in range(0, 6000, 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    want = sorted((i, *brute(u, rules)) for i, u in rows)
    for blocks in (urls.MAX_BLOCKS, 1):
        monkeypatch.setattr(urls, "MAX_BLOCKS", blocks)
        got = urls.judge(pages, urls.rule_table(spark, rules)).collect()
        assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == want


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    from pyspark.sql import functions as F

    listed = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("rule"))
    blocks = 2000 * urls.BITS_PER_KEY // 256 + 1
    words = urls.bloom(listed, blocks).select("block", F.array("w0", "w1", "w2", "w3").alias("words"))
    probe = spark.range(20000).select("id", F.concat(F.lit("k"), "id").alias("key")).withColumn("block", urls._block(F.col("key"), blocks))
    hits = {r["id"] for r in probe.join(words, "block").where(urls._passes(F.col("key"), F.col("words"))).collect()}
    assert set(range(2000)) <= hits
    assert len(hits) - 2000 < 0.03 * 18000


def test_empty_tables_nulls_and_clashing_names(spark):
    rows = [(1, "http://a.com/en/", "x", "y", "z", "v"), (None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, best string, `key` string")
    out = urls.judge(pages, urls.rule_table(spark))
    assert set(out.columns) == {"page_id", "url", "best", "key", "host", "path", "rule", "verdict"}
    assert {(r["page_id"], r["rule"], r["verdict"]) for r in out.collect()} == {(1, "com/en/", "block"), (None, None, "allow")}
    assert urls.judge(pages.where("false"), urls.rule_table(spark)).count() == 0
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in urls.judge(pages, none).collect()} == {"allow"}


@pytest.mark.parametrize("word", ["PythonUDF", "ArrowEval", "MapIn", "FlatMap", "NestedLoop", "Cartesian"])
def test_the_plan_is_native(spark, sf, word):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    assert word not in urls.judge(pages, urls.rule_table(spark))._jdf.queryExecution().toString()


def test_columns_with_the_operator_s_own_names_are_kept(spark):
    rows = spark.createDataFrame([("http://a.com/en/1", 1, 2, 3, 4, "x"), (None, 1, 2, 3, 4, "x")], "url string, `__h` int, `__p` int, `__r` int, `__v` int, `key` string")
    got = urls.judge(rows, urls.rule_table(spark)).orderBy(F.desc("url")).collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [("com/en/", "block"), (None, "allow")]
    assert all((r["__h"], r["__p"], r["__r"], r["__v"], r["key"]) == (1, 2, 3, 4, "x") for r in got)


def test_the_query_against_its_sql(spark, sf):
    import duckdb

    from lexloom.llm import queries

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    got = queries.QUERIES["op10_url_filter"](spark, sf)
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.ORACLE_SQL['op10_url_filter']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_names_in_any_case_are_replaced(spark):
    pages = spark.createDataFrame([("http://a.com/en/", "x", "y", "z", "v", 1)], "url string, Host string, PATH string, Rule string, verDict string, other int")
    got = urls.judge(pages, urls.rule_table(spark))
    assert sorted(got.columns) == ["host", "other", "path", "rule", "url", "verdict"] and got.first()["verdict"] == "block"
    long = spark.createDataFrame([("http://a.com/en/" + "p" * 1_000_000,)], "url string")
    assert urls.judge(long, urls.rule_table(spark)).first()["rule"] == "com/en/"
