import math
import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.functions.vector import cosine_distance, literal, metric
from lexloom.operators import bm25, changes, chunk, crawl, knn, nearby, retrieve

PLAN = lambda df: df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, [math.cos(i), math.sin(i), 0.5], i % 3) for i in range(50)] + [(50, None, 0), (51, [0.0, 0.0, 0.0], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_distances(spark):
    row = spark.range(1).select(*[metric(m)(literal([1, 0]), literal([0, 2])).alias(m) for m in ("cosine_distance", "euclidean_distance", "negative_inner_product")], cosine_distance(literal([0, 0]), literal([1, 1])).alias("zero")).first()
    assert row[0] == 1 and row[1] == pytest.approx(5**0.5) and row[2] == 0 and math.isnan(row[3])
    with pytest.raises(ValueError, match="Unknown method"):
        metric("other")


@pytest.mark.parametrize("method", ["cosine_distance", "euclidean_distance", "negative_inner_product"])
def test_many_queries_like_single_ones(items, method):
    asked = items.where("vec_id in (3, 8, 21)").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in knn.nearest_many(items.where("vec_id < 50"), asked, 6, method).collect()}
    for q in asked.collect():
        one = [r["vec_id"] for r in knn.nearest(items.where("vec_id < 50"), q["embedding"], 6, method).collect()]
        assert [got[q["query_id"], i] for i in range(1, 7)] == one
    assert knn.nearest_many(items, asked.where("false"), 3).count() == 0


def test_plans(items):
    found = knn.nearest(items, [1, 0, 0], 5)
    assert "TakeOrderedAndProject" in PLAN(found) and "Python" not in PLAN(found)
    assert knn.nearest(items, [1, 0, 0], 500).count() == 52
    assert {r["label"] for r in knn.nearest(items, [1, 0, 0], 5, where="label = 2").collect()} == {2}


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "foo bar"), (2, "bar bar baz"), (3, "qux"), (4, None)], "id long, text string")
    index = bm25.build(docs, "id", ["text"])
    asked = spark.createDataFrame([(0, "bar BAR foo")], "query_id int, text string")
    got = {r["id"]: r["metric_value"] for r in bm25.score(index, asked).collect()}

    def score(tfs, n):
        return sum(math.log10((4 - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 1.5)) for tf, df in tfs)

    assert got == pytest.approx({1: score([(1, 2), (1, 1)], 2), 2: score([(2, 2)], 3)})
    assert [r["id"] for r in bm25.score(index, asked, conjunctive=True).collect()] == [1]
    top = bm25.retrieve(index, docs, "bar", 5, "id", where="id > 1").collect()
    assert [r["id"] for r in top] == [2] and top[0]["metric_name"] == "bm25"
    stemmed = bm25.build(spark.createDataFrame([(1, "the dogs were running")], "id long, text string"), "id", ["text"], True, True)
    assert {r["term"] for r in stemmed.postings.collect()} == {"dog", "run"}


def found(spark, ranges):
    rows = [("o", 1, i, a, z, f"c{i}", float(i)) for i, (a, z) in enumerate(ranges)]
    return spark.createDataFrame(rows, "origin string, doc_id int, chunk_id int, start int, end int, context string, bm25 double"), spark.createDataFrame([(1, "".join(chr(97 + i % 26) for i in range(40)))], "doc_id int, text string")


@pytest.mark.parametrize("ranges, merge, want", [([(1, 10), (10, 20), (21, 30)], "last", [(1, 20), (21, 30)]), ([(1, 30), (5, 10)], "last", [(1, 10)]), ([(1, 30), (5, 10)], "max", [(1, 30)]), ([(5, 9), (1, 5), (20, 99)], "last", [(1, 9), (20, 99)])])
def test_deoverlap(spark, ranges, merge, want):
    rows, docs = found(spark, ranges)
    out = retrieve.deoverlap(rows.union(rows.limit(1)), docs, merge).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in out] == want
    assert sum(len(r["chunk_id"]) for r in out) == len(ranges) and all(len(r["text"]) == min(r["end"], 40) - r["start"] + 1 for r in out)


def test_deoverlap_keeps_nulls(spark):
    rows, docs = found(spark, [(1, 10), (5, 12)])
    rows = rows.withColumn("bm25", F.when(F.col("chunk_id") == 1, F.col("bm25")))
    assert retrieve.deoverlap(rows, docs).first()["bm25"] == [None, 1.0]


@pytest.mark.parametrize("tree, nodes, want", [
    ([("h1", "L1"), ("", "u"), ("h2", "L2"), ("n", "a"), ("n", "b")], ["h1", "h2"], [("L1", None, "", "u"), ("L1", "L2", "n", "a"), ("L1", "L2", "n", "b")]),
    ([("h1", "L1"), ("", "abc"), ("h2", "L2"), ("n", "def"), ("n", "ghi"), ("h2", "L2b")], ["h1", "h2"], [("L1", None, "", "abc"), ("L1", "L2", "n", "def"), ("L1", "L2", "n", "ghi"), ("L1", "L2b", None, None)]),
    ([("h1", "L1"), ("", "abc"), ("h2", "L2"), ("n", "def"), ("h3", "L3"), ("h2", "L2b"), ("", "lmn")], ["h1", "h2", "h3"], [("L1", None, None, "", "abc"), ("L1", "L2", None, "n", "def"), ("L1", "L2", "L3", None, None), ("L1", "L2b", None, "", "lmn")]),
    ([("h1", "X")], ["h1", "h2", "h3"], [("X", None, None, None, None)]),
])
def test_frame(spark, tree, nodes, want):
    rows = spark.createDataFrame([(1, i, t, x) for i, (t, x) in enumerate(tree)], "doc int, pos int, tag string, text string")
    assert [tuple(r)[2:] for r in chunk.frame(rows, ["doc"], nodes).orderBy("pos").collect()] == want


def test_segments_and_packs(spark):
    docs = spark.createDataFrame([(1, "One. Two three! Four"), (2, None)], "id int, text string")
    rows = [(r["id"], r["pos"], r["text"]) for r in chunk.segment_text(docs).orderBy("id", "pos").collect()]
    assert rows == [(1, 0, "One. "), (1, 1, "Two three! "), (1, 2, "Four")]
    lists = spark.createDataFrame([(1, ["ab", "cd", None, "", "efghij", "k"])], "id int, parts array<string>")
    assert [r["text"] for r in chunk.pack_segments(lists, "parts", 5, " ").orderBy("pos").collect()] == ["ab cd", "efghij", "k"]


def test_order_joins(spark):
    left = spark.createDataFrame([(1, 5, "x"), (1, 10, "y"), (2, 3, "z")], "k int, t int, name string")
    right = spark.createDataFrame([(1, 5, "a"), (1, 4, "b"), (1, 4, "c"), (2, 3, "d")], "k int, t int, v string")
    got = {r["name"]: r["last_v"] for r in nearby.last_before(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {"x": "c", "y": "a", "z": None}
    more = spark.range(300).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 90).alias("t"), F.col("id").alias("v"))
    marks = more.where("v % 4 = 0 or k = 2 and v < 9")
    plain = nearby.last_before(more, marks, ["k"], "t", ["v"])
    split = nearby.last_before(more, marks, ["k"], "t", ["v"], bucket=F.floor(F.col("t") / 10))
    assert plain.exceptAll(split).count() == 0 and plain.count() == split.count() == 300
    points = spark.createDataFrame([(10,), (20,), (None,), (-7,)], "point long")
    near = nearby.nearest_within(points, spark.createDataFrame([(8,), (12,), (25,), (-9,), (-5,)], "candidate long"), 4)
    assert {r["point"]: r["nearest"] for r in near.collect()} == {10: 12, 20: None, None: None, -7: -5}
    assert "CartesianProduct" not in PLAN(near) and "NestedLoop" not in PLAN(near)


def test_changes(spark):
    old = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "o string, c string, n int")
    new = spark.createDataFrame([("a", None, 1), ("b", "y", 2), (None, "z", 3)], "o string, c string, n int")
    assert {tuple(r) for r in changes.unknown(new, old, ["o", "c", "n"]).collect()} == {("b", "y", 2), (None, "z", 3)}
    assert changes.replaced(old, new.where("o = 'b'"), "o").count() == 2
    ids = changes.numbered(spark.range(1000).withColumn("g", F.col("id") % 7).repartition(5), ["g", "id"], "n", 10).orderBy("g", "id").collect()
    assert [r["n"] for r in ids] == list(range(11, 1011))
    plan = changes.interleaved(spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "origin string"), spark.createDataFrame([("c",), (None,)], "origin string"))
    assert {(r["origin"], r["is_new_origin"]) for r in plan.collect()} == {("a", True), ("b", True), ("c", False)}


def test_crawl(spark):
    pages = spark.createDataFrame([("http://s/a/index.html", '<a href="b.html#x">b</a><a href="/c/">c</a><a href="#">n</a>'), ("http://s/a/b.html", '<a href="http://s/a/d.html">d</a><a href="//t/x">t</a><a href="b.html">b</a>'), ("http://s/a/d.html", '<a href="e.html">e</a>')], "url string, html string")
    start = pages.where("url like '%index.html'").select("url")
    fetch = lambda u: pages.join(u, "url", "left_semi")
    urls = lambda **k: {r[0] for r in crawl.find_links(start, fetch, **k)[0].collect()}
    assert urls() == {"http://s/a/b.html", "http://s/c"}
    assert urls(depth=2) == {"http://s/a/b.html", "http://s/a/d.html", "http://s/a/e.html"}  # pages that are not found are no links
    assert urls(depth=2, children_only=True) == {"http://s/a/b.html", "http://s/a/d.html", "http://s/a/e.html"}
    problems = crawl.find_links(start, fetch, depth=1)[1].collect()
    assert {r["link"] for r in problems} == {"http://s/c"}


def test_text_functions(spark):
    one = spark.createDataFrame([("a  \r\nb \t\n c", "1m0.612s")], "t string, d string")
    row = one.select(tx.normalize_markdown(F.col("t")), tx.duration_seconds(F.col("d")), tx.duration_seconds(F.lit("250ms")), tx.duration_seconds(F.lit("x")), tx.slice_text(F.lit("abc"), F.lit(2), F.lit(99)), tx.slice_text(F.lit("abc"), F.lit(3), F.lit(2)), tx.linkify(F.lit("see http://a.b/c now, http://x…")), tx.url_stem(F.lit("http://a/b/c.html?x")), tx.terms(F.lit("The Café's 2 dogs"), True, True)).first()
    assert tuple(row) == ("a\nb\n c", 60.612, 0.25, None, "bc", "", 'see <a href="http://a.b/c">http://a.b/c</a> now, http://x…', "http://a/b", ["cafe", "s", "dogs"])


def test_urls_resolve_as_the_standard_library_has_it(spark):
    from urllib.parse import urljoin

    pages = ["http://a.com", "http://a.com/", "http://a.com/x/y.html", "http://a.com/x/y/?p=/q/r", "https://b.org:8080/d/e/f/g#h", "http://a.com/x/../y/z"]
    found = ["../z", "./a/../b", "?q=1", "c", "c/", "/d/./e/../f", "//c.net/x", "http://d.com/a/../b", "mailto:x@y.z", "../../../../up", "..", ".", "a/..", "g;x=1/./y", "a?b=/../c", "é/ü", "a/b/../../c?d"]
    rows = spark.createDataFrame([(p, x) for p in pages for x in found], "page string, link string")
    for r in rows.select("page", "link", tx.absolute_url(F.col("link"), F.col("page")).alias("got")).collect():
        want = r["link"] if r["link"].startswith("http") else urljoin(r["page"], r["link"])
        assert r["got"] == want, r


def test_links_of_odd_pages(spark):
    html = """<a href=plain.html>x</a> <A class='c' HREF = '/q?a=1&amp;b=2#f'>y</A> <!-- <a href="no.html">n</a> -->
        <script>var s = '<a href="no2.html">';</script><a data-href="no3" href="two/">z</a><a title="a > b" href="three">t</a><a href="">e</a><a>n</a> <link href="no4">"""
    sitemap = "<?xml version='1.0'?><urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc> http://a/1?x=1&amp;y=2 </loc></url><url><loc>http://a/2/</loc></url></urlset>"
    rows = spark.createDataFrame([(1, html), (2, sitemap), (3, None), (4, "<sitemapindex><sitemap><loc>http://a/s.xml</loc></sitemap></sitemapindex>")], "id int, html string")
    got = {r["id"]: r["l"] for r in rows.select("id", tx.links(F.col("html")).alias("l")).collect()}
    assert got[1] == ["/q?a=1&b=2", "plain.html", "three", "two"]
    assert got[2] == ["http://a/1?x=1&y=2", "http://a/2"]
    assert not got[3] and not got[4]


def test_crawls_with_prefix_redirects_and_validation(spark):
    site = {"http://a/": '<a href="x/1.html">1</a><a href="y">2</a><a href="old">o</a>', "http://a/x/1.html": '<a href="../x/2.html">2</a>', "http://a/new/": '<a href="in">i</a>'}
    pages = spark.createDataFrame([(u, h, u) for u, h in site.items()] + [("http://a/old", site["http://a/new/"], "http://a/new/")], "url string, html string, resolved string")
    fetch = lambda urls: pages.join(urls, "url", "left_semi")
    start = spark.createDataFrame([("http://a/",)], "url string")
    links = lambda **k: sorted(r[0] for r in crawl.find_links(start, fetch, **k)[0].collect())
    assert links(depth=1, children_only="http://a/x/") == ["http://a/x/1.html", "http://a/x/2.html"]
    assert links(depth=1) == ["http://a/new/", "http://a/new/in", "http://a/x/1.html", "http://a/x/2.html"]
    good, problems = crawl.find_links(start, fetch, validate=lambda urls: urls.where("url like '%html'"))
    assert [r[0] for r in good.collect()] == ["http://a/x/1.html"]
    assert {r["link"] for r in problems.collect() if r["problem"] == "does not answer"} == {"http://a/y", "http://a/old"}


def test_links_of_huge_tags(spark):
    """No pattern recurses: a megabyte of attributes, names, quotes or comments gives its link."""
    n = 1_000_000
    tags = [
        f"<a {'x' * n} href='/one'>", f"<a title={'y' * n} href=/two>", f"<a title='{'z ' * n}' href=\"/three\">", f"<a {'k=v ' * (n // 4)}href=/four>",
        f"<a {'\"q\" ' * (n // 4)}href=/five>", f"<!--{'c' * n}--><a href=/six>", f"<a href='/seven?{'p' * n}'>", f"<a {'= ' * n} href=/eight",
    ]
    rows = spark.createDataFrame(list(enumerate(tags)), "id int, html string")
    got = {r["id"]: [x[:7] for x in r["l"]] for r in rows.select("id", tx.links(F.col("html")).alias("l")).collect()}
    assert got == {0: ["/one"], 1: ["/two"], 2: ["/three"], 3: ["/four"], 4: ["/five"], 5: ["/six"], 6: ["/seven?"], 7: ["/eight"]}


def test_attributes_that_only_look_like_links(spark):
    tags = {"<a data-href=/no>": [], "<a hreflang=en href = '/yes'>": ["/yes"], "<a title=\"href='/no'\" class=x\nHREF=/yes#f>": ["/yes"], "<abbr href=/no>": [], "<a href=/a href=/b>": ["/a"], "<a/href=/c>": ["/c"], "<a id='1'href=/d&amp;e>": ["/d&e"]}
    rows = spark.createDataFrame(list(tags), "string").withColumn("l", tx.links(F.col("value")))
    assert {r["value"]: r["l"] for r in rows.collect()} == tags


def test_dead_links_and_addresses_beyond_the_prefix_are_dropped(spark):
    pages = spark.createDataFrame([("http://a/s/", "<a href='dead'><a href='moved'><a href='ok'>", None), ("http://a/s/moved", "", "http://b/out"), ("http://a/s/ok", "<a href='deep'>", None)], "url string, html string, resolved string")
    links, problems = crawl.find_links(spark.createDataFrame([("http://a/s/",)], "url string"), lambda urls: pages.join(urls, "url", "left_semi"), depth=1, children_only="http://a/s/")
    assert sorted(r[0] for r in links.collect()) == ["http://a/s/deep", "http://a/s/ok"]
    assert [tuple(r) for r in problems.collect()] == [("http://a/s/dead", "not found")]


def test_blocks_of_queries_and_items(spark, monkeypatch):
    """Copies, zero vectors and text ids in blocks of any size, as one query after the other finds them."""
    rows = [(f"i{i:03}", [float(i % 7), float(i % 5), 1.0] if i % 11 else [0.0, 0.0, 0.0]) for i in range(200)] + [("none", None)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>").repartition(3)
    asked = df.where("vec_id < 'i012'").withColumnRenamed("vec_id", "query_id")
    for method in ("cosine_distance", "euclidean_distance", "negative_inner_product"):
        want = {}
        for q in asked.collect():
            near = df.where("embedding is not null").select("vec_id", F.round(metric(method)(F.col("embedding"), F.array(*map(F.lit, q["embedding"]))), 9).alias("m"))
            want[q["query_id"]] = [r["vec_id"] for r in near.orderBy(F.asc_nulls_last("m"), "vec_id").limit(40).collect()]
        for sizes in ((7, 3), (2_048, 1_024)):
            monkeypatch.setattr(knn, "ITEM_BLOCK", sizes[0])
            monkeypatch.setattr(knn, "QUERY_BLOCK", sizes[1])
            found = knn.nearest_many(df, asked, 40, method, digits=9).orderBy("query_id", "rank").collect()
            got = {q: [r["vec_id"] for r in found if r["query_id"] == q] for q in want}
            assert got == want, (method, sizes)


def test_many_queries_meet_items_in_bounded_blocks(spark):
    items = spark.range(5000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(i * (F.col("id") + 1)).cast("float")).alias("embedding"))
    asked = items.where("vec_id < 2500").withColumnRenamed("vec_id", "query_id")
    plan = PLAN(knn.nearest_many(items, asked, 3))
    assert plan.count("CartesianProduct") >= 1 and "Union" not in plan and "Broadcast" not in plan
    made = knn.blocks(items.toDF("id", "v"), knn.ITEM_BLOCK, "array<float>").select(F.size("ids").alias("n"), F.size("v").alias("w")).collect()
    assert sum(r["n"] for r in made) == 5000 and max(r["n"] for r in made) <= knn.ITEM_BLOCK and all(r["w"] == 8 * r["n"] for r in made)
    wide = spark.range(10).select("id", F.array_repeat(F.lit(1.0), knn.NUMBERS // 2).alias("v"))
    assert {r["n"] for r in knn.blocks(wide, knn.ITEM_BLOCK, "array<double>").select(F.size("ids").alias("n")).collect()} <= {1, 2}


def test_scores_that_differ_in_their_last_digits_are_ties(spark):
    scored = spark.createDataFrame([(0, i, 1.5 + i * 1e-14) for i in range(100)] + [(0, 200, 2.0)], "query_id int, id long, metric_value double")
    assert sorted(r["id"] for r in bm25.best(scored, 3, digits=9).collect()) == [0, 1, 200]
    assert sorted(r["id"] for r in bm25.best(scored, 3).collect()) == [98, 99, 200]


def test_texts_are_counted_once_where_they_are_read(spark, monkeypatch):
    once = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            once.add(b.num_rows)
            yield b

    texts = [None, "", "the of", "running dogs run", "Dog runs café", "a " * 3000 + "runner"]
    df = spark.createDataFrame([(f"c{i:02}", texts[i % 6]) for i in range(60)], "id string, text string").repartition(3).localCheckpoint()
    asked = spark.createDataFrame([(0, "dogs run"), (1, "cafe nothing"), (2, None)], "query_id int, text string")
    index = bm25.build(df.mapInArrow(seen, "id string, text string"), "id", ["text"], True, True)
    assert "Exchange" not in PLAN(index.postings)
    got = {(r["query_id"], r["id"]): r["metric_value"] for r in bm25.score(index, asked).collect()}
    assert once.value == 60  # postings and averages come from one pass
    assert index.totals.first()["n"] == 60 and index.totals.first()["average"] == pytest.approx((3 + 3 + 1) / 6)

    def score(tfs, n):
        return sum(math.log10((60 - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / (7 / 6))) for tf, df in tfs)

    want = {(0, f"c{i:02}"): score([(2, 20), (1, 20)], 3) if i % 6 == 3 else score([(1, 20), (1, 20)], 3) for i in range(60) if i % 6 in (3, 4)}
    want |= {(1, f"c{i:02}"): score([(1, 10)], 3) for i in range(4, 60, 6)}
    assert got == pytest.approx(want)
    monkeypatch.setattr(bm25, "SENT", 0)
    assert {(r["query_id"], r["id"]): r["metric_value"] for r in bm25.score(index, asked).collect()} == pytest.approx(want)
    none = bm25.build(df.where("false"), "id", ["text"])
    assert none.totals.first()["n"] == 0 and bm25.score(none, asked).count() == 0


def test_the_top_of_many_queries_is_that_of_all_scores(spark, tmp_path, monkeypatch):
    """From an index of texts and from a written one, with queries sent or not, in any blocks; equal scores go to the smaller id."""
    rng, words = random.Random(7), [f"w{chr(97 + i)}" for i in range(26)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(26)], k=rng.randint(0, 9))) for _ in range(150)]
    docs = spark.createDataFrame([(f"c{i}", texts[i % 150]) for i in range(600)] + [(None, "wa wb")], "id string, text string").repartition(3).localCheckpoint()
    items = [(i, " ".join(rng.choices(words, k=5))) for i in range(30)] + [(None, "wa wc"), (None, "wc wd"), (31, None), (32, "nothing")]
    asked = spark.createDataFrame(items, "query_id int, text string")
    read = lambda df: {(r["query_id"], r["id"]): round(r["metric_value"], 9) for r in df.collect()}
    index = bm25.build(docs, "id", ["text"])
    want = read(bm25.best(bm25.score(index, asked).where("id is not null"), 7, digits=9))
    assert len(want) == 31 * 7 and sum(q is None for q, _ in want) == 7
    assert read(bm25.top(index, asked, 7, digits=9)) == want
    for name, size in (("DEALT", 100), ("ASKED", 20), ("SIDE", 50), ("SENT", 0)):
        monkeypatch.setattr(bm25, name, size)
    assert read(bm25.top(index, asked, 7, digits=9)) == want
    assert read(bm25.top(index.write(str(tmp_path / "i")), asked, 7, digits=9)) == want
    assert bm25.top(bm25.build(docs.where("false"), "id", ["text"]), asked, 7).count() == 0
