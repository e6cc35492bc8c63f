import pytest
from pyspark.sql import functions as F

from lexloom.kernels.events import plain_text, tag_texts
from lexloom.kernels.html import Node, parse, to_markdown
from lexloom.operators import chunk
from lexloom.plans import queries
from lexloom.sources.readers import pages_as_markdown, transcript_text


def test_pieces():
    html = "<title>T</title><body>before<h1>One <b>bold</b></h1>between<p>first<br>line</p><p></p><div>tail <script>no</script>x</div></body>"
    assert tag_texts(html, ("h1", "p")) == [("", "before"), ("h1", "One bold"), ("", "between"), ("p", "first\nline"), ("p", ""), ("", "tail x")]
    # an element inside another ends the outer one's piece
    assert tag_texts("<li>a<p>b</p>c</li>d", ("li", "p")) == [("li", "a"), ("p", "b"), ("", "c"), ("", "d")]
    assert tag_texts("<p>one<p>two", ("p",)) == [("p", "one"), ("p", "two")]
    assert tag_texts(None) == [] and tag_texts("") == [] and tag_texts("<h1></h1>", ("h1",)) == [("h1", "")]
    assert tag_texts("a<hr>b", ("hr",)) == [("", "a"), ("hr", ""), ("", "b")]
    assert plain_text("<p>a  b\n c</p><p>d</p><table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table><pre>x\n  y</pre>") == "a b c\n\nd\n\n1\t2\n3\nx\n  y"
    assert plain_text("a &amp; b</p></div> &lt;c") == "a & b <c"


@pytest.mark.parametrize("depth", [1_500, 10_000])
def test_depth_does_not_matter(depth):
    deep = "<div>" * depth + "<h1>deep</h1><p>text</p>" + "</div>" * depth + "<p>after</p>"
    assert tag_texts(deep, ("h1", "p")) == [("h1", "deep"), ("p", "text"), ("p", "after")]
    assert to_markdown(deep) == "# deep\n\ntext\n\nafter"
    assert to_markdown("<b>" * depth + "x" + "</b>" * depth).strip("*") == "x"
    assert tag_texts("<ul><li>" * depth + "x", ("li",))[-1] == ("li", "x")


def _said(node: Node) -> str:
    return " ".join("".join(c if isinstance(c, str) else "" if c.tag in ("script", "style") else " " + _said(c) + " " for c in node.children).split())


def test_segments_against_a_tree(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    got = {}
    for r in chunk.html_segments(pages, ("h1", "h2", "h3")).where("tag <> ''").orderBy("page_id", "pos").collect():
        got.setdefault(r["page_id"], []).append((r["tag"], " ".join(r["text"].split())))
    want = {}
    for r in pages.collect():
        found = [(n.tag, _said(n)) for n in parse(r["html"]).walk() if n.tag in ("h1", "h2", "h3")]
        if found:
            want[r["page_id"]] = found
    squeeze = lambda d: {k: [(t, x.replace(" ", "")) for t, x in v] for k, v in d.items()}
    assert squeeze(got) == squeeze(want) and want


def test_frames(spark, sf):
    html = "intro<h1>A</h1>x<h2>B</h2><p>y</p><p>z</p><h2>C</h2><h1>D</h1><p></p>"
    df = spark.createDataFrame([(1, html, "kept")], "page_id int, html string, more string")
    rows = [tuple(r) for r in chunk.html_frame(df, ["page_id"], ("h1", "h2"), ("h1", "h2", "p")).orderBy("pos").drop("pos").collect()]
    assert rows == [(1, None, None, "", "intro"), (1, "A", None, "", "x"), (1, "A", "B", "p", "y"), (1, "A", "B", "p", "z"), (1, "A", "C", None, None)]
    assert "tag" not in chunk.html_frame(df, ["page_id"], ("h1",)).columns
    assert chunk.html_segments(df, ("h1",)).columns == ["page_id", "more", "pos", "tag", "text"]
    assert queries.QUERIES["html_frame"](spark, sf).where("h1 is not null").count() > 0


def test_a_page_that_fails_does_not_fail_the_job(spark, monkeypatch):
    pages = spark.createDataFrame([("a", "<main><p>fine</p></main>"), ("b", None)], "url string, html string")
    assert {r["origin"]: (r["text"], r["problem"]) for r in pages_as_markdown(pages).collect()} == {"a": ("fine", None), "b": ("", None)}
    bad = pages_as_markdown(pages, extract=(None,)).collect()
    assert {r["origin"]: (r["text"], r["problem"] is None) for r in bad} == {"a": (None, False), "b": ("", True)}


def test_transcripts_take_a_formatter(spark):
    df = spark.sql("SELECT array(struct('b' AS text, 2.5D AS start, 1D AS duration), struct('a' AS text, 1D AS start, 1D AS duration)) AS snippets")
    stamped = transcript_text(df, formatter=lambda s: F.concat(F.lit("["), s["start"].cast("int"), F.lit("] "), s["text"]), glue="\n")
    assert stamped.first()["text"] == "[1] a\n[2] b"
