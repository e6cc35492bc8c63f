import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.kernels import boundaries, chunking, html, markdown
from lexloom.kernels.porter import stem


@pytest.mark.parametrize("points, size, want", [([1, 4, 7, 8, 10], 3, [1, 4, 7, 10]), ([1, 4, 7, 8, 10], 5, [1, 4, 8, 10]), ([1, 4, 7, 8, 10], 7, [1, 8, 10]), ([1], 5, [1]), ([1, 2], 5, [1, 2]), ([1, 2, 3], 5, [1, 3]), ([1, 1, 2, 3], 5, [1, 3]), ([1, 1], 5, [1]), ([], 5, []), ([1, 100, 200, 300], 50, [1, 100, 200, 300]), ([1, 2, 3, 4, 5], 2, [1, 3, 5])])
def test_cut_positions(points, size, want):
    assert boundaries.cut_positions(points, size) == want


def test_chunks_of_known_documents():
    ranges = lambda *a, **k: [c[:2] for c in chunking.chunk(*a, **k)]
    assert ranges("foo\nbar\nfaz", 4, 0) == [(1, 4), (5, 8), (9, 11)]
    assert ranges("abcdefghijklmnopqrstuvwxyz", 3, 2 / 3) == [(i, i + 2) for i in range(1, 25)]
    text = "# A\n\n## B\n\n# C\n\n### D\n\ntext"
    assert chunking.scope([(b.start, b.level, text[b.start - 1 : b.end]) for b in markdown.blocks(text) if b.kind == "heading"], text.index("text") + 1) == ["# C", "## B", "### D"]
    two = "## one\n\nfirst\n\n## two\n\nsecond"
    assert [c[3] for c in chunking.chunk(two, None, segment_levels=(2,))] == ["## one\n\nfirst\n\n", "## two\n\nsecond"]
    assert chunking.chunk("") == []
    for bad in ({"overlap": 1}, {"overlap": -0.1}, {"size": 0}):
        with pytest.raises(ValueError):
            chunking.chunk("text", **bad)


_TEXT = st.lists(st.sampled_from(["# H", "## K", "word ", "A sentence. ", "\n", "\n\n", "é", "- item", "> q", "```", "    code", "x-y"]), max_size=60).map("".join)


@settings(max_examples=150, deadline=None)
@given(_TEXT, st.integers(1, 40), st.sampled_from([0, 0.25, 0.5, 0.75]), st.sampled_from([(), (1,), (1, 2)]))
def test_chunks_cover_the_text(text, size, overlap, levels):
    out = chunking.chunk(text, size, overlap, segment_levels=levels)
    assert "".join(dict((i, text[i - 1]) for a, z, *_ in out for i in range(a, z + 1)).values()) == text
    assert len({c[0] for c in out}) == len({c[1] for c in out}) == len(out)
    breaks = [b.start for b in markdown.blocks(text) if b.kind == "heading" and b.level in levels]
    for a, z, _, piece in out:
        assert 1 <= a <= z <= len(text) and piece == text[a - 1 : z]


@given(_TEXT)
def test_segments_join_to_the_text(text):
    assert "".join(x for _, x in markdown.segments(text, ["h1", "h2", "p", "pre"])) == text


def test_blocks():
    text = "# A\n\npara one\nlazy\n\n> quote\n\n- li\n\n```r\n# no\n```\n\nSet\n===\n\n    code\n\n***\n"
    assert [(b.kind, b.level, text[b.start - 1 : b.end]) for b in markdown.blocks(text)] == [("heading", 1, "# A"), ("paragraph", 0, "para one\nlazy"), ("paragraph", 0, "quote"), ("paragraph", 0, "li"), ("code_block", 0, "```r\n# no\n```"), ("heading", 0, "Set\n==="), ("code_block", 0, "code")]


def test_sentences_and_splits():
    text = "Mr. Smith went. He saw it! e.g. this? yes.\nNext line"
    assert [text[s - 1 :].split()[0] for s in boundaries.sentence_starts(text)] == ["Mr.", "He", "Next"]
    assert boundaries.split(None, 5, ["word"]) == [None]
    assert boundaries.split("short", 10, ["word"]) == ["short"]
    out = boundaries.split("one two three four five six", 9, ["sentence", "word", "character"])
    assert all(len(x) <= 10 for x in out) and "".join(out).replace(" ", "") == "onetwothreefourfivesix"


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("formalize", "formal"), ("electrical", "electr"), ("adoption", "adopt"), ("controll", "control"), ("rate", "rate"), ("at", "at")])
def test_stems(word, want):
    assert stem(word) == want


def test_html():
    page = "<html><head><title>T</title><style>x</style></head><body><nav>menu</nav><main><h2 id=a>Head</h2><p class='c d'>One <b>two</b> <a href='/x'>link</a><br>next</p><ul><li>a<li>b</ul><pre>x\n```\n</pre><table><tr><th>A</th></tr><tr><td>1|2</td></tr></table></main>out</body></html>"
    text = html.to_markdown(page)
    assert text == "# T\n\n## Head\n\nOne **two** [link](/x)\nnext\n\n- a\n- b\n\n````\nx\n```\n````\n\n| A |\n| --- |\n| 1\\|2 |"
    root = html.parse(page)
    for s, n in (("main > p.c", 1), ("#a", 1), ("body b", 1), ("p.e", 0), ("ul li, pre", 3), ("[href=/x]", 1)):
        assert len(html.select(root, s)) == n, s
    assert html.to_markdown(None) == "" and "menu" in html.to_markdown(page, extract=(), zap=())


def test_containers():
    seen = lambda t: [(n.tag, t[n.start - 1 : n.end]) for n in markdown.nodes(t) if n.kind != "paragraph"]
    assert seen("- a\n  - b\n\n- c\n") == [("ul", "- a\n  - b\n\n- c"), ("li", "- a\n  - b"), ("ul", "- b"), ("li", "- b"), ("li", "- c")]
    table = "top\n| a | b \\| c |\n|---|:-:|\n| 1 | 2 |"
    assert seen(table) == [("table", table[4:]), ("tr", "| a | b \\| c |"), ("th", "a"), ("th", "b \\| c"), ("tr", "| 1 | 2 |"), ("td", "1"), ("td", "2")]
    assert [n.kind for n in markdown.nodes("[^n]: note\n    more\n\n[x]: http://y\n\n<div>\nz")] == ["footnote_definition", "paragraph", "html_block"]
    assert [n.tag for n in markdown.nodes("- tight\n\n1. loose\n\n2. too") if n.kind == "paragraph"] == ["", "p", "p"]
    text = "x\n\n- a\n- b\n\n| t |\n| - |\n| u |"
    assert markdown.segments(text, ["ul", "li", "table"]) == [("", "x\n\n"), ("ul", "- a"), ("", "\n"), ("li", "- b"), ("", "\n\n"), ("table", text[-17:])]


@given(st.lists(st.sampled_from(["- ", "1. ", "> ", "  ", "    ", "\t", "a", "|", "---", "\n", "\n\n", "```", "[^a]: ", "<div>", "# ", "é"]), max_size=40).map("".join))
def test_nodes_are_ranges_of_the_text(text):
    found = markdown.nodes(text)
    assert all(1 <= n.start <= n.end <= len(text) for n in found) and [n.start for n in found] == sorted(n.start for n in found)
    assert "".join(x for _, x in markdown.segments(text, ["ul", "ol", "li", "blockquote", "table", "p", "td"])) == text
