import zipfile

import pytest
from pyspark.sql import functions as F

from lexloom.embedders import PROVIDERS, Embedder, embed_texts, request
from lexloom.ingest import default_prepare, ingest
from lexloom.operators.chunk import markdown_chunk
from lexloom.sources.readers import read_as_markdown, transcript_text
from lexloom.store import FlatStore, Store, cast_lossless
from lexloom.streaming.ingest import ingest_stream
from lexloom.tools import RetrievalTool


def docs(spark, rows):
    return spark.createDataFrame(rows, "origin string, text string")


def keyed(df):
    return df.withColumn("doc_key", F.monotonically_increasing_id())


@pytest.fixture
def store(spark, tmp_path):
    return Store.create(spark, str(tmp_path / "s"), extra_cols="n int, text string")


def prepare(n):
    return lambda d: markdown_chunk(d.select("doc_key", "text")).withColumn("n", F.lit(n))


def test_transitions(spark, store, tmp_path):
    load = docs(spark, [("a", "# T\n\nfoo bar"), ("b", "baz")])
    assert ingest(store, load, prepare(1))[0] == 2
    assert ingest(store, load, prepare(1))[0] == 0
    assert store.table().count() == 2 and store.extra.names == ["n"]
    before = {r["origin"]: r["doc_id"] for r in store.table("documents").collect()}
    assert ingest(store, load.where("origin = 'a'"), prepare(2))[0] == 1  # only an extra column differs
    assert ingest(store, docs(spark, [("c", "new"), (None, "x"), ("d", None)]), prepare(1)) is not None
    after = {r["origin"]: r["doc_id"] for r in store.table("documents").collect()}
    assert {k: after[k] for k in before} == before and set(after) == {"a", "b", "c"}
    assert len({r["chunk_id"] for r in store.table("embeddings").collect()}) == 3
    again = Store(spark, store.path)
    assert again.size == 64 and again.embedder == store.embedder and again.table().count() == 3
    with pytest.raises(ValueError, match="already exists"):
        Store.create(spark, store.path)
    assert Store.create(spark, store.path, overwrite=True).table().count() == 0
    with pytest.raises(ValueError, match="not a store"):
        Store(spark, str(tmp_path / "other"))
    with pytest.raises(ValueError):
        Store.create(spark, str(tmp_path / "n"), name="not good")


def test_insert(spark, store):
    some = keyed(docs(spark, [("a", "foo"), (None, "n"), (None, "n")])).cache()
    store.insert(some, prepare(1)(some))
    assert store.table("documents").count() == 3
    with pytest.raises(ValueError, match="duplicate"):
        store.insert(some, prepare(1)(some))
    with pytest.raises(ValueError, match="origin"):
        store.update(some, prepare(1)(some))
    wrong = prepare(1)(some).withColumn("text", F.lit("changed"))
    with pytest.raises(Exception, match="not supported"):
        store.insert(some.withColumn("origin", F.lit(None).cast("string")), wrong)


def test_retrieval(spark, store):
    ingest(store, docs(spark, [("a", "cats and dogs"), ("b", "running horses"), ("c", "cake")]), prepare(7))
    near = store.retrieve_vss("cats and dogs", 10).collect()
    assert near[0]["origin"] == "a" and near[0]["text"] == "cats and dogs" and [r["metric_value"] for r in near] == sorted(r["metric_value"] for r in near)
    assert [r["origin"] for r in store.retrieve_bm25("run").collect()] == ["b"]
    both = store.retrieve(["cake", "horse"], 2)
    assert {r["origin"] for r in both.collect()} >= {"b", "c"}
    assert store.retrieve("cake", 1, where="origin = 'a'").first()["origin"] == "a"
    tool = RetrievalTool(store, 1)
    assert len(tool("cats")) == 1 and len(tool("cats")) == 1 and len(tool.seen) == 2
    assert store.inspect().count() == 3 and store.inspect("cake").count() == 1
    assert set(store.atlas().columns) == {"chunk_id", "text", "x", "y"}


def test_overlaps_are_merged(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"), embedder=None)
    letters = "abcdefghijklmnopqrstuvwxyz"
    some = keyed(docs(spark, [("o", letters)])).cache()
    chunks = markdown_chunk(some.select("doc_key", "text"), 3, 2 / 3)
    store.insert(some, chunks)
    store.build_index()
    got = store.retrieve("abc bcd xyz", 3).orderBy("start").collect()
    assert [(r["start"], r["end"], r["text"]) for r in got] == [(1, 4, "abcd"), (24, 26, "xyz")]
    assert store.retrieve("abc bcd xyz", 3, merge=False).count() == 3


def test_flat_store(spark, tmp_path):
    store = FlatStore(spark, str(tmp_path / "f"), "h1 string, n int")
    rows = lambda *r: spark.createDataFrame(list(r), "origin string, hash string, text string, h1 string, n double, more int")
    texts = lambda: sorted(r["text"] for r in store.table().collect())
    store.update(rows(("foo", "foo", "foo", "h", 1.0, 5)))
    store.update(rows(("foo", "foo", "bar", "h", 1.0, 5)))
    assert texts() == ["foo"]
    store.update(rows(("foo", "bar", "bar", "h", 1.0, 5)))
    assert texts() == ["bar"]
    store.insert(rows(("x", None, "y", None, None, 1)).drop("origin", "hash"))
    store.insert(rows(("x", None, "y", None, None, 1)).drop("origin", "hash"))
    assert texts() == ["bar", "y", "y"] and store.table().columns == ["origin", "hash", "text", "h1", "n"]
    for bad, why in ((rows(("a", "b", "c", "d", 1.5, 1)), "loses"), (rows(("a", "b", None, "d", 1.0, 1)), "without text"), (rows(("a", "b", "c", "d", 1.0, 1)).drop("n"), "missing")):
        with pytest.raises(Exception, match=why):
            store.insert(bad)
    with pytest.raises(ValueError):
        store.update(rows(("a", "b", "c", "d", 1.0, 1)).drop("hash"))
    with pytest.raises(ValueError):
        FlatStore(spark, str(tmp_path / "g"), "chunk_id int")


def test_lossless_casts(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(1.0, "a")], "n double, s string")
    assert cast_lossless(df, T.StructType.fromDDL("n int")).first()["n"] == 1
    with pytest.raises(ValueError):
        cast_lossless(df, T.StructType.fromDDL("s int"))


def test_stream(spark, store, tmp_path):
    folder = str(tmp_path / "in")
    docs(spark, [("a", "one"), ("b", "two")]).write.parquet(folder)
    for _ in range(2):
        stream = spark.readStream.schema("origin string, text string").parquet(folder)
        ingest_stream(stream, store, str(tmp_path / "ck"), prepare(1)).awaitTermination()
        assert store.table("documents").count() == 2
        docs(spark, [("a", "one")]).write.mode("append").parquet(folder)


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A  \r\n\r\ntext\t\n")
    (tmp_path / "b.html").write_text("<title>B</title><main><p>hi</p></main>")
    (tmp_path / "c.csv").write_text("x,y\n1,2|3\n")
    (tmp_path / "d.json").write_text("{bad")
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("in/f.txt", "zipped")
    got = {r["origin"].rsplit("/", 1)[-1]: r for r in read_as_markdown(spark, str(tmp_path)).collect()}
    assert got["a.md"]["text"] == "# A\n\ntext\n" and got["b.html"]["text"] == "# B\n\nhi"
    assert got["c.csv"]["text"] == "| x | y |\n| --- | --- |\n| 1 | 2\\|3 |" and got["f.txt"]["text"] == "zipped"
    assert got["d.json"]["text"] is None and "JSONDecodeError" in got["d.json"]["problem"]
    talk = spark.sql("SELECT array(struct('b' AS text, 2D AS start), struct('a' AS text, 1D AS start)) AS snippets")
    assert transcript_text(talk).first()["text"] == "a b"


def test_providers():
    answers = {"google_gemini": lambda b: {"embeddings": [{"values": [1.0]} for _ in b["requests"]]}, "google_vertex": lambda b: {"predictions": [{"embeddings": {"values": [1.0]}} for _ in b["instances"]]}, "bedrock": lambda b: {"embeddings": {"float": [[1.0]] * len(b["texts"])}}, "ollama": lambda b: {"embeddings": [[1.0]] * len(b["input"])}}
    for name in PROVIDERS:
        spec = Embedder(name, "", {"base_url": "http://h", "headers": {"k": "v"}})
        calls = []

        def send(url, headers, body, name=name, calls=calls):
            calls.append(url)
            if len(calls) == 1:
                raise OSError("again")
            texts = body.get("input") or body.get("text") or body.get("texts") or body.get("requests") or body.get("instances")
            return answers.get(name, lambda b: {"data": [{"index": i, "embedding": [1.0]} for i in range(len(texts))]})(body)

        assert embed_texts(spec, ["t"] * 25, send) == [[1.0]] * 25
        assert embed_texts(spec, [], send) == []
    with pytest.raises(ValueError):
        embed_texts(Embedder("openai"), ["x"])
    assert request(Embedder("openai", "m", {"dims": 8, "base_url": "u"}), ["x"]) == ("u/embeddings", {"model": "m", "input": ["x"], "dimensions": 8})
    spec = Embedder("openai", "m", {"dims": 8})
    assert Embedder.from_json(spec.to_json()) == spec and default_prepare
    assert embed_texts(Embedder(), ["a b"]) == embed_texts(Embedder(), ["b a"])


def test_requests_have_the_settings():
    from lexloom.embedders import texts_a_request

    assert request(Embedder("openai", "m", {"user": "u"}), ["x"])[1]["user"] == "u" and "user" not in request(Embedder("ollama", "m", {"user": "u"}), ["x"])[1]
    assert request(Embedder("google_gemini", "m", {"task_type": "RETRIEVAL_QUERY"}), ["x"])[1]["requests"][0]["taskType"] == "RETRIEVAL_QUERY"
    assert [texts_a_request(Embedder("google_vertex", m)) for m in ("", "gemini-embedding-001")] == [20, 1]
    calls = []

    def slow(url, headers, body):
        calls.append(url)
        raise OSError("busy")

    with pytest.raises(OSError):
        embed_texts(Embedder("openai", "m", {"max_seconds": 0.5}), ["x"], slow)
    assert len(calls) == 1


def files(store):
    import os

    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(store.path) for f in names if f.endswith(".parquet")}


def test_an_update_writes_what_changes_only(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"), embedder=None)
    every = [(f"o{i}", f"document {i} " + "word " * 400) for i in range(300)]
    assert ingest(store, docs(spark, every), build_index=False)[0] == 300
    before = files(store)
    ids = {r["origin"]: r["doc_id"] for r in store.table("documents").collect()}
    assert ingest(store, docs(spark, [("o7", "a new text"), ("o8", every[8][1])]), build_index=False)[0] == 1
    new = {k: v for k, v in files(store).items() if k not in before}
    assert sum(new.values()) < sum(before.values()) / 2 and max(new.values()) < 10_000
    after = {r["origin"]: (r["doc_id"], r["text"]) for r in store.table("documents").collect()}
    assert len(after) == 300 and after["o7"] == (ids["o7"], "a new text") and {k: v[0] for k, v in after.items()} == ids
    assert [r["text"] for r in store.table().where("origin = 'o7'").collect()] == ["a new text"]
    chunks = sorted(map(tuple, store.table().collect()))
    store.compact()
    assert sorted(map(tuple, store.table().collect())) == chunks and store._now()["gone"] == []
    assert store.table("documents").schema["doc_id"].dataType.simpleString() == "bigint"


def insert(store, rows, **more):
    some = keyed(docs(store.spark, rows)).cache()
    store.insert(some, prepare(1)(some).drop("n") if not store.extra.names else prepare(1)(some), **more)


def between(store, monkeypatch, act):
    """Runs act() when the store's next change is about to claim its number."""
    claim, done = store._claim, []

    def late(number):
        if not done:
            done.append(number)
            act()
        return claim(number)

    monkeypatch.setattr(store, "_claim", late)


def test_two_writers_with_different_origins(spark, store, monkeypatch):
    insert(store, [("a", "one"), ("b", "two")])
    other = Store(spark, store.path)
    between(store, monkeypatch, lambda: (insert(other, [("c", "three\n\nfour")]), ingest(other, docs(spark, [("b", "two anew")]), prepare(1), build_index=False)))
    load = docs(spark, [("a", "one anew"), ("d", "five")])
    assert ingest(store, load, prepare(1), build_index=False)[0] == 2
    rows = store.table("documents").collect()
    assert {r["origin"]: r["text"] for r in rows} == {"a": "one anew", "b": "two anew", "c": "three\n\nfour", "d": "five"}
    assert len({r["doc_id"] for r in rows}) == 4 and store._now()["number"] == 4
    chunks = store.table().collect()
    assert len({r["chunk_id"] for r in chunks}) == len(chunks) and sorted(r["text"] for r in chunks) == ["five", "one anew", "three\n\nfour", "two anew"]
    insert(store, [("e", "six")])
    assert max(r["doc_id"] for r in store.table("documents").collect()) == store._now()["last_doc"] == 5


def test_two_writers_with_an_origin_in_common(spark, store, monkeypatch):
    from lexloom.store import StoreConflict

    insert(store, [("a", "one")])
    other = Store(spark, store.path)
    between(store, monkeypatch, lambda: ingest(other, docs(spark, [("a", "theirs")]), prepare(1), build_index=False))
    with pytest.raises(StoreConflict, match="origins"):
        ingest(store, docs(spark, [("a", "mine")]), prepare(1), build_index=False)
    assert store.table("documents").first()["text"] == "theirs"


def test_a_writer_that_died(spark, store, monkeypatch):
    from lexloom import store as module
    from lexloom.store import StoreConflict

    monkeypatch.setattr(module, "PATIENCE", 0)
    assert not store.release() and store._claim(1) and not store._claim(1)
    with pytest.raises(StoreConflict, match="release"):
        insert(store, [("a", "one")])
    assert store.release()
    insert(store, [("a", "one")])
    assert store._now()["number"] == 1


def test_claims_where_creation_is_not_atomic(spark, tmp_path):
    from lexloom import log

    class Other:  # a file system without conditional creation
        pass

    assert log.claimed(spark, str(tmp_path), 1) and not log.claimed(spark, str(tmp_path), 1)
    system, path = log.file_system(spark, str(tmp_path / "x"))
    with pytest.raises(Exception, match="conditional"):
        system.createFile(path).overwrite(False).must(log.CONDITIONAL, True).build()


def test_snapshots_and_vacuum(spark, store):
    insert(store, [("a", "one"), ("b", "two")])
    for i in range(3):
        ingest(store, docs(spark, [("a", f"version {i}")]), prepare(1), build_index=False)
    texts = lambda at=None: {r["origin"]: r["text"] for r in store.table("documents", at).collect()}
    want = {1: "one", 2: "version 0", 3: "version 1", 4: "version 2"}
    assert {at: texts(at)["a"] for at in want} == want and len(store.table("chunks", 2).collect()) == 2 and texts(0) == {}
    store.compact()
    assert {at: texts(at)["a"] for at in want} == want and texts() == texts(4)
    assert store.vacuum() == 0  # nothing is old enough
    assert store.vacuum(2, seconds=0) > 0 and texts(3)["a"] == "version 1"  # staged folders only
    assert store.vacuum(seconds=0) > 5 and texts() == {"a": "version 2", "b": "two"} and store.vacuum(seconds=0) == 0
    with pytest.raises(Exception):
        texts(2)
    with pytest.raises(ValueError, match="no change"):
        store.table("documents", 99)
    ingest(store, docs(spark, [("a", "after")]), prepare(1), build_index=False)
    assert texts() == {"a": "after", "b": "two"} and [r["number"] for r in store.changes().orderBy("number").collect()] == list(range(7))


def test_an_update_reads_files_that_may_have_its_origin(spark, tmp_path, monkeypatch):
    store = Store.create(spark, str(tmp_path / "s"), embedder=None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files of little data
    try:
        for n in range(4):
            assert ingest(store, docs(spark, [(f"o{i:03}", f"document {i}") for i in range(n, 200, 4)]), build_index=False)[0] == 50
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    every = {k: store._read(store._now(), k).inputFiles() for k in ("documents", "chunks")}
    read, real = {"documents": [], "chunks": []}, store._read

    def seen(now, kind, files=None, numbered=False):
        rows = real(now, kind, files, numbered)
        read[kind] += rows.inputFiles()
        return rows

    monkeypatch.setattr(store, "_read", seen)
    assert ingest(store, docs(spark, [("o005", "changed")]), build_index=False)[0] == 1
    assert len(every["documents"]) >= 12 and len([f for f in read["documents"] if "/documents/" in f]) <= 3 and len([f for f in read["chunks"] if "/chunks/" in f]) <= 3
    monkeypatch.undo()
    origins = lambda *x: spark.createDataFrame([(o,) for o in x], "key string")
    assert len(store.files("documents", origins("o005"))) in (2, 3) and store.files("documents", origins("zz", "")) == [] and store.files("documents", origins(None)) == []
    assert {r["text"] for r in store.table().where("origin in ('o005', 'o006')").collect()} == {"changed", "document 6"}


def test_bloom_filters():
    import numpy as np

    from lexloom import log

    rng = np.random.default_rng(1)
    inside, outside = rng.integers(-(2**63), 2**63, 5000), rng.integers(-(2**63), 2**63, 5000)
    field = log.bloom(inside)
    assert log.may_hold(field, inside).all() and log.may_hold(field, outside).mean() < 0.02
    assert not log.may_hold(log.bloom(inside[:0]), outside).any()


def test_the_index_takes_changes_as_segments(spark, tmp_path):
    """After each change the scores are those of an index built anew, and bytes written go with the change."""
    from lexloom.operators import bm25

    store = Store.create(spark, str(tmp_path / "s"), embedder=None)
    words = ["cats", "dogs", "cake", "running", "horses", "trees"]
    text = lambda i, v=0: " ".join(words[(i * 7 + j * (3 + v)) % 6] for j in range(5 + i % 40)) + f" w{chr(97 + i % 26)}x u{chr(97 + i % 23)}{chr(97 + i // 23 % 23)}{chr(97 + i // 529)}"
    ingest(store, docs(spark, [(f"o{i}", text(i)) for i in range(3000)]))
    size = lambda: {k: v for k, v in files(store).items() if "/index/" in k}
    first = size()
    for step in range(5):
        ingest(store, docs(spark, [("o7", text(7, step + 1) + f" step{step}"), (f"new{step}", "cake dogs")]), build_index=False)
        before = size()
        assert store.refresh_index() and not store.refresh_index()
        new = {k: v for k, v in size().items() if k not in before}
        assert sum(new.values()) < sum(first.values()) / 4
        asked = spark.createDataFrame([(0, "cats and running horse"), (1, "cake"), (2, f"step{step}"), (3, "wgx")], "query_id int, text string")
        built = bm25.build(store.table(), "chunk_id", ["context", "text"], stemmed=True, stop_words=True)
        want = {(r[0], r[1]): r[2] for r in bm25.score(built, asked).collect()}
        assert {(r[0], r[1]): r[2] for r in bm25.score(store.index(), asked).collect()} == pytest.approx(want)
    assert len(store.segments().paths) < 6  # merged on the way
    store.compact()
    assert store.refresh_index() and len(store.segments().paths) == 1


def test_the_feed_turns_one_state_into_another(spark, store, tmp_path):
    insert(store, [("a", "one"), ("b", "two")])
    ingest(store, docs(spark, [("a", "one anew"), ("c", "three")]), prepare(1), build_index=False)
    store.compact()
    ingest(store, docs(spark, [("c", "three anew"), ("a", "one again")]), prepare(1), build_index=False)
    key = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    for kind in ("documents", "embeddings"):
        states = {n: key(store.table(kind, n)) for n in range(5)}
        for after in range(5):
            for to in range(after, 5):
                feed = store.feed(after, to, kind)
                rows = {k: key(feed.where(f"_kind = '{k}'").drop("_kind")) for k in ("insert", "delete")}
                assert set(rows["delete"]) <= set(states[after])
                assert sorted([*(set(states[after]) - set(rows["delete"])), *rows["insert"]]) == states[to], (kind, after, to)
    replica, seen = {}, []

    def apply(feed, number):
        found = feed.collect()
        for r in sorted(found, key=lambda r: r["_kind"]):
            replica.pop(r["doc_id"], None) if r["_kind"] == "delete" else replica.__setitem__(r["doc_id"], r["text"])
        seen.append(number)

    store.follow(apply, str(tmp_path / "ck"), "documents").awaitTermination()
    assert replica == {r["doc_id"]: r["text"] for r in store.table("documents").collect()} and seen == [4]
    insert(store, [("d", "four")])
    store.follow(apply, str(tmp_path / "ck"), "documents").awaitTermination()
    assert seen == [4, 5] and "four" in replica.values()
    with pytest.raises(ValueError):
        store.feed(0, kind="chunks")


def test_vectors_by_cells(spark, store):
    ingest(store, docs(spark, [(f"o{i}", f"word{i} and text{i % 7}") for i in range(60)]), prepare(1))
    with pytest.raises(ValueError, match="no vector index"):
        store.retrieve_vss("word3", probes=2)
    store.build_vectors()
    found = lambda probes: [r["origin"] for r in store.retrieve_vss("word3 and text3", 5, probes=probes).collect()]
    assert found(99) == found(None) and found(1)[0] == "o3"
    ingest(store, docs(spark, [("o3", "something else"), ("new", "word3 and text3")]), prepare(1))
    assert store.refresh_vectors() and not store.refresh_vectors()
    assert found(1)[0] == "new" and "o3" not in found(99)[:1] and found(99) == found(None)


def test_the_index_knows_its_age(spark, store):
    assert store.index_age() is None
    with pytest.raises(ValueError, match="no full-text index"):
        store.index()
    ingest(store, docs(spark, [("a", "cats")]), prepare(1))
    assert store.index_age() == 0 and not store.refresh_index()
    ingest(store, docs(spark, [("b", "cats too")]), prepare(1), build_index=False)
    assert store.index_age() == 1 and store.retrieve_bm25("cat").count() == 1
    assert store.refresh_index() and store.retrieve_bm25("cat").count() == 2


def test_many_texts_are_retrieved_as_single_ones(spark, store):
    ingest(store, docs(spark, [(f"o{i}", f"cats {i} and {'dogs ' * (i % 5)} cake") for i in range(20)]), prepare(7))
    texts = ["cats dogs", "cake", "3"]
    together = {r["chunk_id"]: (r["cosine_distance"], r["bm25"]) for r in store.retrieve(texts, 4, merge=False).collect()}
    apart = {}
    for t in texts:
        for r in store.retrieve(t, 4, merge=False).collect():
            apart.setdefault(r["chunk_id"], (r["cosine_distance"], r["bm25"]))
    assert set(together) == set(apart)
    for k, v in apart.items():
        assert [x is None or round(x, 6) for x in together[k]] == [x is None or round(x, 6) for x in v]


def test_flat_store_retrieves(spark, tmp_path):
    store = FlatStore(spark, str(tmp_path / "f"), embedder=Embedder())
    rows = spark.createDataFrame([("a", "1", "cats and dogs"), ("b", "2", "running horses"), ("c", "3", "cake")], "origin string, hash string, text string")
    store.update(rows)
    with pytest.raises(ValueError, match="no full-text index"):
        store.retrieve_bm25("run")
    store.build_index()
    assert [r["origin"] for r in store.retrieve_bm25("run").collect()] == ["b"]
    assert store.retrieve_vss("cats and dogs", 2).first()["origin"] == "a"
    both = store.retrieve("cake", 2)
    assert both.first()["origin"] == "c" and both.columns == ["chunk_id", "origin", "hash", "text", "cosine_distance", "bm25", "rank"]
    assert store.retrieve("cake", 3, where="origin = 'a'").count() == 1
    store.update(spark.createDataFrame([("c", "4", "pie")], rows.schema))
    assert sorted(r["text"] for r in store.table().collect()) == ["cats and dogs", "pie", "running horses"]
