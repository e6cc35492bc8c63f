import os

from pyspark.sql import functions as F

from lexloom.cache import EmbeddingCache
from lexloom.embedders import Embedder
from lexloom.ingest import ingest
from lexloom.operators.chunk import markdown_chunk
from lexloom.store import FlatStore, Store, connect

SPEC = Embedder("openai", "m", {"base_url": "http://h", "headers": {"Authorization": "x"}})


def counting(folder):
    """A transport that notes the texts it is sent."""

    def send(url, headers, body):
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write("\x00".join(body["input"]))
        return {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]}

    def sent():
        found = [t for name in os.listdir(folder) for t in open(os.path.join(folder, name)).read().split("\x00")]
        for name in os.listdir(folder):
            os.remove(os.path.join(folder, name))
        return sorted(found)

    return send, sent


def test_texts_are_sent_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    send, sent = counting(str(tmp_path / "calls"))
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    df = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None)] * 3, "id int, text string").withColumn("_digest", F.lit(0))
    got = cache.with_embeddings(df, SPEC, "text", send)
    assert got.columns == ["id", "text", "_digest", "embedding"]
    assert {(r["id"], tuple(r["embedding"] or ())) for r in got.collect()} == {(1, (2.0, 1.0)), (2, (1.0, 1.0)), (3, (2.0, 1.0)), (4, ())} and got.count() == 12
    assert sent() == ["aa", "b"]
    cache.with_embeddings(df.union(spark.createDataFrame([(5, "new", 0)], df.schema)), SPEC, "text", send)
    assert sent() == ["new"]
    other = Embedder("openai", "another", SPEC.settings)
    cache.with_embeddings(df, other, "text", send)
    assert sent() == ["aa", "b"] and cache.folder(other) != cache.folder(SPEC)
    assert cache.folder(SPEC) == cache.folder(Embedder("openai", "m", {"base_url": "http://other"}))
    assert cache.with_embeddings(df.where("false"), SPEC, "text", send).count() == 0 and sent() == []


def test_a_changed_document_sends_its_new_chunks(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    send, sent = counting(str(tmp_path / "calls"))
    store = Store.create(spark, str(tmp_path / "s"), SPEC, transport=send, cache=EmbeddingCache(spark, str(tmp_path / "cache")))
    sent()
    chunks = lambda d: markdown_chunk(d.select("doc_key", "text"), 20, 0.0)
    text = "first paragraph one\n\nsecond paragraph two\n\nthird paragraph three"
    docs = lambda t: spark.createDataFrame([("a", t), ("b", "first paragraph one")], "origin string, text string")
    ingest(store, docs(text), chunks, build_index=False)
    first = sent()
    assert len(first) == len(set(first)) >= 3
    ingest(store, docs(text.replace("third paragraph three", "third paragraph four")), chunks, build_index=False)
    again = sent()
    assert 0 < len(again) < len(first) and not set(again) & set(first)
    assert store.table("embeddings").where("embedding is null").count() == 0


def test_connect_finds_the_format(spark, tmp_path):
    import pytest

    Store.create(spark, str(tmp_path / "s"), embedder=None)
    assert isinstance(connect(spark, str(tmp_path / "s")), Store)
    FlatStore(spark, str(tmp_path / "f"), "n int").insert(spark.createDataFrame([("t", 1)], "text string, n int"))
    found = connect(spark, str(tmp_path / "f"), extra_cols="n int")
    assert isinstance(found, FlatStore) and found.table().count() == 1
    with pytest.raises(ValueError):
        connect(spark, str(tmp_path / "none"))
