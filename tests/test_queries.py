import math
import os
import random
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

from lexloom.functions.text import STOP_WORDS
from lexloom.kernels.porter import stem
from lexloom.plans import queries as plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def comparable(rows, columns):
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", plans.QUERIES)
def test_query(spark, db, name):
    got = plans.QUERIES[name](spark, SF)
    rows = comparable([tuple(r) for r in got.collect()], got.columns)
    if name not in plans.ORACLE:
        assert rows
        return
    cur = db.execute(plans.ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows == comparable(cur.fetchall(), columns)


@pytest.fixture
def odd_items(spark, tmp_path):
    """A folder with few documents, and with items of any id, some null, of several texts or without words; its rows."""
    rng = random.Random(3)
    words = [*(f"run{chr(97 + i)}ing" for i in range(20)), "running", "runs", "dogs", "the", "of", "x"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(-20, 60)] + [(60, None), (61, ""), (62, "the of")]
    items = [(i, " ".join(rng.choices(words, k=4))) for i in (*range(7), 50, 77, -3, None, None, 5)] + [(8, None), (9, ""), (10, "nothing")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs, items


def test_bm25_porter_asks_every_item(spark, odd_items):
    folder, docs, items = odd_items
    cut = lambda text: [stem(w) for w in re.findall("[a-z]+", (text or "").lower()) if w not in STOP_WORDS]
    texts, asked = {i: cut(t) for i, t in docs}, {}
    for i, t in items:
        asked.setdefault(i, set()).update(cut(t))
    average = sum(map(len, texts.values())) / len(texts)
    df = {t: sum(t in x for x in texts.values()) for x in texts.values() for t in x}
    want = set()
    for q, terms in asked.items():
        weight = lambda t, x: math.log10((len(texts) - df[t] + 0.5) / (df[t] + 0.5) + 1) * x.count(t) * 2.2 / (x.count(t) + 1.2 * (0.25 + 0.75 * len(x) / average))
        found = sorted((-round(sum(weight(t, x) for t in terms if t in x), 9), i) for i, x in texts.items() if terms & {*x})
        want |= {(q, i, n + 1, round(-m, 5)) for n, (m, i) in enumerate(found[:10])}
    assert {q for q, *_ in want} == {*range(7), 50, 77, -3, None}
    assert {tuple(r) for r in plans.QUERIES["bm25_porter"](spark, folder).collect()} == want


def test_bm25_blocks_asks_every_item_and_reads_every_document(spark, odd_items):
    folder, docs, items = odd_items
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(plans.ORACLE["bm25_blocks"]).fetchall()
    assert {r[0] for r in want} == {*range(7), 50, 77, -3, None} and min(r[1] for r in want) < 0
    assert {tuple(r) for r in plans.QUERIES["bm25_blocks"](spark, folder).collect()} == {*want}


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    skip = shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__", "tests")
    shutil.copytree(root, tmp_path / "r", ignore=skip)
    code = "import __spark_entry__ as e, sys; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", env=env, check=True)
