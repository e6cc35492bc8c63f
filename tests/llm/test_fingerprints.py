import hashlib
import random
import re

import numpy as np

from lexloom.llm import fingerprints as fp

B, M = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1


def mix(x):
    x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & M
    x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 & M
    return x ^ x >> 33


def poly(values):
    return sum((v + 1) * pow(B, i, 1 << 64) for i, v in enumerate(values)) & M


def brute(text):
    """{level: set of piece digests}, without any code under test."""
    found = [(m.group(), m.end()) for m in re.finditer(r"[^ \t-\r]+", text)]
    ends = [m for _, m in found]
    words = [mix(poly(w.encode())) for w, _ in found]
    line = ["\n" in re.match(r"[ \t-\r]*", text[e:]).group() for e in ends]
    out, begun = {}, False
    for level in range(15):
        if not words:
            break
        pieces, now = [], []
        for i, w in enumerate(words):
            now.append(w)
            if i == len(words) - 1 or (w >> 7) % (2 << 2 * level) == 0 or (line[i] and (level <= 2 or (w >> 7) % (2 << 2 * (level - 2)) == 0)):
                pieces.append(now)
                now = []
        digests = {mix((poly(p) + len(p)) & M) for p in pieces}
        if len(pieces) <= 2048 or begun:
            begun = begun or len(digests) <= 40
            if begun:
                out[level] = digests
        if len(pieces) == 1:
            break
    return out


def jaccard(a, b):
    """Likeness at the finest level of both."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    level = max(min(a), min(b))
    a, b = a[min(level, max(a))], b[min(level, max(b))]
    return len(a & b) / len(a | b)


def some_texts(seed=2, n=60):
    random.seed(seed)
    words = [f"w{i}" for i in range(400)]
    return [random.choice([" ", "\n", " "]).join(random.choices(words, k=random.choice([0, 1, 2, 5, 20, 60, 300, 900, 5000]))) for _ in range(n)]


def test_pieces_are_those_of_the_brute_version():
    texts = [*some_texts(), "", "  ", "é 日本 x\ty\r\nz", "the same line\n" * 500]
    got = {i: {} for i in range(len(texts))}
    for level, which, owner, digest in fp.pieces([t.encode() for t in texts]):
        for i in which.tolist():
            got[i][level] = set(digest[owner == i].tolist())
    assert [got[i] for i in range(len(texts))] == [brute(t) for t in texts]


def test_long_texts_and_long_words_go_in_parts(monkeypatch):
    texts = [t.encode() for t in some_texts(3, 12)] + [b"x" * 70_000 + b" a b\n" + b"y" * 300]
    want = fp.prints(texts)
    monkeypatch.setattr(fp, "CHUNK", 500)
    assert fp.prints(texts) == want
    assert [fp.prints([t])[0] for t in texts] == want


def test_peeling_recovers_the_difference():
    rng = np.random.default_rng(1)
    both, one, two = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (500, 20, 15))
    s = fp.Sketch(np.array([64]))
    for keys, sign in ((np.concatenate([both, one]), 1), (np.concatenate([two, both]), -1)):
        s.add(keys, np.zeros(len(keys), np.int64), sign)
    keys, _, sign, done = s.peel()
    assert done.all() and set(keys[sign == 1].tolist()) == set(one.tolist()) and set(keys[sign == -1].tolist()) == set(two.tolist())
    s = fp.Sketch(np.array([4]))
    s.add(both, np.zeros(len(both), np.int64), 1)
    assert not s.peel()[3].any()


def test_likeness_and_digests_come_from_the_strings_alone():
    texts = some_texts(4, 120)
    pairs = [(random.choice(texts), random.choice(texts)) for _ in range(150)]
    for t in texts[:100]:  # edited versions
        words = t.split(" ")
        for _ in range(random.choice([1, 3, 20])):
            words.insert(random.randrange(len(words) + 1), random.choice(["new", "w1", "other\n"]))
        pairs.append((t, " ".join(words)))
    a, b = (fp.prints([p[k].encode() for p in pairs]) for k in (0, 1))
    near, level, digest, pair, side = fp.compare(a, b)
    resolved = 0
    for i, (s, t) in enumerate(pairs):
        x, y = brute(s), brute(t)
        finest = max(min(x, default=0), min(y, default=0))
        if level[i] == finest:
            resolved += 1
            assert abs(near[i] - jaccard(x, y)) < 1e-12
        if level[i] >= 0:
            own, other = (z.get(min(int(level[i]), max(z, default=0)), set()) for z in (x, y))
            assert set(digest[(pair == i) & (side == 1)].tolist()) == own - other
            assert set(digest[(pair == i) & (side == -1)].tolist()) == other - own
    assert resolved > 0.75 * len(pairs) and all(level[i] == max(min(brute(s), default=0), min(brute(t), default=0)) for i, (s, t) in enumerate(pairs[-20:], len(pairs) - 20))
    assert fp.likeness(a, a).min() == 1.0


def test_a_sketch_that_sticks_is_tried_again(monkeypatch):
    sizes = []
    peel = fp.Sketch.peel
    monkeypatch.setattr(fp.Sketch, "peel", lambda s: sizes.append(s.part.tolist()) or peel(s))
    a, b = fp.prints([" ".join(f"{x}{i}" for i in range(70)).encode() for x in "ab"])
    near = fp.likeness([a], [b])
    assert near[0] == 0 and len(sizes) > 1 and sizes[1] == [2 * sizes[0][0]]


def expected(rows):
    """rows: (id, text) in order."""
    out = {}
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        out.setdefault(i, []).append((len(t), hashlib.sha256(e.encode()).hexdigest(), round(jaccard(brute(t), brute(e)), 9), round(jaccard(brute(t), brute(nxt)), 9)))
    return out


def test_documents_over_many_ranges(spark, sf, monkeypatch):
    from lexloom.llm import queries

    monkeypatch.setattr(fp, "RANGE_BYTES", 20_000)
    monkeypatch.setattr(fp, "FAN", 3)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = queries.QUERIES["op5_iblt_fingerprints"](spark, sf).collect()
    want = expected(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    assert len(got) == len(want)
    exact = 0
    for r in got:
        own = want[r["doc_id"]][0]
        assert (r["n_chars"], r["edited_sha256"]) == own[:2]
        assert r["near_edited"] == fp.likeness([r["fingerprint"]], [r["edited_fingerprint"]])[0]
        exact += (round(r["near_edited"], 9), round(r["near_next"], 9)) == own[2:]
    assert exact > 0.9 * len(got)  # the others are resolved at a coarser level
    by_id = sorted(got, key=lambda r: r["doc_id"])
    assert [r["near_next"] for r in by_id] == fp.likeness([r["fingerprint"] for r in by_id], [r["fingerprint"] for r in by_id[1:] + by_id[:1]]).tolist()
    assert sum(r["near_edited"] for r in got) > 10 * sum(r["near_next"] for r in got)


def test_recovered_digests_of_two_tables(spark):
    old = {1: "one two three\nfour five six\nseven eight", 2: "same text", 3: "only before here", None: "no id at all"}
    new = {1: "one two three\nfour 5 six\nseven eight", 2: "same text", 4: "", None: "no id at all, changed"}
    frames = [fp.fingerprinted(spark.createDataFrame([*x.items(), (2, "same text")], "doc_id long, text string")) for x in (old, new)]
    got = fp.differences(*frames).collect()
    for i in (1, 3, None):
        a, b = brute(old.get(i, "")), brute(new.get(i, ""))
        rows = [r for r in got if r["id"] == i]
        level = rows[0]["level"]
        x, y = (z.get(min(level, max(z, default=0)), set()) for z in (a, b))
        assert {int(r["digest"], 16) for r in rows if r["side"] == "before"} == x - y
        assert {int(r["digest"], 16) for r in rows if r["side"] == "after"} == y - x
    assert [(r["likeness"], r["digest"]) for r in got if r["id"] == 2] == [(1.0, None)]
    assert [r["likeness"] for r in got if r["id"] == 4] == [1.0]
    assert fp.differences(*(f.where("false") for f in frames)).count() == 0


def test_a_hot_id_is_dealt_to_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_BYTES", 1_000)
    docs = spark.range(600).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "concat('text ', id, ' of some words ', id * 7) as text")
    got = fp.compare_versions(docs)
    assert got.count() == 600 and got.where("doc_id = 7").count() == 201 and got.select("edited_sha256").distinct().count() > 590
    counts = [r["n"] for r in got.selectExpr("spark_partition_id() as p").groupBy("p").count().withColumnRenamed("count", "n").collect()]
    assert max(counts) < 100


def test_odd_rows(spark, odd, none):
    got = fp.compare_versions(odd).collect()
    rows = odd.selectExpr("coalesce(doc_id, -9223372036854775808) as i", "coalesce(text, '') as t").selectExpr("i", "t", "shiftrightunsigned(xxhash64(t), 12) as h").collect()
    want = expected([(r["i"], r["t"]) for r in sorted(rows, key=lambda r: (r["i"], r["h"], r["t"]))])
    assert len(got) == odd.count()
    for r in got:
        own = want[r["doc_id"] if r["doc_id"] is not None else -(1 << 63)]
        assert (r["n_chars"], r["edited_sha256"]) in [x[:2] for x in own]
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 1}) == 1
    assert fp.compare_versions(none).count() == 0
    single = fp.compare_versions(odd.where("doc_id = 8")).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1.0
