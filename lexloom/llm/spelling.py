"""Spelling variants: words at one edit, by blocks of a forward and a reversed sorted dictionary.

An edit that turns a word of L code points into another (of L or L + 1) is either at or after the middle, and both start with
the same half, or before it, and both end with the same half. So the words of a length and of the next one, sorted forward,
hold the pairs of the first kind in blocks that share a prefix; sorted by their reversed spelling, they hold the others in
blocks that share a suffix. A block with more than BLOCK words is divided: what is left between the shared ends is halved
again, and one of these halves is intact too, so that its words are sorted by a longer prefix or by prefix and suffix. In the
end the ends leave one place open, where there are no more words than letters.

Blocks are ranges of sorted rows, scanned in streams. In a block, words that agree in all but one open place, and longer words
that become one of the shorter ones without a letter, are the pairs: exactly those at one edit. A block looks at its own open
places only, and drops one of a run of equal letters at its first place, so that each pair is found once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, text_of, written

#: Words of a block that is not divided, while more than one place is open.
BLOCK = 512
#: Shortest words, least occurrences of a word, and how many times as frequent as a word its form is.
SHORTEST, OFTEN, TIMES = 6, 5, 5
#: One of so many different runs of a document loses a letter.
DAMAGE = 199
LETTERS = "a-zÀ-ÿ"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run): the maximal runs of at least SHORTEST letters, A-Z lower-cased. Null texts have none."""
    low = F.translate(text_of(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{SHORTEST},}}+"), F.lit(0))
    return docs.select(F.col(id_col).alias("id"), F.explode(found).alias("run"))


def damaged(found: DataFrame) -> DataFrame:
    """(word): the runs of runs(), some of which lose a letter by a hash of document and run. A null id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.withColumn("h", h).select(F.when(F.col("h") % DAMAGE == 0, cut).otherwise(F.col("run")).alias("word"))


def dictionary(words: DataFrame) -> DataFrame:
    """(word, n): words of at least SHORTEST code points that occur OFTEN at least."""
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= SHORTEST) & (F.col("n") >= OFTEN))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"pre": F.substring("word", F.lit(1), F.col("a")), "suf": F.when(F.col("b") > 0, F.expr("right(word, b)")).otherwise("")})


KEY = ["size", "a", "b", "pre", "suf"]


def _halves(rows: DataFrame, sides: Column) -> DataFrame:
    """Rows (word, n, size, a, b) once for each side: a code points are shared at the start and b at the end."""
    return _keyed(rows.withColumn("side", F.explode(sides)).select("word", "n", "size", F.col("side.a").alias("a"), F.col("side.b").alias("b")))


def _blocks(words: DataFrame) -> Iterator[DataFrame]:
    """Rows of blocks that need no more division, by round."""
    side = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    length, zero = F.length("word"), F.lit(0)
    # of words of `size` and `size` + 1 letters: each word meets those of its own length and both neighbours
    start = words.withColumn("size", F.explode(F.array(length, length - 1))).where(F.col("size") >= SHORTEST)
    half = F.floor(F.col("size") / 2)
    rows = _halves(start, F.array(side(half, zero), side(zero, F.col("size") - half)))
    while True:
        rows = written(rows, "spelling-blocks")
        sizes = rows.groupBy(*KEY).agg(F.count("*").alias("members"), F.count(F.when(F.length("word") == F.col("size"), 1)).alias("own"))
        sizes = sizes.where("members > 1 and own > 0")
        hot = (F.col("members") > BLOCK) & (F.col("size") - F.col("a") - F.col("b") > 1)
        sizes = written(sizes.select(*[F.col(k).alias(f"k_{k}") for k in KEY], hot.alias("hot")), "spelling-sizes")
        same = [F.col(k) == F.col(f"k_{k}") for k in KEY]
        divided = sizes.where("hot")
        any_hot = not divided.isEmpty()
        yield (rows.join(divided, same, "left_anti") if any_hot else rows).select(*KEY, "word", "n")
        if not any_hot:
            return
        open_half = F.floor((F.col("size") - F.col("a") - F.col("b")) / 2)
        longer_start = side(F.col("a") + open_half, F.col("b"))
        longer_end = side(F.col("a"), F.col("size") - F.col("a") - open_half)
        rows = _halves(rows.join(divided, same, "left_semi").select("word", "n", "size", "a", "b"), F.array(longer_start, longer_end))


def block_pairs(size: int, a: int, b: int, own: list[tuple[str, int]], longer: list[tuple[str, int]]) -> Iterator[tuple[str, int, str, int]]:
    """Pairs at one edit in the open places of a block; `own` has words of `size` letters, `longer` those of one more."""
    for i in range(a, size - b):
        alike = defaultdict(list)
        for w in own:
            alike[w[0][:i] + w[0][i + 1 :]].append(w)
        for group in alike.values():
            for j, (x, n) in enumerate(group):
                for y, m in group[:j]:
                    yield x, n, y, m
    known = dict(own)
    for y, m in longer:
        for j in range(a, size - b + (b == 0)):
            if j == 0 or y[j] != y[j - 1]:
                x = y[:j] + y[j + 1 :]
                if x in known:
                    yield x, known[x], y, m


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each block of sorted rows, both ways round."""
    key, own, longer, out = None, [], [], []

    def emit():
        columns = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], ["word", "n", "near", "near_n"])

    def finish():
        if own and len(own) + len(longer) > 1:
            for x, n, y, m in block_pairs(*key[:3], own, longer):
                out.append((x, n, y, m))
                out.append((y, m, x, n))
                if len(out) >= 20_000:
                    yield emit()
                    out.clear()

    for batch in batches:
        for *k, word, n in zip(*(batch.column(c).to_pylist() for c in (*KEY, "word", "n"))):
            if k != key:
                if key is not None:
                    yield from finish()
                key, own, longer = k, [], []
            (own if len(word) == k[0] else longer).append((word, n))
    if key is not None:
        yield from finish()
    if out:
        yield emit()


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) for each two of the distinct words(word, n) at one edit, both ways round."""
    ready(words.sparkSession)
    rows = None
    for block in _blocks(words):
        rows = block if rows is None else rows.union(block)
    # ranges of the forward dictionary (shared prefix first), then of the reversed one (no prefix, shared suffix)
    dealt = rows.repartitionByRange("size", "pre", "suf", "a", "b").sortWithinPartitions("size", "pre", "suf", "a", "b")
    return dealt.mapInArrow(_scan, "word string, n long, near string, near_n long")


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words(word, n) without nulls; see the query's contract for the names.

    Words compare by code points, as bytes of UTF-8 do; very long words are words like others. A table without words gives
    no rows; other columns are not looked at. Forms grow in n by TIMES, so that following them ends; each step is a join. Words may be
    long, so that no side is broadcast by its rows.
    """
    words = written(words.select("word", "n"), "spelling-words")
    best = near_pairs(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("best"))
    fits = -F.col("best.minus") >= TIMES * F.col("n")
    best = best.select(F.col("word").alias("w"), "n_near", F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n"))
    best = written(best, "spelling-best")
    step = best.where("form is not null").select("w", F.col("form").alias("root"))
    roots = step
    while True:  # after k rounds, roots are 2^k steps away or the last
        onward = roots.select(F.col("w").alias("v"), F.col("root").alias("further"))
        joined = written(roots.join(onward, F.col("root") == F.col("v"), "left"), "spelling-roots")
        moved = joined.where("further is not null").isEmpty()
        roots = joined.select("w", F.coalesce("further", "root").alias("root"))
        if moved:
            break
    roots = roots.select(F.col("w").alias("r"), "root")
    out = words.join(best, F.col("word") == F.col("w"), "left").join(roots, F.col("word") == F.col("r"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
