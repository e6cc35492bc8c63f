"""Quality classifier: interpolated modified Kneser-Ney model over symbols, trained on trusted text.

A document's words (between ASCII spaces) are strings of code points with a boundary on either side; the model is of
order 5 within words, so a word's probability depends on the word alone; a word that repeats the one before it is
one special symbol. Counts are tables in Spark, dealt by n-gram: words of the trusted documents, 5-gram counts, then
continuation counts of each lower order. Joins of these tables on context and suffix give, for each n-gram, what it adds
to the log probability that its suffix has after backing off, and for each context the log weight of backing off. So a
symbol's log probability is a plain sum over the n-grams and contexts that the model has, each looked up by itself:
shards of the model, dealt by n-gram, are read by the tasks from the shared folder one after another and their sums
added. Nothing of the model passes through the driver. Trusted documents that were not trained on give the quantiles of
each language that the perplexities are held against.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import HashIndex, by_text, code_points, mixed, slices, tokens, trimmed
from .common import new_folder, ready, row_hash, small, text_of, written
from .files import read_table

#: Symbols of an n-gram, bits of a symbol (a code point plus one; 0 is the boundary): three in `lo`, the others in `hi`.
ORDER, WIDTH = 5, 21
MASK = (1 << WIDTH) - 1
#: Different symbols that there can be: below order 1 all are equally likely, so no alphabet is left out.
SYMBOLS = 0x110000 + 1
#: Stands for a word equal to the one before it, so that runs of one word cost what such repeats cost in trusted text.
REPEAT = "\ue000"
#: Rows of the model in a shard, about (20 bytes each), and text bytes that meet a shard at once in a task.
SHARD_ROWS, RUN = 3_000_000, 96 << 20
#: A language's threshold is this quantile of the adjusted perplexity of trusted documents that were not trained on, times
#: LEEWAY. Perplexity is adjusted for length: divided by exp(SPREAD / sqrt(symbols)), since that of short texts varies.
QUANTILE, LEEWAY, SPREAD = 0.95, 1.25, 2.0
#: One trusted document in FOLDS is kept for the threshold. Languages with fewer of these than LEAST_TRUSTED use the
#: threshold over all languages.
FOLDS, LEAST_TRUSTED = 5, 20


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """tokens(), where a word that repeats the word before it is the word REPEAT."""
    words, codes, offsets = tokens(texts)
    same = np.zeros(len(codes), bool)
    same[1:] = codes[1:] == codes[:-1]
    same[offsets[:-1][offsets[:-1] < len(codes)]] = False
    return pa.concat_arrays([words, pa.array([REPEAT])]), np.where(same, len(words), codes), offsets


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in slices(b):
            words, codes, _ = _words(part.column("text"))
            n = np.bincount(codes, minlength=len(words))
            yield pa.RecordBatch.from_arrays([words.filter(pa.array(n > 0)), pa.array(n[n > 0])], ["word", "n"])


def _grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo) of the 5-gram of each predicted symbol, and the first of each word and the end; a word of n code points has n + 1."""
    flat, at = code_points(words)
    n = np.diff(at) + 1
    ends = np.cumsum(n)
    seq = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    inside = np.ones(len(seq), bool)
    inside[ends - 1] = False
    seq[inside] = flat.astype(np.int64) + 1
    depth = np.arange(len(seq)) - np.repeat(ends - n, n)  # symbols of the word before this one
    hi, lo = np.zeros_like(seq), seq.copy()
    for k in range(1, ORDER):
        before = np.zeros_like(seq)
        before[k:] = np.where(depth[k:] >= k, seq[:-k], 0)
        if k < 3:
            lo |= before << WIDTH * k
        else:
            hi |= before << WIDTH * (k - 3)
    return hi, lo, np.concatenate([[0], ends])


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hi, lo, at = _grams(b.column("word"))
        n = np.repeat(b.column("n").to_numpy(), np.diff(at))
        order = np.lexsort((lo, hi))
        hi, lo, n = hi[order], lo[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])) if len(hi) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(hi[first]), pa.array(lo[first]), pa.array(total.astype(np.int64))], ["hi", "lo", "n"])


def discounts(of: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams with counts 1 to 4; defined for any counts."""
    n1, n2, n3, n4 = (of[i] or 0 for i in range(4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


def _suffix(k: int) -> tuple[Column, Column]:
    """(hi, lo) of the last k symbols."""
    hi, lo = F.col("hi"), F.col("lo")
    if k == 4:
        return hi.bitwiseAND(F.lit(MASK).cast("long")), lo
    return F.lit(0).cast("long"), lo.bitwiseAND(F.lit((1 << WIDTH * k) - 1).cast("long"))


def _context() -> tuple[Column, Column]:
    """(hi, lo) of all symbols but the last."""
    hi, lo = F.col("hi"), F.col("lo")
    carried = F.shiftleft(hi.bitwiseAND(F.lit(MASK).cast("long")), 2 * WIDTH)
    return F.shiftright(hi, WIDTH), F.shiftright(lo, WIDTH).bitwiseOR(carried)


def train(trusted: DataFrame, text_col: str = "text") -> DataFrame:
    """The model: (gram, k, hi, lo, value) rows. Empty trusted text gives an empty one; null texts count as empty, and
    repeated documents count as often as they occur.

    gram: what an n-gram of order k adds to the log probability of its last symbol, beyond backing off to its suffix.
    Otherwise: log of the weight of order k after a context of k symbols.
    """
    texts = trusted.select(text_of(text_col).alias("text"))
    words = written(texts.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "quality-words")
    counts = words.mapInArrow(_gram_counts, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))
    grams = written(counts.select(F.lit(ORDER).alias("k"), "hi", "lo", "n"), "quality-grams")
    top_order = grams
    for k in range(ORDER - 1, 0, -1):  # of lower orders: numbers of different symbols before, each longer n-gram once
        hi, lo = _suffix(k)
        shorter = top_order.groupBy(hi.alias("hi"), lo.alias("lo")).agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "hi", "lo", "n")
        top_order = written(shorter, "quality-grams")
        grams = grams.union(top_order)
    found = {r["k"]: r for r in grams.groupBy("k").agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in range(1, 5)]).collect()}
    of_order = {k: discounts([found[k][f"n{i}"] for i in range(1, 5)]) if k in found else (0.5, 1.0, 1.5) for k in range(1, ORDER + 1)}
    table = F.array(*[F.array(*[F.lit(float(x)) for x in of_order[k]]) for k in range(1, ORDER + 1)])
    cut = F.get(F.get(table, F.col("k") - 1), F.least("n", F.lit(3)).cast("int") - 1)
    hi, lo = _context()
    t = grams.withColumns({"context_hi": hi, "context_lo": lo, "cut": cut})
    contexts = t.groupBy("k", "context_hi", "context_lo").agg(F.sum("n").alias("total"), F.sum("cut").alias("held"))
    contexts = written(contexts.select(F.col("k").alias("ck"), F.col("context_hi").alias("chi"), F.col("context_lo").alias("clo"), "total", (F.col("held") / F.col("total")).alias("weight")), "quality-contexts")
    own = t.join(contexts, (F.col("k") == F.col("ck")) & (F.col("context_hi") == F.col("chi")) & (F.col("context_lo") == F.col("clo")))
    own = written(own.select("k", "hi", "lo", ((F.col("n") - F.col("cut")) / F.col("total")).alias("own"), "weight"), "quality-own")
    model = contexts.select(F.lit(False).alias("gram"), (F.col("ck") - 1).alias("k"), F.col("chi").alias("hi"), F.col("clo").alias("lo"), F.log("weight").cast("float").alias("value"))
    p = own.where("k = 1").select("hi", "lo", "own", (F.col("weight") / SYMBOLS).alias("rest"))
    for k in range(1, ORDER + 1):
        if k > 1:
            below = p.select(F.col("hi").alias("low_hi"), F.col("lo").alias("low_lo"), (F.col("own") + F.col("rest")).alias("below"))
            hi, lo = _suffix(k - 1)
            joined = own.where(F.col("k") == k).join(below, (hi == F.col("low_hi")) & (lo == F.col("low_lo")))
            p = joined.select("hi", "lo", "own", (F.col("weight") * F.col("below")).alias("rest"))
        p = written(p, f"quality-order{k}")
        model = model.union(p.select(F.lit(True), F.lit(k), "hi", "lo", F.log1p(F.col("own") / F.col("rest")).cast("float")))
    return written(model, "quality-model")


def _key(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """64 bits for an n-gram."""
    return mixed(mixed(hi) * np.uint64(0x9E3779B97F4A7C15) + mixed(lo ^ np.int64(0x5851F42D4C957F2D))).view(np.int64)


class Model:
    """The rows of one shard as arrays; n-grams and contexts of other shards add nothing here."""

    def __init__(self, rows: pa.Table, whole: bool = True):
        gram, k, hi, lo, value = (rows.column(c).to_numpy() for c in ("gram", "k", "hi", "lo", "value"))
        key = _key(hi, lo)
        pick = lambda which, n: np.flatnonzero((gram == which) & (k == n))
        self.tables = [[(HashIndex(key[i]), value[i]) for n in orders for i in [pick(which, n)]] for which, orders in ((True, range(1, ORDER + 1)), (False, range(ORDER)))]
        self.whole = whole

    def log_probabilities(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(log probability without that of order 0, number of symbols) of each word, as far as this shard goes."""
        hi, lo, at = _grams(words)
        _, first, of = np.unique(_key(hi, lo), return_index=True, return_inverse=True)  # each 5-gram is looked up once
        hi, lo = hi[first], lo[first]
        out = np.zeros(len(lo))
        before = (hi >> WIDTH, lo >> WIDTH | (hi & MASK) << 2 * WIDTH)
        for (h, x), tables, start in (((hi, lo), self.tables[0], 1), (before, self.tables[1], 0)):
            todo = np.arange(len(out))
            for k, (index, value) in enumerate(tables, start):
                own = _key(h[todo] & ((1 << WIDTH * max(k - 3, 0)) - 1), x[todo] & ((1 << WIDTH * min(k, 3)) - 1))
                found = index.find(own)
                hit = found >= 0
                out[todo[hit]] += value[found[hit]]
                if self.whole:  # a longer n-gram or context that the model has has all its suffixes there
                    todo = todo[hit]
        return by_text(out[of], at), np.diff(at)


_loaded: dict[str, Model] = {}


def shard_rows(path: str, shard: int, counts: list[int], schema: pa.Schema) -> pa.Table:
    """The rows of a shard; fewer or more than were written raise OSError."""
    rows = read_table(f"{path}/shard={shard}") if counts[shard] else schema.empty_table()
    if rows.num_rows != counts[shard]:
        raise OSError(f"{path}/shard={shard} has {rows.num_rows} rows instead of {counts[shard]}")
    return rows


def written_shards(rows: DataFrame, by: Column, name: str, most: int | None = None) -> tuple[str, list[int]]:
    """(folder, rows of each shard): shards of about SHARD_ROWS rows, numbered by a column, whatever partitions write them."""
    spark = rows.sparkSession
    ready(spark)
    shards = max(1, -(-rows.count() // (most or SHARD_ROWS)))
    path = new_folder(spark, name)
    dealt = rows.withColumn("shard", F.pmod(by, F.lit(shards)).cast("int"))
    dealt.repartition(shards, "shard").write.partitionBy("shard").parquet(path)
    # counted in what went in, so that a shard that lacks rows is told
    found = {r["shard"]: r["n"] for r in dealt.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    return path, [found.get(i, 0) for i in range(shards)]


MODEL = pa.schema([("gram", pa.bool_()), ("k", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("value", pa.float32())])


def model_shards(model: DataFrame) -> tuple[str, list[int]]:
    return written_shards(model, F.xxhash64("hi", "lo"), "quality-shards")


def _shard(path: str, shard: int, counts: list[int]) -> Model:
    """A shard from the shared folder; a worker keeps the last one."""
    name = f"{path}/shard={shard}"
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Model(shard_rows(path, shard, counts, MODEL), len(counts) == 1)
    return _loaded[name]


def _score(path: str, counts: list[int]):
    shards = len(counts)

    def scored(run: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = [_words(part.column("text")) for part in run]
        sums, n = [np.zeros(len(words)) for words, _, _ in cut], [None] * len(cut)
        for shard in range(shards):
            model = _shard(path, shard, counts)
            for i, (words, _, _) in enumerate(cut):
                log_p, n[i] = model.log_probabilities(words)
                sums[i] += log_p
        for part, (_, codes, offsets), log_p, k in zip(run, cut, sums, n):
            symbols = by_text(k[codes], offsets)
            columns = [part.column("id"), part.column("lang"), part.column("h"), pa.array(by_text(log_p[codes], offsets) - symbols * np.log(SYMBOLS)), pa.array(symbols)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang", "h", "log_p", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for part in slices(b):
                held.append(part)
                size += part.nbytes
                if shards == 1 or size >= RUN:
                    yield from scored(held)
                    held, size = [], 0
        if held:
            yield from scored(held)
        _loaded.clear()  # stages that follow have the memory
        trimmed()

    return run


def perplexities(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, h, n_symbols, perplexity) per input row; h is a hash of id and text. Perplexity is null without words.

    Texts are read once. Where the model has several shards, a task reads all of them for each RUN bytes of text.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    ready(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"), row_hash(id_col, text_col).alias("h"))
    path, counts = model_shards(model)
    scored = rows.mapInArrow(_score(path, counts), f"id {kind}, lang string, h long, log_p double, n long")
    value = F.when(F.col("n") > 0, F.exp(F.least(-F.col("log_p") / F.col("n"), F.lit(700.0))))
    return scored.select("id", "lang", "h", F.col("n").alias("n_symbols"), value.alias("perplexity"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that are labelled to be of good quality."""
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("trusted_id")).distinct()


def for_threshold(id_col: str = "id") -> Column:
    """Trusted documents that are not trained on: one in FOLDS, by a hash of the id."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(11)), F.lit(FOLDS)) == 0


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """(id, lang, h, n_symbols, perplexity, threshold, keep) per input row; trusted has the column trusted_id.

    The threshold of a language is the quantile of adjusted perplexity of its trusted documents that were not trained on,
    times LEEWAY; languages with fewer than LEAST_TRUSTED of these (null counts as one) use that of all. With no such
    document at all, those trained on stand in. `threshold` is for the document's own length. Texts without words have no
    perplexity and are kept, as are all without trusted text. Ids that repeat among trusted ones count once, rows that
    repeat are scored each. Columns of docs other than the three named are not looked at. An empty table gives no rows.
    """
    trusted = small(trusted.distinct())
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    good = texts.join(trusted, texts["id"] == trusted["trusted_id"], "left_semi").where(~for_threshold())
    scored = written(perplexities(docs, train(good), id_col, text_col, lang_col), "quality-scores")
    longer = F.exp(SPREAD / F.sqrt(F.greatest("n_symbols", F.lit(1)).cast("double")))
    known = scored.join(trusted, scored["id"] == trusted["trusted_id"], "left_semi").where("perplexity is not null").withColumn("adjusted", F.col("perplexity") / longer)
    at = lambda when: F.percentile_approx(F.when(when, F.col("adjusted")), quantile, 10_000)
    apart, every = known.agg(at(for_threshold()), at(F.lit(True))).first()
    if every is None:
        return scored.withColumns({"threshold": F.lit(None).cast("double"), "keep": F.lit(True)})
    named = F.coalesce("lang", F.lit(""))
    by_lang = known.where(for_threshold()).groupBy(named.alias("of")).agg(at(F.lit(True)).alias("t"), F.count("*").alias("c")).where(F.col("c") >= LEAST_TRUSTED).select("of", "t")
    limit = F.coalesce("t", F.lit(float(every if apart is None else apart))) * LEEWAY * longer
    out = scored.join(small(written(by_lang, "quality-thresholds")), named == F.col("of"), "left").withColumn("threshold", limit)
    return out.select("id", "lang", "h", "n_symbols", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("keep"))
