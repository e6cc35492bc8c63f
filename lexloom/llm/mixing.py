"""Mixing sources to target weights by iterative proportional fitting.

Token counts by (source, language, topic) are raked until their sums match the target shares of each source, language
and topic. Documents are drawn without repeats, so that no cell can give more tokens than it has: the tokens to draw are
raked again with that bound, for the largest budget up to KEEP at which all margins can be met. A cell's drawn tokens, over
its tokens, are the probability of its documents. They are drawn by systematic sampling inside strata of cell and size, so
that the tokens drawn stay near the expected ones. Every category is raked on its own, however many there are: a table
of up to LOCAL_CELLS cells in NumPy on the driver, a larger one by the same steps as a table in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import by_text, slices
from .common import checkpointed, only, ready, row_hash, small, text_of, written

AXES = ("source", "lang", "topic")
#: Cells that are raked on the driver at most (three codes and a few numbers each).
LOCAL_CELLS = 200_000
NONE = "(none)"
#: Default targets: shares in proportion to tokens to this power, but none that asks for more than all its tokens. Share of
#: all tokens to draw at most.
POWER, KEEP = 0.9, 0.8
#: Sweeps at most, without and with the bound; the error of a margin's share at which raking, and raking with the bound, ends; the next budget to
#: try over one whose margins can't be met.
SWEEPS, BOUND_SWEEPS, ERROR, DRAWN_ERROR, SHRINK = 1_000, 100, 1e-9, 1e-5, 0.95
#: Documents of a stratum that are ranked together, about.
SHARD_ROWS = 512
#: Shards of a stratum begin at even steps: the golden ratio's fractional part.
GOLDEN = (5**0.5 - 1) / 2


_CLASSES = np.zeros(256, np.uint8)
for _k, _letters in enumerate((b" \t\n\x0b\f\r", b"|", b"#$%&*@=<>{}[]^~\\", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"), 1):
    _CLASSES[list(_letters)] = _k
#: Default topics: the form of the whole text, since documents carry no subject. The first that fits counts.
TOPICS = ("empty", "table", "marked", "shouted", "numeric", "note", "prose", "long prose")


def describe(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(topic as a position in TOPICS, tokens) of each text: tokens are runs of non-space, and one for the end."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = _CLASSES[data]
    count = lambda flags: by_text(flags.astype(np.int32), offsets).astype(np.int64)
    word = kind != 1
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = word[first]
    n = count(data & 0xC0 != 0x80)
    share = [count(kind == k) / np.maximum(n, 1) for k in range(2, 6)]
    fits = [n == 0, share[0] > 0.01, share[1] > 0.04, share[2] > 0.3, share[3] > 0.05, n < 400, n < 8_000]
    return np.select(fits, range(7), 7), count(start) + 1


def described(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column | None) -> DataFrame:
    """(id, h, source, lang, topic, tokens) per input row, from one pass over the texts; null categories are NONE."""
    kind = docs.schema[id_col].dataType.simpleString()
    ready(docs.sparkSession)

    by_form = topic is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                form, tokens = describe(part.column("text"))
                own = pa.array(np.array(TOPICS)[form], pa.string()) if by_form else part.column("topic")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "h", "source", "lang")), own, pa.array(tokens)], ["id", "h", "source", "lang", "topic", "tokens"])

    named = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    given = F.lit("") if topic is None else named(topic)
    rows = docs.select(F.col(id_col).alias("id"), row_hash(id_col, text_col).alias("h"), named(F.col(source_col)).alias("source"), named(F.col(lang_col)).alias("lang"), given.alias("topic"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, h long, source string, lang string, topic string, tokens long")


def rake(tokens: np.ndarray, targets: list[np.ndarray]) -> np.ndarray:
    """rake_cells() of a three-way table."""
    codes = [x.reshape(-1) for x in np.indices(tokens.shape)]
    return rake_cells(tokens.reshape(-1), codes, targets).reshape(tokens.shape)


def rake_cells(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """Shares of the cells in proportion to tokens where the margins are the targets; codes: each cell's three categories.

    Target shares of categories without tokens go to the others. Cells without tokens stay empty. Where no table
    has all margins, the last sweep's is returned, whose topic margin is right.
    """
    out = tokens / max(tokens.sum(), 1e-300)
    wanted = []
    for code, t in zip(codes, targets):
        there = np.bincount(code, tokens, len(t)) > 0
        t = np.where(there, np.maximum(np.asarray(t, float), 0), 0)
        wanted.append(t / t.sum() if t.sum() > 0 else there / max(there.sum(), 1))
    for _ in range(SWEEPS):
        worst = 0.0
        for code, t in zip(codes, wanted):
            own = np.bincount(code, out, len(t))
            factor = np.divide(t, own, out=np.zeros_like(t), where=own > 0)
            worst = max(worst, float(np.max(np.abs(own - t), initial=0)))
            out = out * factor[code]
        if worst < ERROR:
            break
    return out


def tempered(own: np.ndarray, keep: float) -> np.ndarray:
    """Default target shares of categories with these tokens, where the share `keep` of all tokens is to be drawn."""
    raw, most, full = own**POWER, own / max(keep * own.sum(), 1e-300), np.zeros(len(own), bool)
    while True:  # those that would have more than all they have get that, and the others more; there are ever more of them
        scale = max(1 - most[full].sum(), 0) / max(raw[~full].sum(), 1e-300)
        now = full | (raw * scale >= most)
        if (now == full).all():
            return np.where(full, most, raw * scale)
        full = now


def first_budget(most: float, tokens: np.ndarray, shares: np.ndarray) -> float:
    """The budget up to `most` at which no category has to give more than all its tokens; both are sums by category."""
    some = shares > 0
    return float(min(most, (tokens[some] / shares[some]).min(initial=most)))


def drawn_tokens(tokens: np.ndarray, codes: list[np.ndarray], shares: np.ndarray, most: float) -> np.ndarray:
    """Tokens to draw of each cell, at most all of them, whose margins are in proportion to those of `shares`.

    Their sum is `most`, or the largest budget tried at which the margins can be met; the last one tried is that at which
    `shares` themselves fit. Cells are raked as before, but one that would give more than it has gives all, and the other
    cells of its categories give what is missing.
    """
    size = [int(c.max(initial=-1)) + 1 for c in codes]
    margins = [np.bincount(c, shares, n) for c, n in zip(codes, size)]
    held = [np.bincount(c, tokens, n) for c, n in zip(codes, size)]
    budget = min([most, *(first_budget(most, t, m) for t, m in zip(held, margins))])
    some = shares > 0
    sure = float((tokens[some] / shares[some]).min(initial=most))
    while budget > sure:
        z = shares * budget
        for _ in range(BOUND_SWEEPS):
            worst = 0.0
            for code, m in zip(codes, margins):
                full = z >= tokens
                got = np.bincount(code, np.minimum(z, tokens), len(m))
                capped, free = np.bincount(code[full], tokens[full], len(m)), np.bincount(code[~full], z[~full], len(m))
                worst = max(worst, float(np.max(np.abs(got / budget - m), initial=0)))
                z = z * _factor(m * budget, got, capped, free)[code]
            if worst < DRAWN_ERROR:
                return np.minimum(z, tokens)
        budget *= SHRINK
    return np.minimum(shares * min(budget, sure), tokens)


def _factor(want: np.ndarray, got: np.ndarray, capped: np.ndarray, free: np.ndarray) -> np.ndarray:
    """What the cells of a category are multiplied by, if those that give all they have go on to do so."""
    step = np.divide(want - capped, free, out=np.ones_like(want), where=free > 0)
    plain = np.divide(want, got, out=np.zeros_like(want), where=got > 0)
    return np.where((free > 0) & (want > capped), step, np.where(free > 0, plain, np.minimum(plain, 1.0)))


def _local(cells: DataFrame, targets: dict[str, dict[str, float]], keep: float) -> DataFrame:
    """(source, lang, topic, weight, probability) of at most LOCAL_CELLS cells (source, lang, topic, n)."""
    got = cells.toArrow()
    n = got.column("n").to_numpy().astype(float)
    codes, wanted = [], []
    for k in AXES:
        coded = got.column(k).combine_chunks().dictionary_encode()
        codes.append(coded.indices.to_numpy(zero_copy_only=False))
        names = coded.dictionary.to_pylist()
        own = np.bincount(codes[-1], n, len(names))
        wanted.append(np.array([targets[k].get(v, 0.0) for v in names]) if k in targets else tempered(own, keep))
    shares = rake_cells(n, codes, wanted)
    drawn = drawn_tokens(n, codes, shares, keep * n.sum())
    out = pa.table({**{k: got.column(k) for k in AXES}, "weight": pa.array(shares / (n / max(n.sum(), 1.0))), "probability": pa.array(drawn / np.maximum(n, 1))})
    return cells.sparkSession.createDataFrame(out)


def _raked(cells: DataFrame, total: float, targets: dict[str, dict[str, float]], keep: float) -> DataFrame:
    """cells with the column share: rake_cells() as joins of grouped sums; nothing but errors comes to the driver."""
    spark, n = cells.sparkSession, F.col("n").cast("double")
    wanted = {}
    for k in AXES:
        own = cells.groupBy(k).agg(F.sum(n).alias("own"))
        if k not in targets:  # tempered() by grouped sums
            own, most, scale, full = checkpointed(own), F.col("own") / max(keep * total, 1e-300), 0.0, -1
            raw = F.pow("own", F.lit(POWER))
            while True:
                over = F.lit(full >= 0) & (raw * scale >= most)
                held, free, now = own.agg(F.sum(F.when(over, most).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(raw)), F.count(F.when(over, 1))).first()
                if now == full:
                    break
                scale, full = max(1 - (held or 0.0), 0) / max(free or 0.0, 1e-300), now
            t = F.least(raw * scale, most)
        else:
            named = spark.createDataFrame([(v, max(float(w), 0.0)) for v, w in targets[k].items()], f"{k} string, named double")
            own, t = own.join(F.broadcast(named), k, "left"), F.coalesce("named", F.lit(0.0))
        own = written(own.select(k, t.alias("t")), "mixing-targets")
        every, many = own.agg(F.sum("t"), F.count("*")).first()
        wanted[k] = (own.select(k, (F.col("t") / every if every > 0 else F.lit(1.0 / many)).alias("t")), many)
    out = checkpointed(cells.withColumn("share", n / total))
    for _ in range(SWEEPS):
        worst = 0.0
        for k, (t, many) in wanted.items():
            own = checkpointed(out.groupBy(k).agg(F.sum("share").alias("own")).join(small(t, many), k))
            worst = max(worst, own.agg(F.max(F.abs(F.col("own") - F.col("t")))).first()[0])
            factor = own.select(k, F.when(F.col("own") > 0, F.col("t") / F.col("own")).otherwise(0.0).alias("factor"))
            out = out.join(small(factor, many), k).withColumn("share", F.col("share") * F.col("factor")).drop("factor")
        out = checkpointed(out)
        if worst < ERROR:
            break
    return out


def _spread(cells: DataFrame, total: float, targets: dict[str, dict[str, float]], keep: float) -> DataFrame:
    """_local() for any number of cells: drawn_tokens() as joins of grouped sums."""
    n, z = F.col("n").cast("double"), F.col("z")
    shares = _raked(cells, total, targets, keep)
    margins, budget = {}, keep * total
    for k in AXES:
        margins[k] = written(shares.groupBy(k).agg(F.sum("share").alias("m"), F.sum(n).alias("held")), "mixing-margins")
        most, many = margins[k].agg(F.min(F.when(F.col("m") > 0, F.col("held") / F.col("m"))), F.count("*")).first()
        margins[k], budget = (margins[k].select(k, "m"), many), min(budget, most if most is not None else budget)
    sure = shares.agg(F.min(F.when(F.col("share") > 0, n / F.col("share")))).first()[0]
    sure = budget if sure is None else sure
    drawn = None
    while budget > sure and drawn is None:
        out = checkpointed(shares.withColumn("z", F.col("share") * budget))
        for _ in range(BOUND_SWEEPS):
            worst = 0.0
            for k, (m, many) in margins.items():
                full = z >= n
                own = out.groupBy(k).agg(F.sum(F.least(z, n)).alias("got"), F.sum(F.when(full, n).otherwise(0.0)).alias("capped"), F.sum(F.when(full, 0.0).otherwise(z)).alias("free"))
                own = checkpointed(own.join(small(m, many), k).withColumn("want", F.col("m") * budget))
                worst = max(worst, own.agg(F.max(F.abs(F.col("got") / budget - F.col("m")))).first()[0] or 0.0)
                plain = F.when(F.col("got") > 0, F.col("want") / F.col("got")).otherwise(0.0)
                factor = F.when((F.col("free") > 0) & (F.col("want") > F.col("capped")), (F.col("want") - F.col("capped")) / F.col("free")).when(F.col("free") > 0, plain).otherwise(F.least(plain, F.lit(1.0)))
                out = out.join(small(own.select(k, factor.alias("factor")), many), k).withColumn("z", z * F.col("factor")).drop("factor")
            out = checkpointed(out)
            if worst < DRAWN_ERROR:
                drawn = out
                break
        budget *= SHRINK if drawn is None else 1
    drawn = shares.withColumn("z", F.col("share") * min(budget, sure)) if drawn is None else drawn
    return drawn.select(*AXES, (F.col("share") / (n / total)).alias("weight"), F.least(F.lit(1.0), z / n).alias("probability"))


def planned(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, seed: int = 42) -> DataFrame:
    """(id, h, source, lang, topic, tokens, weight, probability, selected) per input row; h is a hash of id and text.

    targets: for source, lang and topic, category -> weight; a category that isn't named there has weight 0 (``(none)``
    stands for null). Without targets for one of them, its weights are its tokens to the power POWER, but none so high
    that the budget would take more than all its tokens. weight is the raked
    share over the share of tokens; probability is what the documents of the cell are drawn with. Inside a stratum (cell and
    power of two of tokens) documents are taken at even steps in the order of a hash, so that about as many are selected as
    expected. Rows with the same id and text go together; null and empty texts count one token. Without a topic column the
    topic is the form of the text. An empty table gives no rows.
    """
    rows = written(described(docs, id_col, text_col, source_col, lang_col, topic), "mixing-rows").withColumn("size", F.floor(F.log2(F.col("tokens").cast("double"))).cast("int"))
    strata = written(rows.groupBy(*AXES, "size").agg(F.sum("tokens").alias("n"), F.count("*").alias("c")), "mixing-cells")
    cells = strata.groupBy(*AXES).agg(F.sum("n").alias("n"))
    count, total = cells.agg(F.count("*"), F.sum("n")).first()
    known = _local(cells, targets or {}, keep) if count <= LOCAL_CELLS else written(_spread(cells, float(total), targets or {}, keep), "mixing-raked")
    known = strata.join(small(known, count), list(AXES))
    # each stratum goes on where the one before it stopped, over the strata of a size: rows of the table of cells, not of documents
    before = F.sum(F.col("probability") * F.col("c")).over(Window.partitionBy("size").orderBy(*reversed(AXES)).rowsBetween(Window.unboundedPreceding, -1))
    offset = F.pmod(F.xxhash64("size", F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)
    known = written(known.select(*AXES, "size", "weight", "probability", F.ceil(F.col("c") / SHARD_ROWS).alias("shards"), (F.coalesce(before, F.lit(0.0)) + offset).alias("start")), "mixing-strata")
    order = F.xxhash64("h", F.lit(seed))
    dealt = rows.join(small(known), [*AXES, "size"]).withColumns({"order": order, "shard": F.pmod(F.xxhash64("h", F.lit(seed + 1)), F.col("shards"))})
    rank = F.dense_rank().over(Window.partitionBy(*AXES, "size", "shard").orderBy("order", "h"))
    p, start = F.col("probability"), F.col("start") + F.col("shard") * GOLDEN
    start = start - F.floor(start)
    chosen = (p >= 1) | (F.floor(start + p * F.col("rank")) > F.floor(start + p * (F.col("rank") - 1)))
    return dealt.withColumn("rank", rank).select("id", "h", *AXES, "tokens", "weight", "probability", chosen.alias("selected"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, seed: int = 42) -> DataFrame:
    """The rows of docs that are drawn, as planned() says, with all their columns whatever their names."""
    plan = planned(docs, targets, keep, id_col, text_col, source_col, lang_col, topic, seed)
    return only(docs, plan.where("selected").select("id", "h"), id_col, text_col, once=False)
