"""Language-model scoring: a hierarchical Pitman-Yor model of words whose seating is sampled by Gibbs.

Each word is a context with a restaurant of its own; its customers are the training tokens that follow it. All of these share
one parent, the restaurant of words without context, whose customers are their tables, and which orders from the uniform
distribution over the words of the training text and one more that stands for all others. A text starts after the end of
another. So the probabilities after each word sum to one, over the same events that the base score counts.

A sweep draws, for each restaurant and dish, at how many tables its customers sit, given the probability of the dish in the
parent and the tables of the restaurant's other dishes: exactly, from the generalised Stirling numbers, up to EXACT customers.
Of more, each table in front of those that come after the first EXACT weighs (EXACT / customers) ** discount, and their new tables
are a Poisson number, which is the limit of the exact distribution. All pairs are drawn at once from what the sweep before left, and draws come from hashes
of pair and sweep, so that they don't depend on how rows are dealt and a lost task draws the same. After BURN_IN sweeps, the
predictive probabilities of SAMPLES of them are averaged, and texts are scored with the averages.

Everything that grows lies in the shared folder and is read in pieces of bounded size:

* the dictionary, by hash of the word (to number words) and by range of numbers (counts and tables of each word);
* slices: the words of some documents as numbers;
* buckets: the pairs of all slices, dealt by context, those of the HOT most frequent contexts by pair. A pair is in a bucket
  once for each slice that has it, however often it occurs. A bucket holds the seating of its pairs.

A sweep reads each bucket and sends sums of tables to the ranges of numbers. In the end buckets answer slices with one number
for each of their pairs, which most of the time is the same, and slices sum their documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .arrays import by_text, mixed, slices, tokens
from .common import dropped, new_folder, ready, text_of, written
from .files import located
from .quality import shard_rows, written_shards

#: Sweeps before and for the averages.
BURN_IN, SAMPLES = 2, 3
#: Strength of all restaurants. Discounts come from how many counts are one and two.
STRENGTH = 1.0
#: Customers of a dish up to which tables are drawn from their exact distribution.
EXACT = 64
#: One in so many documents is held out, by a hash of the id.
FOLDS, APART = 7, 2
#: Text bytes of a slice, tokens for which there is a bucket, words of a shard and of a range, about; contexts that are split.
SLICE, BUCKET, WORD_ROWS, RANGE, HOT = 12 << 20, 2_500_000, 4_000_000, 1_000_000, 4096
WORDS = pa.schema([("key", pa.int64()), ("number", pa.int64()), ("n", pa.int64())])


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are not learnt from; a null id is none of them."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS)) == APART, F.lit(False))


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of lower-cased texts, as arrays.tokens() gives them; ends of texts are not among them."""
    return tokens(pc.ascii_lower(pc.fill_null(texts, "")))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The end of a text is the empty word."""
    for b in batches:
        for part in slices(b):
            words, codes, _ = _tokens(part.column("text"))
            n = np.bincount(codes, minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([""])]), pa.array([*n.tolist(), part.num_rows], pa.int64())], ["word", "n"])


def keys(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words."""
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)


def _uniform(key: np.ndarray, *salt: int) -> np.ndarray:
    """A number in (0, 1) for each key."""
    x = key.astype(np.int64).view(np.uint64)
    for s in salt:
        x = mixed(x + np.uint64((s + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    x = mixed(mixed(x) * np.uint64(0xC4CEB9FE1A85EC53))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def stirling(discount: float, most: int) -> np.ndarray:
    """Logarithms of the sums, over seatings of n customers at t tables, of what seats them: [n, t]."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for n in range(most):
        t = np.arange(1, n + 2)
        with np.errstate(divide="ignore"):
            stay = np.log(np.maximum(n - discount * t, 0)) + out[n, t]
        out[n + 1, t] = np.logaddexp(out[n, t - 1], stay)
    return out


def _poisson(mean: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    u = _uniform(key, salt, 1)
    out = np.zeros(len(mean), np.int64)
    few = mean < 40
    p = np.exp(-np.where(few, mean, 0))
    left, k = u - p, 0
    todo = few & (left > 0)
    while todo.any() and k < 400:
        k += 1
        p = p * mean / k
        out[todo] = k
        left = left - p
        todo &= left > 0
    many = ~few
    normal = np.sqrt(-2 * np.log(u[many])) * np.cos(2 * np.pi * _uniform(key[many], salt, 2))
    out[many] = np.maximum(np.rint(mean[many] + np.sqrt(mean[many]) * normal), 0)
    return out


def seat(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, key: np.ndarray, sweep: int, strength: float = STRENGTH) -> np.ndarray:
    """Tables of each dish: drawn from their distribution given the parent's probability of the dish and the number of tables
    of the other dishes of its restaurant."""
    out = np.ones(len(customers), np.int64)
    table = stirling(discount, EXACT)
    fade = np.where(customers > EXACT, (EXACT / np.maximum(customers, 1)) ** discount, 1.0)
    later = parent * (1 - fade)  # that a table makes later ones likelier is in its weight too
    log_p, u = np.log(parent * fade / (1 - later)), _uniform(key, sweep, 0)
    exact = np.minimum(customers, EXACT)
    for c in np.unique(exact[exact > 1]):
        at = np.flatnonzero(exact == c)
        for some in np.array_split(at, -(-len(at) * int(c) // 4_000_000)):
            opened = np.log(strength + discount * (others[some][:, None] + np.arange(c)))
            score = table[c, 1 : c + 1] + np.cumsum(opened, axis=1) + log_p[some][:, None] * np.arange(1, c + 1)
            share = np.cumsum(np.exp(score - score.max(axis=1, keepdims=True)), axis=1)
            out[some] = 1 + (share < u[some][:, None] * share[:, -1:]).sum(axis=1)
    more = np.flatnonzero(customers > EXACT)
    mean = (strength / discount + others[more] + out[more]) * later[more] / (1 - later[more])
    out[more] += np.minimum(_poisson(mean, key[more], 1000 * sweep), customers[more] - EXACT)
    return out


def _discount(ones: int | None, twos: int | None) -> float:
    return min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones else 0.5


def pack(values: np.ndarray) -> bytes:
    """An array as compressed planes of bytes."""
    raw = np.ascontiguousarray(values)
    planes = np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T)
    return len(raw).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=0))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.int64))


def _piece(path: str, columns: list[str]) -> list[dict]:
    """Rows of a folder in the shared folder."""
    system, inside = located(path)
    return pq.read_table(inside, filesystem=system, partitioning=None, columns=columns).to_pylist()


def _dealt(df: DataFrame, by: str, name: str) -> str:
    """The folder of df, with a folder for each value of `by` inside."""
    path = new_folder(df.sparkSession, name)
    df.repartition(by).write.partitionBy(by).parquet(path)
    return path


def _distinct(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order, with the sums of their weights."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.add.reduceat(weights, first) if len(first) else weights


@dataclass
class Sizes:
    """Numbers that tasks need: words of a range and contexts that are split; training tokens, different words, number of the end of a text, buckets, ranges; then, of a sweep, the
    customers and tables of all words without context; discounts; samples in the sums of averages."""

    range: int
    hot: int
    tokens: int
    words: int
    end: int = 0
    buckets: int = 1
    customers: int = 0
    tables: int = 0
    d_pairs: float = 0.5
    d_words: float = 0.5
    samples: int = 0
    end_count: int = 0
    unknown_sum: float = 0.0

    def predicted(self, customers, tables):
        """Probability of words without context."""
        rest = (STRENGTH + self.d_words * self.tables) / (self.words + 1)
        return (customers - self.d_words * tables + rest) / (STRENGTH + self.customers)


def _look(path: str, sizes: Sizes, numbers: np.ndarray, names: list[str]) -> list[np.ndarray]:
    """What the ranges have of sorted numbers."""
    out = [np.zeros(len(numbers), np.float64 if x.endswith("_sum") else np.int64) for x in names]
    cuts = np.flatnonzero(np.diff(numbers // sizes.range)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(numbers)]):
        if hi > lo:
            r = int(numbers[lo]) // sizes.range
            (row,) = _piece(f"{path}/range={r}", names)
            for o, x in zip(out, names):
                o[lo:hi] = unpack(row[x], o.dtype)[numbers[lo:hi] - r * sizes.range]
    return out


def _buckets_of(pairs: np.ndarray, sizes: Sizes) -> np.ndarray:
    context = pairs >> 32
    return (mixed(np.where(context < sizes.hot, pairs, context)) % np.uint64(sizes.buckets)).astype(np.int64)


def _pairs(numbers: np.ndarray, before: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """(which tokens have a known word after a known one, their pairs)"""
    at = np.flatnonzero((numbers < sizes.words) & (before < sizes.words))
    return at, before[at].astype(np.int64) << 32 | numbers[at]


def _by_bucket(pairs: np.ndarray, weights: np.ndarray, sizes: Sizes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Different pairs in order and their weights, by bucket."""
    pairs, weights = _distinct(pairs, weights)
    bucket = _buckets_of(pairs, sizes)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(sizes.buckets + 1))
    for b in range(sizes.buckets):
        some = order[cuts[b] : cuts[b + 1]]
        if len(some):
            yield b, pairs[some], weights[some]


def _number(path: str, counts: list[int], sizes: Sizes, kind: pa.DataType):
    """Documents to slices, and what needs no model: numbers of tokens and base scores."""

    def sliced(run: list[pa.RecordBatch], name: int) -> pa.RecordBatch:
        cut = [_tokens(part.column("text")) for part in run]
        listed = [keys(w) for w, _, _ in cut]
        asked, place = np.unique(np.concatenate(listed), return_inverse=True)
        number, n = np.full(len(asked), sizes.words, np.int64), np.zeros(len(asked), np.int64)
        for shard in range(len(counts)):
            rows = shard_rows(path, shard, counts, WORDS)
            key = rows.column("key").to_numpy()
            order = np.argsort(key)
            key = key[order]
            at = np.minimum(np.searchsorted(key, asked), max(len(key) - 1, 0))
            found = np.flatnonzero(key[at] == asked) if len(key) else np.zeros(0, np.int64)
            number[found], n[found] = (rows.column(c).to_numpy()[order[at[found]]] for c in ("number", "n"))
        ends = np.cumsum([len(x) for x in listed])
        base = np.log10((n + 1) / (sizes.tokens + sizes.words + 1))
        texts, lengths, known, scores = [], [], [], []
        end_base = np.log10((sizes.end_count + 1) / (sizes.tokens + sizes.words + 1))
        for (_, codes, offsets), of in zip(cut, np.split(place, ends[:-1])):
            own = of[codes]
            long = np.diff(offsets)
            texts.append(np.insert(number[own], offsets[1:], sizes.end))
            lengths.append(long + 1)
            known.append(by_text((n[own] > 0).astype(np.int64), offsets) + 1)
            scores.append(by_text(base[own], offsets) + end_base)
        ids = pa.chunked_array([part.column("id") for part in run], kind).combine_chunks()
        apart = np.concatenate([part.column("held_out").to_numpy(zero_copy_only=False) for part in run])
        whole = [pack(np.concatenate(x)) for x in (texts, lengths, known, scores, [apart.astype(np.int64)])]
        ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([pa.array([name]), ids, *(pa.array([x], pa.binary()) for x in whole)], ["slice", "ids", "numbers", "lengths", "known", "base", "apart"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made = [], 0, TaskContext.get().partitionId() << 24
        for b in batches:
            for part in slices(b):
                held.append(part)
                size += part.nbytes
                if size >= SLICE:
                    yield sliced(held, made)
                    held, size, made = [], 0, made + 1
        if held:
            yield sliced(held, made)

    return run


def _before(numbers: np.ndarray, sizes: Sizes) -> np.ndarray:
    """The word before each: a text follows the end of another."""
    return np.concatenate([[sizes.end], numbers[:-1]])


def _ask(sizes: Sizes):
    """The pairs of slices, with how often they occur in texts that are learnt from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, numbers, lengths, apart in zip(*(b.column(c).to_pylist() for c in ("slice", "numbers", "lengths", "apart"))):
                numbers, lengths = unpack(numbers, np.int64), unpack(lengths, np.int64)
                learnt = np.repeat(1 - unpack(apart, np.int64), lengths)
                at, pairs = _pairs(numbers, _before(numbers, sizes), sizes)
                for bucket, some, n in _by_bucket(pairs, learnt[at], sizes):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([name]), pa.array([pack_sorted(some)], pa.binary()), pa.array([pack(n)], pa.binary())], ["bucket", "slice", "pairs", "n"])

    return run


def _sums(numbers: np.ndarray, tables: np.ndarray, what: str, size: int) -> list[dict]:
    numbers, tables = _distinct(numbers, tables)
    cuts = np.flatnonzero(np.diff(numbers // size)) + 1
    return [{"range": int(numbers[lo]) // size, "what": what, "numbers": pack_sorted(numbers[lo:hi]), "tables": pack(tables[lo:hi])} for lo, hi in zip([0, *cuts], [*cuts, len(numbers)]) if hi > lo]


SUMS = pa.list_(pa.struct([("range", pa.int32()), ("what", pa.string()), ("numbers", pa.binary()), ("tables", pa.binary())]))
COUNTED = "bucket int, pairs binary, n binary, ones long, twos long, sums array<struct<range: int, what: string, numbers: binary, tables: binary>>"
SEATED = "bucket int, t binary, t_sum binary, sums array<struct<range: int, what: string, numbers: binary, tables: binary>>"


def _bucket_sums(sizes: Sizes, pairs: np.ndarray, t: np.ndarray) -> pa.Array:
    return pa.array([_sums(pairs & 0xFFFFFFFF, t, "word", sizes.range) + _sums(pairs >> 32, t, "context", sizes.range)], SUMS)


def _count(asked: str, sizes: Sizes):
    """Pairs of a bucket with a table each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket in b.column("bucket").to_pylist():
                rows = _piece(f"{asked}/bucket={bucket}", ["pairs", "n"])
                pairs, n = _distinct(np.concatenate([unpack_sorted(r["pairs"]) for r in rows]), np.concatenate([unpack(r["n"], np.int64) for r in rows]))
                pairs, n = pairs[n > 0], n[n > 0]
                row = [pa.array([bucket], pa.int32()), pa.array([pack_sorted(pairs)], pa.binary()), pa.array([pack(n)], pa.binary()), *(pa.array([int((n == i).sum())]) for i in (1, 2))]
                yield pa.RecordBatch.from_arrays([*row, _bucket_sums(sizes, pairs, np.ones(len(n), np.int64))], ["bucket", "pairs", "n", "ones", "twos", "sums"])

    return run


def _sit(counted: str, seated: str | None, ranges: str, sizes: Sizes, sweep: int):
    """A sweep over the pairs of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket in b.column("bucket").to_pylist():
                (row,) = _piece(f"{counted}/bucket={bucket}", ["pairs", "n"])
                pairs, n = unpack_sorted(row["pairs"]), unpack(row["n"], np.int64)
                t, t_sum = np.ones(len(n), np.int64), np.zeros(len(n), np.int64)
                if seated is not None:
                    (row,) = _piece(f"{seated}/bucket={bucket}", ["t", "t_sum"])
                    t, t_sum = unpack(row["t"], np.int64), unpack(row["t_sum"], np.int64)
                words, of_word = np.unique(pairs & 0xFFFFFFFF, return_inverse=True)
                contexts, of_context = np.unique(pairs >> 32, return_inverse=True)
                p = sizes.predicted(*_look(ranges, sizes, words, ["customers", "tables"]))
                (in_context,) = _look(ranges, sizes, contexts, ["opened"])
                t = seat(n, in_context[of_context] - t, p[of_word], sizes.d_pairs, pairs, 2 * sweep)
                row = [pa.array([pack(x)], pa.binary()) for x in (t, t_sum + t if sizes.samples else t_sum)]
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *row, _bucket_sums(sizes, pairs, t)], ["bucket", "t", "t_sum", "sums"])

    return run


RANGES = "range int, n binary, customers binary, tables binary, opened binary, p_sum binary, opened_sum binary"


def _total(sizes: Sizes, before: str | None, sweep: int):
    """Customers and tables of the words of a range, and tables in the restaurants that they are the contexts of."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        r = int(key[0])
        long = min(sizes.range, sizes.words - r * sizes.range)
        sums = {"word": np.zeros(long, np.int64), "context": np.zeros(long, np.int64)}
        for what, numbers, tables in zip(group["what"], group["numbers"], group["tables"]):
            sums[what][unpack_sorted(numbers) - r * sizes.range] += unpack(tables, np.int64)
        customers, opened = sums["word"], sums["context"]
        p_sum, opened_sum = np.zeros(long), np.zeros(long)
        if before is None:
            tables = np.ones(long, np.int64)
        else:
            (row,) = _piece(f"{before}/range={r}", ["customers", "tables", "p_sum", "opened_sum"])
            old = unpack(row["tables"], np.int64)
            p_sum, opened_sum = unpack(row["p_sum"], np.float64), unpack(row["opened_sum"], np.float64)
            if sizes.samples > 1:  # the sample before this one
                p_sum = p_sum + sizes.predicted(unpack(row["customers"], np.int64), old)
            if sizes.samples:
                opened_sum = opened_sum + opened
            one = np.full(long, 1 / (sizes.words + 1))
            tables = seat(customers, sizes.tables - old, one, sizes.d_words, np.arange(long) + r * sizes.range, 2 * sweep + 1)
        row = [r, b"", *(pack(x) for x in (customers, tables, opened, p_sum, opened_sum))]
        return pd.DataFrame([row], columns=["range", "n", "customers", "tables", "opened", "p_sum", "opened_sum"])

    return run


def _answer(asked: str, counted: str, seated: str, sizes: Sizes):
    """What slices asked for: a pair's customers less the discounts of its tables, on average; zero for pairs without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket in b.column("bucket").to_pylist():
                (row,) = _piece(f"{counted}/bucket={bucket}", ["pairs", "n"])
                pairs, n = unpack_sorted(row["pairs"]), unpack(row["n"], np.int64)
                (row,) = _piece(f"{seated}/bucket={bucket}", ["t_sum"])
                t_sum = unpack(row["t_sum"], np.int64)
                value = (n - sizes.d_pairs * t_sum / sizes.samples).astype(np.float32)
                for r in _piece(f"{asked}/bucket={bucket}", ["slice", "pairs"]):
                    some = unpack_sorted(r["pairs"])
                    at = np.minimum(np.searchsorted(pairs, some), max(len(pairs) - 1, 0))
                    out = np.where(pairs[at] == some, value[at], np.float32(0)) if len(pairs) else np.zeros(len(some), np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([r["slice"]]), pa.array([bucket], pa.int32()), pa.array([pack(out)], pa.binary())], ["slice", "bucket", "values"])

    return run


def _sum(answers: str, ranges: str, sizes: Sizes, kind: pa.DataType):
    """Documents of slices."""

    def scores(name: int, numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        before = _before(numbers, sizes)
        listed, place = np.unique(numbers, return_inverse=True)
        known = listed[listed < sizes.words]
        customers, tables, p_sum, n, opened = _look(ranges, sizes, known, ["customers", "tables", "p_sum", "n", "opened_sum"])
        p, rest = np.full(len(listed), sizes.unknown_sum / sizes.samples), np.ones(len(listed))
        p[: len(known)] = (p_sum + sizes.predicted(customers, tables)) / sizes.samples
        rest[: len(known)] = (STRENGTH + sizes.d_pairs * opened / sizes.samples) / (STRENGTH + n)
        customers_of = np.zeros(len(listed))
        customers_of[: len(known)] = n
        at, pairs = _pairs(numbers, before, sizes)
        answered = {r["bucket"]: unpack(r["values"], np.float32) for r in _piece(f"{answers}/slice={name}", ["bucket", "values"])} if len(at) else {}
        all_pairs, all_values = [], []
        for bucket, some, _ in _by_bucket(pairs, np.ones(len(pairs), np.int64), sizes):
            if len(answered.get(bucket, ())) != len(some):
                raise OSError(f"slice {name}: bucket {bucket} answers {len(answered.get(bucket, ()))} of {len(some)} pairs")
            all_pairs.append(some)
            all_values.append(answered[bucket])
        before_place = np.concatenate([[np.searchsorted(listed, sizes.end)], place[:-1]])
        own = np.zeros(len(numbers))
        if len(at):
            some, values = np.concatenate(all_pairs), np.concatenate(all_values)
            order = np.argsort(some)
            own[at] = values[order[np.searchsorted(some[order], pairs)]]
        own /= STRENGTH + customers_of[before_place]
        return by_text(np.log10(own + rest[before_place] * p[place]), np.concatenate([[0], np.cumsum(lengths)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, name in enumerate(b.column("slice").to_pylist()):
                numbers, lengths, known, base, apart = (unpack(b.column(c)[i].as_py(), k) for c, k in (("numbers", np.int64), ("lengths", np.int64), ("known", np.int64), ("base", np.float64), ("apart", np.int64)))
                score = scores(name, numbers, lengths)
                ids = b.column("ids").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(apart == 1), pa.array(lengths), pa.array(known), pa.array(base), pa.array(score)], ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def _dictionary(docs: DataFrame) -> tuple[DataFrame, Sizes] | None:
    """(word, number, n) of the training text, the most frequent first; None without tokens."""
    counted = docs.select(text_of("text").alias("text")).mapInArrow(_word_counts, "word string, n long").where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("word")]
    place = F.monotonically_increasing_id()
    # the partition and the row inside it make up this id
    rows = counted.repartitionByRange(*order).sortWithinPartitions(*order).select("word", "n", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    rows = written(rows, "pitman-words")
    sizes = rows.groupBy("part").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).orderBy("part").collect()
    if not sizes:
        return None
    starts = np.concatenate([[0], np.cumsum([r["rows"] for r in sizes])]).tolist()
    starts = docs.sparkSession.createDataFrame([(r["part"], s) for r, s in zip(sizes, starts)], "in_part long, start long")
    numbered = rows.join(F.broadcast(starts), F.col("part") == F.col("in_part")).select("word", (F.col("start") + F.col("row")).alias("number"), "n")
    known = Sizes(RANGE, HOT, sum(r["n"] for r in sizes), sum(r["rows"] for r in sizes))
    end = numbered.where("word = ''").first()
    known.end, known.end_count = end["number"], end["n"]
    return numbered, known


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(keys(b.column("word"))), b.column("number"), b.column("n")], ["key", "number", "n"])


def _with_counts(ranges: DataFrame, words: DataFrame, sizes: Sizes) -> DataFrame:
    """ranges with n of their words."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _sums(b.column("number").to_numpy(), b.column("n").to_numpy(), "n", sizes.range)
            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(SUMS.value_type)))

    sums = words.mapInArrow(counts, "range int, what string, numbers binary, tables binary")

    def total(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        r = int(key[0])
        n = np.zeros(min(sizes.range, sizes.words - r * sizes.range), np.int64)
        for numbers, counts in zip(group["numbers"], group["tables"]):
            n[unpack_sorted(numbers) - r * sizes.range] += unpack(counts, np.int64)
        return pd.DataFrame([[r, pack(n)]], columns=["of", "counts"])

    counted = sums.groupBy("range").applyInPandas(total, "of int, counts binary")
    return ranges.drop("n").join(counted, F.col("range") == F.col("of")).withColumnRenamed("counts", "n").drop("of")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) per input row, by a model of the documents
    that are not held out.

    Scores are base-10 logarithms of the probability of all words of a text and its end; perplexity is by token, of averaged
    predictive probabilities. Null texts count as empty, which have their end only; repeated rows are scored each; very long
    texts are slices by themselves, whole. Columns other than the two named are not looked at. Without training rows, base scores are
    zero and scores null. An empty table gives no rows.
    """
    spark, field = docs.sparkSession, docs.schema[id_col]
    ready(spark)
    kind = field.dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
    found = _dictionary(rows.where("not held_out"))
    if found is None:
        n = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")) + 1
        zero, none = F.lit(0).cast("long"), F.lit(None).cast("double")
        return rows.select("id", "held_out", n.cast("long").alias("n_tokens"), zero.alias("n_known"), zero.alias("train_tokens"), F.lit(0.0).alias("base_score"), none.alias("score"), none.alias("perplexity"))
    words, sizes = found
    sizes.buckets = -(-sizes.tokens // BUCKET)
    path, counts = written_shards(written(words.mapInArrow(_keyed, "key long, number long, n long"), "pitman-keys"), F.col("key"), "pitman-dictionary", WORD_ROWS)
    arrow = to_arrow_type(field.dataType)
    binary = ", ".join(f"{c} binary" for c in ("numbers", "lengths", "known", "base", "apart"))
    sliced = written(rows.mapInArrow(_number(path, counts, sizes, arrow), f"slice long, ids array<{kind}>, {binary}"), "pitman-slices")
    asked = _dealt(sliced.select("slice", "numbers", "lengths", "apart").mapInArrow(_ask(sizes), "bucket int, slice long, pairs binary, n binary"), "bucket", "pitman-pairs")
    counted, seated, ranges = _sample(spark, asked, words, sizes, burn_in, samples)
    listed = _bucket_list(spark, asked, sizes)
    answers = _dealt(listed.mapInArrow(_answer(asked, counted, seated, sizes), "slice long, bucket int, values binary"), "slice", "pitman-answers")
    types = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = sliced.mapInArrow(_sum(answers, ranges, sizes, arrow), types)
    per_token = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.select("id", "held_out", "n_tokens", "n_known", F.lit(sizes.tokens).cast("long").alias("train_tokens"), "base_score", "score", per_token.alias("perplexity"))


def _bucket_list(spark: SparkSession, asked: str, sizes: Sizes) -> DataFrame:
    """A task for each bucket that has pairs."""
    there = spark.read.parquet(asked).select("bucket").distinct()
    return there.select(F.col("bucket").cast("int").alias("bucket")).repartition(sizes.buckets, "bucket")


def _sample(spark: SparkSession, asked: str, words: DataFrame, sizes: Sizes, burn_in: int, samples: int) -> tuple[str, str, str]:
    """Folders of pairs, of their tables and of ranges after all sweeps; fills in what sizes has of them. What only an earlier
    sweep needed is deleted."""
    buckets, counted, seated, ranges = _bucket_list(spark, asked, sizes), None, None, None
    for sweep in range(burn_in + samples + 1):
        sizes.samples = max(sweep - burn_in, 0)
        before, old_ranges = seated, ranges
        if sweep == 0:
            counted = _dealt(buckets.mapInArrow(_count(asked, sizes), COUNTED), "bucket", "pitman-counted")
        else:
            seated = _dealt(buckets.mapInArrow(_sit(counted, before, ranges, sizes, sweep), SEATED), "bucket", "pitman-seated")
        done = spark.read.parquet(seated or counted)
        if sweep == 0:
            sizes.d_pairs = _discount(*done.agg(F.sum("ones"), F.sum("twos")).first())
        sums = done.select(F.explode("sums").alias("s")).select("s.*")
        total = sums.groupBy("range").applyInPandas(_total(sizes, ranges, sweep), RANGES)
        if sweep == burn_in + samples:
            total = _with_counts(total, words, sizes)
        ranges = _dealt(total, "range", "pitman-ranges")
        listed = spark.read.parquet(ranges).select("customers", "tables").mapInArrow(_totals, "customers long, tables long, ones long, twos long")
        sizes.customers, sizes.tables, ones, twos = listed.agg(*[F.sum(c) for c in ("customers", "tables", "ones", "twos")]).first()
        if sweep == 0:
            sizes.d_words = _discount(ones, twos)
        if sizes.samples:
            sizes.unknown_sum += sizes.predicted(0, 0)
        for folder in (before, old_ranges):
            if folder:
                dropped(spark, folder)
    return counted, seated, ranges


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for customers, tables in zip(b.column("customers").to_pylist(), b.column("tables").to_pylist()):
            customers, tables = unpack(customers, np.int64), unpack(tables, np.int64)
            found = customers.sum(), tables.sum(), (customers == 1).sum(), (customers == 2).sum()
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in found], ["customers", "tables", "ones", "twos"])
