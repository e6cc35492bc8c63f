"""Toxicity: a learnt lexicon as a trie, Levenshtein automata that catch misspelled terms, context windows.

The lexicon is chosen greedily from the words and word beginnings ("stems") of a bounded sample of labelled
documents without near copies: terms that nearly only toxic documents have, by a likelihood ratio that chance
does not reach, each covering as many toxic documents as it can; a document that others cover counts half as much
for each of them. Beside a chosen stem, the words of toxic documents that begin with it stay terms of their own, so
that their misspellings are found.
Scoring works on the distinct words of a batch: hashes of a word and of the word without any one or two letters rule
out words that no term can be near to; the automaton of each remaining word walks the trie. Hits count by the share
of toxic documents among training documents with such a hit, less inside quotation marks or after a word of
reporting and more beside an address to the reader. The score is the noisy-or of the hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import by_text, code_points, mixed, slices, tokens
from .common import row_hash, small, text_of, written

#: Labelled documents that the lexicon is fitted on at most. Candidates and terms follow from these and have no bounds of their own.
TRAIN_DOCS = 40_000
#: Share of the words of both that copies have in common.
COPIED = 0.8
STEMS = (4, 5, 6, 7)
#: A term needs this share of toxic documents among those that have it, this likelihood ratio (twice the log) against
#: the base rate, and so many documents (or this share of all toxic ones).
PRECISION, RATIO, LEAST_DOCS, LEAST_SHARE = 0.85, 34.0, 3, 0.002
#: Each other document with a term takes so many toxic ones from its gain.
PENALTY = 4
#: Words and stems from these lengths on may have one edit: a letter put in, left out or changed, or two swapped.
FUZZY_WORD, FUZZY_STEM = 5, 5
#: Words and stems from this length on may have two.
FUZZY_TWICE = 8
#: Prior numbers of toxic and other documents for a hit.
PRIOR = {0: (1.0, 0.1), 1: (1.5, 0.5), 2: (1.5, 1.0)}
WINDOW, QUOTED, REPORTED, ADDRESSED = 6, 0.3, 0.7, 0.5
#: Words that report speech and words that address the reader, in the four languages of the corpus.
REPORTS = frozenset("said says called wrote quoted quote dijo llamó citó escribió dit appelé cité écrit sagte nannte schrieb zitierte".split())
ADDRESS = frozenset("you your yourself you're tú usted vosotros eres tu vous toi votre es du dich dir euch ihr bist".split())
OPENING, CLOSING = "\"'“‘«„‹`", "\"'”’»“›`"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_DELETED = 22  # bits of the bitmap


def normal(words: pa.Array) -> pa.Array:
    """Lower case, letters and digits only."""
    return pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}\p{N}]+", "")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


class Trie:
    """Terms (word, is it a stem) and the automata of words over them."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.edits = [2 if len(w) >= FUZZY_TWICE else int(len(w) >= (FUZZY_STEM if stem else FUZZY_WORD)) for w, stem in terms]
        self.terms, self.root = terms, [{}, [], 0]  # children, terms that end here, most edits of a term below
        for i, (word, _) in enumerate(terms):
            node = self.root
            for c in word:
                node = node[0].setdefault(c, [{}, [], 0])
                node[2] = max(node[2], self.edits[i])
            node[1].append(i)
        self.lengths = sorted({len(w) for w, stem in terms if stem})
        self.twice = sorted({len(w) + d for (w, stem), k in zip(terms, self.edits) if k == 2 for d in (-2, -1, 0, 1, 2)})
        size = max([len(w) for w, _ in terms] + [1]) + 3
        self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)])) for b in (_BASE, _INVERSE))
        self.near, self.begins, self.near_twice = (np.zeros(1 << _DELETED, bool) for _ in range(3))
        for (word, stem), k in zip(terms, self.edits):
            h = self._of(word)
            near = [h] + [self._of(word[:j] + word[j + 1 :]) for j in range(len(word)) if k]
            if stem:
                self.begins[self._slot(np.array(near, np.uint64))] = True
            else:
                self.near[self._slot(np.array(near, np.uint64))] = True
            if k == 2:
                near += [self._of(word[:i] + word[i + 1 : j] + word[j + 1 :]) for j in range(len(word)) for i in range(j)]
                self.near_twice[self._slot(np.array(near, np.uint64))] = True
        # one edit at the start of a word reaches beginnings that are one shorter or longer than the stem
        self.lengths = sorted({n + d for n in self.lengths for d in ((-1, 0, 1) if n >= FUZZY_STEM else (0,))})
        self.memo: dict[str, tuple[int, int] | None] = {}

    @staticmethod
    def _of(word: str) -> np.uint64:
        h, p = 0, 1
        for c in word:
            h, p = h + (ord(c) + 1) * p, p * int(_BASE)
        return np.uint64(h % (1 << 64))

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (mixed(h) >> np.uint64(64 - _DELETED)).astype(np.int64)

    def search(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term, the first in the lexicon of equally near ones; None if none is near."""
        best: tuple[int, int] | None = None
        n = len(word)

        def step(node, row: list[int], above: list[int] | None, letter: str) -> None:
            nonlocal best
            for i in node[1]:
                stem = self.terms[i][1]
                d = min(row) if stem else row[n]
                if d <= self.edits[i] and (best is None or (d, i) < best[::-1]):
                    best = (i, d)
            for c, child in node[0].items():
                new = [row[0] + 1]
                for j in range(1, n + 1):
                    d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (word[j - 1] != c))
                    if above and j > 1 and word[j - 1] == letter and word[j - 2] == c:
                        d = min(d, above[j - 2] + 1)
                    new.append(d)
                if min(new) <= child[2]:
                    step(child, new, row, c)

        step(self.root, list(range(n + 1)), None, "")
        return best

    def code(self, term: int, edits: int) -> int:
        """The number of a kind of hit: 2 * term + edits, and for two edits 2 * the number of terms + term."""
        return 2 * term + edits if edits < 2 else 2 * len(self.terms) + term

    def _near_twice(self, h: np.ndarray) -> np.ndarray:
        """Which words of one length have a letter or two fewer than a form of a term; h: (words, letters + 1) sums of hashes."""
        n, out = h.shape[1] - 1, self.near_twice[self._slot(h[:, -1])]
        for j in range(n):
            after = (h[:, n] - h[:, j + 1]) * self.down[1]
            out |= self.near_twice[self._slot(h[:, j] + after)]
            after = after * self.down[1]
            for i in range(j):
                out |= self.near_twice[self._slot(h[:, i] + (h[:, j] - h[:, i + 1]) * self.down[1] + after)]
        return out

    def hits(self, words: pa.Array) -> np.ndarray:
        """For normal words: code() of the nearest term and its edits, or -1."""
        out = np.full(len(words), -1, np.int64)
        if not len(words) or not self.terms:
            return out
        longest = len(self.up) - 2
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        fit = np.flatnonzero(sizes > 0)
        # only the beginning of a long word can matter
        cps, at = code_points(pc.utf8_slice_codeunits(words.take(pa.array(fit)), 0, longest + 1))
        n = np.diff(at)
        depth = np.arange(len(cps)) - np.repeat(at[:-1], n)
        term = (cps.astype(np.uint64) + np.uint64(1)) * self.up[depth]
        total = np.concatenate([[np.uint64(0)], np.cumsum(term)])
        start = np.repeat(total[at[:-1]], n)
        before, whole = total[:-1] - start, np.repeat(total[at[1:]], n) - start
        without = before + (whole - before - term) * self.down[1]
        near = np.logical_or.reduceat(self.near[self._slot(without)], at[:-1]) | self.near[self._slot(total[at[1:]] - total[at[:-1]])]
        near &= n <= longest
        for size in self.lengths:
            long = np.flatnonzero(n >= size)
            first = total[at[:-1][long] + size] - total[at[:-1][long]]
            near[long] |= self.begins[self._slot(first)]
            if size >= FUZZY_STEM - 1:
                for j in range(size):  # the beginning without its letter j
                    b = total[at[:-1][long] + j] - total[at[:-1][long]]
                    a = first - (total[at[:-1][long] + j + 1] - total[at[:-1][long]])
                    near[long] |= self.begins[self._slot(b + a * self.down[1])]
        for size in self.twice:
            long = np.flatnonzero((n == size) & ~near)
            if len(long):
                near[long] = self._near_twice(total[at[:-1][long][:, None] + np.arange(size + 1)] - total[at[:-1][long]][:, None])
        some = fit[near]
        for i, word in zip(some.tolist(), words.take(pa.array(some)).to_pylist()):
            if word not in self.memo:
                if len(self.memo) >= 200_000:
                    self.memo.clear()
                self.memo[word] = self.search(word)
            found = self.memo[word]
            if found is not None:
                out[i] = self.code(*found)
        return out


def context_factor(window: list[str], at: int) -> float:
    """How much a hit at window[at] counts: raw tokens, quotation marks and all."""
    before, own, after = window[:at], window[at], window[at + 1 :]
    opened = own[:1] in OPENING and own[:1] != "" or any(w[:1] in OPENING for w in before)
    closed = own.rstrip(".,;:!?")[-1:] in CLOSING and len(own) > 1 or any(w.rstrip(".,;:!?")[-1:] in CLOSING for w in after if len(w) > 1)
    plain = [w.strip("\"'“”‘’«»„‹›`.,;:!?()").lower() for w in window]
    if opened and closed:
        return QUOTED
    if any(w in REPORTS for w in plain[:at]):
        return REPORTED
    return 1 + ADDRESSED if any(w in ADDRESS for i, w in enumerate(plain) if i != at) else 1.0


def _hits(texts: pa.Array, trie: Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the hits in texts, in order: (text, Trie.code of term and edits, context factor)."""
    words, codes, offsets = tokens(texts)
    plain = normal(words).dictionary_encode()
    hit = trie.hits(plain.dictionary)[plain.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
    where = np.flatnonzero(hit[codes] >= 0)
    owner = np.searchsorted(offsets, where, "right") - 1
    factor = np.ones(len(where))
    for k, (i, o) in enumerate(zip(where.tolist(), owner.tolist())):
        lo, hi = max(int(offsets[o]), i - WINDOW), min(int(offsets[o + 1]), i + WINDOW + 1)
        factor[k] = context_factor([words[int(c)].as_py() for c in codes[lo:hi]], i - lo)
    return owner, hit[codes[where]], factor


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, feature) once each: words as they are, stems with a star."""
    for b in batches:
        for part in slices(b):
            words, codes, offsets = tokens(part.column("text"))
            plain = normal(words).dictionary_encode()
            of = plain.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes] if len(words) else codes
            owner = np.repeat(np.arange(part.num_rows), np.diff(offsets))
            pairs = np.unique(owner * max(1, len(plain.dictionary)) + of)
            owner, of = pairs // max(1, len(plain.dictionary)), pairs % max(1, len(plain.dictionary))
            ids = part.column("doc").to_numpy(zero_copy_only=False)
            size = pc.utf8_length(plain.dictionary).to_numpy(zero_copy_only=False)
            keep = (size[of] >= 3) & (size[of] <= 32)
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner[keep]]), plain.dictionary.take(pa.array(of[keep]))], ["doc", "feature"])
            for n in STEMS:
                keep = size[of] > n
                cut = pc.binary_join_element_wise(pc.utf8_slice_codeunits(plain.dictionary, 0, n), "*", "").dictionary_encode()
                stems = np.unique(owner[keep] * max(1, len(cut.dictionary)) + cut.indices.to_numpy(zero_copy_only=False).astype(np.int64)[of[keep]])
                yield pa.RecordBatch.from_arrays([pa.array(ids[stems // max(1, len(cut.dictionary))]), cut.dictionary.take(pa.array(stems % max(1, len(cut.dictionary))))], ["doc", "feature"])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text, toxic): labelled documents that are not held out, at most about TRAIN_DOCS, chosen by a hash of the id.

    Of documents with the same text one stands for all, and so does the first of those with the same three least word hashes for
    those of them that share COPIED of their words with it; the others stay.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    if n > TRAIN_DOCS:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * TRAIN_DOCS / n))
    known = small(known.withColumnRenamed("doc_id", "labelled_id"), min(n, TRAIN_DOCS))
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = texts.join(known, texts["id"] == known["labelled_id"]).select("text", "toxic")
    words = F.array_distinct(F.split(F.lower("text"), r"\s+"))
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumns({"doc": F.xxhash64("text"), "words": F.transform(words, lambda w: F.xxhash64(w))})
    rows = written(rows.withColumn("key", F.xxhash64(F.slice(F.array_sort("words"), 1, 3))), "toxicity-labelled")
    first = rows.groupBy(F.col("key").alias("of")).agg(F.max_by(F.struct("doc", "words"), F.struct("toxic", "doc")).alias("first"))
    same = F.size(F.array_intersect("words", "first.words")) / F.size(F.array_union("words", "first.words"))
    return rows.join(first, F.col("key") == F.col("of")).where((F.col("doc") == F.col("first.doc")) | (same < COPIED)).select("doc", "text", "toxic")


def fit(train: DataFrame) -> dict:
    """The lexicon from (doc, text, toxic): terms, hit values by Trie.code, the value without any hit.

    All that comes to the driver is bounded by TRAIN_DOCS: candidates are in LEAST_SHARE of the toxic ones at least, and terms are
    chosen until none gains. Without toxic rows no term is chosen.
    Words come before stems, so that a word's own term counts where both are equally near.
    """
    train = written(train, "toxicity-train")
    n, toxic = train.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    features = lambda df: df.select("doc", "text").mapInArrow(_features, "doc long, feature string")
    terms: list[tuple[str, bool]] = []
    if toxic:
        bad = written(features(train.where("toxic = 1")), "toxicity-features")
        least = max(LEAST_DOCS, int(LEAST_SHARE * toxic))
        often = bad.groupBy("feature").agg(F.count("*").alias("t")).where(F.col("t") >= least)
        often = written(often, "toxicity-candidates")
        other = features(train.where("toxic = 0")).join(F.broadcast(often.select("feature")), "feature").groupBy("feature").agg(F.count("*").alias("n"))
        t, o, base = F.col("t").cast("double"), F.coalesce("n", F.lit(0)).cast("double"), float(toxic) / n
        ratio = 2 * (t * F.log(t / (t + o) / base) + F.when(o > 0, o * F.log(o / (t + o) / max(1 - base, 1e-9))).otherwise(0.0))
        sharp = often.join(other, "feature", "left").where(((t + 0.5) / (t + o + 1) >= PRECISION) & (ratio >= RATIO)).select("feature", o.alias("o"))
        sharp = written(sharp, "toxicity-sharp")
        cover: dict[str, set] = {}
        other_docs = {r["feature"]: r["o"] for r in sharp.collect()}
        for r in bad.join(F.broadcast(sharp.select("feature")), "feature").toLocalIterator():
            cover.setdefault(r["feature"], set()).add(r["doc"])
        weight = dict.fromkeys(set().union(*cover.values()), 1.0)
        gains = {f: len(d) - PENALTY * other_docs[f] for f, d in cover.items()}
        while gains:  # gains only fall, so one that was brought up to date and still leads is the best
            best = max(gains, key=lambda f: (gains[f], not f.endswith("*"), len(f), f))
            now = sum(weight[d] for d in cover[best]) - PENALTY * other_docs[best]
            if now < gains[best]:
                gains[best] = now
                continue
            if now < least:
                break
            for d in cover[best]:
                weight[d] /= 2
            word = best.rstrip("*")
            terms.append((word, best.endswith("*")))
            same = lambda f: f.startswith(word) or word.startswith(f.rstrip("*"))
            gains = {f: g for f, g in gains.items() if not (same(f) and (best.endswith("*") or len(cover[f] - cover[best]) < least))}
        begun = F.lit(False)
        for n_letters in STEMS:
            begun |= F.substring("feature", 1, n_letters).isin([w for w, stem in terms if stem and len(w) == n_letters])
        beside = often.where(begun & ~F.col("feature").endswith("*")).orderBy(F.desc("t"), "feature").collect()
        terms = sorted(dict.fromkeys([*terms, *((r["feature"], False) for r in beside)]), key=lambda x: x[1])

    kinds = 3 * len(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(terms)
        for b in batches:
            for part in slices(b):
                owner, hit, _ = _hits(part.column("text"), trie)
                label = part.column("toxic").to_numpy(zero_copy_only=False)
                pairs = np.unique(owner * (kinds + 2) + hit) if len(owner) else np.zeros(0, np.int64)
                owner, hit = pairs // (kinds + 2), pairs % (kinds + 2)
                none = np.setdiff1d(np.arange(part.num_rows), owner)
                rows = [pa.array(np.concatenate([hit, np.full(len(none), -1)]), pa.int64()), pa.array(np.concatenate([label[owner], label[none]]), pa.int64())]
                yield pa.RecordBatch.from_arrays(rows, ["hit", "toxic"])

    seen = {r["hit"]: (r["t"], r["n"] - r["t"]) for r in train.mapInArrow(count, "hit long, toxic long").groupBy("hit").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()}
    values = []
    for i in range(kinds):
        (t, o), (a, b) = seen.get(i, (0, 0)), PRIOR[i % 2 if i < 2 * len(terms) else 2]
        values.append((t + a) / (t + o + a + b))
    t, o = seen.get(-1, (0, 0))
    return {"terms": terms, "values": values, "base": min(0.45, (t + 0.5) / (t + o + 10))}


def _scores(texts: pa.Array, trie: Trie, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(score, number of hits) of each text. Of equal hits of a text the strongest counts; a kind of hit that is
    likelier clean than toxic counts nothing."""
    owner, hit, factor = _hits(texts, trie)
    known = np.array([*model["values"], 0.0])
    value = np.where(known >= 0.5, known, 0.0)[hit]
    value = np.where(factor > 1, 1 - (1 - value) * (2 - factor), value * factor) * (value > 0)
    order = np.lexsort((-value, hit, owner))
    first = np.ones(len(order), bool)
    first[1:] = (owner[order][1:] != owner[order][:-1]) | (hit[order][1:] != hit[order][:-1])
    strongest = order[first]
    gone = np.zeros(len(texts))
    np.add.at(gone, owner[strongest], np.log1p(-np.minimum(value[strongest], 0.9999)))
    return 1 - (1 - model["base"]) * np.exp(gone), np.bincount(owner, minlength=len(texts))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, score, hits) per input row; h is a hash of id and text. Null and empty texts get the value without hits.

    Equal texts get equal scores. The model is a lexicon of terms and the words beside its stems. Very long texts are taken whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(model["terms"])
        for b in batches:
            for part in slices(b):
                values, hits = _scores(part.column("text"), trie, model)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), pa.array(values), pa.array(hits)], ["id", "h", "score", "hits"])

    rows = docs.select(F.col(id_col).alias("id"), row_hash(id_col, text_col).alias("h"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, h long, score double, hits long")
