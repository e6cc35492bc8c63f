"""NumPy helpers for Arrow batches of texts: tokens by document, a hash index, symbols of words."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are tokenised at once in a task; a longer text is taken whole.
CHUNK = 3 << 20


def slices(batch: pa.RecordBatch, column: str = "text"):
    """Parts of a batch with about CHUNK bytes of text each."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(sizes):
        return
    part, lo = np.cumsum(sizes) // CHUNK, 0
    for hi in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]:
        yield batch.slice(lo, hi - lo)
        lo = hi
    trimmed()


def trimmed() -> None:
    """Gives memory that a task has freed back to the system, since workers go on to other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct tokens, their code for each token, first token of each text and the end): split at ASCII space."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.flatten()
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary
    empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # pieces before the first and after the last space
        real = ~empty[codes]
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]]
        keep = np.cumsum(~empty) - 1
        codes, words = keep[codes[real]], words.filter(pa.array(~empty))
    else:
        offsets = offsets - offsets[0]
    return words, codes, offsets


def by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values from offset to offset."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all code points, first of each word and the end)."""
    flat = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64))])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class HashIndex:
    """Positions of distinct 64-bit keys, by open addressing; find() gives -1 for a key that isn't there."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, np.int64)
        self.mask = (1 << max(4, int(2 * len(keys)).bit_length())) - 1
        self.table = np.full(self.mask + 1, -1, np.int32)
        todo = np.arange(len(keys))
        slot = mixed(self.keys).astype(np.int64) & self.mask
        while len(todo):
            at = slot[todo]
            free = self.table[at] < 0
            self.table[at[free]] = todo[free]
            todo = todo[self.table[at] != todo]
            slot[todo] = (slot[todo] + 1) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        slot = mixed(keys).astype(np.int64) & self.mask
        at = self.table[slot].astype(np.int64)
        todo = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            got = self.table[slot[todo]].astype(np.int64)
            at[todo] = got
            todo = todo[(got >= 0) & (self.keys[got] != keys[todo])]
        return at
