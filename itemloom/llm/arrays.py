"""Numpy over Arrow text buffers: words, word hashes and shingle hashes of a batch of documents.

All functions work on a slice of a batch that holds a few megabytes of text (``slices``), so
the arrays of a task stay small whatever the batch size; one document is never cut, so its own
length is the only thing that can make a slice larger. A null text counts as an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U = np.uint64
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
EXACT = np.arange(1, 257, dtype=np.uint64)
LOWER = EXACT.copy()
LOWER[65:91] = EXACT[97:123]
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers, one for each 64 bits


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=2)
def _powers_of(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.full(size, base, dtype=np.uint64)
    back = np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
    steps[0] = back[0] = 1
    return np.cumprod(steps), np.cumprod(back)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n - 1).bit_length())
    return _powers_of(base, size)


@dataclass
class Texts:
    """The bytes of several documents in a row, and where each begins."""

    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than documents

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes().decode("utf-8", "replace")

    def chars(self) -> np.ndarray:
        """Code points of each document."""
        heads = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))
        return heads[self.offsets[1:]] - heads[self.offsets[:-1]]


def texts_of(column: pa.Array) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(raw, offsets - offsets[0])


def texts_from(values: list[str]) -> Texts:
    raw = [v.encode("utf-8", "replace") for v in values]
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in raw]))).astype(np.int64)
    return Texts(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cut a batch into runs of whole rows with about ``limit`` bytes of text."""
    at = batch.schema.get_field_index(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0), dtype=np.int64) + 1
    group = np.cumsum(sizes) // limit
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(int(a), int(b - a))


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice: byte ranges and the document of each."""

    texts: Texts
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    counts: np.ndarray  # words of each document
    first: np.ndarray  # index of each document's first word, one more than documents

    def hashes(self, table: np.ndarray = EXACT, which: int = 0) -> np.ndarray:
        """64-bit hash of each word; equal words have equal hashes in every slice."""
        data = self.texts.data
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        forth, back = _powers(BASES[which], len(data))
        run = np.empty(len(data) + 1, dtype=np.uint64)
        run[0] = 0
        np.cumsum(table[data] * forth[:len(data)], out=run[1:])
        return mixed((run[self.ends] - run[self.starts]) * back[self.starts] + (self.ends - self.starts).astype(np.uint64))


def words_of(texts: Texts) -> Words:
    data, offsets = texts.data, texts.offsets
    inside = ~WHITE[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    if n:
        before = np.empty(n, dtype=bool)
        before[0] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.empty(n, dtype=bool)
        after[-1] = False
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    first = np.searchsorted(starts, offsets)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    return Words(texts, starts, ends, doc, counts, first)


def windows(hashes: np.ndarray, words: Words, size: int, seed: int = 0x9FB21C651E98DF25) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words inside one document, and its first word's index."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.doc[:n] == words.doc[size - 1:])
    run = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        run *= U(seed)
        run += hashes[k:k + n]
    return mixed(run[at]), at


def shingles(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes with the document of each; a document of fewer words gives its whole sequence."""
    value, at = windows(hashes, words, size)
    doc = words.doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for k in range(size - 1):
            has = words.counts[short] > k
            i = words.first[short[has]] + k
            whole[has] = whole[has] * U(0xD6E8FEB86659FD93) + hashes[i]
        whole = mixed(whole + words.counts[short].astype(np.uint64))
        value, doc = np.concatenate((value, whole)), np.concatenate((doc, short))
    return value, doc


def distinct(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, value) pairs, sorted by document, then value."""
    if not len(doc):
        return doc, value
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    keep = np.concatenate(([True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])))
    return d[keep], v[keep]
