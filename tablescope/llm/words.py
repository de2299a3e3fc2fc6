"""Words, word hashes and windows of whole texts, as flat numpy arrays over one Arrow batch.

Shared by the operators that look at texts word by word. A batch is cut into slices of a few MB before it is expanded,
so memory follows the slice (or the longest single text), never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text, and rows, that are expanded into arrays at once.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 1 << 15

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Bytes inside a word: everything but ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes inside a word: digits, letters and every byte of a character beyond ASCII.
LETTERED = np.zeros(256, dtype=bool)
LETTERED[0x30:0x3A] = LETTERED[0x41:0x5B] = LETTERED[0x61:0x7B] = LETTERED[0x80:] = True


@dataclass
class Words:
    """Words of some rows, in order: row r has words offsets[r] up to offsets[r + 1]."""

    array: pa.Array
    offsets: np.ndarray
    #: First byte of each word, and the byte behind it, in the joined bytes of all rows.
    begin: np.ndarray
    end: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive parts of at most `limit` bytes of text (one row at least) and SLICE_ROWS rows."""
    offsets = raw(batch.column(column))[1]
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), start + SLICE_ROWS, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null is empty."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else pa.binary()
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(kind)
    _, offsets, data = texts.buffers()
    wide = np.int64 if kind == pa.large_binary() else np.int32
    offsets = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(texts: pa.Array, inside: np.ndarray = SPACED, lower: bool = False) -> Words:
    """The words of each text: longest runs of bytes for which `inside` holds, A-Z lower-cased on request."""
    data, offsets = raw(texts)
    data = LOWER[data] if lower else data
    word = inside[data]
    bounds = np.zeros(len(data) + 1, dtype=bool)
    bounds[offsets] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | bounds[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | bounds[1:-1]
    at = np.flatnonzero(starts)
    behind = np.flatnonzero(ends) + 1
    lengths = behind - at
    cuts = np.zeros(len(at) + 1, np.int32)
    np.cumsum(lengths, out=cuts[1:])
    array = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data[word]))])
    return Words(array, np.searchsorted(at, offsets), at, behind)


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, and the distinct words by number."""
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, alike in every task."""
    codes, distinct = coded(words)
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x) for x in distinct.to_pylist()), np.uint64, len(distinct))[codes] if len(words) else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` consecutive values, without regard to rows."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = mixed((total ^ hashes[k : k + n]) + np.uint64(0x9E3779B97F4A7C15))
    return total


def row_windows(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window hashes inside rows, their rows and first words; a row of fewer words, but not none, is one window."""
    counts = words.counts
    rows = words.rows()
    at = np.arange(len(hashes))
    full = at + width <= words.offsets[1:][rows]
    found, where, first = windows(hashes, width), rows[full], at[full]
    short = np.flatnonzero((counts > 0) & (counts < width))
    found = found[first] if len(found) else found
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for n in np.unique(counts[short]):
            own = np.flatnonzero(counts[short] == n)
            begin = words.offsets[short[own]]
            total = np.full(len(own), n, np.uint64)
            for k in range(n):
                total = mixed((total ^ hashes[begin + k]) + np.uint64(0x9E3779B97F4A7C15))
            extra[own] = total
        found, where, first = np.concatenate([found, extra]), np.concatenate([where, short]), np.concatenate([first, words.offsets[short]])
        order = np.argsort(first, kind="stable")
        found, where, first = found[order], where[order], first[order]
    return found, where, first
