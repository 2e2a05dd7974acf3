"""Words and shingles of Arrow text batches, with numpy over the UTF-8 bytes.

A word is a maximal run of bytes other than space and 0x09-0x0D. Those bytes never occur inside a
multi-byte UTF-8 sequence, so byte positions of words are also character boundaries. Everything here
works on one slice of a batch, whose size in bytes is bounded by the caller, never on a partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


_PLACES = mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * _M1)


def byte_strings(array: pa.Array) -> list[bytes]:
    """The values of a large_binary array; many times faster than to_pylist()."""
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1].tolist()
    raw = array.buffers()[2].to_pybytes() if array.buffers()[2] is not None else b""
    return [raw[a:b] for a, b in zip(offsets, offsets[1:])]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices whose texts together have about `limit` bytes; one longer text is a slice by itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            base = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


class Texts:
    """The bytes of the texts of one slice; null counts as empty. `lower` folds A-Z only."""

    def __init__(self, column: pa.Array, lower: bool = False):
        filled = pc.fill_null(column, "")
        if isinstance(filled, pa.ChunkedArray):
            filled = filled.combine_chunks()
        filled = filled.cast(pa.large_string())
        offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
        raw = filled.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.n = len(filled)
        self.offsets = offsets - offsets[0]
        self.data = LOWER[data] if lower else data

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """Per text, how many bytes have the mask."""
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def pieces(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes without the mask, never across texts: starts, ends, text numbers."""
        inside = ~separator
        first, last = inside.copy(), inside.copy()
        if len(inside):
            first[1:] &= separator[:-1]
            last[:-1] &= separator[1:]
            full = self.offsets[:-1] < self.offsets[1:]
            heads, tails = self.offsets[:-1][full], self.offsets[1:][full] - 1
            first[heads] = inside[heads]
            last[tails] = inside[tails]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The strings at increasing, disjoint byte spans, without copying the bytes."""
        edges = np.empty(2 * len(starts) + 1, np.int64)
        edges[0:-1:2], edges[1::2] = starts, ends
        edges[-1] = ends[-1] if len(ends) else 0
        both = pa.Array.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(self.data))])
        return both.take(pa.array(np.arange(0, 2 * len(starts), 2)))


    @cached_property
    def _characters(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))

    def code_points(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Byte places as code point offsets in their texts."""
        return self._characters[at] - self._characters[self.offsets[doc]]


class Words(Texts):
    def __init__(self, column: pa.Array, lower: bool = False, separators: np.ndarray = IS_SPACE):
        super().__init__(column, lower)
        self.starts, self.ends, self.doc = self.pieces(separators[self.data])
        self.counts = np.bincount(self.doc, minlength=self.n).astype(np.int64)

    def encoded(self) -> tuple[np.ndarray, list[bytes]]:
        """A number for each word, and the distinct words by number."""
        coded = self.spans(self.starts, self.ends).dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), byte_strings(coded.dictionary)

    def hashes(self) -> np.ndarray:
        """64-bit digest of each word, the same in every batch: the sum over its bytes of a random
        number for (byte, place), the places beyond the table multiplied by their block's odd factor."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        heads = np.cumsum(lengths) - lengths
        inside = np.repeat(self.starts - heads, lengths) + np.arange(lengths.sum())
        place = inside - np.repeat(self.starts, lengths)
        value = _PLACES[(place & 63) << 8 | self.data[inside]]
        far = np.flatnonzero(place > 63)
        value[far] *= mix(place[far].astype(np.uint64) >> np.uint64(6)) | np.uint64(1)
        return mix(np.add.reduceat(value, heads) + lengths.astype(np.uint64))

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of the first word, and digest, of each window of `size` words inside one text."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        out = np.full(len(at), size, np.uint64)
        for k in range(size):
            out = mix(out * _M1 + hashes[at + k])
        return at, out


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as (text number, digest), ordered by both; a text of fewer words is one shingle."""
    hashes = words.hashes()
    at, value = words.windows(hashes, size)
    doc = words.doc[at]
    first = np.concatenate(([0], np.cumsum(words.counts)))[:-1]
    for few in range(1, size):
        short = np.flatnonzero(words.counts == few)
        if len(short):
            out = np.full(len(short), few, np.uint64)
            for k in range(few):
                out = mix(out * _M1 + hashes[first[short] + k])
            doc, value = np.concatenate((doc, short)), np.concatenate((value, out))
    order = np.argsort(doc, kind="stable") if (np.diff(doc) < 0).any() else slice(None)
    doc, value = doc[order], value[order]
    edges = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True]))) if len(doc) else np.zeros(1, np.int64)
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        value[a:b].sort()
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[keep], value[keep]
