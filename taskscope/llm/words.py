"""Words of whole Arrow batches as NumPy arrays: no loop over words, no strings.

Texts are handled as UTF-8 bytes.  A word is a run of bytes of a class; bytes of
0x80 and above always belong to words, so a character is never cut.  A word's
64-bit hash is a difference of prefix sums, hence every step is one pass over the
bytes of a piece.  Pieces bound memory: they hold `PIECE` bytes, or one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 21

_ODD = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: All bytes but white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    ALNUM[_a:_b + 1] = True
#: A-Z to a-z; all else stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and their inverses, n of each."""
    if len(_powers[0]) < n:
        inverse = pow(_ODD, -1, 1 << 64)
        for i, base in enumerate((_ODD, inverse)):
            out = np.full(max(n, PIECE + 1), base, np.uint64)
            out[0] = 1
            _powers[i] = np.cumprod(out)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of the texts of a piece: byte ranges, hashes, and each text's first word (one more at the end)."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of `size` words in a row within one text, and where they start.

        A text with fewer words, but one at least, has one window: all its words.
        """
        total = len(self.hash)
        full = max(total - size + 1, 0)
        h = np.zeros(full, np.uint64)
        for k in range(size):
            h = mixed((h ^ self.hash[k:k + full]) + np.uint64(_ODD))
        left = np.repeat(self.first[1:], self.counts)[:full] - np.arange(full)
        at = np.flatnonzero(left >= size)
        h = h[at]
        short = np.flatnonzero((self.counts > 0) & (self.counts < size))
        if len(short):
            extra = np.empty(len(short), np.uint64)
            for j, d in enumerate(short):
                x = np.uint64(0)
                for w in self.hash[self.first[d]:self.first[d + 1]]:
                    x = mixed((np.atleast_1d(x) ^ w) + np.uint64(_ODD))[0]
                extra[j] = x
            at = np.concatenate([at, self.first[short]])
            h = np.concatenate([h, extra])
            order = np.argsort(at, kind="stable")
            at, h = at[order], h[order]
        return h, at


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each starts; a null is an empty text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, inside: np.ndarray = SPACED, lower: bool = True) -> Words:
    data, offsets = utf8(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    mask = np.zeros(n + 2, bool)
    mask[1:-1] = inside[data]
    cuts = np.zeros(n + 1, bool)  # a text's start cuts a word
    cuts[offsets] = True
    start = np.flatnonzero(mask[1:] & (~mask[:-1] | cuts))
    end = np.flatnonzero(mask[:-1] & (~mask[1:] | cuts))
    power, inverse = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    value = (sums[end] - sums[start]) * inverse[start]
    value = mixed(value + (end - start).astype(np.uint64))
    return Words(data, offsets, start, end, value, np.searchsorted(start, offsets))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that no piece has more than `PIECE` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        i = 0
        while i < batch.num_rows:
            before = ends[i - 1] if i else 0
            j = max(int(np.searchsorted(ends, before + PIECE, side="right")), i + 1)
            yield batch.slice(i, j - i)
            i = j
