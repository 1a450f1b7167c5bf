"""Words of whole Arrow batches as 64-bit hashes, with numpy alone: no Python object per word.

A word is a maximal run of ASCII letters, digits, underscores and characters beyond ASCII
that aren't punctuation or spaces of the blocks U+0080-00BF, U+2000-206F and U+3000-303F,
after lower-casing.  The hash of a word is a polynomial in its bytes, mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_C = np.random.default_rng(20240229).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)

_LUT = np.zeros(256, bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_":
    _LUT[_c] = True
_LUT[128:] = True

SLICE_BYTES = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        m = max(n, 2 * SLICE_BYTES)
        _pow, _inv = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, b)])) for b in (_B, _INV))
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """hash, start and end of each word; start and end are bytes within data, the lower-cased texts one after the other.

    of[d]:of[d + 1] are the words of document d, at[d]:at[d + 1] its bytes."""

    data: np.ndarray
    at: np.ndarray
    of: np.ndarray
    start: np.ndarray
    end: np.ndarray
    prefix: np.ndarray

    @property
    def hash(self) -> np.ndarray:
        return self.hash_of(self.start, self.end)

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, inv = _powers(len(self.data) + 1)
        return mix((self.prefix[end] - self.prefix[start]) * inv[start])

    def lengths(self) -> np.ndarray:
        return np.diff(self.of)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), self.lengths())


def slices(arr: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes together; a longer text is a range of its own."""
    n = pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, i = np.cumsum(n), 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + limit, "right")))
        yield i, j
        i = j


def bytes_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and where each text begins."""
    wide = pa.types.is_large_string(arr.type)
    _, off, dat = arr.buffers()
    at = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(dat, np.uint8)[at[0] : at[-1]] if dat is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def words(arr: pa.Array) -> Words:
    """Null is as the empty text."""
    data, at = bytes_of(pc.utf8_lower(pc.fill_null(arr, "")))
    n = len(data)
    ok = _LUT[data]
    if n and data.max() >= 0xC2:
        nxt = np.append(data[1:], 0)
        two = np.flatnonzero(data == 0xC2)
        three = np.flatnonzero((data == 0xE2) & ((nxt == 0x80) | (nxt == 0x81)) | (data == 0xE3) & (nxt == 0x80))
        for w, k in ((two, 2), (three, 3)):
            for j in range(k):
                ok[np.minimum(w + j, n - 1)] = False
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], ok])
    after = np.append(ok, False)
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    powers, _ = _powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=prefix[1:])
    return Words(data, at, np.searchsorted(start, at), start, end, prefix)


def grams(h: np.ndarray, of: np.ndarray, n: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of n words within a document, its first word's index, and the new offsets.

    whole_if_short: a document of 1 to n - 1 words has one run, of all its words."""
    size = np.diff(of)
    first = np.arange(len(h))
    left = np.repeat(of[1:], size) - first
    g = np.zeros(len(h), np.uint64)
    for j in range(n):
        if len(h) > j:
            part = h[j:] * _C[j]
            if whole_if_short:
                part = np.where(left[: len(part)] > j, part, np.uint64(0))
            g[: len(h) - j] += part
    keep = left >= n
    if whole_if_short:
        keep |= (first == np.repeat(of[:-1], size)) & (left < n)
    at = np.concatenate([[0], np.cumsum(keep)])[of]
    return mix(g[keep]), first[keep], at


def char_offsets(data: np.ndarray, base: int, where: np.ndarray) -> np.ndarray:
    """Characters between byte base and each of the bytes where."""
    if not len(where):
        return where
    lead = np.cumsum((data[base : max(where.max(), base + 1)] & 0xC0) != 0x80)
    return np.where(where > base, lead[np.maximum(where - base, 1) - 1], 0)
