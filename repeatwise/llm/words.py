"""Words of Arrow text columns as numpy arrays, for functions that run inside Spark tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided

_U = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], _U)
# odd 64-bit multipliers; any odd values serve
_MUL = _U(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
END = _U(0x5851F42D4C957F2D)  # hash of the end-of-text token, which is no word


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection."""
    x = x ^ (x >> _U(33))
    x = x * _MIX1
    x = x ^ (x >> _U(33))
    x = x * _MIX2
    return x ^ (x >> _U(33))


def texts_of(column: pa.Array) -> pa.Array:
    """String column without nulls (null: empty) and with 64-bit offsets."""
    return column.cast(pa.large_string()).fill_null("")


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a column of texts.

    ``starts`` and ``ends`` are byte positions in ``bytes``; words ``first[d]`` to ``first[d + 1]`` belong to text ``d``;
    ``hashes`` holds a 64-bit hash of each word's bytes (after lower-casing A-Z if asked). Hashes of words of up to eight bytes
    never meet; others meet with odds of 2**-64 a pair.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        column = texts_of(column)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.offsets = at - at[0]
        self.bytes = raw
        inside = ~_SEPARATOR[raw]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(raw):
            before[0], after[-1] = False, False
            before[1:], after[:-1] = inside[:-1], inside[1:]
            edges = self.offsets[(self.offsets > 0) & (self.offsets < len(raw))]
            before[edges], after[edges - 1] = False, False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = self._hash(lower)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def _hash(self, lower: bool) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, _U)
        padded = np.zeros(len(self.bytes) + 16, np.uint8)
        padded[: len(self.bytes)] = self.bytes
        if lower:
            upper = (padded >= 65) & (padded <= 90)
            padded[upper] += 32
        lanes = as_strided(padded[:8].view("<u8"), (len(self.bytes) + 8,), (1,))
        sizes = self.ends - self.starts
        out = mix((lanes[self.starts] & _MASKS[np.minimum(sizes, 8)]) * _MUL + sizes.astype(_U))
        rest, done = np.flatnonzero(sizes > 8), 8
        while len(rest):
            lane = lanes[self.starts[rest] + done] & _MASKS[np.minimum(sizes[rest] - done, 8)]
            out[rest] = mix(out[rest] * _MUL + lane)
            done += 8
            rest = rest[sizes[rest] > done]
        return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` values from each position on (``len(hashes) - k + 1`` of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = out * _MUL + hashes[j : j + n]
    return mix(out)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of ``range(start, start + count)``."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def text_slices(batches, bytes_each: int):
    """Row ranges of Arrow batches with about ``bytes_each`` bytes of text (column 1)."""
    for batch in batches:
        texts = texts_of(batch.column(1))
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset + 1 : texts.offset + len(texts) + 1] if len(texts) else np.zeros(0, np.int64)
        cuts = np.flatnonzero(np.diff(ends // bytes_each)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(texts)]):
            if b > a:
                yield batch.slice(a, b - a), texts.slice(a, b - a)
