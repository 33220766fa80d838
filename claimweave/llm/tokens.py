"""Words of whole Arrow batches as numpy arrays: places and 64-bit hashes, computed without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 2_000_000
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
_WORD_BASE = U(0x9E3779B97F4A7C15)
_GRAM_BASE = U(0xC2B2AE3D27D4EB4F)

#: Bytes between words: space and the five controls from tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII bytes but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: U, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64."""
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, U)
        steps[0] = U(1)
        have = np.multiply.accumulate(steps)
        if len(have) <= 2 * CHUNK_BYTES:
            _powers[key] = have
    return have[:n]


def _inverse(base: U) -> U:
    return U(pow(int(base), -1, 1 << 64))


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: U) -> np.ndarray:
    """Polynomial hashes of the slices [start, end) of ``values``."""
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return (total[ends] - total[starts]) * powers(_inverse(base), len(values) + 1)[starts]


@dataclass
class Words:
    """Words of some rows of a batch, in order."""

    rows: np.ndarray  # the batch's row numbers, one per text
    first: np.ndarray  # of each text: number of its first word; one more at the end
    starts: np.ndarray  # byte places in data
    ends: np.ndarray
    data: np.ndarray
    hashes: np.ndarray

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), np.diff(self.first))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they end inside its text."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(n, U), np.zeros(n, bool)
        at = np.arange(n - k + 1)
        g = np.zeros(n, U)
        g[: n - k + 1] = mix(_sums(self.hashes, at, at + k, _GRAM_BASE) + U(k))
        last = np.repeat(self.first[1:], np.diff(self.first))
        return g, np.arange(n) + k <= last

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each run of words [start, end)."""
        return mix(_sums(self.hashes, starts, ends, _GRAM_BASE) + (ends - starts).astype(U))


def tokenized(column: pa.Array, separators: np.ndarray = SPACES) -> Iterator[Words]:
    """The column's texts in parts of about CHUNK_BYTES, each with its words. A null has none."""
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        to = min(to, n)
        lo = offsets[at]
        yield _words(np.arange(at, to), data[lo : offsets[to]], offsets[at : to + 1] - lo, separators)
        at = to


def _words(rows: np.ndarray, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Words:
    size = len(data)
    gap = separators[data]
    text_start = np.zeros(size + 1, bool)
    text_start[offsets[:-1]] = True
    text_start[offsets[-1]] = True
    before = np.ones(size, bool)
    before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & (before | text_start[:size]))
    after = np.ones(size, bool)
    after[:-1] = gap[1:]
    ends = np.flatnonzero(~gap & (after | text_start[1:])) + 1
    hashes = mix(_sums(_BYTE[data], starts, ends, _WORD_BASE) + (ends - starts).astype(U)) if size else np.zeros(0, U)
    return Words(rows, np.searchsorted(starts, offsets), starts, ends, data, hashes)


def word_keys(words: pa.Array) -> np.ndarray:
    """64-bit hash of each of some words (large binary), alike in every task."""
    n = len(words)
    at = np.frombuffer(words.buffers()[1], np.int64, n + 1, words.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    return mix(_sums(_BYTE[data], at[:-1], at[1:], _WORD_BASE) + np.diff(at).astype(U))
