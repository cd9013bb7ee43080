"""Vectorised scans over Arrow string buffers.

Words, lines and shingles of whole texts are found with array operations over the UTF-8 bytes of a slice of rows, so no
Python object is made for a word. Slices are cut by bytes, which bounds memory whatever the length of a text; one text
longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_LEADING = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_WORD_BYTES = 64  # beyond, a word is hashed by prefix sums
_two_bytes: list[np.ndarray] = []


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _eights(chunks: np.ndarray) -> np.ndarray:
    """Sums over the eight bytes of each word, byte i times the base to the power i."""
    if not _two_bytes:
        low = np.arange(1 << 16, dtype=np.uint64)
        _two_bytes.append((low & np.uint64(255)) + (low >> np.uint64(8)) * _BASE)
    up, _ = _power_tables(8)
    twos = chunks.view("<u2").reshape(-1, 4)
    out = _two_bytes[0][twos[:, 0]]
    for k in (1, 2, 3):
        out += _two_bytes[0][twos[:, k]] * up[2 * k]
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unmix(x: np.ndarray) -> np.ndarray:
    """What ``mix`` was given."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


@dataclass
class Slice:
    """Consecutive rows: ``data`` holds their bytes, row i is data[bounds[i]:bounds[i + 1]]."""

    first: int
    data: np.ndarray
    bounds: np.ndarray
    _sums: np.ndarray | None = None

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def sums(self) -> np.ndarray:
        if self._sums is None:
            up, _ = _power_tables(len(self.data) + 1)
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=self._sums[1:])
        return self._sums

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte ranges."""
        s = self.sums()
        _, down = _power_tables(len(self.data) + 1)
        return mix((s[ends] - s[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What ``hashes`` gives, for ranges as short as words: eight bytes at a time, without sums over the whole slice."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        up, _ = _power_tables(len(self.data) + 1)
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[:-8] = self.data
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        length = ends - starts
        ones = np.zeros(_WORD_BYTES + 1, np.uint64)
        np.cumsum(_power_tables(_WORD_BYTES)[0][:_WORD_BYTES], out=ones[1:])
        out = _eights(eight[starts] & _LEADING[np.minimum(length, 8)]) + ones[np.minimum(length, _WORD_BYTES)]
        rest = np.flatnonzero(length > 8)
        for k in range(8, _WORD_BYTES, 8):
            out[rest] += _eights(eight[starts[rest] + k] & _LEADING[np.minimum(length[rest] - k, 8)]) * up[k]
            rest = rest[length[rest] > k + 8]
        out = mix(out + length.astype(np.uint64))
        if len(rest):
            out[rest] = self.hashes(starts[rest], ends[rest])
        return out

    def words(self, separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and, for each row, the index of its first word (one more entry at the end)."""
        if separator is WHITE:
            return self.runs((self.data != 0x20) & (self.data - np.uint8(0x09) > 4))
        return self.runs(~separator[self.data])

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs within rows of the bytes where ``inside`` holds."""
        n = len(self.data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(self.rows + 1, np.int64)
        cut = np.zeros(n + 1, bool)
        cut[self.bounds] = True
        before = np.empty(n, bool)
        before[0], before[1:] = False, inside[:-1]
        starts = np.flatnonzero(inside & (~before | cut[:n]))
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, inside[1:]
        ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each row has."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def slices(text: pa.Array, lower: bool = False, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string array into slices of about ``most`` bytes; a null is an empty text."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks() if text.num_chunks != 1 else text.chunk(0)
    if not len(text):
        return
    if text.null_count:
        text = text.fill_null("")
    text = text.cast(pa.large_string())
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, len(text))
        part = whole[offsets[i] : offsets[j]]
        yield Slice(i, lowered(part) if lower else part, offsets[i : j + 1] - offsets[i])
        i = j


def windows(words: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words that stay within a row, and the index of each one's first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words[:n].copy()
    for k in range(1, width):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[k : n + k]
        h ^= h >> np.uint64(29)
    counts = np.diff(firsts)
    good = np.ones(n + width - 1, bool)
    for k in range(1, width):  # the last width - 1 words of a row start nothing
        ends = firsts[1:][counts >= k] - k
        good[ends] = False
    at = np.flatnonzero(good[:n])
    return mix(h[at]), at
