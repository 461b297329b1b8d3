"""Words of a batch of texts as arrays of 64-bit hashes, without one Python object per word.

A word is a run of bytes other than the ASCII white space 0x20 and 0x09-0x0D; as UTF-8 uses
these bytes for nothing else, this is the pattern ``[^\\x20\\x09-\\x0D]+`` on code points.
Equal words have equal hashes; different words share one with a chance of about 2**-58.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_RATIO = 0x9E3779B97F4A7C15 | 3
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, U64)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]

#: Bytes of text handled at once; a longer text is handled in pieces cut at white space.
PIECE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit integers over all bits (a bijection)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of the hash's ratio and of its inverse, as far as they were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_RATIO, -1, 2**64)
            up, down = np.full(n, _RATIO, U64), np.full(n, inverse, U64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        return self.up, self.down


_POWERS = _Powers()


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """Hash of data[start:end] for each pair; fold: A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((_FOLDED if fold else _TABLE)[data] * up[: len(data)], dtype=U64, out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


class Texts:
    """Texts of one Arrow column (null: empty): their bytes, limits and, on demand, words."""

    def __init__(self, column: pa.Array, fold: bool = False):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, data = column.buffers()
        limits = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        self.column, self.fold = column, fold
        self.limits = (limits - limits[0]) if len(limits) else np.zeros(1, np.int64)
        size = int(self.limits[-1])
        self.data = (
            np.frombuffer(data, np.uint8)[int(limits[0]) : int(limits[0]) + size]
            if size
            else np.zeros(0, np.uint8)
        )
        self._words = None

    def __len__(self) -> int:
        return len(self.limits) - 1

    def take(self, keep: np.ndarray) -> Texts:
        return Texts(self.column.filter(pa.array(keep)), self.fold)

    def pieces(self) -> Iterator[tuple[int, int]]:
        """Limits of pieces of about PIECE_BYTES; no word lies in two of them."""
        start, size = 0, len(self.data)
        while start < size:
            stop = min(start + PIECE_BYTES, size)
            if stop < size:
                k = int(np.searchsorted(self.limits, stop, "right")) - 1
                if self.limits[k] > start:
                    stop = int(self.limits[k])
                else:
                    stop = self._white_after(stop, int(self.limits[k + 1]))
            yield start, stop
            start = stop

    def _white_after(self, at: int, end: int) -> int:
        while at < end:
            ahead = self.data[at : min(at + 65536, end)]
            found = np.flatnonzero(_WHITE[ahead])
            if len(found):
                return at + int(found[0])
            at += len(ahead)
        return end

    def _find_words(self) -> None:
        hashes, starts, ends = [], [], []
        edges = self.limits
        for low, high in self.pieces():
            data = self.data[low:high]
            inked = ~_WHITE[data]
            first = inked.copy()
            first[1:] &= ~inked[:-1]
            last = inked.copy()
            last[:-1] &= ~inked[1:]
            inner = edges[np.searchsorted(edges, low, "right") : np.searchsorted(edges, high)]
            first[inner - low] = inked[inner - low]
            last[inner - low - 1] = inked[inner - low - 1]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            hashes.append(run_hashes(data, s, e, self.fold))
            starts.append(s + low)
            ends.append(e + low)
        none = np.zeros(0, np.int64)
        self._words = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self._starts = np.concatenate(starts) if starts else none
        self._ends = np.concatenate(ends) if ends else none
        self._first = np.searchsorted(self._starts, edges)

    @property
    def words(self) -> np.ndarray:
        """Hash of each word, in order."""
        if self._words is None:
            self._find_words()
        return self._words

    @property
    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end byte of each word."""
        self.words  # noqa: B018
        return self._starts, self._ends

    @property
    def first(self) -> np.ndarray:
        """Number of the first word of each text, and at the end of all words."""
        self.words  # noqa: B018
        return self._first

    @property
    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.first)

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Per text, the sum of a value for each byte."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.limits])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window of ``size`` words that begins at each word, and whether it lies
        within one text."""
        words, n = self.words, len(self.words)
        total = np.zeros(n, U64)
        for j in range(min(size, n)):
            total[: n - j] += words[j:] * U64(pow(0xA0761D6478BD642F, j + 1, 2**64))
        left = np.repeat(self.first[1:], self.counts) - np.arange(n)
        return mix(total + U64(size)), left >= size


def batches(
    record: pa.RecordBatch, text: str, fold: bool, most_bytes: int = 4 * PIECE_BYTES
) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of a record batch of at most about ``most_bytes`` of text, with their texts."""
    column = record.column(text)
    if column.type != pa.string() and column.type != pa.large_string():
        column = column.cast(pa.large_string())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes) - 1) // most_bytes if len(sizes) else np.zeros(0)
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        if high > low:
            part = record.slice(low, high - low)
            yield part, Texts(column.slice(low, high - low), fold)
    give_back()


def give_back() -> None:
    """Return freed memory to the system. A worker waits for its next task, of this step or a later one,
    beside others on its executor, and would keep what its largest batch took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)
