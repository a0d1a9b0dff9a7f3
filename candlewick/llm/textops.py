"""Vectorized work on the UTF-8 bytes of many texts at once, as tasks get them from Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

#: The white space of the word rule, [\x20\x09-\x0D].
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)

IS_WHITE = np.zeros(256, bool)
IS_WHITE[list(WHITE)] = True
_seeds = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
CODES = _seeds
LOWER = np.arange(256)
LOWER[ord("A") : ord("Z") + 1] += 32
LOWER_CODES = _seeds[LOWER]


class Slice:
    """Some texts: ``data`` are their bytes, text i is ``data[offsets[i]:offsets[i + 1]]``; ``rows`` is (first, end) in the batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: tuple[int, int]):
        self.data, self.offsets, self.rows = data, offsets, rows

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The values of a string or binary column, a null as an empty one, in order."""
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield Slice(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], (at, end))
        at = end


_powers: list[np.ndarray] = []


def _power_table(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; they are kept up to the size of a slice."""
    if _powers and len(_powers[0]) >= n:
        return _powers
    size = max(n, SLICE_BYTES + (1 << 18))
    made = []
    for b in (_BASE, _INVERSE):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        made.append(np.cumprod(p))
    if size <= 4 * SLICE_BYTES:
        _powers[:] = made
    return made


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from one running sum of a polynomial modulo 2**64."""
    up, down = _power_table(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)


def edges(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true; no run crosses an offset."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[0] = cut[n] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    return np.flatnonzero(inside & (before | cut[:-1])), np.flatnonzero(inside & (after | cut[1:])) + 1


class Words:
    """The words of a slice: spans, hashes, and for text i the words ``first[i]`` up to ``first[i + 1]``."""

    def __init__(self, part: Slice, lower: bool = False):
        self.starts, self.ends = edges(~IS_WHITE[part.data], part.offsets)
        self.first = np.searchsorted(self.starts, part.offsets)
        self.hashes = span_hashes(part.data, self.starts, self.ends, LOWER_CODES if lower else CODES)
        self._running: tuple[np.ndarray, np.ndarray] | None = None

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def running(self) -> tuple[np.ndarray, np.ndarray]:
        """The running sum of a polynomial over the words' hashes, and the powers that bring a term back to power 0."""
        if self._running is None:
            up, down = _power_table(len(self.hashes) + 1)
            total = np.zeros(len(self.hashes) + 1, np.uint64)
            np.cumsum(self.hashes * up[: len(self.hashes)], out=total[1:])
            self._running = total, down
        return self._running

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def _salt(n: int) -> np.uint64:
    return np.uint64(n * int(_STEP) % (1 << 64))


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of all windows of n successive words inside a text, and the index of the first word of each.

    They come from one running sum of a polynomial over the words' hashes, which all lengths share: a window is the
    difference of two of its entries, brought back to the window's first word.
    """
    m = len(words.hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total, down = words.running()
    whole = np.ones(m, bool)
    for i in range(1, n):  # a window that starts fewer than n words before a text's end
        at = words.first[1:-1] - i
        whole[at[(at >= 0) & (at < m)]] = False
    at = np.flatnonzero(whole)
    return mix((total[at + n] - total[at]) * down[at] + _salt(n)), at


def fold(hashes: np.ndarray) -> np.ndarray:
    """The hash of a whole sequence of words, as ``windows`` gives it for that length."""
    up, _ = _power_table(len(hashes))
    return mix((hashes * up[: len(hashes)]).sum(keepdims=True, dtype=np.uint64) + _salt(len(hashes)))


def spread(firsts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` positions lie in a stretch of n from one of firsts."""
    marks = np.zeros(size + n + 1, np.int32)
    np.add.at(marks, firsts, 1)
    np.add.at(marks, firsts + n, -1)
    return np.cumsum(marks)[:size] > 0


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all stretches, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
