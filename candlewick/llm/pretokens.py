"""Splits texts into the pre-tokens of byte-level BPE, many texts at once, and collects the ids of distinct pre-tokens.

The split is that of the usual pattern, restated over runs of character classes (letter, number, white space, other): a
pre-token is a run, with the one space before it; of a longer run of white space only the last character can be that
space; and after a lone apostrophe that starts a pre-token, s, t, re, ve, m, ll or d belongs to it.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

import numpy as np

from candlewick.llm import textops as X

LETTER, NUMBER, WHITE, OTHER = 1, 2, 3, 4

#: Unicode's White_Space outside ASCII, and the endings that a lone apostrophe takes with it.
WIDE_WHITE = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

_table: list[np.ndarray] = []


def _classes() -> np.ndarray:
    if not _table:
        kinds = {"L": LETTER, "N": NUMBER}
        t = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        t[[*X.WHITE, *WIDE_WHITE]] = WHITE
        _table.append(t)
    return _table[0]


def split(part: X.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends in ``part.data`` of all pre-tokens, in order; none crosses a text's end."""
    data = part.data
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each character
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(chars) != len(lead):
        raise ValueError("a text isn't valid UTF-8")
    n, kind = len(chars), _classes()[chars]
    bounds = np.searchsorted(lead, part.offsets)
    begin = np.zeros(n + 1, bool)  # where a pre-token begins
    begin[1:-1] = kind[1:] != kind[:-1]
    begin[bounds] = True
    begin[n] = True
    text_start = np.zeros(n + 1, bool)
    text_start[bounds] = True
    # A run of white space before another run gives up its last character; a space goes to that run.
    after = np.flatnonzero(begin[:n] & ~text_start[:n] & (kind != WHITE))
    after = after[kind[after - 1] == WHITE]
    begin[after - 1] = True
    spaced = after[chars[after - 1] == 0x20]
    begin[spaced] = False
    # A lone apostrophe that begins a pre-token and is followed by an ending.
    lone = np.flatnonzero((chars == 0x27) & begin[:n])
    for i in lone[lone + 1 < n].tolist():
        if begin[i + 1] and not text_start[i + 1] and kind[i + 1] == LETTER:
            for ending in ENDINGS:
                j = i + 1 + len(ending)
                if j <= n and "".join(map(chr, chars[i + 1 : j])) == ending and not text_start[i + 2 : j].any():
                    begin[i + 1] = False
                    begin[j] = True
                    break
    cuts = np.append(lead, len(data))[np.flatnonzero(begin)]
    return cuts[:-1], cuts[1:]


class Ids:
    """The ids of the texts of a slice: ``flat[first[i]:first[i + 1]]`` are those of text i."""

    def __init__(self, flat: np.ndarray, first: np.ndarray):
        self.flat, self.first = flat, first

    def of(self, i: int) -> np.ndarray:
        return self.flat[self.first[i] : self.first[i + 1]]


def encode(part: X.Slice, resolve: Callable[[list[bytes]], list[bytes]]) -> Ids:
    """Encodes a slice: resolve gives the ids, as little-endian 32-bit integers, of each distinct pre-token."""
    starts, ends = split(part)
    if not len(starts):
        return Ids(np.zeros(0, "<u4"), np.zeros(len(part) + 1, np.int64))
    _, at, inverse = np.unique(X.span_hashes(part.data, starts, ends), return_index=True, return_inverse=True)
    raw = part.data.tobytes()
    found = resolve([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    places = np.cumsum(sizes) - sizes
    lengths = sizes[inverse]
    flat = np.frombuffer(b"".join(found), "<u4")[X.ragged(places[inverse], lengths)]
    total = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=total[1:])
    return Ids(flat, total[np.searchsorted(starts, part.offsets)])


class Memo:
    """Keeps the ids of so many pre-tokens at most; then it starts anew, so its size is bounded and nothing is lost."""

    def __init__(self, make: Callable[[list[bytes]], list[bytes]], most: int = 600_000):
        self.make, self.most, self.known = make, most, {}

    def __call__(self, tokens: list[bytes]) -> list[bytes]:
        known = self.known
        missing = [t for t in tokens if t not in known]
        if missing:
            if len(known) + len(missing) > self.most:
                known.clear()
                missing = tokens
            known.update(zip(missing, self.make(missing), strict=True))
        return [known[t] for t in tokens]
