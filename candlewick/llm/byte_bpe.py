"""Byte-level BPE: a minimal perfect hash for pre-tokens in the vocabulary, a heap over linked bytes for the others."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from candlewick.llm import pretokens
from candlewick.llm import textops as X


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """A minimal perfect hash by displacement: a key's bucket names the seed that sends its keys to slots of their own.

    Large buckets choose first; a bucket of one key takes a free slot, stored in place of a seed. Slot s holds the key
    ``keys[slots[s]]``; a lookup compares it, so strings outside the set give -1.
    """

    PER_BUCKET, TRIED_AT_ONCE = 3, 256

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.keys, self.buckets = keys, max(1, n // self.PER_BUCKET)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, n)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        size = np.diff(first)
        self.seeds, self.slots = np.zeros(self.buckets, np.int64), np.full(n, -1, np.int64)
        tries = np.arange(self.TRIED_AT_ONCE, dtype=np.int64)
        for b in np.argsort(-size, kind="stable")[: np.count_nonzero(size > 1)].tolist():
            members, base = order[first[b] : first[b + 1]], 0
            while True:
                s = np.sort(self._slots(h[members], (tries + base)[:, None]), axis=1)
                good = np.flatnonzero((self.slots[s] < 0).all(axis=1) & (s[:, 1:] != s[:, :-1]).all(axis=1))
                if len(good):
                    break
                base += self.TRIED_AT_ONCE
            self.seeds[b] = base + good[0]
            self.slots[self._slots(h[members], self.seeds[b])] = members
        alone, free = np.flatnonzero(size == 1), np.flatnonzero(self.slots < 0)
        self.seeds[alone], self.slots[free] = -1 - free, order[first[alone]]

    def _slots(self, h: np.ndarray, seeds) -> np.ndarray:
        seeds = np.asarray(seeds)
        mixed = (X.mix(h ^ X.mix(seeds.astype(np.uint64) + np.array([1], np.uint64))) % np.uint64(self.n)).astype(np.int64)
        return np.where(seeds < 0, -1 - seeds, mixed)

    def lookup(self, strings: list[bytes]) -> np.ndarray:
        """The index of each string among the keys, else -1."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, strings), np.uint64, len(strings))
        at = self.slots[self._slots(h, self.seeds[(h % np.uint64(self.buckets)).astype(np.int64)])]
        keys = self.keys
        return np.fromiter((i if keys[i] == s else -1 for i, s in zip(at.tolist(), strings, strict=True)), np.int64, len(strings))


class Bpe:
    def __init__(self, tokens: list[bytes]):
        self.tokens, self.hash = tokens, PerfectHash(tokens)
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.bytes = [self.ranks[bytes([i])] for i in range(256)]
        self.pairs = [self.ranks.get(bytes([i, j]), -1) for i in range(256) for j in range(256)]
        self.packed = [i.to_bytes(4, "little") for i in range(len(tokens))]
        self.memo = pretokens.Memo(self.resolve)

    def merge(self, word: bytes) -> list[int]:
        """The ids of a pre-token outside the vocabulary: joins the pair of the least rank, the leftmost first, while any is known.

        The heap holds rank, start and end of each known pair, packed into one integer.
        """
        rank, n, pairs = self.ranks.get, len(word), self.pairs
        bits = n.bit_length()
        mask, twice = (1 << bits) - 1, 2 * bits
        heap, left = [], word[0]
        for i in range(1, n):
            right = word[i]
            if (r := pairs[left << 8 | right]) >= 0:
                heap.append(r << twice | (i - 1) << bits | i + 1)
            left = right
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        ids = [self.bytes[c] for c in word]
        before, end = list(range(-1, n)), list(range(1, n + 1))  # end: of the part that starts here, 0 once it is gone
        end.append(0)
        while heap:
            x = pop(heap)
            i, stop = x >> bits & mask, x & mask
            j = end[i]
            if not j or end[j] != stop:  # one of its parts has grown or gone
                continue
            ids[i], end[i], end[j], before[stop] = x >> twice, stop, 0, i
            if stop < n and (r := rank(word[i : end[stop]])) is not None:
                push(heap, r << twice | i << bits | end[stop])
            h = before[i]
            if h >= 0 and (r := rank(word[h:stop])) is not None:
                push(heap, r << twice | h << bits | stop)
        return [x for x, e in zip(ids, end, strict=False) if e]

    def resolve(self, words: list[bytes]) -> list[bytes]:
        packed = self.packed
        return [packed[i] if i >= 0 else b"".join([packed[j] for j in self.merge(w)]) for i, w in zip(self.hash.lookup(words).tolist(), words, strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_made: dict[str, Bpe] = {}


def _bpe(name: str) -> Bpe:
    if name not in _made:
        _made.clear()
        _made[name] = Bpe(read_ranks(SparkFiles.get(name)))
    return _made[name]


def shipped(docs: DataFrame, path: str) -> str:
    """Sends a vocabulary file to all executors; its name there."""
    docs.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def byte_bpe(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``ids`` (binary, little-endian unsigned 32-bit integers) and ``decoded`` (binary, the bytes of these ids).

    ranks_path: a file of base64 byte strings and ranks. Whole texts are encoded, each match of the usual pre-token
    pattern on its own, without special tokens, however long. Null and empty texts have no ids. Of two pairs of one rank
    the left one is joined first. Ids of rows aren't looked at: null and
    repeated ones give a row each. Only the two columns are read, so other columns don't matter. No shuffle.
    """
    name, few = shipped(docs, ranks_path), docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(name)
        for batch in batches:
            for part in X.slices(batch.column(1)):
                found = pretokens.encode(part, bpe.memo)
                a, b = part.rows
                ids = [found.of(i) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), X.binaries([x.tobytes() for x in ids]), X.binaries([bpe.decode(x) for x in ids])], [id_col, "ids", "decoded"])

    return few.mapInArrow(run, f"{id_col} {few.schema[id_col].dataType.simpleString()}, ids binary, decoded binary")
