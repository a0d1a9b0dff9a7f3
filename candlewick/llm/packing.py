"""Packs token sequences into windows of a fixed capacity by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from candlewick.llm import pretokens
from candlewick.llm import textops as X
from candlewick.llm.byte_bpe import shipped

CAPACITY = 1024
#: So many short pieces are shared out at a time.
BLOCK = 512


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Multiway differencing: shares the items out among k windows; the items of each window that has some.

    A partial partition is a descending list of the sums over 0 of its k windows. The two with the largest imbalances
    merge, the largest sums of one onto the smallest of the other, until one partition is left. An entry is a sum and,
    in its low 32 bits, a node: an item, or past the items a link of two nodes.
    """
    n, low = len(sizes), (1 << 32) - 1
    parts: list[list[int]] = [[s << 32 | i] for i, s in enumerate(sizes)]
    links: list[tuple[int, int]] = []
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, i), (_, j) = heapq.heappop(heap), heapq.heappop(heap)
        a, b = parts[i], parts[j]
        if len(a) < len(b):
            a, b = b, a
        for at, y in zip(range(k - 1, -1, -1), b, strict=False):
            if at < len(a):
                x = a[at]
                links.append((x & low, y & low))
                a[at] = ((x >> 32) + (y >> 32)) << 32 | n + len(links) - 1
            else:
                a.append(y)
        a.sort(reverse=True)
        parts[i], parts[j] = a, []
        heapq.heappush(heap, ((a[-1] >> 32 if len(a) == k else 0) - (a[0] >> 32), i))
    out = []
    for top in parts[heap[0][1]]:
        items, todo = [], [top & low]
        while todo:
            x = todo.pop()
            if x < n:
                items.append(x)
            else:
                todo.extend(links[x - n])
        out.append(sorted(items))
    return out


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows of at most capacity, as few as the sum needs; more of them whenever the largest is too large."""
    k = -(-sum(sizes) // capacity)
    while k:
        found = difference(sizes, k)
        if max(sum(sizes[i] for i in w) for w in found) <= capacity:
            return found
        k += max(1, k // 128)
    return []


class Tokens:
    """Ids as the library `tokenizers` gives them for a byte-level BPE file.

    The vocabulary and merges of that file are run by tiktoken, several times faster; the two agree if the merged strings
    have ascending ids in the order of the merges, which is checked here. Texts that contain an added token of the file
    are left to `tokenizers` itself, which also knows the token's flags.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        if whole.get("normalizer") is not None:
            raise ValueError("texts aren't normalized here")
        model = whole["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        unprinted = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(unprinted)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"]["".join(m)] for m in merges]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            raise ValueError("ids don't follow the order of the merges")
        named = [c for c in model["vocab"] if len(c) == 1] + ["".join(m) for m in merges]
        ranks = {bytes(byte[c] for c in t): model["vocab"][t] for t in named}
        self.core = tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.memo = pretokens.Memo(self.resolve)
        self.added = [t["content"] for t in whole.get("added_tokens") or [] if t["content"]]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def resolve(self, words: list[bytes]) -> list[bytes]:
        encode = self.core.encode_ordinary
        return [np.array(encode(w.decode()), "<u4").tobytes() for w in words]

    def with_added(self, texts: pa.Array) -> dict[int, np.ndarray]:
        """The ids of those texts that contain an added token, by position."""
        rows = sorted({i for t in self.added for i in pc.indices_nonzero(pc.match_substring(texts, t)).to_pylist()})
        return {i: np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4") for i in rows}


_made: dict[str, Tokens] = {}


def _tokens(name: str) -> Tokens:
    if name not in _made:
        _made[name] = Tokens(SparkFiles.get(name))
    return _made[name]


COLUMNS = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, block: int = BLOCK, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start (its document's ids before it), length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text, then end_id; a null or empty text has end_id alone. A document of
    capacity or more gives full windows, cut from its start; what is left, shorter than capacity, is shared out over
    windows with the other short pieces of its partition, block of them at a time. So only the last windows of a
    partition and the slack of a block are padding. A sequence id holds the partition's number above 2**33. Equal and
    null ids each give their own pieces. Among equal imbalances the earlier piece merges first. Other columns don't matter. No shuffle.
    """
    name, few = shipped(docs, tokenizer_path), docs.select(id_col, text_col)
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sequence = _tokens(name), TaskContext.get().partitionId() << 33
        waiting: list[tuple] = []
        rows: list[tuple] = []

        def share() -> None:
            nonlocal sequence
            for window in windows([len(p[2]) for p in waiting], capacity):
                at = 0
                for p in (waiting[i] for i in window):
                    rows.append((p[0], p[1], len(p[2]), p[2].tobytes(), p[3], sequence, at))
                    at += len(p[2])
                sequence += 1
            waiting.clear()

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            rows.clear()
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in X.slices(batch.column(1)):
                found = pretokens.encode(part, tokens.memo)
                special = tokens.with_added(batch.column(1).slice(part.rows[0], len(part)))
                names = batch.column(0).slice(part.rows[0], len(part)).to_pylist()
                for i, doc in enumerate(names):
                    ids = np.concatenate([special[i] if i in special else found.of(i), end])
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        if len(piece) == capacity:
                            rows.append((doc, start, capacity, piece.tobytes(), len(ids), sequence, 0))
                            sequence += 1
                        else:
                            waiting.append((doc, start, piece, len(ids)))
                            if len(waiting) == block:
                                share()
                yield out()
        if waiting:
            share()
            yield out()

    return few.mapInArrow(run, f"{id_col} {few.schema[id_col].dataType.simpleString()}, {COLUMNS}")
