"""Removes passages that occur in an earlier document, found by difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm import chunks as C
from candlewick.llm import textops as X

WINDOW = 13
#: Every difference modulo the period is one of two members of its cover.
PERIOD, COVER = 7, (0, 1, 3)

_BYTES_A_WORD = 6.0


class _Passages:
    """The words of a chunk's texts, and their anchors: windows of WINDOW - PERIOD + 1 words at positions of the cover.

    Two equal stretches of WINDOW words, wherever each begins, have such an anchor at the same distance from their
    beginnings, for some distance below PERIOD: the difference of their beginnings is that of two members of the cover.
    """

    def __init__(self, texts: pa.Array):
        parts = list(X.slices(texts, 1 << 62))
        self.part = parts[0] if parts else X.Slice(np.zeros(0, np.uint8), np.zeros(1, np.int64), (0, 0))
        self.words = X.Words(self.part)
        self.texts = self.words.texts()
        length = WINDOW - PERIOD + 1
        hashes, at = X.windows(self.words, length)
        place = at - self.words.first[self.texts[at]] if len(at) else at
        keep = np.isin(place % PERIOD, COVER)
        self.anchors, self.anchor_at = hashes[keep], at[keep]

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        return self.anchors, self.texts[self.anchor_at]

    def candidates(self, bits: list | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first words of the windows that an anchor found in another text extends to."""
        distinct, _, place = C.distinct_tokens(*self.tokens())
        shared = C.unpack(bits, C.bucket_bounds(distinct, buckets))[place]
        hashes, at = X.windows(self.words, WINDOW)
        if not len(at):
            return hashes, at
        near = X.spread(np.maximum(self.anchor_at[shared] - PERIOD + 1, 0), PERIOD, len(self.texts))[at]
        return hashes[near], at[near]


def _entries(hashes: np.ndarray, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's windows: the distinct hashes and the least id of each, by bucket and id; the bounds of the buckets; each window's place."""
    order = np.argsort(hashes)
    begins = C.first_of_equal(hashes[order])
    if not len(begins):
        return hashes, ids, np.zeros(buckets + 1, np.int64), np.zeros(0, np.int64)
    distinct, least = hashes[order][begins], np.minimum.reduceat(ids[order], begins)
    bucket = ((distinct >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    arranged = np.lexsort((distinct, least, bucket))
    rank = np.empty(len(arranged), np.int64)
    rank[arranged] = np.arange(len(arranged))
    marks = np.zeros(len(hashes), np.int64)
    marks[begins] = 1
    place = np.empty(len(hashes), np.int64)
    place[order] = rank[np.cumsum(marks) - 1]
    return distinct[arranged], least[arranged], np.searchsorted(bucket[arranged], np.arange(buckets + 1)), place


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with ``n_words``, ``n_removed`` and ``kept``, the words that stay, joined by one space.

    Words are runs without white space, unchanged. A word goes if a window of 13 words that covers it also starts in a
    document with a smaller id; windows are judged on the input. So of a passage that many documents share, the document
    with the smallest id keeps it, and rows with equal ids don't remove each other's words. A row without an id neither
    loses words nor takes any; null and empty texts have no words. Other columns are carried along, whatever their
    names; ``n_words``, ``n_removed`` and ``kept`` of the input are replaced. Ids are integers. Texts may have any length; one
    is never cut.

    Anchors that no other text has are dropped by an exchange of a few bytes each; only windows around the others are
    compared, by 64-bit hashes, for the least id that has them.
    """
    docs = docs.drop("n_words", "n_removed", "kept")
    fields = [*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)
    chunks, buckets = C.store(docs, text_col, _BYTES_A_WORD)

    def passages(blob: bytes) -> tuple[pa.RecordBatch, _Passages, np.ndarray, np.ndarray]:
        rows = C.rows_of(blob)
        ids = rows.column(at_id)
        missing = np.asarray(ids.is_null())
        return rows, _Passages(rows.column(at_text)), np.asarray(ids.fill_null(0).cast(pa.int64())), missing

    def tokens_of(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return _Passages(rows.column(at_text)).tokens()

    def windows_of(blob: bytes, bits: list | None):
        rows, found, ids, missing = passages(blob)
        hashes, at = found.candidates(bits, buckets)
        with_id = ~missing[found.texts[at]]
        hashes, at = hashes[with_id], at[with_id]
        return rows, found, at, ids[found.texts[at]], _entries(hashes, ids[found.texts[at]], buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob, bits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                _, _, _, _, (hashes, least, bounds, _) = windows_of(blob.as_py(), bits)
                used = np.flatnonzero(np.diff(bounds)).tolist()
                cut = [(bounds[b], bounds[b + 1]) for b in used]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int32()), pa.array([chunk] * len(used), pa.int64()), X.binaries([hashes[i:j].astype("<u8").tobytes() for i, j in cut]), X.binaries([C.squeeze(least[i:j]) for i, j in cut])],
                    ["bucket", "chunk", "tokens", "holders"],
                )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, bits, earlier in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                rows, found, at, ids, (_, least, bounds, place) = windows_of(blob.as_py(), bits)
                gone = np.zeros(len(found.texts), bool)
                if len(at):
                    lesser = C.unpack(earlier, bounds)[place] | (ids > least[place])
                    gone = X.spread(at[lesser], WINDOW, len(found.texts))
                words, data = found.words, found.part.data.tobytes()
                kept, removed = [], []
                for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                    out = gone[a:b]
                    removed.append(int(out.sum()))
                    spans = (np.flatnonzero(~out) + a).tolist() if removed[-1] else ()
                    kept.append(b" ".join([data[words.starts[w] : words.ends[w]] for w in spans]) if removed[-1] else b" ".join(data[found.part.offsets[i] : found.part.offsets[i + 1]].split()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(words.counts(), pa.int64()), pa.array(removed, pa.int64()), X.binaries(kept).cast(pa.string())], names=[f.name for f in fields])

    shared = C.written(C.shared_tokens(chunks, tokens_of, buckets), "anchors")
    marked = chunks.select("chunk", "blob").join(shared, "chunk", "left")
    lesser = C.least_holders(marked.select("chunk", "blob", "bits").mapInArrow(send, "bucket int, chunk bigint, tokens binary, holders binary"))
    marked = marked.join(lesser.withColumnRenamed("bits", "lesser"), "chunk", "left")
    return marked.select("chunk", "blob", "bits", "lesser").mapInArrow(remove, T.StructType(fields))


def trimmed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with the text of each row that loses words replaced by the words that stay; a text that loses none is unchanged."""
    own, text = C.numbered(docs), C.number_of(docs, text_col)
    found = substring_dedup(own, C.number_of(docs, id_col), text)
    return C.restored(found.withColumn(text, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(text))), docs)
