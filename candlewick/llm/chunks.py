"""Documents packed into chunks, and exchanges of hashed tokens between chunks.

Operators that must know which tokens occur in other documents send, for each chunk, its distinct tokens to buckets by
hash and get bits back. A token costs a few bytes in the shuffle at any size of the input, one of a hot document or passage crosses it once a
chunk, and what comes back is a bit each. Chunks are written once, bucketed, to the folder that the cluster names in
spark.checkpoint.dir: their numbers stay the same when a task runs again, and joins on them don't move the texts.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm import textops as X
from candlewick.sources.shared import shared_folder, shared_path, written, written_by

__all__ = ["shared_folder", "written", "written_by"]

#: The least bytes of text in a chunk, the least tokens that a bucket should have, and how many tokens a chunk should send
#: to a bucket: chunks and buckets grow with the square root of the text, so that many cross the shuffle in one row.
CHUNK_BYTES, BUCKET_TOKENS, ROW_TOKENS = 1 << 20, 1 << 18, 16
#: Bytes of text in a bucket of a stored table.
STORED_BYTES = 256 << 20
#: Keys with a share of one in HOT of all rows or more: there are HOT at most.
HOT = 1000


def layout(total: int, bytes_a_token: float) -> tuple[int, int]:
    """Bytes of a chunk, and the number of buckets, for so much text."""
    tokens = total / bytes_a_token
    in_chunk = max(CHUNK_BYTES / bytes_a_token, math.sqrt(ROW_TOKENS * tokens / 4))
    return int(in_chunk * bytes_a_token), max(8, int(tokens / max(BUCKET_TOKENS, ROW_TOKENS * tokens / in_chunk)))


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ..., which no operator's own names meet."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def restored(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``numbered(like)`` under their first names."""
    return df.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(like.columns)))


def number_of(df: DataFrame, name: str) -> str:
    return f"c{df.columns.index(name)}"


def join_each(rows: DataFrame, one_each: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with one_each, which has a row for each key of theirs and counts their rows in column n; total is its sum.

    Keys that hold many rows, HOT at most, are joined by broadcast, so they stay spread as they are; the others by shuffle.
    """
    hot = F.col("n") * HOT >= total
    near = rows.join(F.broadcast(one_each.where(hot).drop("n")), key)
    far = rows.join(F.broadcast(one_each.where(hot).select(key)), key, "left_anti").join(one_each.where(~hot).drop("n"), key)
    return near.unionByName(far)


def chunked(docs: DataFrame, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Columns chunk, blob: the rows of docs, some after another, as compressed Arrow data. A text is never cut."""

    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal chunk, size
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(rows)
            made = pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "blob"])
            chunk += 1
            size = 0
            held.clear()
            return made

        for batch in batches:
            for part in X.slices(batch.column(at), CHUNK_BYTES):
                if held and size + len(part.data) > chunk_bytes:
                    yield out()
                held.append(batch.slice(part.rows[0], len(part)))
                size += len(part.data)
        if held:
            yield out()

    return docs.mapInArrow(run, "chunk bigint, blob binary")


def store(docs: DataFrame, text_col: str, bytes_a_token: float) -> tuple[DataFrame, int]:
    """The chunks of docs as a bucketed table, and the number of buckets for exchanges of their tokens.

    The frame knows its files, so the catalog forgets the table at once.
    """
    spark, name = docs.sparkSession, f"chunks_{uuid.uuid4().hex}"
    total = docs.agg(F.sum(F.octet_length(text_col).cast("bigint"))).first()[0] or 0
    chunk_bytes, buckets = layout(total, bytes_a_token)
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    n = min(most, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // STORED_BYTES)))
    chunked(docs, text_col, chunk_bytes).repartition(n, "chunk").write.bucketBy(n, "chunk").option("path", shared_path(spark, "chunks")).saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return stored, buckets


def rows_of(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def bucket_bounds(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's tokens begin among sorted tokens, and the end."""
    return np.searchsorted((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))


def first_of_equal(tokens: np.ndarray) -> np.ndarray:
    """Where runs of equal tokens begin among sorted ones."""
    return np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, np.int64)


def distinct_tokens(tokens: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens in order, the first and last text of each, as rows, and for each given token its place among them."""
    order = np.argsort(tokens)
    ordered, of = tokens[order], texts[order]
    begins = first_of_equal(ordered)
    if not len(begins):
        return ordered, np.zeros((2, 0), np.int64), np.zeros(0, np.int64)
    marks = np.zeros(len(ordered), np.int64)
    marks[begins] = 1
    place = np.empty(len(ordered), np.int64)
    place[order] = np.cumsum(marks) - 1
    return ordered[begins], np.array([np.minimum.reduceat(of, begins), np.maximum.reduceat(of, begins)]), place


#: Of the rows of a chunk: tokens and the texts they are in.
TokensOf = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


#: A number of texts of this or more is counted as this.
MOST_COUNTED = 65_535


def shared_tokens(chunks: DataFrame, tokens_of: TokensOf, buckets: int, counted: bool = False) -> DataFrame:
    """Columns chunk, bits: for the distinct tokens of the chunk, by bucket, whether each is in two texts or more, packed.

    If counted, 16-bit numbers of the texts instead; then tokens_of gives each token of a text once. A bucket compares
    32 bits of each token, so with the bucket's own bits a chance meeting of different tokens has a probability of 2**-14
    at any size; it can only add a bit or to a number, the same for all texts, and callers compare whole hashes later.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens, (first, last), place = distinct_tokens(*tokens_of(rows_of(blob.as_py())))
                own = np.minimum(np.bincount(place, minlength=len(tokens)), MOST_COUNTED).astype("<u2") if counted else first != last
                bounds = bucket_bounds(tokens, buckets)
                short = tokens.astype("<u4")
                used = np.flatnonzero(np.diff(bounds)).tolist()
                cut = [(bounds[b], bounds[b + 1]) for b in used]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int32()), pa.array([chunk] * len(used), pa.int64()), X.binaries([short[i:j].tobytes() for i, j in cut]), X.binaries([(own[i:j] if counted else np.packbits(own[i:j])).tobytes() for i, j in cut])],
                    ["bucket", "chunk", "tokens", "own"],
                )

    def meet(rows: pa.Table) -> pa.Table:
        given = [np.frombuffer(x, "<u4") for x in rows.column("tokens").to_pylist()]
        own = [unpacked(x, len(t), counted) for x, t in zip(rows.column("own").to_pylist(), given, strict=True)]
        order = np.argsort(every := np.concatenate(given))
        begins = first_of_equal(every[order])
        lengths = np.diff(np.append(begins, len(every)))
        weights = np.concatenate(own).astype(np.int64) if counted else np.concatenate(own).astype(np.int64) + 1
        total = np.empty(len(every), np.int64)
        total[order] = np.repeat(np.add.reduceat(weights[order], begins), lengths)
        result, at, bits = np.minimum(total, MOST_COUNTED).astype("<u2") if counted else total > 1, 0, []
        for x in given:
            part = result[at : at + len(x)]
            bits.append((part if counted else np.packbits(part)).tobytes())
            at += len(x)
        return pa.table([rows.column("chunk"), rows.column("bucket"), X.binaries(bits)], ["chunk", "bucket", "bits"])

    sent = chunks.select("chunk", "blob").mapInArrow(send, "bucket int, chunk bigint, tokens binary, own binary")
    return by_chunk(sent.groupBy("bucket").applyInArrow(meet, "chunk bigint, bucket int, bits binary"))


def by_chunk(bits: DataFrame) -> DataFrame:
    """One row per chunk; it has at most a row for each bucket."""
    return bits.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("bits"))


def unpacked(data: bytes, n: int, counted: bool) -> np.ndarray:
    return np.frombuffer(data, "<u2") if counted else np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def unpack(bits: list[dict] | None, bounds: np.ndarray, counted: bool = False) -> np.ndarray:
    """The bits or numbers of a chunk's tokens, given by ``by_chunk``, in the order of the tokens."""
    out = np.zeros(bounds[-1], np.int64 if counted else bool)
    for x in bits or []:
        i, j = bounds[x["bucket"]], bounds[x["bucket"] + 1]
        out[i:j] = unpacked(x["bits"], j - i, counted)
    return out


def least_holders(sent: DataFrame) -> DataFrame:
    """From columns bucket, chunk, tokens (64-bit), holders (compressed 64-bit ids): the bits of which tokens have a lesser holder elsewhere."""

    def meet(rows: pa.Table) -> pa.Table:
        given = [np.frombuffer(x, "<u8") for x in rows.column("tokens").to_pylist()]
        holders = np.concatenate([expand(x) for x in rows.column("holders").to_pylist()])
        order = np.argsort(every := np.concatenate(given))
        begins = first_of_equal(every[order])
        least = np.empty(len(every), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(holders[order], begins), np.diff(np.append(begins, len(every))))
        hit, bits, at = least < holders, [], 0
        for x in given:
            bits.append(np.packbits(hit[at : at + len(x)]).tobytes())
            at += len(x)
        return pa.table([rows.column("chunk"), rows.column("bucket"), X.binaries(bits)], ["chunk", "bucket", "bits"])

    return by_chunk(sent.groupBy("bucket").applyInArrow(meet, "chunk bigint, bucket int, bits binary"))


def squeeze(values: np.ndarray) -> bytes:
    """64-bit integers, compressed; equal ones side by side cost little."""
    return len(values).to_bytes(8, "little") + pa.compress(values.astype("<i8").tobytes(), codec="zstd", asbytes=True)


def expand(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), "<i8")
