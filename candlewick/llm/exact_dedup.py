"""Exact duplicates by an index of live digests: a cuckoo filter in each bucket, verified against the bucket's content."""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm import chunks as C

#: Fixed value: the white space that doesn't count.
WHITE = r"[\x20\x09-\x0D]+"

#: Slots of a filter's bucket; how often an insertion moves fingerprints before the filter is too full; its first size.
SLOTS, MOVES, LEAST_SIZE = 4, 200, 64
#: Rows that a bucket of the index has about, the least number of buckets, and the digests that a task holds before it sends them on.
BUCKET_ROWS, LEAST_BUCKETS, HELD = 1 << 16, 64, 1 << 16
#: An id that orders after all others stands for none.
NO_ID = (1 << 63) - 1

#: Of rows with equal digests the least of these stays: minus the length, id, row number.
Rank = tuple[int, int, int]
_PARTIAL = "bucket int, digest binary, n bigint, less bigint, id bigint, row bigint"
_ENTRIES = ("n", "less", "id", "row")


class CuckooIndex:
    """Live digests with the number of rows and the best row of each.

    ``filter`` has a 16-bit fingerprint of each live digest in one of two buckets, so most digests that aren't there are
    known not to be from it alone. A hit is verified against ``content``, whose buckets hold the whole digests. Where an
    insertion finds no free slot, the filter is built anew, twice as large, from the digests stored there.
    """

    def __init__(self, size: int = LEAST_SIZE, filter_: bytes | None = None):
        self.filter = array("H", filter_ if filter_ is not None else bytes(2 * SLOTS * size))
        self.mask = len(self.filter) // SLOTS - 1
        self.content: dict[int, list[list]] = {}  # by home bucket of the largest filter: entries digest, n, rank
        self.live, self.verified, self.resized, self._turn = 0, 0, 0, 0

    @staticmethod
    def _home(digest: bytes) -> tuple[int, int]:
        """64 bits and a fingerprint that isn't 0, from bits that don't choose the index's bucket."""
        home, print_ = struct.unpack_from("<QH", digest, 8)
        return home, print_ or 1

    def _other(self, i: int, print_: int) -> int:
        return (i ^ (print_ * 0x5BD1E995)) & self.mask

    def may_have(self, digest: bytes) -> bool:
        home, print_ = self._home(digest)
        i = home & self.mask
        j = self._other(i, print_)
        return print_ in self.filter[SLOTS * i : SLOTS * i + SLOTS] or print_ in self.filter[SLOTS * j : SLOTS * j + SLOTS]

    def find(self, digest: bytes) -> list | None:
        """The entry of a live digest. Of the content only the bucket of a hit is read."""
        if not self.may_have(digest):
            return None
        self.verified += 1
        return next((e for e in self.content.get(self._home(digest)[0], ()) if e[0] == digest), None)

    def _put(self, i: int, print_: int) -> bool:
        for at in range(SLOTS * i, SLOTS * i + SLOTS):
            if not self.filter[at]:
                self.filter[at] = print_
                return True
        return False

    def _place(self, digest: bytes) -> bool:
        home, print_ = self._home(digest)
        i = home & self.mask
        if self._put(i, print_) or self._put(i := self._other(i, print_), print_):
            return True
        for _ in range(MOVES):
            self._turn += 1
            at = SLOTS * i + self._turn % SLOTS
            print_, self.filter[at] = self.filter[at], print_
            i = self._other(i, print_)
            if self._put(i, print_):
                return True
        return False

    def _resize(self) -> None:
        size = self.mask + 1
        while True:
            size, self.resized = 2 * size, self.resized + 1
            self.filter, self.mask = array("H", bytes(2 * SLOTS * size)), size - 1
            if all(self._place(e[0]) for held in self.content.values() for e in held):
                return

    def add(self, digest: bytes, n: int, rank: Rank | None) -> None:
        """n more rows of a digest, of which the best one has this rank."""
        entry = self.find(digest)
        if entry is not None:
            entry[1] += n
            if rank is not None and (entry[2] is None or rank < entry[2]):
                entry[2] = rank
            return
        self.content.setdefault(self._home(digest)[0], []).append([digest, n, rank])
        self.live += 1
        if not self._place(digest):
            self._resize()

    def remove(self, digest: bytes, n: int, rank: Rank) -> None:
        """n rows fewer, of which the best one has this rank. Without rows a digest leaves the filter; without its best row it has none until one is added."""
        entry = self.find(digest)
        if entry is None:
            return
        entry[1] -= n
        if entry[1] <= 0:
            home, print_ = self._home(digest)
            i = home & self.mask
            for b in (i, self._other(i, print_)):
                own = self.filter[SLOTS * b : SLOTS * b + SLOTS]
                if print_ in own:
                    self.filter[SLOTS * b + own.index(print_)] = 0
                    break
            held = self.content[home]
            held.remove(entry)
            if not held:
                del self.content[home]
            self.live -= 1
        elif entry[2] is not None and rank <= entry[2]:
            entry[2] = None

    def entries(self) -> list[list]:
        return [e for held in self.content.values() for e in held]

    def put_back(self, entries: Iterator[tuple[bytes, int, Rank | None]]) -> None:
        """The stored content of a filter that was read again."""
        for digest, n, rank in entries:
            self.content.setdefault(self._home(digest)[0], []).append([digest, n, rank])
            self.live += 1


def _ranks(table: pa.Table | pa.RecordBatch) -> list[Rank | None]:
    return [None if x is None else (x, i, r) for x, i, r in zip(*(table.column(c).to_pylist() for c in ("less", "id", "row")), strict=True)]


def bucket_of(digest: bytes, buckets: int) -> int:
    return int.from_bytes(digest[:8], "big") * buckets >> 64


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns row, id, digest, less of each row of docs, written: a number, SHA-256 of the text without white space, minus the code points of the whole text."""
    own = C.numbered(docs)
    text = F.coalesce(F.col(C.number_of(docs, text_col)), F.lit(""))
    digest = F.unhex(F.sha2(F.regexp_replace(text, WHITE, "").cast("binary"), 256))
    rows = own.select(F.monotonically_increasing_id().alias("row"), F.col(C.number_of(docs, id_col)).cast("bigint").alias("id"), digest.alias("digest"), (-F.length(text)).cast("bigint").alias("less"))
    return C.written(rows, "digests")


def combined(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows of one digest made one row in each task, by an index that is sent on when it holds HELD digests: a hot digest crosses the shuffle once a task or so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()

        def out() -> pa.RecordBatch:
            found = index.entries()
            return pa.RecordBatch.from_arrays(
                [pa.array([bucket_of(e[0], buckets) for e in found], pa.int32()), pa.array([e[0] for e in found], pa.binary()), pa.array([e[1] for e in found], pa.int64()), *(pa.array([e[2][k] for e in found], pa.int64()) for k in range(3))],
                ["bucket", "digest", *_ENTRIES],
            )

        for batch in batches:
            for digest, rank in zip(batch.column("digest").to_pylist(), _ranks(batch), strict=True):
                index.add(digest, 1, rank)
            if index.live >= HELD:
                yield out()
                index = CuckooIndex()
        yield out()

    return rows.select("digest", "less", F.coalesce("id", F.lit(NO_ID)).alias("id"), "row").mapInArrow(run, _PARTIAL)


@dataclass
class ExactIndex:
    """An index of documents in the shared folder.

    ``rows`` (row, id, digest, less) are the live rows. ``table`` has one row for each bucket of digests: bucket, filter
    (its cuckoo filter), digests, and the numbers n, less, id, row of each digest as arrays, null where a digest has no
    best row yet. The number of buckets stays as it was when the index was made, unless ``grown`` makes a larger one.
    """

    rows: DataFrame
    table: DataFrame
    buckets: int

    def _changed(self, added: DataFrame | None, removed: DataFrame | None) -> DataFrame:
        """The table after rows (of ``combined``) were taken off and others added: the filters are read, changed and written."""
        sides = [x.withColumn("sign", F.lit(s)) for x, s in ((removed, -1), (added, 1)) if x is not None]
        changes = sides[0] if len(sides) == 1 else sides[0].union(sides[1])

        def merge(changes: pa.Table, stored: pa.Table) -> pa.Table:
            bucket = (changes if changes.num_rows else stored).column("bucket")[0].as_py()
            if stored.num_rows:
                index = CuckooIndex(filter_=stored.column("filter")[0].as_py())
                numbers = [stored.column(c)[0].as_py() for c in _ENTRIES]
                index.put_back((d, n, None if x is None else (x, i, r)) for d, n, x, i, r in zip(stored.column("digests")[0].as_py(), *numbers, strict=True))
            else:
                index = CuckooIndex()
            for digest, n, rank, sign in sorted(zip(changes.column("digest").to_pylist(), changes.column("n").to_pylist(), _ranks(changes), changes.column("sign").to_pylist(), strict=True), key=lambda x: x[3]):
                if sign > 0:
                    index.add(digest, n, rank)
                else:
                    index.remove(digest, n, rank)
            found = index.entries()
            return pa.table(
                [pa.array([bucket], pa.int32()), pa.array([index.filter.tobytes()], pa.binary()), pa.array([[e[0] for e in found]], pa.list_(pa.binary())), pa.array([[e[1] for e in found]], pa.list_(pa.int64())),
                 *(pa.array([[None if e[2] is None else e[2][k] for e in found]], pa.list_(pa.int64())) for k in range(3))],
                ["bucket", "filter", "digests", *_ENTRIES],
            )

        schema = "bucket int, filter binary, digests array<binary>, n array<bigint>, less array<bigint>, id array<bigint>, row array<bigint>"
        return C.written(changes.groupBy("bucket").cogroup(self.table.groupBy("bucket")).applyInArrow(merge, schema), "exact-index")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ExactIndex:
        """The index with more documents. Their rows are numbered from the largest number on."""
        base = self.rows.agg(F.max("row")).first()[0]
        rows = digests(docs, id_col, text_col)
        rows = rows if base is None else rows.withColumn("row", F.col("row") + base + 1)
        return ExactIndex(C.written(self.rows.unionByName(rows), "exact-rows"), self._changed(combined(rows, self.buckets), None), self.buckets)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> ExactIndex:
        """The index without the rows of some ids. Digests that lose all rows leave their filter; those that lose their best row get the best of the rows that stay."""
        gone = ids.select(F.col(id_col).cast("bigint").alias("id")).where("id is not null").distinct()
        rows = C.written(self.rows.join(gone, "id", "left_anti"), "exact-rows")
        left = ExactIndex(rows, self._changed(None, combined(self.rows.join(gone, "id", "left_semi"), self.buckets)), self.buckets)
        open_ones = left.entries().where("less is null").select("digest")
        again = combined(rows.join(open_ones, "digest", "left_semi"), self.buckets).withColumn("n", F.lit(0).cast("bigint"))
        return ExactIndex(rows, left._changed(again, None), self.buckets)

    def entries(self) -> DataFrame:
        """Columns digest, n, less, id (null for none), row: the live digests, the rows of each and its best row."""
        zipped = self.table.select(F.explode(F.arrays_zip("digests", *_ENTRIES)).alias("x"))
        return zipped.select(F.col("x.digests").alias("digest"), "x.n", "x.less", F.nullif(F.col("x.id"), F.lit(NO_ID)).alias("id"), "x.row")

    def groups(self) -> DataFrame:
        """Columns row, id, keep_id, group_size, kept, digest of each live row.

        Digests that hold many rows are joined by broadcast, the others by shuffle.
        """
        each = self.entries().select("digest", "n", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"))
        total = self.table.agg(F.sum(F.aggregate("n", F.lit(0).cast("bigint"), lambda a, b: a + b))).first()[0] or 0
        return C.join_each(self.rows, each, "digest", total).select("row", "id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")


def exact_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ExactIndex:
    """An index of documents, with buckets of some BUCKET_ROWS rows."""
    rows = digests(docs, id_col, text_col)
    buckets = max(LEAST_BUCKETS, rows.count() // BUCKET_ROWS)
    empty = docs.sparkSession.createDataFrame([], "bucket int, filter binary, digests array<binary>, n array<bigint>, less array<bigint>, id array<bigint>, row array<bigint>")
    made = ExactIndex(rows, empty, buckets)
    return ExactIndex(rows, made._changed(combined(rows, buckets), None), buckets)


def grown(index: ExactIndex) -> ExactIndex:
    """The same index with as many buckets as its rows ask for now, built from the stored rows."""
    buckets = max(LEAST_BUCKETS, index.rows.count() // BUCKET_ROWS)
    return ExactIndex(index.rows, ExactIndex(index.rows, index.table.limit(0), buckets)._changed(combined(index.rows, buckets), None), buckets)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, digest.

    Texts are equal when they are so without white space; a null text is an empty one, and both equal one of white space
    alone. Of equal texts the row with the most code points of the whole text stays, then the one with the smallest id,
    rows without an id last; of rows that are the same in this, too, exactly one. keep_id is the id of the row that stays.
    Texts may have any length, other columns don't matter, an empty table gives none. Digests are SHA-256.

    Rows of 32-byte digests take the place of texts in all that follows. Each task combines its own, buckets by leading
    bits of the digest insert them in a filter; each row then meets its digest's entry.
    """
    found = exact_index(docs, id_col, text_col).groups()
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "digest")
