"""Links documents whose word-shingle sets have a high Jaccard similarity, by T-occurrence search over inverted lists."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm import chunks as C
from candlewick.llm import textops as X
from candlewick.llm.components import components

WORDS, PERCENT = 5, 80
#: Documents that a task indexes and searches together; of each cluster so many are in all of its blocks.
BLOCK, PIVOTS = 256, 8

_BYTES_A_TOKEN = 15.0  # of text, for each token that is exchanged
_TASK_BYTES = 64 << 20  # of sets that a task searches


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n has in common with any set it links to, at least."""
    return -(-percent * n // 100)


def shingles(part: X.Slice) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in ascending order, one text after the other, and where each text's begin."""
    words = X.Words(part, lower=True)
    hashes, at = X.windows(words, WORDS)
    bounds, counts = np.searchsorted(at, words.first), words.counts()
    sets = []
    for i in range(len(part)):
        if counts[i] >= WORDS:
            sets.append(np.unique(hashes[bounds[i] : bounds[i + 1]]))
        elif counts[i]:
            sets.append(X.fold(words.hashes[words.first[i] : words.first[i + 1]]))
        else:
            sets.append(np.zeros(0, np.uint64))
    first = np.zeros(len(part) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=first[1:])
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), first


def _prefix(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For sets of n: of how many least shingles some must be shared with a linked set's, and of these how many at least.

    The first k shared shingles, in order, of two linked sets lie among the first n - least_overlap(n) + k of each. With
    k a fifth of n, and since the other set has at least percent of n shingles, min of both k is a fifth of that.
    """
    common = -(-percent * n // 100)
    k = np.maximum(1, n // 5)
    return np.minimum(n, n - common + k), np.maximum(1, common // 5)


class Lists:
    """Inverted lists of some sets: for each shingle the sets that have it, ascending."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(every, kind="stable")
        self.begins = C.first_of_equal(every[order])
        self.tokens, self.holders = every[order][self.begins], of[order]
        self.ends = np.append(self.begins[1:], len(every))

    def of(self, query: np.ndarray) -> list[list[int]]:
        """The lists of a query's shingles that have any, short ones first."""
        if not len(self.tokens):
            return []
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        at = at[np.argsort(self.ends[at] - self.begins[at], kind="stable")]
        return [self.holders[i:j].tolist() for i, j in zip(self.begins[at].tolist(), self.ends[at].tolist(), strict=True)]


def divide_skip(lists: list[list[int]], need: int, skip) -> Iterator[tuple[int, int]]:
    """The members of at least ``need`` lists, with their number: merges the short lists, probes the long ones.

    With the need - 1 longest lists set apart, a member must be in a short list; setting more than half of them apart
    pays only if they are much longer, so the number is chosen by the length of the longest. The heap over the short
    lists skips all members below the one that could still reach its share; skip(member) leaves a member out.
    """
    if len(lists) < need:
        return
    longest = len(lists[-1])
    apart = min(need - 1, int(need / (0.01 * max(1, longest).bit_length() + 1)))
    short, long = lists[: len(lists) - apart], lists[len(lists) - apart :]
    share = need - apart
    at = [0] * len(short)
    heap = [(x[0], i) for i, x in enumerate(short)]
    heapq.heapify(heap)
    while len(heap) >= share:
        least, popped = heap[0][0], []
        while heap and heap[0][0] == least:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= share:
            if not skip(least):
                found, left = len(popped), len(long)
                for x in long:
                    if found + left < need:
                        break
                    j = bisect_left(x, least)
                    found += j < len(x) and x[j] == least
                    left -= 1
                if found >= need:
                    yield least, found
            target = least + 1
        else:  # pop until one fewer than the share are out, then skip to the next in the heap
            while heap and len(popped) < share - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            target = heap[0][0]
        for i in popped:
            j = bisect_left(short[i], target, at[i])
            at[i] = j
            if j < len(short[i]):
                heapq.heappush(heap, (short[i][j], i))


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _links_in(sets: list[np.ndarray], percent: int) -> list[int]:
    """Union-find roots of the sets, linked directly or over others of them. The first is tried before a search.

    A search leaves out members that are linked already, over others or directly: they change no component.
    """
    parent, lists = list(range(len(sets))), Lists(sets)
    for q in range(1, len(sets)):
        own = sets[q]
        common = len(np.intersect1d(own, sets[0], assume_unique=True))
        if 100 * common >= percent * (len(own) + len(sets[0]) - common) > 0:
            parent[_root(parent, q)] = _root(parent, 0)
        if len({_root(parent, i) for i in range(q + 1)}) == 1:
            continue
        need = least_overlap(len(own), percent)
        for c, n in divide_skip(lists.of(own), need, lambda c: c >= q or _root(parent, c) == _root(parent, q)):
            if 100 * n >= percent * (len(own) + len(sets[c]) - n):
                a, b = sorted((_root(parent, c), _root(parent, q)))
                parent[b] = a
    return [_root(parent, i) for i in range(len(sets))]


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Columns id, n_shingles, and for rows that may have a link: key (of the whole set), tokens (binary, ascending 64-bit)."""
    few = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    chunks, buckets = C.store(few, "text", _BYTES_A_TOKEN)

    def sets_of(rows: pa.RecordBatch):
        part = next(X.slices(rows.column(1), 1 << 62), X.Slice(np.zeros(0, np.uint8), np.zeros(1, np.int64), (0, 0)))
        tokens, first = shingles(part)
        n = np.diff(first)
        length, need = _prefix(n, percent)
        named = ~np.asarray(rows.column(0).is_null())
        length = np.where(named, np.minimum(length, n), 0)
        taken = X.ragged(first[:-1], length)
        return tokens, first, n, need, tokens[taken], np.repeat(np.arange(len(n)), length)

    def tokens_of(rows: pa.RecordBatch):
        return sets_of(rows)[4:]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, bits in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows = C.rows_of(blob.as_py())
                tokens, first, n, need, prefix, of = sets_of(rows)
                distinct, _, place = C.distinct_tokens(prefix, of)
                shared = C.unpack(bits, C.bucket_bounds(distinct, buckets))[place]
                may = (np.bincount(of[shared], minlength=len(n)) >= need).tolist()
                own = [tokens[first[i] : first[i + 1]].astype("<u8").tobytes() if may[i] else None for i in range(len(n))]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(own, pa.binary())], ["id", "n_shingles", "tokens"])

    shared = C.shared_tokens(chunks, tokens_of, buckets)
    found = chunks.select("chunk", "blob").join(shared, "chunk", "left").select("blob", "bits").mapInArrow(keep, "id bigint, n_shingles bigint, tokens binary")
    return C.written(found.withColumn("key", F.when(F.col("tokens").isNotNull(), F.unhex(F.substring(F.sha2("tokens", 256), 1, 32)))), "sets")


def covered(sets: DataFrame, percent: int) -> DataFrame:
    """Of sets (id, tokens), all different, those with as many shingles that another one has as a link needs.

    Column rare: of the least_overlap complement's size and one more, the shingles that the fewest sets have, without
    those that no other set has. Linked sets have one of these in common, since the order is the same for all.
    """
    chunks, buckets = C.store(sets.select("id", "tokens"), "tokens", 8.0)

    def tokens_of(rows: pa.RecordBatch):
        own = rows.column(1).to_pylist()
        return np.frombuffer(b"".join(own), "<u8"), np.repeat(np.arange(len(own)), [len(x) // 8 for x in own])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, counts in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows = C.rows_of(blob.as_py())
                tokens, of = tokens_of(rows)
                distinct, _, place = C.distinct_tokens(tokens, of)
                count = C.unpack(counts, C.bucket_bounds(distinct, buckets), counted=True)[place]
                n = np.bincount(of, minlength=len(rows))
                stay = np.bincount(of[count > 1], minlength=len(rows)) >= -(-percent * n // 100)
                order = np.lexsort((tokens, count, of))
                rank = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
                rare = order[(rank < (n - -(-percent * n // 100) + 1)[of]) & (count[order] > 1)]
                each = np.searchsorted(of[rare], np.arange(len(rows) + 1))
                found = tokens[rare].astype("<u8")
                rare_ones = [found[i:j].tobytes() for i, j in zip(each[:-1].tolist(), each[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns, X.binaries(rare_ones)], ["id", "tokens", "rare"]).filter(pa.array(stay))

    counts = C.shared_tokens(chunks, tokens_of, buckets, counted=True)
    return C.written(chunks.select("chunk", "blob").join(counts, "chunk", "left").select("blob", "bits").mapInArrow(keep, "id bigint, tokens binary, rare binary"), "covered")


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column.to_pylist()]


def _each_rare(sets: DataFrame, *carried: str) -> DataFrame:
    """A row for each rare shingle of each set: token, and the carried integer columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = [np.frombuffer(x, "<i8") for x in part.column(0).to_pylist()]
                of = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), *(c.take(of) for c in part.columns[1:])], ["token", *carried])

    wide = [F.col(c).cast("bigint").alias(c) for c in carried]
    return sets.select("rare", *wide).mapInArrow(run, ", ".join(f"{c} bigint" for c in ("token", *carried)))


def _clusters(sets: DataFrame) -> DataFrame:
    """Columns node, component: sets that have a rare shingle in common, directly or over others; linked sets always do."""
    tokens = _each_rare(sets, "id")
    least = tokens.groupBy("token").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("token", "least")
    return components(tokens.join(least, "token").where("id > least").select(F.col("id").alias("a"), F.col("least").alias("b")))


def _placed(sets: DataFrame, block: int, total: int) -> DataFrame:
    """Columns id, cluster, size, blocks, block: each set of a cluster in one of the cluster's blocks, of about the given size.

    Sets with the same rarest shingle share a block, or a few, so that the shingles of a set lead to few. At most a quarter
    of a block, about, goes to one place, so that blocks are of like size.
    """
    clusters = _clusters(sets)
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    placed = clusters.join(sizes, "component").select(F.col("node").alias("id"), F.col("component").alias("cluster"), "size", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    placed = C.written(placed.join(sets.select("id", F.xxhash64(F.substring("rare", 1, 8)).alias("rarest")), "id"), "rarest")
    lists = placed.where("blocks > 1").groupBy("rarest").agg(F.count("*").alias("n"), F.ceil(F.count("*") * 4 / block).alias("pieces")).where("pieces > 1")
    hot = F.col("n") * C.HOT >= total  # at most so many, by broadcast: their sets stay spread
    near = placed.join(F.broadcast(lists.where(hot).select("rarest", "pieces")), "rarest", "left")
    far = near.where("pieces is null").drop("pieces").join(lists.where(~hot).select("rarest", "pieces"), "rarest", "left")
    piece = F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(1)))
    return near.where("pieces is not null").unionByName(far).withColumn("block", F.pmod(F.xxhash64("rarest", piece), F.col("blocks")).cast("int")).drop("rarest", "pieces")


def _asked(members: DataFrame, open_ones: DataFrame) -> DataFrame:
    """Columns id, cluster, block: the other blocks where a set has a rare shingle in common with an open one.

    Columns of members: id, cluster, block, rare. Shingles that lie in the same blocks, such as those of one passage, are
    taken as one before sets meet blocks, so there is a row or few for each block and none for each shingle of it.
    """
    own = C.written(_each_rare(members.join(open_ones, "id", "left_semi"), "id", "block"), "open-rare")
    lies = _each_rare(members, "cluster", "block").distinct().join(own.select("token").distinct(), "token", "left_semi")
    lies = C.written(lies, "lies")
    place = [F.xxhash64("cluster", "block"), F.xxhash64("block", "cluster")]
    marks = lies.groupBy("token").agg(F.count("*").alias("places"), F.bit_xor(place[0]).alias("x"), F.sum(place[1].cast("decimal(20,0)")).alias("y")).where("places > 1")
    marks = C.written(marks, "marks")
    same = marks.groupBy("places", "x", "y").agg(F.min("token").alias("one"))
    one_each = marks.join(same, ["places", "x", "y"]).select("token", "one")
    wanted = own.join(one_each, "token").select("id", F.col("block").alias("home"), "one").distinct()
    met = wanted.join(lies.withColumnRenamed("token", "one"), "one").where("block <> home")
    return met.select("id", "cluster", F.col("block").cast("int").alias("block")).distinct()  # of the type that members have: groups of both meet by hash


def _linked(sets: DataFrame, percent: int, block: int, pivots: int = PIVOTS) -> DataFrame:
    """Columns a, b: links that join the same sets as all links do. Columns of sets: id, tokens, rare.

    Sets meet only inside a cluster. A cluster is dealt out in blocks, and some of its sets, the pivots, are in each: what
    is linked inside different blocks is in one component if a pivot is. The largest component of a cluster of several
    blocks is settled; every other set, if there are any, is then searched in the other blocks that hold one of its rare
    shingles, since a linked set does.
    """
    total, size = sets.agg(F.count("*"), F.sum(F.octet_length("tokens").cast("bigint"))).first()
    each = (size or 0) / max(1, total)
    least_tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def tasks(rows: int) -> int:
        """A number, so that few bytes of much work aren't put into few tasks, which grows with the bytes."""
        return max(least_tasks, int(rows * each / _TASK_BYTES))

    members = _placed(sets, block, total).join(sets.select("id", "tokens", "rare"), "id")
    members = C.written(members.withColumn("rare", F.when(F.col("blocks") > 1, F.col("rare"))), "members")
    is_pivot = (F.col("blocks") > 1) & ((F.col("id") == F.col("cluster")) | (F.pmod(F.xxhash64("id", F.lit(1)), F.col("size")) < pivots))
    everywhere = members.where(is_pivot).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # clusters of one block are handled some together
    dealt = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(max(64, total // (4 * block))))).otherwise(F.xxhash64("cluster", "block"))
    mine = members.where(~is_pivot).unionByName(everywhere).select("id", "cluster", "blocks", "block", "tokens", dealt.alias("dealt"))

    def inside(rows: pa.Table) -> pa.Table:
        ids, cluster, blocks, which = (np.asarray(rows.column(c)) for c in ("id", "cluster", "blocks", "block"))
        order = np.lexsort((ids, ids != cluster, which, cluster))
        tokens = _arrays(rows.column("tokens"))
        cut = np.flatnonzero(np.r_[True, (cluster[order][1:] != cluster[order][:-1]) | (which[order][1:] != which[order][:-1]), True])
        linked = np.empty(len(ids), np.int64)
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            own = order[i:j]
            linked[own] = ids[own][_links_in([tokens[x] for x in own], percent)]
        return pa.table([rows.column("id"), pa.array(linked), pa.array(blocks > 1)], ["a", "b", "several"])

    first = C.written(mine.repartition(tasks(total), "dealt").groupBy("dealt").applyInArrow(inside, "a bigint, b bigint, several boolean"), "inside")
    parts = components(first.where("several").select("a", "b")).select(F.col("node").alias("id"), "component")
    big = members.where("blocks > 1")
    placed = C.written(big.select("id", "cluster").join(parts, "id", "left").select("id", "cluster", F.coalesce("component", "id").alias("component")), "placed")
    largest = placed.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    settled = largest.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("component"))
    open_ones = C.written(placed.join(settled, ["cluster", "component"], "left_anti").select("id"), "open")
    if open_ones.isEmpty():
        return first.select("a", "b")
    asked = C.written(_asked(big, open_ones), "asked")
    loads = asked.groupBy("cluster", "block").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    asks = asked.join(loads, ["cluster", "block"]).select("cluster", "block", "id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    asks = asks.join(big.select("id", "tokens"), "id")
    held = big.join(loads, ["cluster", "block"]).select(F.col("cluster").alias("c"), F.col("block").alias("k"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), F.col("id").alias("held_id"), F.col("tokens").alias("held_tokens"))

    def across(queries: pa.Table, index: pa.Table) -> pa.Table:
        ids, sets_ = index.column("held_id").to_pylist(), _arrays(index.column("held_tokens"))
        a, b, lists = [], [], Lists(sets_)
        for q, own in zip(queries.column("id").to_pylist(), _arrays(queries.column("tokens")), strict=True):
            for c, n in divide_skip(lists.of(own), least_overlap(len(own), percent), lambda c: ids[c] == q):
                if 100 * n >= percent * (len(own) + len(sets_[c]) - n):
                    a.append(q)
                    b.append(ids[c])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    n = tasks(2 * asked.count())
    second = asks.repartition(n, "cluster", "block", "part").groupBy("cluster", "block", "part").cogroup(held.repartition(n, "c", "k", "p").groupBy("c", "k", "p")).applyInArrow(across, "a bigint, b bigint")
    return first.select("a", "b").union(second)


def jaccard_join(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles (the size of its set), component_id (the least id that links reach).

    A set holds the distinct windows of 5 words, A to Z in lower case, or with fewer words the whole sequence; null and
    empty texts have an empty set and no link. Rows link when 100 * intersection >= percent * union. Of rows with equal
    sets one stands for all, so copies don't meet; rows with equal ids are one node. A row without an id links with
    nothing and its component_id is null. Ids are integers; other columns don't matter. Texts may have any length; a set
    is held whole in a task. Shingles are compared by 64 bits.

    First an exchange of prefix shingles drops rows that can't link, then one of all shingles does among the different
    sets that are left. The others fall into clusters with a prefix shingle in common; inside a cluster, blocks of about
    ``block`` sets are searched by DivideSkip, and what stays open in the blocks that hold one of its rare shingles.
    """
    sets = shingle_sets(docs, id_col, text_col, percent)
    candidates = sets.where("tokens is not null")
    own = C.written(candidates.groupBy("key").agg(F.min("id").alias("stand_in"), F.any_value("tokens").alias("tokens"), F.count("*").alias("n")), "own")
    total = own.agg(F.sum("n")).first()[0] or 0
    copies = C.join_each(candidates.select("id", "key"), own.select("key", "stand_in", "n"), "key", total).select(F.col("id").alias("a"), F.col("stand_in").alias("b"))
    own = own.select(F.col("stand_in").alias("id"), "tokens")
    groups = components(_linked(covered(own, percent), percent, block).union(copies))
    names = [F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id")]
    found = sets.select("id", "n_shingles").where("id is not null").join(groups.withColumnRenamed("node", "id"), "id", "left").select(*names)
    return found.union(sets.where("id is null").select("id", "n_shingles", F.lit(None).cast("bigint")))
