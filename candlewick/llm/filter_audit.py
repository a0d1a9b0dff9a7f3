"""How filters of documents interact in all orders: counts by failure mask, spread over the permutations by rank intervals."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm import chunks as C

#: The filters in order, and their limits.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
WORD, CAPITAL, SYMBOL = r"[^\x20\x09-\x0D]+", "[A-Z]", r"[#$%&*|]"
_COUNTS = ("n", "good", "toxic")


def lehmer_rank(order: str, among: str = FILTERS) -> int:
    """The place, from 0, of the first permutation of ``among`` in lexicographic order that begins with ``order``."""
    rank, left = 0, sorted(among)
    for f in order:
        digit = left.index(f)
        rank += digit * factorial(len(left) - 1)
        left.remove(f)
    return rank


def differences(among: str = FILTERS) -> list[tuple[int, int, int, int]]:
    """Rows mask, step, rank, sign: where the orders begin (1) and end (-1) in which a document failing the mask's filters goes at that step.

    It goes at step s where the first s - 1 filters of an order are none of the mask's and the next one is; the orders
    with one such beginning are an interval of ranks.
    """
    ends: dict[tuple[int, int, int], int] = {}
    for mask in range(1, 1 << len(among)):
        fails = [f for i, f in enumerate(among) if mask >> i & 1]
        passes = [f for f in among if f not in fails]
        for step in range(1, len(passes) + 2):
            for before in permutations(passes, step - 1):
                for f in fails:
                    first = lehmer_rank("".join(before) + f, among)
                    for rank, sign in ((first, 1), (first + factorial(len(among) - step), -1)):
                        ends[mask, step, rank] = ends.get((mask, step, rank), 0) + sign
    return [(*at, sign) for at, sign in sorted(ends.items()) if sign]


def failures(text: Column) -> Column:
    """The mask of the filters A to D that a text fails: bit i is filter i. ``text`` may not be null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    tests = F.transform(
        F.array(words),
        lambda w: F.when(F.size(w) < LEAST_WORDS, 1).otherwise(0) + F.when(F.size(F.array_distinct(w)).cast("bigint") * 100 < F.size(w).cast("bigint") * LEAST_DISTINCT, 2).otherwise(0),
    )[0]
    return tests + F.when(F.regexp_count(text, F.lit(CAPITAL)).cast("bigint") * 100 > F.length(text).cast("bigint") * MOST_CAPITALS, 4).otherwise(0) + F.when(text.rlike(SYMBOL), 8).otherwise(0)


def facts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """Columns part, mask, good, toxic of each row of docs.

    Equal texts meet by their SHA-256; texts that hold many rows are joined by broadcast, so they stay spread. Only short
    rows are shuffled.
    """
    own, name = C.numbered(docs), {c: C.number_of(docs, c) for c in (id_col, text_col, part_col)}
    text = F.coalesce(F.col(name[text_col]), F.lit(""))
    rows = own.select(F.col(name[id_col]).alias("id"), F.coalesce(F.col(name[part_col]).cast("string"), F.lit("")).alias("part"), failures(text).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    rows = C.written(rows, "audit-rows")
    firsts = C.written(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")), "audit-texts")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    copy = F.when(F.col("id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    rows = C.join_each(rows, firsts, "digest", total).select("id", "part", (F.col("mask") + copy).alias("mask"))
    own, name = C.numbered(labels), {c: C.number_of(labels, c) for c in (id_col, "quality", "toxic")}
    known = own.groupBy(F.col(name[id_col]).alias("id")).agg(F.max((F.col(name["quality"]) == 1).cast("int")).alias("good"), F.max((F.col(name["toxic"]) == 1).cast("int")).alias("toxic"))
    labelled = rows.where("id is not null").join(known.where("id is not null"), "id", "left").select("part", "mask", "good", "toxic")
    return labelled.union(rows.where("id is null").select("part", "mask", F.lit(None).cast("int"), F.lit(None).cast("int"))).na.fill(0)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """For each part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null or empty text has no words, so it fails A; it is identical to every other null or empty text. A row fails E if
    an identical text has a smaller id; rows of the same id and text are no copies of each other, and rows without an id
    neither are nor have smaller ones. A null part is the empty string. An id that labels hold more than once is good or
    toxic if any of its rows says so; rows without a label, or with a null one, are neither. Other columns don't matter.
    No rows, no parts. Texts may have any length.

    The documents are counted by part, failure mask and labels first; all that follows works on these few counts: each
    mask's counts are added where its intervals of lexicographic ranks begin and taken off where they end, and running
    sums over the ranks of a part and step give what goes there in each order.
    """
    spark = docs.sparkSession
    counts = facts(docs, labels, id_col, text_col, part_col).groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.sum(c).cast("bigint").alias(c) for c in _COUNTS[1:]))
    counts = C.written(counts, "audit-counts")
    ends = F.broadcast(spark.createDataFrame(differences(), "mask int, step int, rank int, sign int"))  # a fixed table
    changes = counts.join(ends, "mask").groupBy("part", "step", "rank").agg(*(F.sum(F.col("sign") * F.col(c)).alias(c) for c in _COUNTS))
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = F.broadcast(spark.createDataFrame([(r, o, s + 1, f) for r, o in enumerate(orders) for s, f in enumerate(o)], "rank int, filter_order string, step int, filter string"))
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"))
    grid = parts.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1)))).join(steps, "rank")
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # of 120 rows
    gone = grid.join(changes, ["part", "step", "rank"], "left").withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(along) for c in _COUNTS})
    single = [F.struct(F.lit(f).alias("filter"), ((F.col("mask").bitwiseAND(1 << i)) > 0).alias("fails"), (F.col("mask") == 1 << i).alias("alone")) for i, f in enumerate(FILTERS)]
    each = counts.select("part", "n", F.explode(F.array(*single)).alias("x")).groupBy("part", "x.filter").agg(F.sum(F.when(F.col("x.fails"), F.col("n")).otherwise(0)).alias("fails"), F.sum(F.when(F.col("x.alone"), F.col("n")).otherwise(0)).alias("unique_fails"))
    before = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # of 5 rows
    return gone.join(each, ["part", "filter"]).select(
        "part", "filter_order", "step", (F.col("total") - F.sum("n").over(before)).alias("kept"), F.col("n").alias("removed"), (F.col("fails") - F.col("n")).alias("redundant"), "unique_fails",
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("n").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )
