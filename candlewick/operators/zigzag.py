"""Zigzag levels: lines of a level from those of the level below, by folding counter-moves that both extremes outlive."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.operators import scan

SYMBOL = ["symbol"]
LEVELS = 20
_LINE = ("trading_direction", "start_price", "end_price", "start_trade_id", "end_trade_id", "start_timestamp_ms", "end_timestamp_ms", "quantity", "volume")


def _continued(w) -> Column:
    """Whether a line and the two after it are one: the third goes on in its direction, neither extreme goes back."""
    end, next_end, last_end = F.col("end_price"), F.lead("end_price", 1).over(w), F.lead("end_price", 2).over(w)
    up = (next_end >= F.col("start_price")) & (last_end >= end)
    down = (next_end <= F.col("start_price")) & (last_end <= end)
    kept = F.when(F.col("trading_direction") == "Bull", up).when(F.col("trading_direction") == "Bear", down).otherwise(F.lit(False))
    return F.coalesce(kept & (F.lead("trading_direction", 2).over(w) == F.col("trading_direction")), F.lit(False))


def fold(lines: DataFrame, rows: int = scan.ROWS_PER_CHUNK) -> DataFrame:
    """The lines of the next level. lines: columns i (0, 1, 2, ... in each symbol) and those of a line; so has the result.

    A line takes in the two after it while these go on in its direction: whether they do depends on the last line taken
    and the two after that alone. So a line is skipped (it lies inside such a fold) if an odd number of lines right before
    it can be continued, and a new line begins where neither it nor the one before is skipped. Blocks of so many lines are
    solved for both cases of their first line, from windows inside the block and two lines after it; the rows of blocks
    are composed, which says for each block which case holds and how many lines begin before it.
    """
    if rows < 2:
        raise ValueError("a block has two lines at least")
    i = F.col("i")
    own = F.struct(F.floor(i / rows).cast("bigint").alias("b"), F.lit(False).alias("halo"))
    after = F.struct((F.floor(i / rows) - 1).cast("bigint").alias("b"), F.lit(True).alias("halo"))
    placed = lines.withColumn("_p", F.explode(F.when((i % rows < 2) & (i >= rows), F.array(own, after)).otherwise(F.array(own))))
    placed = placed.withColumns({"_block": F.col("_p.b"), "_halo": F.col("_p.halo")}).drop("_p")
    w = Window.partitionBy("symbol", "_block").orderBy("i")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    solved = placed.withColumn("_more", _continued(w)).withColumn("_stop", F.max(F.when(~F.col("_more"), i)).over(before))
    inner = i % rows
    for v in (0, 1):  # the block's first line is skipped or not
        solved = solved.withColumn(f"_skip{v}", F.when(F.col("_stop").isNotNull(), (i - 1 - F.col("_stop")) % 2 == 1).otherwise((inner + v) % 2 == 1))
        begins = (inner > 0) & ~F.col(f"_skip{v}") & ~F.lag(f"_skip{v}").over(w)
        solved = solved.withColumn(f"_n{v}", begins.cast("bigint")).withColumn(f"_n{v}", F.sum(f"_n{v}").over(upto))
    solved = solved.where("not _halo")
    local = scan.saved(solved.withColumn("_end", F.lead(F.lit(True)).over(w).isNull()).drop("_halo", "_stop"))

    def compose(blocks: pa.Table) -> pa.Table:
        skipped, begins, base, out = False, True, 0, []
        for r in blocks.sort_by("_block").to_pylist():
            v = int(skipped)
            out.append((r["symbol"], r["_block"], v, base + int(begins)))
            base += int(begins) + r[f"_n{v}"]
            last = r[f"_skip{v}"]
            skipped = not last and r["_more"]
            begins = not skipped and not last
        return pa.table([pa.array(x) for x in zip(*out, strict=True)], ["symbol", "_block", "_case", "_base"])

    ends = local.where("_end").select("symbol", "_block", "_more", "_skip0", "_skip1", "_n0", "_n1")
    cases = ends.groupBy("symbol").applyInArrow(compose, "symbol string, _block bigint, _case bigint, _base bigint")  # a row for each block
    line = F.col("_base") + F.when(F.col("_case") == 1, F.col("_n1")).otherwise(F.col("_n0")) - 1
    first, last = (lambda c: F.min_by(c, "i").alias(c)), (lambda c: F.max_by(c, "i").alias(c))
    made = local.join(cases, ["symbol", "_block"]).withColumn("_line", line).groupBy("symbol", "_line").agg(
        first("trading_direction"), first("start_price"), last("end_price"), first("start_trade_id"), last("end_trade_id"), first("start_timestamp_ms"), last("end_timestamp_ms"),
        F.sum("quantity").alias("quantity"), F.sum("volume").alias("volume"),
    )
    return made.withColumnRenamed("_line", "i")


def _next_level(lines: pa.Table) -> pa.Table:
    """The same for all lines of a symbol in order."""
    n = len(lines)
    start, end, way = (lines.column(c) for c in ("start_price", "end_price", "trading_direction"))
    more = np.zeros(n, bool)
    if n > 2:
        at = lambda column, k: column.slice(k, n - 2)
        up, up_end = pc.greater_equal(at(end, 1), at(start, 0)), pc.greater_equal(at(end, 2), at(end, 0))
        down, down_end = pc.less_equal(at(end, 1), at(start, 0)), pc.less_equal(at(end, 2), at(end, 0))
        bull, bear = pc.equal(at(way, 0), "Bull"), pc.equal(at(way, 0), "Bear")
        kept = pc.or_(pc.and_(bull, pc.and_(up, up_end)), pc.and_(bear, pc.and_(down, down_end)))
        more[: n - 2] = np.asarray(pc.and_(kept, pc.equal(at(way, 2), at(way, 0))))
    stop = np.maximum.accumulate(np.append(-1, np.where(more, -1, np.arange(n))[:-1]))  # the last line before that can't be continued
    skipped = (np.arange(n) - 1 - stop) % 2 == 1
    first = np.flatnonzero(~skipped & ~np.append(False, skipped[:-1]))
    last = np.append(first[1:], n) - 1
    line = np.repeat(np.arange(len(first)), last - first + 1)
    sums = pa.table([pa.array(line), lines.column("quantity"), lines.column("volume")], ["line", "quantity", "volume"]).group_by("line", use_threads=False).aggregate([("quantity", "sum"), ("volume", "sum")])
    made = {c: lines.column(c).take(pa.array(last if c.startswith("end_") else first)) for c in lines.column_names}
    made |= {c: sums.column(f"{c}_sum").cast(lines.schema.field(c).type) for c in ("quantity", "volume")}
    return pa.table(made)


def zigzag_levels(lines: DataFrame, levels: int = LEVELS, rows: int = scan.ROWS_PER_CHUNK) -> DataFrame:
    """The lines of the levels 2, 3, ... up to levels, from zigzag lines: those columns and level.

    Directions alternate, but for a first line without one, which takes nothing in; those of the result alternate again.
    Quantities and volumes are those of all lines taken in, summed up each in its own unit.

    Levels only get smaller: while a symbol has more lines than a block, a level is folded in blocks; all levels from there
    on are made in one group for each symbol.
    """
    kinds = dict(lines.dtypes)
    wide = {c: F.col(c).cast(re.sub(r"decimal\(\d+", "decimal(38", kinds[c])) for c in ("quantity", "volume")}
    now = scan.saved(scan.index(lines.select("symbol", *_LINE).withColumns(wide), SYMBOL, ["start_trade_id"], "i"))
    found = lines.select("symbol", F.lit(2).alias("level"), *_LINE).limit(0)
    for level in range(2, levels + 1):
        most = now.groupBy("symbol").count().agg(F.max("count")).first()[0]
        if most is None or most <= rows:
            break
        now = scan.saved(fold(now, rows).withColumns(wide))
        found = found.unionByName(now.select("symbol", F.lit(level).alias("level"), *_LINE))
    else:
        return found
    fields = [now.schema["symbol"], T.StructField("level", T.IntegerType()), *(now.schema[c] for c in _LINE)]

    def rest(own: pa.Table) -> pa.Table:
        symbol, own, made = own.column("symbol")[0].as_py(), own.combine_chunks().sort_by("i").select(list(_LINE)), []
        for k in range(level, levels + 1):
            own = _next_level(own)
            made.append(pa.table([pa.array([symbol] * len(own), pa.string()), pa.array([k] * len(own), pa.int32()), *own.columns], ["symbol", "level", *_LINE]))
        return pa.concat_tables(made)

    return found.unionByName(now.groupBy("symbol").applyInArrow(rest, T.StructType(fields)))
