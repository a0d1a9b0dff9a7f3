"""Runs: successive rows of equal kind, as ids, bars and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.operators import scan

SYMBOL = ["symbol"]


def trade_volume() -> Column:
    return F.col("price") * F.col("quantity")


def side_runs(trades: DataFrame, chunks: int | None = None, last: str | None = None) -> DataFrame:
    """Adds run_id: the number of the run of trades of one side that a trade is in, from 1, per symbol."""
    return scan.run_ids(trades, SYMBOL, "trade_id", F.col("is_buy"), "run_id", last, chunks)


def bar_direction() -> Column:
    """Bull, Bear or Cross by the sign of buy volume less sell volume."""
    delta = 2 * F.col("buy_volume") - F.col("total_volume")
    return F.when(delta > 0, "Bull").when(delta < 0, "Bear").otherwise("Cross")


def direction_runs(bars: DataFrame, chunks: int | None = None, last: str | None = None) -> DataFrame:
    """Drops flat bars, then numbers runs of equal direction."""
    return scan.run_ids(bars.where("open_price <> close_price"), SYMBOL, "start_trade_id", bar_direction(), "run_id", last, chunks)


def bar_aggregates(order: str = "start_trade_id") -> list[Column]:
    """Bars of bars: first, last, largest, least and sum by the class of the column."""
    first, last = (lambda c: F.min_by(c, order).alias(c)), (lambda c: F.max_by(c, order).alias(c))
    return [
        F.min("start_trade_id").alias("start_trade_id"), last("end_trade_id"), first("start_timestamp_ms"), last("end_timestamp_ms"),
        first("open_price"), F.max("high_price").alias("high_price"), F.min("low_price").alias("low_price"), last("close_price"),
        *(F.sum(c).alias(c) for c in ("buy_quantity", "buy_trades_count", "buy_volume", "total_quantity", "total_trades_count", "total_volume")),
    ]


def trade_aggregates() -> list[Column]:
    """A bar of trades."""
    buy = F.col("is_buy")
    return [
        F.min("trade_id").alias("start_trade_id"), F.max("trade_id").alias("end_trade_id"), F.min_by("timestamp_ms", "trade_id").alias("start_timestamp_ms"),
        F.max_by("timestamp_ms", "trade_id").alias("end_timestamp_ms"), F.min_by("price", "trade_id").alias("open_price"), F.max("price").alias("high_price"),
        F.min("price").alias("low_price"), F.max_by("price", "trade_id").alias("close_price"), F.sum(F.when(buy, F.col("quantity")).otherwise(0)).alias("buy_quantity"),
        F.count_if(buy).alias("buy_trades_count"), F.sum(F.when(buy, trade_volume()).otherwise(0)).alias("buy_volume"), F.sum("quantity").alias("total_quantity"),
        F.count("*").alias("total_trades_count"), F.sum(trade_volume()).alias("total_volume"),
    ]


def _bars(runs: DataFrame, aggregates: list[Column], emit_open: bool) -> DataFrame:
    """A bar for each run, unless told without the last, still open one of each symbol (column _last_run)."""
    closed = runs if emit_open else runs.where("run_id < _last_run")
    return closed.groupBy("symbol", "run_id").agg(*aggregates).drop("run_id")


def run_bars_side(trades: DataFrame, emit_open: bool = False, chunks: int | None = None) -> DataFrame:
    """A bar for each run of trades of one side."""
    return _bars(side_runs(trades, chunks, "_last_run"), trade_aggregates(), emit_open)


def run_bars_direction(bars: DataFrame, emit_open: bool = False, chunks: int | None = None) -> DataFrame:
    """A bar for each run of side bars of one direction, flat ones left out."""
    return _bars(direction_runs(bars, chunks, "_last_run"), bar_aggregates(), emit_open)


def run_lines_side(trades: DataFrame, chunks: int | None = None) -> DataFrame:
    """A line for each run of trades of one side, the last one included."""
    return side_runs(trades, chunks).groupBy("symbol", "run_id").agg(
        F.any_value("is_buy").alias("is_buy"), F.min_by("price", "trade_id").alias("start_price"), F.max_by("price", "trade_id").alias("end_price"), F.min("trade_id").alias("start_trade_id"),
        F.max("trade_id").alias("end_trade_id"), F.min_by("timestamp_ms", "trade_id").alias("start_timestamp_ms"), F.max_by("timestamp_ms", "trade_id").alias("end_timestamp_ms"),
        F.sum("quantity").alias("quantity"), F.sum(trade_volume()).alias("volume"),
    ).drop("run_id")


def dominant_side_lines(bars: DataFrame) -> DataFrame:
    """A line for each bar; its side is the one with more quantity."""
    return bars.select(
        "symbol", (F.col("buy_quantity") > F.col("total_quantity") - F.col("buy_quantity")).alias("is_buy"), F.col("open_price").alias("start_price"), F.col("close_price").alias("end_price"),
        "start_trade_id", "end_trade_id", "start_timestamp_ms", "end_timestamp_ms", F.col("total_quantity").alias("quantity"), F.col("total_volume").alias("volume"),
    )


def _ways(steps: DataFrame) -> DataFrame:
    """Adds way, the last step that isn't 0 (0 before any), and line, a number that rises where the way changes. steps has chunks."""
    own = steps.withColumn("_turn", F.when(F.col("_step") != 0, F.col("_step")))
    w = scan.inside(SYMBOL, "trade_id")
    upto, before = (w.rowsBetween(Window.unboundedPreceding, n) for n in (0, -1))
    last = F.last("_turn", ignorenulls=True)
    own = own.withColumn("_new", F.coalesce((F.col("_turn") != last.over(before)).cast("bigint"), F.lit(0)))
    local = {"_way": last.over(upto), "_begin": F.first("_turn", ignorenulls=True).over(upto), "_local": F.sum("_new").over(upto)}

    def into(_, before) -> dict[str, Column]:
        return {"_in": F.last("_way", ignorenulls=True).over(before)}

    def starts(_, before) -> dict[str, Column]:
        """Whether the first turn of a chunk changes the way."""
        return {"_starts": F.coalesce((~F.col("_begin").eqNullSafe(F.col("_in")) & F.col("_begin").isNotNull()).cast("bigint"), F.lit(0))}

    def base(_, before) -> dict[str, Column]:
        return {"_base": F.coalesce(F.sum(F.col("_starts") + F.col("_local")).over(before), F.lit(0))}

    rows = scan.carried(own, SYMBOL, ["trade_id"], local, into, starts, base)
    line = F.col("_base") + F.when(F.col("_way").isNull(), 0).otherwise(F.col("_starts") + F.col("_local"))
    return rows.select(*(c for c in steps.columns), F.coalesce("_way", "_in", F.lit(0)).alias("way"), line.alias("line"))


def zigzag_lines(trades: DataFrame, chunks: int | None = None) -> DataFrame:
    """Segments of monotone price.

    A step of zero continues the line; steps of zero before the first other one are a Cross line of their own. A line
    starts where the one before it ended; the trade it starts with counts in the earlier line's quantity and volume. A
    symbol with one trade has no line.
    """
    own = scan.step(scan.chunked(trades, SYMBOL, "trade_id", chunks), SYMBOL, ["trade_id"], index="_i", previous={"_price": "price", "_id": "trade_id", "_ts": "timestamp_ms"})
    steps = _ways(own.where("_i > 0").withColumn("_step", F.signum(F.col("price") - F.col("_price")).cast("int")))
    first = own.where("_i = 0").select("symbol", F.col("trade_id").alias("_first"), F.col("quantity").alias("_q"), trade_volume().alias("_v"))
    lines = steps.groupBy("symbol", "line").agg(
        F.any_value("way").alias("way"), F.min_by("_price", "trade_id").alias("start_price"), F.max_by("price", "trade_id").alias("end_price"), F.min("_id").alias("start_trade_id"),
        F.max("trade_id").alias("end_trade_id"), F.min_by("_ts", "trade_id").alias("start_timestamp_ms"), F.max_by("timestamp_ms", "trade_id").alias("end_timestamp_ms"),
        F.sum("quantity").alias("_q0"), F.sum(trade_volume()).alias("_v0"),
    ).join(first, "symbol")
    opens = F.col("start_trade_id") == F.col("_first")
    direction = F.when(F.col("way") > 0, "Bull").when(F.col("way") < 0, "Bear").otherwise("Cross")
    return lines.select(
        "symbol", direction.alias("trading_direction"), "start_price", "end_price", "start_trade_id", "end_trade_id", "start_timestamp_ms", "end_timestamp_ms",
        F.when(opens, F.col("_q0") + F.col("_q")).otherwise(F.col("_q0")).alias("quantity"), F.when(opens, F.col("_v0") + F.col("_v")).otherwise(F.col("_v0")).alias("volume"),
    )


def smoothed_points(lines: DataFrame, both_ends: bool = False) -> DataFrame:
    """The start of each line and the end of each symbol's last one; with both_ends the two ends of every line."""
    point = lambda p: F.struct(F.col(f"{p}_trade_id").alias("trade_id"), F.col(f"{p}_price").alias("price"), F.col(f"{p}_timestamp_ms").alias("timestamp_ms"))
    if both_ends:
        return lines.select("symbol", F.explode(F.array(point("start"), point("end"))).alias("p")).select("symbol", "p.*")
    last = lines.groupBy("symbol").agg(F.max_by(point("end"), "start_trade_id").alias("p"))
    return lines.select("symbol", point("start").alias("p")).union(last).select("symbol", "p.*")
