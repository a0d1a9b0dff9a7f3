"""Time candles and bars of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.operators import runs, scan

#: Names and milliseconds of the intervals.
INTERVALS = {"1s": 1_000, "5s": 5_000, "15s": 15_000, "30s": 30_000, "1m": 60_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000, "1H": 3_600_000, "4H": 14_400_000, "1D": 86_400_000}
SCALES = [2**i for i in range(19)]


def candle_start(ms: int, column: str = "timestamp_ms"):
    return (F.col(column) - F.col(column) % ms).cast("bigint")


def time_candles(trades: DataFrame, interval: str = "1H") -> DataFrame:
    return candles_of_width(trades, INTERVALS[interval])


def candles_of_width(trades: DataFrame, ms: int) -> DataFrame:
    out = trades.groupBy("symbol", candle_start(ms).alias("start_timestamp_ms")).agg(
        F.min_by("price", "trade_id").alias("open_price"), F.max("price").alias("high_price"), F.min("price").alias("low_price"), F.max_by("price", "trade_id").alias("close_price"),
        F.sum(runs.trade_volume()).alias("volume"), F.count("*").alias("trades_count"), F.min("trade_id").alias("start_trade_id"), F.max("trade_id").alias("end_trade_id"),
    )
    return out.withColumn("end_timestamp_ms", F.col("start_timestamp_ms") + ms)


def wider_candles(candles: DataFrame, interval: str) -> DataFrame:
    """Candles of a multiple of the interval, from candles."""
    ms = INTERVALS[interval]
    out = candles.groupBy("symbol", candle_start(ms, "start_timestamp_ms").alias("start_timestamp_ms")).agg(
        F.min_by("open_price", "start_trade_id").alias("open_price"), F.max("high_price").alias("high_price"), F.min("low_price").alias("low_price"), F.max_by("close_price", "start_trade_id").alias("close_price"),
        F.sum("volume").alias("volume"), F.sum("trades_count").alias("trades_count"), F.min("start_trade_id").alias("start_trade_id"), F.max("end_trade_id").alias("end_trade_id"),
    )
    return out.withColumn("end_timestamp_ms", F.col("start_timestamp_ms") + ms)


def multi_interval_candles(trades: DataFrame, intervals: tuple[str, ...] = tuple(INTERVALS)) -> DataFrame:
    """Candles of several intervals, the trades read once: each from a finer one that divides it.

    The finest, and each that is at least 60 times wider than the last one kept, are written and read again.
    """
    kept: list[tuple[str, DataFrame]] = []
    out = None
    for name in sorted(intervals, key=INTERVALS.get):
        finer = [k for k in kept if INTERVALS[name] % INTERVALS[k[0]] == 0]
        df = wider_candles(finer[-1][1], name) if finer else time_candles(trades, name)
        if not finer or INTERVALS[name] >= 60 * INTERVALS[finer[-1][0]]:
            df = scan.saved(df)
            kept.append((name, df))
        df = df.withColumn("interval", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def bar_index(bars: DataFrame, chunks: int | None = None) -> DataFrame:
    return scan.index(bars, ["symbol"], ["start_trade_id"], chunks=chunks)


def aggregate_bars(bars: DataFrame, scale: int, chunks: int | None = None) -> DataFrame:
    """Each scale successive bars of a symbol as one; the last may have fewer."""
    own = bars if "bar_index" in bars.columns else bar_index(bars, chunks)
    return own.groupBy("symbol", F.floor(F.col("bar_index") / scale).alias("bar_index")).agg(*runs.bar_aggregates()).drop("bar_index")


def bar_pyramid(bars: DataFrame, scales: list[int] | None = None, chunks: int | None = None) -> DataFrame:
    """All scales; bars are numbered once. Every 64-fold one is written, and those up to the next one are made from it."""
    level, base, out = scan.saved(bar_index(bars, chunks)), 1, None
    for scale in scales or SCALES:
        wider = level if scale == base else level.groupBy("symbol", F.floor(F.col("bar_index") / (scale // base)).alias("bar_index")).agg(*runs.bar_aggregates())
        if scale == 64 * base:
            level, base = scan.saved(wider), scale
            wider = level
        one = wider.drop("bar_index").withColumn("scale", F.lit(scale))
        out = one if out is None else out.unionByName(one)
    return out


def last_bars(bars: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Per symbol the newest limit bars: of the newest limit + offset, in ascending order, the first offset are skipped."""
    w = Window.partitionBy("symbol").orderBy(F.desc("start_trade_id"))
    newest = bars.withColumn("_row", F.row_number().over(w)).where(F.col("_row") <= limit + offset)
    n = F.count("*").over(Window.partitionBy("symbol"))
    return newest.withColumn("_n", n).where((F.col("_n") - F.col("_row") >= offset) & (F.col("_n") - F.col("_row") < offset + limit)).drop("_row", "_n")


def last_record(df: DataFrame, order: str) -> DataFrame:
    """The newest row of each symbol."""
    return df.groupBy("symbol").agg(F.max_by(F.struct(*[c for c in df.columns if c != "symbol"]), order).alias("_r")).select("symbol", "_r.*")


def chart_fetch_limit(scale: int, requested: int, offset: int = 0, cap: int = 10_000_000, points: int = 50_000) -> int:
    return max(1, min(cap, requested, (points + 1) * scale + offset))


def horizon_time_stats(bars: DataFrame, horizons: list[int] | None = None, chunks: int | None = None) -> DataFrame:
    """Of the time spans of each number of successive bars: least, largest, sample deviation, mean, count; too long ones are left out."""
    horizons = horizons or [2**i for i in range(1, 11)]
    own = bar_index(bars.select("symbol", "start_trade_id", "start_timestamp_ms"), chunks)
    w = Window.partitionBy("symbol", "_block").orderBy("bar_index")
    rows = scan.blocks(own, ["symbol"], "bar_index", max(horizons))
    rows = rows.withColumns({f"_{n}": F.col("start_timestamp_ms") - F.lag("start_timestamp_ms", n - 1).over(w) for n in horizons}).where("not _halo")
    of = {"min_ms": F.min, "max_ms": F.max, "std_ms": F.stddev_samp, "mean_ms": F.avg, "n": F.count}
    each = rows.groupBy("symbol").agg(*(f(f"_{n}").alias(f"{k}_{n}") for n in horizons for k, f in of.items()))
    one = F.array(*(F.struct(*(F.col(f"{k}_{n}").alias(k) for k in of), F.lit(n).alias("horizon")) for n in horizons))
    return each.select("symbol", F.explode(one).alias("h")).select("symbol", "h.*").where("n > 0")


def velocity_trades_count(trades: DataFrame, ms: int = 100) -> DataFrame:
    return trades.groupBy("symbol", candle_start(ms).alias("start_timestamp_ms")).agg(F.count("*").alias("trades_count"))


def interval_volume_and_change(trades: DataFrame, ms: int) -> DataFrame:
    """Volume, and last price less first price, of each interval."""
    return trades.groupBy("symbol", candle_start(ms).alias("start_timestamp_ms")).agg(
        F.sum(runs.trade_volume()).alias("volume"), (F.max_by("price", "trade_id") - F.min_by("price", "trade_id")).alias("price_change")
    )


def count_bars_since(bars: DataFrame, entries: DataFrame) -> DataFrame:
    """For each (symbol, start_trade_id) of entries the number of bars from it on: one union, running counts from the new end."""
    both = bars.select("symbol", "start_trade_id", F.lit(1).alias("_bar")).unionByName(entries.select("symbol", "start_trade_id", F.lit(0).alias("_bar")).distinct())
    total = bars.groupBy("symbol").agg(F.count("*").alias("_n"))
    counted = scan.step(both, ["symbol"], ["start_trade_id", "_bar"], sums={"_upto": F.col("_bar")})
    return counted.where("_bar = 0").join(total, "symbol").select("symbol", "start_trade_id", (F.col("_n") - F.col("_upto")).alias("bars"))
