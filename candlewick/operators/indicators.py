"""Moving averages, bands, RSI and velocities; rows without enough history have null."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.operators import bars as B
from candlewick.operators import scan

SYMBOL = ["symbol"]


def _framed(df: DataFrame, order: str, value: str, n: int, chunks: int | None, block: int):
    own = scan.index(df, SYMBOL, [order], "_i", chunks)
    rows = scan.blocks(own.withColumn("_x", F.col(value).cast("double")), SYMBOL, "_i", n, block)
    return rows, Window.partitionBy("symbol", "_block").orderBy("_i").rowsBetween(-(n - 1), 0)


def bollinger_bands(df: DataFrame, order: str = "start_trade_id", value: str = "close_price", n: int = 20, width: float = 2.0, chunks: int | None = None, block: int = 100_000) -> DataFrame:
    """Adds middle, upper and lower band: the mean of n values, and that plus and minus width population deviations."""
    rows, w = _framed(df, order, value, n, chunks, block)
    rows = rows.withColumns({"_m": F.avg("_x").over(w), "_d": F.stddev_pop("_x").over(w)}).where("not _halo")
    whole = F.col("_i") >= n - 1
    band = lambda k: F.when(whole, F.col("_m") + k * F.col("_d"))
    return rows.withColumns({"middle_band": F.when(whole, F.col("_m")), "upper_band": band(width), "lower_band": band(-width)}).drop("_m", "_d", "_x", "_i", "_block", "_halo")


def sma_partial(df: DataFrame, order: str, value: str, n: int, chunks: int | None = None, block: int = 100_000) -> DataFrame:
    """Adds sma: the mean of the last n values, of fewer at the start."""
    rows, w = _framed(df, order, value, n, chunks, block)
    return rows.withColumn("sma", F.avg("_x").over(w)).where("not _halo").drop("_x", "_i", "_block", "_halo")


def ema(df: DataFrame, order: str, value: str, alpha: float = 0.1, name: str = "ema", chunks: int | None = None) -> DataFrame:
    """Adds the exponential average: the first value, then alpha * x + (1 - alpha) * the one before."""
    x = F.col(value).cast("double")
    return scan.affine(df, SYMBOL, [order], {name: (F.lit(1 - alpha), alpha * x)}, start=x, chunks=chunks)


def wilder_ma(df: DataFrame, order: str, value: str, n: int, chunks: int | None = None) -> DataFrame:
    """Adds wilder: the first value, then (the one before * (n - 1) + x) / n."""
    return ema(df, order, value, 1.0 / n, "wilder", chunks)


def rsi(df: DataFrame, order: str = "start_trade_id", value: str = "close_price", n: int = 14, chunks: int | None = None) -> DataFrame:
    """Adds rsi, null for the first n rows: averages of gains and losses, means of the first n changes, then Wilder's; 100 without losses."""
    own = scan.step(scan.chunked(df, SYMBOL, order, chunks), SYMBOL, [order], index="_i", previous={"_before": value})
    change = F.col(value).cast("double") - F.col("_before").cast("double")
    keep, step = F.when(F.col("_i") <= n, 1.0).otherwise((n - 1) / n), lambda x: F.coalesce(F.greatest(x, F.lit(0.0)), F.lit(0.0)) / n
    out = scan.affine(own, SYMBOL, [order], {"_gain": (keep, step(change)), "_loss": (keep, step(-change))})
    value_ = F.when(F.col("_loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_gain") / F.col("_loss")))
    return out.withColumn("rsi", F.when(F.col("_i") >= n, value_)).drop("_i", "_before", "_gain", "_loss", scan.CHUNK)


def candle_velocity(candles: DataFrame, kinds: tuple[str, ...] = ("trades_count", "volume", "close_price"), alpha: float = 0.1, chunks: int | None = None) -> DataFrame:
    """Adds velocity, the mean of the kinds' differences to the candle before (0 for the first), and its ema, smoothed_velocity."""
    own = scan.step(scan.chunked(candles, SYMBOL, "start_timestamp_ms", chunks), SYMBOL, ["start_timestamp_ms"], previous={f"_{k}": k for k in kinds})
    total = sum((F.col(k).cast("double") - F.col(f"_{k}").cast("double") for k in kinds), F.lit(0.0)) / len(kinds)
    own = own.withColumn("velocity", F.coalesce(total, F.lit(0.0))).drop(*(f"_{k}" for k in kinds))
    return ema(own, "start_timestamp_ms", "velocity", alpha, "smoothed_velocity").drop(scan.CHUNK)


def trade_velocity(trades: DataFrame, ms: int = 60_000, alpha: float = 0.1, chunks: int | None = None) -> DataFrame:
    """Of each interval with trades: their number, its difference to the interval before (0 for the first), and that one's ema."""
    return candle_velocity(B.velocity_trades_count(trades, ms), ("trades_count",), alpha, chunks)
