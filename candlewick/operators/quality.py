"""Checks of trades, candles, bands, books: rows (check, passed, detail), violations, keys to delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.operators import scan

MOST = 1_000_000
#: The time span that integrity checks accept, in milliseconds.
LEAST_MS, MOST_MS = -10_800_000, 1_767_214_800_000


def _checks(counts: DataFrame, names: dict[str, str]) -> DataFrame:
    """From one row of counts of failures a row for each check."""
    one = F.array(*(F.struct(F.lit(n).alias("check"), (F.col(c) == 0).alias("passed"), F.col(c).cast("bigint").alias("failures")) for n, c in names.items()))
    return counts.select(F.explode(one).alias("c")).select("c.*")


def _bad(condition: Column) -> Column:
    return F.count_if(~F.coalesce(condition, F.lit(False)))


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    return [c for c in required if c not in df.columns]


def validate_trades(trades: DataFrame) -> DataFrame:
    """Prices and quantities in range, ids of a symbol unique."""
    lacking = missing_columns(trades, ("trade_id", "price", "quantity", "timestamp_ms"))
    if lacking:
        raise ValueError(f"Missing required columns: {lacking}")
    ids = trades.groupBy("symbol", "trade_id").agg(F.count("*").alias("n"), *(_bad(F.col(c).between(0, MOST)).alias(c) for c in ("price", "quantity")))
    counts = ids.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("price", "quantity")))
    return _checks(counts, {"price range": "price", "quantity range": "quantity", "unique trade_id": "n"})


def trades_report(trades: DataFrame, position: str = "position", chunks: int | None = None) -> DataFrame:
    """All checks of a delivery of trades as rows: required columns, then ranges, unique ids and their order of delivery.

    Without a required column there is only that row, with the number of those that lack; an empty delivery fails by itself.
    """
    spark, required = trades.sparkSession, ("trade_id", "price", "quantity", "timestamp_ms")
    lacking = missing_columns(trades, required)
    columns = spark.range(1).select(F.lit("required columns").alias("check"), F.lit(not lacking).alias("passed"), F.lit(len(lacking)).cast("bigint").alias("failures"))
    if lacking:
        return columns
    found = columns.unionByName(validate_trades(trades))
    found = found.unionByName(_checks(unsorted_check(trades, position, chunks=chunks).agg(F.count("*").alias("n")), {"sorted trade_id": "n"}))
    return found.unionByName(_checks(trades.agg((F.count("*") == 0).cast("bigint").alias("n")), {"not empty": "n"}))


def validate_symbols(symbols: DataFrame) -> DataFrame:
    """Checks of symbol metadata: an id and a name that aren't empty, a time of the last update."""
    lacking = missing_columns(symbols, ("symbol_id", "symbol_name", "last_updated"))
    if lacking:
        raise ValueError(f"Missing required fields: {lacking}")
    text = lambda c: _bad(F.length(F.col(c).cast("string")) > 0).alias(c)
    counts = symbols.agg(text("symbol_id"), text("symbol_name"), F.count_if(F.col("last_updated").try_cast("timestamp").isNull()).alias("last_updated"))
    return _checks(counts, {"symbol_id": "symbol_id", "symbol_name": "symbol_name", "last_updated": "last_updated"})


def unsorted_check(df: DataFrame, position: str = "position", order: str = "trade_id", chunks: int | None = None) -> DataFrame:
    """Rows whose id is less than that of the row delivered before."""
    return scan.step(df, ["symbol"], [position], previous={"_before": order}, chunks=chunks).where(F.col(order) < F.col("_before")).drop("_before")


def validate_candles(candles: DataFrame) -> DataFrame:
    h, low, o, c = (F.col(f"{x}_price") for x in ("high", "low", "open", "close"))
    counts = candles.agg(_bad((h >= low) & (h >= o) & (h >= c)).alias("high"), _bad((low <= o) & (low <= c)).alias("low"), _bad(low.between(0, MOST) & h.between(0, MOST)).alias("range"))
    return _checks(counts, {"high": "high", "low": "low", "price range": "range"})


def validate_bands(bands: DataFrame) -> DataFrame:
    """Order of the bands where they aren't null."""
    rows = bands.where("middle_band is not null")
    counts = rows.agg(_bad(F.col("upper_band") >= F.col("middle_band")).alias("upper"), _bad(F.col("middle_band") >= F.col("lower_band")).alias("lower"))
    return _checks(counts, {"upper band": "upper", "lower band": "lower"})


def validate_rsi(df: DataFrame) -> DataFrame:
    counts = df.agg(F.count_if(~F.col("rsi").between(0, 100)).alias("range"), F.count_if(F.col("rsi").isNull()).alias("nulls"))
    return _checks(counts, {"rsi range": "range", "rsi nulls": "nulls"})


def validation_summary(checks: DataFrame) -> DataFrame:
    """Checks in all, passed, failed, the share passed, the failed ones' names."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check"))))
    return checks.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.avg(F.col("passed").cast("double")).alias("success_rate"), failed.alias("errors"))


def _first(rules: dict[str, Column]) -> Column:
    out = None
    for name, bad in rules.items():
        out = F.when(F.coalesce(bad, F.lit(True)), name) if out is None else out.when(F.coalesce(bad, F.lit(True)), name)
    return out


def check_trades_integrity(trades: DataFrame, symbols: list[str]) -> DataFrame:
    """Rows of each violation; of a row the first rule it breaks."""
    rules = {"symbol": ~F.col("symbol").isin(symbols), "trade_id": F.col("trade_id") < 0, "price": F.col("price") < 0, "quantity": F.col("quantity") < 0, "timestamp": ~F.col("timestamp_ms").between(LEAST_MS, MOST_MS)}
    return trades.withColumn("violation", _first(rules)).where("violation is not null").groupBy("violation").agg(F.count("*").alias("n"))


def check_book_integrity(messages: DataFrame, symbols: list[str]) -> DataFrame:
    parses = lambda c: F.from_json(c, "array<array<string>>").isNull()
    rules = {"symbol": ~F.col("symbol").isin(symbols), "timestamp": ~F.col("timestamp_ms").between(LEAST_MS, MOST_MS), "action": ~F.col("action").isin("Snapshot", "Update"), "asks": parses("asks"), "bids": parses("bids")}
    return messages.withColumn("violation", _first(rules)).where("violation is not null").groupBy("violation").agg(F.count("*").alias("n"))


def bad_book_rows(messages: DataFrame) -> DataFrame:
    """Keys to delete: a time out of range, or a level whose price or quantity isn't a decimal."""
    number = lambda x, i: F.get(x, i).try_cast("decimal(38,18)").isNull()
    broken = lambda c: F.coalesce(F.exists(F.from_json(c, "array<array<string>>"), lambda x: number(x, 0) | number(x, 1)), F.lit(True))
    return messages.where(~F.col("timestamp_ms").between(LEAST_MS, MOST_MS) | broken("asks") | broken("bids")).select("symbol", "timestamp_ms", "event_id")


def _candle_rules(symbols: list[str], ms: int) -> dict[str, Column]:
    h, low, o, c = (F.col(f"{x}_price") for x in ("high", "low", "open", "close"))
    start = F.col("start_timestamp_ms")
    return {
        "symbol": ~F.col("symbol").isin(symbols),
        "timestamp": ~start.between(LEAST_MS, MOST_MS) | (start % ms != 0) | (F.col("end_timestamp_ms") - start != ms),
        "prices": (low < 0) | (h < low) | (h < o) | (h < c) | (low > o) | (low > c),
        "volume": (F.col("volume") < 0) | (F.col("trades_count") < 1),
        "trade_ids": (F.col("start_trade_id") < 0) | (F.col("start_trade_id") > F.col("end_trade_id")),
    }


def check_candles_integrity(candles: DataFrame, symbols: list[str], ms: int) -> DataFrame:
    """Stored candles of ms milliseconds: rows of each violation; of a row the first rule it breaks. A null breaks the rules on its column."""
    return candles.withColumn("violation", _first(_candle_rules(symbols, ms))).where("violation is not null").groupBy("violation").agg(F.count("*").alias("n"))


def bad_candle_rows(candles: DataFrame, symbols: list[str], ms: int) -> DataFrame:
    """Keys of the candles to delete: those that break a rule, and those of a key that several rows have, since none can be told to be right."""
    keys = ["symbol", "start_timestamp_ms"]
    marked = candles.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_or(_first(_candle_rules(symbols, ms)).isNotNull()).alias("bad"))
    return marked.where("bad or n > 1").select(*keys)


def cleaned_candles(candles: DataFrame, trades: DataFrame, symbols: list[str], ms: int) -> DataFrame:
    """Candles without bad ones; what lies in an interval without a candle then, but with trades of known symbols, is made again from these."""
    from candlewick.operators.bars import candle_start, candles_of_width

    keys = ["symbol", "start_timestamp_ms"]
    bad = bad_candle_rows(candles, symbols, ms)
    kept = candles.join(bad, (candles.symbol.eqNullSafe(bad.symbol)) & candles.start_timestamp_ms.eqNullSafe(bad.start_timestamp_ms), "left_anti")
    own = trades.where(F.col("symbol").isin(symbols)).withColumn("_start", candle_start(ms))
    lost = own.join(kept.select("symbol", F.col("start_timestamp_ms").alias("_start")), ["symbol", "_start"], "left_anti").drop("_start")
    return kept.select(*keys, *(c for c in CANDLE_COLUMNS if c not in keys)).unionByName(candles_of_width(lost, ms).select(*CANDLE_COLUMNS))


CANDLE_COLUMNS = ("symbol", "start_timestamp_ms", "open_price", "high_price", "low_price", "close_price", "volume", "trades_count", "start_trade_id", "end_trade_id", "end_timestamp_ms")


def duplicate_timestamps(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", "start_timestamp_ms").agg(F.count("*").alias("n")).where("n > 1")


def zero_volume_bars(bars: DataFrame) -> DataFrame:
    return bars.where("total_volume = 0")


def row_counts(tables: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Rows of source and target of each table."""
    out = None
    for name, (source, target) in tables.items():
        s, t = source.agg(F.count("*").alias("source_rows")), target.agg(F.count("*").alias("target_rows"))
        one = s.withColumn("table", F.lit(name)).join(t.withColumn("table", F.lit(name)), "table")
        out = one if out is None else out.unionByName(one)
    return out


def candle_trade_consistency(candles: DataFrame, trades: DataFrame, bands: DataFrame) -> DataFrame:
    """Start and end ids of candles that trades lack, and whether candles and bands have as many rows."""
    known = trades.select("symbol", "trade_id")
    lacking = None
    for end in ("start", "end"):
        ids = candles.select("symbol", F.col(f"{end}_trade_id").alias("trade_id")).distinct().join(known, ["symbol", "trade_id"], "left_anti")
        one = ids.agg(F.count("*").alias("failures")).withColumn("check", F.lit(f"{end} ids"))
        lacking = one if lacking is None else lacking.unionByName(one)
    both = candles.select(F.lit(1).alias("x")).union(bands.select(F.lit(-1))).agg(F.abs(F.coalesce(F.sum("x"), F.lit(0))).cast("bigint").alias("failures")).withColumn("check", F.lit("bands rows"))
    return lacking.unionByName(both).select("check", (F.col("failures") == 0).alias("passed"), "failures")
