"""Derives trades and order-book level changes from the given tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,8)"
DAY_MS = 86_400_000
#: Ids of a day of lineitem: order keys below 10**10 stay apart and in order of time, and ids exact as doubles.
ID_DAY = 10**11


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, trade_id, is_buy, price, quantity, timestamp_ms; ids rise with time."""
    k = F.regexp_extract("props", r'"k": ?(\d+)', 1).cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("trade_id"), (F.col("user_id") % 2 == 0).alias("is_buy"),
        F.col("value").cast(MONEY).alias("price"), (k + 1).cast(MONEY).alias("quantity"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
    )


def raw_trades_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of three symbols of equal size; some ids occur more than once."""
    day = F.unix_date(F.col("l_shipdate").cast("date"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("symbol"), (day.cast("bigint") * ID_DAY + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"),
        (F.col("l_suppkey") % 2 == 0).alias("is_buy"), (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 10_000 + 0.5) / 10_000).cast(MONEY).alias("price"),
        F.col("l_quantity").cast(MONEY).alias("quantity"), (day.cast("bigint") * DAY_MS).alias("timestamp_ms"), "l_partkey", "l_suppkey",
    )


def trades_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one row for each id, that of the least (l_partkey, l_suppkey)."""
    w = Window.partitionBy("symbol", "trade_id").orderBy("l_partkey", "l_suppkey", "price", "quantity")
    first = raw_trades_from_lineitem(spark, sf_dir).withColumn("_row", F.row_number().over(w)).where("_row = 1")
    return first.drop("_row", "l_partkey", "l_suppkey")


def book_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, timestamp_ms, event_id, action, side, price, quantity: a level change per event; each day begins with a snapshot."""
    k = F.regexp_extract("props", r'"k": ?(\d+)', 1).cast("int")
    day = Window.partitionBy("event_type", F.to_date("ts")).orderBy("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), "event_id",
        F.when(F.row_number().over(day) == 1, "Snapshot").otherwise("Update").alias("action"),
        F.when(F.col("event_id") % 2 == 0, "ask").otherwise("bid").alias("side"), F.round("value").cast(MONEY).alias("price"), (k % 10).cast(MONEY).alias("quantity"),
    )


def messages_from_book(book: DataFrame) -> DataFrame:
    """The changes of book_from_events as messages: symbol, timestamp_ms, event_id, action, asks and bids as JSON text."""
    level = F.array(F.array(F.col("price").cast("string"), F.col("quantity").cast("string"), F.lit("0"), F.lit("0")))
    side = lambda s: F.to_json(F.when(F.col("side") == s, level).otherwise(F.array().cast("array<array<string>>")))
    return book.select("symbol", "timestamp_ms", "event_id", "action", side("ask").alias("asks"), side("bid").alias("bids"))
