"""Ordered operators give the same for one chunk and for many; hand-worked runs and segments."""

import pytest
from pyspark.sql import functions as F

from candlewick.operators import bars, indicators, runs, scan


def trades(spark, n=300):
    i = F.col("id")
    price = (100 + (i * 37 % 11) - (i * 13 % 7)).cast("decimal(18,8)")
    return spark.range(n).select(F.when(i % 3 == 0, "a").otherwise("b").alias("symbol"), i.alias("trade_id"), (i * 7 % 5 < 2).alias("is_buy"), price.alias("price"), (1 + i % 4).cast("decimal(18,8)").alias("quantity"), (i * 250).alias("timestamp_ms"))


def rows(df):
    return sorted((tuple(str(x) for x in r) for r in df.select(*sorted(df.columns)).collect()))


def test_chunks_do_not_matter(spark):
    t = trades(spark)
    for f in (lambda c: runs.run_bars_side(t, chunks=c), lambda c: runs.zigzag_lines(t, chunks=c)):
        assert rows(f(1)) == rows(f(7))
    ema = lambda c: indicators.ema(t, "trade_id", "price", chunks=c).withColumn("ema", F.round("ema", 9))
    assert rows(ema(1)) == rows(ema(7))


def test_index_counts_from_0(spark):
    got = scan.index(trades(spark, 50), ["symbol"], ["trade_id"], "i", chunks=6)
    assert sorted(r.i for r in got.where("symbol = 'a'").collect()) == list(range(17))


def test_zigzag_by_hand(spark):
    prices = [100000, 99900, 99900, 99800, 99800, 99800, 99700, 99700, 99600, 99600, 99500, 99600]
    t = spark.createDataFrame([("x", i + 1, True, p, 1, i) for i, p in enumerate(prices)], "symbol string, trade_id bigint, is_buy boolean, price bigint, quantity bigint, timestamp_ms bigint")
    got = sorted((r.start_trade_id, r.end_trade_id, r.trading_direction, r.start_price, r.end_price, r.quantity) for r in runs.zigzag_lines(t).collect())
    assert got == [(1, 11, "Bear", 100000, 99500, 11), (11, 12, "Bull", 99500, 99600, 1)]


def test_rsi_without_losses_is_100(spark):
    c = spark.range(50).select(F.lit("x").alias("symbol"), F.col("id").alias("start_trade_id"), (100 + F.col("id")).alias("close_price"))
    got = {r.start_trade_id: r.rsi for r in indicators.rsi(c, chunks=4).collect()}
    assert got[13] is None and all(got[i] == 100 for i in range(14, 50))


def test_fetch_limit():
    assert bars.chart_fetch_limit(4, 1_000_000, points=50) == 204 and bars.chart_fetch_limit(1, 0) == 1


@pytest.mark.parametrize(("parts", "chunks"), [(64, 20), (4, 20), (64, 2), (4, 64)])
def test_chunks_of_clustered_ids_are_alike(spark, monkeypatch, parts, chunks):
    """Three clusters of ids far apart, one of many equal ids, and a symbol with few rows."""
    monkeypatch.setattr(scan, "_PARTS", parts)
    ids = [*range(2000), *range(10**12, 10**12 + 900), *range(10**15, 10**15 + 7000, 7), *([10**15 + 1] * 40)]
    t = spark.createDataFrame([("a", i) for i in ids] + [("b", i) for i in range(30)], "symbol string, trade_id bigint").repartition(5)
    own = scan.chunked(t, ["symbol"], "trade_id", chunks).groupBy("symbol", scan.CHUNK).agg(F.count("*").alias("n"), F.min("trade_id").alias("low"), F.max("trade_id").alias("high")).orderBy("symbol", scan.CHUNK).collect()
    a, b = ([r for r in own if r.symbol == s] for s in "ab")
    assert sum(r.n for r in a) == len(ids) and sum(r.n for r in b) == 30 and len(b) == 1
    assert all(r.high < q.low for r, q in zip(a, a[1:], strict=False))
    assert max(r.n for r in a) <= 2 * len(ids) / chunks + 40 and len(a) >= chunks / 2


def test_small_keys_are_one_chunk(spark):
    assert {r[scan.CHUNK] for r in scan.chunked(trades(spark), ["symbol"], "trade_id").collect()} == {0}
    assert scan.chunked(trades(spark, 0), ["symbol"], "trade_id").count() == scan.chunked(trades(spark, 0), ["symbol"], "trade_id", 7).count() == 0
