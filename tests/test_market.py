"""Hand-worked cases of checks, candles, bands, books, sources and positions; odd inputs."""

import pytest
from pyspark.sql import functions as F

from candlewick.operators import bars, book, indicators, layers, migrate, positions, quality, runs
from candlewick.sources import tables

TRADES = "symbol string, trade_id bigint, is_buy boolean, price decimal(18,8), quantity decimal(18,8), timestamp_ms bigint"
CHANGES = "symbol string, data_set_idx bigint, timestamp_ms bigint, event_id bigint, side string, price decimal(18,8), quantity decimal(18,8)"


def frame(spark, schema, rows):
    from decimal import Decimal

    money = [i for i, c in enumerate(schema.replace("decimal(18,8)", "money").split(", ")) if c.endswith(" money")]
    return spark.createDataFrame([tuple(Decimal(str(x)) if i in money and x is not None else x for i, x in enumerate(r)) for r in rows], schema)


def trades_of(spark, ids, prices, quantities):
    return frame(spark, TRADES, [("x", i, True, p, q, i) for i, p, q in zip(ids, prices, quantities, strict=True)])


def failures(df):
    return {r.check: r.failures for r in df.collect()}


@pytest.mark.parametrize(
    ("ids", "prices", "expected"),
    [
        ((1, 2, 3, 4, 5), (100, 101, 102, 103, 104), (0, 0)),
        ((1, 2, 3), (-100, 101, 2_000_000), (2, 0)),
        ((1, 2, 2, 3), (100, 101, 102, 103), (0, 1)),
        ((), (), (0, 0)),
        ((1, 2), (None, 5), (1, 0)),
    ],
)
def test_validate_trades(spark, ids, prices, expected):
    got = failures(quality.validate_trades(trades_of(spark, ids, prices, [1] * len(ids))))
    assert (got["price range"], got["unique trade_id"], got["quantity range"]) == (*expected, 0)


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="Missing required columns"):
        quality.validate_trades(trades_of(spark, (1,), (1,), (1,)).drop("quantity", "timestamp_ms"))


def test_unsorted(spark):
    t = trades_of(spark, (3, 1, 2), (1, 1, 1), (1, 1, 1)).withColumn("position", F.when(F.col("trade_id") == 3, 0).otherwise(F.col("trade_id")).cast("bigint"))
    assert [r.trade_id for r in quality.unsorted_check(t).collect()] == [1]


def test_validate_candles_bands_rsi(spark):
    rows = [(100.0, 102.0, 99.0, 101.0), (103.0, 105.0, 102.0, 104.0), (106.0, 108.0, 105.0, 107.0)]
    schema = "open_price double, high_price double, low_price double, close_price double"
    assert failures(quality.validate_candles(spark.createDataFrame(rows, schema))) == {"high": 0, "low": 0, "price range": 0}
    spoilt = [(100.0, 99.0, 101.0, 100.5), *rows[1:]]
    assert failures(quality.validate_candles(spark.createDataFrame(spoilt, schema))) == {"high": 1, "low": 1, "price range": 0}
    bands = lambda top: spark.createDataFrame([(top, 100.0, 98.0), (None, None, None)], "upper_band double, middle_band double, lower_band double")
    assert failures(quality.validate_bands(bands(102.0))) == {"upper band": 0, "lower band": 0}
    assert failures(quality.validate_bands(bands(98.0))) == {"upper band": 1, "lower band": 0}
    rsi = spark.createDataFrame([(30.0,), (50.0,), (101.0,), (-1.0,), (None,)], "rsi double")
    assert failures(quality.validate_rsi(rsi)) == {"rsi range": 2, "rsi nulls": 1}
    got = quality.validation_summary(quality.validate_rsi(rsi)).first()
    assert (got.total, got.passed, got.failed, got.success_rate, got.errors) == (2, 0, 2, 0.0, ["rsi nulls", "rsi range"])


def test_candle_trade_consistency(spark):
    t = trades_of(spark, (1, 2, 3), (1, 1, 1), (1, 1, 1))
    candles = spark.createDataFrame([("x", 1, 2), ("x", 3, 4), ("x", 7, 9)], "symbol string, start_trade_id bigint, end_trade_id bigint")
    assert failures(quality.candle_trade_consistency(candles, t, candles.limit(2))) == {"start ids": 1, "end ids": 2, "bands rows": 1}


def test_stored_candles(spark):
    """Of each rule one candle that breaks it, nulls, two rows of one key; what is lost is made again from trades."""
    good = ("x", 0, 2.0, 3.0, 1.0, 2.0, 5.0, 2, 1, 2, 60)
    names = quality.CANDLE_COLUMNS

    def but(**new):
        return tuple(new.get(n, v) for n, v in zip(names, good, strict=True))

    bad = {"symbol": [but(symbol="y"), but(symbol=None)], "timestamp": [but(start_timestamp_ms=1), but(end_timestamp_ms=70)], "prices": [but(high_price=1.5, start_timestamp_ms=240, end_timestamp_ms=300), but(open_price=None, start_timestamp_ms=300, end_timestamp_ms=360)], "volume": [but(volume=-1.0, start_timestamp_ms=360, end_timestamp_ms=420)], "trade_ids": [but(end_trade_id=0, start_timestamp_ms=420, end_timestamp_ms=480)]}
    twice = [but(start_timestamp_ms=480, end_timestamp_ms=540)] * 2
    fine = but(start_timestamp_ms=600, end_timestamp_ms=660)
    schema = "symbol string, start_timestamp_ms bigint, open_price double, high_price double, low_price double, close_price double, volume double, trades_count bigint, start_trade_id bigint, end_trade_id bigint, end_timestamp_ms bigint"
    c = spark.createDataFrame([r for rows in bad.values() for r in rows] + twice + [fine], schema)
    assert {r.violation: r.n for r in quality.check_candles_integrity(c, ["x"], 60).collect()} == {k: len(v) for k, v in bad.items()}
    keys = {(r.symbol, r.start_timestamp_ms) for r in quality.bad_candle_rows(c, ["x"], 60).collect()}
    assert keys == {(r[0], r[1]) for rows in bad.values() for r in rows} | {("x", 480)}
    t = spark.createDataFrame([("x", 5, True, 4.0, 2.0, 485), ("x", 6, True, 9.0, 1.0, 610), ("y", 7, True, 9.0, 1.0, 0)], "symbol string, trade_id bigint, is_buy boolean, price double, quantity double, timestamp_ms bigint")
    got = sorted(tuple(r[n] for n in names) for r in quality.cleaned_candles(c, t, ["x"], 60).collect())
    assert got == [("x", 480, 4.0, 4.0, 4.0, 4.0, 8.0, 1, 5, 5, 540), fine]
    assert quality.check_candles_integrity(c.limit(0), ["x"], 60).count() == quality.bad_candle_rows(c.limit(0), ["x"], 60).count() == 0


def test_minute_candles_from_seconds(spark):
    i = F.col("id")
    t = spark.range(300).select(F.lit("x").alias("symbol"), i.alias("trade_id"), (i % 2 == 0).alias("is_buy"), (50000 + i % 100).cast("decimal(18,8)").alias("price"), F.lit(0.1).cast("decimal(18,8)").alias("quantity"), (i * 1000).alias("timestamp_ms"))
    got = sorted((r.start_trade_id, r.end_trade_id, r.trades_count, float(r.open_price), float(r.close_price), float(r.high_price)) for r in bars.time_candles(t, "1m").collect())
    assert got == [(0, 59, 60, 50000, 50059, 50059), (60, 119, 60, 50060, 50019, 50099), (120, 179, 60, 50020, 50079, 50079), (180, 239, 60, 50080, 50039, 50099), (240, 299, 60, 50040, 50099, 50099)]
    wide = {(r.interval, r.trades_count) for r in bars.multi_interval_candles(t, ("1m", "5m", "1D")).collect()}
    assert wide == {("1m", 60), ("5m", 300), ("1D", 300)}


def test_bands_of_20(spark):
    import statistics

    prices = [100.0 + (i // 2) + (i % 2) * 2 for i in range(30)]
    df = spark.createDataFrame([("x", i, p) for i, p in enumerate(prices)], "symbol string, start_trade_id bigint, close_price double")
    got = sorted(indicators.bollinger_bands(df, block=40).collect(), key=lambda r: r.start_trade_id)
    assert [r.middle_band is None for r in got] == [True] * 19 + [False] * 11
    for r in got[19:]:
        last = prices[r.start_trade_id - 19 : r.start_trade_id + 1]
        assert r.middle_band == pytest.approx(statistics.fmean(last)) and r.upper_band == pytest.approx(statistics.fmean(last) + 2 * statistics.pstdev(last))
        assert r.upper_band > r.middle_band > r.lower_band


@pytest.mark.parametrize("chunks", [1, 6])
def test_ema_and_rsi_step_by_step(spark, chunks):
    prices = [100 + (i * 37 % 11) - (i * 13 % 7) for i in range(60)]
    df = spark.createDataFrame([("x", i, float(p)) for i, p in enumerate(prices)], "symbol string, start_trade_id bigint, close_price double")
    want = [float(prices[0])]
    for p in prices[1:]:
        want.append(0.1 * p + 0.9 * want[-1])
    got = sorted(indicators.ema(df, "start_trade_id", "close_price", chunks=chunks).collect(), key=lambda r: r.start_trade_id)
    assert [r.ema for r in got] == pytest.approx(want)
    moves = [b - a for a, b in zip(prices, prices[1:], strict=False)]
    gain, loss = sum(max(m, 0) for m in moves[:14]) / 14, sum(max(-m, 0) for m in moves[:14]) / 14
    values = [100 - 100 / (1 + gain / loss)]
    for m in moves[14:]:
        gain, loss = (gain * 13 + max(m, 0)) / 14, (loss * 13 + max(-m, 0)) / 14
        values.append(100 - 100 / (1 + gain / loss))
    got = sorted(indicators.rsi(df, chunks=chunks).collect(), key=lambda r: r.start_trade_id)
    assert [r.rsi for r in got[:14]] == [None] * 14 and [r.rsi for r in got[14:]] == pytest.approx(values)


def events(*messages):
    """Level changes of (time, side, price, quantity, ...) messages of one data set."""
    return [("x", 0, m[0], n, side, p, q) for n, m in enumerate(messages) for side, p, q in zip(m[1::3], m[2::3], m[3::3], strict=True)]


FULL = ("ask", 50000, 1, "ask", 50001, 2, "bid", 49999, 1.5, "bid", 49998, 2.5)
NEXT = ("ask", 50000, 0.5, "ask", 50001, 1.5, "bid", 49999, 2, "bid", 49998, 3)


def test_interval_record(spark):
    changes = frame(spark, CHANGES, events((1000, *FULL), (2000, *NEXT)))
    t = frame(spark, TRADES, [("x", 1, True, 50000.5, 0.1, 1500), ("x", 2, False, 49999.5, 0.2, 1800)])
    (r,) = book.interval_records(t, changes).collect()
    assert (r.data_set_idx, r.record_idx, r.total_trades_count, r.buy_trades_count, r.start_trade_id, r.end_trade_id) == (0, 0, 2, 1, 1, 2)
    assert [float(x) for x in (r.buy_quantity, r.total_quantity, r.open_price, r.high_price, r.low_price, r.close_price)] == [0.1, 0.3, 50000.5, 50000.5, 49999.5, 49999.5]
    assert (r.start_timestamp_ms, r.end_timestamp_ms, r.start_asks_total_quantity, r.end_asks_total_quantity, r.start_bids_total_quantity, r.end_bids_total_quantity) == (1000, 2000, 3, 2, 4, 5)
    assert (r.max_start_ask_price, r.min_start_ask_price, r.max_end_bid_quantity) == (50001, 50000, 3)
    assert book.interval_records(t.limit(0), changes).count() == 0  # no trades
    assert book.interval_records(t, changes.where("event_id = 0")).count() == 0  # one message
    assert book.interval_records(t, changes.limit(0)).count() == 0


def test_several_intervals(spark):
    changes = frame(spark, CHANGES, events((1000, *FULL), (2000, *NEXT), (3000, "ask", 50000, 0)))
    t = frame(spark, TRADES, [("x", 1, True, 50000, 1, 1500), ("x", 2, True, 50000, 1, 2500), ("x", 3, True, 50000, 1, 999), ("x", 4, True, 50000, 1, 3000)])
    assert sorted((r.record_idx, r.start_trade_id, r.total_trades_count) for r in book.interval_records(t, changes).collect()) == [(0, 1, 1), (1, 2, 1)]


def test_empty_intervals_are_carried(spark):
    changes = frame(spark, CHANGES, events((1000, "ask", 50000, 1), (2000, "bid", 49999, 2), (3000, "ask", 50000, 3), (4000, "ask", 50001, 1), (5000, "bid", 49999, 0), (6000, "bid", 49998, 7)))
    t = frame(spark, TRADES, [("x", 1, True, 50000, 1, 3500), ("x", 2, True, 50000, 1, 5500)])
    plain = sorted(book.interval_records(t, changes).collect(), key=lambda r: r.record_idx)
    assert [(r.start_timestamp_ms, r.start_asks_total_quantity, r.start_bids_total_quantity) for r in plain] == [(3000, 3, 2), (5000, 4, 0)]
    carried = sorted(book.interval_records(t, changes, carry_empty_intervals=True).collect(), key=lambda r: r.record_idx)
    # bids are empty at first, so theirs start at the second event
    assert [(r.start_timestamp_ms, r.start_asks_total_quantity, r.start_bids_total_quantity, r.max_start_bid_price) for r in carried] == [(1000, 1, 2, 49999), (4000, 4, 2, 49999)]
    assert [(r.end_timestamp_ms, r.end_bids_total_quantity, r.start_trade_id) for r in carried] == [(r.end_timestamp_ms, r.end_bids_total_quantity, r.start_trade_id) for r in plain]
    assert set(carried[0].asDict()) == set(plain[0].asDict())


def test_snapshot_side_stats(spark):
    m = spark.createDataFrame([("x", 1000, 0, '[["50000","1","0","0"],["50001","2","0","0"],["50002","0.5","0","0"],["bad","1"],["3","x"]]', "[]")], "symbol string, timestamp_ms bigint, event_id bigint, asks string, bids string")
    (r,) = book.snapshot_side_stats(m).collect()
    assert [float(x) for x in (r.total_quantity, r.min_price, r.max_price, r.min_quantity, r.max_quantity, r.min_volume, r.max_volume)] == [3.5, 50000, 50002, 0.5, 2, 25001, 100002]


def test_data_sets_leave_the_open_one_out(spark):
    e = spark.createDataFrame([("x", i, i, a) for i, a in enumerate(["Update", "Snapshot", "Update", "Snapshot", "Update"])], "symbol string, timestamp_ms bigint, event_id bigint, action string")
    assert sorted((r.event_id, r.data_set_idx) for r in book.data_sets(e, chunks=2).collect()) == [(1, 0), (2, 0)]
    assert sorted((r.event_id, r.data_set_idx) for r in book.data_sets(e, keep_open=True).collect()) == [(1, 0), (2, 0), (3, 1), (4, 1)]


def test_run_bars_leave_the_open_run_out(spark):
    sides = [True, True, False, True, True]
    t = frame(spark, TRADES, [("x", i, s, 10 + i, 1, i) for i, s in enumerate(sides)])
    assert sorted((r.start_trade_id, r.end_trade_id, r.total_trades_count) for r in runs.run_bars_side(t, chunks=3).collect()) == [(0, 1, 2), (2, 2, 1)]
    assert runs.run_bars_side(t, emit_open=True).count() == 3
    assert runs.run_bars_side(t.limit(0)).count() == 0
    assert runs.run_bars_direction(runs.run_bars_side(t)).count() == 0  # one bar is flat, the other one's run is open


def test_extreme_lines_against_every_pair(spark):
    prices = [100 + (i * 37 % 11) - (i * 13 % 7) for i in range(80)]
    lines = runs.zigzag_lines(trades_of(spark, range(80), prices, [1] * 80))
    got = {chunks: sorted((r.price, r.start_trade_id, r.end_trade_id) for r in layers.extreme_lines(lines, lines.groupBy("symbol").agg(F.max("end_trade_id").alias("max_trade_id")), chunks=chunks).collect()) for chunks in (1, 5)}
    assert got[1] == got[5] and got[1]
    rows = sorted(lines.collect(), key=lambda r: r.start_trade_id)
    last = max(r.end_trade_id for r in rows)
    for price, start, end in got[1]:
        later = [r.start_trade_id for r in rows if r.start_trade_id >= start and r.end_trade_id > start and min(r.start_price, r.end_price) <= price <= max(r.start_price, r.end_price)]
        assert end == next((x for x in sorted(later) if x > start), last) or end in later


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "e"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, migrate.upsert(new, old, ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert tuple(migrate.upsert_report(new, old, ["id"]).first()) == (3, 1, 2)
    assert sorted(map(tuple, migrate.replace(new.where("id = 2"), old, ["id"]).collect())) == [(1, "a"), (2, "c")]
    assert [r.id for r in migrate.missing(new, old, ["id"]).collect()] == [3]


def test_merge_candles(spark):
    schema = "symbol string, start_trade_id bigint, close_price double"
    old = spark.createDataFrame([("x", 1, 1.0), ("x", 5, 5.0)], schema)
    new = spark.createDataFrame([("x", 1, None), ("x", 3, 3.0), ("x", 5, 6.0), ("x", 9, 9.0)], schema)
    assert sorted(map(tuple, migrate.merge_candles(old, new).collect())) == [("x", 1, 1.0), ("x", 5, 6.0), ("x", 9, 9.0)]


def test_parsers(spark):
    one = lambda text: spark.createDataFrame([(text,)], "value string")
    t = tables.parse_trades_json(one('[{"tradeId":"7","instId":"A-B","ts":"1000","px":"1.5","sz":"2","side":"sell"}]')).first()
    assert (t.symbol, t.trade_id, t.is_buy, float(t.price), float(t.quantity), t.timestamp_ms) == ("A-B", 7, False, 1.5, 2, 1000)
    c = tables.parse_candles_json(one('[["1000","1","3","0.5","2","10","20","30","1"]]')).first()
    assert (c.start_timestamp_ms, float(c.open_price), float(c.high_price), float(c.volume_quote), c.is_closed) == (1000, 1, 3, 30, True)
    m = tables.parse_book_messages(one('{"action":"snapshot","arg":{"instId":"A-B"},"data":[{"asks":[["1","2","0","0"]],"bids":[["x","2"]],"seqId":9,"prevSeqId":-1,"ts":"5"}]}')).first()
    assert (m.symbol, m.timestamp_ms, m.action, float(m.asks[0].price), m.bids[0].price, m.seq_id, m.prev_seq_id) == ("A-B", 5, "Snapshot", 1, None, 9, -1)
    assert tables.parse_trades_json(one(None)).count() == tables.parse_trades_json(one("no json")).count() == 0


def test_csv_quarantine(spark, tmp_path):
    head = "instrument_name,trade_id,side,price,size,created_time\n"
    (tmp_path / "AAA-BBB-trades-2024-01.csv").write_text(head + "AAA-BBB,1,buy,2,1.5,1000\nAAA-BBB,2,Sell,1.5,2,1001\nAAA-CCC,3,buy,1,1,1\nAAA-BBB,4,hold,1,1,1\nAAA-BBB,5,buy,1,x,1\n")
    (tmp_path / "AAA-BBB-trades-2024-02.csv").write_text("instrument_name,trade_id,side,size,price,created_time\nAAA-BBB,6,buy,2,1.5,1000\n")
    (tmp_path / "AAA-BBB-trades-2024-03.csv").write_text("a,b\nAAA-BBB,7\n")
    (tmp_path / "AAA-BBB-trades-2024-04.csv").write_text(head)
    (tmp_path / "AAA-BBB-trades-2024-05.csv").write_text("")
    good, bad = tables.ingest_trades_csv(spark, f"{tmp_path}/*.csv")
    assert sorted((r.trade_id, r.is_buy, float(r.price), float(r.quantity)) for r in good.collect()) == [(1, True, 2, 1.5), (2, False, 1.5, 2)]
    found = sorted((r.trade_id, r.reason) for r in bad.collect() if r.instrument_name == "AAA-BBB" or r.trade_id == "3")
    assert found == [("3", "instrument"), ("4", "side"), ("5", "number"), ("6", "header"), ("7", "header")]


def test_exported_bars_are_read_back_from_named_files(spark, tmp_path):
    t = frame(spark, TRADES, [(s, i, i % 3 == 0, 10 + i % 4, 1, 5 * i) for s in ("btc_usd", "eth_usd") for i in range(40)])
    own = runs.run_bars_side(t)
    tables.export_bars_csv(own, f"{tmp_path}/out", 2, 10)
    assert sorted(p.name for p in (tmp_path / "out").glob("*.csv")) == ["btc_0M_to_0M.csv", "eth_0M_to_0M.csv"]
    assert (tmp_path / "out/btc_0M_to_0M.csv").read_text().split("\n")[0] == ",".join(tables.BAR_CSV)
    got = tables.read_bars_csv(spark, f"{tmp_path}/out/*.csv", own.schema)
    want = bars.bar_index(own).where("bar_index between 2 and 11").select(*tables.BAR_CSV)
    assert sorted(map(str, got.drop("file").collect())) == sorted(map(str, want.collect())) and got.count() == 20
    names = tables.export_range(spark.range(3).selectExpr("'a_b' as symbol", "id as start_trade_id"), 1_000_000, 5)
    assert names.count() == 0 and names.columns[-1] == "file"


def test_excursions(spark):
    p = spark.createDataFrame([(1, "x", "long", 100.0, 7.0, "x8", 0, 3), (2, "x", "short", 100.0, 7.0, "x8", 0, 3)], "position_id int, symbol string, side string, entry_price double, notional_usd double, horizon string, entry_index bigint, exit_index bigint")
    b = spark.createDataFrame([("x", i, c, i) for i, c in enumerate([100.0, 110.0, 90.0, 105.0])], "symbol string, bar_index bigint, close_price double, start_timestamp_ms bigint")
    e = {r.position_id: r for r in positions.position_metrics(positions.position_excursions(p, b)).collect()}
    assert (e[1].mfe_gross, e[1].mae_gross, e[1].mfe_mark_price, e[1].bars_elapsed, e[1].bars_remaining) == pytest.approx((0.1, -0.1, 110, 3, 5))
    assert (e[2].mfe_gross, e[2].mae_gross, e[2].mfe_mark_price) == pytest.approx((0.1, -0.1, 90))
    assert e[1].unrealized_net_return_pct == pytest.approx(100 * (0.05 - 0.0005)) and e[1].progress_pct == 37.5


def test_raster_of_levels_of_any_length(spark):
    extent = spark.createDataFrame([("x", 0.0, 100.0, 0, 2_000_000, 1.0)], "symbol string, min_price double, max_price double, min_trade_id bigint, max_trade_id bigint, scale double")
    levels = lambda rows: spark.createDataFrame([("x", *r) for r in rows], "symbol string, price double, start_trade_id bigint, end_trade_id bigint")
    long = layers.extreme_line_raster(levels([(5.0, 7, 1_500_007)]), extent)
    assert long.agg(F.count("*"), F.min("x"), F.max("x"), F.sum("value"), F.sum((F.col("x") - F.col("value") - 7) ** 2)).first() == (1_500_000, 7, 1_500_006, 1_500_000 * 1_499_999 // 2, 0)
    rows = [(5.0, 0, 10), (5.0, 3, 12), (5.5, 4, 12), (9.0, 1, 9), (9.0, 9, 9), (99.0, 2, 10)]
    best = {}
    for price, a, b in rows:
        for x in range(a, b):
            best[x, int(price)] = max(best.get((x, int(price)), ()), (b, a, price))
    for size in (1, 4, 8, 100):
        got = layers.extreme_line_raster(levels(rows), extent, range_cells=size).collect()
        assert sorted((r.x, r.y, r.value) for r in got) == sorted((x, y, x - a) for (x, y), (_, a, _) in best.items())


def test_queries_of_all_rows(spark):
    from candlewick.plans import market, research
    from candlewick.plans.registry import QUERIES
    from candlewick.sources import adapters

    d = "/root/testdata/sf0.001"
    starts = sorted(tuple(r) for r in market.bars_of(spark, d).select("symbol", "start_trade_id").collect())
    got = {(r.symbol, r.start_trade_id): r.bars for r in QUERIES["count_bars_since"](spark, d).collect()}
    newer = {}
    for key in reversed(starts):
        newer[key[0]] = newer.get(key[0], 0) + 1
        assert got.pop(key) == newer[key[0]]
    assert not got and len(starts) > 100

    book_rows = adapters.book_from_events(spark, d).select("symbol", "timestamp_ms", "action").collect()
    snaps = {}
    for r in book_rows:
        if r.action == "Snapshot":
            snaps.setdefault(r.symbol, set()).add(r.timestamp_ms)
    want = set()
    for s, t in {(r.symbol, r.timestamp_ms) for r in book_rows}:
        own = snaps.get(s, ())
        want.add((s, t, max((x for x in own if x <= t), default=None), min((x for x in own if x >= t), default=None), min((x for x in own if x > t), default=None)))
    found = QUERIES["latest_snapshot_before"](spark, d).select("symbol", "timestamp_ms", "last_at_or_before", "first_at_or_after", "next_after").collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want

    candles = sorted((r.symbol, r.bar_index, float(r.close_price)) for r in research.opened(spark, d)[1].collect())
    price = {(s, i): p for s, i, p in candles}
    gross = lambda s, i, j: (1, -1)[i % 2] * (price[s, j] - price[s, i]) / price[s, i]
    name = lambda s, i: f"{s}-{i:08d}"
    marks = {(name(s, i), j): (price[s, j], gross(s, i, j)) for s, i in price for j in range(i + 1, i + 9) if (s, j) in price}
    rows = QUERIES["position_bars"](spark, d).collect()
    assert {(r.position_id, r.bar_index): r.mark_price for r in rows} == {k: pytest.approx(p, abs=1e-6) for k, (p, _) in marks.items()} and len(rows) == len(marks)
    assert {(r.position_id, r.bar_index): r.gross for r in QUERIES["gross_net_return"](spark, d).collect()} == {k: pytest.approx(g, abs=2e-6) for k, (_, g) in marks.items()}
    best = {name(s, i): max([0.0, *(gross(s, i, j) for j in range(i + 1, i + 9) if (s, j) in price)]) for s, i in price}
    assert {r.position_id: r.mfe_gross for r in QUERIES["position_excursions"](spark, d).collect()} == {k: pytest.approx(x, abs=2e-6) for k, x in best.items()}
    assert QUERIES["position_metrics"](spark, d).count() == len(candles)
    ended = [(s, i) for s, i in price if (s, i + 8) in price]
    assert QUERIES["close_positions"](spark, d).count() == len(ended)
    one = QUERIES["journal_summary"](spark, d).first()
    assert one.n_trades == len(ended) and one.realized_pnl_usd == pytest.approx(sum(7 * (gross(s, i, i + 8) - 0.001) for s, i in ended), rel=1e-4, abs=1e-3)
    assert QUERIES["journal_last_closed"](spark, d).count() == 20


def test_queries_of_all_scales_and_intervals(spark):
    from collections import Counter

    from candlewick.plans import market
    from candlewick.plans.registry import QUERIES

    d = "/root/testdata/sf0.001"
    trades = [(r.symbol, r.timestamp_ms) for r in market.trades_of(spark, d).select("symbol", "timestamp_ms").collect()]
    found = QUERIES["multi_interval_candles"](spark, d).select("interval", "symbol", "start_timestamp_ms", "trades_count").collect()
    assert {tuple(r)[:3]: r.trades_count for r in found} == Counter((name, s, t - t % ms) for name, ms in bars.INTERVALS.items() for s, t in trades)
    found = QUERIES["trade_velocity"](spark, d).select("symbol", "start_timestamp_ms", "trades_count").collect()
    assert {tuple(r)[:2]: r.trades_count for r in found} == Counter((s, t - t % 60_000) for s, t in trades)
    shown = ["symbol", "start_trade_id", "total_trades_count"]

    def held(d):
        out = {}
        for r in sorted(market.bars_of(spark, d).select(*shown).collect()):
            out.setdefault(r.symbol, []).append((r.start_trade_id, r.total_trades_count))
        return out

    grouped = lambda n, held: sorted((n, s, rows[i][0], sum(c for _, c in rows[i : i + n])) for s, rows in held.items() for i in range(0, len(rows), n))
    small, large = held(d), held("/root/testdata/sf0.01")
    assert max(map(len, large.values())) > 204
    assert sorted((4, *r) for r in QUERIES["chart_fetch_limit"](spark, "/root/testdata/sf0.01").select(*shown).collect()) == grouped(4, large)
    found = QUERIES["bar_pyramid"](spark, d).select("scale", *shown).collect()
    assert sorted(map(tuple, found)) == [x for i in range(19) for x in grouped(2**i, small)]
