"""Ordered operators against plain loops, at several chunk counts and with shuffled input; streams against batch."""

from __future__ import annotations

import math
import random
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from candlewick.operators import bars, book, layers, positions, research, runs, scan
from candlewick.plans import market
from candlewick.plans.registry import QUERIES
from candlewick.plans.research import _stream
from candlewick.sources import adapters
from candlewick.streaming import streams
from tests.test_market import CHANGES, TRADES, frame

CHUNKS = [1, 7, 64]
SMALL = "/root/testdata/sf0.001"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(-1, 1), st.floats(-5, 5)), max_size=300))
def test_composition(steps):
    a, b = (np.array([s[i] for s in steps], float) for i in (0, 1))
    f, y = scan.composed(a, b)
    factor, value = 1.0, 0.0
    for i, (p, q) in enumerate(steps):
        factor, value = factor * p, p * value + q
        assert f[i] == pytest.approx(factor, abs=1e-12) and y[i] == pytest.approx(value, rel=1e-9, abs=1e-9)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=2, max_size=80), st.data())
def test_first_cover(path, data):
    low, high = np.minimum(path[:-1], path[1:]).astype(float), np.maximum(path[:-1], path[1:]).astype(float)
    asked = data.draw(st.lists(st.tuples(st.integers(0, len(low)), st.integers(-1, 13)), max_size=30))
    since, price = (np.array([x[i] for x in asked], float) for i in (0, 1))
    want = [next((j for j in range(s, len(low)) if low[j] <= p <= high[j]), len(low)) for s, p in asked]
    assert layers.first_cover(low, high, since.astype(int), price).tolist() == want


def ticks(spark, n: int = 700, seed: int = 3):
    """Trades of two symbols, shuffled, with flat stretches."""
    r = random.Random(seed)
    rows = []
    for symbol in ("a", "b"):
        price, at = 100, 0
        for _ in range(n):
            price += r.choice([0, 0, 0, 1, -1, 2, -3])
            at += r.randint(1, 9)
            rows.append((symbol, at, r.random() < 0.5, price, r.randint(1, 5), 40 * at))
    r.shuffle(rows)
    return frame(spark, TRADES, rows).repartition(5), rows


@pytest.fixture(scope="module")
def some(spark):
    return ticks(spark)


@pytest.mark.parametrize("chunks", CHUNKS)
def test_step(spark, some, chunks):
    t, rows = some
    sell = F.when(~F.col("is_buy"), F.col("trade_id"))
    got = scan.step(t, ["symbol"], ["trade_id"], index="i", previous={"before": "price"}, sums={"total": F.col("quantity")}, known={"sold": sell}, chunks=chunks).collect()
    found = {(r.symbol, r.trade_id): (r.i, r.before, r.total, r.sold) for r in got}
    for symbol in ("a", "b"):
        before, total, sold = None, 0, None
        for i, (_, at, buy, price, quantity, _) in enumerate(sorted(r for r in rows if r[0] == symbol)):
            total, sold = total + quantity, sold if buy else at
            assert found.pop((symbol, at)) == (i, before, total, sold)
            before = price
    assert not found and len(got) == len(rows)


@pytest.mark.parametrize("chunks", CHUNKS)
def test_runs_and_lines(spark, some, chunks):
    t, rows = some
    got = sorted((r.symbol, r.start_trade_id, r.end_trade_id, float(r.total_quantity)) for r in runs.run_bars_side(t, emit_open=True, chunks=chunks).collect())
    lines = sorted((r.symbol, r.start_trade_id, r.end_trade_id, r.trading_direction, float(r.start_price), float(r.end_price), float(r.quantity)) for r in runs.zigzag_lines(t, chunks=chunks).collect())
    want, want_lines = [], []
    for symbol in ("a", "b"):
        own = sorted(r for r in rows if r[0] == symbol)
        for at, (_, i, buy, _, quantity, _) in enumerate(own):
            if at and own[at - 1][2] == buy:
                want[-1] = (symbol, want[-1][1], i, want[-1][3] + quantity)
            else:
                want.append((symbol, i, i, quantity))
        way, first = None, True
        for (_, i, _, p, q0, _), (_, j, _, q, quantity, _) in zip(own, own[1:], strict=False):
            turn = "Bull" if q > p else "Bear" if q < p else way or "Cross"
            if turn == way:
                want_lines[-1] = (*want_lines[-1][:2], j, turn, want_lines[-1][4], q, want_lines[-1][6] + quantity)
            else:
                want_lines.append((symbol, i, j, turn, p, q, quantity + (q0 if first else 0)))
            way, first = turn, False
    assert got == sorted(want) and lines == sorted(want_lines)
    closed = runs.run_bars_side(t, chunks=chunks)
    assert closed.count() == len(want) - 2
    assert sorted(map(str, runs.run_bars_direction(closed, chunks=chunks).collect())) == sorted(map(str, runs.run_bars_direction(closed, chunks=1).collect()))


@pytest.mark.parametrize("chunks", CHUNKS)
def test_extreme_lines(spark, some, chunks):
    lines = runs.zigzag_lines(some[0])
    last = lines.groupBy("symbol").agg(F.max("end_trade_id").alias("max_trade_id"))
    got = sorted((r.symbol, r.price, r.start_trade_id, r.end_trade_id) for r in layers.extreme_lines(lines, last, chunks=chunks).collect())
    want, rows = [], sorted((r.symbol, r.start_trade_id, r.end_trade_id, float(r.start_price), float(r.end_price)) for r in lines.collect())
    for n, (symbol, a, b, p, q) in enumerate(rows):
        own = [r for r in rows if r[0] == symbol]
        later = [r for r in rows[n + 1 :] if r[0] == symbol]
        for price, start in {p: a, q: b if p != q else a}.items():
            want.append((symbol, price, start, next((r[1] for r in later if min(r[3:]) <= price <= max(r[3:])), own[-1][2])))
    assert got == sorted(want)


@pytest.mark.parametrize("chunks", CHUNKS)
@pytest.mark.parametrize("steps", [1, 5, 40])
def test_sequential_backtest(spark, chunks, steps):
    r = random.Random(steps)
    rows = [(s, i, r.random() < 0.6, 1.0) for s in ("a", "b", "c") for i in range(3, 400) if not 100 < i < 200]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "symbol string, sample_index bigint, allowed boolean, net_pnl double").repartition(3)
    want = []
    for s in ("a", "b", "c"):
        free = 0
        for _, i, ok, _ in sorted(x for x in rows if x[0] == s):
            if ok and i >= free:
                want.append((s, i))
                free = i + steps
    got = research.backtest_sequential(df, steps, chunks).select("symbol", "sample_index").collect()
    assert sorted(map(tuple, got)) == want
    assert research.backtest_sequential(df.limit(0), steps, chunks).count() == 0


def random_book(seed: int = 4) -> list[tuple]:
    """Changes of two data sets: several a message, levels that are overwritten, deleted, and deleted though absent."""
    r, rows = random.Random(seed), []
    for data_set in (0, 1):
        for n in range(150):
            for side in ("ask", "bid"):
                rows += [("x", data_set, 1000 * data_set + 5 * n, 200 * data_set + n, side, p, r.choice([0, 0, 1, 2, 0.5])) for p in r.sample(range(90, 110), r.randint(0, 3))]
    return rows


@pytest.mark.parametrize("rows", [100_000, 40, 3])
def test_book_replay(spark, rows):
    changes = random_book()
    order = list(changes)
    random.Random(1).shuffle(order)
    frame_ = frame(spark, CHANGES, order).repartition(3)
    got = {(r.data_set_idx, r.event_id): r for r in book.state_stats(frame_, rows=rows).collect()}
    totals = {(r.data_set_idx, r.event_id): r for r in book.totals(frame_).collect()}
    levels, events = {}, sorted({(c[1], c[3]) for c in changes})
    assert sorted(got) == sorted(totals) == events
    for key in events:
        if key[0] and not any(k[0] for k in events if k < key):
            levels = {}
        for _, d, _, e, side, p, q in changes:
            if (d, e) == key:
                levels[side, p] = q
        for side in ("ask", "bid"):
            live = {p: q for (s, p), q in levels.items() if s == side and q}
            r = got[key]
            assert r[f"{side}_total_quantity"] == pytest.approx(sum(live.values())) and r[f"{side}_total_volume"] == pytest.approx(sum(p * q for p, q in live.items()))
            volumes = [p * q for p, q in live.items()]
            want = (max(live), min(live), max(live.values()), min(live.values()), max(volumes), min(volumes)) if live else (None,) * 6
            assert tuple(r[f"{side}_{m}_{x}"] for x in ("price", "quantity", "volume") for m in ("max", "min")) == want
            t = totals[key]
            assert float(t[f"{side}s_total_quantity"]) == pytest.approx(sum(live.values())) and float(t[f"{side}s_total_volume"]) == pytest.approx(sum(volumes))


@pytest.mark.parametrize(("rows", "chunks"), [(200_000, 1), (40, 7), (3, 64)])
def test_heatmap(spark, rows, chunks):
    changes = random_book(5)
    t = frame(spark, TRADES, [("x", i, i % 2 == 0, 92 + i % 17, 1, 12 * i) for i in range(150)])
    own = runs.run_bars_side(t, emit_open=True)
    extent = layers.trade_extent(t)
    e = extent.first()
    starts = sorted((r.start_timestamp_ms, r.start_trade_id) for r in own.collect())
    events, last, total = sorted({(c[1], c[2], c[3]) for c in changes}), {}, {}
    levels: dict = {}
    for n, (d, ms, event) in enumerate(events):
        if n and events[n - 1][0] != d:
            levels = {}
        levels |= {(side, p): q for _, dd, _, ee, side, p, q in changes if (dd, ee) == (d, event)}
        bar = max((i for m, i in starts if m <= ms), default=min(i for _, i in starts))
        x = math.floor((bar - e.min_trade_id) / e.scale)
        for (side, p), q in levels.items():
            y = min(math.floor((p - e.min_price) / e.scale), layers.HEIGHT - 1)
            if q and x >= 0 and y >= 0:
                total[x, y] = total.get((x, y), 0) + p * q
                last[x, y] = max(last.get((x, y), ()), ((d, n, p, side), p * q))
    c = frame(spark, CHANGES, changes)
    assert {(r.x, r.y): r.value for r in layers.book_volume_heatmap(c, own, extent, rows=rows, chunks=chunks).collect()} == {k: pytest.approx(v[1]) for k, v in last.items()}
    assert {(r.x, r.y): r.value for r in layers.book_volume_heatmap(c, own, extent, add=True, rows=rows, chunks=chunks).collect()} == {k: pytest.approx(v) for k, v in total.items()}


@pytest.mark.parametrize("chunks", CHUNKS)
def test_asof_and_snapshots(spark, chunks):
    r = random.Random(8)
    left, right = [("x", r.randint(0, 500), i) for i in range(80)], sorted({r.randint(50, 450) for _ in range(20)})
    found = book.asof(spark.createDataFrame(left, "symbol string, ms bigint, n bigint"), spark.createDataFrame([("x", m, 7 * m) for m in right], "symbol string, ms bigint, id bigint"), "ms", "ms", "id", "at", chunks)
    assert {x.n: x["at"] for x in found.collect()} == {n: 7 * max((m for m in right if m <= ms), default=right[0]) for _, ms, n in left}
    bars_ = spark.createDataFrame([("x", 7 * m) for m in right], "symbol string, start_trade_id bigint")
    assert sorted(x.bars for x in bars.count_bars_since(bars_, bars_).collect()) == list(range(1, len(right) + 1))


def test_closed_positions(spark):
    p = spark.createDataFrame([(1, "x", "long", 100.0, 7.0, "x8", 0, 2)], "position_id int, symbol string, side string, entry_price double, notional_usd double, horizon string, entry_index bigint, exit_index bigint")
    b = spark.createDataFrame([("x", i, c, i) for i, c in enumerate([100.0, 90.0, 104.0])], "symbol string, bar_index bigint, close_price double, start_timestamp_ms bigint")
    exits = spark.createDataFrame([(1, 110.0)], "position_id int, exit_price double")
    r = positions.close_positions(positions.position_excursions(p, b), exits).first()
    assert (r.mfe_gross_return_pct, r.mae_gross_return_pct, r.mfe_mark_price, r.net_return_pct) == pytest.approx((10, -10, 110, 9.9))


def test_streams_give_what_batches_give(spark):
    trades = market.trades_of(spark, SMALL)
    side = {(r.symbol, r.start_trade_id, r.end_trade_id) for r in runs.run_bars_side(trades).collect()}
    assert {(r.symbol, r.start_trade_id, r.end_trade_id) for r in QUERIES["stream_run_bars"](spark, SMALL).collect()} == side
    hours = {(r.symbol, r.start_timestamp_ms): r.trades_count for r in bars.time_candles(trades, "1H").collect()}
    streamed = {(r.symbol, r.start_timestamp_ms): r.trades_count for r in QUERIES["stream_time_candles"](spark, SMALL).collect()}
    assert streamed.items() <= hours.items() and len(hours) - len(streamed) <= 5
    assert QUERIES["stream_upsert"](spark, SMALL).count() == trades.count()
    assert streams.stream_run_bars(_stream(spark, SMALL)).isStreaming


def test_bars_of_many_batches(spark, some, tmp_path):
    """Four files in order of id, one a batch; the last one has rows of the third again."""
    t, _ = some
    for i, (low, high) in enumerate(((0, 500), (500, 505), (505, 2000), (1500, 9000))):
        t.where(f"trade_id >= {low} and trade_id < {high}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    streams.run_bars_of_batches(stream, f"{tmp_path}/out", f"{tmp_path}/stream").awaitTermination()
    got, want = spark.read.parquet(f"{tmp_path}/out/rows").drop("batch"), runs.run_bars_side(t)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert len(list((tmp_path / "out/rows").glob("batch=*"))) == 4


def test_bars_are_resumed(spark):
    for name, whole in (("incremental_bars", "run_bars_side"), ("incremental_bars_direction", "run_bars_direction")):
        assert sorted(map(str, QUERIES[name](spark, SMALL).collect())) == sorted(map(str, QUERIES[whole](spark, SMALL).select(*QUERIES[name](spark, SMALL).columns).collect()))


def test_decimal_prices_of_the_book_are_exact(spark):
    found = book.level_deltas(adapters.messages_from_book(adapters.book_from_events(spark, SMALL)))
    assert all(isinstance(r.price, Decimal) for r in found.limit(3).collect())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 40), st.integers(-9, 9)), max_size=40), st.integers(1, 41))
def test_covering(lives, n):
    lives = [(a, min(n, a + k), v) for a, k, v in lives if a < n]
    start, end, value = (np.array([x[i] for x in lives], np.int64) for i in range(3))
    got = book.covering(start, end, value, n, -99).tolist()
    assert got == [max((v for a, b, v in lives if a <= i < b), default=-99) for i in range(n)]


def test_book_statistics_are_exact():
    """Volumes whose products pass 64 bits are summed without loss."""
    r = random.Random(1)
    n = 200
    start = np.array([r.randint(0, n - 2) for _ in range(300)])
    end = np.array([r.randint(a + 1, n) for a in start.tolist()])
    price, quantity = (np.array([r.randint(1, 10**13) for _ in range(300)]) for _ in range(2))
    found = [x.to_pylist() for x in book._side_stats(start, end, price, quantity, n)]
    for i in range(n):
        live = [(p, q) for a, b, p, q in zip(start.tolist(), end.tolist(), price.tolist(), quantity.tolist(), strict=True) if a <= i < b]
        u = 10**8
        want = [sum(q for _, q in live) / u, sum(p * q for p, q in live) / u**2]
        want += [f(x) / s for x, s in (([p for p, _ in live], u), ([q for _, q in live], u), ([p * q for p, q in live], u * u)) for f in (max, min)] if live else [None] * 6
        assert [x[i] for x in found] == pytest.approx(want, rel=1e-15)
