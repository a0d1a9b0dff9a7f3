"""Zigzag levels, rasters, streams of any cut, upserts and database reads against plain loops."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from candlewick.operators import book, layers, runs, scan, zigzag
from candlewick.sources import database, tables
from candlewick.streaming import streams
from candlewick.streaming.upserts import UpsertTable
from tests.test_brute_force import ticks

BLOCKS = [2, 9, 1_000_000]


def folded(lines: list[dict]) -> list[dict]:
    """A level by a plain fold: the open line takes in a pair that goes on, else it ends and the pair's first line is open."""
    out, now, at = [], None, 0
    while at < len(lines):
        if now is None:
            now, low, high, at = dict(lines[at]), lines[at]["start_price"], lines[at]["end_price"], at + 1
            continue
        pair = lines[at : at + 2]
        sign = {"Bull": 1, "Bear": -1, "Cross": 0}[now["trading_direction"]]
        goes_on = len(pair) == 2 and sign and pair[1]["trading_direction"] == now["trading_direction"] and sign * (pair[0]["end_price"] - low) >= 0 and sign * (pair[1]["end_price"] - high) >= 0
        if not goes_on:
            out.append(now)
            now = None
            continue
        low, high, at = pair[0]["end_price"], pair[1]["end_price"], at + 2
        for x in pair:
            now |= {k: x[k] for k in ("end_price", "end_trade_id", "end_timestamp_ms")} | {k: now[k] + x[k] for k in ("quantity", "volume")}
    return out + ([now] if now else [])


@pytest.mark.parametrize("rows", BLOCKS)
def test_zigzag_levels(spark, rows):
    trades, _ = ticks(spark, 400)
    lines = scan.saved(runs.zigzag_lines(trades))
    found = zigzag.zigzag_levels(lines, 6, rows).collect()
    want = []
    for symbol in ("a", "b"):
        own = sorted((r.asDict() for r in lines.where(F.col("symbol") == symbol).collect()), key=lambda r: r["start_trade_id"])
        for level in range(2, 7):
            own = folded(own)
            want += [{**r, "level": level} for r in own]
            directions = [r["trading_direction"] for r in own]
            assert all(x != y for x, y in zip(directions, directions[1:], strict=False))
    assert Counter(tuple(sorted(r.asDict().items())) for r in found) == Counter(tuple(sorted(r.items())) for r in want)
    assert len({r["level"] for r in want}) == 5 and sum(r["level"] == 6 for r in want) < sum(r["level"] == 2 for r in want)


def test_zigzag_levels_of_few_lines(spark):
    schema = "symbol string, trading_direction string, start_price double, end_price double, start_trade_id bigint, end_trade_id bigint, start_timestamp_ms bigint, end_timestamp_ms bigint, quantity double, volume double"
    path = {"x": [1, 1, 5, 3, 6, 4, 9], "y": [1, 2], "z": [9, 5, 7, 5, 7, 4]}
    rows = []
    for s, p in path.items():
        for i in range(len(p) - 1):
            d = "Bull" if p[i + 1] > p[i] else "Bear" if p[i + 1] < p[i] else "Cross"
            rows.append((s, d, float(p[i]), float(p[i + 1]), i, i + 1, i, i + 1, 1.0, 2.0))
    found = zigzag.zigzag_levels(spark.createDataFrame(rows, schema), 3).where("level = 3").orderBy("symbol", "start_trade_id").collect()
    assert [(r.symbol, r.trading_direction, r.start_price, r.end_price, r.quantity, r.volume) for r in found] == [("x", "Cross", 1, 1, 1, 2), ("x", "Bull", 1, 9, 5, 10), ("y", "Bull", 1, 2, 1, 2), ("z", "Bear", 9, 4, 5, 10)]
    assert zigzag.zigzag_levels(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        zigzag.fold(spark.createDataFrame([], schema), 1)


@pytest.mark.parametrize("chunks", [1, 7, 64])
def test_raster_by_sweep(spark, chunks):
    """Against every cell of every level; pieces are no more than levels and don't overlap."""
    r = random.Random(chunks)
    extent = spark.createDataFrame([("x", 0.0, 100.0, 0, 300, 1.0), ("y", 0.0, 100.0, 0, 300, 1.0)], "symbol string, min_price double, max_price double, min_trade_id bigint, max_trade_id bigint, scale double")
    rows = []
    for s in "xy":
        for _ in range(150):
            a = r.randint(0, 250)
            rows.append((s, r.choice([5.0, 5.5, 9.0, 99.5, 100.0]), a, min(300, a + r.choice([0, 1, 4, 30, 250]))))
    best = {}
    for s, price, a, b in rows:
        for x in range(a, b):
            key = s, x, min(int(price), 99)
            best[key] = max(best.get(key, ()), (b, a, price))
    levels = spark.createDataFrame(rows, "symbol string, price double, start_trade_id bigint, end_trade_id bigint")
    got = layers.extreme_line_raster(levels, extent, range_cells=16, chunks=chunks).collect()
    assert sorted((c.symbol, c.x, c.y, c.value) for c in got) == sorted((*k, k[1] - a) for k, (_, a, _) in best.items())
    pieces = layers.winning_pieces(levels, extent, chunks).collect()
    assert len(pieces) <= len(rows) and sum(p.x_to - p.x_from for p in pieces) == len(best)


MESSAGES = "symbol string, timestamp_ms bigint, event_id bigint, action string, seq_id bigint, prev_seq_id bigint"


def messages(n: int = 300, seed: int = 2) -> list[tuple]:
    r, out, last = random.Random(seed), [], {"a": -1, "b": -1}
    for i in range(1, n + 1):
        s = r.choice("ab")
        snapshot = i % 40 == 0
        prev = (-1 if r.random() < 0.8 else 7) if snapshot else (last[s] if r.random() < 0.9 else 3)
        out.append((s, 10**9 + 1000 * (i // 2), i, "Snapshot" if snapshot else "Update", i, prev))
        last[s] = i
    return out


def stream_of(spark, rows, parts, path):
    """A stream of some files, one a batch, in the order in which they were written."""
    import os

    for i, part in enumerate(parts):
        spark.createDataFrame([rows[k] for k in part], MESSAGES).coalesce(1).write.parquet(f"{path}/{i:03}")
        for f in os.listdir(f"{path}/{i:03}"):
            os.utime(f"{path}/{i:03}/{f}", (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


@pytest.mark.parametrize("form", ["state", "batches"])
def test_guard_of_batches_of_any_cut_and_order(spark, tmp_path, form):
    """Batches whose messages are mixed with those of neighbouring ones, within the lateness, give what one batch gives."""
    rows, r = messages(), random.Random(4)
    order = sorted(range(len(rows)), key=lambda i: rows[i][1] + r.randint(0, 25_000))  # up to 25 s late
    cuts = sorted(r.sample(range(1, len(rows)), 6))
    parts = [order[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    stream = stream_of(spark, rows, parts, f"{tmp_path}/in")
    if form == "state":
        streams.stream_book_guard(stream, "30 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out/rows").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    else:
        streams.guard_of_batches(stream, f"{tmp_path}/out", f"{tmp_path}/state", 30_000).awaitTermination()
        assert len(list((tmp_path / "out/rows").glob("batch=*"))) == 7 and spark.read.parquet(f"{tmp_path}/out/late").count() == 0
    names = ["symbol", "timestamp_ms", "event_id", "expected_seq_id", "prev_seq_id"]
    passed = max(x[1] for x in rows) - 30_000
    want = book.sequence_check(spark.createDataFrame(rows, MESSAGES)).where(F.col("timestamp_ms") < passed).select(*names)
    got = spark.read.parquet(f"{tmp_path}/out/rows").select(*names)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 10


def test_guard_judges_what_waits_at_the_end(spark, tmp_path):
    """What the stream has written and what waits in its state are all breaks, also of a symbol of which no message was judged; nothing comes twice."""
    rows, r, far = messages(), random.Random(5), 2**60
    rows = [(s, t, i + far, a, q + far, p if p in (-1, 3, 7) else p + far) for s, t, i, a, q, p in rows]
    end, n = rows[-1][1], far + 1000
    rows += [("c", end, n, "Update", n, n - 1), ("c", end, n + 1, "Update", n + 1, n), ("c", end, n + 2, "Update", n + 2, n)]
    order = sorted(range(len(rows)), key=lambda i: rows[i][1] + r.randint(0, 25_000))
    stream = stream_of(spark, rows, [order[:100], order[100:230], order[230:]], f"{tmp_path}/in")
    streams.stream_book_guard(stream, "30 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    names = ["symbol", "timestamp_ms", "event_id", "expected_seq_id", "prev_seq_id"]
    written, rest = spark.read.parquet(f"{tmp_path}/out").select(*names), streams.rest_of_book_guard(spark, f"{tmp_path}/state")
    want = book.sequence_check(spark.createDataFrame(rows, MESSAGES)).select(*names)
    assert sorted(map(str, written.union(rest).collect())) == sorted(map(str, want.collect())) and min(written.count(), rest.count()) > 5
    assert sorted((x.event_id, x.expected_seq_id) for x in rest.where("symbol = 'c'").collect()) == [(n, None), (n + 2, n + 1)]


def test_guard_query_takes_all_messages(spark, tmp_path):
    """Events of five minutes, all later than the last one less the lateness, against the SQL and a plain loop."""
    import duckdb

    import __spark_entry__

    r = random.Random(6)
    events = [(i, 1_700_000_000_000 + 1000 * (i % 300), r.choice("ab"), r.randint(1, 9), 10.0, '{"k": 3}') for i in range(1, 601)]
    made = spark.createDataFrame(events, "event_id bigint, ms bigint, event_type string, user_id bigint, value double, props string").withColumn("ts", F.timestamp_millis("ms").cast("timestamp_ntz")).drop("ms")
    made.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    last, want = {}, set()
    for i, ms, s, *_ in sorted(events, key=lambda e: (e[1], e[0])):
        snapshot, expected = i % 50 == 0, last.get(s)
        prev = (5 if i % 3 == 0 else -1) if snapshot else i - 5
        if prev != -1 if snapshot else prev != expected:
            want.add((s, ms, i, expected, prev))
        last[s] = i
    names = ["symbol", "timestamp_ms", "event_id", "expected_seq_id", "prev_seq_id"]
    got = __spark_entry__.queries()["stream_book_guard"](spark, str(tmp_path)).select(*names).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert len(got) == len(want) > 100 and set(map(tuple, got)) == want == set(db.execute(__spark_entry__.oracle_sql()["stream_book_guard"]).fetchall())


def test_late_messages_and_batches_that_run_again(spark, tmp_path):
    rows = [("a", 1000 * i, i, "Update", i, i - 1) for i in range(1, 41)]
    late = ("a", 2_500, 99, "Update", 99, 98)
    stream = stream_of(spark, [*rows, late], [range(30), [40], range(30, 40)], f"{tmp_path}/in")
    for _ in range(2):
        streams.guard_of_batches(stream, f"{tmp_path}/out", f"{tmp_path}/state{_}", 5_000).awaitTermination()  # the second one does all batches again
        assert [r.event_id for r in spark.read.parquet(f"{tmp_path}/out/late").collect()] == [99]
        assert [r.event_id for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()] == [1]


def test_upserts_of_batches(spark, tmp_path):
    """A batch takes effect once, wholly or not at all, and reads the ranges that it touches alone."""
    made = lambda ids, v: spark.createDataFrame([("s", i, v, 0) for i in ids], "symbol string, id bigint, v int, at int")
    table = UpsertTable(f"{tmp_path}/t", ["symbol", "id"], "id", width=100, order=["at"])
    table.put(made(range(1000), 0), 0)
    table.put(made([5, 7, 1005], 1).unionByName(made([5], 2).withColumn("at", F.lit(9))), 1)
    rows = lambda: {r.id: r.v for r in table.read(spark, made([], 0)).collect()}
    want = {i: 0 for i in range(1000)} | {5: 2, 7: 1, 1005: 1}
    assert rows() == want
    table.put(made(range(1000), 8), 1)  # complete: passed over
    assert rows() == want
    broken = made(range(250), 3)
    manifest = UpsertTable.manifest
    with pytest.MonkeyPatch.context() as m:  # ends before its manifest is there
        m.setattr(UpsertTable, "_versions", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.put(broken, 2)
    broken.withColumn("_range", F.lit(1)).write.partitionBy("_range").parquet(f"{tmp_path}/t/rows/_version=2")
    assert rows() == want
    for _ in range(2):
        table.put(broken, 2)
        assert rows() == want | {i: 3 for i in range(250)}
    assert manifest(table, spark, 2).count() == 11
    kept = UpsertTable(f"{tmp_path}/t", ["symbol", "id"], "id", width=100, newest=False)
    kept.put(made([1, 1005, 1006, 5000], 4), 3)
    want = want | {i: 3 for i in range(250)} | {1006: 4, 5000: 4}
    assert rows() == want
    assert table.vacuum(spark) == 4 and rows() == want  # version 1 and three manifests
    read = table._versions(made([], 0), scan.saved(spark.createDataFrame([(7, 0)], "_range bigint, _version bigint")))
    assert read.count() == 100
    plan = read._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan
    metrics = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in metrics


@pytest.fixture(scope="module")
def stored(spark):
    """Trades of two symbols in a database; ids of one lie in three clusters."""
    r = random.Random(6)
    ids = {"a": sorted([*range(0, 300), *range(10**6, 10**6 + 300), *range(10**12, 10**12 + 50)]), "o'b": list(range(0, 2000, 7))}
    rows = [(s, i, r.random() < 0.5, float(r.randint(1, 900)) / 8, float(r.randint(1, 9)), 10 * i) for s in ids for i in ids[s]]
    trades = spark.createDataFrame(rows, "symbol string, trade_id bigint, is_buy boolean, price double, quantity double, timestamp_ms bigint")
    trades = trades.withColumns({c: F.col(c).cast(tables.MONEY) for c in ("price", "quantity")})
    url = "jdbc:derby:memory:trades_of_tests;create=true"
    trades.write.option("createTableColumnTypes", "symbol VARCHAR(64)").jdbc(url, "trades", mode="overwrite")
    return url, trades


@pytest.mark.parametrize(("symbol", "least", "limit"), [("a", 0, None), ("a", 100, 400), ("o'b", 700, 100), ("a", 0, 10**9), ("c", 0, 5), ("a", 0, 0)])
def test_trades_of_a_database(spark, stored, symbol, least, limit):
    url, trades = stored
    got = database.read_trades(spark, url, "trades", symbol, least, limit, rows=40)
    want = tables.read_trades(trades, symbol, least, trades.count() if limit is None else min(limit, 10**6))
    assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_ranges_of_a_database(spark, stored):
    """Clusters of ids are cut where they are; what is asked reaches the database."""
    url, trades = stored
    found = database.read_trades(spark, url, "trades", "a", rows=40)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 40 and len(sizes) <= 2 * 650 // 40 + 3 and found.rdd.getNumPartitions() <= 2 * 650 // 40 + 3
    plan = found.where("timestamp_ms > 30").select("price")._jdf.queryExecution().executedPlan().toString()
    assert "*GreaterThan(timestamp_ms,30)" in plan and "ReadSchema: struct<price" in plan
