"""Returns, segments and backtests at closes of 0 and at halves of the last place, by name against their SQL."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from candlewick.plans import registry

#: Closes of 0, and ratios of two closes that are powers of two or lie at a half of the sixth place.
PRICES = (0.0, 0.01, 3.2, 5.12, 6.4, 32.0, 32.01, 39.93, 59.93, 64.0, 84.28)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Bars of one trade each, as sides take turns; the last events of a symbol are of one side."""
    folder, r = tmp_path_factory.mktemp("returns"), random.Random(7)
    rows = [(i, 1_700_000_000_000 + 1000 * i, "ab"[i // 2 % 2], i // 4 % 2 + 2 * r.randint(0, 8), r.choice(PRICES), f'{{"k": {r.randint(0, 99)}}}') for i in range(4000)]
    made = spark.createDataFrame(rows, "event_id bigint, ms bigint, event_type string, user_id bigint, value double, props string")
    made.withColumn("ts", F.timestamp_millis("ms").cast("timestamp_ntz")).drop("ms").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def both(spark, folder: str, name: str) -> tuple[list[tuple], list[tuple]]:
    """The rows of a query and of its SQL, sorted, with the SQL's order of columns."""
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    found = db.execute(__spark_entry__.oracle_sql()[name])
    names, want = [c[0] for c in found.description], found.fetchall()
    got = __spark_entry__.queries()[name](spark, folder).select(*names).collect()
    return sorted(map(tuple, got), key=repr), sorted(want, key=repr)


def test_forward_return_of_closes_of_zero(spark, events):
    got, want = both(spark, events, "forward_return")
    assert list(map(repr, got)) == list(map(repr, want))
    targets = [r[-1] for r in got]
    assert math.inf in targets and -math.inf in targets and any(map(math.isnan, targets)) and 0.0 in targets


def test_realized_return_at_halves_of_the_last_place(spark, events):
    got, want = both(spark, events, "realized_return")
    assert list(map(repr, got)) == list(map(repr, want)) and {-1.0, math.inf} <= {r[-1] for r in got}


def test_places_of_halves(spark):
    r = random.Random(8)
    values = [s * x for s in (1, -1) for x in (*((10 * r.randint(0, 10**9) + 5) / 10**7 for _ in range(3000)), 0.5e-6, 0.49999999999999994e-6, 0.0, 12345678901.2345675, 1e22, 1e305, math.inf)] + [math.nan, None]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", (registry.places(F.col("x")) + F.lit(0.0)).alias("y")).collect()
    want = duckdb.connect().execute("SELECT round(x, 6) + 0 FROM (SELECT unnest($1::DOUBLE[]) AS x)", [[x.x for x in got]]).fetchall()
    assert [repr(x.y) for x in got] == [repr(y) for y, in want]


@pytest.mark.parametrize("name", ["net_pnl", "research_segments", "backtest_grid", "backtest_grid_summary", "backtest_sequential"])
def test_segments_of_closes_of_zero(spark, events, name):
    got, want = both(spark, events, name)
    assert list(map(repr, got)) == list(map(repr, want)) and any(isinstance(x, float) and not math.isfinite(x) for r in got for x in r)


def test_merge_candles_of_a_symbol_without_stored_ones(spark, tmp_path):
    """Of symbol b all ids are above those of stored candles, and of c all that are below are multiples of 3."""
    ids = {"a": range(7000, 9000, 5), "b": range(8001, 9000, 5), "c": range(7002, 9000, 3)}
    rows = [(i, 1_700_000_000_000 + 600_000 * i, s, 1, 10.0 + i % 7, '{"k": 3}') for s in ids for i in ids[s]]
    made = spark.createDataFrame(rows, "event_id bigint, ms bigint, event_type string, user_id bigint, value double, props string")
    made.withColumn("ts", F.timestamp_millis("ms").cast("timestamp_ntz")).drop("ms").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got, want = both(spark, str(tmp_path), "merge_candles")
    assert got == want and {r[0] for r in got} == {"a"}
