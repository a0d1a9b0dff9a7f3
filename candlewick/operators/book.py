"""Order books: data sets, level changes and lifetimes, totals, state at each event, interval records.

A book event is a row (symbol, timestamp_ms, event_id) with level changes; event_id breaks ties of time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.operators import scan
from candlewick.sources.adapters import MONEY

SYMBOL, ORDER = ["symbol"], ["timestamp_ms", "event_id"]
STATS = ("total_quantity", "total_volume", "max_price", "min_price", "max_quantity", "min_quantity", "max_volume", "min_volume")


def data_sets(events: DataFrame, keep_open: bool = False, chunks: int | None = None) -> DataFrame:
    """Adds data_set_idx, from 0: a snapshot and the updates before the next one. The last, open one of a symbol is left out.

    Only narrow rows (symbol, time, id, action) are ordered; events before the first snapshot belong nowhere.
    """
    narrow = events.groupBy(*SYMBOL, *ORDER).agg(F.max(F.col("action") == "Snapshot").alias("_snap"))
    counted = scan.step(narrow, SYMBOL, ORDER, sums={"_n": F.col("_snap").cast("bigint")}, chunks=chunks)
    last = counted.groupBy("symbol").agg(F.max("_n").alias("_last"))
    own = counted.join(last, "symbol").where("_n > 0" if keep_open else "_n > 0 and _n < _last")
    return events.join(own.select(*SYMBOL, *ORDER, (F.col("_n") - 1).alias("data_set_idx")), [*SYMBOL, *ORDER])


def level_deltas(messages: DataFrame) -> DataFrame:
    """Level changes of messages with JSON asks and bids: side, position, price, quantity; levels that don't parse are dropped, quantity 0 deletes."""
    rows = None
    keep = [c for c in messages.columns if c not in ("asks", "bids")]
    for side in ("ask", "bid"):
        one = messages.select(*keep, F.lit(side).alias("side"), F.posexplode(F.from_json(f"{side}s", "array<array<string>>")).alias("position", "_l"))
        rows = one if rows is None else rows.unionByName(one)
    price, quantity = F.get("_l", 0).try_cast(MONEY), F.get("_l", 1).try_cast(MONEY)
    return rows.select(*keep, "side", "position", price.alias("price"), quantity.alias("quantity")).where("price is not null and quantity is not null")


def level_lifetimes(changes: DataFrame) -> DataFrame:
    """Each quantity of a (data set, side, price) from its event until the next change of that price: from_ms, from_id, to_ms, to_id (null: to the end)."""
    w = Window.partitionBy("symbol", "data_set_idx", "side", "price").orderBy(*ORDER)
    return changes.select(
        "symbol", "data_set_idx", "side", "price", "quantity", F.col("timestamp_ms").alias("from_ms"), F.col("event_id").alias("from_id"), F.lead("timestamp_ms").over(w).alias("to_ms"), F.lead("event_id").over(w).alias("to_id"),
    )


def totals(changes: DataFrame, chunks: int | None = None) -> DataFrame:
    """At each event of a data set the sums of quantity and volume of both sides: changes against the price's last state, summed up.

    They are summed over a whole symbol, in chunks, less the sum before the data set.
    """
    price = Window.partitionBy("symbol", "data_set_idx", "side", "price").orderBy(*ORDER)
    change = F.col("quantity") - F.coalesce(F.lag("quantity").over(price), F.lit(0))
    moved = changes.withColumn("_q", change).withColumn("_v", change * F.col("price"))
    each = moved.groupBy("symbol", "data_set_idx", *ORDER).agg(*(F.sum(F.when(F.col("side") == s, F.col(x)).otherwise(0)).alias(f"_{s}{x}") for s in ("ask", "bid") for x in ("_q", "_v")))
    names = {f"_{s}{x}": f"{s}s_total_{n}" for s in ("ask", "bid") for x, n in (("_q", "quantity"), ("_v", "volume"))}
    sums = scan.step(each, SYMBOL, ORDER, sums={f"_to{c}": F.col(c) for c in names}, chunks=chunks)
    before = sums.groupBy("symbol", "data_set_idx").agg(F.min_by(F.struct(*((F.col(f"_to{c}") - F.col(c)).alias(c) for c in names)), F.struct(*ORDER)).alias("_before"))
    return sums.join(before, ["symbol", "data_set_idx"]).select("symbol", "data_set_idx", *ORDER, *((F.col(f"_to{c}") - F.col(f"_before.{c}")).alias(n) for c, n in names.items()))


def snapshot_side_stats(messages: DataFrame) -> DataFrame:
    """Statistics of each message's own levels, per side."""
    return level_deltas(messages).where("quantity <> 0").groupBy("symbol", *ORDER, "side").agg(*_stats())


def _stats() -> list:
    volume = F.col("price") * F.col("quantity")
    return [
        F.sum("quantity").alias("total_quantity"), F.sum(volume).alias("total_volume"), F.max("price").alias("max_price"), F.min("price").alias("min_price"),
        F.max("quantity").alias("max_quantity"), F.min("quantity").alias("min_quantity"), F.max(volume).alias("max_volume"), F.min(volume).alias("min_volume"),
    ]


def covering(start: np.ndarray, end: np.ndarray, value: np.ndarray, n: int, least: float | int) -> np.ndarray:
    """For each of n places the largest value of the intervals [start, end) over it, ``least`` where there is none.

    An interval is the union of two of the largest power of two that fits; from large powers to small ones, each halves
    what it has into the next. So n * log n steps, all places side by side.
    """
    power = np.frexp((end - start).astype(np.float64))[1] - 1
    held = np.full(n, least, value.dtype)
    for k in range(int(power.max()) if len(power) else 0, -1, -1):
        mine = power == k
        np.maximum.at(held, start[mine], value[mine])
        np.maximum.at(held, end[mine] - (1 << k), value[mine])
        if k:
            half = 1 << (k - 1)
            held[half:] = np.maximum(held[half:], held[:-half].copy())
    return held


def running(start: np.ndarray, end: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the sum over the intervals over it, of integers."""
    total = np.zeros(n + 1, np.int64)
    np.add.at(total, start, value)
    np.add.at(total, end, -value)
    return np.cumsum(total[:-1])


UNIT = 10**8


def _side_stats(start: np.ndarray, end: np.ndarray, price: np.ndarray, quantity: np.ndarray, n: int) -> list[pa.Array]:
    """STATS at n events from the lives of levels: quantity and price in units, exact; volumes as sums of three integers, in parts of 1, 1e-8, 1e-16."""
    empty = running(start, end, np.ones(len(start), np.int64), n) == 0
    (p, p_rest), (q, q_rest) = (np.divmod(x, UNIT) for x in (price, quantity))
    low = p_rest * q_rest
    middle = p * q_rest + p_rest * q + low // UNIT
    parts = p * q + middle // UNIT, middle % UNIT, low % UNIT
    whole = lambda a, b, c: a + (b + c / UNIT) / UNIT
    volume = whole(*parts)
    found = [running(start, end, quantity, n) / UNIT, whole(*(running(start, end, x, n) for x in parts))]
    for x, scale in ((price, UNIT), (quantity, UNIT), (volume, 1)):
        least = -np.inf if x.dtype == np.float64 else np.iinfo(np.int64).min + 1
        found += [covering(start, end, x, n, least) / scale, -covering(start, end, -x, n, least) / scale]
    return [pa.array(x, pa.float64(), mask=None if i < 2 else empty) for i, x in enumerate(found)]


def segments(changes: DataFrame, rows: int, chunks: int | None) -> DataFrame:
    """The changes with _segment: successive events of a data set, so many changes or fewer a segment, and one event whole; and
    before each segment but the first of a data set the levels that live at its beginning, as changes without an event.
    """
    numbered = scan.step(changes.groupBy(*SYMBOL, "data_set_idx", *ORDER).agg(F.count("*").alias("_changes")), SYMBOL, ORDER, sums={"_upto": F.col("_changes")}, chunks=chunks)
    keys = ["symbol", "data_set_idx", *ORDER]
    own = scan.saved(changes.join(numbered.select(*keys, F.floor((F.col("_upto") - F.col("_changes")) / rows).cast("bigint").alias("_segment")), keys))
    level = ["symbol", "data_set_idx", "side", "price"]
    last = own.groupBy(*level, "_segment").agg(F.max_by("quantity", F.struct(*ORDER, "position")).alias("quantity"))
    ends = own.groupBy("symbol", "data_set_idx").agg(F.max("_segment").alias("_most"))
    until = F.coalesce(F.lead("_segment").over(Window.partitionBy(*level).orderBy("_segment")), F.col("_most"))
    lives = last.join(ends, ["symbol", "data_set_idx"]).withColumn("_until", until).where("quantity <> 0 and _until > _segment")
    seeds = lives.select(*level, "quantity", F.explode(F.sequence(F.col("_segment") + 1, "_until")).alias("_segment"))
    return own.unionByName(seeds, allowMissingColumns=True)


def _asks(rows: pa.Table) -> np.ndarray:
    return np.asarray(pc.equal(rows.column("side"), "ask").combine_chunks())


def lives(rows: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray]:
    """Of a segment a row for each event in order, all changes by side, price and event, and from which to which event each change holds.

    A level that lives at the beginning does so from the first event on. A change that the same event overwrites holds nowhere.
    """
    rows = rows.combine_chunks()
    rows = rows.take(pc.sort_indices(rows, [("timestamp_ms", "ascending"), ("event_id", "ascending"), ("position", "ascending")], null_placement="at_start"))
    seeds = rows.column("event_id").null_count
    events = rows.slice(seeds)
    ts, event = (events.column(c).to_numpy() for c in ORDER)
    new = np.ones(len(ts), bool)
    new[1:] = (ts[1:] != ts[:-1]) | (event[1:] != event[:-1])
    at = np.append(np.zeros(seeds, np.int64), np.cumsum(new) - 1)
    price, ask = rows.column("price").to_numpy(), _asks(rows)
    order = np.lexsort((np.arange(len(at)), price, ask))
    start, price, ask = at[order], price[order], ask[order]
    end = np.append(start[1:], new.sum())
    end[:-1][(price[1:] != price[:-1]) | (ask[1:] != ask[:-1])] = new.sum()
    return events.filter(pa.array(new)), rows.take(pa.array(order)), start, end


def state_stats(changes: DataFrame, rows: int = 200_000, chunks: int | None = None) -> DataFrame:
    """At each event the statistics of the live levels of both sides (ask_total_quantity, ... bid_min_volume).

    Data sets are cut into segments of about so many rows, each solved in its own group from the levels that live at its
    beginning: the lives of all levels are laid over the events at once. Sums are exact, in units of 1e-8.
    """
    names = [f"{s}_{x}" for s in ("ask", "bid") for x in STATS]

    def run(rows: pa.Table) -> pa.Table:
        events, levels, start, end = lives(rows)
        n, ask = len(events), _asks(levels)
        price, quantity = (levels.column(c).to_numpy() for c in ("price", "quantity"))
        made = []
        for own in (ask, ~ask):
            live = own & (quantity != 0) & (end > start)
            made += _side_stats(start[live], end[live], price[live], quantity[live], n)
        key = [rows.column(c)[0].as_py() for c in ("symbol", "data_set_idx")]
        return pa.table([pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), *(events.column(c) for c in ORDER), *made], ["symbol", "data_set_idx", *ORDER, *names])

    own = changes if "position" in changes.columns else changes.withColumn("position", F.lit(0))
    units = lambda c: (F.col(c) * UNIT).cast("bigint").alias(c)
    own = segments(own.select("symbol", "data_set_idx", *ORDER, "side", "position", units("price"), units("quantity")), rows, chunks)
    schema = "symbol string, data_set_idx bigint, timestamp_ms bigint, event_id bigint, " + ", ".join(f"{n} double" for n in names)
    return own.groupBy("symbol", "data_set_idx", "_segment").applyInArrow(run, schema)


def intervals(events: DataFrame, chunks: int | None = None) -> DataFrame:
    """Pairs of successive events of a data set: start and end times and the end's id."""
    narrow = events.select("symbol", "data_set_idx", *ORDER).distinct()
    pairs = scan.step(narrow, SYMBOL, ORDER, previous={"start_timestamp_ms": "timestamp_ms", "start_event_id": "event_id", "_set": "data_set_idx"}, chunks=chunks)
    return pairs.where("_set = data_set_idx").select("symbol", "data_set_idx", "start_timestamp_ms", "start_event_id", F.col("timestamp_ms").alias("end_timestamp_ms"), F.col("event_id").alias("end_event_id"))


def trades_in_intervals(trades: DataFrame, events: DataFrame, chunks: int | None = None) -> DataFrame:
    """Trades with the interval [event, next event of the data set) they fall in, by a union in time order instead of a range join.

    Of events with one time only the last begins an interval of some length. Other trades belong nowhere.
    """
    starts = intervals(events, chunks).where("end_timestamp_ms > start_timestamp_ms").select("symbol", F.col("start_timestamp_ms").alias("timestamp_ms"), F.lit(0).alias("_kind"), F.struct("data_set_idx", "start_timestamp_ms", "start_event_id", "end_timestamp_ms", "end_event_id").alias("_i"))
    mine = trades.select("symbol", "timestamp_ms", F.lit(1).alias("_kind"), F.lit(None).cast(starts.schema["_i"].dataType).alias("_i"), *(c for c in trades.columns if c not in ("symbol", "timestamp_ms")))
    both = starts.unionByName(mine, allowMissingColumns=True)
    known = scan.step(both, SYMBOL, ["timestamp_ms", "_kind"], known={"_in": F.col("_i")}, chunks=chunks)
    return known.where((F.col("_kind") == 1) & (F.col("timestamp_ms") < F.col("_in.end_timestamp_ms"))).select(*trades.columns, "_in.*")


def interval_trade_stats(trades: DataFrame, events: DataFrame, chunks: int | None = None) -> DataFrame:
    """Trade aggregates of each interval with trades; first and last by trade id."""
    from candlewick.operators.runs import trade_aggregates

    keys = ["symbol", "data_set_idx", "start_timestamp_ms", "start_event_id", "end_timestamp_ms", "end_event_id"]
    placed = trades_in_intervals(trades, events, chunks)
    aggregates = [c for c, n in zip(trade_aggregates(), range(99), strict=False) if n not in (2, 3)]  # times are the interval's
    return placed.groupBy(*keys).agg(*aggregates)


def interval_records(trades: DataFrame, changes: DataFrame, carry_empty_intervals: bool = False, chunks: int | None = None) -> DataFrame:
    """Interval records: the book before and after the event that ends each interval, and the interval's trades; intervals without trades give none.

    changes: level changes with data_set_idx, best a stored table, since they are read several times. record_idx counts the records of a data set. With carry_empty_intervals a
    record starts where the one before it in the data set ended, over all intervals without trades between them.
    """
    stats = scan.saved(state_stats(changes, chunks=chunks))
    as_of = lambda e: stats.select("symbol", "data_set_idx", F.col("event_id").alias(f"{e}_event_id"), *(F.col(f"{s}_{x}").alias(_record_name(e, s, x)) for s in ("ask", "bid") for x in STATS))
    mine = _numbered(scan.saved(interval_trade_stats(trades, changes, chunks)), F.lit(1), chunks).join(as_of("end"), ["symbol", "data_set_idx", "end_event_id"])
    if carry_empty_intervals:
        starts = _carried_starts(mine, intervals(changes, chunks), as_of("start"), chunks)
        return mine.drop("start_timestamp_ms", "start_event_id", "end_event_id").join(starts, ["symbol", "data_set_idx", "record_idx"])
    return mine.join(as_of("start"), ["symbol", "data_set_idx", "start_event_id"]).drop("start_event_id", "end_event_id")


def _numbered(spans: DataFrame, counted: Column, chunks: int | None) -> DataFrame:
    """Adds record_idx: how many counted spans of the data set end before this one; summed over a whole symbol, in chunks, less the sum before the data set."""
    own = scan.step(spans.withColumn("_one", counted.cast("bigint")), SYMBOL, ["end_timestamp_ms", "end_event_id"], sums={"_upto": F.col("_one")}, chunks=chunks)
    before = F.col("_upto") - F.col("_one")
    base = own.groupBy("symbol", "data_set_idx").agg(F.min(before).alias("_base"))
    return own.join(base, ["symbol", "data_set_idx"]).withColumn("record_idx", before - F.col("_base")).drop("_one", "_upto", "_base")


def _carried_starts(records: DataFrame, spans: DataFrame, stats: DataFrame, chunks: int | None) -> DataFrame:
    """For each record the start of the first interval after the record before, and of each side the first start statistics from there on with levels."""
    keys = ["symbol", "data_set_idx"]
    made = records.select(*keys, "end_event_id", F.lit(True).alias("_made"))
    marked = spans.join(made, [*keys, "end_event_id"], "left")
    numbered = _numbered(marked, F.col("_made").isNotNull(), chunks).join(stats, [*keys, "start_event_id"])
    names = {s: [_record_name("start", s, x) for x in STATS] for s in ("ask", "bid")}
    with_levels = {s: F.when(F.col(_record_name("start", s, "total_volume")) > 0, F.struct("end_timestamp_ms", "end_event_id")) for s in names}
    first = numbered.groupBy(*keys, "record_idx").agg(F.min("start_timestamp_ms").alias("start_timestamp_ms"), *(F.min_by(F.struct(*names[s]), with_levels[s]).alias(f"_{s}") for s in names))
    value = lambda s, n: F.coalesce(f"_{s}.{n}", F.lit(0.0)) if "_total_" in n else F.col(f"_{s}.{n}")
    return first.select(*keys, "record_idx", "start_timestamp_ms", *(value(s, n).alias(n) for s in names for n in names[s]))


def _record_name(end: str, side: str, stat: str) -> str:
    kind, what = stat.split("_")
    return f"{end}_{side}s_total_{what}" if kind == "total" else f"{kind}_{end}_{side}_{what}"


def sequence_check(messages: DataFrame, chunks: int | None = None) -> DataFrame:
    """Messages that break the chain: an update whose prev_seq_id isn't the seq_id before, a snapshot whose prev_seq_id isn't -1."""
    own = scan.step(messages, SYMBOL, ORDER, previous={"_seq": "seq_id"}, chunks=chunks)
    broken = F.when(F.col("action") == "Snapshot", F.col("prev_seq_id") != -1).otherwise(F.coalesce(F.col("prev_seq_id") != F.col("_seq"), F.lit(True)))
    return own.where(broken).withColumnRenamed("_seq", "expected_seq_id")


def asof(left: DataFrame, right: DataFrame, left_ms: str, right_ms: str, right_id: str, name: str, chunks: int | None = None) -> DataFrame:
    """left with the id of right's latest row at or before its time, else right's first id. Ties of right: the largest id."""
    marks = right.select("symbol", F.col(right_ms).alias("_ms"), F.lit(0).alias("_kind"), F.col(right_id).alias("_id"))
    rows = left.select("symbol", F.col(left_ms).alias("_ms"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_id"), F.struct(*left.columns).alias("_row"))
    known = scan.step(marks.unionByName(rows, allowMissingColumns=True), SYMBOL, ["_ms", "_kind", "_id"], known={"_known": F.col("_id")}, chunks=chunks)
    first = right.groupBy("symbol").agg(F.min(right_id).alias("_first"))
    return known.where("_kind = 1").join(first, "symbol", "left").select("_row.*", F.coalesce("_known", "_first").alias(name))


def latest_snapshot(events: DataFrame, times: DataFrame, chunks: int | None = None) -> DataFrame:
    """For each (symbol, timestamp_ms) of times: the last snapshot at or before it, the first at or after it, the next after it."""
    snaps = events.where("action = 'Snapshot'").select("symbol", "timestamp_ms").distinct()
    asked = times.select("symbol", "timestamp_ms").distinct()
    marks = snaps.select("symbol", "timestamp_ms", F.lit(1).alias("_kind")).unionByName(asked.select("symbol", "timestamp_ms", F.lit(0).alias("_kind")))
    marks = scan.saved(marks)
    before = scan.step(marks.withColumn("_k", 1 - F.col("_kind")), SYMBOL, ["timestamp_ms", "_k"], known={"last_at_or_before": F.when(F.col("_kind") == 1, F.col("timestamp_ms"))}, chunks=chunks).where("_kind = 0")
    back = marks.withColumns({"_t": -F.col("timestamp_ms"), "_k": 1 - F.col("_kind")})
    at = scan.step(back, SYMBOL, ["_t", "_k"], known={"first_at_or_after": F.when(F.col("_kind") == 1, F.col("timestamp_ms"))}, chunks=chunks).where("_kind = 0")
    after = scan.step(back, SYMBOL, ["_t", "_kind"], known={"next_after": F.when(F.col("_kind") == 1, F.col("timestamp_ms"))}, chunks=chunks).where("_kind = 0")
    keys = ["symbol", "timestamp_ms"]
    return before.select(*keys, "last_at_or_before").join(at.select(*keys, "first_at_or_after"), keys).join(after.select(*keys, "next_after"), keys)
