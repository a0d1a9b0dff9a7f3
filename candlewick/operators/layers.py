"""Sparse chart layers: extents, volume profiles, extreme lines, heatmaps. A cell is a row (symbol, x, y, value)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.operators import book, scan
from candlewick.operators.runs import trade_volume

HEIGHT = 100


def trade_extent(trades: DataFrame) -> DataFrame:
    """Per symbol the least and largest price and id, their differences, the scale of a cell, the width; none if a difference is 0."""
    e = trades.groupBy("symbol").agg(F.min("price").cast("double").alias("min_price"), F.max("price").cast("double").alias("max_price"), F.min("trade_id").alias("min_trade_id"), F.max("trade_id").alias("max_trade_id"))
    e = e.withColumns({"delta_price": F.col("max_price") - F.col("min_price"), "delta_trade_id": F.col("max_trade_id") - F.col("min_trade_id")})
    e = e.withColumns({"scale": F.col("delta_price") / HEIGHT, "width": F.floor(HEIGHT * F.col("delta_trade_id") / F.col("delta_price")).cast("bigint")})
    return e.where("delta_price > 0 and delta_trade_id > 0")


def _cell(value, low: str):
    return F.floor((value - F.col(low)) / F.col("scale")).cast("bigint")


def _y(price):
    return F.least(_cell(price, "min_price"), F.lit(HEIGHT - 1))


def trade_volume_profile(trades: DataFrame) -> DataFrame:
    """Volume of buys (side bid) and sells (side ask) in each cell of trade id and price, clamped at the edges."""
    own = trades.join(scan.saved(trade_extent(trades)), "symbol")  # a row for each symbol: the planner knows its size
    x = F.greatest(F.least(_cell(F.col("trade_id"), "min_trade_id"), F.col("width") - 1), F.lit(0))
    y = F.greatest(_y(F.col("price").cast("double")), F.lit(0))
    return own.groupBy("symbol", F.when(F.col("is_buy"), "bid").otherwise("ask").alias("side"), x.alias("x"), y.alias("y")).agg(F.sum(trade_volume()).alias("value"))


def first_cover(low: np.ndarray, high: np.ndarray, since: np.ndarray, price: np.ndarray) -> np.ndarray:
    """For each price the first range at or after its place since that has it, else the number of ranges.

    The ranges of successive nodes meet, so a pair's joint range has a price only if one of the two has it. All searches
    climb a tree of pairs side by side, over the next node of each level, and come down where one has the price.
    """
    n = len(low)
    lows, highs = [low], [high]
    while len(lows[-1]) > 1:
        x, y = (np.append(v, pad) if len(v) % 2 else v for v, pad in ((lows[-1], np.inf), (highs[-1], -np.inf)))
        lows.append(np.minimum(x[::2], x[1::2]))
        highs.append(np.maximum(y[::2], y[1::2]))
    at, level, found = since.astype(np.int64).copy(), np.zeros(len(since), np.int64), np.full(len(since), n)
    climbing = np.ones(len(since), bool)
    alive = np.arange(len(since))[at < n]
    while len(alive):
        sizes = np.array([len(v) for v in lows])[level[alive]]
        alive = alive[at[alive] < sizes]
        has = np.zeros(len(alive), bool)
        for h in np.unique(level[alive]).tolist():
            mine = level[alive] == h
            i = alive[mine]
            has[mine] = (lows[h][at[i]] <= price[i]) & (price[i] <= highs[h][at[i]])
        hit, miss = alive[has], alive[~has]
        found[hit[level[hit] == 0]] = at[hit[level[hit] == 0]]
        down = hit[level[hit] > 0]
        level[down] -= 1
        at[down] *= 2
        climbing[down] = False
        at[miss] += 1
        up = miss[climbing[miss] & (at[miss] % 2 == 0)]
        up = up[level[up] + 1 < len(lows)]
        at[up] //= 2
        level[up] += 1
        alive = np.concatenate([down, miss])
    return found


_FANOUT = 64


def _first_later(still: DataFrame, ranges: DataFrame) -> DataFrame:
    """Columns of still (symbol, _chunk, price, ...) and _later, its first later chunk whose range has the price; others are left out.

    The chunks of a symbol form a tree of 64 children a node; a level looks at the later siblings of its node on each floor,
    then at the children of the first node that has its price: 63 and 64 rows at most for each level and floor.
    """
    floors, top = [ranges], ranges.agg(F.max("_node")).first()[0] or 0
    while top > 0:
        top //= _FANOUT
        upper = floors[-1].groupBy("symbol", F.floor(F.col("_node") / _FANOUT).cast("bigint").alias("_node")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
        floors.append(scan.saved(upper))
    own, found = still.withColumn("_place", F.col("_chunk")), None
    for h, floor in enumerate(floors[:-1]):
        nodes = floor.withColumn("_parent", F.floor(F.col("_node") / _FANOUT).cast("bigint"))
        hit = own.withColumn("_parent", F.floor(F.col("_place") / _FANOUT).cast("bigint")).join(nodes, ["symbol", "_parent"]).where("_node > _place and price between low and high")
        hit = hit.groupBy(*still.columns).agg(F.min("_node").alias("_later"))
        own = scan.saved(own.join(hit.select(*still.columns), still.columns, "left_anti").withColumn("_place", F.floor(F.col("_place") / _FANOUT).cast("bigint")))
        for below in reversed(floors[:h]):
            children = below.withColumn("_later", F.floor(F.col("_node") / _FANOUT).cast("bigint"))
            hit = hit.join(children, ["symbol", "_later"]).where("price between low and high").groupBy(*still.columns).agg(F.min("_node").alias("_later"))
        found = hit if found is None else found.unionByName(hit)
    return still.withColumn("_later", F.lit(None).cast("bigint")).limit(0) if found is None else found


def extreme_lines(lines: DataFrame, last_ids: DataFrame, chunks: int | None = None) -> DataFrame:
    """From each end of each line a level at its price, until the start of the first later line that covers the price, else until last_ids' max_trade_id.

    A line without a step has one level, from its start. Chunks are solved alone; what stays open goes to the first later
    chunk whose range has the price: lines join end to end, so one of that chunk's lines covers it.
    """
    narrow = lines.select("symbol", "start_trade_id", "end_trade_id", F.col("start_price").cast("double").alias("start_price"), F.col("end_price").cast("double").alias("end_price"))
    own = scan.chunked(scan.saved(narrow), ["symbol"], "start_trade_id", chunks)
    schema = "symbol string, _chunk bigint, price double, start_trade_id bigint, end_trade_id bigint"

    def ordered(rows: pa.Table) -> tuple[np.ndarray, ...]:
        rows = rows.combine_chunks().sort_by([("start_trade_id", "ascending"), ("end_trade_id", "ascending")])
        p, q = (rows.column(c).to_numpy() for c in ("start_price", "end_price"))
        return rows.column("start_trade_id").to_numpy(), rows.column("end_trade_id").to_numpy(), p, q, np.minimum(p, q), np.maximum(p, q)

    def solve(rows: pa.Table) -> pa.Table:
        a, b, p, q, low, high = ordered(rows)
        steps = np.flatnonzero(p != q)
        at, price = np.concatenate([np.arange(len(a)), steps]), np.concatenate([p, q[steps]])
        until = first_cover(low, high, at + 1, price)
        ends = pa.array(np.append(a, 0)[until], pa.int64(), mask=until == len(a))
        n = len(at)
        return pa.table([pa.array([rows.column("symbol")[0].as_py()] * n, pa.string()), pa.array(np.full(n, rows.column("_chunk")[0].as_py())), pa.array(price), pa.array(np.concatenate([a, b[steps]])), ends], ["symbol", "_chunk", "price", "start_trade_id", "end_trade_id"])

    first = scan.saved(own.groupBy("symbol", "_chunk").applyInArrow(solve, schema))
    ranges = scan.saved(own.groupBy("symbol", F.col("_chunk").alias("_node")).agg(F.min(F.least("start_price", "end_price")).alias("low"), F.max(F.greatest("start_price", "end_price")).alias("high")))
    still = first.where("end_trade_id is null").drop("end_trade_id")
    later = scan.saved(_first_later(still, ranges))

    def close(levels: pa.Table, rows: pa.Table) -> pa.Table:
        a, _, _, _, low, high = ordered(rows)
        price = levels.column("price").to_numpy()
        ends = a[first_cover(low, high, np.zeros(len(price), np.int64), price)] if len(a) else np.zeros(0, np.int64)
        return pa.table([*(levels.column(c) for c in ("symbol", "_chunk", "price", "start_trade_id")), pa.array(ends)], ["symbol", "_chunk", "price", "start_trade_id", "end_trade_id"])

    renamed = own.select(F.col("symbol").alias("s"), F.col("_chunk").alias("c"), "start_trade_id", "end_trade_id", "start_price", "end_price")
    needed = renamed.join(later.select(F.col("symbol").alias("s"), F.col("_later").alias("c")).distinct(), ["s", "c"], "left_semi")
    second = later.groupBy("symbol", "_later").cogroup(needed.groupBy("s", "c")).applyInArrow(close, schema)
    open_ones = still.join(later, ["symbol", "_chunk", "price", "start_trade_id"], "left_anti").join(last_ids.select("symbol", "max_trade_id"), "symbol")
    out = first.where("end_trade_id is not null").unionByName(second).unionByName(open_ones.withColumnRenamed("max_trade_id", "end_trade_id").select("symbol", "_chunk", "price", "start_trade_id", "end_trade_id"))
    return out.drop("_chunk")


def winning_pieces(levels: DataFrame, extent: DataFrame, chunks: int | None = None) -> DataFrame:
    """Columns symbol, y, x_from, x_to, since: where a level holds its row of cells; these pieces don't overlap.

    Of the levels in a cell the one that ends last holds, then the one that starts last, then the higher. So a level that
    starts where one that ends later lives holds nothing, and any other one holds from its start to its own end or to the
    start of the next that ends later: a running maximum of the ends, in order of starts, leaves those that hold at all.
    """
    own = levels.join(scan.saved(extent), "symbol")  # a row for each symbol: the planner knows its size
    own = own.select("symbol", _y(F.col("price")).alias("y"), _cell(F.col("start_trade_id"), "min_trade_id").alias("_a"), F.struct("end_trade_id", "start_trade_id", "price", _cell(F.col("end_trade_id"), "min_trade_id").alias("b")).alias("_rank"))
    best = own.where("_rank.b > _a").groupBy("symbol", "y", "_a").agg(F.max("_rank").alias("_rank"))
    keys = ["symbol", "y"]
    best = scan.chunked(scan.saved(best), keys, "_a", chunks)
    w = scan.inside(keys, "_a")
    upto, earlier = (w.rowsBetween(Window.unboundedPreceding, n) for n in (0, -1))
    local = {"_upto": F.max("_rank").over(upto), "_earlier": F.max("_rank").over(earlier)}
    rows = scan.carried(best, keys, ["_a"], local, lambda _, before: {"_before": F.max("_upto").over(before)})
    over = lambda c: F.coalesce(F.col("_rank") > F.col(c), F.lit(True))
    holding = rows.where(over("_earlier") & over("_before")).select(*keys, "_a", F.col("_rank.b").alias("_b"), (-F.col("_a")).alias("_back"))
    ended = scan.step(scan.saved(holding), keys, ["_back"], previous={"_next": "_a"}, chunks=chunks)
    return ended.select(*keys, F.col("_a").alias("x_from"), F.least("_b", "_next").alias("x_to"), F.col("_a").alias("since"))


def extreme_line_raster(levels: DataFrame, extent: DataFrame, range_cells: int = 65_536, chunks: int | None = None) -> DataFrame:
    """Cells of each level from its start to its end with 0, 1, 2, ...; of levels in one cell the one that ends last holds.

    Only pieces that hold are made into cells, so there are as many rows as cells come out. A piece is cut into ranges of
    range_cells, which are dealt over the tasks.
    """
    pieces = winning_pieces(levels, extent, chunks)
    ranges = pieces.withColumn("_from", F.explode(F.sequence(F.col("x_from"), F.col("x_to") - 1, F.lit(range_cells).cast("bigint"))))
    ranges = ranges.withColumn("_to", F.least(F.col("_from") + range_cells, "x_to") - 1)
    ranges = ranges.repartition(int(levels.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol", "y", "_from")  # a number, so that small rows aren't put together
    return ranges.select("symbol", F.explode(F.sequence("_from", "_to")).alias("x"), "y", "since").select("symbol", "x", "y", (F.col("x") - F.col("since")).alias("value"))


_FRACTION = 1 << 40


def _heated(rows: pa.Table, add: bool) -> pa.Table:
    """The cells of a segment of a data set, with the last event in each; see book_volume_heatmap.

    In each row of cells the lives of levels are laid over the events between which something starts or ends there: of the
    levels between two such events the highest holds, or their sum. What holds becomes cells only then, and two successive
    pieces share one column of cells at most.
    """
    key = [rows.column(c)[0].as_py() for c in ("symbol", "data_set_idx")]
    events, levels, start, end = book.lives(rows)
    n, x = len(events), events.column("x").to_numpy()
    new = np.ones(n, bool)
    new[1:] = x[1:] != x[:-1]
    column, first = np.cumsum(new) - 1, np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    y, price, value = (levels.column(c).to_numpy() for c in ("y", "price", "value"))
    live = (value > 0) & (end > start) & (y >= 0)
    bid = np.asarray(pc.equal(levels.column("side"), "bid").combine_chunks())[live]
    start, end, y, price, value = (v[live] for v in (start, end, y, price, value))
    places = np.unique(np.concatenate([y * n + start, y * n + end]))
    a, b = (np.searchsorted(places, y * n + v) for v in (start, end))
    by_rank = np.lexsort((bid, price))
    rank = np.empty(len(by_rank), np.int64)
    rank[by_rank] = np.arange(len(by_rank))
    top = book.covering(a, b, rank, len(places), -1)
    held = np.flatnonzero(top >= 0)
    if add:  # exact, as whole numbers and fractions
        whole = np.floor(value)
        parts = whole.astype(np.int64), np.rint((value - whole) * _FRACTION).astype(np.int64)
        whole, rest = (book.running(a, b, v, len(places))[held] for v in parts)
        piece = whole + rest / _FRACTION
    else:
        piece = value[by_rank][top[held]]
    row, since = places[held] // max(n, 1), places[held] % max(n, 1)
    until = since + places[np.minimum(held + 1, len(places) - 1)] - places[held] - 1
    count = column[until] - column[since] + 1
    i = np.repeat(np.arange(len(held)), count)
    c = column[since][i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
    at = np.minimum(last[c], until[i])
    cell = row[i] * len(first) + c
    ends = np.ones(len(cell), bool)
    ends[:-1] = cell[1:] != cell[:-1]
    if add:
        each = piece[i] * (at - np.maximum(first[c], since[i]) + 1)
        begins = np.append(0, np.flatnonzero(ends)[:-1] + 1) if len(cell) else np.zeros(0, np.int64)
        made = np.add.reduceat(each, begins) if len(cell) else each
    else:
        made = piece[i][ends]
    c, row, at = c[ends], row[i][ends], at[ends]
    shown = x[first[c]] >= 0
    c, row, at, made = (v[shown] for v in (c, row, at, made))
    k = len(c)
    columns = [pa.array([key[0]] * k, pa.string()), pa.array([key[1]] * k, pa.int64()), pa.array(x[first[c]]), pa.array(row), *(events.column(o).take(pa.array(at)) for o in book.ORDER), pa.array(made)]
    return pa.table(columns, ["symbol", "data_set_idx", "x", "y", *book.ORDER, "value"])


def book_volume_heatmap(changes: DataFrame, bars: DataFrame, extent: DataFrame, add: bool = False, rows: int = 200_000, chunks: int | None = None) -> DataFrame:
    """At each event the live levels' volumes: x from the bar at that time, y from the price; later events, then higher prices, overwrite, or add up.

    Cells below 0 are dropped. Data sets are cut into segments of about so many rows, as in book.state_stats; a segment gives
    a row for each of its cells, and the last segment of a cell, or the sum, counts. The x of a data set rise with the events.
    """
    extent = scan.saved(extent)  # a row for each symbol: the planner knows its size
    keys = ["symbol", "data_set_idx", *book.ORDER]
    e = book.asof(changes.select(*keys).distinct(), bars, "timestamp_ms", "start_timestamp_ms", "start_trade_id", "bar_id", chunks)
    e = e.join(extent, "symbol").select(*keys, _cell(F.col("bar_id"), "min_trade_id").alias("x")).where("x is not null")
    own = changes if "position" in changes.columns else changes.withColumn("position", F.lit(0))
    own = book.segments(own.select(*keys, "side", "position", "price", "quantity").join(e, keys), rows, chunks).join(extent, "symbol")
    own = own.select(
        *keys, "_segment", "side", "position", "x", (F.col("price") * book.UNIT).cast("bigint").alias("price"), _y(F.col("price").cast("double")).alias("y"), (F.col("price") * F.col("quantity")).cast("double").alias("value"),
    )
    schema = "symbol string, data_set_idx bigint, x bigint, y bigint, timestamp_ms bigint, event_id bigint, value double"
    cells = own.groupBy("symbol", "data_set_idx", "_segment").applyInArrow(lambda t: _heated(t, add), schema).groupBy("symbol", "x", "y")
    return cells.agg(F.sum("value").alias("value") if add else F.max_by("value", F.struct("data_set_idx", *book.ORDER)).alias("value"))
