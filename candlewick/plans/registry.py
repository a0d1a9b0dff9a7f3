"""Registers queries with the SQL that gives the same rows; SQL fragments that several of them use."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def places(x: Column) -> Column:
    """A double of 6 places as the SQL's round makes it: the double itself is scaled and rounded, where Spark's round takes the decimal number that it is shown as. The two differ at halves of the last place."""
    scaled = x * 1e6
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 1e6).otherwise(x)


def plain(df: DataFrame) -> DataFrame:
    """Numbers as they are compared: integers as bigint, others as double of 6 places."""
    out = {}
    for name, kind in df.dtypes:
        if kind in ("double", "float") or kind.startswith("decimal"):
            out[name] = places(F.col(name).cast("double")) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            out[name] = F.col(name).cast("bigint")
    return df.withColumns(out)


def num(*names: str, **made: str) -> str:
    """SQL of such doubles: columns by name, and expressions."""
    return ", ".join(f"round(CAST({x} AS DOUBLE), 6) + 0 AS {n}" for n, x in ({n: n for n in names} | made).items())


def big(*names: str, **made: str) -> str:
    return ", ".join(f"CAST({x} AS BIGINT) AS {n}" for n, x in ({n: n for n in names} | made).items())


PRICES = ("open_price", "high_price", "low_price", "close_price")
SUMS = ("buy_quantity", "buy_volume", "total_quantity", "total_volume")
BAR = f"symbol, {big('start_trade_id', 'end_trade_id', 'start_timestamp_ms', 'end_timestamp_ms', 'buy_trades_count', 'total_trades_count')}, {num(*PRICES, *SUMS)}"
BAR_COLUMNS = ["symbol", "start_trade_id", "end_trade_id", "start_timestamp_ms", "end_timestamp_ms", "buy_trades_count", "total_trades_count", *PRICES, *SUMS]

_TRADE_BAR = """min(trade_id) AS start_trade_id, max(trade_id) AS end_trade_id, arg_min(timestamp_ms, trade_id) AS start_timestamp_ms, arg_max(timestamp_ms, trade_id) AS end_timestamp_ms,
  arg_min(price, trade_id) AS open_price, max(price) AS high_price, min(price) AS low_price, arg_max(price, trade_id) AS close_price,
  sum(CASE WHEN is_buy THEN quantity ELSE 0 END) AS buy_quantity, count(*) FILTER (is_buy) AS buy_trades_count, sum(CASE WHEN is_buy THEN price * quantity ELSE 0 END) AS buy_volume,
  sum(quantity) AS total_quantity, count(*) AS total_trades_count, sum(price * quantity) AS total_volume"""
BARS_OF_BARS = """min(start_trade_id) AS start_trade_id, arg_max(end_trade_id, start_trade_id) AS end_trade_id, arg_min(start_timestamp_ms, start_trade_id) AS start_timestamp_ms, arg_max(end_timestamp_ms, start_trade_id) AS end_timestamp_ms,
  arg_min(open_price, start_trade_id) AS open_price, max(high_price) AS high_price, min(low_price) AS low_price, arg_max(close_price, start_trade_id) AS close_price,
  sum(buy_quantity) AS buy_quantity, sum(buy_trades_count) AS buy_trades_count, sum(buy_volume) AS buy_volume, sum(total_quantity) AS total_quantity, sum(total_trades_count) AS total_trades_count, sum(total_volume) AS total_volume"""
STAT_NAMES = [f"{s}_{x}" for s in ("ask", "bid") for x in ("total_quantity", "total_volume", "max_price", "min_price", "max_quantity", "min_quantity", "max_volume", "min_volume")]


def _side_stats(side: str) -> str:
    of = f"FILTER (side = '{side}')"
    parts = [f"coalesce(sum(quantity) {of}, 0) AS {side}_total_quantity", f"coalesce(sum(price * quantity) {of}, 0) AS {side}_total_volume"]
    for x, e in (("price", "price"), ("quantity", "quantity"), ("volume", "price * quantity")):
        parts += [f"max({e}) {of} AS max_{x}_{side}", f"min({e}) {of} AS min_{x}_{side}"]
    return ", ".join(re.sub(r"AS (max|min)_(\w+)_(ask|bid)$", r"AS \3_\1_\2", p) for p in parts)


#: Fragments by name, in an order in which each uses only earlier ones.
PARTS = {
    "trades": "SELECT event_type AS symbol, event_id AS trade_id, user_id % 2 = 0 AS is_buy, CAST(value AS DECIMAL(30,8)) AS price, CAST(1 + CAST(regexp_extract(props, '\"k\": ?(\\d+)', 1) AS INTEGER) AS DECIMAL(30,8)) AS quantity, epoch_us(ts) // 1000 AS timestamp_ms FROM events",
    "raw_lineitem": "SELECT l_returnflag AS symbol, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 100000000000 + l_orderkey * 10 + l_linenumber AS trade_id, l_suppkey % 2 = 0 AS is_buy, CAST(floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000 AS DECIMAL(30,8)) AS price, CAST(l_quantity AS DECIMAL(30,8)) AS quantity, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 86400000 AS timestamp_ms, l_partkey, l_suppkey FROM lineitem",
    "item_trades": "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY symbol, trade_id ORDER BY l_partkey, l_suppkey, price, quantity) AS r FROM raw_lineitem) WHERE r = 1",
    "runs": "SELECT *, sum(c) OVER (PARTITION BY symbol ORDER BY trade_id) AS run_id FROM (SELECT *, CASE WHEN is_buy IS DISTINCT FROM lag(is_buy) OVER (PARTITION BY symbol ORDER BY trade_id) THEN 1 ELSE 0 END AS c FROM trades)",
    "all_bars": f"SELECT symbol, run_id, {_TRADE_BAR} FROM runs GROUP BY symbol, run_id",
    "bars": "SELECT * EXCLUDE (run_id, l) FROM (SELECT *, max(run_id) OVER (PARTITION BY symbol) AS l FROM all_bars) WHERE run_id < l",
    "directed": "SELECT *, CASE WHEN 2 * buy_volume > total_volume THEN 'Bull' WHEN 2 * buy_volume < total_volume THEN 'Bear' ELSE 'Cross' END AS direction FROM bars",
    "direction_runs": "SELECT *, sum(c) OVER (PARTITION BY symbol ORDER BY start_trade_id) AS run_id FROM (SELECT *, CASE WHEN direction IS DISTINCT FROM lag(direction) OVER (PARTITION BY symbol ORDER BY start_trade_id) THEN 1 ELSE 0 END AS c FROM directed WHERE open_price <> close_price)",
    "ibars": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start_trade_id) - 1 AS bar_index FROM bars",
    "candles": "SELECT symbol, timestamp_ms - timestamp_ms % 3600000 AS start_timestamp_ms, arg_min(price, trade_id) AS open_price, max(price) AS high_price, min(price) AS low_price, arg_max(price, trade_id) AS close_price, sum(price * quantity) AS volume, count(*) AS trades_count, min(trade_id) AS start_trade_id, max(trade_id) AS end_trade_id, timestamp_ms - timestamp_ms % 3600000 + 3600000 AS end_timestamp_ms FROM trades GROUP BY symbol, timestamp_ms - timestamp_ms % 3600000",
    "icandles": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start_trade_id) - 1 AS bar_index FROM candles",
    "steps": "SELECT *, sign(price - p)::INTEGER AS s FROM (SELECT *, lag(price) OVER w AS p, lag(trade_id) OVER w AS pid, lag(timestamp_ms) OVER w AS pts FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY trade_id))",
    "ways": "SELECT *, coalesce(last_value(nullif(s, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trade_id), 0) AS way FROM steps",
    "zigzag_runs": "SELECT *, sum(c) OVER (PARTITION BY symbol ORDER BY trade_id) AS line FROM (SELECT *, CASE WHEN way IS DISTINCT FROM lag(way) OVER (PARTITION BY symbol ORDER BY trade_id) THEN 1 ELSE 0 END AS c FROM ways WHERE p IS NOT NULL)",
    "first_trades": "SELECT symbol, min(trade_id) AS first_id, arg_min(quantity, trade_id) AS q, arg_min(price * quantity, trade_id) AS v, max(trade_id) AS last_id FROM trades GROUP BY symbol",
    "lines": "SELECT z.symbol, CASE WHEN any_value(way) > 0 THEN 'Bull' WHEN any_value(way) < 0 THEN 'Bear' ELSE 'Cross' END AS trading_direction, arg_min(p, trade_id) AS start_price, arg_max(price, trade_id) AS end_price, min(pid) AS start_trade_id, max(trade_id) AS end_trade_id, arg_min(pts, trade_id) AS start_timestamp_ms, arg_max(timestamp_ms, trade_id) AS end_timestamp_ms, sum(quantity) + max(CASE WHEN pid = first_id THEN q ELSE 0 END) AS quantity, sum(price * quantity) + max(CASE WHEN pid = first_id THEN v ELSE 0 END) AS volume FROM zigzag_runs z JOIN first_trades f ON z.symbol = f.symbol GROUP BY z.symbol, line",
    "book": "SELECT event_type AS symbol, epoch_us(ts) // 1000 AS timestamp_ms, event_id, CASE WHEN row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id) = 1 THEN 'Snapshot' ELSE 'Update' END AS action, CASE WHEN event_id % 2 = 0 THEN 'ask' ELSE 'bid' END AS side, CAST(round(value) AS DECIMAL(30,8)) AS price, CAST(CAST(regexp_extract(props, '\"k\": ?(\\d+)', 1) AS INTEGER) % 10 AS DECIMAL(30,8)) AS quantity FROM events",
    "changes": "SELECT * EXCLUDE (n, m), n - 1 AS data_set_idx FROM (SELECT *, max(n) OVER (PARTITION BY symbol) AS m FROM (SELECT *, CAST(sum(CASE WHEN action = 'Snapshot' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY timestamp_ms, event_id) AS BIGINT) AS n FROM book)) WHERE n > 0 AND n < m",
    "lives": "SELECT symbol, data_set_idx, side, price, quantity, timestamp_ms AS from_ms, event_id AS from_id, lead(timestamp_ms) OVER w AS to_ms, lead(event_id) OVER w AS to_id FROM changes WINDOW w AS (PARTITION BY symbol, data_set_idx, side, price ORDER BY timestamp_ms, event_id)",
    "book_states": "SELECT e.symbol, e.data_set_idx, e.timestamp_ms, e.event_id, l.side, l.price, l.quantity FROM changes e LEFT JOIN lives l ON e.symbol = l.symbol AND e.data_set_idx = l.data_set_idx AND l.from_id <= e.event_id AND (l.to_id IS NULL OR l.to_id > e.event_id) AND l.quantity > 0",
    "states": f"SELECT symbol, data_set_idx, timestamp_ms, event_id, {_side_stats('ask')}, {_side_stats('bid')} FROM book_states GROUP BY ALL",
    "spans": "SELECT * FROM (SELECT symbol, data_set_idx, lag(timestamp_ms) OVER w AS start_timestamp_ms, lag(event_id) OVER w AS start_event_id, timestamp_ms AS end_timestamp_ms, event_id AS end_event_id FROM changes WINDOW w AS (PARTITION BY symbol, data_set_idx ORDER BY timestamp_ms, event_id)) WHERE start_event_id IS NOT NULL",
    "placed": "SELECT t.*, s.* EXCLUDE (symbol) FROM trades t JOIN spans s ON t.symbol = s.symbol AND t.timestamp_ms >= s.start_timestamp_ms AND t.timestamp_ms < s.end_timestamp_ms",
    "span_stats": f"SELECT symbol, data_set_idx, start_timestamp_ms AS from_ms, start_event_id, end_timestamp_ms AS to_ms, end_event_id, {_TRADE_BAR} FROM placed GROUP BY symbol, data_set_idx, placed.start_timestamp_ms, start_event_id, placed.end_timestamp_ms, end_event_id",
    "records": "SELECT t.* EXCLUDE (start_timestamp_ms, end_timestamp_ms), t.from_ms AS start_timestamp_ms, t.to_ms AS end_timestamp_ms, row_number() OVER (PARTITION BY t.symbol, t.data_set_idx ORDER BY t.to_ms, t.end_event_id) - 1 AS record_idx, "
    + ", ".join(f"{a}.{n} AS {e}_{n}" for a, e in (("a", "start"), ("b", "end")) for n in STAT_NAMES)
    + " FROM span_stats t JOIN states a ON a.symbol = t.symbol AND a.event_id = t.start_event_id JOIN states b ON b.symbol = t.symbol AND b.event_id = t.end_event_id",
    "extent": "SELECT *, delta_price / 100 AS scale, CAST(floor(100 * delta_trade_id / delta_price) AS BIGINT) AS width FROM (SELECT *, max_price - min_price AS delta_price, max_trade_id - min_trade_id AS delta_trade_id FROM (SELECT symbol, CAST(min(price) AS DOUBLE) AS min_price, CAST(max(price) AS DOUBLE) AS max_price, min(trade_id) AS min_trade_id, max(trade_id) AS max_trade_id FROM trades GROUP BY symbol)) WHERE delta_price > 0 AND delta_trade_id > 0",
    "numbered_lines": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start_trade_id, end_trade_id) AS no FROM lines",
    "ends": "SELECT symbol, no, CAST(end_price AS DOUBLE) AS price, end_trade_id AS start_trade_id FROM numbered_lines UNION ALL SELECT symbol, no, CAST(start_price AS DOUBLE), start_trade_id FROM numbered_lines",
    "levels": "SELECT e.symbol, e.price, e.start_trade_id, coalesce(min(l.start_trade_id), max(f.last_id)) AS end_trade_id FROM ends e JOIN first_trades f ON f.symbol = e.symbol LEFT JOIN numbered_lines l ON l.symbol = e.symbol AND l.no > e.no AND e.price BETWEEN least(l.start_price, l.end_price) AND greatest(l.start_price, l.end_price) GROUP BY e.symbol, e.no, e.price, e.start_trade_id",
    "predictions": "SELECT b.symbol, b.bar_index AS sample_index, (CAST(regexp_extract(props, '\"k\": ?(\\d+)', 1) AS INTEGER) - 50) / 1000.0 AS pred_log2, CAST(regexp_extract(props, '\"k\": ?(\\d+)', 1) AS INTEGER) / 100.0 AS p_long, user_id % 3 = 0 AS blocks FROM ibars b JOIN events e ON e.event_id = b.start_trade_id",
    "returns": "SELECT a.symbol, a.bar_index, a.start_trade_id AS entry_trade_id, a.start_timestamp_ms AS entry_timestamp_ms, CAST(a.open_price AS DOUBLE) AS entry_open, CAST(a.close_price AS DOUBLE) AS entry_close, b.start_trade_id AS exit_trade_id, b.start_timestamp_ms AS exit_timestamp_ms, CAST(b.close_price AS DOUBLE) AS exit_close, log2(CAST(b.close_price AS DOUBLE)) - log2(CAST(a.close_price AS DOUBLE)) AS target FROM ibars a JOIN ibars b ON a.symbol = b.symbol AND b.bar_index = a.bar_index + 8",
    "counted": "SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM ibars",
    "grid": "SELECT symbol, bar_index AS sample_index FROM counted WHERE bar_index % 4 = 0 AND bar_index <= n - 1 - 8",
    "segments": "SELECT *, CASE WHEN action = 'long' THEN linear - 0.001 ELSE -linear - 0.001 END AS net_pnl FROM (SELECT g.symbol, g.sample_index, p.pred_log2, p.p_long, r.* EXCLUDE (symbol, bar_index), entry_close * pow(2, pred_log2) AS target_price, CASE WHEN p_long >= 1 - p_long THEN 'long' ELSE 'short' END AS action, NOT blocks AS allowed, pow(2, target) - 1 AS linear FROM grid g JOIN predictions p ON g.symbol = p.symbol AND g.sample_index = p.sample_index JOIN returns r ON r.symbol = g.symbol AND r.bar_index = g.sample_index)",
    "positions": "SELECT symbol || '-' || lpad(CAST(bar_index AS VARCHAR), 8, '0') AS position_id, symbol, CASE WHEN bar_index % 2 = 0 THEN 'long' ELSE 'short' END AS side, CAST(close_price AS DOUBLE) AS entry_price, 7.0::DOUBLE AS notional_usd, bar_index AS entry_index, bar_index + 8 AS exit_index FROM icandles",
    "marks": "SELECT p.*, c.bar_index, CAST(c.close_price AS DOUBLE) AS mark_price, c.start_timestamp_ms AS mark_ms, CASE WHEN side = 'long' THEN (CAST(c.close_price AS DOUBLE) - entry_price) / entry_price ELSE (entry_price - CAST(c.close_price AS DOUBLE)) / entry_price END AS gross FROM positions p JOIN icandles c ON c.symbol = p.symbol AND c.bar_index > p.entry_index AND c.bar_index <= p.exit_index",
    "both_marks": "SELECT position_id, bar_index, mark_price, gross FROM marks UNION ALL SELECT position_id, entry_index, entry_price, 0.0 FROM positions",
    "excursions": "SELECT p.*, m.* EXCLUDE (position_id) FROM positions p JOIN (SELECT position_id, max(gross) AS mfe_gross, min(gross) AS mae_gross, arg_max(mark_price, ROW(gross, bar_index)) AS mfe_mark_price, arg_max(mark_price, ROW(-gross, bar_index)) AS mae_mark_price, arg_max(mark_price, bar_index) AS mark_price, count(*) - 1 AS bars_elapsed FROM both_marks GROUP BY position_id) m ON m.position_id = p.position_id",
    "closed": "SELECT *, CASE WHEN side = 'long' THEN (exit_price - entry_price) / entry_price ELSE (entry_price - exit_price) / entry_price END AS gross FROM (SELECT e.*, CAST(c.close_price AS DOUBLE) AS exit_price FROM excursions e JOIN icandles c ON c.symbol = e.symbol AND c.bar_index = e.exit_index)",
}


def sql(body: str, recursive: bool = False, **more: str) -> str:
    """body with the fragments it uses, directly or over others; more are fragments of its own."""
    own = PARTS | more
    used: set[str] = set()
    todo = [body, *more.values()]
    while todo:
        text = todo.pop()
        for name in own:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                todo.append(own[name])
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(f"{n} AS ({own[n]})" for n in own if n in used) + f"\n{body}" if used else body


def query(oracle: str | None = None):
    """Registers a function under its name, its numbers made plain."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add
