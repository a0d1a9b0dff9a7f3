"""Forward returns, sample sets, segments and backtests of predictions on indexed bars (column bar_index)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions import columns as X
from candlewick.operators import migrate, scan

KEY = ["symbol", "sample_index"]


def forward_return(bars: DataFrame, steps: int) -> DataFrame:
    """Entry and exit bar at + steps, with target, the base-2 logarithm of their closes' ratio, infinite where one is 0; entries without an exit are dropped."""
    exits = bars.select("symbol", (F.col("bar_index") - steps).alias("bar_index"), F.col("start_trade_id").alias("exit_trade_id"), F.col("start_timestamp_ms").alias("exit_timestamp_ms"), F.col("close_price").cast("double").alias("exit_close"))
    entries = bars.select("symbol", "bar_index", F.col("start_trade_id").alias("entry_trade_id"), F.col("start_timestamp_ms").alias("entry_timestamp_ms"), F.col("open_price").cast("double").alias("entry_open"), F.col("close_price").cast("double").alias("entry_close"))
    return entries.join(exits, ["symbol", "bar_index"]).withColumn("target", X.log2(F.col("exit_close")) - X.log2(F.col("entry_close")))


def grid_samples(bars: DataFrame, step: int, steps: int) -> DataFrame:
    """Positions 0, step, 2 * step, ... that have a bar at + steps."""
    n = bars.groupBy("symbol").agg(F.count("*").alias("_n"))
    return bars.where(F.col("bar_index") % step == 0).join(n, "symbol").where(F.col("bar_index") <= F.col("_n") - 1 - steps).select("symbol", F.col("bar_index").alias("sample_index"))


def merge_sample_indices(*samples: DataFrame) -> DataFrame:
    out = samples[0].select(*KEY)
    for s in samples[1:]:
        out = out.union(s.select(*KEY))
    return out.distinct()


def align_samples(samples: DataFrame, inference: DataFrame, train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples mapped over the inference bars' start id to the train bars' position; per symbol how many have none."""
    raw = samples.join(inference.select("symbol", F.col("bar_index").alias("sample_index"), "start_trade_id"), KEY, "left")
    mapped = raw.join(train.select("symbol", "start_trade_id", F.col("bar_index").alias("train_index")), ["symbol", "start_trade_id"], "left")
    return mapped.where("train_index is not null"), mapped.where("train_index is null").groupBy("symbol").agg(F.count("*").alias("skipped"))


def research_segments(samples: DataFrame, predictions: DataFrame, bars: DataFrame, steps: int) -> DataFrame:
    """A row for each sample with a prediction and both bars: prices, target, predicted price, action, whether entry is allowed, realized return, PnL."""
    rows = samples.join(predictions, KEY).join(forward_return(bars, steps).withColumnRenamed("bar_index", "sample_index"), KEY)
    rows = rows.withColumns({
        "target_price": X.pred_target_price(F.col("entry_close"), F.col("pred_log2")), "action": X.policy_direction(F.col("p_long"), F.col("p_short")),
        "allowed": X.entry_allowed(F.col("hint_mode"), F.col("blocks"), F.col("blocks")), "linear": X.power_of_two(F.col("target")) - 1,
    })
    return rows.withColumn("net_pnl", X.net_pnl(F.col("action"), F.col("linear")))


def backtest_grid(segments: DataFrame) -> DataFrame:
    return segments.where("allowed and net_pnl is not null")


def backtest_summary(trades: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Per symbol the PnL and number of trades, of all and of those with a visible entry."""
    seen = X.visible("entry_trade_id", low, high)
    return trades.groupBy("symbol").agg(F.sum("net_pnl").alias("net_pnl"), F.count("*").alias("n_trades"), F.coalesce(F.sum(F.when(seen, F.col("net_pnl"))), F.lit(0.0)).alias("visible_net_pnl"), F.count_if(seen).alias("n_visible"))


def _next(at: np.ndarray, free: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of the first sample from each free position on, and of the first one at + steps after each sample."""
    return np.searchsorted(at, free), np.searchsorted(at, at + steps)


def backtest_sequential(segments: DataFrame, steps: int, chunks: int | None = None) -> DataFrame:
    """Trades that don't overlap: from the first allowed sample on, each time the next one at + steps or later.

    Only positions go to the helpers, in chunks of sample indices of at least steps. A trade from before reaches less than
    steps into a chunk, so each chunk is solved for each of these first free positions; the one that comes true follows
    from the chunks before, of which a row each is composed in order; then the chunk is walked once more from there.
    """
    allowed = scan.saved(backtest_grid(segments))
    low, high, n = allowed.agg(F.min("sample_index"), F.max("sample_index"), F.count("*")).first()
    if low is None:
        return allowed
    width = max(steps, -(-(high - low + 1) // (chunks or -(-n // scan.ROWS_PER_CHUNK))))
    own = allowed.select(*KEY, F.floor((F.col("sample_index") - low) / width).cast("bigint").alias("_chunk"))

    def sorted_at(rows: pa.Table) -> tuple[str, int, np.ndarray]:
        return rows.column("symbol")[0].as_py(), rows.column("_chunk")[0].as_py(), np.sort(rows.column("sample_index").to_numpy())

    def ends(rows: pa.Table) -> pa.Table:
        """For each first free position of the chunk the one after its last trade."""
        symbol, chunk, at = sorted_at(rows)
        free = low + chunk * width + np.arange(steps)
        i, after = _next(at, free, steps)
        while (going := i < len(at)).any():
            free[going] = at[i[going]] + steps
            i[going] = after[i[going]]
        return pa.table([[symbol], [chunk], pa.array([free.tolist()], pa.list_(pa.int64()))], ["symbol", "_chunk", "free"])

    def compose(rows: pa.Table) -> pa.Table:
        rows, first = rows.combine_chunks().sort_by("_chunk"), []
        free = low
        for chunk, after in zip(rows.column("_chunk").to_pylist(), rows.column("free"), strict=True):
            begin = low + chunk * width
            first.append(max(free, begin))
            free = after[first[-1] - begin].as_py()
        return pa.table([rows.column("symbol"), rows.column("_chunk"), pa.array(first, pa.int64())], ["symbol", "c", "first"])

    def walk(begin: pa.Table, rows: pa.Table) -> pa.Table:
        symbol, _, at = sorted_at(rows)
        i, after = (x.tolist() for x in _next(at, begin.column("first").to_numpy(), steps))
        taken, i = [], i[0]
        while i < len(at):
            taken.append(i)
            i = after[i]
        return pa.table([pa.array([symbol] * len(taken), pa.string()), pa.array(at[np.array(taken, np.int64)])], KEY)

    composed = own.groupBy("symbol", "_chunk").applyInArrow(ends, "symbol string, _chunk bigint, free array<bigint>").groupBy("symbol").applyInArrow(compose, "symbol string, c bigint, first bigint")
    chosen = composed.groupBy("symbol", "c").cogroup(own.groupBy("symbol", "_chunk")).applyInArrow(walk, "symbol string, sample_index bigint")
    return allowed.join(chosen, KEY)


def samples_to_infer(mapped: DataFrame, stored: DataFrame, checkpoint: str, label: str, start_index: int) -> DataFrame:
    """Samples that the stored set lacks; a set of another checkpoint, label or start counts as empty."""
    valid = stored.where((F.col("checkpoint") == checkpoint) & (F.col("label") == label) & (F.col("start_index") == start_index))
    return mapped.join(valid.select(*KEY), KEY, "left_anti")


def merge_research_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    return migrate.replace(new, old, KEY)
