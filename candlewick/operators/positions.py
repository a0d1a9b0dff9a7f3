"""Positions: their bars, excursions, metrics, closed trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions import columns as X


def position_bars(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars after entry up to exit of each position (entry_index, exit_index): an equi-join on the positions of bars."""
    rows = positions.withColumn("bar_index", F.explode(F.sequence(F.col("entry_index") + 1, "exit_index")))
    return rows.join(bars.select("symbol", "bar_index", F.col("close_price").cast("double").alias("mark_price"), F.col("start_timestamp_ms").alias("mark_ms")), ["symbol", "bar_index"])


def position_excursions(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds the largest and least gross return since entry, 0 at first, with their prices (of equal ones the latest), and the last mark."""
    marks = position_bars(positions, bars).withColumn("gross", X.gross_return(F.col("side"), F.col("entry_price"), F.col("mark_price")))
    at_entry = positions.withColumns({"bar_index": F.col("entry_index"), "mark_price": F.col("entry_price"), "mark_ms": F.lit(None).cast("bigint"), "gross": F.lit(0.0)})
    both = marks.unionByName(at_entry)
    found = both.groupBy("position_id").agg(
        F.max("gross").alias("mfe_gross"), F.min("gross").alias("mae_gross"), F.max_by("mark_price", F.struct("gross", "bar_index")).alias("mfe_mark_price"),
        F.max_by("mark_price", F.struct(-F.col("gross"), "bar_index")).alias("mae_mark_price"), F.max_by("mark_price", "bar_index").alias("mark_price"), (F.count("*") - 1).alias("bars_elapsed"),
    )
    return positions.join(found, "position_id")


def _display(df: DataFrame, gross) -> DataFrame:
    mfe, mae, now = X.net_return(F.col("mfe_gross")), X.net_return(F.col("mae_gross")), X.net_return(gross)
    return df.withColumns({
        "mfe_gross_return_pct": 100 * F.col("mfe_gross"), "mae_gross_return_pct": 100 * F.col("mae_gross"),
        "mfe_net_return_pct": 100 * mfe, "mae_net_return_pct": 100 * mae, "mfe_pnl_usd": F.col("notional_usd") * mfe, "mae_pnl_usd": F.col("notional_usd") * mae,
        "giveback_net_return_pct": 100 * (mfe - now), "giveback_pnl_usd": F.col("notional_usd") * (mfe - now),
    })


def position_metrics(excursions: DataFrame) -> DataFrame:
    """Adds progress towards the horizon, the unrealized return, and the excursions net of fees."""
    steps, elapsed = X.horizon_steps(F.col("horizon")), F.col("bars_elapsed")
    gross = X.gross_return(F.col("side"), F.col("entry_price"), F.col("mark_price"))
    df = excursions.withColumns({
        "bars_remaining": F.greatest(F.lit(0), steps - elapsed), "progress_pct": F.least(F.lit(100.0), 100.0 * elapsed / steps), "at_target_horizon": elapsed >= steps,
        "gross_return_pct": 100 * gross, "unrealized_net_return_pct": 100 * X.net_return(gross), "unrealized_pnl_usd": F.col("notional_usd") * X.net_return(gross),
    })
    return _display(df, gross)


def close_positions(excursions: DataFrame, exits: DataFrame) -> DataFrame:
    """Closed trades: positions joined with exits (position_id, exit_price), after a last update of the excursions with the exit price."""
    rows = excursions.join(exits, "position_id")
    gross = X.gross_return(F.col("side"), F.col("entry_price"), F.col("exit_price"))
    better, worse = gross >= F.col("mfe_gross"), gross <= F.col("mae_gross")
    rows = rows.withColumns({
        "mfe_mark_price": F.when(better, F.col("exit_price")).otherwise(F.col("mfe_mark_price")), "mae_mark_price": F.when(worse, F.col("exit_price")).otherwise(F.col("mae_mark_price")),
        "mfe_gross": F.greatest("mfe_gross", gross), "mae_gross": F.least("mae_gross", gross), "gross_return_pct": 100 * gross,
        "net_return_pct": 100 * X.net_return(gross, True), "realized_pnl_usd": F.col("notional_usd") * X.net_return(gross, True),
    })
    return _display(rows, gross)


def journal_summary(closed: DataFrame, order: str = "exit_index", limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """The sum of realized PnL and the number of trades; the last closed ones, newest first."""
    return closed.agg(F.sum("realized_pnl_usd").alias("realized_pnl_usd"), F.count("*").alias("n_trades")), closed.orderBy(F.desc(order), F.desc("position_id")).limit(limit)
