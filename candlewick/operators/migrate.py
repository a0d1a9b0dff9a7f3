"""Upserts, merges and differences of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], *order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row")


def new_rows(rows: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each key that the target doesn't have; of equal keys the least row by its other columns."""
    others = [c for c in rows.columns if c not in keys] or list(keys)
    return first_per_key(rows.join(target.select(*keys), list(keys), "left_anti"), keys, *others)


def upsert(rows: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target with the rows of new keys; rows of known keys do nothing."""
    return target.unionByName(new_rows(rows, target, keys))


def upsert_report(rows: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows parsed, inserted, and left out as duplicates."""
    distinct = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    known = target.select(*keys).distinct().withColumn("_known", F.lit(True))
    both = distinct.join(known, list(keys), "left")
    inserted = F.count_if(F.col("_known").isNull())
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("parsed"), inserted.alias("inserted"), (F.coalesce(F.sum("n"), F.lit(0)) - inserted).alias("duplicates"))


def replace(rows: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target with rows: those of known keys take the place of the old ones."""
    both = target.withColumn("_age", F.lit(1)).unionByName(rows.withColumn("_age", F.lit(0)))
    return first_per_key(both, keys, "_age").drop("_age")


def merge_candles(old: DataFrame, new: DataFrame, key: str = "start_trade_id") -> DataFrame:
    """Updates known ids with new values that aren't null and adds ids above the largest old one; other new ids are dropped."""
    values = [c for c in old.columns if c not in ("symbol", key)]
    renamed = new.select("symbol", key, *(F.col(c).alias(f"_{c}") for c in values))
    kept = old.join(renamed, ["symbol", key], "left").select("symbol", key, *(F.coalesce(f"_{c}", c).alias(c) for c in values))
    most = old.groupBy("symbol").agg(F.max(key).alias("_most"))
    added = new.join(most, "symbol", "left").where(F.col("_most").isNull() | (F.col(key) > F.col("_most"))).select("symbol", key, *values)
    return kept.unionByName(added)


def missing(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the source that the target lacks."""
    return source.select(*keys).distinct().join(target.select(*keys), list(keys), "left_anti")


def symbol_dimension(df: DataFrame, names: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """df with symbol_id, and the number of rows of each unknown symbol. The names are a bounded dimension."""
    dim = F.broadcast(df.sparkSession.createDataFrame(list(names.items()), "symbol string, symbol_id int"))
    return df.join(dim, "symbol"), df.join(dim, "symbol", "left_anti").groupBy("symbol").agg(F.count("*").alias("n"))
