"""Time windows and row buffers, for bounded and unbounded inputs alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _keys(keys: Sequence[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def _bounds(df: DataFrame) -> DataFrame:
    return df.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in df.columns if c != "_w"])


def tumbling(df: DataFrame, ts: str, size: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Half-open windows aligned to the epoch."""
    return _bounds(df.groupBy(F.window(ts, size).alias("_w"), *_keys(keys)).agg(*aggs))


def sliding(df: DataFrame, ts: str, size: str, advance: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Windows of `size` that start every `advance`; a row is in each window that covers it."""
    return _bounds(df.groupBy(F.window(ts, size, advance).alias("_w"), *_keys(keys)).agg(*aggs))


def session(df: DataFrame, ts: str, gap: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Windows that end when nothing came for longer than `gap`; the end is the last time plus the gap."""
    return _bounds(df.groupBy(F.session_window(ts, gap).alias("_w"), *_keys(keys)).agg(*aggs))


def row_buffer(partition: Sequence[str], order: Sequence[str], size: int):
    """The frame of a buffer that holds the last `size` rows of a partition, the present one included."""
    return W.partitionBy(*partition).orderBy(*order).rowsBetween(-(size - 1), 0)


def buffer_full(df: DataFrame, partition: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Rows at which the buffer is full."""
    n = F.row_number().over(W.partitionBy(*partition).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n") >= size).drop("_n")


def expiring(df: DataFrame, partition: Sequence[str], ts: str, limit: str, island: str = "_island") -> DataFrame:
    """A column that grows whenever a partition was quiet for longer than `limit`: partition a buffer by it as well."""
    w = W.partitionBy(*partition).orderBy(ts)
    quiet = F.col(ts) > F.lag(ts).over(w) + F.expr(f"INTERVAL {limit}")
    return df.withColumn(island, F.sum(F.coalesce(quiet, F.lit(False)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
