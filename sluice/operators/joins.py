"""Joins beyond the built-in ones: with tables and policies, within time, and by windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A lookup table is broadcast only if its optimiser estimate is at most this; else Spark shuffles both sides.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the optimiser's estimate of a table's bytes is within the limit."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def stream_table(stream: DataFrame, table: DataFrame, keys: Sequence[str], missing: str = "nulls", defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Lookup of each row in a table. `missing` tells what a row without a match becomes: `nulls`, `skip`, `defaults` or `fail`."""
    table = F.broadcast(table) if small(table) else table
    if missing == "skip":
        return stream.join(table, list(keys), "inner")
    out = stream.join(table.withColumn("_hit", F.lit(True)), list(keys), "left")
    added = [c for c in table.columns if c not in keys]
    if missing == "fail" and not added:
        found = F.when(F.col("_hit"), F.col(keys[0])).otherwise(F.raise_error(F.lit("a row has no match in the table")))
        return out.withColumn(keys[0], found).drop("_hit")
    if missing == "defaults":
        for name, value in (defaults or {}).items():
            out = out.withColumn(name, F.when(F.col("_hit"), F.col(name)).otherwise(F.lit(value)))
    elif missing == "fail":
        for name in added:
            out = out.withColumn(name, F.when(F.col("_hit"), F.col(name)).otherwise(F.raise_error(F.lit("a row has no match in the table"))))
    elif missing != "nulls":
        raise ValueError(f"unknown policy {missing}")
    return out.drop("_hit")


def interval_join(left: DataFrame, right: DataFrame, keys: Column, left_ts: str, right_ts: str, lower: str, upper: str, how: str = "inner") -> DataFrame:
    """Pairs whose right time is within [left + lower, left + upper]; `keys` must hold an equality, by which both sides are dealt."""
    lo, hi = F.expr(f"{left_ts} + INTERVAL {lower}"), F.expr(f"{left_ts} + INTERVAL {upper}")
    return left.join(right, keys & F.col(right_ts).between(lo, hi), how)


def within(left: DataFrame, right: DataFrame, keys: Column, left_ts: str, right_ts: str, span: str, how: str = "inner") -> DataFrame:
    """Pairs at most `span` apart."""
    lo, hi = F.expr(f"{left_ts} - INTERVAL {span}"), F.expr(f"{left_ts} + INTERVAL {span}")
    return left.join(right, keys & F.col(right_ts).between(lo, hi), how)


def _windowed(side: DataFrame, ts: str, *window: str) -> DataFrame:
    """A side with its windows. In a stream the window takes over as the event time, of which there may be only one."""
    out = side.withColumn("window", F.window(ts, *window))
    return out.withColumn(ts, F.expr(f"`{ts}` + INTERVAL 0 SECOND")) if side.isStreaming else out


def tumbling_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, size: str, how: str = "inner") -> DataFrame:
    """Pairs of equal keys in the same window."""
    return _windowed(left, left_ts, size).join(_windowed(right, right_ts, size), ["window", *keys], how)


def sliding_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, size: str, advance: str, how: str = "inner") -> DataFrame:
    """Pairs of equal keys, once for each window that both are in."""
    return _windowed(left, left_ts, size, advance).join(_windowed(right, right_ts, size, advance), ["window", *keys], how)


def session_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, gap: str, how: str = "inner") -> DataFrame:
    """Pairs of equal keys in the same session of both sides together; sessions part where nothing came for longer than the gap.
    A session is named by its start."""
    marks = left.select(*keys, F.col(left_ts).alias("_ts")).union(right.select(*keys, F.col(right_ts).alias("_ts"))).distinct()
    w = W.partitionBy(*keys).orderBy("_ts")
    fresh = F.coalesce(F.col("_ts") > F.lag("_ts").over(w) + F.expr(f"INTERVAL {gap}"), F.lit(True))
    starts = marks.withColumn("_new", F.when(fresh, F.col("_ts")))
    named = starts.withColumn("session_start", F.max("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    sided = [side.withColumn("_ts", F.col(ts)).join(named, [*keys, "_ts"]).drop("_ts") for side, ts in ((left, left_ts), (right, right_ts))]
    return sided[0].join(sided[1], [*keys, "session_start"], how)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, values: Sequence[str]) -> DataFrame:
    """The latest right row at or before each left row, by one sort of both sides together instead of a range join."""
    l = left.select(*keys, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"))
    r = right.select(*keys, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_v"))
    w = W.partitionBy(*keys).orderBy("_ts", "_side").rowsBetween(W.unboundedPreceding, 0)
    both = l.union(r).withColumn("_v", F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").select("_row.*", *[F.col("_v")[v].alias(v) for v in values])
