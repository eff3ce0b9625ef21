"""Stateful operators of unbounded inputs that Spark has no built-in for."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DoubleType, StructField, StructType

from sluice.session import ship



#: Aggregates of a buffer, given its values from the oldest to the present one. Nulls are skipped but by LAG, FIRST, LAST, NTH and COUNT_ALL.
def _mean(v: list) -> float | None:
    return sum(v) / len(v) if v else None


def _variance(v: list, less: int) -> float | None:
    m = _mean(v)
    return None if len(v) <= less else sum((x - m) ** 2 for x in v) / (len(v) - less)


def _root(x: float | None) -> float | None:
    return None if x is None else math.sqrt(x)


def _present(f: Callable[[list], object]) -> Callable[[list, int], object]:
    return lambda v, _: f([x for x in v if x is not None])


FUNCTIONS: dict[str, Callable[[list, int], object]] = {
    "lag": lambda v, k: v[-1 - k] if len(v) > k else None,
    "first": lambda v, _: v[0],
    "last": lambda v, _: v[-1],
    "nth": lambda v, k: v[k - 1] if len(v) >= k else None,
    "count_all": lambda v, _: float(len(v)),
    "count": _present(lambda v: float(len(v))),
    "sum": _present(lambda v: sum(v) if v else None),
    "avg": _present(_mean),
    "min": _present(lambda v: min(v, default=None)),
    "max": _present(lambda v: max(v, default=None)),
    "var_samp": _present(lambda v: _variance(v, 1)),
    "var_pop": _present(lambda v: _variance(v, 0)),
    "stddev_samp": _present(lambda v: _root(_variance(v, 1))),
    "stddev_pop": _present(lambda v: _root(_variance(v, 0))),
    "rank": lambda v, _: float(1 + sum(x is not None and v[-1] is not None and x < v[-1] for x in v)),
    "dense_rank": lambda v, _: float(1 + len({x for x in v if x is not None and v[-1] is not None and x < v[-1]})),
}
#: Output names and the functions that `row_buffer` gives unless others are asked for.
USUAL = {"lag_value": ("lag", 1), "avg_value": ("avg", 0), "min_value": ("min", 0), "max_value": ("max", 0), "n_rows": ("count_all", 0)}


#: What is held of a key: the buffered values and, if gaps count, their order (seconds if it is a time).
HELD = "v array<double>, at array<double>"


def _seconds(order: pd.Series) -> list[float]:
    since = (order - pd.Timestamp(0, tz=order.dt.tz)).dt.total_seconds() if hasattr(order, "dt") else order.astype(float)
    return since.tolist()


def _buffered(order: str, value: str, size: int, wanted: Mapping[str, tuple[str, int]], quiet: float | None, full_only: bool) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The last `size` rows of a key; each row gives the aggregates over the buffer that it ends. With `quiet` seconds, a
    buffer starts anew after a gap in the order column that is longer; with `full_only`, rows come once the buffer is full."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        parts = list(rows)
        batch = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        if not batch[order].is_monotonic_increasing:
            batch = batch.sort_values(order, kind="stable", ignore_index=True)
        at = [None] * len(batch) if quiet is None else _seconds(batch[order])
        out, keep = [], []
        for v, when in zip(batch[value].tolist(), at, strict=True):
            if quiet is not None and held and when - held[-1][1] > quiet:
                held = []
            held = [*held, (None if v is None or v != v else float(v), when)][-size:]
            values = [x for x, _ in held]
            keep.append(not full_only or len(held) == size)
            out.append([FUNCTIONS[f](values, k) for f, k in wanted.values()])
        state.update(([v for v, _ in held], [when for _, when in held]))
        both = pd.concat([batch, pd.DataFrame(np.array(out, dtype="float64"), index=batch.index, columns=list(wanted))], axis=1)
        yield both if all(keep) else both[keep]

    return step


def row_buffer(df: DataFrame, keys: Sequence[str], order: str, value: str, size: int, wanted: Mapping[str, tuple[str, int]] = USUAL, quiet: float | None = None, full_only: bool = False) -> DataFrame:
    """Aggregates of a value over the last `size` rows of each key, for a stream: `wanted` has (function, argument) by output
    name, see FUNCTIONS. Rows of a micro-batch are taken in `order`; those of an earlier batch come before. Any state store will
    do, and the session's settings stay as they are (`transformWithStateInPandas` needs RocksDB, and its process on the driver
    doesn't find shipped code)."""
    unknown = [f for f, _ in wanted.values() if f not in FUNCTIONS]
    if unknown:
        raise ValueError(f"unknown functions {unknown}")
    ship(df.sparkSession)
    fields = StructType([*df.schema.fields, *[StructField(name, DoubleType()) for name in wanted]])
    step = _buffered(order, value, size, dict(wanted), quiet, full_only)
    return df.groupBy(*keys).applyInPandasWithState(step, fields, HELD, "append", GroupStateTimeout.NoTimeout)


#: Parts of a keyed table, by a hash of the key.
BUCKETS = 64


def keyed_table(changes: DataFrame, path: str, keys: Sequence[str], order: str, checkpoint: str, once: bool = True):
    """A table kept by key: the row of the latest `order` counts, in whatever order rows come. The table lies in BUCKETS parts; a
    micro-batch writes only the parts that it touches, as version v<number>, and `read_keyed` takes the latest version of each, so
    that a batch that is run again does no harm. Versions that are no longer the latest of any part are deleted two batches later."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
        row = F.struct(*batch.columns)
        last = batch.groupBy(*keys).agg(F.max_by(row, F.col(order)).alias("r")).select("r.*").withColumn("_part", part)
        touched = sorted(r[0] for r in last.select("_part").distinct().collect())  # BUCKETS at most
        old = [f for p, f in versions(spark, path, number).items() if p in touched]
        both = last.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumn("_part", part)) if old else last
        merged = both.groupBy("_part", *keys).agg(F.max_by(row, F.col(order)).alias("r")).select("_part", "r.*")
        merged.write.mode("overwrite").partitionBy("_part").parquet(f"{path}/v{number}")
        latest = {f.rsplit("/", 2)[1] for f in versions(spark, path, number - 1).values()}
        fs, root = _files(spark, path)
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("v") and int(name[1:]) < number - 1 and name not in latest:
                fs.delete(status.getPath(), True)

    writer = changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _files(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def versions(spark: SparkSession, path: str, below: int | None = None) -> dict[int, str]:
    """The folder of each part's latest complete version before `below`."""
    fs, root = _files(spark, path)
    found: dict[int, tuple[int, str]] = {}
    for status in fs.listStatus(root) if fs.exists(root) else []:
        name = status.getPath().getName()
        done = name.startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
        if not done or below is not None and int(name[1:]) >= below:
            continue
        for part in fs.listStatus(status.getPath()):
            if part.getPath().getName().startswith("_part="):
                number = int(part.getPath().getName().removeprefix("_part="))
                if found.get(number, (-1, ""))[0] < int(name[1:]):
                    found[number] = (int(name[1:]), part.getPath().toString())
    return {k: f for k, (_, f) in found.items()}


def read_keyed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The present rows of a table that `keyed_table` keeps."""
    parts = list(versions(spark, path).values())
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def split_late(batch: DataFrame, ts: str, newest: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of a micro-batch at or after a time, and the late ones for a dead-letter sink."""
    late = F.col(ts) < newest
    return batch.where(~late), batch.where(late)
