"""Subquery, set and data-change operators over DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exists(df: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    return df.join(other, on, "left_semi")


def not_exists(df: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    return df.join(other, on, "left_anti")


def in_query(df: DataFrame, col: str, other: DataFrame, of: str) -> DataFrame:
    return df.join(other.select(F.col(of).alias("_in")), F.col(col) == F.col("_in"), "left_semi")


def not_in_query(df: DataFrame, col: str, other: DataFrame, of: str) -> DataFrame:
    """A null in the other column takes nothing out; a null in `col` is dropped."""
    return df.where(F.col(col).isNotNull()).join(other.select(F.col(of).alias("_in")), F.col(col) == F.col("_in"), "left_anti")


def with_scalar(df: DataFrame, other: DataFrame, value: Column, name: str) -> DataFrame:
    """A column with one aggregate of another table: its single row is broadcast."""
    return df.crossJoin(F.broadcast(other.agg(value.alias(name))))


def _compared(df: DataFrame, col: str, op: str, other: DataFrame, of: str, largest: bool) -> DataFrame:
    """`df` with _holds (col against the extreme of the other column), _n (rows) and _nulls (null ones of them)."""
    ends = other.agg((F.max(of) if largest else F.min(of)).alias("_end"), F.count("*").alias("_n"), (F.count("*") - F.count(of)).alias("_nulls"))
    return df.crossJoin(F.broadcast(ends)).withColumn("_holds", F.expr(f"`{col}` {op} _end"))  # one row


def compare_all(df: DataFrame, col: str, op: str, other: DataFrame, of: str) -> DataFrame:
    """Rows for which `col op v` holds with every v; of none it holds, with a null it is unknown. op is one of > >= < <=."""
    met = _compared(df, col, op, other, of, op[0] == ">")
    return met.where((F.col("_n") == 0) | (F.col("_nulls") == 0) & F.col("_holds")).drop("_end", "_n", "_nulls", "_holds")


def compare_any(df: DataFrame, col: str, op: str, other: DataFrame, of: str) -> DataFrame:
    """Rows for which `col op v` holds with some v."""
    met = _compared(df, col, op, other, of, op[0] == "<")
    return met.where("_holds").drop("_end", "_n", "_nulls", "_holds")


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with rows of equal keys replaced by those of `changes`."""
    return table.join(changes.select(*keys), list(keys), "left_anti").unionByName(changes.select(*table.columns))


def update(table: DataFrame, assign: Mapping[str, Column], where: Column) -> DataFrame:
    """Columns set where the condition holds; all see the old values."""
    return table.select(*[F.when(where, assign[c]).otherwise(F.col(c)).alias(c) if c in assign else F.col(c) for c in table.columns])


def delete(table: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition isn't true; an unknown one keeps the row."""
    return table.where(~F.coalesce(where, F.lit(False)))


def tombstones(table: DataFrame, keys: Sequence[str], where: Column) -> DataFrame:
    """Rows to delete, as keys with nulls elsewhere."""
    return table.where(where).select(*[F.col(c) if c in keys else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns])
