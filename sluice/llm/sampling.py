"""Bounded, repeatable samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds; of a null key it is that of the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds


def labelled_sample(rows: DataFrame, key: str, label: str, text: str, most_rows: int, most_chars: int) -> list[Row]:
    """Rows (label, text) of each label, chosen by a hash of key and text: `most_rows` at most, and `most_chars`
    characters or one text. All rows are candidates. Labels must be few; null labels and texts are left out."""
    rows = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(label).agg(F.count("*").alias("n")).collect()
    if not counts:
        return []
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col(label) == F.lit(r[0]), min(1.0, 2.0 * most_rows / r.n)).otherwise(share)
    place = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), 12) / float(1 << 52)
    some = rows.withColumn("_place", place).where(F.col("_place") < share).select(label, text, "_place")
    order = W.partitionBy(label).orderBy("_place", F.xxhash64(text))
    some = some.select(label, text, "_place", F.row_number().over(order).alias("_n"), F.sum(F.length(text)).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("_chars"))
    some = some.where((F.col("_n") == 1) | (F.col("_n") <= most_rows) & (F.col("_chars") <= most_chars))
    return some.orderBy(label, "_n").select(label, text).collect()
