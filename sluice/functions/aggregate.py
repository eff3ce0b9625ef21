"""Aggregate functions of the dialect. Those that depend on order take the order explicitly, as a set has none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_value(col: Column, order: Column) -> Column:
    """The value of the earliest row, also if it is null."""
    return F.min_by(F.struct(col.alias("v")), order)["v"]


def last_value(col: Column, order: Column) -> Column:
    return F.max_by(F.struct(col.alias("v")), order)["v"]


def listagg(col: Column, order: Column, sep: str = ",") -> Column:
    """Texts in order; nulls are skipped; an empty group gives null."""
    pairs = F.array_sort(F.collect_list(F.when(col.isNotNull(), F.struct(order.alias("o"), col.cast("string").alias("v")))))
    return F.when(F.size(pairs) > 0, F.array_join(F.transform(pairs, lambda p: p["v"]), sep))


AGGREGATES = {
    "COUNT": lambda c=None: F.count("*" if c is None else c),
    "SUM": F.sum,
    "AVG": F.avg,
    "MIN": F.min,
    "MAX": F.max,
    "APPROX_COUNT_DISTINCT": F.approx_count_distinct,
    "COUNT_DISTINCT": F.countDistinct,
    "FIRST_VALUE": first_value,
    "LAST_VALUE": last_value,
    "LISTAGG": listagg,
    "STRING_AGG": listagg,
    "MEDIAN": F.median,
    "DELTA": lambda c: F.max(c) - F.min(c),
    "STDDEV": F.stddev_samp,
    "STDDEV_POP": F.stddev_pop,
    "VARIANCE": F.var_samp,
    "VAR_POP": F.var_pop,
    "PERCENTILE_CONT": lambda c, p: F.percentile(c, p),
    "PERCENTILE_DISC": lambda c, p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c if isinstance(c, str) else c._jc.toString()})"),
    "CORR": F.corr,
    "COVAR_POP": F.covar_pop,
    "COVAR_SAMP": F.covar_samp,
    "REGR_SLOPE": F.regr_slope,
    "REGR_INTERCEPT": F.regr_intercept,
    "REGR_R2": F.regr_r2,
}

ALIASES = {"FIRST": "FIRST_VALUE", "LAST": "LAST_VALUE", "COLLECT": "LISTAGG", "GROUP_CONCAT": "STRING_AGG", "STDDEV_SAMP": "STDDEV", "VAR_SAMP": "VARIANCE"}


def aggregate(name: str, *args: object) -> Column:
    """An aggregate by name, in any case."""
    key = ALIASES.get(name.upper(), name.upper())
    if key not in AGGREGATES:
        raise KeyError(f"no aggregate {name}")
    return AGGREGATES[key](*args)
