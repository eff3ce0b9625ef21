"""Metrics that annotations of a query ask for, observed while the query runs.

`-- @metric: name`, with `@metric_type` (counter, gauge or histogram), `@metric_field` and `@metric_condition`, each once; or several at once as
`-- @metric_<name>: type field [WHERE condition]`. Streams report them in `lastProgress["observedMetrics"]`, bounded queries by
an Observation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Shares of a histogram's values.
SHARES = (0.5, 0.9, 0.99)


@dataclass(frozen=True)
class Metric:
    name: str
    kind: str = "counter"
    field: str | None = None
    condition: str | None = None

    def column(self) -> Column:
        """The metric as an aggregate: how many rows, the greatest value, or count, sum and shares of the values."""
        when = F.expr(self.condition) if self.condition else F.lit(True)
        value = F.when(when, F.col(self.field)) if self.field else F.when(when, F.lit(1))
        if self.kind == "counter":
            return F.count(F.when(when, F.lit(1))).alias(self.name)
        if self.kind == "gauge":
            return F.max(value).alias(self.name)
        if self.kind == "histogram":
            shares = F.percentile_approx(value, list(SHARES))
            return F.struct(F.count(value).alias("n"), F.sum(value).alias("sum"), shares.alias("shares")).alias(self.name)
        raise ValueError(f"unknown metric type {self.kind}")


def declared(notes: dict[str, str]) -> list[Metric]:
    found = []
    if "metric" in notes:
        found.append(Metric(notes["metric"], notes.get("metric_type", "counter"), notes.get("metric_field"), notes.get("metric_condition")))
    for name, text in notes.items():
        if name.startswith("metric_") and name not in ("metric_type", "metric_field", "metric_condition"):
            m = re.fullmatch(r"(\w+)(?:\s+(?!WHERE\b)(\w+))?(?:\s+WHERE\s+(.*))?", text.strip(), re.I)
            if not m:
                raise ValueError(f"not a metric: {text}")
            found.append(Metric(name.removeprefix("metric_"), m[1].lower(), m[2], m[3]))
    return found


def observed(df: DataFrame, notes: dict[str, str]) -> DataFrame:
    """The query with its metrics; a bounded one has them in `df.sluice_metrics.get` once it ran."""
    columns = [m.column() for m in declared(notes)]
    if not columns:
        return df
    if df.isStreaming:
        return df.observe("metrics", *columns)
    watch = Observation("metrics")
    out = df.observe(watch, *columns)
    out.sluice_metrics = watch
    return out
