"""The table surface: lookups by key, filters, scalars, wildcard paths over nested values, and loads in order of dependence."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

_PATH = re.compile(r"(\*\*|\*|\w+)((?:\[(?:\*|\d+)\])*)")


def _steps(path: str) -> list[str]:
    """`a.*.b[0]` as a, *, b, [0]."""
    found = []
    for part in path.split("."):
        m = _PATH.fullmatch(part)
        if not m:
            raise ValueError(f"not a path: {path}")
        found += [m[1], *re.findall(r"\[(?:\*|\d+)\]", m[2])]
    return found


def _values(kind: DataType, at: Column, steps: Sequence[str]) -> list[Column]:
    """Arrays of text that the steps lead to. The schema tells all ways, so that no row is walked one by one."""
    if not steps:
        return [F.array(F.to_json(at) if isinstance(kind, StructType | MapType | ArrayType) else at.cast("string"))]
    step, rest = steps[0], steps[1:]
    inner = isinstance(kind, ArrayType) and step.startswith("[")
    if inner and step != "[*]":
        return _values(kind.elementType, F.get(at, int(step[1:-1])), rest)
    if inner or isinstance(kind, MapType) and step == "*":
        each, of = (at, kind.elementType) if inner else (F.map_values(at), kind.valueType)

        def all_of(x: Column) -> Column:
            found = _values(of, x, rest)
            return F.concat(*found) if found else F.array().cast("array<string>")

        return [F.flatten(F.transform(each, all_of))] if _values(of, F.lit(None), rest) else []
    if isinstance(kind, MapType):
        deeper = _values(kind, at, ["*", *steps]) if step == "**" else []
        return deeper + (_values(kind.valueType, at[step], rest) if step != "**" else [])
    if isinstance(kind, ArrayType):
        return _values(kind, at, ["[*]", *steps]) if step == "**" else []
    if not isinstance(kind, StructType):
        return []
    if step == "**":  # here, or below any field
        here = _values(kind, at, rest) if rest else []
        return here + [v for f in kind.fields for v in _values(f.dataType, at[f.name], steps)]
    return [v for f in kind.fields if step in ("*", f.name) for v in _values(f.dataType, at[f.name], rest)]


def wildcard(df: DataFrame, path: str) -> Column:
    """All values of a path as an array of text, nulls left out: `*` is any field or map key, `**` any depth, `arr[*]` and `arr[n]` elements."""
    steps, found = _steps(path), []
    for f in df.schema.fields:
        if steps[0] == "**":
            found += _values(f.dataType, F.col(f.name), steps) + (_values(f.dataType, F.col(f.name), steps[2:]) if steps[1:2] == [f.name] else [])
        elif steps[0] in ("*", f.name):
            found += _values(f.dataType, F.col(f.name), steps[1:])
    found = [F.coalesce(v, F.array().cast("array<string>")) for v in found]
    return F.array_compact(F.concat(*found)) if found else F.array().cast("array<string>")


class Table:
    """A keyed table. Its rows stay distributed; only what a call asks for comes to the driver."""

    def __init__(self, df: DataFrame, keys: Sequence[str]):
        self.df, self.keys = df, list(keys)

    def _of(self, key: object) -> DataFrame:
        values = key if isinstance(key, tuple) else (key,)
        where = F.lit(True)
        for name, value in zip(self.keys, values, strict=True):
            where = where & F.col(name).eqNullSafe(F.lit(value))
        return self.df.where(where)

    def get(self, key: object) -> Row | None:
        return self._of(key).first()

    def contains(self, key: object) -> bool:
        return not self._of(key).isEmpty()

    def count(self, where: str = "true") -> int:
        return self.df.where(where).count()

    def bulk(self, wanted: DataFrame) -> DataFrame:
        """Rows of many keys at once, as a semi join."""
        return self.df.join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")

    def filter(self, where: str) -> DataFrame:
        return self.df.where(where)

    def exists(self, where: str) -> bool:
        return not self.df.where(where).isEmpty()

    def column_values(self, column: str, where: str = "true") -> DataFrame:
        return self.df.where(where).select(column)

    def scalar(self, expression: str, where: str = "true") -> object:
        """One aggregate, or the value of the only row."""
        rows = self.df.where(where).selectExpr(f"{expression} AS v").take(2)
        if len(rows) > 1:
            raise ValueError("more than one row")
        return rows[0][0] if rows else None

    def wildcard(self, path: str, where: str | None = None) -> DataFrame:
        """Keys and values of a path; `where` compares the value, as in `> 100`."""
        found = self.df.select(*self.keys, F.explode(wildcard(self.df, path)).alias("value"))
        if where is None:
            return found
        op, bound = re.fullmatch(r"\s*(<=|>=|<>|!=|=|<|>)\s*(.+?)\s*", where).groups()
        value = "value" if bound.startswith("'") else "try_cast(value AS double)"
        return found.where(f"{value} {op} {bound}")

    def wildcard_aggregate(self, function: str, path: str) -> object:
        """COUNT, SUM, AVG, MIN or MAX of the values of a path."""
        made = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[function.upper()]
        value = F.col("value") if function.upper() == "COUNT" else F.expr("try_cast(value AS double)")
        return self.wildcard(path).agg(made(value)).first()[0]

    def stream_all(self) -> Iterator[Row]:
        """Rows one by one, a partition at a time."""
        return self.df.toLocalIterator()

    def stream_filter(self, where: str) -> Iterator[Row]:
        return self.df.where(where).toLocalIterator()

    def batch(self, size: int, offset: int = 0) -> DataFrame:
        """A page of rows in the order of the keys."""
        return self.df.orderBy(*self.keys).offset(offset).limit(size)

    def aggregate(self, *columns: Column) -> Row:
        return self.df.agg(*columns).first()


def waves(needs: Mapping[str, Iterable[str]]) -> list[list[str]]:
    """Names in waves, each after all that it needs; what isn't listed itself is there already."""
    left = {n: {m for m in of if m in needs} for n, of in needs.items()}
    found = []
    while left:
        ready = sorted(n for n, of in left.items() if not of)
        if not ready:
            raise ValueError(f"{', '.join(sorted(left))} need each other")
        found.append(ready)
        left = {n: of.difference(ready) for n, of in left.items() if n not in ready}
    return found


def load_in_waves(needs: Mapping[str, Iterable[str]], load: Callable[[str], object], at_once: int = 4) -> dict[str, object]:
    """Loads tables, those of a wave side by side."""
    found: dict[str, object] = {}
    with ThreadPoolExecutor(at_once) as pool:
        for wave in waves(needs):
            found |= dict(zip(wave, pool.map(load, wave), strict=True))
    return found


def routed(df: DataFrame, strategy: str, keys: Sequence[str] = (), n: int | None = None) -> DataFrame:
    """Rows dealt as asked: `hash` by keys, `round_robin`, `fan_in` to one partition, `sticky` as they come, `smart` by keys
    unless the plan deals them so already."""
    if strategy == "sticky":
        return df
    if strategy == "fan_in":
        return df.coalesce(1)
    if strategy == "round_robin":
        return df.repartition(n or df.sparkSession.sparkContext.defaultParallelism)
    if strategy in ("hash", "smart"):
        top = re.sub(r"#\d+L?", "", df._jdf.queryExecution().optimizedPlan().toString().splitlines()[0])
        if strategy == "smart" and top.startswith(f"RepartitionByExpression [{', '.join(keys)}]"):
            return df
        return df.repartition(*([n] if n else []), *keys)
    raise ValueError(f"unknown strategy {strategy}")
