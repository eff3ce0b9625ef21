"""A catalogue of streams, tables and jobs, and the statements of the dialect over it."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.aggregate import AGGREGATES
from sluice.functions.scalar import SCALARS
from sluice.operators import relations
from sluice.plans import metrics
from sluice.plans.dialect import DialectError, Query, annotations, bound, tokens, translate
from sluice.sources import adapters, config


def resolve_env(text: str, env: dict[str, str] | None = None) -> str:
    """`${NAME:default}` and `${NAME}` from the environment; a name without value or default raises KeyError."""
    env = dict(os.environ) if env is None else env

    def value(m: re.Match) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[2] is None:
            raise KeyError(m[1])
        return m[2]

    return re.sub(r"\$\{(\w+)(?::([^}]*))?\}", value, text)


def bindings(options: dict[str, str]) -> tuple[dict[str, dict[str, str]], dict[str, dict[str, str]]]:
    """Sources and sinks by name in the options of WITH: `name.type` ends with _source or _sink, or the name is `sink`. Options
    of a `name.config_file` come first, with those of the files that it extends before."""
    groups: dict[str, dict[str, str]] = {}
    for key, value in options.items():
        name, dot, option = key.partition(".")
        if dot:
            groups.setdefault(name, {})[option] = value
    for name, own in groups.items():
        if "config_file" in own:
            groups[name] = config.load(own.pop("config_file")) | own
    sinks = {n: o for n, o in groups.items() if "type" in o and (o["type"].endswith("_sink") or n == "sink")}
    return {n: o for n, o in groups.items() if "type" in o and n not in sinks}, sinks


def statements(text: str) -> list[str]:
    """The statements of a text, parted by semicolons outside of quotes and notes."""
    found, start = [], 0
    for m in re.finditer(r"'(?:[^']|'')*'|--[^\n]*|;", text):
        if m.group() == ";":
            found.append(text[start : m.start()])
            start = m.end()
    return [t.strip() for t in [*found, text[start:]] if tokens(t)]


@dataclass
class Job:
    name: str
    text: str
    status: str = "running"
    version: str = "1"
    query: object = None
    history: list[tuple[str, str]] = field(default_factory=list)


class Engine:
    def __init__(self, spark: SparkSession, time: str = "_timestamp"):
        self.spark, self.time = spark, time
        self.streams: dict[str, DataFrame] = {}
        self.tables: dict[str, DataFrame] = {}
        self.keys: dict[str, list[str]] = {}
        self.jobs: dict[str, Job] = {}
        self.notes: dict[str, str] = {}
        #: Watermark delays of streams.
        self.delays: dict[str, str] = {}

    # catalogue

    def register(self, name: str, df: DataFrame, table: bool = False, keys: list[str] | None = None, watermark: str | None = None) -> None:
        (self.tables if table else self.streams)[name] = df
        if watermark:
            self.delays[name] = watermark
        if keys:
            self.keys[name] = keys
        df.createOrReplaceTempView(name)

    def unregister(self, name: str) -> None:
        self.streams.pop(name, None)
        self.tables.pop(name, None)
        self.spark.catalog.dropTempView(name)

    def register_function(self, name: str, function: Callable, returns: object = None) -> None:
        """A scalar, grouped (pandas) or table function for queries. Its code goes to workers with the session's."""
        if returns is None and hasattr(function, "_name") and function.__class__.__name__ == "UserDefinedTableFunction":
            self.spark.udtf.register(name, function)
        else:
            self.spark.udf.register(name, function, returns) if returns is not None else self.spark.udf.register(name, function)

    def run_file(self, path: str) -> list[DataFrame]:
        """Runs the statements of a file, which end with semicolons, in order."""
        with open(path) as f:
            return [self.sql(t) for t in statements(f.read())]

    def explain(self, text: str) -> str:
        """The Spark SQL of a statement and its plan."""
        query = translate(text, self.time)
        return f"{query.sql}\n{self.spark.sql(query.sql)._jdf.queryExecution().toString()}"

    # statements

    def sql(self, text: str, params: Sequence[object] = ()) -> DataFrame:
        """Runs one statement; those that change the catalogue give a one-row result. `$1` and so on stand for parameters."""
        self.notes = annotations(text)
        text = re.sub(r"\A(?:\s*--[^\n]*(?:\n|\Z))+", "", bound(resolve_env(text).strip().rstrip(";"), params)).strip()
        words = [t.upper() for t in tokens(text)[:4]]
        if not words:
            raise DialectError("no statement")
        head = words[0]
        if head in ("SELECT", "WITH"):
            return self.select(text)
        if head == "CREATE":
            return self._create(text)
        if head == "INSERT":
            return self._insert(text)
        if head in ("UPDATE", "DELETE"):
            return self._change(text)
        if head in ("SHOW", "LIST"):
            return self._show(text)
        if head == "DESCRIBE":
            df = self._find(tokens(text)[1])
            return self._rows([(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema], "name string, type string, nullable boolean")
        if head in ("START", "STOP", "PAUSE", "RESUME", "DEPLOY", "ROLLBACK"):
            return self._job(text)
        raise DialectError(f"unknown statement {head}")

    def select(self, text: str) -> DataFrame:
        words, depth, into, kept = tokens(text), 0, None, []
        k = 0
        while k < len(words):
            t = words[k]
            depth += (t == "(") - (t == ")")
            if t.upper() == "INTO" and not depth and k + 1 < len(words):
                into, k = words[k + 1], k + 2
                continue
            uri = re.fullmatch(r"'(\w+)://([^']+)'", t) if kept and kept[-1].upper() in ("FROM", "JOIN") else None
            kept.append(self._uri(uri[1], uri[2]) if uri else t)
            k += 1
        query = translate(" ".join(kept), self.time)
        query.notes = self.notes | annotations(text)
        sources, sinks = bindings(query.options)
        for name, options in sources.items():
            if name not in self.streams and name not in self.tables:
                self.register(name, adapters.bind(self.spark, options))
        self._watermark(query, {t.strip("`") for t in kept})
        df = metrics.observed(self.spark.sql(query.sql), query.notes)
        if into:
            if into in sinks:
                df = self._rows([(into, "written")], "name string, status string") if self._write(df, sinks[into], query.emit) is None else df
            else:
                df = self._append(into, df)
        self.last: Query = query
        return df

    def _watermark(self, query: Query, words: set[str]) -> None:
        """Streams in a windowed query get the watermark that was asked for, else half of the window's length: later rows
        correct windows until then, and EMIT FINAL waits for it."""
        for name, df in self.streams.items():
            if name in words and df.isStreaming and self.time in df.columns:
                delay = query.options.get(f"{name}.watermark") or self.delays.get(name)
                if delay or query.size:
                    limit = delay or self.spark.sql(f"SELECT cast(INTERVAL {query.size} / 2 AS string) AS h").first()[0]
                    df.withWatermark(self.time, limit).createOrReplaceTempView(name)

    def _write(self, df: DataFrame, options: dict[str, str], emit: str | None) -> object:
        rest = {k: v for k, v in options.items() if k not in ("type", "path", "topic")}
        return adapters.write(df, options["type"], options.get("path") or options.get("topic", ""), rest, emit)

    def _uri(self, scheme: str, path: str) -> str:
        name = f"uri_{abs(hash((scheme, path)))}"
        self.register(name, adapters.read(self.spark, scheme, path, {}))
        return name

    def _find(self, name: str) -> DataFrame:
        found = self.tables.get(name, self.streams.get(name))
        if found is None:
            raise DialectError(f"no stream or table {name}")
        return found

    def _rows(self, rows: list, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _create(self, text: str) -> DataFrame:
        m = re.fullmatch(r"CREATE\s+(STREAM|TABLE)\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)\s*(?:\([^)]*\)\s*)?AS\s+(SELECT.*)", text, re.I | re.S)
        if not m:
            raise DialectError("CREATE STREAM or TABLE name AS SELECT is expected")
        keys = [k[0] for k in re.findall(r"(\w+)\s+(PRIMARY\s+KEY)", m[3], re.I)]
        df = self.select(re.sub(r"\s+PRIMARY\s+KEY", "", m[3], flags=re.I))
        query, table = self.last, m[1].upper() == "TABLE"
        _, sinks = bindings(query.options)
        if keys and table and not df.isStreaming:
            df = self._latest(df, m[3], keys)
        self.register(m[2], df, table, keys)
        job = self.jobs.setdefault(m[2], Job(m[2], m[3]))
        for sink in sinks.values():
            job.query = self._write(df, sink, query.emit)
        return self._rows([(m[2], "created")], "name string, status string")

    def _latest(self, df: DataFrame, text: str, keys: list[str]) -> DataFrame:
        """Of each key the row of the latest time, if the query has the time column, else of the greatest values."""
        rest = [c for c in df.columns if c not in keys]
        order = [F.col(c) for c in ([self.time] if self.time in df.columns else []) + rest]
        row = F.struct(*df.columns)
        return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order) if order else F.lit(1)).alias("_r")).select("_r.*")

    def _append(self, name: str, df: DataFrame) -> DataFrame:
        old = self.tables.get(name, self.streams.get(name))
        if old is not None and (old.isStreaming or df.isStreaming):
            raise DialectError(f"rows can't be added to {name}: it is or gets an unbounded stream; bind a sink instead")
        stream = name in self.streams and name not in self.tables
        self.register(name, df if old is None else old.unionByName(df), not stream, self.keys.get(name))
        return self._rows([(name, "inserted")], "name string, status string")

    def _insert(self, text: str) -> DataFrame:
        m = re.fullmatch(r"INSERT\s+INTO\s+(\w+)\s*(?:\(([^)]*)\))?\s*(VALUES.*|SELECT.*)", text, re.I | re.S)
        if not m:
            raise DialectError("INSERT INTO name VALUES or SELECT is expected")
        target = self._find(m[1])
        names = [c.strip() for c in m[2].split(",")] if m[2] else target.columns
        rows = self.spark.sql(m[3]) if m[3][:6].upper() == "VALUES" else self.select(m[3])
        rows = rows.toDF(*names)
        cols = [F.col(c).cast(target.schema[c].dataType).alias(c) if c in names else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns]
        return self._append(m[1], rows.select(*cols))

    def _change(self, text: str) -> DataFrame:
        if m := re.fullmatch(r"DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.*))?", text, re.I | re.S):
            df = relations.delete(self._find(m[1]), F.expr(m[2] or "true"))
        elif m := re.fullmatch(r"UPDATE\s+(\w+)\s+SET\s+(.*?)(?:\s+WHERE\s+(.*))?", text, re.I | re.S):
            table = self._find(m[1])
            pairs = [p.split("=", 1) for p in re.split(r",(?![^(]*\))", m[2])]
            assign = {k.strip(): F.expr(v).cast(table.schema[k.strip()].dataType) for k, v in pairs}
            df = relations.update(table, assign, F.expr(m[3] or "true"))
        else:
            raise DialectError("the statement isn't complete")
        self.register(m[1], df, True, self.keys.get(m[1]))
        return self._rows([(m[1], "changed")], "name string, status string")

    def _show(self, text: str) -> DataFrame:
        words = tokens(text)
        like = next((w[1:-1] for w in words if w.startswith("'")), "%")
        what = words[1].upper()
        rows = {
            "STREAMS": [(n, "stream") for n in self.streams],
            "TABLES": [(n, "table") for n in self.tables],
            "FUNCTIONS": [(n, "aggregate" if n in AGGREGATES else "scalar") for n in sorted({*SCALARS, *AGGREGATES})],
            "JOBS": [(j.name, j.status) for j in self.jobs.values()],
            "VERSIONS": [(j.name, j.version) for j in self.jobs.values()],
            "STATUS": [(j.name, j.status) for j in self.jobs.values()],
            "TOPICS": [(n, "topic") for n, df in self.streams.items() if "_topic" in df.columns],
            "PROPERTIES": sorted((k, v) for k, v in self.spark.sparkContext.getConf().getAll() if k.startswith("spark.sql")),
            "METRICS": [(j.name, str(getattr(j.query, "lastProgress", None))) for j in self.jobs.values()],
        }
        if what in ("SCHEMA", "PARTITIONS"):
            df = self._find(words[2])
            return self._rows([(f.name, f.dataType.simpleString()) for f in df.schema] if what == "SCHEMA" else [(words[2], str(df.rdd.getNumPartitions()))], "name string, value string")
        if what not in rows:
            raise DialectError(f"can't show {what}")
        return self._rows(rows[what], "name string, value string").where(F.col("name").like(like))

    def _job(self, text: str) -> DataFrame:
        words = tokens(text)
        upper = [w.upper() for w in words]
        verb, name = upper[0], words[3 if upper[2] == "FORCE" else 2] if upper[1] == "JOB" else words[2]
        if verb in ("START", "DEPLOY"):
            version = re.search(r"VERSION\s+'([^']+)'", text, re.I)
            old = self.jobs.get(name)
            job = Job(name, text, version=version[1] if version else "1", history=[*(old.history if old else []), *([(old.version, old.text)] if old else [])])
            if old:
                self._halt(old)
            self.jobs[name] = job
            self._run(job)
        elif name not in self.jobs:
            raise DialectError(f"no job {name}")
        else:
            job = self.jobs[name]
            if verb == "ROLLBACK":
                if not job.history:
                    raise DialectError(f"job {name} has no older version")
                self._halt(job)
                job.version, job.text = job.history.pop()
                self._run(job)
            elif verb == "RESUME":
                if job.status != "running":
                    self._run(job)
            else:
                self._halt(job)
                job.status = {"STOP": "stopped", "PAUSE": "paused"}[verb]
        return self._rows([(name, self.jobs[name].status)], "name string, status string")

    def _halt(self, job: Job) -> None:
        if hasattr(job.query, "stop"):
            job.query.stop()
        job.query = None

    def _run(self, job: Job) -> None:
        """Runs a job's query. An unbounded one goes on from its checkpoint, if it ran before."""
        body = re.search(r"\bAS\s+((?:SELECT|WITH)\b.*)", job.text, re.I | re.S)
        if not body and not job.text.lstrip()[:6].upper() == "SELECT":
            raise DialectError(f"job {job.name} has no query")
        df = self.select(body[1] if body else job.text)
        self.register(job.name, df)
        for sink in bindings(self.last.options)[1].values():
            job.query = self._write(df, sink, self.last.emit)
        job.status = "running"
