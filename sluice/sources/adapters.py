"""Sources and sinks by scheme, over Spark's readers and writers."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Reader = Callable[[SparkSession, str, Mapping[str, str]], DataFrame]
_READERS: dict[str, Reader] = {}
#: Suffixes of paths and the formats they tell.
SUFFIXES = {"csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "orc": "orc", "txt": "text"}


def register(scheme: str, reader: Reader) -> None:
    """A reader for another scheme."""
    _READERS[scheme] = reader


def file_options(options: Mapping[str, str]) -> dict[str, str]:
    """Reader options by the dialect's names."""
    named = {"delimiter": "sep", "quote": "quote", "escape": "escape", "has_headers": "header", "header": "header", "recursive": "recursiveFileLookup", "glob": "pathGlobFilter", "extension": "pathGlobFilter"}
    found = {named[k]: (f"*.{v}" if k == "extension" else v) for k, v in options.items() if k in named}
    return {"header": "true"} | found


def read_file(spark: SparkSession, path: str, options: Mapping[str, str] = {}, schema: StructType | str | None = None) -> DataFrame:
    """Batch input of CSV (lines to skip, most records), JSON lines or arrays, Parquet, ORC or text.

    `skip_lines` numbers lines within each file, as its rows are read in order; `max_records` is a limit asked for."""
    kind = options.get("format") or SUFFIXES.get(path.rsplit(".", 1)[-1], "parquet")
    if kind in ("csv_no_header", "json_array"):
        options = {**options, "has_headers": "false"} if kind == "csv_no_header" else options
        multiline, kind = kind == "json_array", kind.split("_")[0]
    else:
        multiline = False
    reader = spark.read.options(**file_options(options)) if kind == "csv" else spark.read
    if schema is not None:
        reader = reader.schema(schema)
    skip = int(options.get("skip_lines", 0))
    if kind == "csv" and skip:
        if not options.get("has_headers", "true") == "false":
            raise ValueError("skip_lines needs has_headers = false and a schema")
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
        first = lines.groupBy("f").agg(F.min("i").alias("first"))
        kept = lines.join(F.broadcast(first), "f").where(F.col("i") - F.col("first") >= skip).select("value")
        df = kept.select(F.from_csv("value", schema if isinstance(schema, str) else schema.simpleString(), {"sep": options.get("delimiter", ",")}).alias("r")).select("r.*")
    elif kind == "csv":
        df = reader.option("inferSchema", str(schema is None).lower()).csv(path)
    elif kind == "json":
        df = reader.option("multiLine", str(multiline).lower()).json(path)
    else:
        df = reader.format(kind).load(path)
    return df.limit(int(options["max_records"])) if "max_records" in options else df


def read_stream(spark: SparkSession, path: str, schema: StructType | str, options: Mapping[str, str] = {}) -> DataFrame:
    """A directory watched for files; `max_files` bounds a micro-batch."""
    kind = options.get("format", "parquet")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", options.get("max_files", "1000"))
    return (reader.options(**file_options(options)) if kind == "csv" else reader).format(kind).load(path)


def read_kafka(spark: SparkSession, topics: str, options: Mapping[str, str], streaming: bool = True) -> DataFrame:
    """Key, value, headers as a map, and the system columns of each message."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("subscribe", topics).option("includeHeaders", "true")
    renamed = {"brokers": "kafka.bootstrap.servers", "group": "kafka.group.id", "start": "startingOffsets", "max_offsets": "maxOffsetsPerTrigger"}
    df = reader.options(**{renamed.get(k, k): v for k, v in options.items()}).load()
    headers = F.map_from_entries(F.transform("headers", lambda h: F.struct(h["key"], h["value"].cast("string"))))
    return df.select(F.col("key").cast("string").alias("_key"), "value", F.col("timestamp").alias("_timestamp"), F.col("offset").alias("_offset"), F.col("partition").alias("_partition"), F.col("topic").alias("_topic"), headers.alias("_headers"))


def read(spark: SparkSession, scheme: str, path: str, options: Mapping[str, str]) -> DataFrame:
    if scheme in _READERS:
        return _READERS[scheme](spark, path, options)
    if scheme in ("file", "file_source", "file_source_mmap"):
        return read_file(spark, path, options)
    if scheme == "kafka":
        return read_kafka(spark, path, options)
    raise ValueError(f"no source {scheme}")


def bind(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    """A source by its options: type, path or topic, and with `watch` a directory as a stream, which needs a schema."""
    kind, path = options["type"], options.get("path") or options.get("topic", "")
    rest = {k: v for k, v in options.items() if k not in ("type", "path", "topic", "watch", "schema")}
    if kind.startswith("file") and str(options.get("watch", "")).lower() == "true":
        df = read_stream(spark, path, options["schema"], rest)
    elif kind.startswith("file"):
        df = read_file(spark, path, rest, options.get("schema"))
    else:
        df = read(spark, kind.removesuffix("_source"), path, rest)
    return event_time(df, options["event_time"], options.get("event_time_format", "epoch_millis")) if "event_time" in options else df


def event_time(df: DataFrame, field: str, kind: str = "epoch_millis") -> DataFrame:
    """The column _timestamp from a field: epoch_millis, epoch_seconds, iso8601, or a date pattern."""
    col = F.col(field)
    made = {"epoch_millis": lambda: F.timestamp_millis(col.cast("long")), "epoch_seconds": lambda: F.timestamp_seconds(col), "epoch": lambda: F.timestamp_seconds(col), "iso8601": lambda: F.try_to_timestamp(col)}
    return df.withColumn("_timestamp", made[kind]() if kind in made else F.try_to_timestamp(col, F.lit(kind)))


def split_bad(df: DataFrame, raw: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON rows that fit a schema, and those that don't, for a dead-letter sink."""
    parsed = df.withColumn("_p", F.from_json(raw, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_p").isNull() | F.col("_p._bad").isNotNull()
    return parsed.where(~bad).select("_p.*").drop("_bad"), parsed.where(bad).select(raw)


def debezium(df: DataFrame, raw: str, schema: str) -> DataFrame:
    """Operation and the row after (before, for deletes) of change envelopes."""
    e = F.from_json(raw, f"payload struct<op:string,before:struct<{schema}>,after:struct<{schema}>>")
    return df.select(e["payload"].alias("e")).select(F.col("e.op").alias("op"), F.coalesce("e.after", "e.before").alias("row")).select("op", "row.*")


def maxwell(df: DataFrame, raw: str, schema: str) -> DataFrame:
    """Operation (c, u or d) and the row of Maxwell's change envelopes."""
    e = F.from_json(raw, f"type string, data struct<{schema}>")
    op = F.create_map(*[F.lit(x) for pair in (("insert", "c"), ("bootstrap-insert", "c"), ("update", "u"), ("delete", "d")) for x in pair])
    return df.select(e.alias("e")).where(F.col("e.type").isin("insert", "bootstrap-insert", "update", "delete")).select(op[F.col("e.type")].alias("op"), "e.data.*")


def _rotation(options: Mapping[str, str]) -> dict[str, str]:
    """Writer options for files that end after so many records."""
    return {"maxRecordsPerFile": options["rotate.records"]} if "rotate.records" in options else {}


def write(df: DataFrame, scheme: str, path: str, options: Mapping[str, str], emit: str | None = None) -> object:
    """Writes a bounded input, or starts the query of an unbounded one, which needs `checkpoint`."""
    kind = options.get("format") or SUFFIXES.get(path.rsplit(".", 1)[-1], "json")
    extra = {k: v for k, v in options.items() if k in ("compression", "maxRecordsPerFile", "header", "kafka.bootstrap.servers")} | _rotation(options)
    if scheme.startswith("kafka"):
        key = [F.col(options["key"]).cast("string").alias("key")] if "key" in options else []
        headers = [F.transform(F.map_entries("_headers"), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("binary").alias("value"))).alias("headers")] if "_headers" in df.columns else []
        part = [F.col(options["partition"]).cast("int").alias("partition")] if "partition" in options else []
        value = F.to_json(F.struct(*[c for c in df.columns if c != "_headers"])).alias("value")
        kind, df, extra = "kafka", df.select(value, *key, *headers, *part), {**extra, "topic": path}
        if headers:
            extra["includeHeaders"] = "true"
    elif scheme.startswith("stdout"):
        kind = "console"
    if df.isStreaming:
        mode = options.get("mode") or ("update" if emit == "CHANGES" else "append")
        writer = df.writeStream.format(kind).options(**extra).option("checkpointLocation", options["checkpoint"]).outputMode(mode)
        writer = writer if kind in ("kafka", "console") else writer.option("path", path)
        return (writer.trigger(availableNow=True) if options.get("once") else writer).start()
    if kind == "console":
        return df.show()
    return df.write.format(kind).options(**extra).mode(options.get("mode", "append")).save(*([] if kind == "kafka" else [path]))
