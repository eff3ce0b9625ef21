"""The plans of batch queries over streams, run until the input ends."""

import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.operators import joins, windows
from sluice.plans.engine import Engine
from sluice.streaming.stateful import keyed_table, read_keyed, row_buffer

DATA = "/root/testdata/sf0.001/events.parquet"


def _stream(spark, tmp_path, parts=3):
    df = spark.read.parquet(DATA).withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartitionByRange(parts, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_tumbling_update_equals_batch(spark, tmp_path):
    batch, stream = _stream(spark, tmp_path)
    agg = [F.count("*").alias("n")]
    _run(windows.tumbling(stream, "ts", "1 day", ["event_type"], agg), "tumble", "complete", tmp_path)
    got = {tuple(r) for r in spark.table("tumble").collect()}
    assert got == {tuple(r) for r in windows.tumbling(batch, "ts", "1 day", ["event_type"], agg).collect()}


def test_row_buffer_in_a_stream(spark, tmp_path):
    batch, stream = _stream(spark, tmp_path, 1)
    _run(row_buffer(stream.select("event_id", "user_id", "ts", "value"), ["user_id"], "ts", "value", 5), "buffer", "append", tmp_path)
    w = windows.row_buffer(["user_id"], ["ts"], 5)
    want = {r[0]: (round(r[1], 6), r[2]) for r in batch.select("event_id", F.avg("value").over(w), F.count("*").over(w)).collect()}
    got = {r.event_id: (round(r.avg_value, 6), r.n_rows) for r in spark.table("buffer").collect()}
    assert got == want


def test_row_buffer_functions_expiry_and_nulls(spark, tmp_path):
    rows = [(1, 0, 1.0), (1, 1, None), (1, 2, 3.0), (1, 100, 7.0), (1, 101, 9.0), (2, 0, 5.0)]
    spark.createDataFrame(rows, "k long, s long, v double").selectExpr("k", "timestamp_seconds(s) AS ts", "v").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, ts timestamp, v double").parquet(str(tmp_path / "in"))
    wanted = {"mean": ("avg", 0), "two": ("nth", 2), "sd": ("stddev_pop", 0), "n": ("count", 0), "place": ("rank", 0)}
    _run(row_buffer(stream, ["k"], "ts", "v", 3, wanted, quiet=50.0), "expiry", "append", tmp_path)
    got = {(r.k, r.ts.timestamp()): (r.mean, r.two, r.sd, r.n, r.place) for r in spark.table("expiry").collect()}
    assert got[(1, 2.0)] == (2.0, None, 1.0, 2.0, 2.0) and got[(1, 100.0)] == (7.0, None, 0.0, 1.0, 1.0) and got[(1, 101.0)][:2] == (8.0, 9.0)
    _run(row_buffer(stream, ["k"], "ts", "v", 3, quiet=None, full_only=True), "full", "append", tmp_path)
    assert sorted(r.ts.timestamp() for r in spark.table("full").collect()) == [2.0, 100.0, 101.0]


def _late(spark, tmp_path):
    """Four files: on time, two later, and one with a row that comes late but within half a window's time."""
    for i, times in enumerate((["00:10", "00:50"], ["01:20"], ["01:25"], ["00:55", "03:00"])):
        rows = [(f"2024-01-01 {t}:00", 1.0) for t in times]
        spark.createDataFrame(rows, "t string, v double").selectExpr("cast(t AS timestamp) AS ts", "v").coalesce(1).write.parquet(str(tmp_path / f"in/f{i}"))
    return spark.readStream.schema("ts timestamp, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def test_emit_over_a_stream_from_text(spark, tmp_path):
    """EMIT FINAL gives each window once, when the watermark of half a window has passed; EMIT CHANGES corrects windows."""
    engine = Engine(spark, "ts")
    engine.register("e", _late(spark, tmp_path))
    text = "SELECT _WINDOW_START AS w, COUNT(*) AS n FROM e WINDOW TUMBLING(ts, 1h) EMIT {}"
    _run(engine.sql(text.format("FINAL")), "final", "append", tmp_path)
    assert sorted(((r.w - 1704067200000) // 3600000, r.n) for r in spark.table("final").collect()) == [(0, 3), (1, 2)]
    _run(engine.sql(text.format("CHANGES")), "changes", "update", tmp_path)
    fired = [((r.w - 1704067200000) // 3600000, r.n) for r in spark.table("changes").collect()]
    assert (0, 2) in fired and (0, 3) in fired and (3, 1) in fired
    engine.register("e", engine.streams["e"], watermark="1 minute")
    _run(engine.sql(text.format("FINAL")), "strict", "append", tmp_path)
    assert sorted(((r.w - 1704067200000) // 3600000, r.n) for r in spark.table("strict").collect()) == [(0, 2), (1, 2)]  # the late row is dropped


def test_outer_window_join_over_streams(spark, tmp_path):
    """Rows without a partner come out when the window has closed."""
    _late(spark, tmp_path)
    stream = lambda: spark.readStream.schema("ts timestamp, v double").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    left = stream().selectExpr("ts AS l_ts", "v AS k").withWatermark("l_ts", "10 minutes")
    right = stream().where("ts > '2024-01-01 01:00:00'").selectExpr("ts AS r_ts", "v AS k").withWatermark("r_ts", "10 minutes")
    _run(joins.tumbling_join(left, right, ["k"], "l_ts", "r_ts", "1 hour", "left").select("l_ts", "r_ts"), "outer", "append", tmp_path)
    got = sorted((r.l_ts.hour, r.l_ts.minute, r.r_ts is not None) for r in spark.table("outer").collect())
    assert got == [(0, 10, False), (0, 50, False), (0, 55, False), (1, 20, True), (1, 20, True), (1, 25, True), (1, 25, True), (3, 0, True)]


def test_metrics_of_a_query(spark):
    engine = Engine(spark, "ts")
    engine.register("r", spark.range(10).selectExpr("id", "id * 2 AS v"))
    df = engine.sql("-- @metric_seen: counter WHERE id > 3\n-- @metric_top: gauge v\n-- @metric_spread: histogram v\nSELECT id, v FROM r")
    df.collect()
    got = df.sluice_metrics.get
    assert (got["seen"], got["top"], got["spread"]["n"], got["spread"]["sum"]) == (6, 18, 10, 90)


def test_keyed_table(spark, tmp_path):
    batch, stream = _stream(spark, tmp_path)
    keyed_table(stream.select("user_id", "ts", "value"), str(tmp_path / "t"), ["user_id"], "ts", str(tmp_path / "c")).awaitTermination()
    table = read_keyed(spark, str(tmp_path / "t"), stream.select("user_id", "ts", "value").schema)
    got = {r.user_id: r.value for r in table.collect()}
    assert table.count() == len(got) and got == {r.user_id: r.v for r in batch.groupBy("user_id").agg(F.max_by("value", "ts").alias("v")).collect()}


def test_row_buffer_in_a_plain_session_elsewhere(spark, tmp_path):
    """A caller's session with Spark's default state store, started in another folder: the driver's processes find no sources there."""
    repo = Path(__file__).resolve().parents[1]
    code = f"""import sys
sys.path.insert(0, {str(repo)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
import __spark_entry__
__spark_entry__.queries()["stream_row_buffer"](spark, "/root/testdata/sf0.001").write.parquet("out")
spark.stop()"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    w = Window.partitionBy("user_id").orderBy("ts")
    last = windows.row_buffer(["user_id"], ["ts"], 5)
    batch = spark.read.parquet(DATA)
    want = batch.select("event_id", F.lag("value").over(w), F.round(F.avg("value").over(last), 6), F.min("value").over(last), F.max("value").over(last), F.count("*").over(last).cast("double"))
    got = spark.read.parquet(str(tmp_path / "out")).select("event_id", "lag_value", "avg_value", "min_value", "max_value", "n_rows")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
