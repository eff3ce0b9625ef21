"""Every registered query of the engine against DuckDB over the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from sluice.plans import registry

DATA = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


def test_every_query_has_sql():
    assert registry.queries().keys() == registry.oracle_sql().keys()


def test_range_frame_counts_parts_of_seconds(spark, tmp_path):
    """A day back from a row is exactly a day: 0.8 s and 1 microsecond more are outside, a day and less are inside."""
    times = ["2024-01-01 00:00:00.1", "2024-01-02 00:00:00.9", "2024-01-03 00:00:00.9", "2024-01-04 00:00:00.900001", "2024-01-05 00:00:00.3", "1969-12-30 23:59:59.7", "1969-12-31 23:59:59.8"]
    spark.createDataFrame([(k, 1, t) for k, t in enumerate(times)], "event_id long, user_id long, t string").selectExpr("event_id", "user_id", "cast(t AS timestamp_ntz) AS ts").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(registry.oracle_sql()["range_frame"]).fetchall())
    assert [n for _, n in want] == [1, 1, 2, 1, 2, 1, 1]
    assert sorted(map(tuple, registry.queries()["range_frame"](spark, str(tmp_path)).collect())) == want


def test_stream_takes_rows_of_any_month_and_without_a_time(spark, tmp_path):
    """Files arrive in the order of time, not of days of a month, and a row without a time comes last."""
    times = ["2024-02-05 00:00:00", "2024-01-20 00:00:00", "2024-01-05 00:00:00", "2024-02-25 00:00:00", None]
    rows = [(k, 1, t, "view", float(k)) for k, t in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, user_id long, t string, event_type string, value double").selectExpr("event_id", "cast(t AS timestamp_ntz) AS ts", "user_id", "event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(registry.oracle_sql()["stream_row_buffer"]).fetchall())
    assert len(want) == 5 and sorted(map(tuple, registry.queries()["stream_row_buffer"](spark, str(tmp_path)).collect())) == want
