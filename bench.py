"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

At sf0.1 a query takes little longer than a job's start; so LARGE ones run again over TIMES as many events and orders, made by repeating rows
under new ids, users and customers; these stand apart under "large" and don't count in the value.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import functions as F

from sluice.plans import registry
from sluice.session import build_session

HEADLINE = ["select_where", "group_by", "having", "tumbling_hour", "sliding_six_hours", "session_six_hours", "row_buffer", "stream_table_join", "interval_join", "exists", "in_subquery", "scalar_subquery", "correlated_subquery", "any_subquery", "equi_join", "statistics", "sql_tumbling"]

LARGE, TIMES = ["select_where", "group_by", "having", "tumbling_hour", "row_buffer", "stream_table_join", "any_subquery", "scalar_subquery"], 20


def enlarged(spark, sf_dir: str) -> str:
    """A folder with more events and orders, and links to the other tables."""
    folder = tempfile.mkdtemp(prefix="bench-")
    copies = spark.range(TIMES).withColumnRenamed("id", "copy")
    for table, ids in (("events", ("event_id", "user_id")), ("orders", ("o_orderkey", "o_custkey"))):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").crossJoin(F.broadcast(copies))  # TIMES rows
        for name in ids:
            rows = rows.withColumn(name, F.col(name) + F.col("copy") * 10_000_000)
        rows.drop("copy").write.parquet(f"{folder}/{table}.parquet")
    for table in ("customer", "supplier"):
        os.symlink(os.path.abspath(f"{sf_dir}/{table}.parquet"), f"{folder}/{table}.parquet")
    return folder


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds, more = registry.queries(), {}, {}
    large = enlarged(spark, sf_dir)
    for name, folder, label in [*((n, sf_dir, n) for n in HEADLINE), *((n, large, f"{n}_x{TIMES}") for n in LARGE)]:
        best = float("inf")
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        (seconds if folder == sf_dir else more)[label] = round(best, 4)
    shutil.rmtree(large)
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "large": more, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
