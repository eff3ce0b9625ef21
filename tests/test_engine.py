import pytest
from pyspark.sql import functions as F

from sluice.plans.dialect import DialectError, annotations, duration, translate
from sluice.plans.engine import Engine, resolve_env
from sluice.operators import joins


@pytest.fixture
def engine(spark):
    e = Engine(spark, "ts")
    e.register("users", spark.createDataFrame([(1, "ann", 5.0), (2, "bob", 7.0)], "id long, name string, score double"), True, ["id"])
    return e


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_durations():
    assert duration(["5m"]) == "5 minute"
    assert duration(["90"]) == "90 second"
    assert duration(["INTERVAL", "'2'", "HOURS"]) == "2 hour"
    with pytest.raises(DialectError):
        duration(["5x"])


def test_clauses_in_order():
    with pytest.raises(DialectError):
        translate("SELECT a FROM t HAVING a > 1 WHERE a = 2")
    with pytest.raises(DialectError):
        translate("SELECT a FROM t WINDOW TUMBLING(ts, 1h)")
    q = translate("SELECT a, COUNT(*) FROM t GROUP BY a EMIT CHANGES WITH ('sink.type' = 'file', 'sink.path' = '/x')")
    assert q.emit == "CHANGES" and q.options == {"sink.type": "file", "sink.path": "/x"}
    assert translate("SELECT a, COUNT(*) FROM t GROUP BY a").emit == "CHANGES"
    assert annotations("-- @job_mode: adaptive\nSELECT 1") == {"job_mode": "adaptive"}


def test_env():
    assert resolve_env("${A:x}/${B}", {"B": "b"}) == "x/b"
    with pytest.raises(KeyError):
        resolve_env("${NONE}", {})


def test_changes(engine):
    engine.sql("INSERT INTO users VALUES (3, 'cid', 1.5)")
    engine.sql("UPDATE users SET score = score + 1, name = upper(name) WHERE id >= 2")
    engine.sql("DELETE FROM users WHERE id = 1")
    assert rows(engine.sql("SELECT * FROM users")) == [(2, "BOB", 8.0), (3, "CID", 2.5)]


def test_create_show_describe(engine):
    engine.sql("CREATE TABLE best AS SELECT id PRIMARY KEY, score FROM users WHERE score > 6")
    assert rows(engine.sql("SELECT * FROM best")) == [(2, 7.0)]
    assert ("best", "table") in rows(engine.sql("SHOW TABLES"))
    assert rows(engine.sql("SHOW TABLES LIKE 'b%'")) == [("best", "table")]
    assert rows(engine.sql("DESCRIBE best")) == [("id", "bigint", True), ("score", "double", True)]
    assert len(rows(engine.sql("SHOW FUNCTIONS"))) > 70


def test_jobs(engine):
    engine.sql("START JOB j AS SELECT id FROM users")
    engine.sql("PAUSE JOB j")
    assert rows(engine.sql("SHOW JOBS")) == [("j", "paused")]
    engine.sql("DEPLOY JOB j VERSION '2' AS SELECT name FROM users")
    assert engine.streams["j"].columns == ["name"]
    engine.sql("ROLLBACK JOB j")
    assert engine.streams["j"].columns == ["id"]
    with pytest.raises(DialectError):
        engine.sql("STOP JOB nothing")


def test_csv_source_and_sink(engine, spark, tmp_path):
    (tmp_path / "in.csv").write_text("id;v\n1;a\n2;b\n")
    from sluice.sources import adapters

    df = adapters.read_file(spark, str(tmp_path / "in.csv"), {"delimiter": ";"})
    assert rows(df) == [(1, "a"), (2, "b")]
    adapters.write(df, "file", str(tmp_path / "out.json"), {"format": "json"})
    assert rows(spark.read.json(str(tmp_path / "out.json"))) == [(1, "a"), (2, "b")]
    (tmp_path / "skip.csv").write_text("# note\n1,a\n2,b\n")
    assert rows(adapters.read_file(spark, str(tmp_path / "skip.csv"), {"skip_lines": "1", "has_headers": "false"}, "id long, v string")) == [(1, "a"), (2, "b")]


def test_bad_json_goes_aside(spark):
    from sluice.sources import adapters

    good, bad = adapters.split_bad(spark.createDataFrame([('{"a": 1}',), ("{oops",)], "raw string"), "raw", "a long")
    assert rows(good) == [(1,)] and rows(bad) == [("{oops",)]


def test_missing_table_policies(spark, engine):
    left = spark.createDataFrame([(1,), (9,)], "id long")
    table = engine.tables["users"].select("id", "name")
    assert rows(joins.stream_table(left, table, ["id"], "skip")) == [(1, "ann")]
    assert joins.stream_table(left, table, ["id"]).where(F.col("name").isNull()).count() == 1
    with pytest.raises(Exception):
        joins.stream_table(left, table, ["id"], "fail").collect()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, ts timestamp, v double")
    assert joins.as_of(empty, empty.withColumnRenamed("v", "w"), ["id"], "ts", "ts", ["w"]).count() == 0
    assert joins.session_join(empty.select("id", F.col("ts").alias("a")), empty.select("id", F.col("ts").alias("b")), ["id"], "a", "b", "1 hour").count() == 0


def test_row_buffer_clauses():
    def sql(end):
        return translate(f"SELECT AVG(x) OVER (ROWS WINDOW BUFFER 5 ROWS PARTITION BY k ORDER BY t {end}) AS m FROM s").sql

    assert "4 PRECEDING" in sql("EMIT EVERY RECORD") == sql("EXPIRE AFTER NEVER") == sql("")
    assert "_full0 >= 5" in sql("EMIT ON BUFFER FULL") and "_island0" in sql("EXPIRE AFTER INTERVAL '5' MINUTE INACTIVITY")
    with pytest.raises(DialectError):
        sql("EMIT SOMETIMES")


def test_joins_keep_their_brackets(engine):
    assert rows(engine.sql("SELECT u.id, j.m FROM users u JOIN (SELECT id AS jid, MAX(score) AS m FROM users GROUP BY id) j ON u.id = j.jid")) == [(1, 5.0), (2, 7.0)]
    assert rows(engine.sql("SELECT JOIN('-', name, 'x') AS j FROM users")) == [("ann-x",), ("bob-x",)]


def test_into_only_as_a_clause(engine):
    assert rows(engine.sql("SELECT id FROM users WHERE name <> 'go into town'")) == [(1,), (2,)] and "town" not in engine.tables
    engine.sql("SELECT id, name INTO others FROM users")
    assert rows(engine.sql("SELECT * FROM others")) == [(1, "ann"), (2, "bob")]


def test_insert_into_a_stream_adds(engine, spark):
    engine.register("s", spark.createDataFrame([(1,)], "id long"))
    engine.sql("INSERT INTO s VALUES (2)")
    assert rows(engine.sql("SELECT * FROM s")) == [(1,), (2,)] and "s" in engine.streams and "s" not in engine.tables


@pytest.mark.parametrize("op, quantifier, values, want", [
    (">", "ALL", "(1), (3)", [5, 9]), (">", "ALL", "(1), (NULL)", []), ("<", "ANY", "(6), (NULL)", [2, 5]), ("=", "ANY", "(5), (9)", [5, 9]),
    ("<>", "ALL", "(5)", [2, 9]), ("=", "ALL", "(5), (5)", [5]), ("<>", "ANY", "(5), (5)", [2, 9]), (">=", "SOME", "(9)", [9]),
])
def test_quantified(engine, spark, op, quantifier, values, want):
    engine.register("t", spark.sql("SELECT * FROM VALUES (2), (5), (9) AS t(x)"))
    engine.register("v", spark.sql(f"SELECT * FROM VALUES {values} AS v(y)"))
    assert [r[0] for r in rows(engine.sql(f"SELECT t.x FROM t WHERE t.x {op} {quantifier} (SELECT y FROM v)"))] == want
    assert [r[0] for r in rows(engine.sql("SELECT x FROM t WHERE x > ALL (SELECT y FROM v WHERE y > 100)"))] == [2, 5, 9]
    assert rows(engine.sql("SELECT x FROM t WHERE x > ANY (SELECT y FROM v WHERE y > 100)")) == []


def test_session_with_a_key(engine, spark):
    engine.register("e", spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 00:00:00'), (2, TIMESTAMP '2024-01-01 00:01:00'), (1, TIMESTAMP '2024-01-01 00:02:00') AS e(k, ts)"))
    assert rows(engine.sql("SELECT COUNT(*) AS n FROM e WINDOW SESSION(ts, 10m, k)")) == [(1,), (2,)]
    assert rows(engine.sql("SELECT COUNT(*) AS n FROM e WINDOW SESSION(e.ts, 10m)")) == [(3,)]
    assert rows(engine.sql("SELECT COUNT(*) AS n, _WINDOW_START AS s FROM e WINDOW HOPPING(ts, 1h, 1h) HAVING COUNT(*) > 1")) == [(3, 1704067200000)]


def test_common_tables_sets_and_samples(engine):
    assert rows(engine.sql("WITH a AS (SELECT id FROM users WHERE id = 1), b AS (SELECT id + 1 AS id FROM a) SELECT * FROM a UNION ALL SELECT * FROM b")) == [(1,), (2,)]
    assert rows(engine.sql("WITH RECURSIVE n(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM n WHERE k < 4) SELECT max(k) AS m FROM n")) == [(4,)]
    assert rows(engine.sql("SELECT id FROM users INTERSECT SELECT 2")) == [(2,)]
    assert rows(engine.sql("SELECT id FROM users EXCEPT SELECT 2")) == [(1,)]
    assert rows(engine.sql("SELECT id, name, COUNT(*) AS n FROM users GROUP BY id")) == [(1, "ann", 1), (2, "bob", 1)]
    assert rows(engine.sql('SELECT "name" AS `the name`, 1e-1 * score AS s FROM users WHERE id = $1 AND name <> $2', [2, "it's $1"])) == [("bob", 0.7000000000000001)]
    with pytest.raises(DialectError):
        engine.sql("SELECT $3 FROM users", [1])


def test_functions_in_text(engine):
    def one(e):
        return engine.sql(f"SELECT {e} AS v FROM users WHERE id = 1").first()[0]

    assert one(r"REGEXP('a1', '\d')") is True and one("REGEXP_REPLACE('xfoobar', '(?<=foo)bar', '#')") == "xfoo#"
    assert one("REGEXP_REPLACE('a-b-c', '(\w)-(\w)', '$2-$1')") == "b-a-c"
    assert one("TRIM(concat('\t', ' a b '))") == "a b" and one("STRUCT('a', 1, 'b', 2)").asDict() == {"a": 1, "b": 2}
    assert one("CURRENT_TIMESTAMP()") > 1_700_000_000_000 and one("2e0") == 2.0
    assert engine.sql("SELECT PERCENTILE_CONT(score, 0.5) AS p, PERCENTILE_DISC(score, 0.5) AS d FROM users").first() == (6.0, 5.0)
    with pytest.raises(Exception, match="negative"):
        one("SQRT(0 - score)")


def test_statement_file_and_functions(engine, tmp_path):
    (tmp_path / "q.sql").write_text("-- first; note\nCREATE TABLE a AS SELECT id PRIMARY KEY, ';' AS t FROM users;\nSELECT twice(id) AS d FROM a;")
    engine.register_function("twice", lambda x: x * 2, "long")
    assert rows(engine.run_file(str(tmp_path / "q.sql"))[1]) == [(2,), (4,)]


def test_latest_row_of_a_key(engine, spark):
    engine.register("s", spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-02', 'new'), (1, TIMESTAMP '2024-01-01', 'old') AS s(id, ts, v)"))
    engine.sql("CREATE TABLE kept AS SELECT id PRIMARY KEY, ts, v FROM s")
    assert [r.v for r in engine.sql("SELECT v FROM kept").collect()] == ["new"]


def test_bindings_from_text_alone(spark, tmp_path):
    """File to file by one statement, with a configuration file that extends another."""
    (tmp_path / "in.csv").write_text("id,v\n1,5\n2,7\n")
    (tmp_path / "base.yaml").write_text("type: file_source\nformat: csv\nheader: 'true'\n")
    (tmp_path / "own.yaml").write_text(f"extends: base.yaml\n# note\npath: {tmp_path}/in.csv\n")
    engine = Engine(spark, "ts")
    engine.sql(f"CREATE STREAM big AS SELECT id, v * 2 AS w FROM numbers WHERE v > 5 WITH ('numbers.config_file' = '{tmp_path}/own.yaml', 'out.type' = 'file_sink', 'out.path' = '{tmp_path}/out', 'out.format' = 'parquet')")
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == [(2, 14)]
    engine.sql(f"SELECT id INTO other FROM numbers WITH ('other.type' = 'file_sink', 'other.path' = '{tmp_path}/other', 'other.format' = 'json')")
    assert rows(spark.read.json(f"{tmp_path}/other")) == [(1,), (2,)]
    from sluice.sources import config

    assert config.parse("a:\n  b: 1\n  c:\n    - x\n    - y\nd: 'e # f'\n")["a.c"] == "x,y"


def test_jobs_over_streams_pause_and_resume(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    engine = Engine(spark, "ts")
    out = f"'out.type' = 'file_sink', 'out.path' = '{tmp_path}/out', 'out.format' = 'parquet', 'out.checkpoint' = '{tmp_path}/c', 'out.once' = 'true'"
    engine.sql(f"START JOB j AS SELECT id + 1 AS k FROM s WITH ('s.type' = 'file_source', 's.watch' = 'true', 's.path' = '{tmp_path}/in', 's.schema' = 'id long', {out})")
    engine.jobs["j"].query.awaitTermination()
    engine.sql("PAUSE JOB j")
    spark.range(5, 8).write.mode("append").parquet(f"{tmp_path}/in")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    engine.sql("RESUME JOB j")
    engine.jobs["j"].query.awaitTermination()
    assert sorted(r[0] for r in rows(spark.read.parquet(f"{tmp_path}/out"))) == list(range(1, 9))
    assert rows(engine.sql("SHOW JOBS")) == [("j", "running")] and rows(engine.sql("SHOW TOPICS")) == []


def test_key_only_tables_can_fail(spark):
    with pytest.raises(Exception, match="no match"):
        joins.stream_table(spark.createDataFrame([(9,)], "id long"), spark.createDataFrame([(1,)], "id long"), ["id"], "fail").collect()


def test_maxwell(spark):
    from sluice.sources import adapters

    df = spark.createDataFrame([('{"type": "update", "data": {"a": 1}}',), ('{"type": "delete", "data": {"a": 2}}',), ('{"type": "table-create"}',)], "raw string")
    assert rows(adapters.maxwell(df, "raw", "a long")) == [("d", 2), ("u", 1)]
    env = spark.createDataFrame([('{"payload": {"op": "d", "before": {"a": 3}, "after": null}}',)], "raw string")
    assert rows(adapters.debezium(env, "raw", "a long")) == [("d", 3)]
