"""Registered queries of the engine's operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.functions import scalar as S
from sluice.functions.aggregate import aggregate, first_value, last_value, listagg
from sluice.operators import joins, relations, tables, windows
from sluice.plans.engine import Engine
from sluice.session import scratch
from sluice.sources import adapters
from sluice.streaming.stateful import keyed_table, read_keyed, row_buffer, split_late

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        name = f.__name__.strip("_")
        _QUERIES[name] = f
        _SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dialect(name: str, text: str, sql: str, tables: tuple[str, ...] = ("events",), time: str = "ts") -> None:
    """A query in the dialect's text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, time)
        for t in tables:
            engine.register(t, _t(spark, sf_dir, t))
        return engine.sql(text)

    _QUERIES[name] = run
    _SQL[name] = sql


# time windows


@_query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY 1, 2, 3")
def _tumbling_hour(spark, d):
    return windows.tumbling(_t(spark, d, "events"), "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value")])


@_query("""SELECT w AS window_start, w + INTERVAL '6 hours' AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total
    FROM (SELECT *, unnest([time_bucket(INTERVAL '1 hour', ts) - k * INTERVAL '1 hour' FOR k IN range(6)]) AS w FROM events) GROUP BY 1, 2, 3""")
def _sliding_six_hours(spark, d):
    return windows.sliding(_t(spark, d, "events"), "ts", "6 hours", "1 hour", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])


@_query("""WITH a AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' THEN 1 ELSE 0 END AS f FROM events),
    b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
    SELECT min(ts) AS window_start, max(ts) + INTERVAL '6 hours' AS window_end, user_id, count(*) AS n FROM b GROUP BY user_id, s""")
def _session_six_hours(spark, d):
    return windows.session(_t(spark, d, "events"), "ts", "6 hours", ["user_id"], [F.count("*").alias("n")])


@_query("""SELECT event_id, lag(value) OVER w AS lag_value, round(avg(value) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS avg_value,
    least(row_number() OVER w, 10) AS buffer_rows FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _row_buffer(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    b = windows.row_buffer(["user_id"], ["ts", "event_id"], 10)
    return _t(spark, d, "events").select("event_id", F.lag("value").over(w).alias("lag_value"), F.round(F.avg("value").over(b), 6).alias("avg_value"), F.least(F.row_number().over(w), F.lit(10)).cast("long").alias("buffer_rows"))


@_query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events) WHERE n >= 10")
def _buffer_full(spark, d):
    return windows.buffer_full(_t(spark, d, "events"), ["user_id"], ["ts"], 10).select("event_id", "user_id")


@_query("""WITH a AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '12 hours' THEN 1 ELSE 0 END AS f FROM events),
    b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
    SELECT event_id, row_number() OVER (PARTITION BY user_id, s ORDER BY ts) AS place FROM b""")
def _buffer_expiry(spark, d):
    df = windows.expiring(_t(spark, d, "events"), ["user_id"], "ts", "12 hours")
    return df.select("event_id", F.row_number().over(W.partitionBy("user_id", "_island").orderBy("ts")).cast("long").alias("place"))


@_query("""SELECT event_id, rank() OVER w AS rnk, dense_rank() OVER w AS dense, round(percent_rank() OVER w, 9) AS pct, round(cume_dist() OVER w, 9) AS cume,
    ntile(4) OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts), event_id) AS tile FROM events WINDOW w AS (PARTITION BY user_id ORDER BY date_trunc('day', ts))""")
def _ranking(spark, d):
    w = W.partitionBy("user_id").orderBy(F.date_trunc("day", "ts"))
    tile = W.partitionBy("user_id").orderBy(F.date_trunc("day", "ts"), "event_id")
    cols = [F.rank().over(w).cast("long").alias("rnk"), F.dense_rank().over(w).cast("long").alias("dense"), F.round(F.percent_rank().over(w), 9).alias("pct"), F.round(F.cume_dist().over(w), 9).alias("cume"), F.ntile(4).over(tile).cast("long").alias("tile")]
    return _t(spark, d, "events").select("event_id", *cols)


@_query("""SELECT event_id, first_value(value) OVER w AS first_v, last_value(value) OVER w AS last_v, nth_value(value, 2) OVER w AS second_v, lead(value, 1) OVER (PARTITION BY user_id ORDER BY ts) AS next_v
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def _frame_values(spark, d):
    o = W.partitionBy("user_id").orderBy("ts")
    w = o.rowsBetween(-3, 0)
    return _t(spark, d, "events").select("event_id", F.first("value").over(w).alias("first_v"), F.last("value").over(w).alias("last_v"), F.nth_value("value", 2).over(w).alias("second_v"), F.lead("value").over(o).alias("next_v"))


@_query("""SELECT event_id, round(stddev_samp(value) OVER w, 6) AS sd, round(var_pop(value) OVER w, 2) AS vp, min(value) OVER w AS lo, max(value) OVER w AS hi, count(value) OVER w AS n
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def _frame_statistics(spark, d):
    w = W.partitionBy("event_type").orderBy("ts").rowsBetween(-19, 0)
    return _t(spark, d, "events").select("event_id", F.round(F.stddev_samp("value").over(w), 6).alias("sd"), F.round(F.var_pop("value").over(w), 2).alias("vp"), F.min("value").over(w).alias("lo"), F.max("value").over(w).alias("hi"), F.count("value").over(w).alias("n"))


@_query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS day_n FROM events""")
def _range_frame(spark, d):
    w = W.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, 0)
    return _t(spark, d, "events").select("event_id", F.count("*").over(w).alias("day_n"))


# projection, filter, expressions


@_query("SELECT event_id, value * 2 AS twice, value * 2 + 1 AS more, event_type || ':' || CAST(user_id AS VARCHAR) AS tag FROM events WHERE value > 50 AND event_type <> 'error'")
def _select_where(spark, d):
    df = _t(spark, d, "events").where((F.col("value") > 50) & (F.col("event_type") != "error"))
    return df.select("event_id", (F.col("value") * 2).alias("twice"), (F.col("value") * 2 + 1).alias("more"), F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("tag"))


@_query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'large' END AS class, p_retailprice BETWEEN 1000 AND 1200 AS mid_price FROM part WHERE p_name LIKE '%a%' AND p_size IN (1, 5, 9, 14, 33, 45)")
def _case_like_in(spark, d):
    size = F.col("p_size")
    df = _t(spark, d, "part").where(F.col("p_name").like("%a%") & size.isin(1, 5, 9, 14, 33, 45))
    return df.select("p_partkey", F.when(size < 10, "small").when(size < 30, "mid").otherwise("large").alias("class"), F.col("p_retailprice").between(1000, 1200).alias("mid_price"))


@_query("""SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 1.0 ELSE value / (user_id % 7) END AS ratio, nullif(event_type, 'view') AS kind, coalesce(nullif(event_type, 'view'), 'none') AS named,
    nullif(event_type, 'view') IS NULL AS is_view FROM events""")
def _null_handling(spark, d):
    kind = S.scalar("NULLIF", F.col("event_type"), "view")
    return _t(spark, d, "events").select("event_id", S.divide_or_one(F.col("value"), F.col("user_id") % 7).alias("ratio"), kind.alias("kind"), S.scalar("COALESCE", kind, "none").alias("named"), kind.isNull().alias("is_view"))


@_query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_discount AS DECIMAL(18,4)) AS DOUBLE) AS off FROM lineitem")
def _decimal_product(spark, d):
    money = lambda c: F.col(c).cast("decimal(18,4)")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (money("l_extendedprice") * money("l_discount")).cast("double").alias("off"))


# functions


@_query("SELECT event_id, abs(-value) AS a, round(value, 1) AS r, CAST(ceil(value) AS BIGINT) AS c, CAST(floor(value) AS BIGINT) AS f, sqrt(value) AS s, pow(value, 2) AS p, user_id % 7 AS m, least(value, 100) AS lo, greatest(value, 100) AS hi FROM events")
def _math_functions(spark, d):
    v = F.col("value")
    cols = {"a": S.scalar("ABS", -v), "r": S.scalar("ROUND", v, 1), "c": S.scalar("CEILING", v), "f": S.scalar("FLOOR", v), "s": S.scalar("SQRT", v), "p": S.scalar("POW", v, 2), "m": S.scalar("MOD", F.col("user_id"), 7), "lo": S.scalar("LEAST", v, 100.0), "hi": S.scalar("GREATEST", v, 100.0)}
    return _t(spark, d, "events").select("event_id", *[c.alias(n) for n, c in cols.items()])


@_query("""SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS lw, substring(p_name, 2, 4) AS sub, replace(p_type, ' ', '-') AS rep, trim('  ' || p_name || ' ') AS tr, length(p_name) AS n, concat(p_brand, '/', p_size) AS cc,
    split_part(p_name, ' ', 1) AS sp, left(p_name, 3) AS l3, right(p_name, 3) AS r3, CAST(strpos(p_name, 'a') AS INTEGER) AS pos, regexp_matches(p_name, '[aeiou]{2}') AS rx, regexp_replace(p_name, '[aeiou]', '#') AS rr, split_part(p_name, ' ', 2) AS sp2 FROM part""")
def _string_functions(spark, d):
    n = F.col("p_name")
    cols = {"u": S.scalar("UPPER", n), "lw": S.scalar("LOWER", F.col("p_brand")), "sub": S.scalar("SUBSTRING", n, 2, 4), "rep": S.scalar("REPLACE", F.col("p_type"), " ", "-"), "tr": S.scalar("TRIM", F.concat(F.lit("  "), n, F.lit(" "))), "n": S.scalar("LEN", n).cast("long"), "cc": S.scalar("CONCAT", F.col("p_brand"), F.lit("/"), F.col("p_size"))}
    cols |= {"sp": S.scalar("SPLIT", n, " "), "l3": S.scalar("LEFT", n, 3), "r3": S.scalar("RIGHT", n, 3), "pos": S.scalar("POSITION", "a", n), "rx": S.scalar("REGEXP", n, "[aeiou]{2}"), "rr": S.scalar("REGEXP_REPLACE", n, "[aeiou]", "#"), "sp2": S.scalar("SPLIT_PART", n, " ", 2)}
    return _t(spark, d, "part").select("p_partkey", *[c.alias(k) for k, c in cols.items()])


@_query("""SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, dayofweek(ts) AS dow, dayofyear(ts) AS doy, weekofyear(ts) AS wk, quarter(ts) AS q, CAST(floor(epoch(ts)) AS BIGINT) AS ep, strftime(ts, '%Y/%m/%d %H:%M') AS txt,
    date_diff('month', TIMESTAMP '2023-11-15 00:00:00', ts) AS months, date_diff('day', TIMESTAMP '2023-11-15 12:00:00', ts) AS days FROM events""")
def _date_functions(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    at = lambda text: F.unix_millis(F.lit(text).cast("timestamp"))
    parts = {"y": "YEAR", "mo": "MONTH", "d": "DAY", "h": "HOUR", "dow": "DOW", "doy": "DOY", "wk": "WEEK", "q": "QUARTER", "ep": "EPOCH"}
    cols = [S.extract(p, ms).alias(n) for n, p in parts.items()]
    return _t(spark, d, "events").select("event_id", *cols, S.scalar("DATE_FORMAT", ms, "%Y/%m/%d %H:%M").alias("txt"), S.datediff("months", at("2023-11-15 00:00:00"), ms).alias("months"), S.datediff("days", at("2023-11-15 12:00:00"), ms).alias("days"))


@_query("SELECT event_id, props->>'$.k' AS k, json_exists(props, '$.k') AS has_k, json_exists(props, '$.z') AS has_z FROM events")
def _json_functions(spark, d):
    p = F.col("props")
    return _t(spark, d, "events").select("event_id", S.scalar("JSON_VALUE", p, "$.k").alias("k"), S.scalar("JSON_EXISTS", p, "$.k").alias("has_k"), S.scalar("JSON_EXISTS", p, "$.z").alias("has_z"))


@_query("SELECT vec_id, len(embedding) AS n, list_contains([label, 3], 3) AS has3, [label, label + 1][2] AS second, map_keys(MAP {'a': label, 'b': 2})[1] AS k1 FROM embeddings")
def _array_functions(spark, d):
    lab = F.col("label")
    return _t(spark, d, "embeddings").select("vec_id", S.scalar("ARRAY_LENGTH", F.col("embedding")).cast("long").alias("n"), S.scalar("ARRAY_CONTAINS", S.scalar("ARRAY", lab, F.lit(3)), 3).alias("has3"), S.scalar("ARRAY", lab, lab + 1)[1].alias("second"), S.scalar("MAP_KEYS", S.scalar("MAP", "a", lab, "b", F.lit(2)))[0].alias("k1"))


# aggregation


@_query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS s, round(avg(value), 6) AS a, min(value) AS lo, max(value) AS hi, count(DISTINCT user_id) AS users, round(max(value) - min(value), 6) AS delta, median(value) AS med FROM events GROUP BY 1")
def _group_by(spark, d):
    v = F.col("value")
    return _t(spark, d, "events").groupBy("event_type").agg(aggregate("COUNT").alias("n"), F.round(aggregate("SUM", v), 4).alias("s"), F.round(aggregate("AVG", v), 6).alias("a"), aggregate("MIN", v).alias("lo"), aggregate("MAX", v).alias("hi"), aggregate("COUNT_DISTINCT", "user_id").alias("users"), F.round(aggregate("DELTA", v), 6).alias("delta"), aggregate("MEDIAN", v).alias("med"))


@_query("SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 4) AS v, round(var_pop(l_quantity), 4) AS vp, round(corr(l_extendedprice, l_quantity), 6) AS c, round(covar_pop(l_extendedprice, l_quantity), 2) AS cp, round(covar_samp(l_extendedprice, l_quantity), 2) AS cs, round(regr_slope(l_extendedprice, l_quantity), 4) AS sl, round(regr_intercept(l_extendedprice, l_quantity), 2) AS ic, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def _statistics(spark, d):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    one = {"sd": ("STDDEV", 6), "sdp": ("STDDEV_POP", 6), "v": ("VARIANCE", 4), "vp": ("VAR_POP", 4)}
    two = {"c": ("CORR", 6), "cp": ("COVAR_POP", 2), "cs": ("COVAR_SAMP", 2), "sl": ("REGR_SLOPE", 4), "ic": ("REGR_INTERCEPT", 2), "r2": ("REGR_R2", 6)}
    cols = [F.round(aggregate(f, q), n).alias(k) for k, (f, n) in one.items()] + [F.round(aggregate(f, p, q), n).alias(k) for k, (f, n) in two.items()]
    return _t(spark, d, "lineitem").groupBy("l_returnflag").agg(*cols)


@_query("SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p90, quantile_disc(value, 0.25) AS d25 FROM events GROUP BY 1")
def _percentiles(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.round(aggregate("PERCENTILE_CONT", "value", 0.9), 6).alias("p90"), aggregate("PERCENTILE_DISC", "value", 0.25).alias("d25"))


@_query("SELECT user_id, arg_min(value, ts) AS first_v, arg_max(value, ts) AS last_v, string_agg(event_type, ',' ORDER BY ts) AS kinds FROM events GROUP BY 1")
def _ordered_aggregates(spark, d):
    t = F.col("ts")
    return _t(spark, d, "events").groupBy("user_id").agg(first_value(F.col("value"), t).alias("first_v"), last_value(F.col("value"), t).alias("last_v"), listagg(F.col("event_type"), t).alias("kinds"))


@_query("SELECT user_id, count(*) AS n, round(sum(value) / count(*), 6) AS mean FROM events GROUP BY 1 HAVING count(*) > 60 AND sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) * 5 < count(*)")
def _having(spark, d):
    df = _t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value") / F.count("*"), 6).alias("mean"), F.sum((F.col("event_type") == "error").cast("int")).alias("errors"))
    return df.where((F.col("n") > 60) & (F.col("errors") * 5 < F.col("n"))).drop("errors")


@_query("SELECT DISTINCT user_id, event_type FROM events")
def _distinct(spark, d):
    return _t(spark, d, "events").select("user_id", "event_type").distinct()


@_query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _rollup(spark, d):
    return _t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _top_k(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


# joins


@_query("SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 100000")
def _equi_join(spark, d):
    o, c, n = (_t(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.where("o_totalprice > 100000").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@_query("SELECT c.c_custkey, o.o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 3000) c FULL OUTER JOIN (SELECT * FROM orders WHERE o_totalprice > 100000) o ON c.c_custkey = o.o_custkey")
def _full_join(spark, d):
    c, o = _t(spark, d, "customer").where("c_acctbal > 3000"), _t(spark, d, "orders").where("o_totalprice > 100000")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "full").select("c_custkey", "o_orderkey")


@_query("SELECT c.c_name, o.o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 3000) c RIGHT JOIN orders o ON c.c_custkey = o.o_custkey")
def _right_join(spark, d):
    c = _t(spark, d, "customer").where("c_acctbal > 3000")
    return c.join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "right").select("c_name", "o_orderkey")


@_query("SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey < n.n_nationkey AND n.n_regionkey = 2")
def _theta_join(spark, d):
    s, n = _t(spark, d, "supplier"), _t(spark, d, "nation").where("n_regionkey = 2")
    return s.join(F.broadcast(n), F.col("s_nationkey") < F.col("n_nationkey")).select("s_suppkey", "n_nationkey")  # 25 nations at any scale


@_query("SELECT e.event_id, e.user_id, coalesce(c.c_mktsegment, 'unknown') AS c_mktsegment FROM events e LEFT JOIN (SELECT c_custkey AS user_id, c_mktsegment FROM customer WHERE c_acctbal > 2000) c ON e.user_id = c.user_id")
def _stream_table_join(spark, d):
    table = _t(spark, d, "customer").where("c_acctbal > 2000").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return joins.stream_table(_t(spark, d, "events"), table, ["user_id"], "defaults", {"c_mktsegment": "unknown"}).select("event_id", "user_id", "c_mktsegment")


_SIDES = "(SELECT event_id AS l_id, user_id, ts AS l_ts FROM events WHERE event_type = 'click') l {} JOIN (SELECT event_id AS r_id, user_id, ts AS r_ts FROM events WHERE event_type = 'purchase') r"


def _two(spark, d):
    e = _t(spark, d, "events")
    left = e.where("event_type = 'click'").select(F.col("event_id").alias("l_id"), "user_id", F.col("ts").alias("l_ts"))
    return left, e.where("event_type = 'purchase'").select(F.col("event_id").alias("r_id"), "user_id", F.col("ts").alias("r_ts"))


@_query(f"SELECT l_id, r_id FROM {_SIDES.format('')} ON l.user_id = r.user_id AND r_ts BETWEEN l_ts - INTERVAL 1 HOUR AND l_ts + INTERVAL 6 HOUR")
def _interval_join(spark, d):
    left, right = _two(spark, d)
    l, r = left.alias("l"), right.alias("r")
    return joins.interval_join(l, r, F.col("l.user_id") == F.col("r.user_id"), "l_ts", "r_ts", "-1 HOUR", "6 HOUR").select("l_id", "r_id")


@_query(f"SELECT l_id, r_id FROM {_SIDES.format('LEFT')} ON l.user_id = r.user_id AND r_ts BETWEEN l_ts - INTERVAL 3 HOUR AND l_ts + INTERVAL 3 HOUR")
def _within_left(spark, d):
    left, right = _two(spark, d)
    return joins.within(left.alias("l"), right.alias("r"), F.col("l.user_id") == F.col("r.user_id"), "l_ts", "r_ts", "3 HOUR", "left").select("l_id", "r_id")


@_query(f"SELECT l_id, r_id FROM {_SIDES.format('')} ON l.user_id = r.user_id AND time_bucket(INTERVAL '1 day', l_ts) = time_bucket(INTERVAL '1 day', r_ts)")
def _tumbling_join(spark, d):
    left, right = _two(spark, d)
    return joins.tumbling_join(left, right, ["user_id"], "l_ts", "r_ts", "1 day").select("l_id", "r_id")


@_query(f"""SELECT l_id, r_id, w AS window_start FROM (SELECT l_id, r_id, l_ts, r_ts, unnest([time_bucket(INTERVAL '1 hour', l_ts) - k * INTERVAL '1 hour' FOR k IN range(6)]) AS w FROM {_SIDES.format('')} ON l.user_id = r.user_id)
    WHERE r_ts >= w AND r_ts < w + INTERVAL '6 hours'""")
def _sliding_join(spark, d):
    left, right = _two(spark, d)
    return joins.sliding_join(left, right, ["user_id"], "l_ts", "r_ts", "6 hours", "1 hour").select("l_id", "r_id", F.col("window.start").alias("window_start"))


@_query("""WITH a AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' THEN 1 ELSE 0 END AS f FROM events WHERE event_type IN ('click', 'purchase')),
    b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
    SELECT l.event_id AS l_id, r.event_id AS r_id FROM b l JOIN b r ON l.user_id = r.user_id AND l.s = r.s AND l.event_type = 'click' AND r.event_type = 'purchase'""")
def _session_join(spark, d):
    left, right = _two(spark, d)
    return joins.session_join(left, right, ["user_id"], "l_ts", "r_ts", "6 hours").select("l_id", "r_id")


@_query(f"SELECT l_id, r_id FROM {_SIDES.format('ASOF LEFT')} ON l.user_id = r.user_id AND r.r_ts <= l.l_ts")
def _as_of_join(spark, d):
    left, right = _two(spark, d)
    return joins.as_of(left, right, ["user_id"], "l_ts", "r_ts", ["r_id"]).select("l_id", "r_id")


# subqueries, sets, changes


@_query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
def _exists(spark, d):
    return relations.exists(_t(spark, d, "customer"), _t(spark, d, "orders").where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@_query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
def _not_exists(spark, d):
    return relations.not_exists(_t(spark, d, "customer"), _t(spark, d, "orders").where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@_query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def _in_subquery(spark, d):
    return relations.in_query(_t(spark, d, "part"), "p_partkey", _t(spark, d, "lineitem").where("l_quantity > 49"), "l_partkey").select("p_partkey")


@_query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def _not_in_subquery(spark, d):
    return relations.not_in_query(_t(spark, d, "part"), "p_partkey", _t(spark, d, "lineitem").where("l_quantity > 49"), "l_partkey").select("p_partkey")


@_query("SELECT event_id FROM events WHERE value > (SELECT avg(value) FROM events)")
def _scalar_subquery(spark, d):
    e = _t(spark, d, "events")
    return relations.with_scalar(e, e, F.avg("value"), "m").where("value > m").select("event_id")


@_query("SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def _correlated_subquery(spark, d):
    o = _t(spark, d, "orders")
    return o.join(o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m")), "o_custkey").where("o_totalprice > m").select("o_orderkey")


@_query("SELECT s_suppkey FROM supplier WHERE s_acctbal > ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = 3 AND c_acctbal < 5000)")
def _all_subquery(spark, d):
    c = _t(spark, d, "customer").where("c_nationkey = 3 AND c_acctbal < 5000")
    return relations.compare_all(_t(spark, d, "supplier"), "s_acctbal", ">", c, "c_acctbal").select("s_suppkey")


@_query("SELECT o_orderkey FROM orders WHERE o_totalprice / 50 < ANY (SELECT c_acctbal FROM customer WHERE c_nationkey = 3)")
def _any_subquery(spark, d):
    c = _t(spark, d, "customer").where("c_nationkey = 3")
    o = _t(spark, d, "orders").withColumn("part", F.col("o_totalprice") / 50)
    return relations.compare_any(o, "part", "<", c, "c_acctbal").select("o_orderkey")


@_query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
def _union(spark, d):
    return _t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(_t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()


@_query("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000")
def _except(spark, d):
    return _t(spark, d, "orders").select(F.col("o_custkey").alias("k")).subtract(_t(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k")))


@_query("SELECT user_id AS k FROM events INTERSECT SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000")
def _intersect(spark, d):
    return _t(spark, d, "events").select(F.col("user_id").alias("k")).intersect(_t(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k")))


@_query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_nationkey <> 7")
def _upsert_update_delete(spark, d):
    table = _t(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    changes = table.where("s_acctbal < 0").withColumn("s_acctbal", F.lit(-1.0))
    merged = relations.upsert(table, changes, ["s_suppkey"])
    merged = relations.update(merged, {"s_acctbal": F.lit(0.0)}, F.col("s_acctbal") == -1.0)
    return relations.delete(merged, F.col("s_nationkey") == 7).drop("s_nationkey")


# the dialect's text

_dialect(
    "sql_tumbling",
    "SELECT event_type, TUMBLE_START() AS w_start, COUNT(*) AS n, ROUND(AVG(value), 6) AS avg_value FROM events GROUP BY event_type WINDOW TUMBLING(ts, 1h) HAVING COUNT(*) > 2 EMIT FINAL",
    f"SELECT event_type, epoch_ms(time_bucket(INTERVAL '1 hour', ts)) AS w_start, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY event_type, time_bucket(INTERVAL '1 hour', ts) HAVING count(*) > 2",
)
_dialect("sql_session", "SELECT user_id, COUNT(*) AS n, _WINDOW_START AS s FROM events GROUP BY user_id WINDOW SESSION(6h) EMIT FINAL", _SQL["session_six_hours"].replace("SELECT min(ts) AS window_start, max(ts) + INTERVAL '6 hours' AS window_end, user_id, count(*) AS n", "SELECT user_id, count(*) AS n, CAST(floor(epoch_us(min(ts)) / 1000) AS BIGINT) AS s"))
_dialect(
    "sql_row_buffer",
    "SELECT event_id, LAG(value, 1) OVER (ROWS WINDOW BUFFER 10 ROWS PARTITION BY user_id ORDER BY ts) AS prev, ROUND(AVG(value) OVER (ROWS WINDOW BUFFER 10 ROWS PARTITION BY user_id ORDER BY ts EMIT EVERY RECORD), 6) AS mean FROM events EMIT CHANGES",
    "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS prev, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean FROM events",
)

@_query("SELECT event_id, CAST(dayofweek(ts) AS INTEGER) AS dow, strftime(ts, '%Y-%m') AS ym, CAST(date_diff('month', make_timestamp(1700000000000000), ts) AS INTEGER) AS months, props->>'$.k' AS k, regexp_replace(event_type, '[aeiou]', '#') AS rr, CAST(length(event_type) AS INTEGER) AS n FROM events")
def _sql_functions(spark, sf_dir):
    engine = Engine(spark, "ts")
    engine.register("events", _t(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))))
    return engine.sql("SELECT event_id, EXTRACT(DOW FROM ms) AS dow, DATE_FORMAT(ms, '%Y-%m') AS ym, DATEDIFF('months', 1700000000000, ms) AS months, JSON_VALUE(props, '$.k') AS k, REGEXP_REPLACE(event_type, '[aeiou]', '#') AS rr, LEN(event_type) AS n FROM events")


_dialect("sql_all", "SELECT s_suppkey FROM supplier WHERE s_acctbal > ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = 3 AND c_acctbal < 5000)", _SQL["all_subquery"], ("supplier", "customer"))
_dialect("sql_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier", _SQL["union"], ("customer", "supplier"))
_dialect("sql_within", "SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id WITHIN 10m WHERE a.event_id < b.event_id", "SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 10 MINUTE AND a.ts + INTERVAL 10 MINUTE WHERE a.event_id < b.event_id")


_ORDERED = "OVER (ROWS WINDOW BUFFER 10 ROWS PARTITION BY user_id ORDER BY ts {})"
_dialect("sql_buffer_full", f"SELECT event_id, MAX(value) {_ORDERED.format('EMIT ON BUFFER FULL')} AS top FROM events WHERE event_type <> 'view'", "SELECT event_id, top FROM (SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS top, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE event_type <> 'view') WHERE n >= 10")
_dialect(
    "sql_buffer_expiry",
    "SELECT event_id, COUNT(*) " + _ORDERED.format("EXPIRE AFTER INTERVAL '12' HOUR INACTIVITY") + " AS held, LAG(value, 1) " + _ORDERED.format("EXPIRE AFTER INTERVAL '12' HOUR INACTIVITY") + " AS prev FROM events",
    """WITH a AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '12 hours' THEN 1 ELSE 0 END AS f FROM events),
    b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
    SELECT event_id, count(*) OVER (PARTITION BY user_id, s ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS held, lag(value) OVER (PARTITION BY user_id, s ORDER BY ts) AS prev FROM b""",
)
_dialect("sql_join_subquery", "SELECT c.c_custkey, t.most FROM customer c JOIN (SELECT o_custkey, MAX(o_totalprice) AS most FROM orders GROUP BY o_custkey) t ON c.c_custkey = t.o_custkey WHERE c.c_name <> 'into nowhere'", "SELECT c_custkey, max(o_totalprice) AS most FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1", ("customer", "orders"))
_dialect("sql_any", "SELECT s_suppkey FROM supplier WHERE s_acctbal < ANY (SELECT c_acctbal FROM customer WHERE c_nationkey = 3) AND s_nationkey = ANY (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)", "SELECT s_suppkey FROM supplier WHERE s_acctbal < ANY (SELECT c_acctbal FROM customer WHERE c_nationkey = 3) AND s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)", ("supplier", "customer"))
_dialect("sql_all_with_nulls", "SELECT s_suppkey, s_acctbal > ALL (SELECT NULLIF(c_acctbal, 0) FROM customer WHERE c_acctbal < -900) AS every_one, s_acctbal > ALL (SELECT CASE WHEN c_acctbal < -950 THEN c_acctbal END FROM customer WHERE c_acctbal < -900) AS unknown FROM supplier", "SELECT s_suppkey, s_acctbal > ALL (SELECT nullif(c_acctbal, 0) FROM customer WHERE c_acctbal < -900) AS every_one, s_acctbal > ALL (SELECT CASE WHEN c_acctbal < -950 THEN c_acctbal END FROM customer WHERE c_acctbal < -900) AS unknown FROM supplier", ("supplier", "customer"))
_dialect("sql_cte", "WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING SUM(o_totalprice) > 500000), named AS (SELECT c.c_name, b.total FROM customer c JOIN big b ON c.c_custkey = b.o_custkey) SELECT c_name, ROUND(total, 2) AS total FROM named", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 500000) SELECT c_name, round(total, 2) AS total FROM customer JOIN big ON c_custkey = o_custkey", ("orders", "customer"))
_dialect("sql_recursive", "WITH RECURSIVE n(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM n WHERE k < 25) SELECT n.k, s.s_suppkey FROM n JOIN supplier s ON s.s_nationkey = n.k", "SELECT s_nationkey AS k, s_suppkey FROM supplier WHERE s_nationkey BETWEEN 1 AND 25", ("supplier",))
_dialect("sql_hopping", "SELECT event_type, _WINDOW_START AS w, COUNT(*) AS n FROM events GROUP BY event_type WINDOW HOPPING(ts, 6h, 1h) EMIT FINAL", """SELECT event_type, epoch_ms(w) AS w, count(*) AS n FROM (SELECT *, unnest([time_bucket(INTERVAL '1 hour', ts) - k * INTERVAL '1 hour' FOR k IN range(6)]) AS w FROM events) GROUP BY 1, 2""")
_dialect("sql_session_key", "SELECT COUNT(*) AS n, _WINDOW_START AS s FROM events WINDOW SESSION(ts, 6h, user_id) EMIT FINAL", _SQL["sql_session"].replace("SELECT user_id, count(*)", "SELECT count(*)"))
_dialect("sql_window_no_keys", "SELECT TUMBLE_START() AS s, TUMBLE_END() AS e, COUNT(*) AS n, MAX(value) AS top FROM events WINDOW TUMBLING(ts, 1d) HAVING COUNT(*) > 1 ORDER BY top DESC, s LIMIT 12", "SELECT epoch_ms(time_bucket(INTERVAL '1 day', ts)) AS s, epoch_ms(time_bucket(INTERVAL '1 day', ts)) + 86400000 AS e, count(*) AS n, max(value) AS top FROM events GROUP BY time_bucket(INTERVAL '1 day', ts) HAVING count(*) > 1 ORDER BY top DESC, s LIMIT 12")
_dialect("sql_window_in_derived", "SELECT t.event_type, MAX(t.n) AS most FROM (SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type WINDOW TUMBLING(ts, 1h)) t GROUP BY t.event_type", "SELECT event_type, max(n) AS most FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type, time_bucket(INTERVAL '1 hour', ts)) GROUP BY 1")
_dialect("sql_sets", "SELECT user_id AS k FROM events INTERSECT SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 250000", "(SELECT user_id AS k FROM events INTERSECT SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) EXCEPT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 250000", ("events", "customer", "orders"))
_dialect("sql_lateral_alias", "SELECT event_id, value * 2 AS twice, twice + 1 AS more FROM events WHERE value > 1e1", "SELECT event_id, value * 2 AS twice, value * 2 + 1 AS more FROM events WHERE value > 10")
_dialect("sql_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", ("orders",))
_dialect("sql_no_from", "SELECT 1 AS a, 'x' || 'y' AS b, GREATEST(2, 3) AS c", "SELECT 1 AS a, 'xy' AS b, 3 AS c", ())
_dialect("sql_default_frame", "SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts), 4) AS so_far FROM events", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts), 4) AS so_far FROM events")
_dialect("sql_percentiles", "SELECT event_type, ROUND(PERCENTILE_CONT(value, 0.9), 6) AS p90, PERCENTILE_DISC(value, 0.25) AS d25, ROUND(PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY value), 6) AS med FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p90, quantile_disc(value, 0.25) AS d25, round(median(value), 6) AS med FROM events GROUP BY 1")
_dialect("sql_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = part.p_partkey)", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = part.p_partkey)", ("part", "lineitem", "supplier"))
_dialect(
    "sql_strings",
    r"SELECT p_partkey, LTRIM(CONCAT('  ', p_name)) AS l, RTRIM(CONCAT(p_name, ' ')) AS r, TRIM(CONCAT(' ', p_name, ' ')) AS t, JOIN('-', p_brand, p_type) AS j, REGEXP(p_brand, '\d') AS digit, REGEXP_REPLACE(p_type, '([A-Z]+) ', '<$1>') AS first_word, STRUCT('a', p_size).a AS s, MAP_VALUES(MAP('k', p_size))[0] AS m, SQRT(p_size) AS root FROM part".replace("\\\\", "\\"),
    r"SELECT p_partkey, p_name AS l, p_name AS r, p_name AS t, p_brand || '-' || p_type AS j, regexp_matches(p_brand, '\d') AS digit, regexp_replace(p_type, '([A-Z]+) ', '<\1>') AS first_word, p_size AS s, p_size AS m, sqrt(p_size) AS root FROM part".replace("\\\\", "\\"),
    ("part",),
)


def _engine_query(name: str, sql: str, tables: tuple[str, ...], *texts: str, params: tuple = ()) -> None:
    """The last of several statements."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, "ts")
        for t in tables:
            engine.register(t, _t(spark, sf_dir, t), t not in ("events",), None)
        for text in texts[:-1]:
            engine.sql(text)
        return engine.sql(texts[-1], params)

    _QUERIES[name] = run
    _SQL[name] = sql


_engine_query("sql_parameters", "SELECT event_id FROM events WHERE event_type = 'click' AND value > 100", ("events",), "SELECT event_id FROM events WHERE event_type = $1 AND value > $2", params=("click", 100))
_engine_query("sql_insert_select", "SELECT s_suppkey AS k, s_name AS n FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0 UNION ALL SELECT -1, 'none'", ("supplier", "customer"), "SELECT s_suppkey AS k, s_name AS n INTO people FROM supplier", "INSERT INTO people SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0", "INSERT INTO people VALUES (-1, 'none')", "SELECT k, n FROM people")
_engine_query("sql_update_delete", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_nationkey <> 7", ("supplier",), "UPDATE supplier SET s_acctbal = 0 WHERE s_acctbal < 0", "DELETE FROM supplier WHERE s_nationkey = 7", "SELECT s_suppkey, s_acctbal FROM supplier")
_engine_query("sql_create_table_keyed", "SELECT user_id, arg_max(value, ts) AS value FROM events GROUP BY 1", ("events",), "CREATE TABLE latest AS SELECT user_id PRIMARY KEY, ts, value FROM events", "SELECT user_id, value FROM latest")
_engine_query("sql_create_stream", "SELECT event_id, value FROM events WHERE value > 200", ("events",), "CREATE STREAM big AS SELECT event_id, value FROM events WHERE value > 200", "SELECT * FROM big")
_engine_query("sql_start_job", "SELECT event_type, count(*) AS n FROM events GROUP BY 1", ("events",), "START JOB counts AS SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type", "PAUSE JOB counts", "RESUME JOB counts", "SELECT * FROM counts")
_engine_query("sql_show", "SELECT * FROM (VALUES ('customer', 'table'), ('supplier', 'table')) t(name, value)", ("supplier", "customer"), "SHOW TABLES")
_engine_query("sql_describe", "SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string')) t(name, value)", ("region",), "SHOW SCHEMA region")


# functions and sources beyond the ones above


@_query("SELECT event_id, event_type AS kind, true AS has, false AS none, 'kind,user' AS keys, 'new' AS changed, 1 AS left_over FROM events")
def _headers(spark, d):
    df = _t(spark, d, "events").withColumn("_headers", F.create_map(F.lit("kind"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")))
    return df.select("event_id", S.scalar("HEADER", "kind").alias("kind"), S.scalar("HAS_HEADER", "user").alias("has"), S.scalar("HAS_HEADER", "x").alias("none"), S.scalar("HEADER_KEYS").alias("keys"), S.scalar("SET_HEADER", "kind", "new")["kind"].alias("changed"), F.size(S.scalar("REMOVE_HEADER", "kind")).alias("left_over"))


@_query("SELECT event_id, event_type AS kind, 'new' AS changed, 1 AS left_over FROM events")
def _sql_headers(spark, d):
    engine = Engine(spark, "ts")
    engine.register("events", _t(spark, d, "events").withColumn("_headers", F.create_map(F.lit("kind"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))))
    return engine.sql("SELECT event_id, HEADER('kind') AS kind, SET_HEADER('kind', 'new')['kind'] AS changed, CARDINALITY(REMOVE_HEADER('kind')) AS left_over FROM events")


@_query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS secs, date_trunc('second', ts) AS back, epoch_ms(time_bucket(INTERVAL '1 hour', ts)) + 3600000 AS w_end, props->'$.k' AS raw, event_type || '/' || CAST(user_id AS VARCHAR) AS joined, user_id AS field FROM events")
def _more_functions(spark, d):
    ts = F.col("ts").cast("timestamp")
    secs = S.scalar("UNIX_TIMESTAMP", ts)
    df = _t(spark, d, "events").withColumn("window", F.window("ts", "1 hour"))
    return df.select("event_id", secs.alias("secs"), S.scalar("FROM_UNIXTIME", secs).alias("back"), S.scalar("TUMBLE_END").alias("w_end"), S.scalar("JSON_EXTRACT", F.col("props"), "$.k").alias("raw"), S.scalar("JOIN", "/", F.col("event_type"), F.col("user_id")).alias("joined"), S.scalar("STRUCT", "a", F.col("user_id"))["a"].alias("field"))


@_query("SELECT event_id, event_type AS v, '{\"a\":' || user_id || '}' AS obj, NULL AS nothing FROM events")
def _json_query(spark, d):
    j = F.concat(F.lit('{"o":{"a":'), F.col("user_id"), F.lit('},"v":1}'))
    return _t(spark, d, "events").select("event_id", S.scalar("MAP_VALUES", S.scalar("MAP", "t", F.col("event_type")))[0].alias("v"), S.scalar("JSON_QUERY", j, "$.o").alias("obj"), S.scalar("JSON_QUERY", j, "$.v").alias("nothing"))


@_query("SELECT event_type, true AS close FROM events GROUP BY 1")
def _approx_count_distinct(spark, d):
    near = F.abs(aggregate("APPROX_COUNT_DISTINCT", "user_id") - aggregate("COUNT_DISTINCT", "user_id")) <= 0.15 * aggregate("COUNT_DISTINCT", "user_id")
    return _t(spark, d, "events").groupBy("event_type").agg(near.alias("close"))


@_query("SELECT user_id, string_agg(event_type, '|' ORDER BY ts) AS kinds FROM events GROUP BY 1")
def _string_agg(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(aggregate("STRING_AGG", F.col("event_type"), F.col("ts"), "|").alias("kinds"))


@_query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _cube(spark, d):
    return _t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@_query("SELECT c_custkey, v AS value FROM (SELECT c_custkey, c_acctbal AS v FROM customer UNION ALL SELECT c_custkey, CAST(c_nationkey AS DOUBLE) FROM customer) WHERE v > 15")
def _table_wildcard(spark, d):
    leg = lambda c: F.struct(F.col(c).cast("double").alias("price"))
    df = _t(spark, d, "customer").select("c_custkey", F.struct(leg("c_acctbal").alias("a"), leg("c_nationkey").alias("b")).alias("legs"))
    return tables.Table(df, ["c_custkey"]).wildcard("legs.*.price", "> 15").withColumn("value", F.col("value").cast("double"))


@_query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def _table_bulk_lookup(spark, d):
    table = tables.Table(_t(spark, d, "customer"), ["c_custkey"])
    return table.bulk(_t(spark, d, "events").select(F.col("user_id").alias("c_custkey"))).select("c_custkey", "c_name")


def _sides(df: DataFrame, op: str) -> DataFrame:
    return df.select(F.to_json(F.struct(F.struct(F.lit(op).alias("op"), F.lit(None).cast("struct<s_suppkey: bigint, s_name: string>").alias("before"), F.struct("s_suppkey", "s_name").alias("after")).alias("payload"))).alias("raw"))


@_query("SELECT 'u' AS op, s_suppkey, s_name FROM supplier")
def _debezium(spark, d):
    return adapters.debezium(_sides(_t(spark, d, "supplier"), "u"), "raw", "s_suppkey: bigint, s_name: string")


@_query("SELECT 'c' AS op, s_suppkey, s_name FROM supplier")
def _maxwell(spark, d):
    raw = _t(spark, d, "supplier").select(F.to_json(F.struct(F.lit("insert").alias("type"), F.struct("s_suppkey", "s_name").alias("data"))).alias("raw"))
    return adapters.maxwell(raw, "raw", "s_suppkey: bigint, s_name: string")


@_query("SELECT user_id, value FROM events WHERE event_type <> 'error'")
def _dead_letters(spark, d):
    good = F.to_json(F.struct("user_id", "value"))
    raw = _t(spark, d, "events").select(F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(good).alias("raw"))
    return adapters.split_bad(raw, "raw", "user_id bigint, value double")[0]


@_query("SELECT event_id, ts AS t FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'")
def _late_rows(spark, d):
    df = adapters.event_time(_t(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).select("event_id", (F.col("us") / 1_000_000).alias("secs"), "us"), "secs", "epoch_seconds")
    kept, _ = split_late(df.withColumn("t", F.timestamp_micros("us")), "t", F.lit("2024-01-10").cast("timestamp"))
    return kept.select("event_id", "t")


def _file_query(kind: str, sql: str, options: dict[str, str], select: list[str], table: str, schema: str | None = None) -> None:
    """A table written as files of a kind by the sink and read by the source."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch(spark, kind)
        adapters.write(_t(spark, sf_dir, table).select(*select), "file_sink", path, options)
        return adapters.bind(spark, {"type": "file_source", "path": path, **options, **({"schema": schema} if schema else {})}).select(*select)

    _QUERIES[f"file_{kind}"] = run
    _SQL[f"file_{kind}"] = sql


_SUPPLIER = "SELECT s_suppkey, s_name, s_acctbal FROM supplier"
_file_query("csv", _SUPPLIER, {"format": "csv", "header": "true"}, ["s_suppkey", "s_name", "s_acctbal"], "supplier", "s_suppkey long, s_name string, s_acctbal double")
_file_query("json", _SUPPLIER, {"format": "json", "compression": "gzip"}, ["s_suppkey", "s_name", "s_acctbal"], "supplier")
_file_query("parquet", _SUPPLIER, {"format": "parquet", "compression": "zstd", "rotate.records": "50"}, ["s_suppkey", "s_name", "s_acctbal"], "supplier")
_file_query("orc", _SUPPLIER, {"format": "orc"}, ["s_suppkey", "s_name", "s_acctbal"], "supplier")


# the same operators over unbounded inputs, run until what is there is done


def _arrive(events: DataFrame, source: str) -> None:
    """Three files in the order of time, rows without a time last, as files are read in the order in which they were written."""
    time = F.unix_micros("ts")
    first, last = events.agg(F.min(time), F.max(time)).first()
    third = ((last or 0) - (first or 0)) // 3
    late = F.coalesce((time > F.lit((first or 0) + third)).cast("int") + (time > F.lit((first or 0) + 2 * third)).cast("int"), F.lit(2))
    for part in range(3):
        events.where(late == part).coalesce(1).write.mode("append").parquet(source)


def _streamed(spark: SparkSession, d: str, make: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Rows that a query over the events as a stream of files writes."""
    source, out, checkpoint = (scratch(spark, n) for n in ("stream-in", "stream-out", "stream-checkpoint"))
    events = _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    _arrive(events, source)
    made = make(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source))
    if mode == "append":
        writer = made.writeStream.format("parquet").option("path", out)
    else:  # each batch as a version of its own
        writer = made.writeStream.outputMode(mode).foreachBatch(lambda batch, n: batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/b={n}"))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    schema = made.schema if mode == "append" else made.withColumn("_batch", F.lit(0)).schema
    return spark.read.schema(schema).parquet(out if mode == "append" else f"{out}/*")


@_query("SELECT event_id, lag(value) OVER w AS lag_value, round(avg(value) OVER b, 6) AS avg_value, min(value) OVER b AS min_value, max(value) OVER b AS max_value, CAST(count(*) OVER b AS DOUBLE) AS n_rows FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts), b AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def _stream_row_buffer(spark, d):
    out = _streamed(spark, d, lambda s: row_buffer(s.select("event_id", "user_id", "ts", "value"), ["user_id"], "ts", "value", 5))
    return out.drop("user_id", "ts", "value").withColumn("avg_value", F.round("avg_value", 6))


@_query("SELECT event_type, count(*) AS n, epoch_ms(time_bucket(INTERVAL '1 day', ts)) AS w FROM events GROUP BY 1, 3")
def _stream_emit_changes(spark, d):
    """The last correction of each window."""

    def make(stream: DataFrame) -> DataFrame:
        engine = Engine(spark, "ts")
        engine.register("s", stream)
        return engine.sql("SELECT event_type, _WINDOW_START AS w, COUNT(*) AS n FROM s GROUP BY event_type WINDOW TUMBLING(ts, 1d) EMIT CHANGES")

    return _streamed(spark, d, make, "update").groupBy("event_type", "w").agg(F.max_by("n", "_batch").alias("n"))


@_query("WITH t AS (SELECT event_type, count(*) AS n, time_bucket(INTERVAL '1 day', ts) AS w FROM events GROUP BY 1, 3) SELECT event_type, n, epoch_ms(w) AS w FROM t WHERE w + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '12 hours' FROM events)")
def _stream_emit_final(spark, d):
    """Windows that the watermark, half a window behind, has passed."""

    def make(stream: DataFrame) -> DataFrame:
        engine = Engine(spark, "ts")
        engine.register("s", stream)
        return engine.sql("SELECT event_type, _WINDOW_START AS w, COUNT(*) AS n FROM s GROUP BY event_type WINDOW TUMBLING(ts, 1d) EMIT FINAL")

    return _streamed(spark, d, make)


@_query(_SQL["interval_join"])
def _stream_interval_join(spark, d):
    def make(stream: DataFrame) -> DataFrame:
        side = lambda kind, p: stream.where(F.col("event_type") == kind).select(F.col("event_id").alias(f"{p}_id"), F.col("user_id").alias(f"{p}_user"), F.col("ts").alias(f"{p}_ts")).withWatermark(f"{p}_ts", "1 day")
        return joins.interval_join(side("click", "l"), side("purchase", "r"), F.col("l_user") == F.col("r_user"), "l_ts", "r_ts", "-1 HOUR", "6 HOUR").select("l_id", "r_id")

    return _streamed(spark, d, make)


@_query("SELECT user_id, arg_max(value, ts) AS value FROM events GROUP BY 1")
def _stream_keyed_table(spark, d):
    source, path, checkpoint = (scratch(spark, n) for n in ("stream-in", "keyed", "stream-checkpoint"))
    events = _t(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    _arrive(events, source)
    keyed_table(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source), path, ["user_id"], "ts", checkpoint).awaitTermination()
    return read_keyed(spark, path, events.schema).select("user_id", "value")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
