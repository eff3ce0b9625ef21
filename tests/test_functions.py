import pytest
from pyspark.sql import functions as F

from sluice.functions import scalar as S


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()[0]


def test_strftime_quotes_text():
    assert S.strftime_pattern("%Y at %H:%M") == "yyyy' at 'HH:mm"
    with pytest.raises(ValueError):
        S.strftime_pattern("%q")


def test_regexp_replace_first_and_flags(spark):
    text = F.lit("Banana")
    assert one(spark, S.regexp_replace_first(text, "an", "#")) == "B#ana"
    assert one(spark, S.regexp_replace_first(text, "AN", "#", "gi")) == "B##a"
    assert one(spark, S.regexp_replace_first(text, "x", "#")) == "Banana"
    assert one(spark, S.regexp_replace_first(F.lit(None).cast("string"), "x", "#")) is None


def test_datediff_counts_boundaries(spark):
    a, b = F.lit(1703980799000), F.lit(1703980800000)  # the last second of a day and the next
    assert one(spark, S.datediff("days", a, b)) == 1
    assert one(spark, S.datediff("hours", a, b)) == 0
    assert one(spark, S.datediff("years", F.lit(1672531199000), F.lit(1672531200000))) == 1


def test_json(spark):
    j = F.lit('{"a": [{"b": 1}], "n": null}')
    assert one(spark, S.scalar("JSON_EXTRACT", j, "$.a.0.b")) == "1"
    assert one(spark, S.scalar("JSON_EXISTS", j, "$.n")) is True
    assert one(spark, S.scalar("JSON_EXISTS", F.lit("{bad"), "$.n")) is False
    assert one(spark, S.scalar("JSON_QUERY", j, "$.a")) == '[{"b":1}]'
    assert one(spark, S.scalar("JSON_QUERY", j, "$.a.0.b")) is None


def test_null_skipping_and_bounds(spark):
    assert one(spark, S.scalar("CONCAT", F.lit("a"), F.lit(None).cast("string"), F.lit(1))) == "a1"
    assert one(spark, S.scalar("SPLIT_PART", F.lit("a,b"), ",", 0)) == ""
    assert one(spark, S.scalar("SPLIT_PART", F.lit("a,b"), ",", 5)) == ""
    assert one(spark, S.scalar("SUBSTRING", F.lit("hello"), 0, 2)) == "he"
    assert one(spark, S.scalar("GREATEST", F.lit(1), F.lit(None).cast("int"))) == 1
    assert one(spark, S.divide_or_one(F.lit(3), F.lit(0))) == 1.0
    assert one(spark, S.scalar("TRIM", F.lit("\t a b \n"))) == "a b"


def test_headers(spark):
    df = spark.range(1).select(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")).alias("_headers"))
    row = df.select(S.scalar("HEADER", "a").alias("x"), S.scalar("HAS_HEADER", "z").alias("y"), S.scalar("SET_HEADER", "a", "9").alias("s"), S.scalar("REMOVE_HEADER", "b").alias("r"), S.scalar("HEADER_KEYS").alias("k")).first()
    assert (row.x, row.y, row.s, row.r, row.k) == ("1", False, {"b": "2", "a": "9"}, {"a": "1"}, "a,b")


def test_unknown(spark):
    with pytest.raises(KeyError):
        S.scalar("NO_SUCH")
