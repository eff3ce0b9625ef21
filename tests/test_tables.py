import pytest
from pyspark.sql import functions as F

from sluice.operators.tables import Table, load_in_waves, routed, waves


@pytest.fixture
def table(spark):
    rows = [
        (1, {"a": {"price": 5.0}, "b": {"price": 150.0}}, {"price": 7.0, "deep": {"price": 9.0}}, [{"x": 1}, {"x": 2}]),
        (2, {}, None, None),
    ]
    return Table(spark.createDataFrame(rows, "id long, positions map<string, struct<price: double>>, s struct<price: double, deep: struct<price: double>>, arr array<struct<x: int>>"), ["id"])


def values(df):
    return sorted((r[0], r[1]) for r in df.collect())


def test_wildcards(table):
    assert values(table.wildcard("positions.*.price")) == [(1, "150.0"), (1, "5.0")]
    assert values(table.wildcard("positions.*.price", "> 100")) == [(1, "150.0")]
    assert values(table.wildcard("**.price")) == [(1, "150.0"), (1, "5.0"), (1, "7.0"), (1, "9.0")]
    assert values(table.wildcard("arr[*].x")) == [(1, "1"), (1, "2")]
    assert values(table.wildcard("arr[1].x")) == [(1, "2")]
    assert values(table.wildcard("s.*")) == [(1, "7.0"), (1, '{"price":9.0}')]
    assert values(table.wildcard("nothing.x")) == []
    assert [table.wildcard_aggregate(f, "positions.*.price") for f in ("COUNT", "SUM", "AVG", "MIN", "MAX")] == [2, 155.0, 77.5, 5.0, 150.0]


def test_lookups(table, spark):
    assert table.get(1).id == 1 and table.get(9) is None and table.contains(2) and not table.contains(3)
    assert table.count() == 2 and table.exists("id > 1") and not table.exists("id > 5")
    assert table.scalar("max(id)") == 2 and table.scalar("id", "id = 1") == 1 and table.scalar("id", "id = 7") is None
    with pytest.raises(ValueError):
        table.scalar("id")
    assert [r.id for r in table.bulk(spark.createDataFrame([(2,), (2,), (5,)], "id long")).collect()] == [2]
    assert [r.id for r in table.stream_filter("id < 2")] == [1] and len(list(table.stream_all())) == 2
    assert [r.id for r in table.batch(1, 1).collect()] == [2] and table.aggregate(F.sum("id"))[0] == 3


def test_waves():
    needs = {"a": [], "b": ["a"], "c": ["a", "there"], "d": ["b", "c"]}
    assert waves(needs) == [["a"], ["b", "c"], ["d"]]
    seen = []
    assert load_in_waves(needs, lambda n: seen.append(n) or n.upper()) == {n: n.upper() for n in needs} and seen[0] == "a" and seen[-1] == "d"
    with pytest.raises(ValueError):
        waves({"a": ["b"], "b": ["a"]})


def test_routing(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 5)
    assert routed(df, "fan_in").rdd.getNumPartitions() == 1 and routed(df, "round_robin", n=7).rdd.getNumPartitions() == 7
    assert routed(df, "sticky") is df and routed(df, "hash", ["k"], 6).rdd.getNumPartitions() == 6
    dealt = df.repartition(4, "k")
    assert routed(dealt, "smart", ["k"]) is dealt
