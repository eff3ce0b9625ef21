"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._common import discard, materialise, spread_join

#: The rounds needed grow with the logarithm of the longest chain.
MOST_ROUNDS = 60


def _least(rows: DataFrame) -> DataFrame:
    """Of each u the smallest v, and the number of rows. Pre-aggregated, so that a u of very many rows costs each task one."""
    return rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Each node links its larger neighbours to its smallest neighbour or itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).withColumn("m", F.least("m", "u"))
    return spread_join(both.where("v > u"), least, ["u"], "n", 2 * n_edges).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    linked = spread_join(down, least, ["u"], "n", n_edges).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """Columns node and component (the smallest node reachable) of each node that has an edge to another.

    Null ends and loops are ignored; an empty table gives an empty one. Both stars shuffle only pairs of node ids
    and pre-aggregate their minima; nodes of very many neighbours are joined by `spread_join`. A round is written to the
    shared folder, and the one before it is deleted.
    """
    now = materialise(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v"), "components")
    now, old = materialise(_large_star(now, now.count()), "components"), now
    seen = None
    for _ in range(MOST_ROUNDS):
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(old)
        if tuple(sign) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = tuple(sign)
        stars = materialise(_small_star(now, sign[0]), "components")
        discard(now)
        now, old = materialise(_large_star(stars, stars.count()), "components"), stars
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
