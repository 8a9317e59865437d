"""Connected components by alternating large and small stars, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A node of more edges than this, and than a SHARE-th of all, is dealt by SALTS of its neighbours; there are at most
#: 2 x SHARE such nodes, whose numbers are sent to every executor.
HOT, SHARE, SALTS = 256, 5000, 64


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)), F.sum(F.xxhash64("v", "u") % F.lit(1 << 40))).first())


def _with_least(edges: DataFrame, key: str, other: str, least: DataFrame, bound: int) -> DataFrame:
    """edges with m, the least node around key; least has (u, m, n). A node with more than bound edges meets its row in
    SALTS places instead of one."""
    hot = F.broadcast(least.where(F.col("n") > bound).select(F.col("u").alias(key), F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(other), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    dealt = edges.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    copies = F.sequence(F.lit(0).cast("long"), F.when(F.col("n") > bound, F.lit(SALTS - 1)).otherwise(F.lit(0)).cast("long"))
    return dealt.join(least.select(F.col("u").alias(key), "m", F.explode(copies).alias("_salt")), [key, "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) to (node, root): root is the least node that node is linked with, for each node on an edge.

    Loops and repeated edges do no harm; null ends must not occur. An empty table gives no rows. The least neighbour of a
    node is an aggregate that is combined before it is shuffled; it goes back to the edges by a join in which nodes with
    very many edges are salted, so the root of a large component isn't one task's. Each round's edges are written to the
    shared folder, so lineage stays short; the driver sees three numbers a round. The number of rounds grows with the
    logarithm of the longest chain.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        bound = max(HOT, state[0] // SHARE)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        # large star: larger neighbours of v go to the least one around v
        large = _with_least(now, "v", "u", least, bound).select("u", F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct())
        # small star: smaller neighbours of u, and u itself, go to the least of them
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = _with_least(large, "u", "v", least, bound).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        before, state, now = state, _state(new), new
        if state == before:
            break
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
