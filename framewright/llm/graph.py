"""Connected components by alternating large and small stars."""

from pyspark.sql import DataFrame, functions as F

from framewright.session import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of `edges` (two long columns): root is the smallest node reachable.

    Each round points the neighbours of a node at their smallest member, first the larger neighbours, then the smaller
    ones, until the edges are stars. Minima are combined before their shuffle, so a hub costs one row per task there, and
    the join that brings them back is an ordinary equi-join whose large partitions Spark splits. Rounds grow with the
    logarithm of the longest chain. Only two numbers per round reach the driver.
    """
    at = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = _digest(at)
    while before[0]:
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        pulled = large.join(small_low, "u")
        small = pulled.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        at = cut(small.unionByName(small_low.select("u", F.col("m").alias("v"))).distinct())
        now = _digest(at)
        if now == before:
            break
        before = now
    roots = at.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())
