"""Connected components over a link table, by alternating large-star and small-star rounds.

Every round is two small plans on the remaining links; links shrink to stars, so the number of
rounds grows with the logarithm of the longest path. A node's links are dealt by the node and a
salt from their other end: a hot node's links are in as many tasks as there are salts, its minimum
meets one row for each, and only these are joined with the links. No links go to the driver, not
even for a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import durable


#: Parts of a node's links.
SALTS = 64


def _flipped(links: DataFrame) -> DataFrame:
    return links.select(F.col("b").alias("a"), F.col("a").alias("b"))


def _with_least(links: DataFrame, own: bool) -> DataFrame:
    """(a, b, m): every link with the least neighbour of ``a``, ``a`` included if ``own``."""
    salted = links.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    parts = salted.groupBy("a", "salt").agg(F.min("b").alias("m"))
    least = parts.groupBy("a").agg((F.least(F.min("m"), F.col("a")) if own else F.min("m")).alias("m"))
    told = parts.select("a", "salt").hint("merge").join(least, "a")
    return salted.hint("merge").join(told, ["a", "salt"]).select("a", "b", "m")


def _large_star(links: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to its least neighbour (itself included)."""
    met = _with_least(links.union(_flipped(links)), own=True)
    return met.where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node sends itself and its smaller neighbours to the least of them; links have a > b."""
    met = _with_least(links, own=False)
    return met.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()


def _are_stars(links: DataFrame) -> bool:
    """No node has two links up, or links both up and down."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``: root is the smallest node it reaches.

    Nodes are longs. Self-links and repeated links are allowed, an empty table gives an empty one.
    """
    links = durable(links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(links):
        links = durable(_small_star(durable(_large_star(links))))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
