"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_tables, materialize


def _with_least(rows: DataFrame, made: list[str]) -> DataFrame:
    """Rows (a, b) with m, the least of a and its b's.  The least are a written table, so that both sides of the join are
    plain shuffles and the adaptive planner may split a node that very many rows share."""
    least = materialize(rows.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least", made)
    return rows.join(least, "a")


def _large_star(edges: DataFrame, made: list[str]) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, made).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, made: list[str]) -> DataFrame:
    down = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "stars", made)
    joined = _with_least(down, made)
    own = joined.select("a", F.col("m").alias("b"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: bigint): component is the least node reachable.

    Alternating large-star and small-star rounds: each is one aggregation with partial sums and one join on the node,
    which the adaptive planner splits where a node is hot; rounds go on until the links
    are stars, and their number grows with the logarithm of the size.
    """
    spark, made = edges.sparkSession, []
    now = materialize(edges.where("a <> b").select("a", "b").distinct(), "links", made)
    while True:
        old, made = made, []
        now = materialize(_small_star(_large_star(now, old), old), "stars", made)
        drop_tables(spark, old)
        # done when every node hangs on one root, and no root hangs on any
        degrees = now.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        if degrees.where("n > 1").isEmpty() and degrees.join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
