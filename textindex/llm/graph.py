"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textindex.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node that ``(src, dst)`` edges lead to.

    Large-star and small-star steps in turn, until nothing changes; every step
    links a node's neighbours to the smallest of them, which is an aggregate and
    a join on the node, and never holds a component together.
    """
    now = materialize(edges.filter("src <> dst").select("src", "dst").distinct(), "edges")
    while True:
        both = now.union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        # written before the join, whose two sides then are plain shuffles that
        # Spark splits where one node has very many neighbours
        least = materialize(both.groupBy("src").agg(F.min(F.least("src", "dst")).alias("m")), "least")
        large = materialize(
            both.join(least, "src").filter(F.col("dst") > F.col("src"))
            .select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct(), "edges")
        least = materialize(large.groupBy("src").agg(F.min("dst").alias("m")), "least")
        now = materialize(
            large.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
            .filter("src <> dst").union(least.select("src", F.col("m").alias("dst"))).distinct(), "edges")
        # done once these are stars: every node leads to one other, which leads nowhere
        several = now.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("src")
        onward = now.select(F.col("dst").alias("src")).join(now, "src", "left_semi").select("src")
        if several.union(onward).isEmpty():
            break
    return (now.select(F.col("src").alias("node"), F.col("dst").alias("label"))
            .union(now.select(F.col("dst").alias("node"), F.col("dst").alias("label")).distinct()))
