"""Connected components of links that no single machine could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyhue.llm.tables import staged


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of any type that can be ordered -> (node, root): each node of a link that isn't the smallest of its component, and that
    smallest one. No links: no rows.

    Two steps alternate until every link leads straight to a root. In the first, each node hands its larger neighbours to its smallest one; in
    the second, its smaller ones. A node's smallest neighbour is an aggregate, so a node with very many links is never one task's group; the
    join back splits such a node's links where adaptive execution finds them large. Each round is written down.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = larger.where("a <> b").distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = staged(small.where("a <> b").distinct())
        roots = edges.select("b").distinct().withColumn("middle", F.lit(1))
        left = edges.groupBy("a").agg(F.count("*").alias("n")).join(roots, F.col("a") == roots["b"], "left").where("n > 1 OR middle = 1")
        if left.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
