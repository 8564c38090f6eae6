"""Connected components of a link table by alternating stars, on Spark alone."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import stage


def both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def large_star(links: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is tied to the node's least neighbour or itself."""
    sides = both_ways(links)
    least = sides.groupBy("a").agg(F.min("b").alias("m"))
    # written, so that the join sees two plain inputs and can split a node of many links
    least = stage(least.select(F.col("a").alias("n"), F.least("a", "m").alias("m")), "least")
    return (sides.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("n"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where(F.col("a") != F.col("b")).distinct())


def small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stage(down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "least")
    tied = down.join(least, F.col("a") == F.col("n")).select(
        F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return tied.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): least node of the component, for every node of a link table (a, b).

    Each round is written to the shared folder. Rounds end when no node's root changes, which
    takes about the square of the logarithm of the longest chain.
    """
    now = stage(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "links")
    before = None
    while True:
        now = stage(small_star(stage(large_star(now), "large-star")), "small-star")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
