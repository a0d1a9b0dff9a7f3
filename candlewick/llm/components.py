"""Connected components of a graph given as a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.chunks import written


def _larger_to_least(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours, and the node itself, are linked to the least of its neighbourhood."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()


def _smaller_to_least(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node itself, are linked to the least of them. In links, a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    return links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Columns node, component (the least node that links reach), for each node of links (integer columns a, b).

    Links go from each node to the least one it knows, in turns of larger and smaller neighbours, until they are stars;
    each turn is written to the shared folder. A link is 16 bytes; the joins meet no other key than nodes, one row each on
    one side, so adaptive execution can split the links of a hot node over tasks, and the minima are pre-aggregated.
    """
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        links = written(_smaller_to_least(_larger_to_least(links)), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
        before = now
