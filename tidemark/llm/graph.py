"""Connected components of a table of links, in a few shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the least node of its component.

    Alternating large-star and small-star: each round links a node's neighbours to their least,
    so the number of rounds grows with the logarithm of the nodes. Minima are pre-aggregated and
    only they are joined back; a node with very many links never has them in one row.
    """
    edges = C.cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionAll(least.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(down.select("a", F.col("m").alias("b")))
        edges = C.cut(small.where("a <> b").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).collect()[0]
        if state == now:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b"), F.col("b"))).distinct()
