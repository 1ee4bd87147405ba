"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, materialise


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``edges(a, b)``: the smallest node it can reach.

    Alternates two star steps until nothing changes: every node's larger neighbours are tied to its smallest neighbour,
    then its smaller ones are. Each step is a partial minimum and a join that deals the rows of hubs to many tasks, and each
    round is written to the shared folder. The number of rounds grows with the logarithm of
    the longest path. Edges from a node to itself keep it in the result; rows with nulls are ignored.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null").distinct()
    links = materialise(links)
    before, total = None, links.count()
    while True:
        both = links.union(links.select("b", "a"))
        low = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = join_spread(both, "a", low, "v", "n", 2 * total, ["b"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # A smallest node's own ties to larger ones are among them: m is the node itself there.
        large = materialise(large.union(links.where("a = b")).distinct())
        low2 = large.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"), F.count("*").alias("n"))
        tied = join_spread(large, "a", low2, "v", "n", total, ["b"])
        small = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low2.select(F.col("v").alias("a"), F.col("m").alias("b")))
        links = materialise(small.distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, total = now, now[0]
    return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
