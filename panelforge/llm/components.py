"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


#: Bytes of a table with a row for each node up to which it is broadcast.
SMALL = 16 << 20


def _mark(edges: DataFrame) -> tuple:
    """What tells whether a step has changed the links, in one row."""
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); a component is named by
    its smallest node.  Every step is a minimum for each node joined back; the steps
    follow the logarithm of the longest path.  A node with very many links is only
    ever joined with one row, so its links are split like any skewed join."""
    edges = store(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        small = 32 * mark[0] <= SMALL  # a row for each node at most: counted, so it may be broadcast

        def per_node(df: DataFrame) -> DataFrame:
            return F.broadcast(df) if small else df

        # Large star: the greater neighbours of a node are linked with the least of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(per_node(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: the lesser neighbours and the node itself are linked with the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        turned = large.join(per_node(low), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = store(turned.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "stars")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
