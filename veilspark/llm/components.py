"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import stored


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def connected_components(links: DataFrame) -> DataFrame:
    """The smallest node that each linked node can reach.

    ``links`` has two columns of the same ordered type, the ends of a link in any order. Returns
    ``(node, root)`` with one row per node of a link that isn't a self-link, roots included; nodes without
    such a link have none. Nulls at either end are ignored, repeated links count once, an empty table gives none.

    Each round joins every link with the smallest neighbour of one of its ends: neighbours are never gathered,
    the minimum is combined before the shuffle, and a hub's links are an ordinary skewed join. Each round is
    stored in the shared folder. The number of rounds grows with the logarithm of the number of nodes.
    """
    a, b = (F.col(c) for c in links.columns[:2])
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where((a != b) & a.isNotNull() & b.isNotNull())
    edges = stored(edges.distinct(), "links")
    before = _digest(edges)
    while before[0]:
        # Every neighbour above u is linked with the smallest of u and its neighbours.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # Every neighbour below u, and u itself, is linked with the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        after = _digest(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
