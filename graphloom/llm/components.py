"""Connected components on distributed edges, by alternating large-star and small-star rounds.

Every round is a minimum per node, pre-aggregated before its shuffle, and a join back to the edges; its result is written to
the shared folder, so lineage doesn't grow and lost executors cost no earlier round. Hubs are safe: no node's neighbours are
ever collected, and a hub's edges are split by adaptive skew joins. Rounds needed grow as the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node it is connected with.

    Loops, repeated edges and edges with a null end are harmless; the latter two add nothing, and a node that has only
    loops is its own root. No edges give no rows. Nodes may be of any ordered type.
    """
    given = edges.select(F.col("a"), F.col("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    now = C.written(given.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    loops = now.filter("a = b").select("a")
    now_edges, before, last = now.filter("a > b"), None, None
    while (mark := _signature(now_edges)) != before:
        before = mark
        if not mark[0]:
            break
        both = now_edges.select("a", "b").union(now_edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(now_edges.join(least, "a").select("a", F.col("m").alias("b"))).filter("a > b").distinct()
        large = C.written(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).filter("a > b").distinct()
        now_edges = C.written(small, "small-star")
        C.forget(large, *([last] if last is not None else []))
        last = now_edges
    roots = now_edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    out = now_edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
    alone = loops.join(out.select(F.col("node").alias("a")), "a", "left_anti")
    return out.union(alone.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
