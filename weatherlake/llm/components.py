"""Connected components by contraction: every node joins its smallest neighbour, chains are shortened by pointer
doubling, edges are renamed to the new roots, until no edge is left. Only aggregations and equality joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weatherlake.llm.common import stored


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component. ``rows``: a bound of
    the number of edges, if it is known."""
    edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", rows)
    roots, n = None, edges.count()
    nodes = 2 * n
    while n:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "up", 2 * n)
        while True:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
            jumped = stored(up.join(over, "up").select("node", F.col("next").alias("up"), (F.col("next") < F.col("up")).alias("moved")), "up", 2 * n)
            up = jumped.drop("moved")
            if jumped.filter("moved").isEmpty():
                break
        left = up.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        right = up.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        renamed = edges.join(left, "a").join(right, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = stored(renamed.distinct(), "edges", n)
        n = edges.count()
        if roots is None:
            roots = up.select("node", F.col("up").alias("root"))
        else:
            moved = up.select(F.col("node").alias("root"), F.col("up").alias("next"))
            roots = stored(roots.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots", nodes)
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
