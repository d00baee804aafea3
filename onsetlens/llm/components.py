"""Connected components of an edge table, by moving edges to smaller neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from onsetlens.session import materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node that is in an edge (a, b): root is the smallest node reachable.

    Each round links the larger neighbours of a node to its smallest neighbour, then the smaller
    ones (large-star and small-star); edges never grow in number, and rounds are logarithmic on
    long chains.  A node with very many edges is one row of a pre-aggregated minimum and a join
    that Spark may split.  Every round is written to the shared folder.
    """
    greater, less = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = materialise(edges.where("a <> b").select(greater, less).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        # Large star: neighbours above a node go to its smallest neighbour or itself.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("m"))
        moved = both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.where("a <> b").distinct()
        # Small star: neighbours below a node, and the node itself, go to the smallest of them.
        least = moved.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        met = moved.join(least, F.col("a") == F.col("node"))
        moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
        edges = materialise(moved.where("a <> b").distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots.select("id", F.col("id").alias("root")))
