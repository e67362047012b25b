"""Connected components of a graph held in tables: hooking to the smallest neighbour and pointer jumping, on contracted edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): nodes have one root if and only if they are connected.

    A round hooks every vertex to its smallest neighbour if that is smaller, halves the paths until they end at roots, and
    replaces vertices by roots. At least half of the vertices that still have edges vanish in a round, so rounds grow with the
    logarithm of the longest path. Each round's tables are written to the shared folder; minima are combined before the shuffle,
    so a vertex with a third of all edges is no hot task."""
    edges = written(_clean(edges), "edges")
    known: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        up = _flat(written(up, "hooks"))
        if known is None:
            known = up
        else:
            moved = up.select(F.col("node").alias("root"), F.col("root").alias("to"))
            known = written(known.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        for side in ("a", "b"):
            to = up.select(F.col("node").alias(side), F.col("root").alias("r"))
            edges = edges.join(to, side).withColumn(side, F.col("r")).drop("r")
        edges = written(_clean(edges), "edges")
    return known if known is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _flat(up: DataFrame) -> DataFrame:
    """Every node's root, by following two steps at once until nothing moves."""
    while True:
        over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jump = written(up.join(over, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "jumps")
        up = jump.select("node", "root")
        if jump.filter("moved").isEmpty():
            return up
