"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node of an edge. Loops and repeated edges do no harm; no edges: no rows.

    Each round every node takes the smallest of itself and its neighbours, and edges move to what their ends took; those
    within one node go. A star is done in one round, a path in a logarithmic number of rounds.
    """
    left = settle(edges.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b")).distinct(), "edges")
    found = None
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = settle(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("to")), "labels")
        if found is None:
            found = to.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            later = to.select(F.col("a").alias("component"), "to")
            found = settle(found.join(later.hint("merge"), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "components")
        moved = left.join(to.hint("merge"), "a").select("b", F.col("to").alias("x")).join(to.select(F.col("a").alias("b"), F.col("to").alias("y")).hint("merge"), "b")
        left = settle(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if not left.limit(1).count():
            return found
