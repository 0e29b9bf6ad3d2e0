"""Connected components of an edge table by repeated hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialectry.llm.common import discard, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable, for every node that has an edge.

    Each round hooks every node to its smallest neighbour, shortens the chains twice, and keeps only
    edges between different parents. The edge count at least halves with each chain, so rounds grow
    with the logarithm of the longest path. Minima are pre-aggregated before the shuffle: a star of
    any size sends one row per task.
    """
    left = stored(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct(), "edges")
    label = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("p"))
        for _ in range(2):
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("p"))
        parent = stored(parent, "parents")
        held = None
        if label is None:
            label = parent.withColumnRenamed("p", "label")
        else:
            held = label
            label = label.join(parent.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("p", "label").alias("label"))
        pa_, pb = parent.toDF("a", "pa"), parent.toDF("b", "pb")
        smaller = stored(left.join(pa_, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        label = stored(label, "labels")
        discard(left, parent, *([held] if held is not None else []))
        left = smaller
    if label is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return label
