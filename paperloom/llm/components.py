"""Connected components of an edge table, by repeated contraction.

Each round maps every node to the smallest of itself and its neighbours and relabels the
edges; those between two different labels go on to the next round. Node ids should be
hashes, so that no order of the input makes long descending chains: the rounds then grow
with the logarithm of the number of nodes. Each round is written to the shared folder, so a
lost executor costs no more than one round. Minima are combined before the shuffle and the
relabelling joins can be split by Spark, so a node may have any number of edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import stage


def components(edges: DataFrame, name: str) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (a, b: long, null-free).

    A component's label is one of its nodes. Loops and repeated edges change nothing; without
    edges the result is empty.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = stage(both.distinct(), f"{name}-edges")
    mapped = None
    while mapped is None or not left.isEmpty():
        down = stage(
            left.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).withColumnRenamed("a", "node"),
            f"{name}-round",
        )
        if mapped is None:
            mapped = down.withColumnRenamed("to", "component")
        else:
            moved = down.withColumnRenamed("node", "component")
            joined = mapped.join(moved, "component", "left")
            mapped = stage(
                joined.select("node", F.coalesce("to", "component").alias("component")), f"{name}-nodes"
            )
        one = left.join(down, F.col("a") == F.col("node")).select(F.col("to").alias("a"), "b")
        two = one.join(down, F.col("b") == F.col("node")).select("a", F.col("to").alias("b"))
        left = stage(two.where("a <> b").distinct(), f"{name}-edges")
    return mapped
