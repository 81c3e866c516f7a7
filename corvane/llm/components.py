"""Connected components of an edge table, in DataFrame functions only: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import drop, materialize

MAX_ROUNDS = 60


def _minimum(pairs: DataFrame) -> DataFrame:
    """The smallest neighbour of each node; an aggregate that combines before the shuffle, so hubs are harmless."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minimum(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them. Edges: u > v."""
    least = _minimum(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component. Loops and repeated edges are harmless;
    edges with a null end are left out, and no edges give no rows.

    Ends when every edge leads to its root, that is, when no node has two smaller neighbours or neighbours on both sides: a
    number of rounds near the logarithm of the longest path. Each round is written to the shared folder, and only a count
    comes to the driver.
    """
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    current = materialize(start, "edges")
    for _ in range(MAX_ROUNDS):
        sides = current.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("s")).select("s.*")
        if not sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").count():
            break
        following = materialize(_small_star(_large_star(current)), "edges")
        drop(edges.sparkSession, current)
        current = following
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
