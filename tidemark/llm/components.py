"""Connected components of an edge table, by repeated contraction.

In each round every node joins its neighbour (or itself) of least random priority, and edges are renamed.
A round shrinks any graph by a constant factor in expectation, whatever its shape; a hub's edges are
reduced by a partial minimum, so no task holds a node's neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def components(edges: DataFrame) -> DataFrame:
    """edges(u long, v long), either way round, repeated or not. Returns (node, root) for each node of an edge.

    Loops and rows with a null end are left out. No edges: no rows.
    """
    left = scratch.keep(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    found = None
    for turn in range(1_000):
        if left.isEmpty():
            break
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("p"), F.col(c).alias("n"))
        to = scratch.keep(both.groupBy(F.col("u").alias("node")).agg(F.min(first("v")).alias("m")).select("node", F.when(F.col("m") < F.struct(F.xxhash64("node", F.lit(turn)).alias("p"), F.col("node").alias("n")), F.col("m.n")).otherwise(F.col("node")).alias("to")), "to")
        name = lambda c: to.select(F.col("node").alias(c), F.col("to").alias(f"{c}2"))
        after = left.join(name("u"), "u").join(name("v"), "v").where("u2 <> v2").select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).distinct()
        after = scratch.keep(after, "edges")
        if found is None:
            found = to.select("node", F.col("to").alias("root"))
        else:
            renamed = scratch.keep(found.join(to.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
            scratch.drop(found, to)
            found = renamed
        scratch.drop(left)
        left = after
    return left.select(F.col("u").alias("node"), F.col("v").alias("root")) if found is None else found
