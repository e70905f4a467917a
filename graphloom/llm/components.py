"""Connected components by contraction, for edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """edges: a and b. Returns node and root, the least node of its component, for each node of an edge between two nodes.

    Each round every node points to its least neighbour, pointers are doubled until
    they end, and edges move to what their ends point to. At least half of the nodes
    that still have edges go each round.
    """
    left = edges.where(F.col("a") != F.col("b")).select("a", "b")
    found: DataFrame | None = None
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")), "least")
        while True:
            once, twice = (up.select(F.col("node").alias(f"root{k}"), F.col("root").alias(f"root{k + 1}")) for k in (0, 1))
            jumped = stored(up.withColumnRenamed("root", "root0").join(once, "root0").join(twice, "root1").select("node", F.col("root2").alias("root"), (F.col("root2") != F.col("root0")).alias("moved")), "jumped")
            up = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if found is None:
            found = up
        else:
            then = up.select(F.col("node").alias("root"), F.col("root").alias("then"))
            found = found.join(then, "root", "left").select("node", F.coalesce("then", "root").alias("root"))
        a = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = stored(left.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a != b").distinct(), "left")
        if left.isEmpty():
            return stored(found, "roots")
