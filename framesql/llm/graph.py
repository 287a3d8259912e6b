"""Connected components by contraction, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesql.llm import common


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges``: a, b. Returns id, root (the smallest identifier that can be reached) for every end of an edge.

    In each round every node takes the smallest of itself and its neighbours as parent (a
    map-side minimum, so hubs don't matter); parents are followed to the end by doubling; edges within a tree go.
    """
    left = common.written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    for k in range(most_rounds):
        if left.isEmpty():
            break
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = common.written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("p")).select("id", F.least("id", "p").alias("p")), f"parents{k}")
        for jump in range(most_rounds):
            up = parent.select(F.col("id").alias("p"), F.col("p").alias("pp"))
            further = common.written(parent.join(up, "p").select("id", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), f"parents{k}-{jump}")
            parent = further.select("id", "p")
            if further.where("moved").isEmpty():
                break
        found = parent.select("id", F.col("p").alias("root")) if found is None else found.join(parent.withColumnRenamed("id", "root"), "root", "left").select("id", F.coalesce("p", "root").alias("root"))
        found = common.written(found, f"roots{k}")
        pa, pb = (parent.select(F.col("id").alias(x), F.col("p").alias(f"p{x}")) for x in "ab")
        left = left.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        left = common.written(left, f"edges{k}")
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("a").alias("root")).limit(0) if found is None else found
