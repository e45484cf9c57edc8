"""Connected components by hooking and pointer jumping on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Save


def components(edges: DataFrame, save: Save) -> DataFrame:
    """``id, comp``: of every id of the edges (a, b) the smallest id it is connected with.

    Every round hooks each root to its smallest neighbour and lets all ids jump to where their
    target points until they stand, so a chain of n ids takes about log2 n written tables; the
    roots that are left and their edges, at most half as many, make the next round.
    """
    step = 0

    def put(df: DataFrame) -> DataFrame:
        nonlocal step
        step += 1
        return save(df, f"graph{step}")

    edges, found = put(edges.filter("a <> b").select("a", "b").distinct()), None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = put(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("up")))
        moved = True
        while moved:
            target = up.select(F.col("id").alias("up"), F.col("up").alias("next"))
            jumped = put(up.join(target, "up", "left").select("id", F.coalesce("next", "up").alias("up"), (F.col("next") != F.col("up")).alias("moved")))
            moved = not jumped.filter("moved").isEmpty()
            up = jumped.select("id", "up")
        root = up.select("id", F.col("up").alias("comp"))
        found = root if found is None else put(found.join(up.withColumnRenamed("id", "comp"), "comp", "left").select("id", F.coalesce("up", "comp").alias("comp")))
        a, b = up.select(F.col("id").alias("a"), F.col("up").alias("up_a")), up.select(F.col("id").alias("b"), F.col("up").alias("up_b"))
        edges = put(edges.join(a, "a").join(b, "b").filter("up_a <> up_b").select(F.col("up_a").alias("a"), F.col("up_b").alias("b")).distinct())
    return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")) if found is None else found
