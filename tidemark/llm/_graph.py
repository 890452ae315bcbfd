"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), every step a join and a grouped minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(u, v) but the roots themselves; root is the smallest node reachable.

    Every step writes its edges to the shared folder, so no lineage builds up; the number of steps grows with the
    logarithm of the longest path. No edges: no rows."""

    def small(e: DataFrame) -> DataFrame:
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        both = e.join(low, "u")
        return both.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionAll(low.select("u", F.col("m").alias("v"))).distinct()

    def large(e: DataFrame) -> DataFrame:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = materialise(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = state(e)
    while before[0]:
        e = materialise(small(large(e)), "edges")
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
