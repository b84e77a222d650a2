"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    # Hashes are shortened so that their sum stays exact.
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 24))).first())


def _star(pairs: DataFrame, onto_larger: bool) -> DataFrame:
    """pairs: (u, w). Every w is tied to the smallest of u and its neighbours."""
    lowest = pairs.groupBy("u").agg(F.min("w").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("m"))
    tied = pairs.join(lowest, F.col("u") == F.col("_u"))
    if onto_larger:
        return tied.where("w > u").select(F.col("w").alias("u"), F.col("m").alias("v"))
    return tied.select(F.col("w").alias("u"), F.col("m").alias("v")).union(lowest.select(F.col("_u").alias("u"), F.col("m").alias("v")))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, component (the smallest node reachable), for all nodes with an edge to another one.

    edges: two columns of one sortable type, in any direction. Each half round is one aggregation and one
    join on a node; large groups of edges are split by adaptive execution. The loop ends when a full
    round changes nothing.
    """
    a, b = edges.columns
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = stored(now, label)
    mark = _mark(now)
    while mark[0]:
        both = now.select("u", F.col("v").alias("w")).union(now.select(F.col("v").alias("u"), F.col("u").alias("w")))
        large = stored(_star(both, True).where("u <> v").distinct(), label)
        small = stored(_star(large.select("u", F.col("v").alias("w")), False).where("u <> v").distinct(), label)
        now, before, mark = small, mark, _mark(small)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
