"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_io import cut_lineage, fitted


#: Edges that one task handles at least.
PER_TASK = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the smallest node that links reach.

    Nodes may be of any ordered type. Each step is a pre-aggregated minimum for each node and a join on
    it, and leaves at most as many edges as it found; a hub's edges are only ever split, never gathered.
    The folder of checkpoints holds the state of each round. An empty table gives an empty table.
    """
    now = cut_lineage(edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(now)
    few = lambda df: fitted(df, before[0], PER_TASK)
    while before[0]:
        now = few(now)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = few(few(both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")).distinct())
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        paired = few(large.join(least, F.col("u") == F.col("w")))
        small = paired.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        now = cut_lineage(few(small))
        after = _state(now)
        if after == before:
            break
        before = after
    return cut_lineage(few(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())))
