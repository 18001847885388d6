"""Retrieval metrics over ranked results and relevance judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mark_hits(results: DataFrame, judgements: DataFrame, *, query_col: str = "query_id", item_col: str = "item_id") -> DataFrame:
    """results (query, item, rank) with ``hit``."""
    good = judgements.select(query_col, item_col).distinct().withColumn("hit", F.lit(1))
    return results.join(good, [query_col, item_col], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def query_metrics(results: DataFrame, judgements: DataFrame, k: int = 10, *, query_col: str = "query_id", item_col: str = "item_id") -> DataFrame:
    """One row a query of results: precision, recall and nDCG at k, average precision over the whole list, reciprocal rank.

    results: (query, item, rank) with ranks from 1. Precision divides by k, recall by the number of
    relevant items (0 without any), nDCG has binary gains and an ideal of min(relevant, k) hits.
    """
    relevant = judgements.select(query_col, item_col).distinct().groupBy(query_col).agg(F.count(F.lit(1)).alias("n_relevant"))
    return metrics_of_hits(mark_hits(results, judgements, query_col=query_col, item_col=item_col), relevant, k, query_col=query_col)


def metrics_of_hits(marked: DataFrame, relevant: DataFrame, k: int = 10, *, query_col: str = "query_id") -> DataFrame:
    """query_metrics() from results that are marked (query, rank, hit) and the number of relevant items (query, n_relevant): no list of all relevant pairs is needed."""
    so_far = F.sum("hit").over(Window.partitionBy(query_col).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    hit, within = F.col("hit") == 1, F.col("rank") <= k
    sums = marked.withColumn("__c", so_far).groupBy(query_col).agg(
        F.sum(F.when(hit & within, 1).otherwise(0)).alias("hits"),
        F.sum(F.when(hit & within, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(hit, F.col("__c") / F.col("rank")).otherwise(0.0)).alias("ap"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    some = F.coalesce(F.col("n_relevant"), F.lit(0)) > 0
    return sums.join(relevant, query_col, "left").select(
        query_col,
        (F.col("hits") / k).alias("precision_at_k"),
        F.when(some, F.col("hits") / F.col("n_relevant")).otherwise(0.0).alias("recall_at_k"),
        F.when(some, F.col("ap") / F.col("n_relevant")).otherwise(0.0).alias("average_precision"),
        F.when(some, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg_at_k"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """(n_queries, mean_precision, mean_recall, map, mean_ndcg, mrr); zeros without queries."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return metrics.agg(
        F.count(F.lit(1)).alias("n_queries"), mean("precision_at_k").alias("mean_precision"), mean("recall_at_k").alias("mean_recall"), mean("average_precision").alias("map"), mean("ndcg_at_k").alias("mean_ndcg"), mean("reciprocal_rank").alias("mrr")
    )
