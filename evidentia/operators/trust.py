"""Joins of URLs with lists of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import LOW_TRUST_DOMAINS, TRUST_BLOCKED, TRUST_LISTED, TRUST_NEUTRAL, TRUSTED_ARABIC_DOMAINS, TRUSTED_DOMAINS, UNRELIABLE_DOMAINS
from ..functions.trust import pattern_trust
from ..functions.urls import parent_domains, registered_domain


#: Parts into which the rows of one host are dealt.
PARTS = 256


def _by_host(urls: DataFrame, url_col: str, columns: dict[str, Column], lists: DataFrame) -> DataFrame:
    """urls with columns that follow from ``__host`` and ``tier``, each computed once a host and part.

    Each host has a few suffixes, so only distinct hosts are exploded and joined with the lists. The rows are dealt out
    by host and a hash of the URL, so that those of a host with many pages, texts and all, are not one task's.
    """
    part = F.pmod(F.xxhash64(url_col), F.lit(PARTS)).alias("__part")
    hosts = urls.select(registered_domain(F.col(url_col)).alias("__host"), part).distinct()
    names = lists.select(F.lower("domain").alias("__name"), (F.col("tier") == "blocked").alias("__b"), (F.col("tier") != "blocked").alias("__t"))
    found = hosts.select("__host", "__part", F.explode(parent_domains(F.col("__host"))).alias("__name")).join(names, "__name").groupBy("__host", "__part").agg(F.bool_or("__b").alias("__b"), F.bool_or("__t").alias("__t"))
    tiers = found.select("__host", "__part", F.when(F.col("__b"), "blocked").when(F.col("__t"), "trusted").alias("tier"))
    told = hosts.join(tiers, ["__host", "__part"], "left").select("__host", "__part", *[c.alias(k) for k, c in columns.items()])
    return urls.select("*", registered_domain(F.col(url_col)).alias("__host"), part).join(told, ["__host", "__part"], "left").drop("__host", "__part")


def listed_tier(urls: DataFrame, url_col: str, lists: DataFrame) -> DataFrame:
    """urls with ``tier``: blocked before trusted before null, by the host or any parent domain. lists: (domain, tier)."""
    return _by_host(urls, url_col, {"tier": F.col("tier")}, lists)


def usual_lists(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """(domain, tier) of the constants' sources, trusted and of low trust, and of more, a table of that form: lists are as long as their user wants."""
    own = spark.createDataFrame([(d, "trusted") for d in (*TRUSTED_DOMAINS, *TRUSTED_ARABIC_DOMAINS)] + [(d, "blocked") for d in LOW_TRUST_DOMAINS], "domain string, tier string")
    return own if more is None else own.unionByName(more.select("domain", "tier"))


def drop_blocked(urls: DataFrame, url_col: str, lists: DataFrame | None = None) -> DataFrame:
    """urls without those of blocked sources: by default the unreliable ones of the constants."""
    if lists is None:
        lists = urls.sparkSession.createDataFrame([(d, "blocked") for d in UNRELIABLE_DOMAINS], "domain string, tier string")
    return listed_tier(urls, url_col, lists).where(F.coalesce(F.col("tier"), F.lit("")) != "blocked").drop("tier")


def with_trust(urls: DataFrame, url_col: str, lists: DataFrame) -> DataFrame:
    """urls with ``trust``: the score of functions.trust.trust_score with lists that may be of any length."""
    host = F.col("__host")
    score: Column = F.when(host == "", F.lit(TRUST_NEUTRAL)).when(F.col("tier") == "blocked", TRUST_BLOCKED).when(F.col("tier") == "trusted", TRUST_LISTED).otherwise(pattern_trust(host))
    return _by_host(urls, url_col, {"trust": score}, lists).fillna(TRUST_NEUTRAL, ["trust"])  # null URLs have no host


def trusted_first(urls: DataFrame, n: int, *, trust_col: str = "trust", pos_col: str = "pos", extra: int = 5) -> DataFrame:
    """The first n + extra rows by trust, ties in their order."""
    return urls.orderBy(F.desc(trust_col), F.asc(pos_col)).limit(n + extra)


def trusted_count(urls: DataFrame, *, trust_col: str = "trust", least: float = 2.0) -> DataFrame:
    return urls.agg(F.count_if(F.col(trust_col) >= least).alias("trusted"), F.count(F.lit(1)).alias("kept"))


def site_queries(domains: DataFrame, query: str, size: int = 25) -> DataFrame:
    """(batch, query): the query restricted to batches of ``size`` domains in order.

    The place of a domain is the number of smaller ones: domains are dealt out by their first two
    characters, whose counts are a small table, and ranked within them, so that no task sorts the list.
    """
    own = domains.select("domain").distinct().withColumn("__g", F.substring("domain", 1, 2))
    groups = own.groupBy("__g").agg(F.count(F.lit(1)).alias("n"))
    before = groups.select("__g", (F.sum("n").over(Window.orderBy("__g")) - F.col("n")).alias("before"))
    ranked = own.withColumn("r", F.row_number().over(Window.partitionBy("__g").orderBy("domain"))).join(before, "__g").withColumn("batch", F.floor((F.col("before") + F.col("r") - 1) / size))
    sites = ranked.groupBy("batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list("domain")), lambda d: F.concat(F.lit("site:"), d)), " OR ").alias("sites"))
    return sites.select("batch", F.concat(F.lit(f"{query} ("), "sites", F.lit(")")).alias("query"))


def batches_needed(found: DataFrame, n: int, *, batch_col: str = "batch", url_col: str = "url", extra: int = 5) -> DataFrame:
    """(batch, urls) of the batches that a search asks before it has n + extra different URLs: it stops after the batch that fills it."""
    first = found.groupBy(url_col).agg(F.min(batch_col).alias(batch_col))
    counts = found.select(batch_col).distinct().join(first.groupBy(batch_col).agg(F.count(F.lit(1)).alias("urls")), batch_col, "left").fillna(0, ["urls"])
    before = F.sum("urls").over(Window.orderBy(batch_col)) - F.col("urls")
    return counts.withColumn("__before", before).where(F.col("__before") < n + extra).select(batch_col, "urls")
