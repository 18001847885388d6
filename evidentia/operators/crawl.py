"""The crawl frontier: priorities, politeness, seen sets, breadth-first expansion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.trust import crawl_boost, frontier_priority
from ..functions.urls import fingerprint, host_domain


def frontier_rows(links: DataFrame, *, trust_col: str = "trust") -> DataFrame:
    """links (url, parent_url, depth, relevance_score, discovered_at, trust) with fingerprint, priority and status."""
    return links.withColumns({
        "fingerprint": fingerprint(F.col("url")),
        "priority": frontier_priority(F.col("relevance_score"), F.col("depth"), crawl_boost(F.col(trust_col))),
        "status": F.lit("pending"),
    })


def push(frontier: DataFrame, links: DataFrame, seen: DataFrame, *, capacity: int = 100_000) -> DataFrame:
    """The links that enter the frontier: not seen, each URL once (its best priority), best first up to the capacity left.

    Returns rows of the frontier's columns. What is pending is one count; the cut is a global top-k,
    which keeps the best of each task before anything is gathered.
    """
    fresh = links.join(seen.select("fingerprint"), "fingerprint", "left_anti").join(frontier.select("fingerprint"), "fingerprint", "left_anti")
    rest = [c for c in frontier.columns if c != "fingerprint"]
    once = fresh.groupBy("fingerprint").agg(F.max_by(F.struct(*rest), F.struct(F.col("priority"), (-F.col("depth")).alias("d"), F.col("url"))).alias("x")).select("fingerprint", *[F.col("x")[c].alias(c) for c in rest])
    room = max(0, capacity - frontier.where("status = 'pending'").count())
    return once.orderBy(F.desc("priority"), "depth", "discovered_at", "fingerprint").limit(room).select(*frontier.columns)


def pop_polite(frontier: DataFrame, clock: DataFrame, as_of: float, *, look: int = 50, take: int | None = 1) -> DataFrame:
    """Of the ``look`` best pending rows those whose domain may be asked at as_of, one a domain, the best ``take`` (all with None).

    clock: (domain, next_allowed_at); a domain without a row may be asked.
    """
    order = [F.desc("priority"), F.asc("depth"), F.asc("discovered_at"), F.asc("fingerprint")]
    best = frontier.where("status = 'pending'").orderBy(*order).limit(look).withColumn("domain", host_domain(F.col("url")))
    free = best.join(clock, "domain", "left").where(F.coalesce("next_allowed_at", F.lit(0.0)) <= as_of).drop("next_allowed_at")
    one = free.withColumn("__n", F.row_number().over(Window.partitionBy("domain").orderBy(*order))).where("__n = 1").drop("__n")
    return one.orderBy(*order).limit(take) if take is not None else one


def without_indexed(frontier: DataFrame, indexed: DataFrame) -> DataFrame:
    """frontier with the pending rows whose URL is indexed already marked as done: an incremental crawl doesn't fetch them again."""
    return with_status(frontier, frontier.where("status = 'pending'").join(indexed.select("url"), "url", "left_semi"), "done")


def enqueue(queue: DataFrame, items: DataFrame, capacity: int, *, order: list[Column]) -> DataFrame:
    """queue with the first items in order, as many as have room; the others are dropped, as by a producer that doesn't wait."""
    return queue.unionByName(items.orderBy(*order).limit(max(0, capacity - queue.count())))


def with_status(frontier: DataFrame, done: DataFrame, status: str) -> DataFrame:
    """frontier with the status of the rows whose fingerprint is in done."""
    marked = done.select("fingerprint", F.lit(True).alias("__hit")).distinct()
    return frontier.join(marked, "fingerprint", "left").withColumn("status", F.when(F.col("__hit"), status).otherwise(F.col("status"))).select(*frontier.columns)


def update_clock(clock: DataFrame, fetched: DataFrame, as_of: float) -> DataFrame:
    """clock after fetches (domain, delay) at as_of: never sooner than a second later."""
    later = fetched.groupBy("domain").agg((F.lit(as_of) + F.greatest(F.max("delay"), F.lit(1.0))).alias("next_allowed_at"))
    return clock.unionByName(later).groupBy("domain").agg(F.max("next_allowed_at").alias("next_allowed_at"))


def frontier_size(frontier: DataFrame) -> DataFrame:
    return frontier.agg(F.count_if(F.col("status") == "pending").alias("pending"))


def crawl_depths(seeds: DataFrame, links: DataFrame, *, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """(url, depth, parent_url) reached from seeds (url) over links (parent_url, url) in max_depth steps at most.

    One round a level: the level's links less the URLs seen so far, each URL once with its smallest
    parent. The lineage is cut after each level; only the size of a level comes to the driver. With
    max_pages the shallowest URLs stay, in order of URL within the last level.
    """
    edges = links.select("parent_url", "url").where("url is not null").distinct()
    level = seeds.select("url").distinct().select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url")).checkpoint()
    reached = level
    for depth in range(1, max_depth + 1):
        step = edges.join(level.select(F.col("url").alias("parent_url")), "parent_url").join(reached.select("url"), "url", "left_anti")
        level = step.groupBy("url").agg(F.min("parent_url").alias("parent_url")).select("url", F.lit(depth).alias("depth"), "parent_url").checkpoint()
        if level.isEmpty():
            break
        reached = reached.unionByName(level).checkpoint()
    return reached if max_pages is None else reached.orderBy("depth", "url").limit(max_pages)


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], score_links: Callable[[DataFrame], DataFrame], *, max_depth: int = 2, max_pages: int | None = 500, threshold: float = 0.45) -> DataFrame:
    """Pages (url, depth, relevance_score, html) found from seeds (url) by rounds of fetch and link scoring.

    fetch: rows with url to rows with url, html, status; score_links: pages to (parent_url, url,
    relevance_score). Only pages that came back with status 200 count and are followed. max_pages=None
    sets no bound.
    """
    level = seeds.select("url").distinct().select("url", F.lit(0).alias("depth"), F.lit(1.0).alias("relevance_score"))
    level = level if max_pages is None else level.limit(max_pages)
    pages, left = None, max_pages
    for depth in range(max_depth + 1):
        got = level.join(fetch(level.select("url")).where("status = 200 and html is not null").select("url", "html"), "url").checkpoint()
        pages = got if pages is None else pages.unionByName(got)
        if max_pages is not None:
            left -= got.count()
        if depth == max_depth or (left is not None and left <= 0):
            break
        links = score_links(got).where(F.col("relevance_score") >= threshold).groupBy("url").agg(F.max("relevance_score").alias("relevance_score"))
        fresh = links.join(pages.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth + 1))
        fresh = fresh if left is None else fresh.orderBy(F.desc("relevance_score"), "url").limit(left)
        level = fresh.select("url", "depth", "relevance_score").checkpoint()
        if level.isEmpty():
            break
    return pages
