"""Fetching as data: a fetcher maps URLs to downloads; offline it is a table of stored pages."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DOWNLOAD

MAX_BYTES = 5 * 1024 * 1024
PAGE_TYPES = ("text/html", "application/xhtml+xml", "text/plain")

#: Fixed value: seconds that a robots.txt file holds.
ROBOTS_TTL = 3600.0


def from_table(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> Callable[[DataFrame], DataFrame]:
    """A fetcher that looks pages up in a table; URLs it lacks come back with status 404."""
    held = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).dropDuplicates(["url"])

    def fetch(urls: DataFrame) -> DataFrame:
        return urls.select("url").join(held, "url", "left").withColumn("status", F.when(F.col("html").isNull(), 404).otherwise(200))

    return fetch


def parallel_fetch(urls: DataFrame, get: Callable[[str], dict], *, workers: int = 8, tries: int = 3, rules: DataFrame | None = None, deadline: float | None = None, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Downloads by ``get`` (url to a dict of DOWNLOAD's fields) in ``workers`` tasks; a failure is a row with status -1 and its error.

    After a failure a task waits 2 ** attempt seconds and a jitter below one, then tries again. With rules
    (of robots_rules()) URLs that they refuse aren't asked and come back as errors. ``deadline`` bounds
    the seconds of a task: what it hasn't begun by then comes back as an error, the rest stays.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        began = time.monotonic()
        for pdf in batches:
            rows = []
            for url, allowed in zip(pdf["url"], pdf["allowed"], strict=True):
                row = {"url": url, "final_url": url, "status": -1, "html": None, "content_type": None, "error": None, "crawl_delay": 0.0, "elapsed_ms": 0.0}
                rows.append(row)
                if not allowed:
                    row["error"] = "robots"
                    continue
                for attempt in range(tries):
                    if deadline is not None and time.monotonic() - began >= deadline:
                        row["error"] = "deadline"
                        break
                    try:
                        row |= {"error": None} | get(url)
                        break
                    except Exception as e:
                        row["error"] = str(e)
                        if attempt + 1 < tries:
                            wait(2.0**attempt + random.random())
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DOWNLOAD.split(", ")])

    asked = urls.select("url").withColumn("allowed", F.lit(True))
    if rules is not None:
        hosts = urls.select("url", F.lower(F.regexp_extract("url", r"^[^:/?#]+://([^/?#]*)", 1)).alias("domain"))
        open_ = allowed_by_robots(hosts, rules).select("url").distinct()
        asked = urls.select("url").join(open_.withColumn("__open", F.lit(True)), "url", "left").select("url", F.coalesce("__open", F.lit(False)).alias("allowed"))
    return asked.repartition(workers).mapInPandas(run, DOWNLOAD)


def opensearch_urls(answer: Column) -> Column:
    """The URLs of an OpenSearch answer, the fourth entry of its list; empty where there is none."""
    parts = F.from_json(answer, "array<string>")
    return F.coalesce(F.from_json(F.get(parts, F.lit(3)), "array<string>"), F.array().cast("array<string>"))


def succeeded(status: Column, html: Column) -> Column:
    return (status == 200) & html.isNotNull()


def is_page_type(content_type: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    out = F.lit(False)
    for t in PAGE_TYPES:
        out = out | F.startswith(kind, F.lit(t))
    return out


def guarded(downloads: DataFrame, *, truncate: bool = False) -> DataFrame:
    """downloads with html only where the type is a page's and the size is in bounds; larger ones are cut or become errors."""
    ok, large = is_page_type(F.col("content_type")), F.octet_length("html") > MAX_BYTES
    html = F.when(~ok, F.lit(None)).when(large, F.substring("html", 1, MAX_BYTES) if truncate else F.lit(None)).otherwise(F.col("html"))
    error = F.when(~ok, "content type").when(large & F.lit(not truncate), "too large").otherwise(F.col("error"))
    return downloads.withColumns({"error": error, "html": html})


def _robots_lines(files: DataFrame) -> DataFrame:
    """(domain, pos, k, v, agent): the fields of robots.txt files (domain, text), each with the agent that it is for."""
    lines = files.select("domain", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    rule = lines.select("domain", "pos", F.lower(F.trim(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1))).alias("k"), F.trim(F.regexp_extract("line", r"^\s*[A-Za-z-]+\s*:\s*([^#]*)", 1)).alias("v"))
    return rule.withColumn("agent", F.expr("last_value(case when k = 'user-agent' then v end) ignore nulls over (partition by domain order by pos)"))


def robots_rules(files: DataFrame) -> DataFrame:
    """(domain, allow, prefix) of robots.txt files (domain, text) for all agents."""
    return _robots_lines(files).where("agent = '*' and k in ('allow', 'disallow') and v != ''").select("domain", (F.col("k") == "allow").alias("allow"), F.col("v").alias("prefix"))


def crawl_delays(files: DataFrame) -> DataFrame:
    """(domain, delay) of every robots.txt file (domain, text): the whole seconds that it asks all agents to wait, the last such line; 0 without one. Null texts ask nothing."""
    asked = _robots_lines(files).where("agent = '*' and k = 'crawl-delay'").where(F.col("v").rlike("^[0-9]+$"))
    last = asked.groupBy("domain").agg(F.max_by(F.col("v").cast("double"), "pos").alias("delay"))
    return files.select("domain").distinct().join(last, "domain", "left").select("domain", F.coalesce("delay", F.lit(0.0)).alias("delay"))


def live_robots(files: DataFrame, as_of: float, ttl: float = ROBOTS_TTL) -> tuple[DataFrame, DataFrame]:
    """The newest file of each domain (domain, text, fetched_at) that is younger than ttl seconds, and the domains (domain) whose file has to be fetched anew."""
    newest = files.groupBy("domain").agg(F.max_by("text", "fetched_at").alias("text"), F.max("fetched_at").alias("fetched_at"))
    young = F.coalesce(F.lit(as_of) - F.col("fetched_at") < ttl, F.lit(False))
    return newest.where(young), newest.where(~young).select("domain")


def allowed_by_robots(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, domain) that the longest matching rule of their domain allows; without a rule they are allowed."""
    path = F.regexp_replace("url", r"^[^:]+://[^/?#]*", "")
    hit = urls.withColumn("__p", F.when(path == "", "/").otherwise(path)).join(rules.select(F.col("domain").alias("__d"), "allow", "prefix"), (F.col("domain") == F.col("__d")) & F.startswith(F.col("__p"), F.col("prefix")))
    said = hit.groupBy("url").agg(F.max_by("allow", F.struct(F.length("prefix"), "allow")).alias("allow"))
    return urls.join(said.where(~F.col("allow")).select("url"), "url", "left_anti")


def search_table(pages: DataFrame, query_terms: list[str], n: int, *, text_col: str = "text", url_col: str = "url") -> DataFrame:
    """A search source over a table: (url, pos), the pages that hold most of the terms first."""
    low = F.lower(F.col(text_col))
    hits = sum((F.when(F.contains(low, F.lit(t.lower())), 1).otherwise(0) for t in query_terms), F.lit(0))
    best = pages.select(F.col(url_col).alias("url"), hits.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "url").limit(n)
    return best.select("url", (F.lit(0) - F.col("hits")).alias("pos"))


def unwrap_redirect(url: Column) -> Column:
    """The target of a search engine's redirect (its uddg parameter), or the URL itself."""
    target = F.regexp_extract(url, r"[?&]uddg=([^&]*)", 1)
    return F.when(target != "", F.coalesce(F.try_url_decode(target), target)).otherwise(url)
