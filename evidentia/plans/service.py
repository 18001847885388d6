"""Services over the operators, and the command line: queries, search, check and batteries of claims, index, crawl, recent rows, counts."""

from __future__ import annotations

import argparse
import json
import time
import uuid
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.batteries import BATTERIES
from ..functions.constants import NO_INFO
from ..functions.text import normalise_query, query_terms, squeeze
from ..operators import crawl, evaluation, html, models, trust, verdict
from ..sources import settings, tables
from ..sources.fetch import from_table
from . import catalogue, flows

#: Bounds of requests.
QUERY_CHARS, TOP_K, PAGES, RECENT = (1, 500), (1, 50), (1, 10_000), (1, 200)
MIN_CHUNKS = 3


def bounded(value: int, limits: tuple[int, int], name: str) -> int:
    if not limits[0] <= value <= limits[1]:
        raise ValueError(f"{name} must be from {limits[0]} to {limits[1]}")
    return value


@dataclass
class CrawlJob:
    """pending, running, done or error, with what came of it."""

    query: str
    job_id: str = field(default_factory=lambda: uuid.uuid4().hex[:8])
    status: str = "pending"
    pages_crawled: int = 0
    chunks_indexed: int = 0
    elapsed_seconds: float = 0.0
    pages_per_second: float = 0.0
    error: str | None = None

    def run(self, work) -> CrawlJob:
        """work() returns (pages, chunks); its failure becomes the job's error."""
        began, self.status = time.monotonic(), "running"
        try:
            self.pages_crawled, self.chunks_indexed = work()
            self.status = "done"
        except Exception as e:
            self.status, self.error = "error", str(e)
        self.elapsed_seconds = time.monotonic() - began
        self.pages_per_second = self.pages_crawled / max(self.elapsed_seconds, 1e-9)
        return self


class SearchEngine:
    """Search over a vector table; the index is built from pages, which an empty index does at its first search."""

    def __init__(self, spark: SparkSession, path: str, config: dict | None = None, model: models.ModelBackend = models.DEFAULT):
        self.spark, self.model, self.config = spark, model, settings.load(config)
        self.store = tables.VectorTable(spark, path)
        self.jobs: dict[str, CrawlJob] = {}

    def index(self, pages: DataFrame) -> CrawlJob:
        def work() -> tuple[int, int]:
            stored = self.store.read().select(F.col("metadata")["url"].alias("url"), F.col("metadata")["content_hash"].alias("content_hash"), F.lit(True).alias("indexed")).distinct()
            seen = Observation()
            rows = flows.index_pages(pages.observe(seen, F.count(F.lit(1)).alias("pages")), stored, model=self.model, strategy=self.config["chunker"]["strategy"])
            fields = ("url", "title", "domain", "content_hash")
            made = rows.select("id", "text", "embedding", F.create_map(*[x for c in fields for x in (F.lit(c), F.col(c))]).alias("metadata"))
            version = self.store.add(made)  # the one pass over the pages; both figures are counted on its way
            return seen.get["pages"], next(r["rows"] for r in self.store.records() if r["version"] == version)

        return CrawlJob("index").run(work)

    def search(self, query: str, as_of: float, *, top_k: int = 10, lists: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
        bounded(len(query), QUERY_CHARS, "query length")
        bounded(top_k, TOP_K, "top_k")
        if pages is not None and self.store.count() < MIN_CHUNKS:
            self.index(pages)
        asked = self.spark.createDataFrame([(query,)], "query string").select(F.col("query").alias("query_id"), "query", models.embed(normalise_query(F.col("query")), self.model).alias("embedding"))
        chunks = self.store.read().select("id", "text", "embedding", F.col("metadata")["url"].alias("url"), F.col("metadata")["title"].alias("title"), F.lit(None).cast("double").alias("published"))
        rated = trust.with_trust(trust.drop_blocked(chunks, "url"), "url", trust.usual_lists(self.spark) if lists is None else lists)
        s = self.config["search"]
        return flows.search(asked, rated, as_of, retrieve=s["top_k_retrieval"], top_k=top_k, min_score=s["min_score"])

    def crawl(self, query: str, seeds: DataFrame, fetch, *, max_depth: int = 2, max_pages: int = 500) -> CrawlJob:
        """A job that crawls from seeds (url) by a fetcher, follows links that suit the query, and indexes what it finds."""
        bounded(len(query), QUERY_CHARS, "query length")
        bounded(max_pages, PAGES, "max_pages")
        job = CrawlJob(query)
        self.jobs[job.job_id] = job
        terms = [r.t for r in self.spark.createDataFrame([(query,)], "q string").select(F.explode(query_terms(F.col("q"))).alias("t")).collect()]

        def links(got: DataFrame) -> DataFrame:
            found = html.extract_links(got.withColumn("page", F.col("url")), terms, threshold=self.config["crawler"].get("relevance_threshold", 0.45), key="page")
            return found.select(F.col("page").alias("parent_url"), "url", "relevance_score")

        def work() -> tuple[int, int]:
            pages = crawl.crawl(seeds, fetch, links, max_depth=max_depth, max_pages=max_pages).withColumn("page_id", F.xxhash64("url"))
            done = self.index(pages)
            if done.status == "error":
                raise RuntimeError(done.error)
            return done.pages_crawled, done.chunks_indexed

        return job.run(work)

    def job(self, job_id: str) -> CrawlJob | None:
        return self.jobs.get(job_id)

    def recent(self, n: int = 20) -> DataFrame:
        """(url, title, chunks) of n indexed pages, in order of URL."""
        bounded(n, RECENT, "n")
        pages = self.store.read().groupBy(F.col("metadata")["url"].alias("url")).agg(F.min(F.col("metadata")["title"]).alias("title"), F.count(F.lit(1)).alias("chunks"))
        return pages.orderBy("url").limit(n)

    def stats(self) -> dict:
        """Chunks, pages and domains of the index, and jobs by status."""
        row = self.store.read().agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct(F.col("metadata")["url"]).alias("pages"), F.count_distinct(F.col("metadata")["domain"]).alias("domains")).first()
        return row.asDict() | {"jobs": dict(Counter(j.status for j in self.jobs.values()))}

    def delete(self, url: str) -> None:
        """Takes a page's chunks out of the index."""
        self.store.delete(self.store.read().where(F.col("metadata")["url"] == url).select("id"))

    def clear(self) -> None:
        self.store.delete(self.store.read().select("id"))


def check(spark: SparkSession, claims: list[str], pages: DataFrame, lists: DataFrame, top_k: int = 10) -> DataFrame:
    """One JSON result a claim over the pages (url, text)."""
    asked = spark.createDataFrame(list(enumerate(claims)), "claim_id int, claim string").withColumn("claim", squeeze(F.col("claim")))
    found = flows.trusted_evidence_pages(asked, pages, lists)
    seen, verdicts, verified = flows.check_claims(asked, found, top_k=bounded(top_k, TOP_K, "top_k"))
    return verdict.result_envelope(verdicts, verified, seen)


def run_battery(spark: SparkSession, name: str, pages: DataFrame, lists: DataFrame, top_k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(claim_id, claim, expected, actual, note) and the tally of a battery of claims over the pages (url, text)."""
    rows = [(i, *case) for i, case in enumerate(BATTERIES[name])]
    cases = verdict.gate_claims(spark.createDataFrame(rows, "claim_id int, text string, expected string, note string"))
    asked = cases.select("claim_id", F.col("probe").alias("claim"))
    verdicts = flows.check_claims(asked, flows.trusted_evidence_pages(asked, pages, lists), top_k=bounded(top_k, TOP_K, "top_k"))[1]
    out = cases.join(verdicts.select("claim_id", "verdict"), "claim_id", "left").select("claim_id", F.col("text").alias("claim"), "expected", F.coalesce("verdict", F.lit(NO_INFO)).alias("actual"), "note")
    return out, verdict.battery_tally(out)


def evaluate(engine_results: DataFrame, judgements: DataFrame, k: int = 10) -> dict:
    return evaluation.mean_metrics(evaluation.query_metrics(engine_results, judgements, k)).first().asDict()


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="evidentia", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, text in (("query", "run a registered query on a folder of tables"), ("index", "index the table pages"), ("search", "search an index"), ("check", "check claims against the table documents"), ("stats", "count an index"), ("recent", "pages of an index"), ("delete", "take a page out of an index"), ("crawl", "crawl the table pages from the URLs of a file, one a line, and index what is found"), ("battery", "check a battery of claims: core, social or news"), ("list", "list the registered queries")):
        p = sub.add_parser(name, help=text)
        p.add_argument("--tables", default="/root/testdata/sf0.001", help="folder of Parquet tables")
        if name in ("index", "search", "stats", "recent", "delete", "crawl"):
            p.add_argument("--store", required=True, help="folder of the index")
        if name in ("query", "search", "check", "delete", "crawl", "battery"):
            p.add_argument("words", nargs="+")
        if name == "crawl":
            p.add_argument("--seeds", required=True, help="file of URLs")
        if name == "battery":
            p.add_argument("--json", help="folder for the results as JSON")
        if name in ("search", "check", "battery"):
            p.add_argument("--top-k", type=int, default=10)
    got = parser.parse_args(args)
    if got.command == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return
    spark = SparkSession.builder.appName("evidentia").getOrCreate()
    if got.command == "query":
        catalogue.QUERIES[got.words[0]](spark, got.tables).show(50, truncate=100)
    elif got.command in ("check", "battery"):
        docs = tables.table(spark, got.tables, "documents").select(F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("url"), "text")
        none = spark.createDataFrame([], "domain string, tier string")
        if got.command == "battery":
            cases, tally = run_battery(spark, got.words[0], docs, trust.usual_lists(spark), got.top_k)
            if got.json:
                tables.write_json(cases, got.json)
            cases.orderBy("claim_id").show(50, truncate=60)
            print(json.dumps(tally.first().asDict()))
            return
        for r in check(spark, [" ".join(got.words)], docs, none, got.top_k).collect():
            print(r.result)
    else:
        engine = SearchEngine(spark, got.store)
        if got.command == "index":
            print(json.dumps(vars(engine.index(tables.table(spark, got.tables, "pages")))))
        elif got.command == "stats":
            print(json.dumps(engine.stats()))
        elif got.command == "recent":
            engine.recent().show(50, truncate=100)
        elif got.command == "delete":
            engine.delete(got.words[0])
        elif got.command == "crawl":
            seeds = spark.read.text(got.seeds).select(F.trim("value").alias("url")).where("url != ''")
            print(json.dumps(vars(engine.crawl(" ".join(got.words), seeds, from_table(tables.table(spark, got.tables, "pages"))))))
        else:
            engine.search(" ".join(got.words), time.time(), top_k=got.top_k).show(truncate=100)


if __name__ == "__main__":
    main()
