"""The three entry flows as compositions of operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import kept
from ..functions.constants import MIN_RELEVANCE, PAGE_LEAST, PER_DOMAIN_CLAIMS, PER_DOMAIN_SEARCH, UNRELIABLE_DOMAINS
from ..functions.text import clickbait_factor, letters_tokens, snippet
from ..functions.trust import blended_score, freshness, is_listed
from ..functions.urls import evidence_domain, host_domain, registered_domain
from ..functions.vectors import dot, fused_score, sigmoid
from ..operators import chunking, html, models, ranking, retrieval, store, trust, verdict

#: Rows of found pages (claim, URL, numbers) that are sent to all tasks at most.
SENT = 20_000


def select_evidence(claims: DataFrame, pages: DataFrame, *, model: models.ModelBackend = models.DEFAULT, per_page: int = 2, top_k: int = 10, rerank: bool = True) -> DataFrame:
    """Evidence rows of each claim: (claim_id, url, text, retrieval_score, credibility, rank).

    claims: claim_id, claim. pages: claim_id, url, text, credibility: the pages found for a claim, so the
    work follows the number of pages, not claims x pages. Pages of fewer than PAGE_LEAST characters have no
    content. Chunks are scored by cosine, the best of each
    page above the floor stay, are re-ranked, capped by domain and cut to top_k.
    """
    chunks = chunking.chunk_claims(pages.where(F.length(F.trim("text")) >= PAGE_LEAST), keep=["claim_id", "url", "credibility"])
    asked = claims.select("claim_id", "claim", models.embed(F.col("claim"), model).alias("q"))
    scored = chunks.withColumn("v", models.embed(F.col("text"), model)).join(asked, "claim_id")
    scored = scored.withColumn("retrieval_score", F.round(dot(F.col("q"), F.col("v")), 4)).where(F.col("retrieval_score") >= MIN_RELEVANCE)
    best = ranking.top_rows(scored, per_page, by=["claim_id", "url"], order=[F.desc("retrieval_score"), F.asc("chunk_index")]).drop("rank", "v", "q")
    if rerank:
        many = best.groupBy("claim_id").agg(F.count(F.lit(1)).alias("__n"))
        best = best.join(many, "claim_id").withColumn("retrieval_score", fused_score(F.col("retrieval_score"), models.rerank(F.col("claim"), F.col("text"), model), F.col("__n"))).drop("__n")
    order = [F.desc("retrieval_score"), F.asc("url"), F.asc("chunk_index")]
    capped = ranking.cap_per_domain(best.withColumn("__d", evidence_domain(F.col("url"))), PER_DOMAIN_CLAIMS, by=["claim_id", "__d"], order=order).drop("__d")
    return ranking.top_rows(capped, top_k, by=["claim_id"], order=order)


def check_claims(claims: DataFrame, pages: DataFrame, *, model: models.ModelBackend = models.DEFAULT, top_k: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence with labels, verdicts, verification) of claims over the pages found for them."""
    chosen = select_evidence(claims, pages, model=model, top_k=top_k)
    seen = chosen.withColumn("p", models.infer(F.col("text"), F.col("claim"), model)).select("*", "p.*").drop("p")
    verdicts = verdict.claim_verdicts(seen)
    return seen, verdicts, verdict.verify_sources(seen, verdicts)


def search(queries: DataFrame, chunks: DataFrame, as_of: float, *, retrieve: int = 30, top_k: int = 10, min_score: float = 0.15, near_duplicates: bool = True, where: Column | None = None, model: models.ModelBackend = models.DEFAULT) -> DataFrame:
    """Ranked results of each query: (query_id, rank, url, title, snippet, score).

    queries: query_id, embedding, and query where results are to be re-ranked by a model. chunks: id, url, title, text, embedding, trust, published (epoch
    seconds or null). Nearest chunks, the best of each URL, near duplicates of a domain removed, domains
    capped, then relevance, trust and freshness blended and clickbait demoted.
    """
    found = ranking.nearest(queries, chunks, retrieve, vector_id="id", where=where).drop("rank")
    rows = found.join(chunks.drop("embedding"), "id").withColumn("chunk_no", F.col("id"))
    if "query" in queries.columns:
        rows = rows.join(queries.select("query_id", "query"), "query_id").withColumn("score", sigmoid(models.rerank(F.col("query"), F.col("text"), model))).drop("query")
    best = ranking.top_rows(rows, 1, by=["query_id", "url"], order=[F.desc("score"), F.asc("id")]).drop("rank", "chunk_no").withColumn("domain", host_domain(F.col("url")))
    if near_duplicates:
        best = ranking.near_duplicate_filter(best, by=["query_id", "domain"])
    capped = ranking.cap_per_domain(best, PER_DOMAIN_SEARCH, by=["query_id", "domain"], order=[F.desc("score"), F.asc("id")])
    blended = capped.withColumn("score", blended_score(F.col("score"), F.col("trust"), freshness(F.col("published"), as_of), clickbait_factor(F.col("title")))).where(F.col("score") >= min_score)
    ranked = ranking.top_rows(blended, top_k, by=["query_id"], order=[F.desc("score"), F.asc("id")])
    return ranked.select("query_id", "rank", "url", "title", snippet(F.col("text")).alias("snippet"), "score")


def index_pages(pages: DataFrame, stored: DataFrame, *, model: models.ModelBackend = models.DEFAULT, strategy: str = "sentence") -> DataFrame:
    """Index rows (id, url, chunk_index, text, embedding, title, domain, content_hash) of the pages (page_id, url, html) that aren't stored with this content."""
    texts = html.extract_content(pages, keep=["page_id", "url"]).where(~F.col("is_empty"))
    fresh = store.to_index(texts, stored)
    chunks = store.chunk_rows(chunking.chunk(fresh, strategy, keep=["url", "title", "content_hash"]))
    return chunks.select("id", "url", "chunk_index", "text", models.embed(F.col("text"), model).alias("embedding"), F.substring("title", 1, 200).alias("title"), host_domain(F.col("url")).alias("domain"), "content_hash")


def trusted_evidence_pages(claims: DataFrame, pages: DataFrame, lists: DataFrame, *, terms: Callable[[Column], Column] = letters_tokens, n: int = 10, unreliable: Sequence[str] = UNRELIABLE_DOMAINS) -> DataFrame:
    """(claim_id, url, text, credibility): for each claim the n + 5 most trusted of the pages that share a term with it, without pages of unreliable sources.

    pages: url, text, each URL once. Among equally trusted pages those with the weightier shared terms come first (operators.retrieval).
    """
    usable = pages.where(~is_listed(registered_domain(F.col("url")), unreliable))
    rated = trust.with_trust(usable.select("url", "text"), "url", lists)
    best = kept(retrieval.best_pages(claims, rated, n + 5, terms=terms))
    # The texts of the found pages are fetched once; where the pages are few, no other text is moved or split.
    few = best.count() <= SENT
    return kept(pages.select("url", "text").join(F.broadcast(best) if few else best, "url")).select("claim_id", "url", "text", F.col("trust").alias("credibility"))


def seed_urls(query: str, expanded: list[str], search: Callable[[str], DataFrame], n: int, *, expansions: int = 2) -> DataFrame:
    """Seeds of a crawl: what the search finds for the query and its first expansions, in that order, each URL once, at most n.

    search: a query text to (url, pos).
    """
    return ranking.discover([search(q) for q in [query, *expanded[:expansions]]], n)
