"""Schemas of the stored tables, as DDL: Spark takes these texts wherever it takes a schema, and they need no running session."""

from __future__ import annotations


FRONTIER = "fingerprint string, url string, priority double, depth int, parent_url string, discovered_at double, relevance_score double, status string"
SEEN = "fingerprint string, added_at double"
POLITENESS = "domain string, next_allowed_at double"
PAGES = "fingerprint string, url string, title string, domain string, crawl_timestamp double, http_status int, content_hash string, indexed boolean, depth int, relevance_score double"
DOWNLOAD = "url string, final_url string, status int, html string, content_type string, error string, crawl_delay double, elapsed_ms double"
EXTRACTED = "url string, title string, text string, lang string, word_count int, extraction_method string, published_date string"
LINK = "url string, anchor_text string, surrounding_text string, relevance_score double"
CHUNK = "text string, chunk_index int, start_char int, end_char int, token_count int"
VECTOR = "id string, text string, embedding array<float>, metadata map<string, string>"
EVIDENCE = "url string, title string, text string, retrieval_score double, credibility double"
PROBABILITIES = "supports double, refutes double, no_info double"
VERIFICATION = "verified boolean, independent_sources int, trusted_agree array<string>, trusted_contradict array<string>, statement string"
TASK = "task_id string, started double, stage string, pct int, message string, done boolean, error string"
CRAWL_JOB = "job_id string, status string, query string, pages_crawled int, chunks_indexed int, elapsed_seconds double, error string"
OCR_BLOCK = "text string, confidence double, bbox array<array<int>>"
IMAGE_REGION = "id int, type string, x int, y int, width int, height int, area_px int"
