"""Keyed tables: upserts, expiry, eviction, deletion, incremental indexing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import chunk_id, content_hash


def latest(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row a key: the last in order. An aggregate with map-side combining, so that a hot key is no hot task."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__x"))
    return best.select(*keys, *[F.col("__x")[c].alias(c) for c in rest]).select(*rows.columns)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """table with the last change of each key in place of its row."""
    newest = latest(changes, keys, order)
    return table.join(newest.select(*keys), keys, "left_anti").unionByName(newest)


def mark(table: DataFrame, chosen: DataFrame, key: str, column: str, value: object) -> DataFrame:
    """table with value in column for the keys in chosen."""
    hit = chosen.select(key, F.lit(True).alias("__hit")).distinct()
    return table.join(hit, key, "left").withColumn(column, F.when(F.col("__hit"), F.lit(value)).otherwise(F.col(column))).select(*table.columns)


def delete(table: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    return table.join(chosen.select(key), key, "left_anti")


def recent(table: DataFrame, n: int, *, time_col: str = "crawl_timestamp", tie_col: str = "url") -> DataFrame:
    return table.orderBy(F.desc(time_col), F.asc(tie_col)).limit(n)


def alive_entries(cache: DataFrame, as_of: float, ttl: float, *, time_col: str = "added_at") -> DataFrame:
    return cache.where(F.lit(as_of) - F.col(time_col) < ttl)


def evict_oldest(cache: DataFrame, *, limit: int = 200, batch: int = 50, time_col: str = "added_at", key: str = "key") -> DataFrame:
    """cache without its ``batch`` oldest entries if it has more than ``limit``."""
    if cache.count() <= limit:
        return cache
    return cache.join(cache.orderBy(time_col, key).limit(batch).select(key), key, "left_anti")


def fill_cache(keys: DataFrame, cache: DataFrame, compute, *, key: str = "key", as_of: float, ttl: float) -> DataFrame:
    """(key, value, added_at) for keys: live entries as they are, the others computed. compute: DataFrame of keys to (key, value)."""
    asked = keys.select(key).distinct()
    live = alive_entries(cache, as_of, ttl).join(asked, key, "left_semi")
    made = compute(asked.join(live.select(key), key, "left_anti")).select(key, "value", F.lit(as_of).alias("added_at"))
    return live.select(key, "value", "added_at").unionByName(made)


def to_index(pages: DataFrame, stored: DataFrame, *, url_col: str = "url", text_col: str = "text") -> DataFrame:
    """pages with content_hash that aren't indexed yet with this content; of repeated pages one stays."""
    hashed = pages.withColumn("content_hash", content_hash(F.coalesce(F.col(text_col), F.lit("")))).dropDuplicates([url_col, "content_hash"])
    known = stored.where("indexed").select(F.col("url").alias("__u"), F.col("content_hash").alias("__h"))
    return hashed.join(known, (F.col(url_col) == F.col("__u")) & (F.col("content_hash") == F.col("__h")), "left_anti")


def chunk_rows(chunks: DataFrame, *, url_col: str = "url") -> DataFrame:
    """chunks with the id that an index keeps them under."""
    return chunks.withColumn("id", chunk_id(F.col(url_col), F.col("chunk_index")))


def clean_metadata(entries: Column) -> Column:
    """Null values of a map as empty texts."""
    return F.transform_values(entries, lambda _, v: F.coalesce(v.cast("string"), F.lit("")))


def counters(pages: DataFrame) -> DataFrame:
    """(pages, indexed, failed, mean_depth) of the metadata table."""
    return pages.agg(F.count(F.lit(1)).alias("pages"), F.count_if("indexed").alias("indexed"), F.count_if(F.col("http_status") != 200).alias("failed"), F.avg("depth").alias("mean_depth"))
