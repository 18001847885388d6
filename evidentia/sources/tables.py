"""Readers and writers of tables, images and JSON results; the vector store is in vectors.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.media import IMAGE_TYPES
from .vectors import VectorTable  # noqa: F401  one of the tables

IMAGE_GLOB = "*.{png,jpg,jpeg,webp,bmp,tif,tiff}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of the image files at a folder, file or glob."""
    return spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_GLOB).option("recursiveFileLookup", "true").load(path)


def image_extension(content_type: Column, url: Column) -> Column:
    """The extension by content type, else that of the URL, else .png."""
    known = F.create_map(*[F.lit(x) for pair in IMAGE_TYPES.items() for x in pair])
    from_url = F.lower(F.regexp_extract(url, r"(\.[A-Za-z]{3,4})(?:[?#]|$)", 1))
    return F.coalesce(F.try_element_at(known, F.lower(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1)))), F.when(from_url != "", from_url), F.lit(".png"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def search_response(ranked: DataFrame, *, query_col: str = "query", full: bool = False, asked: DataFrame | None = None) -> DataFrame:
    """One JSON text a query, in order of rank: url and score, or every field; with asked, the table of queries, those without results have an empty list."""
    item = F.struct(F.col("rank").alias("o"), *([F.col(c) for c in ranked.columns if c not in (query_col, "rank")] if full else [F.col("url"), F.col("score")]))
    rows = ranked.groupBy(query_col).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x.dropFields("o")).alias("evidence"))
    if asked is not None:
        rows = asked.select(query_col).distinct().join(rows, query_col, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(rows.schema["evidence"].dataType)))
    return rows.select(query_col, F.to_json(F.struct(F.col(query_col).alias("user_query"), "evidence")).alias("response"))


def build(kind: str, makers: dict):
    """The maker of a configured back end, or an error that names it."""
    if kind not in makers:
        raise ValueError(f"unknown backend: {kind}")
    return makers[kind]
