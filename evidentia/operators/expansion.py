"""Query expansion: synonyms from a table, terms from a model, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_json_list, query_terms


def expand_by_synonyms(queries: DataFrame, synonyms: DataFrame, *, most: int = 10, query_col: str = "query") -> DataFrame:
    """queries with ``expanded_terms``: synonyms (term, synonym) of their terms, each once, in order of term and synonym, at most ``most``."""
    keyed = queries.withColumn("__q", F.xxhash64(query_col))
    terms = keyed.select("__q", F.posexplode(query_terms(F.col(query_col))).alias("pos", "term"))
    found = terms.join(synonyms.select(F.lower("term").alias("term"), F.lower("synonym").alias("synonym")), "term").where("term != synonym")
    first = found.groupBy("__q", "synonym").agg(F.min("pos").alias("pos"))
    lists = first.groupBy("__q").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "synonym"))), lambda x: x["synonym"]), 1, most).alias("expanded_terms"))
    return keyed.join(lists, "__q", "left").withColumn("expanded_terms", F.coalesce("expanded_terms", F.array().cast("array<string>"))).drop("__q")


def expand_by_model(answer: Column, most: int = 10) -> Column:
    """The terms of a model's answer: the first JSON list in it, none where there is none."""
    return F.coalesce(first_json_list(answer, most), F.array().cast("array<string>"))


def all_terms(query: Column, expanded: Column) -> Column:
    return query_terms(query, expanded)


def explanation_prompt(claim: Column, verdict: Column, confidence: Column, evidence: Column) -> Column:
    """The text that a model is asked to explain a verdict by. evidence: array<struct<url, text>>."""
    lines = F.array_join(F.transform(evidence, lambda e, i: F.format_string("[%d] %s: %s", i + 1, e["url"], F.substring(e["text"], 1, 300))), "\n")
    return F.concat_ws("\n", F.concat(F.lit("Claim: "), claim), F.format_string("Verdict: %s (%.2f)", verdict, confidence), F.lit("Evidence:"), lines, F.lit("Explain the verdict in two or three sentences, from this evidence only."))
