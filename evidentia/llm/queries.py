"""The registered queries of the operators, and the SQL that their results are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, balltree, chat, decontam, jaccard, langid, mixing, oracles, qda, rules, secrets, suffixdedup, toxicity, warc
from .spark_io import stage_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_turns(turns.unionByName(extra)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.drop("rules")


def op4_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = qda.score_quality(docs, labels.where(langid.fold(F.col("doc_id"), 5) != 0))
    return scored.select("doc_id", (langid.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digest(suffixdedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    field = langid.fit(docs.where(langid.fold(F.col("doc_id"), 5) != 0))
    return langid.identify(docs, field).select("doc_id", (langid.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    grammar = toxicity.fit(docs, labels.where(langid.fold(F.col("doc_id"), 3) != 1))
    scored = toxicity.score_toxicity(docs, grammar)
    return scored.select("doc_id", (langid.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{stage_folder(spark)}/warc"
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.cluster(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_poisson_mix": op1_poisson_mix,
    "op2_chat_format": op2_chat_format,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_qda": op4_quality_qda,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_secret_scan": op8_secret_scan,
    "op9_signature_trees": op9_signature_trees,
    "op10_decontamination": op10_decontamination,
    "op11_filter_audit": op11_filter_audit,
    "op12_warc_archives": op12_warc_archives,
    "op13_ball_tree_clusters": op13_ball_tree_clusters,
}

ORACLES: dict[str, str] = oracles.ORACLES
