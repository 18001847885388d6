"""Verdicts: trust-weighted votes, verification by several sources, gates, media and post verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import CARDS, NO_INFO, REFUTES, SHARE_NEEDED, SOURCES_NEEDED, STRONG_REFUTATION, STRONG_SHARE, SUPPORTS, TRUSTED_CREDIBILITY, VIDEO_FAKE
from ..functions.text import clean_claim, has_claim
from ..functions.urls import evidence_domain


def claim_verdicts(evidence: DataFrame, *, by: str = "claim_id") -> DataFrame:
    """(claim, verdict, confidence, supports, refutes, no_info): shares of probability weighted by retrieval score and credibility.

    evidence: by, retrieval_score, credibility, p_supports, p_refutes, p_no_info; null probabilities and
    scores count 0, a null credibility 1. A strong refutation with share enough goes first.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    weight = zero("retrieval_score") * F.coalesce(F.col("credibility"), F.lit(1.0))
    sums = evidence.groupBy(by).agg(
        F.sum(zero("p_supports") * weight).alias("s"), F.sum(zero("p_refutes") * weight).alias("r"), F.sum(zero("p_no_info") * weight).alias("n"), F.max(zero("p_refutes")).alias("top")
    )
    total = F.col("s") + F.col("r") + F.col("n")
    share = lambda c: F.when(total >= 1e-6, F.col(c) / total).otherwise(F.lit(0.0))
    shares = sums.select(by, "top", total.alias("total"), share("s").alias("supports"), share("r").alias("refutes"), share("n").alias("no_info"))
    strong = (F.col("top") >= STRONG_REFUTATION) & (F.col("refutes") >= STRONG_SHARE)
    some = F.col("total") >= 1e-6
    verdict = F.when(~some, NO_INFO).when(strong, REFUTES).when(F.col("supports") >= SHARE_NEEDED, SUPPORTS).when(F.col("refutes") >= SHARE_NEEDED, REFUTES).otherwise(NO_INFO)
    sure = F.when(~some, F.lit(0.0)).when(strong, F.col("top")).when(F.col("supports") >= SHARE_NEEDED, F.col("supports")).when(F.col("refutes") >= SHARE_NEEDED, F.col("refutes")).otherwise(F.greatest("supports", "refutes"))
    return shares.select(by, verdict.alias("verdict"), sure.alias("confidence"), "supports", "refutes", "no_info")


def verify_sources(evidence: DataFrame, verdicts: DataFrame, *, by: str = "claim_id") -> DataFrame:
    """(claim, verified, independent_sources, trusted_agree, trusted_contradict, statement).

    evidence: by, url, credibility, label. Sources of a claim are first reduced to one row a domain, so
    the sets that are collected are as large as the number of distinct trusted domains.
    """
    rows = evidence.select(by, evidence_domain(F.col("url")).alias("domain"), "label", (F.coalesce(F.col("credibility"), F.lit(1.0)) >= TRUSTED_CREDIBILITY).alias("trusted")).join(verdicts.select(by, "verdict"), by)
    agree = F.col("label") == F.col("verdict")
    definite = F.col("label").isin(SUPPORTS, REFUTES) & F.col("verdict").isin(SUPPORTS, REFUTES)
    domains = rows.groupBy(by, "verdict", "domain").agg(F.bool_or(agree).alias("a"), F.bool_or(agree & F.col("trusted")).alias("ta"), F.bool_or(~agree & definite & F.col("trusted")).alias("tc"))
    found = domains.groupBy(by, "verdict").agg(
        F.count_if("a").cast("int").alias("independent_sources"),
        F.sort_array(F.collect_list(F.when(F.col("ta"), F.col("domain")))).alias("trusted_agree"),
        F.sort_array(F.collect_list(F.when(F.col("tc"), F.col("domain")))).alias("trusted_contradict"),
    )
    n, agreeing, contra = F.col("independent_sources"), F.size("trusted_agree"), F.size("trusted_contradict")
    verified = F.col("verdict").isin(SUPPORTS, REFUTES) & (n >= SOURCES_NEEDED) & (agreeing > 0) & (contra == 0)
    statement = (
        F.when(F.col("verdict") == NO_INFO, F.lit("Not enough reliable evidence to verify this claim."))
        .when(verified, F.format_string("%s — %d independent sources agree (%d trusted).", "verdict", n, agreeing))
        .when((n >= 1) & (agreeing == 0), F.format_string("Leans %s, but only low-authority sources agree (%d). Treat with caution.", "verdict", n))
        .when(contra > 0, F.format_string("Conflicting evidence: %s disputed by %d trusted source(s).", "verdict", contra))
        .otherwise(F.format_string("Leans %s (%d source(s)) — weak support.", "verdict", n))
    )
    return found.select(by, verified.alias("verified"), "independent_sources", "trusted_agree", "trusted_contradict", statement.alias("statement"))


def gate_claims(posts: DataFrame, *, text_col: str = "text", english_col: str | None = None, is_factual: Column | None = None) -> DataFrame:
    """posts with cleaned, probe and is_claim: the English text is probed if it passes the first gate, else the cleaned one; is_factual is the second gate, true where no model decides."""
    cleaned = clean_claim(F.coalesce(F.col(text_col), F.lit("")))
    english = F.col(english_col) if english_col else F.lit(None).cast("string")
    probe = F.when(F.coalesce(has_claim(english), F.lit(False)), english).otherwise(cleaned)
    return posts.withColumns({"cleaned": cleaned, "probe": probe}).withColumn("is_claim", has_claim(F.col("probe")) & F.coalesce(is_factual if is_factual is not None else F.lit(True), F.lit(True)))


def video_verdicts(frames: DataFrame, *, by: str = "video_id") -> DataFrame:
    """(video, avg_real, avg_fake, verdict, n): REAL if the mean real probability is the larger one."""
    means = frames.groupBy(by).agg(F.avg("p_real").alias("avg_real"), F.avg("p_fake").alias("avg_fake"), F.count(F.lit(1)).alias("n"))
    return means.withColumn("verdict", F.when(F.col("avg_real") > F.col("avg_fake"), "REAL").otherwise("FAKE"))


def shown_video_verdict(avg_fake: Column) -> Column:
    """What a client shows: FAKE above the limit of the mean fake probability, whatever the real one."""
    return F.when(avg_fake > VIDEO_FAKE, "FAKE").otherwise("REAL")


def evidence_cards(evidence: DataFrame, *, by: str = "claim_id", most: int = CARDS) -> DataFrame:
    """The first ``most`` evidence rows of each claim by rank."""
    return evidence.where(F.col("rank") <= most)


def post_verdicts(parts: DataFrame, *, by: str = "post_id") -> DataFrame:
    """(post, fake_image, refuted_text, verdict, confidence) from rows with fake_image and refuted_text flags."""
    either = parts.groupBy(by).agg(F.coalesce(F.bool_or("fake_image"), F.lit(False)).alias("fake_image"), F.coalesce(F.bool_or("refuted_text"), F.lit(False)).alias("refuted_text"))
    label = F.when(F.col("fake_image") & F.col("refuted_text"), "FAKE").when(F.col("fake_image"), "FAKE IMAGE").when(F.col("refuted_text"), "MISLEADING TEXT").otherwise("AUTHENTIC")
    return either.withColumn("verdict", label).withColumn("confidence", F.lit(0.85))


def explanation_input(evidence: DataFrame, verdicts: DataFrame, *, by: str = "claim_id", most: int = 5, pos_col: str = "pos") -> DataFrame:
    """The first rows that agree with the verdict, or of all rows where none agrees."""
    from .ranking import top_rows

    rows = evidence.join(verdicts.select(by, "verdict"), by).withColumn("__other", F.when(F.col("label") == F.col("verdict"), 0).otherwise(1))
    some = rows.groupBy(by).agg(F.min("__other").alias("__least"))
    return top_rows(rows.join(some, by).where("__other = __least"), most, by=[by], order=[F.asc(pos_col)]).drop("__other", "__least", "rank", "verdict")


def battery_tally(cases: DataFrame) -> DataFrame:
    """(total, passed, failed) of rows with expected and actual."""
    passed = F.count_if(F.col("expected").eqNullSafe(F.col("actual")))
    return cases.agg(F.count(F.lit(1)).alias("total"), passed.alias("passed"), (F.count(F.lit(1)) - passed).alias("failed"))


def result_envelope(verdicts: DataFrame, verification: DataFrame, evidence: DataFrame, *, by: str = "claim_id", shown: int = 400, top_k: int = 10) -> DataFrame:
    """One JSON document a claim: verdict, confidence, the top_k evidence rows in order of retrieval score and URL, verification."""
    from .ranking import top_rows

    evidence = top_rows(evidence, top_k, by=[by], order=[F.desc("retrieval_score"), F.asc("url")])
    item = F.struct((-F.col("retrieval_score")).alias("o"), F.col("url"), F.round("retrieval_score", 4).alias("retrieval_score"), F.col("credibility"), F.col("label").alias("nli_label"), F.substring("text", 1, shown).alias("snippet"))
    own = evidence.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x.dropFields("o")).alias("evidence"))
    parts = verdicts.join(own, by, "left").join(verification, by, "left")
    body = F.struct(F.col("verdict").alias("final_prediction"), F.round("confidence", 4).alias("confidence"), F.coalesce(F.col("evidence"), F.array()).alias("evidence"), F.struct("verified", "independent_sources", "trusted_agree", "trusted_contradict", "statement").alias("verification"))
    return parts.select(by, F.to_json(body).alias("result"))
