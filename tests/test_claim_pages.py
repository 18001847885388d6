"""Operators do the whole job: nothing is left out by a prefix, a length or an id."""

from pyspark.sql import functions as F

from evidentia.plans import catalogue, flows


def test_pages_are_found_by_any_term(spark):
    claims = spark.createDataFrame([(1, "The sky is blue."), (2, "(Crimson), something!"), (3, "12 34")], "claim_id int, claim string")
    pages = spark.createDataFrame([("https://a.org/1", "a blue bird"), ("https://b.org/2", "something else, crimson"), ("https://c.org/3", "56 78")], "url string, text string")
    lists = spark.createDataFrame([("b.org", "trusted")], "domain string, tier string")
    found = {(r.claim_id, r.url) for r in flows.trusted_evidence_pages(claims, pages, lists).collect()}
    assert found == {(1, "https://a.org/1"), (2, "https://b.org/2")}


def test_every_claim_of_the_benchmark_finds_pages(spark, sf_dir):
    claims, found = catalogue._claims(spark, sf_dir)
    with_terms = claims.where(F.col("claim").rlike(r"(?i)\b[a-z]{3,}\b"))
    assert with_terms.join(found, "claim_id", "left_anti").count() == 0


def test_best_pages_are_those_of_the_whole_join(spark):
    """Several tiers of trust, sizes and ties, and claims with frequent and rare terms, against a plain version."""
    import math
    import random

    from evidentia.functions.text import letters_tokens
    from evidentia.operators import retrieval

    rng = random.Random(3)
    names = [f"{a}{b}{c}" for a in "abcdefgh" for b in "mnop" for c in "xyz"]
    text = lambda n: " ".join(names[min(int(rng.expovariate(0.06)), len(names) - 1)] for _ in range(n))
    pages = [(f"u{i:04d}", text(rng.choice([1, 2, 5, 20, 60, 400])), rng.choice([0.2, 1.0, 1.0, 1.0, 2.0] if i % 7 else [3.0, 1.0])) for i in range(1500)]
    pages += [(f"same{i}", pages[3][1], 1.0) for i in range(40)] + [("none", None, 2.0), ("empty", "", 2.0), ("digits", "12 3", 2.0)]
    claims = [(i, text(rng.choice([1, 3, 12, 40]))) for i in range(30)] + [(98, None), (99, "zzz"), (100, "12")]
    own = {u: set((t or "").split()) - {"12", "3"} for u, t, _ in pages}
    often = {}
    for ts in own.values():
        for t in ts:
            often[t] = often.get(t, 0) + 1
    want = set()
    for c, claim in claims:
        weight = {t: round(math.log1p(len(pages) / often[t]) * 1e6) for t in set((claim or "").split()) if t in often}
        hits = {u: sum(weight.get(t, 0) for t in ts) for u, ts in own.items() if ts & weight.keys()}
        trust = {u: x for u, _, x in pages}
        best = sorted(hits, key=lambda u: (-trust[u], -hits[u] / math.sqrt(len(own[u])), len(own[u]), u))[:15]
        want |= {(c, u, k) for k, u in enumerate(best, 1)}
    df, asked = spark.createDataFrame(pages, "url string, text string, trust double"), spark.createDataFrame(claims, "claim_id int, claim string")
    got = {(r.claim_id, r.url, r["rank"]) for r in retrieval.best_pages(asked, df, 15, terms=letters_tokens).collect()}
    assert got == want and len(want) > 400
    assert retrieval.best_pages(asked, df.limit(0), 15, terms=letters_tokens).count() == 0


def test_pages_of_one_host_are_dealt_out_and_texts_fetched_once(spark):
    """Rows of a host, with their texts, are not one task's; what follows reads the found texts alone."""
    from evidentia.operators import trust

    pages = spark.range(2000).select(F.concat(F.lit("https://www.b.org/"), F.col("id").cast("string")).alias("url"), F.lit("a word").alias("text"))
    pages = pages.unionByName(spark.createDataFrame([(None, "a word"), ("", "b word")], "url string, text string"))
    lists = spark.createDataFrame([("b.org", "trusted")], "domain string, tier string")
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        rated = trust.with_trust(pages, "url", lists)
        most = rated.groupBy(F.spark_partition_id()).agg(F.count("trust").alias("n")).agg(F.max("n")).first()[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert most < 1000
    assert {(r.url in (None, ""), r.trust) for r in rated.select("url", "trust").distinct().collect()} == {(False, 2.0), (True, 1.0)}
    claims = spark.createDataFrame([(1, "some word")], "claim_id int, claim string")
    found = flows.trusted_evidence_pages(claims, pages, lists)
    assert found.count() == 15 and "Join" not in found._jdf.queryExecution().sparkPlan().toString()
