import random
import re

import brute
import pytest

import corpus_pipeline as pipeline


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_each_stage_takes_effect(spark, docs, sf_dir):
    extra = spark.createDataFrame([(900001, "12345 *** 67890", "en", "s", 15), (900002, None, None, None, None), (900003, "", "fr", "s", 0)], docs.schema)
    stages = dict(pipeline.STAGES)
    out = stages["language_id"](spark, docs.unionByName(extra), sf_dir)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} and out.columns == docs.columns
    rows = docs.orderBy("doc_id").collect()
    out = stages["near_duplicates"](spark, docs, sf_dir)
    assert sorted(r.doc_id for r in out.collect()) == sorted({rows[c].doc_id for _, c in brute.op9([r.text for r in rows])}) and out.columns == docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    out = stages["decontamination"](spark, docs, sf_dir)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r, x in zip(rows, brute.op10([r.text for r in rows], items), strict=True) if not x[-1]} and out.columns == docs.columns
    out = stages["secret_scan"](spark, docs, sf_dir)
    assert out.columns == docs.columns and out.count() == len(rows)
    for r in out.collect():
        assert r.n_chars == len(r.text) and brute.op8(r.text)[:3] == (0, 0, 0) and not re.search("AKIA[A-Z0-9]{14}", r.text)
    assert {"copy", "shuffle_key", *docs.columns} == set(stages["source_mix"](spark, docs, sf_dir).columns)


def test_run_writes_and_reads_every_stage(spark, sf_dir, docs):
    out = pipeline.run(spark, sf_dir)
    assert 0 < out.count() < 2 * docs.count() and {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}


FINNISH = "ja on se ei että mutta kun niin minä sinä hän olla kaikki joka tämä hyvä päivä talossa kissalla koirasta menemme tulisivat yhdeksän kaksikymmentä puhelimella työssä huomenna aurinko paistaa järvellä".split()
POLISH = "nie jest się na z do że jak ale co dla był przez jego tylko czy już może kiedy dlaczego szczęście źródło książka człowiek wszystkie dziewczyna przyszłość żółty świat".split()


def test_language_stage_drops_mixed_random_and_unlearned_texts(spark):
    """200 texts of each kind among the documents: nine tenths of each kind go, and less than a hundredth of the documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng, long = random.Random(7), {}
    for r in docs.orderBy("doc_id").collect():
        if r.lang and len((r.text or "").split()) >= 80:
            long.setdefault(r.lang, []).append(r.text.split())

    def mixed():
        one, two = (rng.choice(long[x]) for x in rng.sample(sorted(long), 2))
        n = min(len(one), len(two), 150)
        return " ".join(one[:n] + two[-n:])

    letters = "abcdefghijklmnopqrstuvwxyz"
    kinds = {
        "mixed": mixed,
        "random": lambda: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 10))) for _ in range(rng.choice([30, 120]))),
        "unlearned": lambda: " ".join(rng.choice(rng.choice([FINNISH, POLISH])) for _ in range(rng.choice([40, 120]))),
    }
    planted = [(10**6 + 1000 * k + i, make(), None, name, 0) for k, (name, make) in enumerate(kinds.items()) for i in range(200)]
    out = pipeline.language_id(spark, docs.unionByName(spark.createDataFrame(planted, docs.schema)), "")
    kept = {r.source: r["count"] for r in out.where("doc_id >= 1000000").groupBy("source").count().collect()}
    assert all(kept.get(name, 0) <= 20 for name in kinds), kept
    assert out.where("doc_id < 1000000").count() > 0.99 * docs.count()


def test_language_stage_drops_documents_of_the_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    gone = docs.count() - pipeline.language_id(spark, docs, "").count()
    assert 10 <= gone < 0.005 * docs.count()
