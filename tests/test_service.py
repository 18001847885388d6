import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia import checkpoints
from evidentia.operators import expansion, regions, trust
from evidentia.plans import catalogue, service
from evidentia.sources import fetch, tables


def test_index_and_search(spark, sf_dir, tmp_path):
    engine = service.SearchEngine(spark, str(tmp_path / "store"))
    pages = tables.table(spark, sf_dir, "pages")
    first = engine.index(pages)
    assert first.status == "done" and first.chunks_indexed > 0 and first.pages_crawled == pages.count()
    assert first.chunks_indexed == engine.store.count() and first.pages_per_second > 0
    assert engine.index(pages).chunks_indexed == 0
    text = engine.store.read().orderBy("id").first().text
    got = engine.search(" ".join(text.split()[:40]), catalogue.AS_OF, top_k=5).collect()
    assert 1 <= len(got) <= 5 and [r["rank"] for r in got] == list(range(1, len(got) + 1))
    engine.clear()
    assert engine.store.count() == 0
    with pytest.raises(ValueError):
        engine.search("", 0.0)
    with pytest.raises(ValueError):
        engine.search("x", 0.0, top_k=51)


def test_check(spark):
    pages = spark.createDataFrame([(f"https://s{i}.gov/x", "The tower in the old harbour was finished in the spring of nineteen hundred. " * 3) for i in range(3)], "url string, text string")
    claim = "The tower in the old harbour was finished in the spring of nineteen hundred."
    out = [json.loads(r.result) for r in service.check(spark, [claim], pages, spark.createDataFrame([], "domain string, tier string")).collect()]
    assert out[0]["final_prediction"] == "SUPPORTS" and out[0]["verification"]["verified"] and out[0]["verification"]["independent_sources"] == 3


def test_failed_job():
    def work():
        raise OSError("down")

    job = service.CrawlJob("q").run(work)
    assert (job.status, job.error) == ("error", "down") and len(job.job_id) == 8


def test_expansion(spark):
    queries = spark.createDataFrame([("big fast car",), ("none",)], "query string")
    synonyms = spark.createDataFrame([("fast", "quick"), ("big", "large"), ("big", "huge"), ("car", "auto"), ("fast", "large")], "term string, synonym string")
    got = {r.query: r.expanded_terms for r in expansion.expand_by_synonyms(queries, synonyms, most=3).collect()}
    assert got == {"big fast car": ["huge", "large", "quick"], "none": []}
    answers = spark.createDataFrame([('Sure: ["a", "b"]',), ("no",)], "a string")
    assert [r.x for r in answers.select(expansion.expand_by_model(F.col("a"), 1).alias("x")).collect()] == [["a"], []]


def test_regions(spark):
    rng = np.random.default_rng(1)
    grey = np.full((300, 400), 200.0)
    grey[50:250, 40:360] = rng.integers(0, 255, (200, 320))
    boxes = regions.picture_boxes(grey, [])
    assert len(boxes) == 1 and abs(boxes[0][0] - 40) < 30 and abs(boxes[0][2] - 320) < 60
    collage = rng.integers(0, 255, (200, 210)).astype(float)
    collage[:, 100:110] = 128
    assert regions.split_collage(collage) == [(0, 0, 105, 200), (105, 0, 105, 200)]
    df = spark.createDataFrame([(1, 400, grey.ravel().tolist(), [])], "image_id int, width int, cells array<double>, boxes array<struct<x: int, y: int, w: int, h: int>>")
    assert regions.detect_regions(df).count() == 1


def test_command_line(capsys):
    service.main(["list"])
    assert "claim_check" in capsys.readouterr().out


def test_crawl_jobs_recent_pages_and_counts(spark, tmp_path):
    text = "<p>" + "The old harbour has a tower and a long red wall beside the water. " * 5 + "</p>"
    pages = spark.createDataFrame([("https://a.org/1", f'<title>One</title>{text}<p>Here is a page about the <a href="/2">harbour tower</a>.</p><p>Something of no interest: <a href="/3">nothing else</a>.</p>'), ("https://a.org/2", f"<title>Two</title>{text.replace('old', 'new')}"), ("https://a.org/3", f"<title>Three</title>{text}")], "url string, html string")
    engine = service.SearchEngine(spark, str(tmp_path / "store"))
    checkpoints.folder(spark)
    job = engine.crawl("harbour tower", pages.where("url like '%/1'").select("url"), fetch.from_table(pages), max_depth=1)
    assert job.error is None and job.status == "done" and job.pages_crawled == 2 and engine.job(job.job_id) is job and engine.job("none") is None
    assert [r.url for r in engine.recent().collect()] == ["https://a.org/1", "https://a.org/2"]
    assert engine.stats() == {"chunks": job.chunks_indexed, "pages": 2, "domains": 1, "jobs": {"done": 1}}
    engine.delete("https://a.org/1")
    assert [r.url for r in engine.recent(5).collect()] == ["https://a.org/2"]
    with pytest.raises(ValueError):
        engine.recent(0)


def test_batteries(spark):
    pages = spark.createDataFrame([("https://www.reuters.com/x", " ".join([service.BATTERIES["core"][2][0]] * 4)), ("https://www.bbc.com/x", " ".join([service.BATTERIES["core"][2][0]] * 4))], "url string, text string")
    cases, tally = service.run_battery(spark, "core", pages, trust.usual_lists(spark))
    got = {r.claim_id: (r.expected, r.actual) for r in cases.collect()}
    assert got[2] == ("SUPPORTS", "SUPPORTS") and len(got) == 7
    row = tally.first()
    assert (row.total, row.passed + row.failed) == (7, 7) and row.passed == sum(a == b for a, b in got.values())
    assert [len(service.BATTERIES[k]) for k in ("core", "social", "news")] == [7, 13, 2]
