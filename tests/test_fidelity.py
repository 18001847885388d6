"""Behaviour that follows fixed values: trust of sources, regions of screenshots, batches of a search, fetching, models per worker."""

import numpy as np
from pyspark.sql import functions as F

from evidentia.functions import trust as score
from evidentia.functions.constants import UNRELIABLE_DOMAINS
from evidentia.operators import crawl, html, media, models, regions, trust, verdict
from evidentia.plans import flows
from evidentia.sources import fetch, tables


def test_trust_with_the_usual_lists(spark):
    want = {
        "https://www.reuters.com/a": 2.0, "https://edition.cnn.com/": 2.0, "https://snopes.com/": 2.0, "https://bbc.com": 2.0, "https://www.nytimes.com/x": 2.0, "https://infowars.com": 0.2, "https://www.naturalnews.com/": 0.2,
        "https://old.reddit.com/r": 0.2, "https://arxiv.org/abs/1": 0.2, "http://unknownblog.xyz/": 0.3, "https://en.wikipedia.org/wiki/X": 1.3, "": 1.0, "https://blog.intel.com/": 2.4, "https://a.substack.com/p": 0.6,
        "https://someone.wordpress.com/": 0.2, "https://mine.example.net/": 1.7,
    }
    urls = spark.createDataFrame([(u,) for u in want], "url string")
    scored = {r.url: round(r.t, 6) for r in urls.select("url", score.trust_score(F.col("url")).alias("t")).collect()}
    assert scored == {**want, "https://mine.example.net/": 1.0}
    more = spark.createDataFrame([("example.net", "trusted")], "domain string, tier string")
    rows = trust.with_trust(urls, "url", trust.usual_lists(spark, more))
    assert {r.url: round(r.trust, 6) for r in rows.collect()} == {**want, "https://mine.example.net/": 2.0}


def test_claims_and_searches_leave_out_unreliable_sources(spark):
    claims = spark.createDataFrame([(1, "the bridge was closed")], "claim_id int, claim string")
    pages = spark.createDataFrame([(f"https://{d}/{i}", "the bridge was closed on monday") for i, d in enumerate(("a.org", "sub.rumble.com", "mercola.com", "b.com"))], "url string, text string")
    found = flows.trusted_evidence_pages(claims, pages, trust.usual_lists(spark))
    assert {r.url for r in found.collect()} == {"https://a.org/0", "https://b.com/3"}
    assert flows.trusted_evidence_pages(claims, pages, trust.usual_lists(spark), unreliable=()).count() == 4


def test_unreliable_sources_are_dropped_by_default(spark):
    urls = [f"https://www.{d}/x" for d in UNRELIABLE_DOMAINS[:3]] + ["https://sub.rumble.com/", "https://example.org/rumble.com"]
    kept = trust.drop_blocked(spark.createDataFrame([(u,) for u in urls], "url string"), "url").collect()
    assert [r.url for r in kept] == ["https://example.org/rumble.com"]


def test_site_queries_and_early_stop(spark):
    domains = [f"{a}{b}{i}.org" for a in "ab" for b in "xy" for i in range(20)]
    got = {r.batch: r.query for r in trust.site_queries(spark.createDataFrame([(d,) for d in domains], "domain string").repartition(7), "q").collect()}
    own = sorted(domains)
    assert got == {k: "q (" + " OR ".join(f"site:{d}" for d in own[25 * k : 25 * k + 25]) + ")" for k in range(4)}
    found = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (1, "c"), (2, "d"), (2, "e"), (3, "f")], "batch int, url string")
    assert [(r.batch, r.urls) for r in trust.batches_needed(found, 3, extra=1).orderBy("batch").collect()] == [(0, 2), (1, 1), (2, 2)]


def test_region_types(spark):
    rows = spark.createDataFrame([(300, 300), (400, 100), (50, 200), (100, 100), (260, 260)], "w int, h int")
    got = [r.t for r in rows.select(media.region_type(F.col("w"), F.col("h"), F.lit(1000), F.lit(1000)).alias("t")).collect()]
    assert got == ["photo / main image", "banner / horizontal bar", "vertical image", "image block", "photo / main image"]


def test_collages_are_cut_in_the_middle_of_their_seams():
    rng = np.random.default_rng(0)
    grey = rng.integers(0, 256, (300, 400)).astype(float)
    grey[148:152] = 255  # a seam of rows at 148 .. 151
    grey[:148, 199] = 255  # a seam of one column in the upper part only
    assert regions.split_collage(grey) == [(0, 0, 199, 150), (199, 0, 201, 150), (0, 150, 400, 150)]
    narrow = grey.copy()
    narrow[60] = 0  # the part above is lower than a part may be
    assert (0, 0, 199, 60) not in regions.split_collage(narrow)
    assert regions.split_collage(np.zeros((50, 50))) == [(0, 0, 50, 50)]


def test_boxes_of_pictures_leave_out_bars_and_text():
    rng = np.random.default_rng(1)
    grey = np.full((400, 400), 10.0)
    grey[:40] = 200  # a tool bar
    grey[100:300, 100:300] = rng.integers(0, 256, (200, 200))
    ((x, y, w, h),) = regions.picture_boxes(grey, [])
    assert abs(x - 100) <= 12 and abs(y - 100) <= 12 and abs(w - 200) <= 24 and abs(h - 200) <= 24
    assert regions.picture_boxes(grey, [(90, 90, 220, 220)]) == []
    assert regions.picture_boxes(np.full((100, 100), 7.0), []) == []


def test_extraction_summary(spark):
    blocks = spark.createDataFrame([(1, 5, 5, 2, 2, "in"), (1, 90, 90, 2, 2, "out"), (2, 0, 0, 1, 1, "alone")], "image_id int, x int, y int, w int, h int, text string")
    found = spark.createDataFrame([(1, 0, 0, 20, 20), (3, 0, 0, 9, 9)], "image_id int, x int, y int, width int, height int")
    got = {r.image_id: (r.total_text_blocks, r.total_inside_text, r.total_image_regions, r.total_outside_text) for r in media.extraction_summary(blocks, found).collect()}
    assert got == {1: (2, 1, 1, 1), 2: (1, 0, 0, 1), 3: (0, 0, 1, 0)}


def test_shown_verdicts_and_cards(spark):
    rows = spark.createDataFrame([(0.4, 0.45), (0.2, 0.51)], "avg_real double, avg_fake double")
    assert [r.v for r in rows.select(verdict.shown_video_verdict(F.col("avg_fake")).alias("v")).collect()] == ["REAL", "FAKE"]
    evidence = spark.createDataFrame([(1, k) for k in range(1, 7)], "claim_id int, rank int")
    assert verdict.evidence_cards(evidence).count() == 3 and verdict.evidence_cards(evidence, most=2).count() == 2


def test_fetch_waits_heeds_robots_and_keeps_what_it_has(spark):
    waits = spark.sparkContext.accumulator(0)

    def get(url):
        if "bad" in url:
            raise OSError("down")
        return {"status": 200, "html": "<p>x</p>", "content_type": "text/html"}

    urls = spark.createDataFrame([(u,) for u in ("http://a.org/ok", "http://a.org/private/x", "http://b.org/bad")], "url string")
    rules = fetch.robots_rules(spark.createDataFrame([("a.org", "User-agent: *\nDisallow: /private")], "domain string, text string"))
    got = {r.url: (r.status, r.error) for r in fetch.parallel_fetch(urls, get, rules=rules, wait=lambda s: waits.add(int(s))).collect()}
    assert got == {"http://a.org/ok": (200, None), "http://a.org/private/x": (-1, "robots"), "http://b.org/bad": (-1, "down")}
    assert waits.value == 1 + 2
    late = {r.error for r in fetch.parallel_fetch(urls, get, deadline=0.0).collect()}
    assert late == {"deadline"}


def test_opensearch_answers(spark):
    rows = spark.createDataFrame([('["q", ["t"], ["d"], ["http://a", "http://b"]]',), ("{}",), ("[1]",)], "j string")
    assert [r.u for r in rows.select(fetch.opensearch_urls(F.col("j")).alias("u")).collect()] == [["http://a", "http://b"], [], []]


def test_seeds_come_from_the_query_and_two_expansions(spark):
    held = {"q": ["u1", "u2"], "x": ["u2", "u3"], "y": ["u4"], "z": ["u5"]}
    search = lambda q: spark.createDataFrame([(u, i) for i, u in enumerate(held[q])], "url string, pos int")
    assert [r.url for r in flows.seed_urls("q", ["x", "y", "z"], search, 10).collect()] == ["u1", "u2", "u3", "u4"]


def test_frontier_without_indexed_pages_and_full_queues(spark):
    frontier = spark.createDataFrame([("u1", "f1", "pending"), ("u2", "f2", "pending"), ("u3", "f3", "done")], "url string, fingerprint string, status string")
    got = {r.url: r.status for r in crawl.without_indexed(frontier, spark.createDataFrame([("u2",)], "url string")).collect()}
    assert got == {"u1": "pending", "u2": "done", "u3": "done"}
    items = spark.createDataFrame([(i,) for i in range(5)], "i int")
    assert sorted(r.i for r in crawl.enqueue(items.where("i < 2"), items.where("i >= 2"), 4, order=[F.desc("i")]).collect()) == [0, 1, 3, 4]
    assert crawl.enqueue(items, items, 3, order=[F.asc("i")]).count() == 5


def test_models_are_built_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def factory():
        import os
        import uuid

        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda texts: [[float(len(t))] for t in texts]

    backend = models.ModelBackend(embed=models.PerWorker(factory))
    df = spark.range(1000).repartition(8).select(F.col("id").cast("string").alias("t"))
    assert df.select(models.embed(F.col("t"), backend).alias("v")).where("v[0] > 0").count() == 1000
    pids = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(pids) == len(set(pids)) >= 1


def test_link_relevance_and_its_failure(spark):
    df = spark.createDataFrame([("red car", "a red car here"), ("red car", "nothing")], "q string, t string")
    one, two = (r.s for r in df.select(models.link_relevance(F.col("q"), F.col("t")).alias("s")).collect())
    assert one > 0.9 and two < 0.1
    broken = models.ModelBackend(link_relevance=lambda pairs: 1 / 0)
    assert {r.s for r in df.select(models.link_relevance(F.col("q"), F.col("t"), broken).alias("s")).collect()} == {0.3}


def test_search_reranks_where_it_has_the_query_text(spark):
    chunks = spark.createDataFrame([(1, "https://a.org/1", "t", "nothing of it", [1.0, 0.0], 1.0, None), (2, "https://b.org/2", "t", "the red car", [0.9, 0.1], 1.0, None)], "id int, url string, title string, text string, embedding array<double>, trust double, published double")
    plain = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    assert [r.url for r in flows.search(plain, chunks, 0.0).orderBy("rank").collect()][0] == "https://a.org/1"
    asked = spark.createDataFrame([(1, [1.0, 0.0], "red car")], "query_id int, embedding array<double>, query string")
    assert [r.url for r in flows.search(asked, chunks, 0.0).orderBy("rank").collect()][0] == "https://b.org/2"


def test_links_are_ranked_by_score(spark):
    page = '<p>one <a href="/a">plain</a></p><p>two <a href="/b">red car</a></p><p>three <a href="/c">red</a></p>'
    df = spark.createDataFrame([(1, "https://h.org/", page)], "page_id int, url string, html string")
    got = html.extract_links(df, ["red", "car"], threshold=0.0).orderBy("rank").collect()
    assert [(r.url[-1], r.pos, r["rank"]) for r in got] == [("b", 1, 1), ("c", 2, 2), ("a", 0, 3)]
    kept = html.extract_links(df, ["red", "car"], threshold=0.0, most=2).orderBy("rank").collect()
    assert [r.url[-1] for r in kept] == ["b", "a"]  # the first two, then by score


def test_queries_without_results_have_an_empty_answer(spark):
    ranked = spark.createDataFrame([("a", 1, "u1", 0.9), ("a", 2, "u2", 0.5)], "query string, rank int, url string, score double")
    got = {r.query: r.response for r in tables.search_response(ranked, asked=spark.createDataFrame([("a",), ("b",)], "query string")).collect()}
    assert got == {"a": '{"user_query":"a","evidence":[{"url":"u1","score":0.9},{"url":"u2","score":0.5}]}', "b": '{"user_query":"b","evidence":[]}'}


def test_robots_delays_and_expiry(spark):
    texts = {
        "a.com": "User-agent: *\nCrawl-delay: 3\nDisallow: /x\nCrawl-delay: 7", "b.com": "User-agent: bot\nCrawl-delay: 9\n\nUser-agent: *\nDisallow:", "c.com": "Crawl-delay: 5\nUser-agent: *\nCrawl-delay: soon", "d.com": None,
        "e.com": "USER-AGENT: *\r\ncrawl-DELAY:  12  # slow\r\n",
    }
    files = spark.createDataFrame([(d, t) for d, t in texts.items()], "domain string, text string")
    assert {r.domain: r.delay for r in fetch.crawl_delays(files).collect()} == {"a.com": 7.0, "b.com": 0.0, "c.com": 0.0, "d.com": 0.0, "e.com": 12.0}
    kept = spark.createDataFrame([("a.com", "old", 100.0), ("a.com", "new", 5000.0), ("b.com", "x", 1500.0), ("c.com", "y", None)], "domain string, text string, fetched_at double")
    live, stale = fetch.live_robots(kept, 5100.0)
    assert [(r.domain, r.text) for r in live.collect()] == [("a.com", "new")] and {r.domain for r in stale.collect()} == {"b.com", "c.com"}
