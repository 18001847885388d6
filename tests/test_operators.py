import json
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions.constants import NO_INFO, REFUTES, SUPPORTS
from evidentia.operators import chunking, crawl, evaluation, html, media, models, ranking, store, verdict
from evidentia.plans import catalogue
from evidentia.sources import fetch, settings, tables
from evidentia.streaming import incremental


def evidence(spark, rows):
    return spark.createDataFrame(rows, "claim_id int, url string, retrieval_score double, credibility double, p_supports double, p_refutes double, p_no_info double, label string")


def test_verdict_golden(spark):
    rows = evidence(spark, [(1, "https://a.org/x", 0.3765, 1.3, 0.8905, 0.0834, 0.0261, SUPPORTS), (1, "https://a.org/y", 0.3409, 1.3, 0.86, 0.1053, 0.0347, SUPPORTS)])
    verdicts = verdict.claim_verdicts(rows)
    got = verdicts.first()
    assert (got.verdict, round(got.confidence, 3)) == (SUPPORTS, 0.876)
    checked = verdict.verify_sources(rows, verdicts).first()
    assert (checked.verified, checked.independent_sources, checked.trusted_agree) == (False, 1, [])


def test_verdict_ladder(spark):
    rows = [(1, 0.5, 1.0, 0.3, 0.86, 0.1), (2, 0.5, 1.0, 0.2, 0.7, 0.1), (3, 0.5, 1.0, 0.4, 0.3, 0.3), (4, 0.0, 1.0, 0.9, 0.0, 0.1), (5, 1.0, None, None, None, None)]
    got = {r.claim_id: (r.verdict, round(r.confidence, 4)) for r in verdict.claim_verdicts(evidence(spark, [(i, "https://a/b", w, c, s, r, n, None) for i, w, c, s, r, n in rows])).collect()}
    assert got == {1: (REFUTES, 0.86), 2: (REFUTES, 0.7), 3: (NO_INFO, 0.4), 4: (NO_INFO, 0.0), 5: (NO_INFO, 0.0)}


def test_verification_statements(spark):
    rows = evidence(spark, [(1, f"https://www.s{i}.org/x", 1.0, 2.0 if i < 2 else 1.0, 0.9, 0.05, 0.05, SUPPORTS) for i in range(4)] + [(2, "https://t.org/x", 1.0, 1.0, 0.9, 0.0, 0.1, SUPPORTS), (3, "https://u.org/x", 1.0, 2.0, 0.9, 0.0, 0.1, SUPPORTS), (3, "https://v.org/x", 0.1, 2.0, 0.1, 0.8, 0.1, REFUTES)])
    got = {r.claim_id: r for r in verdict.verify_sources(rows, verdict.claim_verdicts(rows)).collect()}
    assert got[1].verified and got[1].statement == "SUPPORTS — 4 independent sources agree (2 trusted)." and got[1].trusted_agree == ["s0.org", "s1.org"]
    assert got[2].statement.startswith("Leans SUPPORTS, but only low-authority")
    assert got[3].statement == "Conflicting evidence: SUPPORTS disputed by 1 trusted source(s)."


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).round(1)
    x[50] = x[51] = x[52]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, embedding array<double>").repartition(5)
    asked = df.where("vec_id < 30").withColumnRenamed("vec_id", "query_id")
    for block in (7, 1000):
        got = {(r.query_id, r["rank"]): r.vec_id for r in ranking.nearest(asked, df, 5, block=block).collect()}
        for q in range(30):
            score = np.einsum("d,vd->v", x[q], x)
            assert [got[q, k + 1] for k in range(5)] == sorted(range(300), key=lambda i: (-score[i], i))[:5]
    assert ranking.nearest(asked.limit(0), df, 5).count() == 0 and ranking.nearest(asked, df.limit(0), 5).count() == 0


def test_lists_find_nine_tenths_of_the_nearest(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 16))
    x = centre[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "vec_id int, embedding array<double>").repartition(5)
    asked = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    centres = ranking.centroids(df, 32)
    exact = {(r.query_id, r.vec_id) for r in ranking.nearest(asked, df, 10).collect()}
    for tile in (20_000, 50):  # tiles change the work, not the result
        got = {(r.query_id, r.vec_id) for r in ranking.nearest_by_lists(asked, df, 10, centres, tile=tile, query_tile=tile).collect()}
        assert len(got) == len(exact) and len(got & exact) >= 0.9 * len(exact)
    full = {(r.query_id, r.vec_id) for r in ranking.nearest_by_lists(asked, df, 10, centres, probes=32).collect()}
    assert full == exact
    assert ranking.nearest_by_lists(asked, df.limit(0), 5, centres).count() == 0


def test_scores_are_held_in_slabs():
    rng = np.random.default_rng(1)
    asked, held = rng.integers(-3, 4, (2000, 8)).astype(float), rng.integers(-3, 4, (10000, 8)).astype(float)
    names = rng.permutation(10000).astype(object)
    tracemalloc.start()
    got_s, got_v = ranking._merged(asked, held, names, np.zeros((2000, 0)), np.empty((2000, 0), dtype=object), 30)
    score, place = ranking._first(asked, held, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80_000_000  # all scores at once take 160 MB, and more with their order
    for q in range(0, 2000, 97):
        whole = held @ asked[q]
        order = np.lexsort((names.astype(int), -whole))[:30]
        assert got_s[q].tolist() == whole[order].tolist() and got_v[q].tolist() == names[order].tolist()
        assert place[q].tolist() == np.argsort(-whole, kind="stable")[:10].tolist() and score[q].tolist() == whole[place[q]].tolist()


def test_near_duplicate_batches_are_bounded_by_bytes(spark):
    rows = spark.range(40).select(F.lit(1).alias("q"), "id", (1.0 / (F.col("id") + 1)).alias("score"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(9000)), lambda x: F.concat(F.col("id").cast("string"), F.lit("w"), x.cast("string")))).alias("text"))
    assert ranking.near_duplicate_filter(rows, by=["q"]).count() == 40
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8_000_000


def test_near_duplicates_in_order_of_score(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join(words[:39]), " ".join(words[20:] + [f"v{i}" for i in range(20)]), "", ""]
    df = spark.createDataFrame([(i, "d", t, 1.0 - i / 10) for i, t in enumerate(texts)] + [(9, "e", texts[0], 0.1)], "id int, domain string, text string, score double")
    assert sorted(r.id for r in ranking.near_duplicate_filter(df, by=["domain"]).collect()) == [0, 2, 3, 4, 9]


def test_sentence_packs():
    parts = [f"s{i} " + "w " * 9 for i in range(6)]
    packs = chunking.pack_sentences([p.strip() for p in parts], 25, 1)
    assert [p.split()[0] for p in packs] == ["s0", "s1", "s2", "s3", "s4"] and all(len(p.split()) == 20 for p in packs)


def test_chunk_dispatch(spark):
    df = spark.createDataFrame([(1, "short"), (2, "A long sentence here that goes on. " * 30)], "id int, text string")
    for strategy, more in (("fixed", {}), ("sentence", {})):
        assert {r.id for r in chunking.chunk(df, strategy, keep=["id"], **more).collect()} == {2}
    with pytest.raises(ValueError):
        chunking.chunk(df, "other", keep=["id"])


def test_metrics(spark):
    results = spark.createDataFrame([("q", f"d{i}", i) for i in range(1, 7)] + [("r", "x", 1)], "query_id string, item_id string, rank int")
    good = spark.createDataFrame([("q", "d2"), ("q", "d4"), ("q", "zz"), ("q", "d2")], "query_id string, item_id string")
    got = {r.query_id: r for r in evaluation.query_metrics(results, good, 3).collect()}
    q = got["q"]
    assert (q.precision_at_k, q.recall_at_k, q.reciprocal_rank) == pytest.approx((1 / 3, 1 / 3, 0.5))
    assert q.average_precision == pytest.approx((1 / 2 + 2 / 4) / 3)
    assert q.ndcg_at_k == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3) + 0.5))
    assert got["r"].average_precision == 0.0
    assert evaluation.mean_metrics(evaluation.query_metrics(results.limit(0), good)).first().map == 0.0


PAGE = """<html><head><title>A  title</title><meta property="article:published_time" content="2024-01-02"><script>var x = "<p>no</p>";</script></head><body><nav><a href="/nav">menu</a></nav>
<article><h1>Heading of the page that is long enough to count</h1><p>Some words of content before <a href="../next?utm_source=a&b=1">the next page</a> and after it, long enough.<br>More.</p><p>short</p></article>
<a href="mailto:x@y.z">mail</a><a href="../next?b=1#frag">again</a></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "http://h.com/a/b", PAGE), (2, "http://h.com/c", None), (3, "http://h.com/d", "<p>un<b>closed")], "page_id int, url string, html string")
    got = {r.page_id: r for r in html.extract_content(pages, keep=["page_id"], least=20).collect()}
    assert got[1].title == "A title" and got[1].published_date == "2024-01-02" and "menu" not in got[1].text and "short" not in got[1].text and "next page" in got[1].text
    assert got[2].text == "" and got[2].is_empty and got[3].text == "unclosed"
    links = html.extract_links(pages, ["next", "page"], threshold=0.0).orderBy("pos").collect()
    assert [(r.url, r.anchor_text) for r in links] == [("http://h.com/nav", "menu"), ("http://h.com/next?b=1", "the next page")]
    assert links[1].relevance_score == 1.0 and "content before the next page and after" in links[1].surrounding_text


def test_references_without_a_semicolon_are_text(spark):
    page = html.parse("<title>A &amp; B &lt;C&gt; &am</title><p>Fish &amp; chips &amp</p><p>&copy 1 &copy; 2 &ampx; &#38; &#x26; &#38 & &</p><a href='/a?x=1&copy=2&amp;y=3'>a</a>")
    assert page.title == "A & B <C> &am" and page.blocks[1:3] == ["Fish & chips &amp", ""] and page.blocks[3] == "&copy 1 © 2 &ampx; & & &#38 & &"
    assert page.links[0]["href"] == "/a?x=1&copy=2&y=3"


def test_cut_references_and_digits_as_the_sql_has_them(spark, tmp_path):
    """Pages whose texts end within a reference, and whose first sentence ends in its own number."""
    long = "A sentence of some words that is long enough to count, and then some more of them, said the man. "
    rows = [(1, "http://a.org/1", f"<title>Tit &amp</title><p>{long * 2}and &amp</p>"), (2, "http://a.org/2", f"<title>T</title><p>0 {long * 2}Call 5550</p>"), (3, "http://a.org/3", f"<p>{long.strip()[:-1] * 2} 5550</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("html_content", "index_flow"):
        got = catalogue.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(got.columns)} from ({catalogue.ORACLES[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 3


def test_frontier(spark):
    frontier = spark.createDataFrame([("f1", "http://a.com/1", 0.9, 0, None, 1.0, 0.9, "pending"), ("f2", "http://a.com/2", 0.8, 0, None, 2.0, 0.8, "pending"), ("f3", "http://b.com/1", 0.7, 0, None, 3.0, 0.7, "pending"), ("f4", "http://c.com/1", 1.0, 0, None, 3.0, 0.7, "done")], "fingerprint string, url string, priority double, depth int, parent_url string, discovered_at double, relevance_score double, status string")
    clock = spark.createDataFrame([("b.com", 100.0)], "domain string, next_allowed_at double")
    assert [r.fingerprint for r in crawl.pop_polite(frontier, clock, 50.0, take=None).collect()] == ["f1"]
    assert [r.fingerprint for r in crawl.pop_polite(frontier, clock, 100.0, take=None).collect()] == ["f1", "f3"]
    links = spark.createDataFrame([("f1", 1.0), ("f8", 0.5), ("f8", 0.6), ("f9", 0.7), ("s", 0.9)], "fingerprint string, priority double").selectExpr("fingerprint", "'u' url", "priority", "1 depth", "'p' parent_url", "0D discovered_at", "priority relevance_score", "'pending' status")
    seen = spark.createDataFrame([("s",)], "fingerprint string")
    assert [(r.fingerprint, r.priority) for r in crawl.push(frontier, links, seen).collect()] == [("f9", 0.7), ("f8", 0.6)]
    assert [r.fingerprint for r in crawl.push(frontier, links, seen, capacity=4).collect()] == ["f9"]
    assert crawl.frontier_size(crawl.with_status(frontier, frontier.limit(1), "processing")).first().pending == 2
    assert {(r.domain, r.next_allowed_at) for r in crawl.update_clock(clock, spark.createDataFrame([("a.com", 0.0), ("b.com", 5.0)], "domain string, delay double"), 10.0).collect()} == {("a.com", 11.0), ("b.com", 100.0)}


def test_store(spark, tmp_path):
    cache = spark.createDataFrame([("a", "1", 10.0), ("b", "2", 90.0)], "key string, value string, added_at double")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    filled = store.fill_cache(keys, cache, lambda k: k.withColumn("value", F.upper("key")), as_of=100.0, ttl=50.0)
    assert {(r.key, r.value) for r in filled.collect()} == {("a", "A"), ("b", "2"), ("c", "C")}
    assert [r.key for r in store.evict_oldest(cache, limit=1, batch=1).collect()] == ["b"]
    vectors = tables.VectorTable(spark, str(tmp_path / "v"))
    rows = spark.createDataFrame([("x", "t", [1.0, 0.0], {"k": "1"}), ("y", "u", [0.0, 1.0], {"k": "2"})], "id string, text string, embedding array<float>, metadata map<string, string>")
    vectors.add(rows)
    vectors.add(rows.where("id = 'x'").withColumn("text", F.lit("new")))
    assert vectors.count() == 2 and {r.text for r in vectors.read().collect()} == {"new", "u"}
    asked = spark.createDataFrame([(1, [1.0, 0.1])], "query_id int, embedding array<double>")
    assert [r.id for r in vectors.search(asked, 1).collect()] == ["x"] and [r.id for r in vectors.search(asked, 1, where={"k": "2"}).collect()] == ["y"]
    vectors.delete(rows)
    assert vectors.count() == 0


def test_media(spark):
    data = spark.createDataFrame([("data:image/jpeg;base64,aGk=",), ("data:;base64,aGk=",)], "d string").select(media.decode_data_url(F.col("d")).alias("x")).collect()
    assert [(bytes(r.x.content), r.x.extension) for r in data] == [(b"hi", ".jpg"), (b"hi", ".png")]
    cells = np.zeros((20, 20))
    cells[1:4, 1:4], cells[4, 4], cells[10:12, 10:12] = 0.9, 0.9, 0.8
    masks = spark.createDataFrame([(1, 20, cells.ravel().tolist()), (2, 20, [0.0] * 400)], "image_id int, width int, cells array<double>")
    got = media.mask_regions(masks, least=5).collect()
    assert [(r.x, r.y, r.width, r.height, r.area) for r in got] == [(1, 1, 4, 4, 10)]
    assert [(r.coverage_pct, r.forged) for r in media.mask_summary(masks).orderBy("image_id").collect()] == [(3.5, True), (0.0, False)]
    regions = spark.createDataFrame([(1, 0, 0, 50, 50, 10000), (1, 5, 5, 49, 49, 10000), (1, 0, 0, 1, 1, 10000), (1, 60, 0, 40, 30, 10000)], "image_id int, x int, y int, width int, height int, image_area int")
    assert [(r.width, r.height) for r in media.keep_regions(regions).collect()] == [(50, 50), (40, 30)]


def test_models_are_deterministic_and_cached(spark):
    df = spark.createDataFrame([("a b",), ("a b",), ("c",), (None,)], "text string")
    v = [r.v for r in df.select(models.embed(F.col("text")).alias("v")).collect()]
    assert v[0] == v[1] != v[2] and sum(x * x for x in v[0]) == pytest.approx(1, rel=1e-5)
    cache = spark.createDataFrame([], "key string, value array<float>, added_at double")
    assert models.embed_cached(df.dropna(), cache, 0.0).where("embedding is not null").count() == 3
    p = df.select(models.infer(F.lit("the cat sat"), F.lit("the cat sat")).alias("p")).first().p
    assert p.label == SUPPORTS and p.p_supports == pytest.approx(0.9)


def test_fetch(spark):
    urls = spark.createDataFrame([("http://a",), ("http://bad",)], "url string")

    def get(url):
        if "bad" in url:
            raise OSError("no route")
        return {"status": 200, "html": "<p>x", "content_type": "text/html; charset=utf-8"}

    got = {r.url: (r.status, r.html, r.error) for r in fetch.guarded(fetch.parallel_fetch(urls, get)).where(F.lit(True)).collect()}
    assert got["http://a"] == (200, "<p>x", None) and got["http://bad"][0] == -1
    rules = fetch.robots_rules(spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /x\nAllow: /x/ok\nUser-agent: other\nDisallow: /")], "domain string, text string"))
    links = spark.createDataFrame([("http://a.com/x/1", "a.com"), ("http://a.com/x/ok/2", "a.com"), ("http://a.com/", "a.com"), ("http://b.com/x", "b.com")], "url string, domain string")
    assert {r.url for r in fetch.allowed_by_robots(links, rules).collect()} == {"http://a.com/x/ok/2", "http://a.com/", "http://b.com/x"}


def test_settings():
    got = settings.load({"search": {"min_score": 0.2}}, {"CRAWLER__MAX_DEPTH": "5", "SEARCH__TOP_K_OUTPUT": "3", "OTHER": "x"})
    assert got["crawler"]["max_depth"] == 5 and got["search"] == settings.DEFAULTS["search"] | {"min_score": 0.2, "top_k_output": 3}


def test_envelope_and_response(spark):
    rows = evidence(spark, [(1, "https://a.org/x", 0.3, 1.3, 0.9, 0.05, 0.05, SUPPORTS), (1, "https://b.org/x", 0.9, 1.3, 0.9, 0.05, 0.05, SUPPORTS)]).withColumn("text", F.lit("t" * 500))
    verdicts = verdict.claim_verdicts(rows)
    body = json.loads(verdict.result_envelope(verdicts, verdict.verify_sources(rows, verdicts), rows).first().result)
    assert [e["url"] for e in body["evidence"]] == ["https://b.org/x", "https://a.org/x"] and len(body["evidence"][0]["snippet"]) == 400 and body["final_prediction"] == SUPPORTS
    ranked = spark.createDataFrame([("q", 2, "u2", 0.1), ("q", 1, "u1", 0.2)], "query string, rank int, url string, score double")
    assert json.loads(tables.search_response(ranked).first().response) == {"user_query": "q", "evidence": [{"url": "u1", "score": 0.2}, {"url": "u2", "score": 0.1}]}


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    pages = spark.createDataFrame([("http://a/1", "x"), ("http://a/1", "x"), ("http://a/2", "y")], "url string, text string")
    pages.coalesce(1).write.parquet(folder)
    seen = []
    run = incremental.index_batches(incremental.new_contents(spark.readStream.schema(pages.schema).parquet(folder)), lambda b: b.select("url"), lambda b: seen.extend(r.url for r in b.collect()), checkpoint=str(tmp_path / "c"))
    run.awaitTermination()
    assert sorted(seen) == ["http://a/1", "http://a/2"]
    events = str(tmp_path / "ev")
    spark.createDataFrame([("a.com", 1.0), ("a.com", 1.2), ("a.com", 5.0), ("b.com", 1.1)], "domain string, ts double").coalesce(1).write.parquet(events)
    before = spark.conf.get(incremental.STATE_STORE[0])
    spark.conf.set(*incremental.STATE_STORE)
    out = incremental.rate_limited(spark.readStream.schema("domain string, ts double").parquet(events))
    run = out.writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    spark.conf.set(incremental.STATE_STORE[0], before)
    assert sorted((r.domain, r.ts, r.allowed_at) for r in spark.table("limited").collect()) == [("a.com", 1.0, 1.0), ("a.com", 1.2, 2.0), ("a.com", 5.0, 5.0), ("b.com", 1.1, 1.1)]
