"""Links with the text of the element around them, and the query over all pages against a plain version."""

import re

from pyspark.sql import functions as F

from evidentia.functions.urls import canonical_url
from evidentia.operators import html
from evidentia.plans import catalogue


def test_context_is_the_text_of_the_parent_element():
    page = html.parse(
        "<div>Far away.<p>Before <b>bold</b> <a href=' /a '>the <i>link</i> text</a> after.<script>var x = 'no';</script></p><p>Other <a href='/b'>again</a>"
        "<ul><li>one <a href=/c>c</a><li>two <a href='/d'><img src=x></a></ul>" + "w" * 300 + " <a href='/e'>end</a> " + "v" * 300 + "</div><a href=''>none</a><a name=x>none</a><a href='/f'>last"
    )
    got = {x["href"]: (x["anchor"], x["around"]) for x in page.links}
    assert got["/a"] == ("thelinktext", "Before bold the link text after.")  # pieces of an anchor are joined without a space, so it isn't found in its context
    assert got["/b"][1].startswith("Other again one c two") and got["/c"] == ("c", "one c") and got["/d"] == ("", "two")
    assert got["/e"] == ("end", "w" * 99 + " end " + "v" * 99) and got["/f"] == ("last", got["/f"][1]) and list(got) == ["/a", "/b", "/c", "/d", "/e", "/f"]
    assert html.parse(None).links == [] and html.parse("</div></p><a href='/x'>").links[0]["anchor"] == ""


def tokens(text):
    return {w for w in re.findall(r"[^\W]+", text.lower()) if re.fullmatch("[a-z]{3,}", w)}


def test_link_scores_of_all_pages_match_a_plain_version(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    rows = [(p.page_id, i, x["href"], p.url, x["anchor"][:200], x["around"]) for p in pages for i, x in enumerate(html.parse(p.html).links)]
    pairs = spark.createDataFrame(sorted({(r[2], r[3]) for r in rows}), "href string, base string")
    whole = {(r.href, r.base): r.u for r in pairs.select("href", "base", canonical_url(F.col("href"), F.col("base")).alias("u")).collect()}
    best = {}
    for page, i, href, base, anchor, around in rows:
        url = whole[href, base]
        if url is not None and (page, url) not in best:
            score = min(1.0, len({"the", "and"} & tokens(f"{anchor} {around}")) / 2 + 0.05)
            best[page, url] = (i, anchor, around[:200], score)
    want = set()
    for page in {p for p, _ in best}:
        own = sorted((x[0], u, *x[1:]) for (p, u), x in best.items() if p == page)[:200]
        ranked = sorted(own, key=lambda x: (-x[4], x[0]))
        want |= {(page, pos, url, anchor, around, round(score, 9), k) for k, (pos, url, anchor, around, score) in enumerate(ranked, 1)}
    got = catalogue.QUERIES["html_link_scores"](spark, sf_dir).collect()
    assert {(r.page_id, r.pos, r.url, r.anchor_text, r.surrounding_text, round(r.relevance_score, 9), r["rank"]) for r in got} == want
    assert len(got) == len(want) > 100 and len({w[5] for w in want}) > 1
