"""Main content: every method, planted boilerplate, odd markup, and the given pages."""

import re

from pyspark.sql import functions as F

from evidentia.operators import content

SENTENCE = "The council met on Monday, and the engineers, who had waited, explained how the bridge would be closed, repaired and opened again."
BODY = "".join(f"<p>{SENTENCE} Part {i}.</p>" for i in range(4))
NAV = "<nav><ul><li><a href='/a'>Home of everything</a></li><li><a href='/b'>About all of us here</a></li></ul></nav>"
AD = "<div class='ad banner'><p>Buy the best of all pans, pots, knives, spoons and forks, today only, at half the price, in every shop of every town.</p></div>"
SIDE = "<div id='sidebar'><p>Most read: ten things, twenty places, thirty people, all that you never, ever, wanted to read about in the first place.</p></div>"
RELATED = "<div class='related-links'>" + "".join(f"<p><a href='/{i}'>A headline about something else altogether, number {i}, with many words</a></p>" for i in range(9)) + "</div>"
FOOT = "<footer><p>All rights reserved, everywhere, for ever, by the owners, their heirs, their lawyers and the cats of their lawyers.</p></footer>"


def page(*parts, title="A title"):
    return f"<html><head><title>{title}</title><script>var p='<p>';</script></head><body>{''.join(parts)}</body></html>"


PAGES = {
    1: page(NAV, AD, f"<div class='wrap'><div class='story'>{BODY}</div>{SIDE}</div>", RELATED, FOOT),
    2: page(NAV, f"<div class='sidebar'>{BODY}</div>", FOOT),  # a wrong name: only the dense method takes it
    3: page("<ul>" + "".join(f"<li><a href='/{i}'>{SENTENCE} {i}</a></li>" for i in range(4)) + "</ul>"),  # nothing but links
    4: page("<p>Too short.</p>", AD),
    5: None,
    6: "",
    7: page("<article><h1>The bridge is closed until the spring</h1>", BODY, "<h2>What follows</h2><ul><li>" + SENTENCE + "<li>" + SENTENCE + "</ul></article>", RELATED),
    8: "<p>" + SENTENCE + "<p>" + SENTENCE + "<br>" + SENTENCE + "</div></div><b>" + SENTENCE,  # unclosed, and closed twice
    9: page(f"<div><div class='text'>{BODY}</div><div class='text'>{BODY.replace('council', 'senate')}</div><div><p>tiny</p></div></div>", RELATED),  # two halves of an article
    10: page("<div>" + "".join(f"<span>word{i}</span><br>" for i in range(60)) + "</div>"),  # short lines: all of the text
    11: page("<div>" * 3000 + BODY + "</div>" * 3000),
    12: page(f"<meta property='article:published_time' content='2024-05-01'><div>{BODY}</div>", title="T&amp;C\n x"),
}


def found(spark, pages):
    df = spark.createDataFrame([(k, h, "x", 1) for k, h in pages.items()], "page_id int, html string, text string, box int")
    return {r.page_id: r for r in content.main_content(df).collect()}


def test_every_method_is_taken_and_boilerplate_left_out(spark):
    got = found(spark, PAGES)
    assert set(got) == set(PAGES)
    assert {k: r.extraction_method for k, r in got.items()} == {
        1: "scored", 2: "dense", 3: "paragraphs", 4: "none", 5: "none", 6: "none", 7: "scored", 8: "scored", 9: "scored", 10: "paragraphs", 11: "scored", 12: "scored",
    }
    assert got[1].text == "\n".join(f"{SENTENCE} Part {i}." for i in range(4)) and got[1].title == "A title"
    assert got[2].text == got[11].text == got[12].text == got[1].text
    assert got[3].text.count(SENTENCE) == 4
    assert got[4].text == got[5].text == got[6].text == "" and got[4].word_count == 0
    assert got[7].text.startswith("The bridge is closed until the spring\n") and got[7].text.count(SENTENCE) == 6 and "headline" not in got[7].text
    assert got[8].text.count(SENTENCE) == 4
    assert got[9].text.count("council") == got[9].text.count("senate") == 4 and "tiny" not in got[9].text
    assert got[10].text.count("word") == 60
    assert (got[12].published_date, got[12].title) == ("2024-05-01", "T&C x") and got[1].word_count == len(got[1].text.split())


def test_planted_boilerplate_in_given_pages(spark, sf_dir):
    """Each page of the table keeps its article's text and loses navigation, advertisements and what is planted."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    planted = pages.withColumn("html", F.regexp_replace("html", "</body>", SIDE + RELATED + FOOT + "</body>").cast("string"))
    one, two = ({r.page_id: r for r in content.main_content(p).collect()} for p in (pages, planted))
    html = {r.page_id: r.html for r in pages.collect()}
    usual = [k for k, h in html.items() if re.search(r"<article>.{800,}</article>", h, re.S)]
    assert len(one) == len(two) == len(html) and len(usual) > 30
    for k in usual:
        assert two[k].extraction_method == "scored" and two[k].text == one[k].text
        assert "A headline about" not in two[k].text and "Most read" not in two[k].text and "cats of their" not in two[k].text
        ad = re.search(r'<div class="ad">(.*?)</div>', html[k])
        words = re.sub(r"<[^>]+>", " ", re.search(r"<article>(.*)</article>", html[k], re.S)[1])
        assert len(two[k].text) > 0.7 * len(" ".join(words.split()))
        assert ad is None or len(ad[1]) < 30 or ad[1] in words or ad[1] not in two[k].text


def plain(blocks):
    """(method, text) of the blocks of a page, by the definition."""
    few = [b.linked < 0.5 * b.chars for b in blocks]
    points = [1 + len(re.findall("[,،、，]", b.text)) + min(b.chars / 100, 3.0) if not b.out and f and b.chars >= 25 else 0.0 for b, f in zip(blocks, few, strict=True)]
    boxes = {}
    for b, p in zip(blocks, points, strict=True):
        for node, end, hint, up, share in ((b.box, b.box_end, b.hint, b.up, 1.0), (b.up, b.up_end, b.up_hint, b.over, 0.5)):
            if node >= 0:
                x = boxes.setdefault(node, {"end": end, "hint": hint, "up": up, "p": 0.0, "c": 0, "l": 0})
                x["p"], x["c"], x["l"] = x["p"] + p * share, x["c"] + b.chars, x["l"] + b.linked
    score = {n: (x["p"] + 5 * x["hint"]) * (1 - x["l"] / x["c"]) for n, x in boxes.items() if x["p"] > 0}
    best = max(score, key=lambda n: (round(score[n], 9), -n), default=None)
    chosen = [n for n in score if n == best or (boxes[n]["up"] == boxes[best]["up"] and score[n] >= max(10.0, 0.2 * score[best]))]
    long = [f and b.chars >= 80 for b, f in zip(blocks, few, strict=True)]
    main = any(b.main for b in blocks)
    squeeze = lambda rows: re.sub(r"\n{3,}", "\n\n", re.sub(r"\s{3,}", "  ", "\n".join(b.text for b in rows))).strip(" ")
    scored = squeeze([b for b, f in zip(blocks, few, strict=True) if f and not b.out and any(n <= b.box <= boxes[n]["end"] for n in chosen)])
    dense = squeeze([b for i, b in enumerate(blocks) if few[i] and any(long[max(0, i - 1) : i + 2])])
    paragraphs = squeeze([b for b in blocks if b.tag in content.PARAGRAPHS and len(b.text) > 40 and (b.main or not main)])
    if len(paragraphs) < 200:
        paragraphs = squeeze(blocks)
    return next(((m, t) for m, t in (("scored", scored), ("dense", dense), ("paragraphs", paragraphs)) if len(t) >= 200), ("none", ""))


def test_matches_the_plain_version(spark, sf_dir):
    given = {r.page_id + 100: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    df = spark.createDataFrame(list((PAGES | given).items()), "page_id long, html string")
    want = {r.page_id: plain(r.blocks) for r in content.outlines(df).collect()}
    assert {r.page_id: (r.extraction_method, r.text) for r in content.main_content(df).collect()} == want


def test_no_pages(spark):
    assert found(spark, {1: "x"})[1].extraction_method == "none"
    assert content.main_content(spark.createDataFrame([], "page_id int, html string")).count() == 0
