from urllib.parse import parse_qsl, urlencode, urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.functions import trust as tr
from evidentia.functions import urls as ur
from evidentia.functions import vectors as ve


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_canonical_urls(spark):
    cases = {
        "HTTP://Example.COM:80//a//b?b=2&a=1&utm_source=x#top": "http://example.com/a/b?a=1&b=2",
        "https://example.com:8443": "https://example.com:8443/",
        "https://u:p@example.com/x;v=1?q=a+b&q=%C3%A9&e=": "https://example.com/x?e=&q=a+b&q=%C3%A9",
        "mailto:a@b.c": None, "javascript:x()": None, "ftp://a/b": None, "https://a.b/c.PDF": None, "": None, "#x": None, "http:///x": None, None: None,
    }
    assert column(spark, list(cases), ur.canonical_url) == list(cases.values())


def test_query_encoding_like_form_encoding(spark):
    urls = ["http://h/p?z=~*-._&y=%2F%3F&x=a%20b&w", "http://h/p?k=1&k=0&&K=2&ref=9"]
    want = [f"http://h/p?{urlencode(sorted((k, v) for k, v in parse_qsl(urlparse(u).query, keep_blank_values=True) if k != 'ref'))}" for u in urls]
    assert column(spark, urls, ur.canonical_url) == want


@pytest.mark.parametrize("base", ["http://h.com/a/b/c.html?x=1", "http://h.com", "http://h.com/d/"])
def test_relative_urls(spark, base):
    links = ["x", "./x", "../x", "/x", "//o.org/y", "?q=1", "../../..", "x/../y", "http://abs.org/z"]
    assert column(spark, links, lambda c: ur.resolve(c, F.lit(base))) == [urljoin(base, x) for x in links]


def test_trust(spark):
    urls = ["https://www.reuters.com/x", "bbc.com", "https://edition.cnn.com", "https://en.wikipedia.org/w", "https://unknownblog.xyz", "", "https://blog.intel.com", "https://x.gov.uk", "https://me.medium.com", "https://bad.org", "https://sub.bad.org", "https://misbar.com"]
    assert column(spark, urls, lambda c: F.round(tr.trust_score(c, blocked=["bad.org"]), 6)) == [2.0, 2.0, 2.0, 1.3, 0.3, 1.0, 2.4, 2.5, 0.6, 0.2, 0.2, 2.0]


def test_domains(spark):
    urls = ["https://www.A.com:80/x", "http://www.b.www.c.org/p", "d.net/x?y"]
    assert column(spark, urls, ur.host_domain) == ["a.com", "b.www.c.org", ""]
    assert column(spark, urls, ur.registered_domain) == ["a.com", "b.www.c.org", "d.net"]
    assert column(spark, urls[:2], ur.evidence_domain) == ["A.com:80", "b.c.org"]


def test_text_functions(spark):
    assert column(spark, ["You won't believe THIS!!", "", None, "WHAT IS IT", "plain title?"], tx.clickbait_factor) == pytest.approx([0.4, 1.0, 1.0, 0.7, 1.0])
    assert column(spark, ["a b c", "one two three four five", ""], lambda c: F.array_join(tx.word_shingles(c), "|")) == ["a|b|c", "one two three four|two three four five", ""]
    assert column(spark, ["CLEANED: yes it is\nENGLISH: ok", "none"], lambda c: tx.labelled_line(c, "CLEANED")) == ["yes it is", None]
    assert column(spark, ['x ["a", "b", "c"] y', "no"], lambda c: tx.first_json_list(c, 2)) == [["a", "b"], None]
    assert column(spark, ["  a!! b ", "***"], tx.normalise_query) == ["a b", None]


def test_vector_functions(spark):
    assert column(spark, [[1.0, 2.0, 3.0]], ve.softmax, "array<double>")[0] == pytest.approx([0.09003057, 0.24472847, 0.66524096])
    assert column(spark, [[3.0, 4.0]], ve.normalise, "array<double>")[0] == pytest.approx([0.6, 0.8])
    assert column(spark, [[1.0, 5.0, 5.0]], ve.argmax, "array<double>") == [1]


def test_sentences_keep_digits_at_their_ends(spark):
    texts = ["0 is a number. It ends in 10", "  Call 555-8630  ", "A. 1 B. Call 1221 ", "", None]
    assert column(spark, texts, lambda v: tx.sentences(F.coalesce(v, F.lit("")))) == [["0 is a number.", "It ends in 10"], ["Call 555-8630"], ["A. 1 B.", "Call 1221"], [], []]
