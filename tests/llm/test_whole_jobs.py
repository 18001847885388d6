"""Operators of training data do the whole job: nothing is left out by a count, a character class or an id."""

import brute

from evidentia.llm import jaccard

BASE = " ".join(f"w{(i * i) % 211}" for i in range(120))
DOCS = "doc_id bigint, text string, n int"


def test_unlinked_rows_with_null_or_repeated_ids_stay(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(None, one, 1), (None, two, 2), (None, None, 3), (None, None, 4), (7, three, 5), (7, BASE, 6), (3, BASE, 7), (3, BASE, 8), (9, "", 9), (10, BASE + " more", 10)]
    assert brute.op9([BASE, BASE + " more"])[1][1] == 0
    out = jaccard.keep_one_of_each(spark.createDataFrame(rows, DOCS).repartition(3))
    got = sorted(r.n for r in out.collect())
    assert [n for n in got if n not in (7, 8)] == [1, 2, 3, 4, 5, 9] and len(got) == 7 and out.columns == ["doc_id", "text", "n"]
