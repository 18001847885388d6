"""What is exploded must not carry its whole array along: that costs the square of a text's length."""

import re

import pytest

from evidentia.operators import boundaries, keyphrases


@pytest.mark.parametrize("make", [lambda d: keyphrases.word_scores(d), boundaries.neighbours, boundaries.occurrences, lambda d: boundaries.split(d, boundaries.learn(d))])
def test_no_array_beside_what_is_exploded(spark, make):
    docs = spark.createDataFrame([(1, "One word. Two words of it, e.g. these. And 3."), (2, None)], "doc_id long, text string")
    plan = make(docs)._jdf.queryExecution().sparkPlan().toString()
    found = re.findall(r"Generate \w+\([^\n]*?\), \[([^\]]*)\], (?:true|false), \[", plan)
    held = [re.sub(r"#.*", "", x.strip()) for f in found for x in f.split(",") if x.strip()]
    assert "Generate" in plan and not set(held) & {"w", "p", "s", "text"}
