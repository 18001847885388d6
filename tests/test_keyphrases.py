"""Key words against a plain version, edges, and the search query that takes them."""

import math
import re
import statistics

from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.operators import keyphrases
from evidentia.plans import catalogue

TEXT = """The reactor at Alder Lake was shut. Engineers of NASA looked at the reactor and the cooling loop!
Reactor safety is what the Alder council asked about. The council met NASA, and the council wrote a report. reports are the thing that the council keeps."""
TEXTS = [TEXT, None, "", "...", "one", "a b c 12 345", "Übung macht den Meister. die Übungen! ÜBUNG", "漢字 テキスト 漢字。", "word " * 3000, "x\ny\nWord word WORD"]


def plain(text):
    """(word: score) by the definition."""
    sentences = [w for s in re.split(r"[.!?\n]+", text or "") if (w := re.findall(r"[^\W_]+", s))]
    seen = {}
    for i, words in enumerate(sentences):
        for p, form in enumerate(words):
            x = seen.setdefault(form.lower(), {"tf": 0, "acro": 0, "cap": 0, "sent": [], "left": [], "right": []})
            x["tf"] += 1
            x["acro"] += len(form) > 1 and form.upper() == form and any(c.isalpha() for c in form)
            x["cap"] += p > 0 and form[0].isupper()
            x["sent"].append(i)
            if p > 0:
                x["left"].append(words[p - 1].lower())
            if p + 1 < len(words):
                x["right"].append(words[p + 1].lower())
    tfs = [x["tf"] for w, x in seen.items() if len(w) > 1]
    out = {}
    for w, x in seen.items():
        if len(w) > 2 and any(c.isalpha() for c in w):
            usual = statistics.fmean(tfs) + statistics.pstdev(tfs)
            sides = sum(len(set(x[s])) / len(x[s]) for s in ("left", "right") if x[s])
            context = 1 + sides * x["tf"] / max(y["tf"] for y in seen.values())
            casing = max(x["acro"], x["cap"]) / (1 + math.log(x["tf"]))
            out[w] = context * math.log(math.log(3 + statistics.median(x["sent"]))) / (casing + (x["tf"] / usual + len(set(x["sent"])) / len(sentences)) / context)
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def chosen(scores, top):
    out = []
    for w in sorted(scores, key=lambda w: (round(scores[w], 9), w)):
        if len(out) < top and not any(1 - distance(w, g) / max(len(w), len(g)) > 0.7 for g in out):
            out.append(w)
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "word") for i, t in enumerate(texts)], "doc_id int, text string, word string")


def test_scores_and_words_match_the_definition(spark, sf_dir):
    real = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    texts = TEXTS + real
    df = frame(spark, texts)
    got = {}
    for r in keyphrases.word_scores(df).collect():
        got.setdefault(r.doc_id, {})[r.word] = r.score
    for i, t in enumerate(texts):
        want = plain(t)
        assert set(got.get(i, {})) == set(want)
        assert all(math.isclose(got[i][w], s, rel_tol=1e-9) for w, s in want.items())
    words = {r.doc_id: r.words for r in keyphrases.key_words(df, 8).collect()}
    assert words == {i: chosen(plain(t), 8) for i, t in enumerate(texts)}
    assert keyphrases.key_words(df.limit(0)).count() == 0


def test_topics_come_first_and_spellings_once(spark):
    best = keyphrases.key_words(frame(spark, [TEXT]), 6).first().words
    assert {"nasa", "alder"} <= set(best) and "the" not in best
    assert len({"report", "reports"} & set(keyphrases.key_words(frame(spark, [TEXT]), 50).first().words)) == 1


def test_texts_are_exchanged_once(spark):
    plan = keyphrases.word_scores(frame(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_search_query_takes_key_words_between_tags_and_tokens(spark):
    df = spark.createDataFrame([(1, "#Solar_Farm output fell. The Minister of Energy blamed the grid")], "doc_id int, text string")
    row = df.join(keyphrases.key_words(df, 3), "doc_id").select("words", tx.search_query(F.col("text"), key_words=F.col("words")).alias("q"), tx.search_query(F.col("text")).alias("plain")).first()
    assert row.q.startswith("solar farm " + " ".join(row.words)) and "blamed" in row.q
    assert row.plain.startswith("solar farm") and not row.plain.startswith("solar farm " + " ".join(row.words))


ODD = [" ".join(f"Word{i}ab #Tag{i}" for i in range(40)), "x" * 20000 + " " + "x" * 19990 + "y" + " Short words", "ΟΔΟΣ Οδός İstanbul straße STRASSE ﬁne ⅧⅧ", "Ⓐ٣٤٥ abc٣ 12ab", "a.b!c?d\n\n.e", "\t \n"]


def test_best_words_are_the_first_of_the_scores(spark, sf_dir):
    texts = TEXTS + ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(100).collect()]
    df, scores = frame(spark, texts), {}
    for r in keyphrases.word_scores(df).collect():
        scores.setdefault(r.doc_id, {})[r.word] = r.score
    # the plain distance takes the square of a word's length, so the long words are only held against their scores
    want = {i: chosen(scores.get(i, {}), 12) for i, t in enumerate(texts) if t is None or len(t) < 20000}
    got = {r.doc_id: r.words for r in keyphrases.key_words(df, 12).collect()}
    assert set(got) == set(range(len(texts)))
    assert {i: got[i] for i in want} == want
    assert len(got[len(TEXTS) + 1]) == 3 and {"short", "words"} < set(got[len(TEXTS) + 1])


def test_search_queries_of_documents_exchange_texts_once(spark, sf_dir):
    plan = catalogue.QUERIES["search_query_key_words"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Generate" not in plan


def test_search_queries_of_documents_have_every_row(spark, sf_dir, tmp_path):
    tags = " ".join(f"a Tag{i:02}" for i in range(20))
    rows = [(1, None), (2, ""), (3, "... a b c"), (4, tags), (5, TEXT), (None, "No Key is known for this Text"), (7, "one"), (7, "two more words")]
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text")
    invalid = spark.sql("select 8L as doc_id, cast(x'616263ff20616263' as string) as text")
    spark.createDataFrame(rows, "doc_id long, text string").union(invalid).union(real).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in catalogue.QUERIES["search_query_key_words"](spark, str(tmp_path)).collect()), key=repr)
    tagged = catalogue._tagged(spark, str(tmp_path)).withColumn("words", keyphrases.best_words(F.col("text"), 15))  # of all texts, also where tags fill the query
    assert got == sorted((tuple(r) for r in tagged.select("doc_id", tx.search_query(F.col("text"), key_words=F.col("words"))).collect()), key=repr)
    by_key = {k: q for k, q in got}
    assert len(got) == len(rows) + 1 + real.count() and None in by_key
    assert by_key[1] is None and by_key[2] == "" and by_key[3] == ". a b c"
    assert by_key[4] == " ".join(f"tag{i:02}" for i in range(15)) and {q for k, q in got if k == 7} == {"one", "two words more"}
    full = [q.split(" ") for k, q in got if k and k > 100 and q]
    assert max(map(len, full)) >= 15


def test_distance_is_the_edit_distance():
    words = ["report", "reports", "reprot", "a", "ab", "ba", "abc" * 30, "abd" * 30, "é漢字", "漢é字", "kitten", "sitting"]
    assert all(keyphrases._distance(a, b) == distance(a, b) for a in words for b in words)
    assert all(keyphrases._alike(a, b) == (1 - distance(a, b) / max(len(a), len(b)) > 0.7) for a in words for b in words)
