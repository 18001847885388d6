"""Learned sentence boundaries against a plain version, planted abbreviations, and edges."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidentia.operators import boundaries

NAMES = ["Miller", "Okoye", "Tanaka", "Silva", "Weber", "Novak", "Haddad", "Larsen", "Moreau", "Rossi"]
PLANTED = [
    f"Dr. {n} met approx. {i + 3} people near the {('river', 'mill', 'old bridge')[i % 3]}. They spoke with Prof. {NAMES[(i + 7) % 10]} about the plan, e.g. the {('roof', 'cellar')[i % 2]}. The plan was kept. It cost 1{i}.50 in all! Was J. {n} there? The people went home. Nobody had kept a home by the river, the mill, the bridge, the roof or the cellar!"
    for i, n in enumerate(NAMES * 4)
]
EDGES = [None, "", " \n\t ", "...", "no mark at all", "One. Two! Three? four", 'He said "no." Then he left. (All of it.) The end', "wait ... what. Yes", "漢字。 テキスト. 漢字", "word. " * 2000, "a. b. c.", "x.y. Z"]

SPACE = re.compile(r"[ \t\n\f\r]+")


def shape(t):
    core = re.sub(r"""["')\]}»”’,;:]+$""", "", re.sub(r"""^["'(\[{«“‘]+""", "", t))
    dot = bool(re.search(r"[^.]\.$", core))
    bare = (core[:-1] if dot else core).lower()
    return ("##" if re.search(r"^[0-9.,]*[0-9]$", bare) else bare), dot, bool(re.search(r"[!?]$", core)), core[:1].isupper()


def tokens(text):
    return [t for t in SPACE.split(text or "") if t]


def ll(k, n, p):
    return (k * math.log(p) if k and p > 0 else 0) + ((n - k) * math.log(1 - p) if n - k and p < 1 else 0)


def assoc(a, b, both, n):
    return -2 * (ll(both, a, b / n) + ll(b - both, n - a, b / n) - ll(both, a, both / a) - ll(b - both, n - a, (b - both) / (n - a) if n > a else 1))


def model(texts):
    shaped = [[shape(t) for t in tokens(x)] for x in texts]
    pairs = [(a, b) for s in shaped for a, b in zip(s, s[1:])]
    every = [a for s in shaped for a in s]
    n, counts, with_ = len(every), Counter(a[0] for a in every), Counter(a[0] for a in every if a[1])
    scores = {}
    for t, w in with_.items():
        if any(c.isalpha() for c in t):
            o, inside = counts[t] - w, t.count(".")
            size = len(t) - inside
            scores[t] = 2 * (ll(w, w + o, 0.99) - ll(w, w + o, sum(with_.values()) / n)) * math.exp(-size) * (inside + 1) * float(size) ** -o
    short = {t for t, s in scores.items() if s >= 0.3}
    plain = lambda t: t not in short and len(t) > 1 and t != "##"
    after = Counter(b[0] for a, b in pairs if a[2] or (a[1] and plain(a[0])))
    breaks = sum(after.values())
    starters = {t for t, k in after.items() if any(c.isalpha() for c in t) and k * n > counts[t] * breaks and assoc(breaks, counts[t], k, n) >= 30}
    parted = Counter((a[0], b[0]) for a, b in pairs if a[1] and not plain(a[0]))
    together = {p for p, k in parted.items() if p[1] not in starters and k * n > counts[p[0]] * counts[p[1]] and assoc(counts[p[0]], counts[p[1]], k, n) >= 7.88}
    low, high = {b[0] for _, b in pairs if not b[3]}, {b[0] for a, b in pairs if b[3] and not a[1] and not a[2]}
    return scores, short, starters, together, low, high


def sentences(text, made):
    _, short, starters, together, low, high = made
    pieces = [p for p in re.split(r"""(?:(?<=[.!?])|(?<=[.!?]["')\]}»”’])|(?<=[.!?]["')\]}»”’]{2})|(?<=[.!?]["')\]}»”’]{3}))[ \t\n\f\r]+""", (text or "").strip(" ")) if p]
    out, now = [], []
    for i, p in enumerate(pieces):
        now.append(p)
        if i + 1 == len(pieces) or not tokens(p):
            continue
        t, dot, mark, _ = shape(tokens(p)[-1]) if not p[-1].isspace() else ("", False, False, False)
        nxt, _, _, upper = shape(tokens(pieces[i + 1])[0])
        begins = upper and nxt in low and nxt not in high
        if mark or not dot:
            end = True
        elif (t, nxt) in together:
            end = False
        elif t == "##":
            end = upper or not nxt[:1].islower()
        elif len(t) == 1 and t.isalpha():
            end = begins
        elif t in short:
            end = begins or (nxt in starters and upper)
        else:
            end = True
        if end:
            out.append(" ".join(now))
            now = []
    return out + ([" ".join(now)] if now else [])


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, type string")


@pytest.mark.parametrize("planted", [True, False])
def test_matches_the_plain_version(spark, sf_dir, planted):
    real = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    texts = EDGES + (PLANTED if planted else []) + real
    df, made = frame(spark, texts), model(texts)
    learnt = boundaries.learn(df)
    assert {r.type for r in learnt.abbreviations.collect()} == made[1]
    assert {r.type for r in learnt.starters.collect()} == made[2]
    assert {(r.type, r.next) for r in learnt.collocations.collect()} == made[3]
    got = {}
    for r in boundaries.split(df, learnt).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.sentence))
    for i, t in enumerate(texts):
        assert [s for _, s in sorted(got.get(i, []))] == sentences(t, made), t


def test_planted_abbreviations_are_not_split(spark, sf_dir):
    real = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(100).collect()]
    df = frame(spark, PLANTED + real)
    learnt = boundaries.learn(df)
    assert {"dr", "prof", "approx", "e.g"} <= {r.type for r in learnt.abbreviations.collect()}
    assert not {"bridge", "river", "mill", "kept", "home"} & {r.type for r in learnt.abbreviations.collect()}
    found = boundaries.split(df, learnt)
    assert [r.sentence for r in found.where("doc_id = 4").orderBy("pos").collect()] == [
        "Dr. Weber met approx. 7 people near the mill.", "They spoke with Prof. Okoye about the plan, e.g. the roof.", "The plan was kept.", "It cost 14.50 in all!", "Was J. Weber there?", "The people went home.",
        "Nobody had kept a home by the river, the mill, the bridge, the roof or the cellar!",
    ]
    assert {r["count"] for r in found.where(F.col("doc_id") < len(PLANTED)).groupBy("doc_id").count().collect()} == {7}


def test_without_texts_every_period_ends_a_sentence(spark):
    none = boundaries.learn(frame(spark, PLANTED).limit(0))
    assert none.abbreviations.count() == 0
    got = boundaries.split(frame(spark, ["Dr. Who. Yes", None]), none)
    assert [r.sentence for r in got.orderBy("pos").collect()] == ["Dr.", "Who.", "Yes"]
    assert boundaries.split(frame(spark, []), none).count() == 0
    assert got.where(F.col("sentence").isNull()).count() == 0
