"""The learned operators and the pipeline against plain versions, written from their definitions."""

import hashlib
import math
import re

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import langid, mixing, qda, secrets, toxicity
from evidentia.llm.spark_io import bounded


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def statistics(text):
    """The discriminant's statistics of one text."""
    t = text or ""
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", t) if x]
    lines = [x for x in t.split("\n") if x]
    n, nw, nl = len(t), len(w), len(lines)
    short = qda.SHORT

    def share(c, of, usual):
        have, all_ = c + short * usual, of + short
        return math.log((have + 0.005 * all_) / (all_ * 1.005 - min(have, all_)))

    chars = lambda s: sum(t.count(c) for c in s)
    return [
        math.log1p(nw) * 0.5, math.log1p((n + 6 * short) / (nw + short)), share(chars(qda.SYMBOLS), n, 0.0), share(chars(qda.CAPITALS), n, 0.02), share(chars("0123456789"), n, 0.0), share(chars("!?"), n, 0.0),
        share(chars(".,;:"), n, 0.02), share(chars("\n"), n, 0.003), share(nw - len(set(w)), nw, 0.3), share(nl - len(set(lines)), nl, 0.0), share(sum(len(x) >= 15 for x in w), nw, 0.02),
        share(sum(x[-1] in ".,;:!?" for x in w), nw, 0.1), share(sum(a.lower() == b.lower() for a, b in zip(w, w[1:], strict=False)), nw, 0.0),
    ]


def test_quality_scores_match_a_plain_discriminant(spark, sf_dir, real):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    x = {k: np.array(statistics(r.text)) for k, r in real.items()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in x}
    p = len(statistics(""))
    own = {c: np.array([x[k] for k, v in y.items() if v == c]) for c in (0, 1)}
    cov = {c: np.cov(own[c].T) for c in own}
    pooled = sum((len(own[c]) - 1) * cov[c] for c in own) / (len(y) - 2)
    log = {k: [0.0, 0.0] for k in x}
    for c in (0, 1):
        weight = max(qda.POOL, p / (p + len(own[c])))
        m = (1 - weight) * cov[c] + weight * pooled
        m = (1 - qda.RIDGE) * m + qda.RIDGE * np.eye(p) * np.trace(m) / p
        for k, v in x.items():
            d = v - own[c].mean(axis=0)
            log[k][c] = -0.5 * d @ np.linalg.solve(m, d) - 0.5 * np.linalg.slogdet(m)[1]
    prior = math.log(len(own[1]) / len(own[0]))
    want = {k: 1 / (1 + math.exp(-min(30, max(-30, a[1] - a[0] + prior)))) for k, a in log.items()}
    got = {r.doc_id: r.score for r in qda.score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-6


def test_quality_of_repeated_and_extra_columns(spark):
    rows = [(1, "good text of words. " * 20, "en", "s", 1), (1, "good text of words. " * 20, "en", "s", 1), (2, "### $$$ %%%", "en", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"x": F.lit("clash"), "id": F.lit(9), "y": F.lit(1), "score": F.lit("s")})
    out = qda.score_quality(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")).collect()
    assert len(out) == 4 and len({r.score for r in out if r.doc_id == 1}) == 1


def plain_posteriors(field, emit):
    """Label probabilities of one sequence by forward and backward passes in plain loops."""
    n, k = emit.shape
    a, b = np.zeros((n, k)), np.ones((n, k))
    p = np.exp(emit - emit.max(axis=1, keepdims=True))
    a[0] = np.exp(field.start) * p[0]
    for t in range(1, n):
        a[t] = [sum(a[t - 1, i] * math.exp(field.moves[i, j]) for i in range(k)) * p[t, j] for j in range(k)]
        a[t] /= a[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = [sum(math.exp(field.moves[i, j]) * p[t + 1, j] * b[t + 1, j] for j in range(k)) for i in range(k)]
        b[t] /= b[t].sum()
    out = a * b
    return out / out.sum(axis=1, keepdims=True)


def test_language_shares_match_a_plain_field(spark, real):
    docs = spark.createDataFrame([tuple(r) for r in real.values()], DOCS)
    field = langid.fit(docs)
    known = dict(zip(field.lexicon[0].tolist(), field.lexicon[1].tolist(), strict=True))

    def hashed(raw, salt):
        """The row of a feature: its bytes hashed as a text of their own."""
        from evidentia.llm.textscan import mix, prefix_hashes, range_hashes

        c = prefix_hashes(np.frombuffer(raw, dtype=np.uint8))
        return int(mix(range_hashes(c, np.array([0]), np.array([len(raw)])) + np.uint64(salt))[0])

    def weights_of(word):
        raw = word.encode()
        names = [hashed(raw[:n], 2 * n) for n in (1, 2, 3, 4)] + [hashed(raw[max(0, len(raw) - n) :], 2 * n + 1) for n in (1, 2, 3, 4)]
        whole = hashed(raw, 99)
        names += [whole, hashed(b"", 5000 + (known[whole] + 1 if whole in known else 0))]
        names += [hashed(raw[i : i + n], 1000 + n) for n in (3, 4) for i in range(len(raw) - n + 1)]
        return sum(field.weights[h >> (64 - langid.TABLE_BITS)].astype(float) for h in names) / math.sqrt(len(names))

    pick = sorted((k for k, r in real.items() if r.text and 3 < len(r.text.split()) < 120), key=lambda k: hashlib.md5(str(k).encode()).digest())[:12]
    got = {r.doc_id: r for r in langid.identify(docs.where(F.col("doc_id").isin(pick)), field).collect()}
    for k in pick:
        words = re.findall(r"[^\x20\x09-\x0D]+", real[k].text.lower())
        post = plain_posteriors(field, np.array([weights_of(w) for w in words]))
        spoken = np.array([any("a" <= c <= "z" or ord(c) > 127 for c in w) for w in words])
        shares = post[spoken].sum(axis=0) / spoken.sum()
        assert [s.share for s in got[k].shares] == pytest.approx(shares[: len(field.labels)].tolist(), abs=1e-5)
        assert got[k].lang_pred == field.labels[int(shares[: len(field.labels)].argmax())]


def test_toxicity_scores_match_a_plain_reading(spark, sf_dir, real):
    docs = spark.createDataFrame([tuple(r) for r in real.values()], DOCS)
    grammar = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    odds = dict(zip(grammar.keys.tolist(), grammar.odds.tolist(), strict=True))
    classes = {w: c for c, words in ((toxicity.THREAT, toxicity.THREATS), (toxicity.TARGET, toxicity.TARGETS), (toxicity.NEGATION, toxicity.NEGATIONS), (toxicity.REPORT, toxicity.REPORTS)) for w in words}

    def read(word):
        """(symbol, weight) of a word: the best of itself and its beginnings, cut by bytes."""
        raw = word.encode()
        own = [odds.get(toxicity._hash_of(word), 0.0)]
        for n in toxicity.STEMS:
            if len(raw) > n:
                c = toxicity.prefix_hashes(np.frombuffer(raw, dtype=np.uint8))
                own.append(odds.get(int(toxicity.mix(toxicity.range_hashes(c, np.array([0]), np.array([n])) + np.uint64(n))[0]), 0.0))
        return (toxicity.INSULT, max(own)) if max(own) > 0 else (classes.get(word, toxicity.OTHER), 0.0)

    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, grammar).collect()}
    for k, r in real.items():
        low = (r.text or "").lower()
        damped, full, seen, n_words = [0.0] * 5, [0.0] * 5, {}, 0
        for clause in re.split(r"""[.,;:!?\n|()"]""", low):
            words = re.findall(r"[a-z'\u0080-\U0010ffff]+", clause)
            n_words += len(words)
            if len(words) > 400:
                break
            symbols, weights = zip(*map(read, words), strict=True) if words else ((), ())
            for i, kind, w in toxicity.clause_matches(list(symbols), list(weights)):
                m = seen[words[i], kind] = seen.get((words[i], kind), 0) + 1
                damped[kind] += w * math.log2((1 + m) / m)
                full[kind] += w
        else:
            dense = (full[0] + full[1] + full[4]) / max(20.0, n_words) * 100
            z = sum(c * math.log1p(x) for c, x in zip(grammar.coef, [*damped, dense], strict=True)) + grammar.bias
            assert got[k] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-6)


def plain_redaction(text):
    """The text without its secrets, by the patterns and the entropy of each window of a candidate."""
    spans = [m.span() for m in re.finditer(secrets.ASSIGN, text) if len(m[2]) >= 12]
    spans += [m.span() for p in (secrets.ACCESS, secrets.HEX) for m in re.finditer(p, text)]
    for m in re.finditer(secrets.CANDIDATE, text):
        s = m[0]
        digit = re.search("[0-9]", s)
        if digit and (not re.search(secrets.NOT_ALLOWED, s) or any(re.search(p, s) for p in secrets.ALLOW) or s.isdigit()):
            continue
        if not digit:
            turns = sum(a.islower() and b.isupper() or a.isupper() and b.islower() for a, b in zip(s, s[1:], strict=False) if a.isalpha() and b.isalpha())
            up, low = sum(c.isupper() for c in s), sum(c.islower() for c in s)
            if turns < secrets.CHANGES * len(s) or min(up, low) < secrets.CASE_SHARE * (up + low):
                continue
        kind = "word" if not digit else "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) else "alnum" if s.isalnum() else "base64"
        most = max(-sum(c / 20 * math.log2(c / 20) for c in (w.count(x) for x in set(w))) for w in (s[i : i + 20] for i in range(len(s) - 19)))
        if round(most, 9) >= secrets.ENTROPY[kind]:
            spans.append(m.span())
    out, at = [], 0
    for s, e in sorted(spans):
        if s > at or not out and s == 0:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def plain_copies(rows, seed=17):
    """(doc_id, copy) by inverting each source's Poisson distribution at the documents' hashes."""
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + 1
    weight = {s: n**0.5 for s, n in sizes.items()}
    out = []
    for r in rows:
        rate = len(rows) * weight[r["source"]] / (sizes[r["source"]] * sum(weight.values()))
        parts, count = max(1, math.ceil(rate / mixing.MAX_MEAN)), 0
        for j in range(parts):
            u = int(hashlib.md5(f"{seed}|{r['doc_id']}|{j}".encode()).hexdigest()[:13], 16) / 2**52
            term = total = math.exp(-rate / parts)
            k = 0
            while total <= u and k < mixing.TERMS:
                k += 1
                term *= rate / parts / k
                total += term
            count += k
        out += [(r["doc_id"], c) for c in range(count)]
    return out


def test_pipeline_matches_a_plain_run(spark, sf_dir, real):
    docs = spark.createDataFrame([tuple(r) for r in real.values()], DOCS)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = sorted((r.asDict() for r in langid.keep_identified(docs).collect()), key=lambda r: r["doc_id"])  # the learned stage, tested above
    rows = [rows[i] for i, (_, c) in enumerate(brute.op9([r["text"] for r in rows])) if i == c]
    rows = [r for r, x in zip(rows, brute.op10([r["text"] for r in rows], items), strict=True) if not x[-1]]
    rows = [r | {"text": plain_redaction(r["text"])} for r in rows]
    text = {r["doc_id"]: r["text"] for r in rows}
    got = [(r.doc_id, r.copy, r.text, r.n_chars) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert sorted(got) == sorted((i, c, text[i], len(text[i])) for i, c in plain_copies(rows))


def test_stages_on_odd_tables(spark, sf_dir):
    """Nulls in every column, empty tables, repeated rows and columns with the names that stages use inside."""
    rows = [(None, None, None, None, None), (1, None, "en", "s", None), (2, "", None, None, 0), (3, "one two three four five six", "en", "s", 27), (3, "one two three four five six", "en", "s", 27), (4, "word " * 30_000, "en", "s", 5), (None, "x y z", None, "s", 5)]
    names = ["__source", "__parts", "__cdf", "__first", "__count", "__lower", "__some", "n", "s", "x", "key", "node", "secrets", "hits", "start", "id", "bands", "copy"]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in names})
    plain = spark.createDataFrame(rows, DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.limit(0), sf_dir).count() == 0, name
        out = stage(spark, plain, sf_dir)
        assert name == "source_mix" or out.columns == plain.columns, name
        got = out.collect()
        wide = stage(spark, docs.drop("secrets") if name == "secret_scan" else docs, sf_dir).collect()
        assert len(wide) == len(got), name
        if name in ("decontamination", "secret_scan"):
            assert len(got) == len(rows), name
        if name == "near_duplicates":
            assert len(got) == len(rows) - 1  # one of the two equal rows goes
        if name == "language_id":
            assert all(r.text for r in got)


def test_batches_are_bounded_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        df = bounded(spark.range(60).repartition(1).select(F.repeat(F.lit("x"), 100_000).alias("t")), 1_000_000)
        sizes = [r.n for r in df.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in it), "n bigint").collect()]
        assert sum(sizes) == 60 and max(sizes) <= 11
        assert spark.conf.get(key) == "1000000" and bounded(df).sparkSession.conf.get(key) == "1000000"
    finally:
        spark.conf.set(key, before)
