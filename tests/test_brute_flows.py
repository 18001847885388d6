"""The claim check against a plain version, written from its definition."""

import math
import re
from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from evidentia.operators import models
from evidentia.plans import catalogue


def rounded(x, places):
    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


def terms(text):
    return list(dict.fromkeys(re.findall(r"\b[a-z]{3,}\b", text.lower())))


def chunks_of(text):
    """Packs of at most 120 words of sentences of more than 20 characters, one sentence over; else windows of 480 characters."""
    parts = [s.strip(" ") for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text, flags=re.ASCII)]
    parts = [s for s in parts if len(s) > 20]
    if not parts:
        windows = [text[i : i + 480].strip(" \t\n\r\x0b\x0c") for i in range(0, len(text), 480)]
        return [w for w in windows if len(w) >= 81]
    out, now = [], []
    for s in parts:
        if now and sum(len(x.split()) for x in now) + len(s.split()) > 120:
            out.append(" ".join(now).strip())
            now = now[-1:]
        now.append(s)
    out.append(" ".join(now).strip())
    return [p for p in out if len(p) >= 61]


def vector(text):
    return np.array(models.hashed_embedding([text])[0], dtype=np.float32).astype(float)


def test_claim_check_matches_a_plain_run(spark, sf_dir):
    docs = [(f"https://{r.source}.example.org/{r.doc_id}", r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    claims = {r.item_id: " ".join(re.split(r"\s+", r.text, flags=re.ASCII)).strip(" ") for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    own = {url: terms(text) for url, text in docs}
    text_of, often = dict(docs), Counter(t for ts in own.values() for t in ts)
    got = {r.claim_id: r for r in catalogue.claim_check(spark, sf_dir).collect()}
    assert got.keys() == claims.keys()
    told = Counter()
    for cid, claim in claims.items():
        weight = {t: int(rounded(math.log1p(len(docs) / often[t]) * 1e6, 0)) for t in terms(claim) if often[t]}
        hits = {u: sum(weight.get(t, 0) for t in ts) for u, ts in own.items() if any(t in weight for t in ts)}
        pages = sorted(hits, key=lambda u: (-hits[u] / math.sqrt(len(own[u])), len(own[u]), u))[:15]
        q, candidates = vector(claim), []
        for u in pages:
            if len(text_of[u].strip(" ")) < 150:
                continue
            scored = [(rounded(float(np.sum(q * vector(c))), 4), -i, c) for i, c in enumerate(chunks_of(text_of[u]))]
            candidates += [(s, u, -i, c) for s, i, c in sorted((x for x in scored if x[0] >= 0.30), reverse=True)[:2]]
        if len(candidates) > 1:
            logits = models.overlap_rerank([(claim, c[:512]) for _, _, _, c in candidates])
            candidates = [(rounded(0.6 * s + 0.4 / (1 + math.exp(-x)), 4), u, i, c) for (s, u, i, c), x in zip(candidates, logits, strict=True)]
        candidates.sort(key=lambda x: (-x[0], x[1], x[2]))
        per, chosen = defaultdict(int), []
        for c in candidates:
            domain = c[1].split("/")[2].replace("www.", "")
            per[domain] += 1
            if per[domain] <= 2:
                chosen.append((*c, domain))
        chosen = chosen[:10]
        p = models.overlap_inference([(c, claim) for _, _, _, c, _ in chosen])
        sums = [sum(x[k] * s[0] * 1.3 for x, s in zip(p, chosen, strict=True)) for k in range(3)]
        total = sum(sums)
        yes, no, _ = [x / total if total >= 1e-6 else 0.0 for x in sums]
        top = max((x[1] for x in p), default=0.0)
        if total < 1e-6:
            verdict, sure = "NOT ENOUGH INFO", 0.0
        elif top >= 0.85 and no >= 0.35:
            verdict, sure = "REFUTES", top
        elif max(yes, no) >= 0.55:
            verdict, sure = ("SUPPORTS", yes) if yes >= 0.55 else ("REFUTES", no)
        else:
            verdict, sure = "NOT ENOUGH INFO", max(yes, no)
        assert got[cid].verdict == verdict and got[cid].confidence == pytest.approx(sure, abs=1e-6), cid
        if chosen:
            labels = [("SUPPORTS", "REFUTES", "NOT ENOUGH INFO")[max(range(3), key=lambda i, x=x: (x[i], -i))] for x in p]
            assert got[cid].independent_sources == len({c[4] for c, name in zip(chosen, labels, strict=True) if name == verdict}), cid
            assert got[cid].verified is False  # no source here is a trusted one
        told[verdict] += 1
    assert sum(told.values()) == len(claims) and len({round(r.confidence, 6) for r in got.values()}) > len(claims) / 2
