"""Model operators behind one registry. Defaults are deterministic stand-ins: they carry the data flow, not a model's accuracy."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import NO_INFO, REFUTES, SUPPORTS
from ..functions.urls import cache_key

DIMENSIONS = 64
NEGATIONS = frozenset("not no never false fake hoax myth debunked denied wrong untrue nicht kein pas jamais falso".split())


def hashed_embedding(texts: list[str], dimensions: int = DIMENSIONS) -> list[list[float]]:
    """Unit vectors of signed word counts in hashed slots."""
    out = []
    for t in texts:
        v = [0.0] * dimensions
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.md5(w.encode("utf-8", "surrogatepass")).digest()[:8], "little")
            v[h % dimensions] += 1.0 if h >> 63 else -1.0
        n = sum(x * x for x in v) ** 0.5
        out.append([x / (n + 1e-9) for x in v])
    return out


def overlap_rerank(pairs: list[tuple[str, str]]) -> list[float]:
    """Logits from the share of the query's words in the text."""
    out = []
    for q, t in pairs:
        a, b = set((q or "").lower().split()), set((t or "").lower().split())
        out.append(8 * len(a & b) / max(1, len(a)) - 4)
    return out


def overlap_inference(pairs: list[tuple[str, str]]) -> list[tuple[float, float, float]]:
    """(supports, refutes, no information) from word overlap and negations; premise and hypothesis."""
    out = []
    for premise, claim in pairs:
        a, b = set((premise or "").lower().split()), set((claim or "").lower().split())
        share = len(a & b) / max(1, len(b))
        against = bool(a & NEGATIONS) != bool(b & NEGATIONS)
        yes = share * (0.2 if against else 0.9)
        no = share * (0.7 if against else 0.05)
        out.append((yes, no, max(0.0, 1 - yes - no)))
    return out


#: Models of this Python worker, by the number of their factory.
_built: dict[str, Callable] = {}


class PerWorker:
    """A callable that a factory makes once in each Python worker: tasks carry the factory, never the model."""

    def __init__(self, factory: Callable[[], Callable]):
        self.factory, self.number = factory, uuid.uuid4().hex

    def __call__(self, items: list) -> list:
        if self.number not in _built:
            _built[self.number] = self.factory()
        return _built[self.number](items)


@dataclass
class ModelBackend:
    """Callables over lists. Replace any by a real model; wrap what is large or slow to load in PerWorker."""

    embed: Callable[[list[str]], list[list[float]]] = hashed_embedding
    rerank: Callable[[list[tuple[str, str]]], list[float]] = overlap_rerank
    infer: Callable[[list[tuple[str, str]]], list[tuple[float, float, float]]] = overlap_inference
    translate: Callable[[list[str]], list[str]] = field(default=lambda texts: texts)
    is_claim: Callable[[list[str]], list[bool]] = field(default=lambda texts: [True] * len(texts))
    classify_image: Callable[[list[bytes]], list[tuple[float, float]]] = field(default=lambda images: [(0.5, 0.5)] * len(images))
    entities: Callable[[list[str]], list[list[str]]] = field(default=lambda texts: [[] for _ in texts])
    segment: Callable[[list[bytes]], list[tuple[int, list[float]]]] = field(default=lambda images: [(1, [0.0])] * len(images))
    read_text: Callable[[list[bytes]], list[list[dict]]] = field(default=lambda images: [[] for _ in images])
    link_relevance: Callable[[list[tuple[str, str]]], list[float]] = overlap_rerank
    complete: Callable[[list[str]], list[str]] = field(default=lambda prompts: [""] * len(prompts))


DEFAULT = ModelBackend()


def embed(text: Column, model: ModelBackend = DEFAULT) -> Column:
    call = model.embed

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(call(s.fillna("").tolist()))

    return run(text)


def embed_cached(texts: DataFrame, cache: DataFrame, as_of: float, *, text_col: str = "text", ttl: float = 86_400, model: ModelBackend = DEFAULT) -> DataFrame:
    """texts with ``embedding``: distinct texts once, live entries of the cache (key, value, added_at) first."""
    from .store import fill_cache

    keyed = texts.withColumn("key", cache_key(F.col(text_col)))
    one = keyed.groupBy("key").agg(F.min(text_col).alias("t"))
    filled = fill_cache(keyed, cache, lambda missing: missing.join(one, "key").select("key", embed(F.col("t"), model).alias("value")), as_of=as_of, ttl=ttl)
    return keyed.join(filled.select("key", F.col("value").alias("embedding")), "key", "left").drop("key")


def rerank(query: Column, text: Column, model: ModelBackend = DEFAULT) -> Column:
    call = model.rerank

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            yield pd.Series(call(list(zip(q.fillna(""), t.fillna(""), strict=True))), dtype=float)

    return run(query, F.substring(text, 1, 512))


def infer(premise: Column, claim: Column, model: ModelBackend = DEFAULT) -> Column:
    """struct(label, score, p_supports, p_refutes, p_no_info)."""
    call, names = model.infer, (SUPPORTS, REFUTES, NO_INFO)

    @F.pandas_udf("label string, score double, p_supports double, p_refutes double, p_no_info double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for p, c in batches:
            rows = call(list(zip(p.fillna(""), c.fillna(""), strict=True)))
            yield pd.DataFrame([(names[max(range(3), key=lambda i: (r[i], -i))], max(r), *r) for r in rows], columns=["label", "score", "p_supports", "p_refutes", "p_no_info"])

    return run(premise, claim)


def translate(text: Column, only: Column, model: ModelBackend = DEFAULT, most: int = 6_000) -> Column:
    """Translations of the rows where ``only`` holds, of at most ``most`` characters; the text itself elsewhere."""
    call = model.translate

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(call(s.fillna("").tolist()))

    return F.when(only, run(F.when(only, F.substring(text, 1, most)))).otherwise(text)


def is_factual(text: Column, model: ModelBackend = DEFAULT) -> Column:
    call = model.is_claim

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(call(s.fillna("").tolist()))

    return run(text)


def classify_image(content: Column, model: ModelBackend = DEFAULT) -> Column:
    """struct(p_real, p_fake)."""
    call = model.classify_image

    @F.pandas_udf("p_real double, p_fake double")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(call(s.tolist()), columns=["p_real", "p_fake"])

    return run(content)


def segment(content: Column, model: ModelBackend = DEFAULT) -> Column:
    """struct(width, cells): the forgery mask of a picture, row by row."""
    call = model.segment

    @F.pandas_udf("width int, cells array<double>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(call(s.tolist()), columns=["width", "cells"])

    return run(content)


def read_text(content: Column, model: ModelBackend = DEFAULT, least: float = 0.3) -> Column:
    """array of struct(text, confidence, x, y, w, h): the text blocks of a picture above the confidence."""
    call = model.read_text

    @F.pandas_udf("array<struct<text: string, confidence: double, x: int, y: int, w: int, h: int>>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(call(s.tolist()))

    return F.filter(run(content), lambda b: b["confidence"] > least)


def entities(text: Column, model: ModelBackend = DEFAULT) -> Column:
    """Named entities in lower case, each once, without single characters and mere numbers."""
    call = model.entities

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(call(s.fillna("").tolist()))

    found = F.transform(run(text), lambda e: F.trim(F.lower(e)))
    return F.array_distinct(F.filter(found, lambda e: (F.length(e) > 1) & ~F.replace(e, F.lit(" "), F.lit("")).rlike(r"^\d+$")))


def complete(prompt: Column, model: ModelBackend = DEFAULT) -> Column:
    """What a language model answers to a prompt."""
    call = model.complete

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(call(s.fillna("").tolist()))

    return run(prompt)


def link_relevance(query: Column, context: Column, model: ModelBackend = DEFAULT, failed: float = 0.3) -> Column:
    """Probability that a link is relevant to the query: the logistic function of the model's logit, ``failed`` where the model fails."""
    call = model.link_relevance

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            try:
                logits = pd.Series(call(list(zip(q.fillna(""), t.fillna(""), strict=True))), dtype=float)
                yield 1 / (1 + (-logits.clip(-30, 30)).map(math.exp))
            except Exception:  # a model that fails leaves its links in the middle, not the crawl without them
                yield pd.Series([failed] * len(q), dtype=float)

    return run(query, context)
