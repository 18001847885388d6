"""Vector functions over arrays of floats; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    return F.get(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / (n + 1e-9))), F.lit(0))


def cosine_score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    powers = F.transform(v, lambda x: F.exp(x - top))
    return F.get(F.transform(F.array(powers), lambda p: F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda a, y: a + y))), F.lit(0))


def argmax(v: Column) -> Column:
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def weighted_centroid(query: Column, expansions: Column, own: float = 0.8, first: int = 3) -> Column:
    """normalise(own * query + (1 - own) * mean of the first expansions); the query itself without any."""
    few = F.slice(expansions, 1, first)
    mean = F.transform(query, lambda _, i: F.aggregate(few, F.lit(0.0), lambda a, e: a + F.get(e, i)) / F.size(few))
    return F.when(F.size(few) > 0, normalise(F.zip_with(query, mean, lambda q, m: own * q + (1 - own) * m))).otherwise(query)


def fused_score(cosine: Column, model_score: Column, candidates: Column) -> Column:
    """0.6 cosine + 0.4 sigmoid(model), rounded, where there is more than one candidate; else the cosine."""
    return F.when(candidates > 1, F.round(0.6 * cosine + 0.4 * sigmoid(model_score), 4)).otherwise(cosine)
