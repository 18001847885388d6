"""Quality scores by regularised quadratic discriminant analysis.

Statistics of a document's text are transformed to tame their tails. Each class has a mean and a
covariance that is shrunk twice: towards the pooled covariance, and towards a multiple of the identity.
The Cholesky factors are computed once and kept with the model; a score is the logistic function of the
difference of the two Mahalanobis log-densities plus the log prior odds.

The class moments are sums over all labelled rows, so that fitting is one aggregation with map-side
combining; the driver holds two vectors and two small matrices whatever the number of labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_io import cut_lineage

#: Shares of the pooled covariance and of the scaled identity in a class covariance.
POOL, RIDGE = 0.3, 0.05
#: Characters, words or lines of usual text that every share starts from.
SHORT = 20.0
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#*$%&|<>=~^_\\@{}[]+"


def _without(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the transformed statistics of each text; null reads as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    base = docs.select(F.col(id_col).alias("id"), text.alias("t"), words.alias("w"), lines.alias("l"))
    n, nw, nl = F.length("t").cast("double"), F.size("w").cast("double"), F.size("l").cast("double")
    # Shares lean on a usual value as if SHORT more units had been seen, so that a short text is not extreme by chance.
    share = lambda c, of, usual: F.log((c + SHORT * usual + 0.005 * (of + SHORT)) / ((of + SHORT) * 1.005 - F.least(c + SHORT * usual, of + SHORT)))  # noqa: E731  a smoothed logit
    distinct = F.size(F.array_distinct("w")).cast("double")
    heavy = F.size(F.filter("w", lambda w: F.length(w) >= 15)).cast("double")
    letters_last = F.size(F.filter("w", lambda w: w.rlike(r"[.,;:!?]$"))).cast("double")
    doubled = F.size(F.filter(F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.lower(a) == F.lower(b)), lambda x: x)).cast("double")
    t = F.col("t")
    stats = [
        F.log1p(nw) * 0.5,
        F.log1p((n + 6 * SHORT) / (nw + SHORT)),
        share(_without(t, SYMBOLS), n, 0.0),
        share(_without(t, CAPITALS), n, 0.02),
        share(_without(t, "0123456789"), n, 0.0),
        share(_without(t, "!?"), n, 0.0),
        share(_without(t, ".,;:"), n, 0.02),
        share(_without(t, "\n"), n, 0.003),
        share(nw - distinct, nw, 0.3),
        share(nl - F.size(F.array_distinct("l")), nl, 0.0),
        share(heavy, nw, 0.02),
        share(letters_last, nw, 0.1),
        share(doubled, nw, 0.0),
    ]
    return base.select("id", F.array(*stats).alias("x"))


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors and log determinants; log prior odds; score where nothing could be learned."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    logdets: list[float]
    prior: float
    default: float = 0.5

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.default)
        logs = []
        for mean, inverse, logdet in zip(self.means, self.factors, self.logdets, strict=True):
            z = (x - mean) @ inverse.T
            logs.append(-0.5 * (z * z).sum(axis=1) - 0.5 * logdet)
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + self.prior, -30, 30)))


def fit(stats: DataFrame, marks: DataFrame, *, pool: float = POOL, ridge: float = RIDGE) -> Discriminant:
    """A discriminant from (id, x) and (id, y): y is 0 or 1. One aggregation of counts, sums and products."""
    rows = stats.join(marks.select(F.col("id").alias("__id"), "y"), F.col("id") == F.col("__id")).select("y", "x")
    first = rows.select(F.size("x")).first()
    if first is None:
        return Discriminant([], [], [], 0.0)
    p = first[0]
    at = lambda i: F.get("x", F.lit(i))
    sums = rows.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(at(i)) for i in range(p)]).alias("s"),
        F.array(*[F.sum(at(i) * at(j)) for i in range(p) for j in range(i + 1)]).alias("q"),
    )
    got = {r.y: r for r in sums.collect()}  # two rows
    total = sum(r.n for r in got.values())
    if set(got) != {0, 1} or min(r.n for r in got.values()) < 2:
        return Discriminant([], [], [], 0.0, got[1].n / total if 1 in got else 0.0)
    means, scatter = [], []
    for y in (0, 1):
        r, m = got[y], np.zeros((p, p))
        mean = np.array(r.s) / r.n
        m[np.tril_indices(p)] = r.q
        m = m + np.tril(m, -1).T
        means.append(mean)
        scatter.append(m - r.n * np.outer(mean, mean))
    pooled = (scatter[0] + scatter[1]) / max(1, total - 2)
    factors, logdets = [], []
    for y in (0, 1):
        own = scatter[y] / max(1, got[y].n - 1)
        weight = max(pool, p / (p + got[y].n))  # few labels: lean on both classes' covariance
        cov = (1 - weight) * own + weight * pooled
        cov = (1 - ridge) * cov + ridge * np.eye(p) * max(np.trace(cov) / p, 1e-6)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        logdets.append(2 * float(np.log(np.diag(lower)).sum()))
    return Discriminant(means, factors, logdets, float(np.log(got[1].n / got[0].n)))


def quality_marks(labels: DataFrame, *, id_col: str = "doc_id", mark_col: str = "quality") -> DataFrame:
    """(id, y) of labels: null ids and marks are left out, of repeated labels the largest holds."""
    return labels.where(F.col(id_col).isNotNull() & F.col(mark_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.when(F.col(mark_col) == 1, 1).otherwise(0)).alias("y"))


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark_col: str = "quality") -> DataFrame:
    """One row per row of docs: id, score (0 to 1; higher: better).

    Null texts score as empty ones, repeated rows give repeated results and each counts where its id is
    labelled, an empty table gives an empty one, and other columns are ignored. With no labels of both classes the score is the share of good
    labels, or 0.5 without any. The statistics are computed once and kept in the checkpoint folder.
    """
    stats = cut_lineage(features(docs, id_col=id_col, text_col=text_col))
    model = fit(stats, quality_marks(labels, id_col=id_col, mark_col=mark_col))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(x.to_list())) if len(x) else np.empty(0))

    return stats.select(F.col("id").alias(id_col), score("x").alias("score"))
