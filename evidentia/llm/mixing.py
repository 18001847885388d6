"""Mixing sources to target weights by Poisson replication.

Every document gets its own count from a Poisson distribution whose mean is the target repetition rate
of its source, by inverting the distribution function at a hash of (seed, document). Counts need no
coordination: any executor recomputes the same ones. Rates above ``MAX_MEAN`` are split into equal
independent parts and added, which keeps the inversion short and away from underflow.
Only DataFrame expressions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_io import cut_lineage

#: Largest mean that is inverted in one piece.
MAX_MEAN = 8.0
#: Terms of the distribution function kept for a mean up to MAX_MEAN; the rest is below 2**-60.
TERMS = 48
#: Most sources whose rates are broadcast (about 0.5 KB each); beyond it the join is left to Spark, which splits hot partitions.
BROADCAST_SOURCES = 20_000


def unit_hash(seed: int, *parts: Column) -> Column:
    """A double in [0, 1) from 52 bits of an MD5 of the seed and the parts; null parts read as the word null."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_terms(mean: Column) -> Column:
    """array: P(X <= 0), P(X <= 1), ... of a Poisson variable of that mean (0 <= mean <= MAX_MEAN)."""
    start = F.exp(-mean)
    step = lambda acc, k: F.struct(
        (acc["p"] * mean / k).alias("p"),
        (acc["c"] + acc["p"] * mean / k).alias("c"),
        F.concat(acc["all"], F.array(acc["c"] + acc["p"] * mean / k)).alias("all"),
    )
    zero = F.struct(start.alias("p"), start.alias("c"), F.array(start).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), zero, lambda a, k: step(a, k.cast("double")), lambda a: a["all"])


def source_rates(docs: DataFrame, *, source_col: str = "source", weights: DataFrame | None = None, alpha: float = 0.5, total: int | None = None) -> DataFrame:
    """(source, n, rate, parts, cdf) for every source of docs.

    weights: (source, weight), weights of sources that docs lacks are ignored, and sources without a
    positive weight get rate 0. Without it the weight of a source is n ** alpha. rate = total * weight /
    (n * sum of weights); total is the number of rows of docs by default. A null source is a source.
    """
    n = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        w = n.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        given = weights.groupBy(F.col("source").alias("s2")).agg(F.max(F.greatest(F.col("weight").cast("double"), F.lit(0.0))).alias("weight"))
        w = n.join(given, n["source"].eqNullSafe(given["s2"]), "left").drop("s2").fillna(0.0, ["weight"])
    all_weight = F.coalesce(w.agg(F.sum("weight")).scalar(), F.lit(0.0))
    want = F.lit(float(total)) if total is not None else w.agg(F.sum("n")).scalar().cast("double")
    rated = w.withColumn("rate", F.when(all_weight > 0, want * F.col("weight") / (F.col("n") * all_weight)).otherwise(F.lit(0.0)))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_MEAN)).cast("int")
    return rated.withColumn("parts", parts).withColumn("cdf", poisson_terms(F.col("rate") / F.col("parts"))).select("source", "n", "rate", "parts", "cdf")


def poisson_count(seed: int, key: Column, parts: Column, cdf: Column, first_hash: Column) -> Column:
    """The document's count: for each part, how many terms of its distribution function the hash reaches. first_hash: that of part 0."""
    one = lambda j: F.size(F.filter(cdf, lambda c: c <= unit_hash(seed, key, j)))
    first = F.size(F.filter(cdf, lambda c: c <= first_hash))
    more = F.aggregate(F.sequence(F.lit(1), parts - 1), F.lit(0), lambda a, j: a + one(j))
    return first + F.when(parts > 1, more).otherwise(F.lit(0))


def mix_sources(
    docs: DataFrame,
    *,
    weights: DataFrame | None = None,
    alpha: float = 0.5,
    total: int | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    shuffle: bool = True,
) -> DataFrame:
    """docs with each row repeated by its Poisson count, plus ``copy`` (0, 1, ...) and ``shuffle_key``.

    Rows come in the order of shuffle_key within partitions and over them: the key is uniform in
    [0, 2**52), so partition k of n takes the k-th n-th of its range and no sampling pass is needed.
    Rows of the same id and source get the same count; a null id counts as one id; an empty table gives
    an empty one. Columns of docs named copy or shuffle_key are replaced; any other name is fine.
    The one table that is joined has a row for each source. It is counted first and broadcast up to
    BROADCAST_SOURCES rows, so that texts move once, to their place in the order.
    """
    kept = docs.drop(*[c for c in docs.columns if c in ("copy", "shuffle_key")])
    taken = {c.lower() for c in kept.columns}
    source, parts, cdf, first, count = (next(n for n in (f"__{name}{i or ''}" for i in range(len(taken) + 1)) if n not in taken) for name in ("source", "parts", "cdf", "first", "count"))
    rates = cut_lineage(source_rates(docs, source_col=source_col, weights=weights, alpha=alpha, total=total).select(F.col("source").alias(source), F.col("parts").alias(parts), F.col("cdf").alias(cdf)))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    counted = (
        kept.join(rates, kept[source_col].eqNullSafe(F.col(source)))
        .withColumn(first, unit_hash(seed, F.col(id_col), F.lit(0)))
        .withColumn(count, poisson_count(seed, F.col(id_col), F.col(parts), F.col(cdf), F.col(first)))
        .where(F.col(count) > 0)
    )
    out = counted.select(*[F.col(f"`{c}`") for c in kept.columns], F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias("copy"))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("copy").cast("string"))), 1, 13), 16, 10).cast("long")
    out = out.withColumn("shuffle_key", key)
    if not shuffle:
        return out
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col("shuffle_key") * F.lit(float(n)) / F.lit(float(1 << 52))).cast("int")
    return out.repartitionById(n, part).sortWithinPartitions("shuffle_key", id_col, "copy")
