"""Retrieval and ranking: nearest neighbours, re-ranking, per-source caps, near duplicates, blended order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import bounded
from ..functions.constants import NEAR_DUPLICATE
from ..functions.text import word_shingles


#: Scores that a task holds at once: a slab of the matrix of queries by vectors, so that memory follows neither.
SCORES = 1_000_000


def _merged(mat: np.ndarray, held: np.ndarray, names: np.ndarray, top_s: np.ndarray, top_v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores and names of each query, in order, of those so far (top_s, top_v) and the vectors held; ties to the smaller name."""
    few = max(1, SCORES // len(mat))
    for at in range(0, len(held), few):
        own, keep_s, keep_v = names[at : at + few], [], []
        # einsum adds in one order for every pair, so that equal vectors score equally in any batch
        for s, v, t in zip(top_s, top_v, np.einsum("qd,vd->qv", mat, held[at : at + few]), strict=True):
            better = np.arange(len(t)) if len(s) < k else np.flatnonzero(t >= s[-1])  # the k-th best stands last
            if len(better):
                s, v = np.concatenate([s, t[better]]), np.concatenate([v, own[better]])
                cut = np.partition(-s, min(k, len(s)) - 1)[: min(k, len(s))].max()
                near = np.flatnonzero(-s <= cut)
                order = sorted(near.tolist(), key=lambda i, s=s, v=v: (-s[i], v[i]))[:k]
                s, v = s[order], v[order]
            keep_s.append(s)
            keep_v.append(v)
        top_s, top_v = np.array(keep_s), np.array(keep_v, dtype=object)
    return top_s, top_v


def _first(mat: np.ndarray, held: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and places of the k best of the vectors held for each query, ties to the first."""
    few, scores, places = max(1, SCORES // len(held)), [], []
    for at in range(0, len(mat), few):
        score = np.einsum("qd,vd->qv", mat[at : at + few], held)
        places.append(np.argsort(-score, axis=1, kind="stable")[:, :k].copy())
        scores.append(np.take_along_axis(score, places[-1], axis=1))
    return np.concatenate(scores), np.concatenate(places)


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    vector_id: str = "vec_id",
    query_vec: str = "embedding",
    vector_vec: str = "embedding",
    where: Column | None = None,
    block: int = 2_000,
) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best inner products of each query, ties to the smaller id.

    where filters the vectors before the search, so that no query comes short. The queries are a stated
    set: they are broadcast in blocks of at most ``block`` vectors, and each task keeps, for each query,
    the k best of its own vectors by matrix products of at most SCORES scores. Only those are shuffled, so the join
    never holds all pairs, and the second step ranks tasks x k rows a query. Vectors of another length
    than the queries' and null vectors take no part.
    """
    spark = queries.sparkSession
    q_kind, v_kind = queries.schema[query_id].dataType.simpleString(), vectors.schema[vector_id].dataType.simpleString()
    pool = vectors if where is None else vectors.where(where)
    pool = pool.select(F.col(vector_id).alias("v"), F.col(vector_vec).cast("array<double>").alias("x")).where("x is not null")
    asked = queries.where(F.col(query_vec).isNotNull()).select(F.col(query_id).alias("q"), F.col(query_vec).cast("array<double>").alias("x"))
    out = None
    rows: list = []

    def search(part: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(([r.q for r in part], np.array([r.x for r in part], dtype=np.float64)))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, mat = sent.value
            top_s = np.full((len(ids), 0), 0.0)
            top_v = np.empty((len(ids), 0), dtype=object)
            for pdf in batches:
                pdf = pdf[pdf["x"].map(len) == mat.shape[1]]
                if len(pdf):
                    top_s, top_v = _merged(mat, np.stack(pdf["x"].to_list()), pdf["v"].to_numpy(dtype=object), top_s, top_v, k)
            if top_s.shape[1]:
                yield pd.DataFrame({query_id: np.repeat(np.array(ids, dtype=object), top_s.shape[1]), vector_id: top_v.ravel(), "score": top_s.ravel()})

        return pool.mapInPandas(best, f"`{query_id}` {q_kind}, `{vector_id}` {v_kind}, score double")

    for r in asked.toLocalIterator():
        rows.append(r)
        if len(rows) == block:
            out, rows = search(rows) if out is None else out.unionByName(search(rows)), []
    if rows or out is None:
        found = search(rows) if rows else spark.createDataFrame([], f"`{query_id}` {q_kind}, `{vector_id}` {v_kind}, score double")
        out = found if out is None else out.unionByName(found)
    return top_rows(out, k, by=[query_id], order=[F.desc("score"), F.asc(vector_id)])


def centroids(vectors: DataFrame, lists: int, *, vector_id: str = "vec_id", vector_vec: str = "embedding", sample: int = 20_000, rounds: int = 10) -> np.ndarray:
    """Centres of ``lists`` groups of unit vectors, by spherical k-means on at most ``sample`` vectors, the first in the order of a hash."""
    some = vectors.where(F.col(vector_vec).isNotNull()).select(F.xxhash64(vector_id).alias("h"), F.col(vector_vec).cast("array<double>").alias("x")).orderBy("h").limit(sample)
    x = np.array([r.x for r in some.collect()], dtype=np.float64)
    if not len(x):
        return np.zeros((1, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    centres = x[np.random.default_rng(3).permutation(len(x))[:lists]]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / (length + 1e-9), centres)
    return centres


#: Stands for the list of the vectors that have none.
UNLISTED = -1


def nearest_lists(centres: np.ndarray, n: int):
    """A column function: the lists of the n nearest centres of a vector, by inner product; null for vectors of another length."""
    width = centres.shape[1]

    @F.pandas_udf("array<int>")
    def lists(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), dtype=object, index=s.index)
        ok = s.map(lambda x: x is not None and len(x) == width and not pd.isna(x).any())
        if ok.any():
            score = np.stack(s[ok].to_list()).astype(np.float64) @ centres.T
            out[ok] = pd.Series(np.argsort(-score, axis=1, kind="stable")[:, :n].astype(np.int32).tolist(), index=s.index[ok])
        return out

    return lists


def nearest_by_lists(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    centres: np.ndarray,
    *,
    probes: int = 8,
    query_id: str = "query_id",
    vector_id: str = "vec_id",
    query_vec: str = "embedding",
    vector_vec: str = "embedding",
    vector_list: str | None = None,
    tile: int = 20_000,
    query_tile: int = 2_000,
) -> DataFrame:
    """(query_id, vec_id, score, rank) as nearest() gives it, of the ``probes`` lists whose centres are nearest to a query: approximate.

    Every vector is in the list of its nearest centre, which the column vector_list holds if it is given;
    vectors whose column is null are searched for every query. A list is dealt out in tiles of about ``tile``
    vectors by ``query_tile`` queries by hash, so that neither a large list nor a much-asked one is one
    task's, and each tile is one matrix product. Nothing passes the driver but the centres.
    """
    q_kind, v_kind = queries.schema[query_id].dataType.simpleString(), vectors.schema[vector_id].dataType.simpleString()
    rows = lambda df, name, vec, lists: df.where(F.size(vec) == centres.shape[1]).select(F.col(name).alias("id"), F.col(vec).cast("array<double>").alias("x"), F.explode(lists).alias("list"))
    v = rows(vectors, vector_id, vector_vec, nearest_lists(centres, 1)(vector_vec) if vector_list is None else F.array(F.coalesce(vector_list, F.lit(UNLISTED))))
    own = nearest_lists(centres, probes)(query_vec)
    q = rows(queries, query_id, query_vec, own if vector_list is None else F.concat(own, F.array(F.lit(UNLISTED))))
    # One row a list: into how many parts its vectors and its queries are cut.
    parts = lambda df, size, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    cuts = F.broadcast(parts(v, tile, "vs").join(parts(q, query_tile, "qs"), "list"))
    share = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v = v.join(cuts, "list").select("list", share("vs").alias("a"), every("qs").alias("b"), "id", "x")
    q = q.join(cuts, "list").select("list", every("vs").alias("a"), share("qs").alias("b"), "id", "x")

    def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({query_id: [], vector_id: [], "score": []})
        held = held.sort_values("id")
        score, place = _first(np.stack(asked["x"].to_list()), np.stack(held["x"].to_list()), k)
        return pd.DataFrame({query_id: np.repeat(asked["id"].to_numpy(), score.shape[1]), vector_id: held["id"].to_numpy()[place].ravel(), "score": score.ravel()})

    found = q.groupBy("list", "a", "b").cogroup(v.groupBy("list", "a", "b")).applyInPandas(best, f"`{query_id}` {q_kind}, `{vector_id}` {v_kind}, score double")
    return top_rows(found, k, by=[query_id], order=[F.desc("score"), F.asc(vector_id)])


def top_rows(df: DataFrame, k: int, *, by: list[str], order: list[Column], rank_col: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank. Spark limits each group before the shuffle as well (WindowGroupLimit)."""
    return df.withColumn(rank_col, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank_col) <= k)


def best_per_url(chunks: DataFrame, *, by: list[str], score_col: str = "score", tie_col: str = "chunk_index") -> DataFrame:
    """One row of each group: the best score, ties to the first. An aggregate, so it combines before the shuffle."""
    rest = [c for c in chunks.columns if c not in by]
    best = chunks.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(F.col(score_col), (-F.col(tie_col)).alias("t"))).alias("__best"))
    return best.select(*by, *[F.col("__best")[c].alias(c) for c in rest])


def cap_per_domain(ranked: DataFrame, most: int, *, by: list[str], order: list[Column]) -> DataFrame:
    """The first ``most`` rows of each group."""
    return top_rows(ranked, most, by=by, order=order, rank_col="__n").drop("__n")


def near_duplicate_filter(ranked: DataFrame, *, by: list[str], text_col: str = "text", score_col: str = "score", tie_col: str = "id", most: float = NEAR_DUPLICATE, k: int = 4) -> DataFrame:
    """Without the rows of which more than ``most`` of the word shingles were seen in better rows that stayed, by group.

    What stays depends on what stayed before, so a group is folded in order of score; it is streamed
    sorted in batches bounded by bytes, and the fold holds the shingles that stayed, never the group's rows. Groups are a query's
    candidates of one source, which earlier steps have cut to a top k.
    """
    schema = ranked.schema
    with_shingles = ranked.withColumn("__s", F.transform(word_shingles(F.coalesce(F.col(text_col), F.lit("")), k), lambda s: F.xxhash64(s)))
    ordered = with_shingles.repartition(*by).sortWithinPartitions(*by, F.desc(score_col), tie_col)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, seen = None, set()
        for pdf in batches:
            keep = []
            for key, own in zip(pdf[by].itertuples(index=False, name=None), pdf["__s"], strict=True):
                if key != group:
                    group, seen = key, None
                own = set(own.tolist())
                stay = seen is None or len(own & seen) / max(1, len(own)) <= most
                if stay:
                    seen = own if seen is None else seen | own
                keep.append(stay)
            yield pdf.loc[np.array(keep, dtype=bool)].drop(columns="__s")

    return bounded(ordered).mapInPandas(fold, schema)


def discover(sources: list[DataFrame], n: int, *, url_col: str = "url", pos_col: str = "pos") -> DataFrame:
    """URLs of several result lists in order of list and position, each once, at most n."""
    parts = [s.select(url_col, F.lit(i).alias("__list"), F.col(pos_col).alias("__pos")) for i, s in enumerate(sources)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    first = both.groupBy(url_col).agg(F.min(F.struct("__list", "__pos")).alias("__at"))
    return first.orderBy("__at").limit(n).select(url_col)


def first_non_empty(sources: list[DataFrame]) -> DataFrame:
    """The first of several tables of one schema that has rows."""
    for s in sources[:-1]:
        if not s.isEmpty():
            return s
    return sources[-1]
