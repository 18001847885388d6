"""Centroid clustering by ball-tree filtering: Lloyd's rounds over metric trees, in integers and exact.

Each task plants trees over its own vectors, of at most ``TREE`` vectors each. A node stores its radius,
count and integer sum. In a round a tree is walked from its root with the centroids that may still be
nearest: by the triangle inequality a centroid is out if it is farther from the node's centre than the
nearest one by more than two radii. A node with one centroid left is assigned as a whole by its stored
sum and count; a leaf is compared vector by vector. Bounds are widened by more than their rounding, so
that ties always reach the leaves, where integers decide them.

A task sends at most one row a centroid a round; the driver holds k centroids and never a vector. Trees
are written to the checkpoint folder once and read in every round. A vector that a third of all rows
share is a ball of radius 0 wherever it stands, and no row is moved by its content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_io import bounded, cut_lineage

#: Vectors of a tree and of a leaf.
TREE, LEAF = 4096, 32
#: Largest component in magnitude: squared distances of 64 dimensions stay below 2**63.
REACH = 1 << 27

_TREES = "ids binary, nulls binary, points binary, spans binary, radius binary, sums binary"


def kept_vectors(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """(i, v): ids and integer vectors floor(scale * x) of the rows with exactly dims components, none null or non-finite.

    Rows without an id and rows that share one stay. A component beyond 2**27 in magnitude raises an
    error, since squared distances would leave the range of long.
    """
    x = F.col(vec_col).cast("array<double>")
    ok = F.coalesce((F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    whole = F.transform("x", lambda c: F.floor(c * float(scale)))
    far = F.exists("x", lambda c: F.abs(c * float(scale)) > REACH)
    kept = rows.select(F.col(id_col).cast("long").alias("i"), x.alias("x"), ok.alias("ok")).where("ok")
    return kept.select("i", F.when(far, F.raise_error(F.lit(f"a component exceeds {REACH / scale}"))).otherwise(whole).cast("array<int>").alias("v"))


def first_centroids(kept: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The k vectors of smallest sha256 of prefix and id, fewer if there are fewer; ties by the vector, rows without an id last."""
    key = F.sha2(F.concat(F.lit(prefix), F.col("i").cast("string")), 256)
    top = kept.orderBy(key.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in top], dtype=np.int64)


# --- trees of one task ---------------------------------------------------------------------------------


def plant(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, spans, radius, sums) of a ball tree: nodes in preorder, spans holds first, last + 1 and the right child (0: leaf); the left child is next."""
    order, wide = np.arange(len(points)), points.astype(np.float64)
    spans, radius, sums = [], [], []
    todo = [(0, len(points), -1)]
    while todo:
        lo, hi, above = todo.pop()
        if above >= 0:
            spans[above][2] = len(spans)
        own = order[lo:hi]
        here = wide[own]
        centre = here.mean(axis=0)
        away = ((here - centre) ** 2).sum(axis=1)
        spans.append([lo, hi, 0])
        radius.append(float(np.sqrt(away.max())))
        sums.append(points[own].sum(axis=0, dtype=np.int64))
        if hi - lo > LEAF and (here != here[0]).any():
            one = here[away.argmax()]
            other = here[((here - one) ** 2).sum(axis=1).argmax()]
            # Each to the nearer of two far points, so that groups part; in halves where that would leave hardly any on one side.
            along = here @ (other - one)
            mid = int((along < (one + other) @ (other - one) / 2).sum())
            mid = mid if min(mid, hi - lo - mid) * 16 >= hi - lo else (hi - lo) // 2
            order[lo:hi] = own[np.argpartition(along, mid)]
            todo.append((lo + mid, hi, len(spans) - 1))
            todo.append((lo, lo + mid, -1))
    return order, np.array(spans, dtype=np.int32), np.array(radius), np.array(sums)


def walk(points: np.ndarray, spans: np.ndarray, radius: np.ndarray, sums: np.ndarray, centres: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(node, first, last + 1, centroids): one centroid for a ball that is assigned as a whole, else that of each vector of a leaf."""
    wide = centres.astype(np.float64)
    todo = [(0, np.arange(len(centres)))]
    while todo:
        node, may = todo.pop()
        lo, hi, right = spans[node].tolist()
        gap = np.sqrt(((wide[may] - sums[node] / (hi - lo)) ** 2).sum(axis=1))
        near = gap.min()
        may = may[gap <= (near + 2 * radius[node]) * (1 + 1e-9) + 1e-6]
        if len(may) == 1:
            yield node, lo, hi, may
        elif right:
            todo += [(right, may), (node + 1, may)]
        else:
            far = ((points[lo:hi, None, :].astype(np.int64) - centres[may]) ** 2).sum(axis=2)
            yield node, lo, hi, may[far.argmin(axis=1)]  # may ascends: ties go to the smaller number


def _unpack(row: dict, dims: int):
    points = np.frombuffer(row["points"], dtype=np.int32).reshape(-1, dims)
    spans = np.frombuffer(row["spans"], dtype=np.int32).reshape(-1, 3)
    return points, spans, np.frombuffer(row["radius"]), np.frombuffer(row["sums"], dtype=np.int64).reshape(-1, dims)


def trees(kept: DataFrame, dims: int) -> DataFrame:
    """One row a tree, of at most TREE vectors of one task."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], pa.binary()) for c in _TREES.split(", ")])

        def tree(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks()
            ids = part["i"].combine_chunks()
            flat = part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, dims)
            order, spans, radius, sums = plant(flat)
            names = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[order]
            absent = ids.is_null().to_numpy(zero_copy_only=False)[order]
            row = [names.tobytes(), absent.tobytes(), flat[order].tobytes(), spans.tobytes(), radius.tobytes(), sums.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], schema=schema)

        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while n + batch.num_rows >= TREE:
                held.append(batch.slice(0, TREE - n))
                batch = batch.slice(TREE - n)
                yield tree(pa.Table.from_batches(held))
                held, n = [], 0
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if n:
            yield tree(pa.Table.from_batches(held))

    return bounded(kept).mapInArrow(grow, _TREES)


def assign_round(forest: DataFrame, centres: np.ndarray, dims: int) -> tuple[np.ndarray, dict[str, int]]:
    """The centroids after one round, and how many vectors went by whole balls and by leaves. Centroids without vectors stay."""
    spark = forest.sparkSession
    sent = spark.sparkContext.broadcast(centres)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sent.value
        n, s = np.zeros(len(now), dtype=np.int64), np.zeros(now.shape, dtype=np.int64)
        whole = np.zeros(len(now), dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                points, spans, radius, sums = _unpack(row, dims)
                for node, lo, hi, own in walk(points, spans, radius, sums, now):
                    if len(own) == 1:
                        n[own[0]] += hi - lo
                        s[own[0]] += sums[node]
                        whole[own[0]] += hi - lo
                    else:
                        np.add.at(n, own, 1)
                        np.add.at(s, own, points[lo:hi].astype(np.int64))
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(n[full]), pa.array(whole[full]), pa.array(s[full].tolist(), pa.list_(pa.int64()))], names=["c", "n", "w", "s"])

    parts = forest.mapInArrow(total, "c int, n bigint, w bigint, s array<bigint>")
    rows = parts.groupBy("c").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), *[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(dims)]).collect()  # k rows at most
    sent.unpersist()
    out = centres.copy()
    for r in rows:
        out[r.c] = [r[f"s{j}"] // r.n for j in range(dims)]
    whole = sum(r.w for r in rows)
    return out, {"whole": whole, "leaf": sum(r.n for r in rows) - whole}


def assigned(forest: DataFrame, centres: np.ndarray, dims: int) -> DataFrame:
    """(i, cluster, distance) of every vector: its nearest centroid and the squared distance, exact."""
    sent = forest.sparkSession.sparkContext.broadcast(centres)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                points, spans, radius, sums = _unpack(row, dims)
                own = np.empty(len(points), dtype=np.int32)
                for _, lo, hi, got in walk(points, spans, radius, sums, sent.value):
                    own[lo:hi] = got
                far = ((points.astype(np.int64) - sent.value[own]) ** 2).sum(axis=1)
                ids = pa.array(np.frombuffer(row["ids"], dtype=np.int64), mask=np.frombuffer(row["nulls"], dtype=bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(own), pa.array(far)], names=["i", "cluster", "distance"])

    return forest.mapInArrow(label, "i bigint, cluster int, distance bigint")


def cluster(rows: DataFrame, *, k: int = 40, rounds: int = 5, prefix: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """(<id>, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Vectors with nulls, non-finite or too few or many components are left out; other columns are ignored.
    Fewer than k kept vectors give as many centroids; none at all give an empty result. Equal vectors are
    in one cluster, ties go to the smaller number, repeated rows each count.
    """
    spark = rows.sparkSession
    kept = kept_vectors(rows, id_col=id_col, vec_col=vec_col, dims=dims, scale=scale)
    centres = first_centroids(kept, k, prefix)
    if not len(centres):
        return spark.createDataFrame([], f"`{id_col}` bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    forest = cut_lineage(trees(kept, dims))
    for _ in range(rounds):
        centres, _ = assign_round(forest, centres, dims)
    out = cut_lineage(assigned(forest, centres, dims))
    sums = {r.cluster: r.s for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    named = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    per = spark.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return out.join(F.broadcast(per), "cluster").select(F.col("i").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
