"""Interaction audit of filters: what each filter removes in every order of application.

The orders of n filters form a trie. Two prefixes of the same filters leave the same survivors, so a node
of the trie is an unordered set: it is visited once, depth first, and memoised. A node's survivors are a
persisted DataFrame, made from the persisted survivors of the node above by one more filter; one
aggregation over them counts what every edge that leaves the node removes, a part at a time. At most n
DataFrames are persisted at once, the counts are written to the checkpoint folder, and every figure of
every order follows from the counts of the edges.

Rows are narrow (a part, a flag a filter, the marks), so an edge costs no look at the texts. Counts
combine before the shuffle: a part that holds most rows sends one row a task. Lost executors cost the
recomputation of their blocks from the node above, up to the checkpoint of the flags.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark_io import cut_lineage, stage_folder

#: Permutations grow as n!, and with them the result.
MOST = 7
LETTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"


def text_flags(text: Column) -> dict[str, Column]:
    """What each filter on one text finds wrong; null reads as empty. Empty texts fail A alone."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    capitals = F.regexp_count(t, F.lit("[A-Z]")).cast("long")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * capitals > 2 * F.length(t).cast("long"),
        "D": t.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, A..E, good, toxic): for each document, the filters that it fails and its labels.

    E holds if the same text stands under a smaller id anywhere in the table: texts are told by SHA-256.
    Rows that share an id are no copies of each other by E; a row without an id never fails E and makes no
    other row fail. A null part is the empty one, a document with several labels has a mark if one of them
    gives it. The texts are read once; what is shuffled is digests, ids and flags.
    """
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(t, 256)).alias("digest"), *[c.alias(k) for k, c in text_flags(t).items()])
    base = cut_lineage(base)
    first = base.groupBy("digest").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    mark = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("i")).agg(mark("quality").alias("good"), mark("toxic").alias("toxic"))
    rows = base.join(first, "digest", "left").withColumn("E", F.coalesce(F.col("i") > F.col("first"), F.lit(False)))
    rows = rows.join(marks, "i", "left")
    return rows.select("part", *LETTERS, *[F.coalesce(m, F.lit(False)).alias(m) for m in ("good", "toxic")])


def edges(rows: DataFrame, filters: list[str], *, part: str = "part", marks: list[str]) -> DataFrame:
    """(part, state, filter, held, removed, <mark>_lost): what each filter removes from the survivors of each set of others.

    rows has one boolean column a filter (true: fails it) and one a mark, none of them null. state is the
    set as bits by position in filters. Parts without survivors in a state have no row for it. An empty
    table has no edges.
    """
    if len(filters) > MOST:
        raise ValueError(f"{len(filters)} filters have too many orders; {MOST} at most")
    spark, folder = rows.sparkSession, stage_folder(rows.sparkSession)
    everything, seen = (1 << len(filters)) - 1, set()

    counted = [F.count(F.lit(1)).alias("held")]
    for i, f in enumerate(filters):
        counted.append(F.count_if(F.col(f)).alias(f"r{i}"))
        counted += [F.count_if(F.col(f) & F.col(m)).alias(f"r{i}_{j}") for j, m in enumerate(marks)]
    out = [F.struct(F.lit(i).alias("filter"), F.col(f"r{i}").alias("removed"), *[F.col(f"r{i}_{j}").alias(f"{m}_lost") for j, m in enumerate(marks)]) for i in range(len(filters))]

    def visit(state: int, survivors: DataFrame) -> None:
        seen.add(state)
        held = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        # The same expressions in every state, so that they are compiled once; filters of the state itself remove nothing and are no edges.
        held.groupBy(F.col(part).alias("part")).agg(*counted).select("part", "held", F.inline(F.array(*out))).write.parquet(f"{folder}/state={state}")
        for i in range(len(filters)):
            below = state | 1 << i
            if below not in seen and below != everything:
                visit(below, held.where(~F.col(filters[i])))
        held.unpersist()

    visit(0, rows)
    lost = "".join(f", {m}_lost bigint" for m in marks)
    return spark.read.schema(f"part string, held bigint, filter int, removed bigint{lost}, state int").parquet(folder)


def report(found: DataFrame, filters: list[str], *, marks: list[str]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <mark>_lost, shapley) for each part, order and step, zeros included."""
    n, everything = len(filters), (1 << len(filters)) - 1
    spark = found.sparkSession
    every = [(s, i, s == everything ^ 1 << i, factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for s in range(everything) for i in range(n) if not s >> i & 1]
    steps = [("".join(filters[i] for i in order), k + 1, sum(1 << i for i in order[:k]), order[k]) for order in permutations(range(n)) for k in range(n)]
    counts = ["held", "removed", *[f"{m}_lost" for m in marks]]
    parts = found.where("state = 0").select("part").distinct()
    grid = parts.select("part", F.inline(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(i).alias("filter"), F.lit(alone).alias("alone"), F.lit(w).alias("weight")) for s, i, alone, w in every])))
    dense = grid.join(found, ["part", "state", "filter"], "left").select("part", "state", "filter", "alone", "weight", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts])
    own = Window.partitionBy("part", "filter")
    where = lambda edge: F.max(F.when(edge, F.col("removed"))).over(own)
    rated = dense.select(
        "part", "state", "filter", *[f"{m}_lost" for m in marks], "removed", (F.col("held") - F.col("removed")).alias("kept"),
        (where(F.col("state") == 0) - F.col("removed")).alias("redundant"),
        where(F.col("alone")).alias("unique_fails"),
        F.sum(F.col("weight") * F.col("removed")).over(own).alias("shapley"),
    )
    table = spark.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    return rated.join(F.broadcast(table), ["state", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{m}_lost" for m in marks], "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report of the five filters over whole documents, by source. An empty table has an empty report."""
    marks = ["good", "toxic"]
    return report(edges(flagged(docs, labels), list(LETTERS), marks=marks), list(LETTERS), marks=marks)
