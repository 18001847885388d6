"""Pages for claims by shared terms: the best few of each claim, without joining frequent terms.

A page's score for a claim is the sum of its shared terms' weights over the root of its number of terms. Pages are
kept in cells of their trust and size, which bounds what a term can give to a page of the cell. What a claim's
weightiest terms find is scored first; the n-th best page of a tier of trust is a floor for the tier. In
each cell the lightest terms that together stay below the floor are left out of the join: a page that has none but
those can't get in. What the others find is dropped if it can't reach the floor with those left out, and else scored
on all terms. The result is that of the whole join; what is joined follows the answers, not claims x pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import kept
from .ranking import top_rows

#: Entries that are joined for each claim and tier before the floors are known; cells for each doubling of a page's size.
FIRST, CELLS = 200, 4
#: Bounds are widened by more than their rounding.
SLACK = 1 + 1e-9


def best_pages(claims: DataFrame, pages: DataFrame, n: int, *, terms: Callable[[Column], Column]) -> DataFrame:
    """(claim_id, url, trust, hits, size, rank): for each claim the n best of the pages that share a term with it.

    claims: claim_id, claim. pages: url, text, trust, url unique. By trust, then hits over the root of the page's number of
    terms, then the page of fewer terms, then the URL. hits is a whole number: each shared term weighs the logarithm
    of its rarity in millionths. Null texts and claims have no terms, and are not found and find nothing.
    """
    own = pages.select("url", "trust", F.array_distinct(terms(F.coalesce("text", F.lit("")))).alias("terms")).withColumn("size", F.size("terms")).where("size > 0")
    asked = claims.select("claim_id", F.explode(F.array_distinct(terms(F.coalesce("claim", F.lit(""))))).alias("term"))
    bucket = F.floor(CELLS * F.log2("size") + 1e-9).cast("int").alias("bucket")
    words = own.select("url", "trust", "size", bucket, F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    words = kept(words)  # the texts are read once; what follows works on the claims' own terms
    cells = words.groupBy("term", "trust", "bucket").agg(F.count(F.lit(1)).alias("pages"))
    total = pages.agg(F.count(F.lit(1)).alias("total"))
    often = cells.groupBy("term").agg(F.sum("pages").alias("often"))
    weighed = asked.join(often, "term").crossJoin(total).select("claim_id", "term", F.round(F.log1p(F.col("total") / F.col("often")) * 1e6).cast("long").alias("weight"))
    places = kept(weighed.join(cells, "term").withColumn("most", F.col("weight") / F.pow(F.lit(2.0), F.col("bucket") / (2.0 * CELLS))))

    def scored(pairs: DataFrame) -> DataFrame:
        """Pairs (claim_id, url, trust, size) with all that their shared terms give."""
        ends = pairs.select("claim_id", "url", "trust", "size").join(words.select("url", "term"), "url").join(weighed, ["claim_id", "term"])
        return ends.groupBy("claim_id", "url", "trust", "size").agg(F.sum("weight").alias("hits")).withColumn("score", F.col("hits") / F.sqrt("size"))

    tier = Window.partitionBy("claim_id", "trust")
    before = F.sum("pages").over(tier.orderBy(F.desc("most"), "term", "bucket")) - F.col("pages")
    first = scored(words.join(places.withColumn("before", before).where(F.col("before") < FIRST), ["term", "trust", "bucket"]).select("claim_id", "url", "trust", "size").distinct())
    ranked = first.withColumn("r", F.row_number().over(tier.orderBy(F.desc("score")))).where(F.col("r") <= n)
    floors = ranked.groupBy("claim_id", "trust").agg(F.max(F.when(F.col("r") == n, F.col("score"))).alias("floor"), F.count(F.lit(1)).alias("known"))
    higher = Window.partitionBy("claim_id").orderBy(F.desc("trust")).rowsBetween(Window.unboundedPreceding, -1)
    floors = kept(floors.withColumn("full", F.coalesce(F.sum("known").over(higher), F.lit(0)) >= n).select("claim_id", "trust", F.coalesce("floor", F.lit(0.0)).alias("floor"), "full"))
    # In each cell: what a term and all lighter ones can give together; those below the floor are left out, and what they weigh is kept for the bound.
    cell = Window.partitionBy("claim_id", "trust", "bucket")
    bound = places.withColumn("upto", F.sum("most").over(cell.orderBy("weight", "term"))).join(floors.where("not full"), ["claim_id", "trust"])
    bound = bound.withColumn("needed", F.col("upto") * SLACK >= F.col("floor")).withColumn("rest", F.coalesce(F.sum(F.when(~F.col("needed"), F.col("weight"))).over(cell), F.lit(0)))
    needed = bound.where("needed").select("claim_id", "term", "trust", "bucket", "weight", "rest", "floor")
    hits = words.join(needed, ["term", "trust", "bucket"]).groupBy("claim_id", "url", "trust", "size", "rest", "floor").agg(F.sum("weight").alias("some"))
    best = scored(hits.where((F.col("some") + F.col("rest")) / F.sqrt("size") * SLACK >= F.col("floor")))
    return top_rows(best, n, by=["claim_id"], order=[F.desc("trust"), F.desc("score"), F.asc("size"), F.asc("url")]).select("claim_id", "url", "trust", "hits", "size", "rank")
