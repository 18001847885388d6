"""Sentence boundaries learned from the texts themselves, without labels or word lists.

After Kiss and Strunk (2006): an abbreviation is a word that nearly always stands before a period, short, and
often with periods inside; a frequent starter is a word drawn to the beginnings of sentences; a collocation is
a pair that a period does not part. All three are log-likelihood ratios of counts, and the counts come from one
aggregation of neighbouring words, which combines before it shuffles. What reaches the driver is three totals.

The splitter cuts a text at every mark with space behind it and joins the pieces again where the model says that
the period ends no sentence. Texts are dealt out by key once; the model's tables are joined to the pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import kept

SPACE = r"[ \t\n\f\r]+"
OPEN, CLOSE = """"'([{«“‘""", """"')]}»”’,;:"""
#: Least scores of abbreviations, starters and collocations, as in the paper.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
NUMBER = "##"


def _shape(token: Column) -> Column:
    """(type, dot, mark, upper) of a token: lower case without quotes and the last period; numbers are one type."""
    core = F.rtrim(F.ltrim(token, F.lit(OPEN)), F.lit(CLOSE))
    dot = core.endswith(".") & ~core.endswith("..") & (F.length(core) > 1)
    bare = F.lower(F.when(dot, F.substring(core, F.lit(1), F.length(core) - 1)).otherwise(core))
    number = (bare != "") & (F.ltrim(bare, F.lit("0123456789.,")) == "") & ~bare.endswith(".") & ~bare.endswith(",")
    return F.struct(F.when(number, F.lit(NUMBER)).otherwise(bare).alias("type"), dot.alias("dot"), (core.endswith("!") | core.endswith("?")).alias("mark"), core.rlike(r"^\p{Lu}").alias("upper"))


def _tokens(text_col: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), SPACE), lambda t: t != "")


def occurrences(texts: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(type, dot, n): how often a word stands with and without a period, which is all that abbreviation_scores() counts."""
    return texts.select(F.explode(_tokens(text_col)).alias("x")).select(_shape(F.col("x")).alias("x")).groupBy("x.type", "x.dot").agg(F.count(F.lit(1)).alias("n"))


def neighbours(texts: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(type, dot, mark, next, upper, n): how often a word stands with a period or mark before another one; next is empty at a text's end, upper is the next one's."""
    # A token takes its next one with it before it is exploded: a row that held its text would cost the square of the text's length.
    pairs = texts.select(_tokens(text_col).alias("w")).select(F.inline(F.transform("w", lambda x, i: F.struct(x.alias("x"), F.coalesce(F.get("w", i + 1), F.lit("")).alias("y")))))
    flat = pairs.select(_shape(F.col("x")).alias("x"), _shape(F.col("y")).alias("y")).select("x.type", "x.dot", "x.mark", F.col("y.type").alias("next"), F.col("y.upper").alias("upper"))
    return flat.groupBy("type", "dot", "mark", "next", "upper").agg(F.count(F.lit(1)).alias("n"))


def _xlogy(x: Column, y: Column) -> Column:
    return F.when((x != 0) & (y > 0), x * F.log(y)).otherwise(0.0)


def _binomial(k: Column, n: Column, p: Column) -> Column:
    return _xlogy(k, p) + _xlogy(n - k, 1 - p)


def association(a: Column, b: Column, both: Column, n: Column | float) -> Column:
    """Twice the log-likelihood ratio of b being as frequent with a as without it, from counts of each, of both and of all."""
    n = F.lit(n) if not isinstance(n, Column) else n
    p, p1, p2 = b / n, both / a, F.when(n > a, (b - both) / F.nullif(n - a, F.lit(0))).otherwise(1.0)
    return -2 * (_binomial(both, a, p) + _binomial(b - both, n - a, p) - _binomial(both, a, p1) - _binomial(b - both, n - a, p2))


def abbreviation_scores(pairs: DataFrame, total: int, dots: int) -> DataFrame:
    """(type, with_dot, without_dot, score) of the types with a letter that stand before a period at least once."""
    with_, without = F.col("with_dot"), F.col("without_dot")
    ratio = 2 * (_binomial(with_, with_ + without, F.lit(0.99)) - _binomial(with_, with_ + without, F.lit(dots / max(1, total))))
    inside = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = (F.length("type") - inside).cast("double")
    score = ratio * F.exp(-letters) * (inside + 1) * F.pow(letters, -without)
    counts = pairs.groupBy("type").agg(F.sum(F.when(F.col("dot"), F.col("n")).otherwise(0)).alias("with_dot"), F.sum(F.when(~F.col("dot"), F.col("n")).otherwise(0)).alias("without_dot"))
    return counts.where((with_ > 0) & F.col("type").rlike(r"\p{L}")).withColumn("score", score)


@dataclass
class Boundaries:
    """Tables of a model: abbreviations (type), starters (type), collocations (type, next), cases (type, low, high: seen in lower case, with a capital inside a sentence)."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame
    cases: DataFrame


def learn(texts: DataFrame, *, text_col: str = "text") -> Boundaries:
    """The model of a corpus. Null and empty texts count for nothing; without texts the model is empty and every period ends a sentence.

    The counts of neighbours are written to the context's checkpoint folder, since all tables come from them.
    """
    pairs = kept(neighbours(texts, text_col=text_col))
    sums = pairs.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("dot"), F.col("n"))).alias("d")).first()
    total, dots = sums.n or 0, sums.d or 0
    short = kept(abbreviation_scores(pairs, total, dots).where(F.col("score") >= ABBREVIATION).select("type"))
    known = pairs.join(short.select("type", F.lit(True).alias("short")), "type", "left").fillna(False, ["short"])
    plain = ~F.col("short") & (F.length("type") > 1) & (F.col("type") != NUMBER)
    ends = F.col("mark") | (F.col("dot") & plain)
    after = known.where(ends & (F.col("next") != "")).groupBy(F.col("next").alias("type")).agg(F.sum("n").alias("both"))
    breaks = after.agg(F.sum("both")).first()[0] or 0
    counts = pairs.groupBy("type").agg(F.sum("n").alias("n"))
    drawn = after.join(counts, "type").where(F.col("type").rlike(r"\p{L}") & (F.col("both") * total > F.col("n") * breaks))
    starters = kept(drawn.where(association(F.lit(float(breaks)), F.col("n"), F.col("both"), float(total)) >= STARTER).select("type"))
    parted = known.where(F.col("dot") & ~plain & (F.col("next") != "")).groupBy("type", "next").agg(F.sum("n").alias("both"))
    parted = parted.join(counts, "type").join(counts.select(F.col("type").alias("next"), F.col("n").alias("m")), "next").join(starters.select(F.col("type").alias("next")), "next", "left_anti")
    together = kept(parted.where((F.col("both") * total > F.col("n") * F.col("m")) & (association(F.col("n"), F.col("m"), F.col("both"), float(total)) >= COLLOCATION)).select("type", "next"))
    inside = ~F.col("dot") & ~F.col("mark")
    cases = pairs.where("next <> ''").groupBy(F.col("next").alias("type")).agg(F.max(~F.col("upper")).alias("low"), F.max(F.col("upper") & inside).alias("high")).where("low or high")
    return Boundaries(short, starters, together, cases)


def split(texts: DataFrame, model: Boundaries, *, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, pos, sentence) of each text, in order; white space inside where pieces were joined is one space. Keys should be unique.

    A mark other than a period ends a sentence, and so does the period of a word that is no abbreviation, initial
    or number. An abbreviation ends one before a capital word that starts sentences often, or that is otherwise
    written in lower case and never with a capital inside a sentence; so does an initial, by the second rule alone.
    A number ends one but before lower case. Neither does if the two words are a collocation. Null and empty texts
    have no sentence.
    """
    pieces = F.filter(F.split(F.trim(F.coalesce(F.col(text_col), F.lit(""))), r"""(?<=[.!?]["')\]}»”’]{0,3})[ \t\n\f\r]+"""), lambda p: p != "")
    rows = texts.select(key, text_col).repartition(F.col(key)).select(F.col(key).alias("key"), pieces.alias("p"))
    last = lambda t: _shape(F.regexp_extract(t, r"([^ \t\n\f\r]+)$", 1))
    head = lambda t: _shape(F.regexp_extract(t, r"^([^ \t\n\f\r]+)", 1))
    after = rows.select("key", F.inline(F.transform("p", lambda x, i: F.struct(i.alias("i"), x.alias("piece"), F.get("p", i + 1).alias("after")))))
    one = after.select("key", "i", "piece", last(F.col("piece")).alias("x"), head(F.col("after")).alias("y"))
    one = one.select("key", "i", "piece", "x.type", "x.dot", "x.mark", F.col("y.type").alias("next"), F.col("y.upper").alias("upper"))
    flag = lambda df, name, to: df.select(*[F.col(c).alias(t) for c, t in to.items()], F.lit(True).alias(name))
    one = one.join(flag(model.abbreviations, "short", {"type": "type"}), "type", "left")
    one = one.join(flag(model.starters, "starts", {"type": "next"}), "next", "left")
    one = one.join(flag(model.collocations, "pair", {"type": "type", "next": "next"}), ["type", "next"], "left")
    one = one.join(model.cases.select(F.col("type").alias("next"), "low", "high"), "next", "left")
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    begins = F.col("upper") & true("low") & ~true("high")
    initial = (F.length("type") == 1) & F.col("type").rlike(r"\p{L}")
    end = (
        F.when(F.col("mark"), True)
        .when(~F.col("dot"), True)  # an ellipsis, or a period behind quotes
        .when(true("pair"), False)
        .when(F.col("type") == NUMBER, F.col("upper") | ~F.col("next").rlike(r"^\p{Ll}"))
        .when(initial, begins)
        .when(true("short"), begins | (true("starts") & F.col("upper")))
        .otherwise(True)
    )
    own = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    numbered = one.select("key", "i", "piece", F.coalesce(F.sum(end.cast("int")).over(own), F.lit(0)).cast("int").alias("pos"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "piece"))), lambda x: x["piece"]), " ")
    return numbered.groupBy("key", "pos").agg(joined.alias("sentence")).select(F.col("key").alias(key), "pos", "sentence")
