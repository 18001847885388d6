"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose statistic lies beyond a cutoff. The cutoffs of all rules form one
fixed sequence from loose to tight (``STEPS``: the loosest cutoff of every rule in turn, then the next
ones), so that going on rejects more and more. A document's step is the first one that rejects it.

On labelled good documents of a stratum (the holdout; nothing else is learned from them) every step is
tested: the exact binomial probability of at most the observed number of false rejections, by all rules
up to this step together, if their true rate were above ``alpha``. A stratum advances while the test
rejects that hypothesis at its level, and stops for good at the first step that fails; because the
sequence is fixed, that needs no correction over steps, cutoffs or rules. Over strata the level ``delta``
is divided by their number (Bonferroni). With probability 1 - ``delta`` every stratum then loses at most
a share ``alpha`` of its good documents to all rules together.

A stratum with so few labelled good documents that no test could succeed, even without a false
rejection, is judged together with all others of its kind: the limit then holds for their union. Which
ones these are depends on the numbers of labels alone, not on outcomes, and they count as strata still.
Only DataFrame expressions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_io import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: (rule, statistic, sign, cutoffs from loose to tight); sign 1 rejects above the cutoff, -1 below it.
RULES = (
    ("symbols", "symbol_ratio", 1, (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05)),
    ("dup_lines", "dup_line_ratio", 1, (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    ("repeats", "repeat_ratio", 1, (0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    ("capitals", "capital_ratio", 1, (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2)),
    ("long_words", "mean_word_chars", 1, (20.0, 15.0, 12.0, 10.0, 9.0, 8.0)),
    ("short_words", "mean_word_chars", -1, (1.5, 2.0, 2.5, 3.0, 3.5)),
)

#: The fixed sequence of the tests: (rule, cutoff).
STEPS = sorted(((r, j) for r, rule in enumerate(RULES) for j in range(len(rule[3]))), key=lambda x: (x[1], x[0]))
NEVER = len(STEPS)


def word_stats(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals.

    Trigram equality within a document is tested on 64-bit hashes of the three words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)]
    held = [f"__k{i}" for i in range(len(keep))]
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(
        *own,
        F.filter(F.split(text, SPACE), lambda x: x != "").alias("w"),
        lines.alias("lines"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, CAPITALS, ""))).cast("long").alias("n_capitals"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
    )
    size = F.size("w")
    grams = F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    hashed = base.select(
        *held, "n_symbols", "n_capitals", "word_chars",
        size.cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(size >= 3, grams).otherwise(F.array().cast("array<bigint>")).alias("g"),
    )
    rest = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_capitals"]
    # Sorted (hash, position) pairs of the texts that repeat a trigram; equal hashes stand side by side.
    ranked = hashed.select(*held, *rest, F.when(F.size(F.array_distinct("g")) < F.size("g"), F.array_sort(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    h = lambda k: F.get(F.col("s"), k)["h"]
    again = F.filter(F.transform(F.sequence(F.lit(0), F.size("s") - 1), lambda k: F.when((h(k) == h(k - 1)) | (h(k) == h(k + 1)), F.get(F.col("s"), k)["i"])), lambda x: x.isNotNull())
    found = ranked.select(*held, *rest, F.when(F.col("s").isNotNull(), F.array_sort(again)).alias("p"))
    covered = F.aggregate(
        "p",
        F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + 3).alias("to"), (a["n"] + p + 3 - F.greatest(p, a["to"])).alias("n")),
        lambda a: a["n"],
    )
    return found.select(*[F.col(k).alias(c) for k, c in zip(held, keep, strict=True)], *rest, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def rule_stats(stats: DataFrame) -> DataFrame:
    return stats.withColumns({
        "symbol_ratio": _ratio("n_symbols", "word_chars"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": _ratio("n_repeat_words", "n_words"),
        "capital_ratio": _ratio("n_capitals", "word_chars"),
        "mean_word_chars": _ratio("word_chars", "n_words"),
    })


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X binomial (n, rate), term by term in logarithms; 1 where k is not below n * rate."""
    odds = F.log(F.lit(rate / (1 - rate)))
    start = n * F.log(F.lit(1 - rate))
    step = lambda a, i: F.struct(
        (a["l"] + F.log((n - i + 1) / i) + odds).alias("l"),
        (a["c"] + F.exp(a["l"] + F.log((n - i + 1) / i) + odds)).alias("c"),
    )
    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(terms, F.struct(start.cast("double").alias("l"), F.exp(start).cast("double").alias("c")), step, lambda a: a["c"])
    return F.when(k >= n * F.lit(rate), F.lit(1.0)).otherwise(total)


def _beyond(rule: int, cutoff: Column) -> Column:
    _, stat, sign, _ = RULES[rule]
    return (F.col(stat) > cutoff) if sign > 0 else (F.col(stat) < cutoff)


def first_step() -> Column:
    """The first step that rejects a row, NEVER where none does."""
    return F.least(*[F.when(_beyond(r, F.lit(RULES[r][3][j])), F.lit(t)).otherwise(F.lit(NEVER)) for t, (r, j) in enumerate(STEPS)])


def choose_limits(good: DataFrame, *, stratum_col: str = "stratum", step_col: str = "step", alpha: float = 0.05, delta: float = 0.1) -> DataFrame:
    """(stratum, limit): the last step that is proven safe for the stratum, -1 where none is.

    good: the steps of labelled good documents. One pass counts the false rejections of every step;
    what is left is a row for each stratum. Strata of too few rows are tested as one.
    """
    up_to = [F.count_if(F.col(step_col) <= t).alias(f"k{t}") for t in range(len(STEPS))]
    counts = cut_lineage(good.groupBy(F.col(stratum_col).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *up_to))
    counts = counts.withColumn("level", F.lit(delta) / counts.agg(F.count(F.lit(1))).scalar())
    small = F.pow(F.lit(1 - alpha), F.col("n")) > F.col("level")
    # Whole strata and the union of the small ones, each tested once.
    tested = counts.groupBy(small.alias("small"), F.when(~small, F.col("stratum")).alias("own")).agg(F.sum("n").alias("n"), F.first("level").alias("level"), *[F.sum(f"k{t}").alias(f"k{t}") for t in range(len(STEPS))])
    passed = F.array(*[binomial_tail(F.col(f"k{t}"), F.col("n"), alpha) <= F.col("level") for t in range(len(STEPS))])
    failed = F.array_position(passed, False)  # from 1; 0 where every step passes
    limits = tested.select("small", "own", F.when(failed > 0, failed - 2).otherwise(len(STEPS) - 1).cast("int").alias("limit"))
    named = counts.select("stratum", small.alias("s2"))
    return named.join(limits, (F.col("s2") == F.col("small")) & (F.col("small") | F.col("stratum").eqNullSafe(F.col("own")))).select("stratum", "limit")


def rejected(limit: Column) -> Column:
    """The names of the rules that reject a row by their cutoffs up to the limit."""
    hits = []
    for r, (name, _, _, cuts) in enumerate(RULES):
        cutoff = F.lit(None).cast("double")
        for j, c in enumerate(cuts):
            cutoff = F.when(limit >= STEPS.index((r, j)), F.lit(c)).otherwise(cutoff)
        hits.append(F.when(_beyond(r, cutoff), F.lit(name)))
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    good_col: str = "quality",
    alpha: float = 0.05,
    delta: float = 0.1,
) -> DataFrame:
    """One row per row of docs: id, the statistics, base_failed, rules (names of rejecting rules), kept.

    A null text has no words and fails the base rule; a null stratum is a stratum; strata without
    labelled good documents have no limit, so that only the base rule applies. Labels of ids that docs
    lacks, null ids and null labels are ignored; of repeated labels of an id the largest holds, and
    repeated documents count once each. Empty tables are fine. Other columns are ignored.
    Good documents that the base rule already rejects say nothing about the other rules and are left out.
    """
    stats = word_stats(docs, text_col=text_col, keep=(id_col, stratum_col)).withColumnRenamed(stratum_col, "__stratum")
    stats = cut_lineage(stats)
    rated = rule_stats(stats).withColumn("__step", first_step())
    good = labels.where(F.col(good_col).isNotNull()).groupBy(F.col(id_col).alias("__lid")).agg(F.max(good_col).alias("__good")).where("__good = 1")
    held = rated.where(~base_failed()).join(good, F.col(id_col) == F.col("__lid"), "left_semi")
    limits = choose_limits(held, stratum_col="__stratum", step_col="__step", alpha=alpha, delta=delta)
    judged = rated.join(limits, F.col("__stratum").eqNullSafe(F.col("stratum")), "left").withColumn("rules", F.when(F.col("__step") <= F.col("limit"), rejected(F.col("limit"))).otherwise(F.array().cast("array<string>")))
    return judged.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), "rules", (~base_failed() & (F.size("rules") == 0)).alias("kept")
    )
