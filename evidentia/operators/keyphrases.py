"""Statistical key words of single texts: no word list, no training, no other text.

A word's score rests on how it is written (capitals, acronyms), where it stands, how often, in how many
sentences, and with how many different neighbours; low scores are better. Function words fall through by
their many neighbours. ``word_scores`` gives every word's figures, as a grouped aggregate of the exploded
words: texts are dealt out by key once, before the words are exploded, so that grouping and ranking need no
further exchange; a group is one word of one text. ``best_words`` gives the best words alone, by the same
scores, as a column of the text: nothing is exploded, exchanged or joined.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable
from functools import cache
from itertools import chain
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import bounded

#: Sentences end at these marks; words are runs of letters and digits of any script.
SENTENCE_ENDS, WORD = r"[.!?\n]+", r"[\p{L}\p{N}]+"
#: Words that are more alike than this, by edit distance over the longer one's length, are one.
ALIKE = 0.7


def _words(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, sent, pos, word, form, left, right): one row a word of a sentence, both counted from 0; form is as written."""
    sentences = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), SENTENCE_ENDS), lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(0))), lambda w: F.size(w) > 0)
    # A word takes its neighbours with it before it is exploded: a row that held its sentence would cost the square of the sentence's length.
    beside = lambda w, i: F.struct(i.alias("pos"), F.get(w, i).alias("form"), F.get(w, i - 1).alias("left"), F.get(w, i + 1).alias("right"))
    per = texts.select(F.col(key).alias("key"), sentences.alias("s")).select("key", "s", F.size("s").alias("n_sent")).select("key", "n_sent", F.posexplode(F.transform("s", lambda w: F.transform(w, lambda _, i: beside(w, i)))).alias("sent", "w"))
    return per.select("key", "n_sent", "sent", F.inline("w")).select("key", "n_sent", "sent", "pos", "form", F.lower("form").alias("word"), F.lower("left").alias("left"), F.lower("right").alias("right"))


def word_scores(texts: DataFrame, *, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, word, tf, casing, position, frequency, spread, context, score) of every word with a letter and three characters or more.

    With tf, tfs of the text's words of two characters or more:
    casing = max(acronyms, capitals not at a sentence's start) / (1 + ln tf); position = ln(3 + median of the
    sentences' numbers); frequency = tf / (mean + deviation of tf); spread = share of the sentences; context =
    1 + (distinct left / left + distinct right / right) * tf / max tf; score = context * ln(position) /
    (casing + frequency / context + spread / context). Rows of one key are one text as far as counts go, so
    keys should be unique; null texts have no words.
    """
    one = _words(texts.select(key, text_col).repartition(F.col(key)), key, text_col)
    forms = one.groupBy("key", "word").agg(
        F.count(F.lit(1)).alias("tf"),
        F.max("n_sent").alias("n_sent"),
        F.count_if((F.length("form") > 1) & (F.upper("form") == F.col("form")) & F.col("form").rlike(r"\p{L}")).alias("acronyms"),
        F.count_if((F.col("pos") > 0) & F.col("form").rlike(r"^\p{Lu}")).alias("capitals"),
        F.percentile("sent", F.lit(0.5)).alias("middle"),
        F.size(F.collect_set("sent")).alias("sentences"),
        F.size(F.collect_set("left")).alias("lefts"), F.count("left").alias("n_left"),
        F.size(F.collect_set("right")).alias("rights"), F.count("right").alias("n_right"),
    )
    own = Window.partitionBy("key")
    counted = F.when(F.length("word") > 1, F.col("tf"))
    share = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(0.0)
    made = forms.select(
        "key", "word", "tf",
        (F.greatest("acronyms", "capitals") / (1 + F.log("tf"))).alias("casing"),
        F.log(3 + F.col("middle")).alias("position"),
        (F.col("tf") / F.coalesce(F.avg(counted).over(own) + F.stddev_pop(counted).over(own), F.lit(1.0))).alias("frequency"),
        (F.col("sentences") / F.col("n_sent")).alias("spread"),
        (1 + (share("lefts", "n_left") + share("rights", "n_right")) * F.col("tf") / F.max("tf").over(own)).alias("context"),
    )
    score = F.col("context") * F.log("position") / (F.col("casing") + (F.col("frequency") + F.col("spread")) / F.col("context"))
    return made.where((F.length("word") > 2) & F.col("word").rlike(r"\p{L}")).select(F.col("key").alias(key), "word", "tf", "casing", "position", "frequency", "spread", "context", score.alias("score"))


_ENDS, _WORD = re.compile(SENTENCE_ENDS), re.compile(r"[^\W_]+")


def _scores(text: str) -> dict[str, float]:
    """The scores of ``word_scores`` for the words of one text, in time that grows with its length."""
    sentences = [w for s in _ENDS.split(text) if (w := _WORD.findall(s))]
    at, beside, opened, first, last = defaultdict(list), set(), Counter(), Counter(), Counter()
    for i, forms in enumerate(sentences):
        words = [x.lower() for x in forms]
        for x in words:
            at[x].append(i)
        beside.update(zip(words, words[1:]))
        opened[forms[0]] += 1
        first[words[0]] += 1
        last[words[-1]] += 1
    acronyms, capitals = Counter(), Counter()
    for form, n in Counter(chain.from_iterable(sentences)).items():
        if form.islower() and form.isascii():
            continue
        if len(form) > 1 and form.upper() == form and _lettered(form):
            acronyms[form.lower()] += n
        if unicodedata.category(form[0]) == "Lu":
            capitals[form.lower()] += n - opened[form]
    rights, lefts = Counter(map(itemgetter(0), beside)), Counter(map(itemgetter(1), beside))
    tfs = Counter(len(x) for w, x in at.items() if len(w) > 1)
    n_words = tfs.total() or 1
    mean = sum(tf * n for tf, n in tfs.items()) / n_words
    usual = mean + math.sqrt(sum((tf - mean) ** 2 * n for tf, n in tfs.items()) / n_words) or 1.0
    most = max(map(len, at.values()), default=0)

    @cache  # most words of a text occur once and share their figures with others
    def score(tf, cased, middle, n_sent, lefts, n_left, rights, n_right):
        context = 1 + ((lefts / n_left if n_left else 0.0) + (rights / n_right if n_right else 0.0)) * tf / most
        return context * math.log(math.log(3 + middle)) / (cased / (1 + math.log(tf)) + (tf / usual + n_sent / len(sentences)) / context)

    out = {}
    for w, x in at.items():
        if len(w) > 2 and _lettered(w):
            tf, cased = len(x), max(acronyms.get(w, 0), capitals.get(w, 0))
            if tf == 1:
                left, right = w not in first, w not in last
                out[w] = score(1, cased, x[0], 1, left, left, right, right)
            else:
                out[w] = score(tf, cased, (x[(tf - 1) // 2] + x[tf // 2]) / 2, len(set(x)), lefts[w], tf - first[w], rights[w], tf - last[w])
    return out


def _lettered(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def _distance(a: str, b: str) -> int:
    """Edit distance, a column of its table at a time as the bits of whole numbers."""
    where, full = {}, (1 << len(a)) - 1
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    up, down, far, end = full, 0, len(a), 1 << len(a) >> 1
    for c in b:
        same = where.get(c, 0)
        across = ((same & up) + up ^ up) | same
        more, less = down | full & ~(across | up), up & across
        far += bool(more & end) - bool(less & end)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(same | down | more)) & full, more & (same | down) & full
    return far


def _alike(a: str, b: str) -> bool:
    longer = max(len(a), len(b))
    # An edit adds or takes one of the kinds of letters on either side, so most pairs need no distance.
    if not 1 - abs(len(a) - len(b)) / longer > ALIKE or not 1 - (len(set(a) ^ set(b)) + 1) // 2 / longer > ALIKE:
        return False
    return 1 - _distance(a, b) / longer > ALIKE


def _best(texts: Iterable[str | None], top: int) -> list[list[str]]:
    out = []
    for text in texts:
        equal, tiers, got = defaultdict(list), defaultdict(list), []
        for word, score in _scores(text or "").items():
            equal[score].append(word)
        for score, words in equal.items():
            tiers[round(score, 9)] += words
        for word in (w for tier in sorted(tiers) for w in sorted(tiers[tier])):
            if len(got) >= top:
                break
            if not any(_alike(word, g) for g in got):
                got.append(word)
        out.append(got)
    return out


def best_words(text: Column, top: int = 20) -> Column:
    """The best words of a text in order of score, ties by the word; a word that is like a better one is left out. Empty for null texts and those without words."""

    @F.pandas_udf("array<string>")
    def best(texts: pd.Series) -> pd.Series:
        return pd.Series(_best(texts, top), dtype=object)

    return best(F.make_valid_utf8(text))


def key_words(texts: DataFrame, top: int = 20, *, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, words): ``best_words`` of each row's text."""
    return bounded(texts).select(key, best_words(F.col(text_col), top).alias("words"))
