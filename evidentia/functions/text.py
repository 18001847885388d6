"""Text functions: cleaning, terms, sentences, shingles, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CLICKBAIT_PHRASES


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_claim(text: Column) -> Column:
    """A post without links, mentions, hash signs and symbols; runs of marks become sentence ends."""
    out = text
    for pattern, to in ((r"https?://\S+", " "), (r"(?U)@\w+", " "), ("#", " "), (r"(?U)[^\w\s.,!?'\"-]", " "), (r"[!?]{2,}", ". "), (r"\.{2,}", ". ")):
        out = F.regexp_replace(out, pattern, to)
    return squeeze(out)


def has_claim(text: Column) -> Column:
    """At least 15 characters after squeezing, and three Latin or Arabic letters in a row."""
    return (F.length(squeeze(text)) >= 15) & text.rlike(r"[A-Za-z؀-ۿ]{3,}")


def has_arabic(text: Column, *, one_block: bool = False) -> Column:
    return text.rlike(r"[؀-ۿ]" if one_block else r"[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]")


def hashtags(text: Column) -> Column:
    """Distinct lower-case tags in order, underscores as spaces, without mere numbers."""
    tags = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)#(\w{2,})"), F.lit(1)), lambda t: F.trim(F.lower(F.replace(t, F.lit("_"), F.lit(" ")))))
    return F.array_distinct(F.filter(tags, lambda t: (t != "") & ~t.rlike(r"(?U)^\d+$")))


def keyword_tokens(text: Column) -> Column:
    """Distinct lower-case tokens in order: no mere numbers, short ones only with a digit."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9][A-Za-z0-9\-]+"), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(tokens, lambda t: ~t.rlike(r"^\d+$") & ((F.length(t) >= 3) | t.rlike("[0-9]"))))


def short_query(text: Column, words: int = 8) -> Column:
    return F.array_join(F.slice(word_list(text), 1, words), " ")


def search_query(text: Column, max_terms: int = 15, entities: Column | None = None, key_words: Column | None = None, tags: Column | None = None) -> Column:
    """Hashtags, then entities (from a model or a gazetteer) and key words (operators.keyphrases), if there are, then tokens up to max_terms; else the first eight words.

    tags are the text's hashtags where they are known. A text is cleaned only where what comes first leaves room for its tokens.
    """
    cleaned = clean_claim(text)
    first = F.array_distinct(F.concat(hashtags(text) if tags is None else tags, *[F.coalesce(c, F.array().cast("array<string>")) for c in (entities, key_words) if c is not None]))
    terms = let(first, lambda f: F.slice(F.when(F.size(f) >= max_terms, f).otherwise(F.array_distinct(F.concat(f, keyword_tokens(cleaned)))), 1, max_terms))
    return let(terms, lambda t: F.when(F.size(t) > 0, F.array_join(t, " ")).otherwise(short_query(cleaned)))


def normalise_query(text: Column) -> Column:
    """Words, spaces, hyphens and apostrophes only; null if nothing is left."""
    out = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w\s\-']", " "), r"\s{2,}", " "))
    return F.when(out != "", out)


def normalise_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s{3,}", "  "), r"\n{3,}", "\n\n"))


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    return F.size(word_list(text))


def query_terms(text: Column, expansions: Column | None = None) -> Column:
    own = F.filter(word_list(F.lower(text)), lambda w: F.length(w) > 2)
    return F.array_distinct(own if expansions is None else F.concat(own, F.flatten(F.transform(expansions, lambda e: F.filter(word_list(F.lower(e)), lambda w: F.length(w) > 2)))))


def letters_tokens(text: Column) -> Column:
    """Lower-case runs of three or more letters a-z with no letter, digit or underscore of any script beside them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{M}\p{N}_])[a-z]{3,}(?![\p{L}\p{M}\p{N}_])"), F.lit(0))


def sentences(text: Column, *, longer_than: int = 0) -> Column:
    """Pieces between an end mark with space after it and a capital."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.trim(s))  # F.trim itself would take the piece's number as what to trim
    return F.filter(parts, lambda s: F.length(s) > longer_than)


def word_shingles(text: Column, k: int = 4) -> Column:
    """Distinct runs of k words (letters, digits, underscores; lower case); the distinct words of shorter texts."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
    return let(words, lambda w: F.array_distinct(F.when(F.size(w) < k, w).otherwise(runs(w))))


def snippet(text: Column, most: int = 800) -> Column:
    """Squeezed text; beyond most characters cut at the last space before, with an ellipsis."""
    t = squeeze(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most), r" [^ ]*$", ""), F.lit("…")))


def clickbait_factor(title: Column) -> Column:
    """1 for plain titles; times 0.5 for a phrase, 0.7 for mostly capitals, 0.8 for repeated marks."""
    low = F.lower(title)
    letters = F.length(F.regexp_replace(title, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(title, r"[^\p{Lu}]", ""))
    phrase = F.exists(F.array(*[F.lit(p) for p in CLICKBAIT_PHRASES]), lambda p: F.contains(low, p))
    marks = (F.length(title) - F.length(F.replace(title, F.lit("!"), F.lit(""))) >= 2) | (F.length(title) - F.length(F.replace(title, F.lit("?"), F.lit(""))) >= 2)
    factor = F.when(phrase, 0.5).otherwise(1.0) * F.when((letters > 0) & (capitals / F.greatest(letters, F.lit(1)) > 0.5), 0.7).otherwise(1.0) * F.when(marks, 0.8).otherwise(1.0)
    return F.when(title.isNull() | (title == ""), F.lit(1.0)).otherwise(factor)


def keyword_overlap(text: Column, terms: Column) -> Column:
    """Share of the query's terms among the text's tokens plus 0.05, at most 1; 0.5 without terms."""
    query = F.array_distinct(terms)
    share = F.size(F.array_intersect(letters_tokens(text), query)) / F.size(query) + 0.05
    return F.when(F.coalesce(F.size(query), F.lit(0)) <= 0, F.lit(0.5)).otherwise(F.least(share, F.lit(1.0)))


def labelled_line(text: Column, label: str) -> Column:
    """What follows 'LABEL:' at the start of a line; null where there is none."""
    got = F.trim(F.regexp_extract(text, rf"(?m)^{label}:(.*)$", 1))
    return F.when(got != "", got)


def first_json_list(text: Column, most: int | None = None) -> Column:
    """The first JSON list of strings in a text, cut to most entries."""
    got = F.from_json(F.regexp_extract(text, r"(?s)\[.*?\]", 0), "array<string>")
    return F.slice(got, 1, most) if most is not None else got
