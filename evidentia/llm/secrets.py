"""Secret scans: patterns, and sliding-window Shannon entropy over candidate strings.

Base patterns find assignments, access keys and long hex runs. On top of them every run of key-like
characters of 20 or more is a candidate. Its character class (digits, hex, letters and digits, base64)
sets a threshold; a window of 20 characters slides over it, and the counts of its characters and the sum
of c * log2(c) over them are kept up to date from the character that leaves and the one that enters. Candidates
whose largest window entropy reaches the threshold of their class are secrets unless an allow-list
pattern covers them. Only DataFrame expressions run here; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: Candidates for the entropy scan, and the window.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Bits of a packed count (up to WINDOW + 1), and values that a running sum takes together.
FIELD, BLOCK = 5, 64

#: Least window entropy (bits a character) that makes a candidate a secret, by its character class.
#: Runs without a digit (word) must also mix cases as chance does, see mixed_case(). Runs of digits alone have no threshold.
ENTROPY = {"hex": 2.9, "alnum": 3.6, "base64": 3.75, "word": 3.6}
#: Least changes of case a character, and least share of the letters in either case. Names in camel case have fewer capitals.
CHANGES, CASE_SHARE = 0.25, 0.3

#: A candidate is allowed (no secret) unless it matches one of these: a long number, or a token that mixes letters and digits.
NOT_ALLOWED = r"[0-9]{5}|[A-Za-z][0-9]|[0-9][A-Za-z]"
#: Further allow-list patterns: all-zero UUIDs and words with a short number at their end.
ALLOW = (r"^[0-]+$", r"^[A-Za-z]+[0-9]{1,4}$")

KINDS = ("assign", "access", "hex", "entropy")


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, plus) -> Column:
    """Exclusive prefix sums of an array of ints, from 0; plus(a, b) is the sum.

    Blocks of BLOCK values are summed first, so that no accumulator grows with the array.
    """
    size = F.lit(BLOCK)

    def sums(v: Column, start: Column) -> Column:
        zero = F.struct(start.alias("s"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(v, zero, lambda a, x: F.struct(plus(a["s"], x).alias("s"), F.concat(a["all"], F.array(a["s"])).alias("all")), lambda a: a["all"])

    def blocks(v: Column) -> Column:
        first = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int"))
        totals = F.transform(first, lambda k: F.aggregate(F.slice(v, k * size + 1, size), F.lit(0), plus))
        return bound(sums(totals, F.lit(0)), lambda starts: F.flatten(F.transform(starts, lambda start, k: sums(F.slice(v, k * size + 1, size), start))))

    return bound(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(F.array().cast("array<int>")))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of the leftmost non-overlapping matches.

    Offsets come from the lengths of the matches and of the pieces between them, which split() returns.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def placed(pairs: Column) -> Column:
        ends = running(F.transform(pairs, lambda p: F.length(p["g"]) + F.length(p["m"])), _plus)
        start = lambda p: p["at"] + F.length(p["p"]["g"])
        return F.transform(F.arrays_zip(pairs.alias("p"), ends.alias("at")), lambda p: F.struct(start(p).alias("s"), (start(p) + F.length(p["p"]["m"])).alias("e"), p["p"]["m"].alias("m")))

    pairs = F.filter(F.arrays_zip(found.alias("m"), between.alias("g")), lambda p: p["m"].isNotNull())
    return F.when(text.rlike(pattern), bound(pairs, placed)).otherwise(none)


def char_class(s: Column) -> Column:
    return F.when(~s.rlike("[0-9]"), "word").when(s.rlike("^[0-9]+$"), "digits").when(s.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), "hex").when(s.rlike("^[A-Za-z0-9]+$"), "alnum").otherwise("base64")


def max_window_entropy(s: Column, window: int = WINDOW) -> Column:
    """The largest entropy of a window of the string of ALPHABET; strings shorter than the window count as one window of their length.

    One pass over the characters. The counts of the window's characters are packed, FIELD bits each, into
    a few whole numbers. A step adds one to the count of the character that enters, takes one from that of
    the character that leaves, and moves the sum of c * log2(c), in units of 2 ** -40, by the four terms
    that this changes, so that a step costs the same whatever the length of the string.
    """
    per = 60 // FIELD
    words = -(-(len(ALPHABET) + 1) // per)
    term = F.array(*[F.lit(round(c * math.log2(c) * 2**40) if c else 0).cast("long") for c in range(window + 2)])
    names = [f"c{k}" for k in range(words)]

    def scan(codes: Column) -> Column:
        count = lambda a, x: F.get(F.array(*[a[c] for c in names]), (x / per).cast("int"))
        of = lambda a, x: F.call_function("shiftright", count(a, x), (x % per * FIELD).cast("int")).bitwiseAND(F.lit((1 << FIELD) - 1)).cast("int")
        one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), (x % per * FIELD).cast("int"))

        def moved(a: Column, x: Column, sign: int) -> Column:
            n = of(a, x)
            more = F.get(term, n + sign) - F.get(term, n)
            return F.struct(*[F.when((x / per).cast("int") == k, a[c] + sign * one(x)).otherwise(a[c]).alias(c) for k, c in enumerate(names)], (a["t"] + more).alias("t"), a["least"].alias("least"), (a["i"] + (1 if sign > 0 else 0)).alias("i"))

        def step(a: Column, x: Column) -> Column:
            left = bound(a, lambda a: F.when(a["i"] >= window, moved(a, F.get(codes, a["i"] - window), -1)).otherwise(a))
            full = bound(left, lambda a: moved(a, x, 1))
            return bound(full, lambda a: F.struct(*[a[c] for c in names], a["t"].alias("t"), F.when(a["i"] >= F.least(F.lit(window), F.size(codes)), F.least(a["least"], a["t"])).otherwise(a["least"]).alias("least"), a["i"].alias("i")))

        zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in names], F.lit(0).cast("long").alias("t"), F.lit(1 << 62).cast("long").alias("least"), F.lit(0).alias("i"))
        return F.aggregate(codes, zero, step, lambda a: a["least"])

    w = F.least(F.lit(window), F.length(s)).cast("double")
    codes = F.transform(F.filter(F.split(s, ""), lambda ch: ch != ""), lambda ch: F.instr(F.lit(ALPHABET), ch))
    return F.log2(w) - bound(codes, scan) / F.lit(float(1 << 40)) / w


def mixed_case(s: Column) -> Column:
    """Capitals and small letters alternate and share the letters as in random strings, unlike words and identifiers."""
    changes = F.regexp_count(s, F.lit("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"))
    upper, lower = F.regexp_count(s, F.lit("[A-Z]")), F.regexp_count(s, F.lit("[a-z]"))
    return (changes >= CHANGES * F.length(s)) & (F.least(upper, lower) >= CASE_SHARE * (upper + lower))


def entropy_secret(s: Column) -> Column:
    allowed = ~s.rlike(NOT_ALLOWED)
    for pattern in ALLOW:
        allowed = allowed | s.rlike(pattern)
    kind = char_class(s)
    limit = F.lit(ENTROPY["word"])
    for name, least in ENTROPY.items():
        limit = F.when(kind == name, F.lit(least)).otherwise(limit)
    allowed = F.when(kind == "word", ~mixed_case(s)).otherwise(allowed | (kind == "digits"))
    return F.when(allowed, F.lit(False)).otherwise(F.round(max_window_entropy(s), 9) >= limit)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' columns plus ``secrets``: array<struct<start, kind_no, kind, end>> by start, then kind in the order of KINDS.

    Null reads as the empty text; empty texts have no secrets; repeated rows give repeated results; an empty
    table gives an empty one; work is linear in a text's length, whatever the candidates or hits in it;
    overlapping spans of different kinds all stay. A column named secrets is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    span = lambda no: lambda m: F.struct(m["s"].alias("start"), F.lit(no).alias("kind_no"), F.lit(KINDS[no]).alias("kind"), m["e"].alias("end"))
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["m"], ASSIGN, 2)) >= 12)
    entropy = F.filter(matches(text, CANDIDATE), lambda m: entropy_secret(m["m"]))
    parts = [assign, matches(text, ACCESS), matches(text, HEX), entropy]
    spans = F.concat(*[F.transform(p, span(no)) for no, p in enumerate(parts)])
    return docs.drop(*[c for c in docs.columns if c == "secrets"]).withColumn("secrets", F.array_sort(spans))


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from scan_secrets()'s rows."""
    n = lambda no: F.size(F.filter("secrets", lambda x: x["kind_no"] == no)).cast("long")
    return scanned.select(
        id_col,
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(_line(F.filter("secrets", lambda x: x["kind_no"] < 3)), 256).alias("base_sha256"),
        _line(F.col("secrets")).alias("spans"),
    )


def redact(scanned: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """scan_secrets()'s rows with every maximal run of covered characters replaced by mark, without the column secrets.

    Null texts stay null, texts without secrets stay as they are.
    """

    def cut(chars: Column) -> Column:
        piece = lambda start, end: F.array_join(F.slice(chars, start + 1, end - start), "")
        before = running(F.transform("secrets", lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        runs = F.filter(F.arrays_zip(F.col("secrets").alias("x"), before.alias("at")), lambda r: (r["x"]["start"] > r["at"]) | (r["at"] == 0))
        kept = F.transform(runs, lambda r: F.concat(piece(r["at"], r["x"]["start"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), piece(F.array_max(F.transform("secrets", lambda x: x["end"])), F.size(chars)))

    whole = F.filter(F.split(F.col(text_col), ""), lambda ch: ch != "")
    return scanned.withColumn(text_col, F.when(F.size("secrets") > 0, bound(whole, cut)).otherwise(F.col(text_col))).drop("secrets")


def redact_documents(docs: DataFrame, *, text_col: str = "text", chars_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """docs with secrets replaced in the text and, where there is such a column, the number of characters brought up to date."""
    out = redact(scan_secrets(docs, text_col=text_col), text_col=text_col, mark=mark)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(F.length(text_col)).cast(docs.schema[chars_col].dataType))
    return out.select(*docs.columns)
