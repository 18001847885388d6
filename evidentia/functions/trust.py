"""Trust, credibility and freshness of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import (
    BLEND_FRESHNESS,
    BLEND_RELEVANCE,
    BLEND_TRUST,
    LOW_TRUST_DOMAINS,
    SPAM_FACTOR,
    SPAM_TLDS,
    TLD_TRUST,
    TRUST_BLOCKED,
    TRUST_LEAST,
    TRUST_LISTED,
    TRUST_MOST,
    TRUST_NEUTRAL,
    TRUSTED_ARABIC_DOMAINS,
    TRUSTED_DOMAINS,
    USER_CONTENT_FACTOR,
    USER_CONTENT_HOSTS,
)
from .text import let
from .urls import parent_domains, registered_domain


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(TRUST_LEAST), F.least(F.lit(TRUST_MOST), x))


def is_listed(domain: Column, listed: Sequence[str]) -> Column:
    """Whether the domain or a parent domain is in a list. For long lists join on the exploded parents instead (operators.trust)."""
    return let(domain, lambda d: F.arrays_overlap(parent_domains(d), F.array(*[F.lit(x) for x in listed]))) if listed else F.lit(False)


def pattern_trust(domain: Column) -> Column:
    """Trust by the first pattern in the domain, times the penalties of spam and user content."""
    base = F.lit(TRUST_NEUTRAL)
    for pattern, weight in reversed(TLD_TRUST):
        base = F.when(F.contains(domain, F.lit(pattern)) | F.endswith(domain, F.lit(pattern.rstrip("."))), F.lit(weight)).otherwise(base)
    spam = F.lit(False)
    for tld in SPAM_TLDS:
        spam = spam | F.endswith(domain, F.lit(tld))
    shared = F.lit(False)
    for host in USER_CONTENT_HOSTS:
        shared = shared | F.contains(domain, F.lit(host))
    return clamp(base * F.when(spam, SPAM_FACTOR).otherwise(1.0) * F.when(shared, USER_CONTENT_FACTOR).otherwise(1.0))


def trust_score(url: Column, *, trusted: Sequence[str] = (*TRUSTED_DOMAINS, *TRUSTED_ARABIC_DOMAINS), blocked: Sequence[str] = LOW_TRUST_DOMAINS) -> Column:
    """0.2 to 3: sources of low trust, then trusted ones, then patterns; neutral without a domain."""
    domain = registered_domain(url)
    score = F.when(is_listed(domain, blocked), F.lit(TRUST_BLOCKED)).when(is_listed(domain, trusted), F.lit(TRUST_LISTED)).otherwise(pattern_trust(domain))
    return F.when(domain == "", F.lit(TRUST_NEUTRAL)).otherwise(score)


def normalised_trust(score: Column) -> Column:
    return clamp(score) / TRUST_MOST


def crawl_boost(score: Column) -> Column:
    return F.least(score / 1.5, F.lit(2.0))


def frontier_priority(relevance: Column, depth: Column, boost: Column) -> Column:
    return relevance / (1 + depth) * boost


def to_seconds(value: Column) -> Column:
    """Epoch seconds of a text: a number, an ISO time (without zone: the session's), or a date in front; null else."""
    number = F.when(value.rlike(r"^\s*-?\d+(\.\d+)?\s*$"), value.try_cast("double"))
    time = F.try_to_timestamp(F.regexp_replace(value, "Z$", "+00:00"))
    date = F.try_to_timestamp(F.substring(value, 1, 10), F.lit("yyyy-MM-dd"))
    return F.coalesce(number, F.unix_micros(time) / 1e6, F.unix_micros(date) / 1e6)


def freshness(seconds: Column, as_of: float | Column, days: float = 365.0) -> Column:
    """exp(-age / days); 0.5 for an unknown date, 1 for a future one."""
    now = F.lit(as_of) if isinstance(as_of, int | float) else as_of
    return F.coalesce(F.exp(-F.greatest((now - seconds) / 86400.0, F.lit(0.0)) / days), F.lit(0.5))


def blended_score(relevance: Column, trust: Column, fresh: Column, title_factor: Column) -> Column:
    return (BLEND_RELEVANCE * relevance + BLEND_TRUST * normalised_trust(trust) + BLEND_FRESHNESS * fresh) * title_factor


def next_allowed(now: Column, delay: Column) -> Column:
    return now + F.greatest(delay, F.lit(1.0))


def alive(expires_at: Column, as_of: float) -> Column:
    return F.lit(as_of) <= expires_at
