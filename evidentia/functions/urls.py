"""URL functions: canonical form, domains, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import NOT_PAGES, TRACKING_PARAMETERS


def resolve(url: Column, base: Column) -> Column:
    """url against base: absolute ones stay, //host, /path, ?query and relative paths are completed, dot segments removed."""
    scheme = F.regexp_extract(base, r"^([^:/?#]+):", 1)
    root = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    joined = (
        F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(F.startswith(url, F.lit("//")), F.concat(scheme, F.lit(":"), url))
        .when(F.startswith(url, F.lit("/")), F.concat(root, url))
        .when(F.startswith(url, F.lit("?")), F.concat(root, path, url))
        .otherwise(F.concat(root, F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", "")), url))
    )
    return F.when(joined.rlike(r"^[^?#]*/\.\.?(/|$|\?|#)"), _without_dots(joined)).otherwise(joined)


def _without_dots(url: Column) -> Column:
    root, path, rest = (F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)([^?#]*)(.*)$", i) for i in (1, 2, 3))
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))  # noqa: E731  the first, empty segment stays
    stack = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda a, s: F.when(s == ".", a).when(s == "..", up(a)).otherwise(F.concat(a, F.array(s))))
    closed = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(root, F.array_join(stack, "/"), closed, rest)


def canonical_url(url: Column, base: Column | None = None) -> Column:
    """The canonical form of a page's URL, or null if it can't be a page: scheme and host in lower case, no default
    port, fragment or tracking parameters, single slashes, parameters sorted and encoded alike."""
    u = F.trim(url)
    full = u if base is None else F.when(u.rlike("^https?://"), u).otherwise(resolve(u, base))
    scheme = F.lower(F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_replace(F.regexp_extract(full, r"^[^:/?#]+://([^/?#]*)", 1), r"^.*@", "")
    host = F.lower(F.regexp_replace(authority, r":\d*$", ""))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    usual = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(full, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), r";[^/]*$", ""), r"/+", "/")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    query = F.regexp_extract(full, r"^[^?#]*\?([^#]*)", 1)
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    encode = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pair = lambda p: F.struct(decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair)
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_PARAMETERS)))
    tail = F.array_join(F.transform(kept, lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"]))), "&")
    out = F.concat(scheme, F.lit("://"), host, F.when(usual, F.lit("")).otherwise(F.concat(F.lit(":"), port)), path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(F.lit("")))
    refused = u.rlike("^(javascript:|mailto:|tel:|data:|#)") | ~scheme.isin("http", "https") | (host == "") | F.lower(path).rlike(rf"\.({'|'.join(NOT_PAGES)})$")
    return F.when((u != "") & ~refused, out)


def fingerprint(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def cache_key(text: Column) -> Column:
    return F.concat(F.lit("emb:"), F.md5(text))


def chunk_id(url: Column, index: Column) -> Column:
    """An id that a rerun gives again, in place of a random one."""
    return F.substring(F.sha2(F.concat_ws("#", url, index.cast("string")), 256), 1, 32)


def host_domain(url: Column) -> Column:
    """The host in lower case without a leading www."""
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1), r"^.*@", ""), r":\d*$", ""))
    return F.regexp_replace(host, r"^www\.", "")


def registered_domain(url: Column) -> Column:
    """The host by splitting, for texts that need not be URLs: lower case, no port, no leading www."""
    after = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"^.*?://", "")).otherwise(url)
    return F.regexp_replace(F.trim(F.lower(F.regexp_extract(after, r"^([^/?#:]*)", 1))), r"^www\.", "")


def evidence_domain(url: Column) -> Column:
    """The third part between slashes without any 'www.'; case and port stay."""
    return F.replace(F.split_part(url, F.lit("/"), F.lit(3)), F.lit("www."), F.lit(""))


def parent_domains(domain: Column) -> Column:
    """The domain and each parent domain of two or more labels."""
    parts = F.split(domain, r"\.")
    many = F.size(parts)
    return F.when(many >= 2, F.transform(F.sequence(F.lit(1), F.greatest(many - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, many), "."))).otherwise(F.array(domain))


def is_http_url(url: Column) -> Column:
    return url.rlike(r"^(?i)https?://[^/?#]+")


def same_domain(a: Column, b: Column) -> Column:
    return host_domain(a) == host_domain(b)
