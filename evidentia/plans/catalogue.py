"""The registered queries of the library, each with the SQL that its result is held against where SQL can express it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import checkpoints
from ..functions import constants as C
from ..functions import text as tx
from ..functions import trust as tr
from ..functions import urls as ur
from ..functions import vectors as ve
from ..operators import boundaries, chunking, content, crawl, evaluation, expansion, html, keyphrases, media, models, ranking, retrieval, store, trust, verdict
from ..sources import fetch, tables
from ..sources.vectors import VectorTable
from ..streaming import incremental
from . import flows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "claim_check"

#: Epoch seconds that stand for now in the queries: 2024-06-01 UTC.
AS_OF = 1717200000.0
LISTS = [("spam-farm.example.org", "blocked"), ("example.net", "trusted")]
POSTS = [(1, "#Covid_19 vaccine #5G #2021 #covid_19 see https://a.b/c @who BREAKING!!! now.."), (2, "no tags here at all"), (3, "#كأس_العالم #Ünïcode_Tag #x")]


#: Queries over made rows, for the tests alone: none of them reads a given table.
MADE: dict[str, Query] = {}
MADE_SQL: dict[str, str] = {}


def made(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        MADE[f.__name__], MADE_SQL[f.__name__] = f, sql
        return f

    return keep


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "pages")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "documents")


def _lists(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LISTS, "domain string, tier string")


# --- URLs and trust -----------------------------------------------------------------------------------

_TRACKING = ", ".join(f"'{p}'" for p in C.TRACKING_PARAMETERS)
_CANONICAL = f"""
    select page_id, url, s || '://' || h || (case when path = '' then '/' else path end) || (case when len(qs) > 0 then '?' || array_to_string(qs, '&') else '' end) as canonical
    from (select page_id, url, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) as s, lower(regexp_extract(u, '^[^:]+://([^/?#]*)', 1)) as h,
                 regexp_replace(regexp_extract(u, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g') as path,
                 list_sort([x for x in string_split(regexp_extract(u, '\\?([^#]*)', 1), '&') if x <> '' and split_part(x, '=', 1) not in ({_TRACKING})]) as qs
          from (select page_id, url, trim(url) as u from pages))"""
_HOST = "regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)), '^www\\.', '')"
_TIER = f"(case when {_HOST} = 'spam-farm.example.org' then 'blocked' when {_HOST} = 'example.net' or {_HOST} like '%.example.net' then 'trusted' end)"
_TRUST = f"(case when {_TIER} = 'blocked' then 0.2 when {_TIER} = 'trusted' then 2.0 when {_HOST} like '%.org%' then 1.3 else 1.0 end)"


@query(f"select page_id, canonical from ({_CANONICAL})")
def url_canonical(spark, sf):
    return _pages(spark, sf).select("page_id", ur.canonical_url(F.col("url")).alias("canonical"))


@query(f"select substr(sha256(canonical), 1, 16) as fingerprint, count(*) as n, min(page_id) as first_page from ({_CANONICAL}) group by canonical")
def url_fingerprint_dedup(spark, sf):
    return _pages(spark, sf).withColumn("fingerprint", ur.fingerprint(ur.canonical_url(F.col("url")))).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


@query(f"select page_id, {_HOST} as host, {_HOST} as registered, replace(split_part(url, '/', 3), 'www.', '') as evidence from pages")
def domain_extract(spark, sf):
    u = F.col("url")
    return _pages(spark, sf).select("page_id", ur.host_domain(u).alias("host"), ur.registered_domain(u).alias("registered"), ur.evidence_domain(u).alias("evidence"))


@query(f"select page_id, {_TRUST}::double as trust, least({_TRUST} / 1.5, 2.0)::double as boost, ({_TRUST} / 3.0)::double as normalised from pages")
def trust_score(spark, sf):
    rated = trust.with_trust(_pages(spark, sf).select("page_id", "url"), "url", _lists(spark))
    return rated.select("page_id", "trust", tr.crawl_boost(F.col("trust")).alias("boost"), tr.normalised_trust(F.col("trust")).alias("normalised"))


@query(f"select page_id, {_TIER} as tier from pages")
def trust_suffix_join(spark, sf):
    return trust.listed_tier(_pages(spark, sf).select("page_id", "url"), "url", _lists(spark)).select("page_id", "tier")


@query(f"select page_id from pages where coalesce({_TIER}, '') <> 'blocked'")
def blocked_filter(spark, sf):
    return trust.drop_blocked(_pages(spark, sf).select("page_id", "url"), "url", _lists(spark)).select("page_id")


@query(f"select page_id, round((page_id % 10) / 10.0 / (1 + page_id % 4) * least({_TRUST} / 1.5, 2.0), 9)::double as priority from pages")
def frontier_priority(spark, sf):
    rated = trust.with_trust(_pages(spark, sf).select("page_id", "url"), "url", _lists(spark))
    links = rated.select("page_id", "url", "trust", (F.col("page_id") % 10 / 10.0).alias("relevance_score"), (F.col("page_id") % 4).alias("depth"))
    return crawl.frontier_rows(links).select("page_id", F.round("priority", 9).alias("priority"))


@query(f"select page_id, {_TRUST}::double as trust from pages order by trust desc, page_id limit 15")
def trusted_first_sort(spark, sf):
    rated = trust.with_trust(_pages(spark, sf).select("page_id", "url", F.col("page_id").alias("pos")), "url", _lists(spark))
    return trust.trusted_first(rated, 10).select("page_id", "trust")


@query(f"select count(*) filter ({_TRUST} >= 2.0) as trusted, count(*) as kept from pages")
def trusted_count(spark, sf):
    return trust.trusted_count(trust.with_trust(_pages(spark, sf).select("page_id", "url"), "url", _lists(spark)))


@made("select (rn - 1) // 25 as batch, 'claim (' || string_agg('site:' || d, ' OR ' order by d) || ')' as query from (select d, row_number() over (order by d) as rn from (select 'd' || lpad((range)::varchar, 3, '0') || '.org' as d from range(60))) group by 1")
def site_queries(spark, sf):
    domains = spark.range(60).select(F.concat(F.lit("d"), F.lpad(F.col("id").cast("string"), 3, "0"), F.lit(".org")).alias("domain"))
    return trust.site_queries(domains, "claim")


@query("select u as url from (select u, min(l * 1000000000 + p) as first from (select page_id % 3 as l, page_id as p, url as u from pages union all select 3, page_id, url from pages) group by u) order by first limit 40")
def discover_seeds(spark, sf):
    """Four result lists that hold all pages, some of them twice."""
    pages = _pages(spark, sf).select("url", F.col("page_id").alias("pos"))
    return ranking.discover([pages.where(f"pos % 3 = {i}") for i in range(3)] + [pages], 40)


# --- Text ---------------------------------------------------------------------------------------------

@query("select doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 15 and regexp_matches(text, '[A-Za-z؀-ۿ]{3,}') as is_claim, regexp_matches(text, '[؀-ۿ]') as arabic from documents")
def claim_gate(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", tx.has_claim(t).alias("is_claim"), tx.has_arabic(t).alias("arabic"))


_CLEAN = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(text, 'https?://\\S+', ' ', 'g'), '@[\\p{L}\\p{M}\\p{N}\\p{Pc}]+', ' ', 'g'), '#', ' '),
    '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s.,!?''"-]', ' ', 'g'), '[!?]{2,}', '. ', 'g'), '\\.{2,}', '. ', 'g'), '\\s+', ' ', 'g'))"""


@query(f"select doc_id, md5({_CLEAN}) as cleaned from documents")
def clean_claim(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(tx.clean_claim(F.col("text"))).alias("cleaned"))


#: Documents whose capitalised words are hash tags.
_TAGGED = "select doc_id, regexp_replace(text, ' ([A-Z])', ' #\\1', 'g') as text from documents"
_HASHTAGS = """[x for x in [trim(lower(replace(y, '_', ' '))) for y in regexp_extract_all(text, '#([\\p{L}\\p{M}\\p{N}\\p{Pc}]{2,})', 1)] if x <> '' and not regexp_matches(x, '^\\p{Nd}+$')]"""


def _distinct(lists: str, most: str = "") -> str:
    """(doc_id, terms): the lists' terms in the order in which they first occur, each once."""
    return f"select d.doc_id, coalesce(terms, []){most} as terms from documents d left join (select doc_id, list(x order by p) as terms from (select doc_id, x, min(p) as p from (select doc_id, unnest(l) as x, generate_subscripts(l, 1) as p from ({lists})) group by doc_id, x) group by doc_id) using (doc_id)"


def _tag(docs):
    return docs.select("doc_id", F.regexp_replace("text", " ([A-Z])", " #$1").alias("text"))


def _tagged(spark, sf):
    return _tag(_docs(spark, sf))


@query(f"select doc_id, md5(array_to_string(terms, '|')) as tags from ({_distinct(f'select doc_id, {_HASHTAGS} as l from ({_TAGGED})')})")
def hashtag_terms(spark, sf):
    return _tagged(spark, sf).select("doc_id", F.md5(F.array_join(tx.hashtags(F.col("text")), "|")).alias("tags"))


_KEYWORDS = "[x for x in [lower(y) for y in regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9\\-]+')] if not regexp_matches(x, '^\\d+$') and (length(x) >= 3 or regexp_matches(x, '[0-9]'))]"
_SHORT = "array_to_string(([w for w in regexp_split_to_array({0}, '\\s+') if w <> ''])[1:8], ' ')"


@query(f"""select doc_id, case when len(terms) > 0 then array_to_string(terms, ' ') else short end as query from
    ({_distinct(f"select doc_id, list_concat({_HASHTAGS}, {_KEYWORDS.format('clean')}) as l from (select doc_id, text, {_CLEAN} as clean from ({_TAGGED}))", "[1:15]")})
    join (select doc_id, {_SHORT.format('clean')} as short from (select doc_id, {_CLEAN} as clean from ({_TAGGED}))) using (doc_id)""")
def search_query(spark, sf):
    return _tagged(spark, sf).select("doc_id", tx.search_query(F.col("text")).alias("query"))


_KEY_WORDS = """with parts as (select doc_id, [x for x in [regexp_extract_all(y, '[\\p{L}\\p{N}]+') for y in regexp_split_to_array(coalesce(text, ''), '[.!?\\n]+')] if len(x) > 0] as s from documents),
      sent as (select doc_id, len(s) as n_sent, unnest(range(len(s))) as i, unnest(s) as w from parts),
      one as (select doc_id, n_sent, i, unnest(range(len(w))) as pos, unnest(w) as form, unnest([lower(x) for x in list_concat([null], w[1:-2])]) as l, unnest([lower(x) for x in list_concat(w[2:], [null])]) as r from sent),
      forms as (select doc_id, lower(form) as word, count(*) as tf, max(n_sent) as n_sent, count(*) filter (length(form) > 1 and upper(form) = form and regexp_matches(form, '\\p{L}')) as acronyms,
        count(*) filter (pos > 0 and regexp_matches(form, '^\\p{Lu}')) as capitals, quantile_cont(i, 0.5) as middle, count(distinct i) as sentences,
        count(distinct l) as lefts, count(l) as n_left, count(distinct r) as rights, count(r) as n_right from one group by doc_id, lower(form)),
      figures as (select *, greatest(acronyms, capitals) / (1 + ln(tf)) as casing, ln(3 + middle) as position, sentences / n_sent as spread,
        tf / coalesce(avg(tf) filter (length(word) > 1) over (partition by doc_id) + stddev_pop(tf) filter (length(word) > 1) over (partition by doc_id), 1.0) as frequency,
        1 + (case when n_left > 0 then lefts / n_left else 0.0 end + case when n_right > 0 then rights / n_right else 0.0 end) * tf / max(tf) over (partition by doc_id) as context from forms),
      scored as (select doc_id, word, round(context * ln(position) / (casing + (frequency + spread) / context), 9) as score from figures where length(word) > 2 and regexp_matches(word, '\\p{L}'))
    select doc_id, word, round(score, 6) as score, rank::int as rank from (select *, row_number() over (partition by doc_id order by score, word) as rank from scored) where rank <= 10"""


@query(_KEY_WORDS)
def key_word_scores(spark, sf):
    """The ten best key words of every document."""
    scored = keyphrases.word_scores(_docs(spark, sf)).withColumn("score", F.round("score", 9))
    return ranking.top_rows(scored, 10, by=["doc_id"], order=[F.asc("score"), F.asc("word")]).select("doc_id", "word", F.round("score", 6).alias("score"), "rank")


@query()
def search_query_key_words(spark, sf):
    """Search queries of all documents: hashtags first, then key words that are no spelling of a better one, then tokens."""
    # Texts are dealt out before any work on them, as a table may be one row group. Where tags alone fill a query, no key word comes into it.
    tagged = _tag(_docs(spark, sf).select("doc_id", "text").repartition("doc_id")).withColumn("tags", tx.hashtags(F.col("text")))
    found = checkpoints.bounded(tagged).withColumn("words", keyphrases.best_words(F.when(F.size("tags") < 15, F.col("text")), 15))
    return found.select("doc_id", tx.search_query(F.col("text"), 15, key_words=F.col("words"), tags=F.col("tags")).alias("query"))


@query("select doc_id, len([w for w in regexp_split_to_array(text, '\\s+') if w <> ''])::int as n, array_to_string(([w for w in regexp_split_to_array(text, '\\s+') if w <> ''])[1:8], ' ') as short from documents")
def token_count(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.token_count(F.col("text")).alias("n"), tx.short_query(F.col("text")).alias("short"))


@query("select doc_id, len(string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)))::int as n from documents")
def sentence_split(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(F.split("text", r"(?<=[.!?])\s+(?=[A-Z])")).alias("n"))


_TOKENS = r"""with t as (select doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[ \t\n\f\r]+') if x <> ''] as w from documents),
      c as (select regexp_replace(regexp_replace(unnest(w), '^["''(\[{«“‘]+', ''), '["'')\]}»”’,;:]+$', '') as core from t),
      s as (select regexp_matches(core, '[^.]\.$') as dot, lower(case when regexp_matches(core, '[^.]\.$') then regexp_replace(core, '\.$', '') else core end) as bare from c),
      k as (select case when regexp_matches(bare, '^[0-9.,]*[0-9]$') then '##' else bare end as type, count(*) filter (dot) as w, count(*) filter (not dot) as o from s group by 1),
      n as (select sum(w)::double / sum(w + o) as p from k),
      r as (select type, w, o, length(replace(type, '.', ''))::double as letters, length(type) - length(replace(type, '.', '')) as inside,
        2 * (w * ln(0.99) + o * ln(0.01) - w * ln(p) - o * ln(1 - p)) as ratio from k, n where w > 0 and regexp_matches(type, '\p{L}'))
    select type, w::bigint as with_dot, o::bigint as without_dot, round(ratio * exp(-letters) * (inside + 1) * pow(letters, -o), 6)::double + 0.0 as score from r"""


@query(_TOKENS)
def abbreviation_scores(spark, sf):
    """How much each word of the documents is an abbreviation by the company it keeps with periods."""
    pairs = checkpoints.kept(boundaries.occurrences(_docs(spark, sf)))
    sums = pairs.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("dot"), F.col("n"))).alias("d")).first()
    scores = boundaries.abbreviation_scores(pairs, sums.n or 0, sums.d or 0)
    return scores.select("type", "with_dot", "without_dot", (F.round("score", 6) + 0.0).alias("score"))


@query()
def learned_sentences(spark, sf):
    """Sentences of all documents by boundaries learned from all documents."""
    docs = _docs(spark, sf)
    found = boundaries.split(docs, boundaries.learn(docs))
    return found.select("doc_id", "pos", F.md5("sentence").alias("sentence"))


@query("""select doc_id, s::int as start_char, e::int as end_char, (row_number() over (partition by doc_id order by s) - 1)::int as chunk_index, md5(t) as chunk
    from (select doc_id, s, least(s + 512, length(text)) as e, trim(substr(text, s + 1, 512), chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) as t
          from (select doc_id, text, unnest(range(0, length(text), 448)) as s from documents)) where length(t) >= 100""")
def chunk_fixed(spark, sf):
    return chunking.chunk_fixed(_docs(spark, sf), keep=["doc_id"]).select("doc_id", "start_char", "end_char", "chunk_index", F.md5("text").alias("chunk"))


def _packs(most: int, overlap: int, least: int, longer: int, table: str = "documents") -> str:
    """(doc_id, text, chunk_index) of packed sentences: a pack opens at sentence ``first`` and is closed by the sentence that no longer fits."""
    return f"""with recursive parts as (select doc_id, [y for y in [trim(x) for x in string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))] if length(y) > {longer}] as s from {table}),
      one as (select doc_id, i, s[i] as t, len([w for w in regexp_split_to_array(s[i], '\\s+') if w <> '']) as n from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from parts)),
      totals as (select doc_id, i, sum(n) over (partition by doc_id order by i) as upto from one),
      walk(doc_id, i, first, closed) as (select doc_id, 1::bigint, 1::bigint, null::bigint from parts where len(s) > 0
        union all select w.doc_id, w.i + 1, case when over then greatest(w.first, w.i + 1 - {overlap}) else w.first end, case when over then w.first end from
          (select w.*, t.upto - coalesce(b.upto, 0) > {most} as over from walk w join totals t on t.doc_id = w.doc_id and t.i = w.i + 1 left join totals b on b.doc_id = w.doc_id and b.i = w.first - 1) w),
      ends as (select doc_id, closed as a, i - 1 as b from walk where closed is not null union all select doc_id, first, i from walk join (select doc_id, len(s) as n from parts) using (doc_id) where i = n),
      joined as (select e.doc_id, b, regexp_replace(array_to_string(s[a:b], ' '), '^\\s+|\\s+$', '', 'g') as t from ends e join parts using (doc_id))
    select doc_id, t as text, (row_number() over (partition by doc_id order by b) - 1)::int as chunk_index from joined where length(t) >= {least}"""


_WORDS = "len([w for w in regexp_split_to_array(text, '\\s+') if w <> ''])::int"


@query(f"select doc_id, md5(text) as chunk, chunk_index, {_WORDS} as token_count from ({_packs(512, 3, 100, 0)})")
def chunk_sentence(spark, sf):
    return chunking.chunk_sentences(_docs(spark, sf), keep=["doc_id"]).select("doc_id", F.md5("text").alias("chunk"), "chunk_index", "token_count")


@query(f"""select doc_id, md5(text) as chunk, chunk_index from ({_packs(120, 1, 61, 20)}) union all
    select doc_id, md5(t), (row_number() over (partition by doc_id order by s) - 1)::int from
      (select doc_id, s, trim(substr(text, s + 1, 480), chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) as t from
        (select doc_id, text, unnest(range(0, length(text), 480)) as s from documents where len([y for y in [trim(x) for x in string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))] if length(y) > 20]) = 0)) where length(t) >= 81""")
def chunk_claims(spark, sf):
    return chunking.chunk_claims(_docs(spark, sf), keep=["doc_id"]).select("doc_id", F.md5("text").alias("chunk"), "chunk_index")


_SEMANTIC = """with recursive parts as (select doc_id, [y for y in [trim(x) for x in string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))] if y <> ''] as s from documents),
      one as (select doc_id, i, [w for w in regexp_split_to_array(lower(s[i]), '\\s+') if w <> ''] as w from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from parts)),
      slots as (select doc_id, i, ('0x' || substr(h, 1, 2))::int % 64 as slot, sum(case when ('0x' || substr(h, 15, 2))::int >= 128 then 1 else -1 end)::double as v from (select doc_id, i, md5(unnest(w)) as h from one) group by all),
      norms as (select doc_id, i, sqrt(sum(v * v)) as m from slots group by all),
      dots as (select b.doc_id, b.i, sum(a.v * b.v) as d from slots a join slots b on a.doc_id = b.doc_id and a.slot = b.slot and b.i = a.i + 1 group by all),
      steps as (select o.doc_id, o.i, sum(len(w)) over (partition by o.doc_id order by o.i) as upto, coalesce(d, 0) / ((coalesce(n.m, 0) + 1e-9) * (coalesce(p.m, 0) + 1e-9)) >= 0.75 as near
        from one o left join dots using (doc_id, i) left join norms n on n.doc_id = o.doc_id and n.i = o.i left join norms p on p.doc_id = o.doc_id and p.i = o.i - 1),
      walk(doc_id, i, first, closed) as (select doc_id, 1::bigint, 1::bigint, null::bigint from parts where len(s) > 0
        union all select doc_id, i + 1, case when over then i + 1 else first end, case when over then first end from
          (select w.*, not t.near or t.upto - coalesce(b.upto, 0) > 512 as over from walk w join steps t on t.doc_id = w.doc_id and t.i = w.i + 1 left join steps b on b.doc_id = w.doc_id and b.i = w.first - 1)),
      ends as (select doc_id, closed as a, i - 1 as b from walk where closed is not null union all select doc_id, first, i from walk join (select doc_id, len(s) as n from parts) using (doc_id) where i = n),
      joined as (select doc_id, a, array_to_string(s[a:b], ' ') as text from ends join parts using (doc_id))
    select doc_id, text, (row_number() over (partition by doc_id order by a) - 1)::int as chunk_index from joined where length(text) >= 100"""


@query(f"select doc_id, md5(text) as chunk, chunk_index, {_WORDS} as token_count from ({_SEMANTIC})")
def chunk_semantic(spark, sf):
    return chunking.chunk_semantic(_docs(spark, sf), models.hashed_embedding, keep=["doc_id"]).select("doc_id", F.md5("text").alias("chunk"), "chunk_index", "token_count")


@query("""select doc_id, count(distinct g)::int as n from (
      select doc_id, unnest(case when len(w) < 4 then w else [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] end) as g
      from (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as w from documents)) group by doc_id""")
def shingles(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(tx.word_shingles(F.col("text"))).alias("n")).where("n > 0")


_CLICK = " or ".join("contains(lower(t), '" + p.replace("'", "''") + "')" for p in C.CLICKBAIT_PHRASES)


_FACTOR = f"""(case when {_CLICK} then 0.5 else 1.0 end) * (case when l > 0 and c / greatest(l, 1) > 0.5 then 0.7 else 1.0 end)
      * (case when length(t) - length(replace(t, '!', '')) >= 2 or length(t) - length(replace(t, '?', '')) >= 2 then 0.8 else 1.0 end)"""
_LETTERS = "length(regexp_replace(t, '[^\\p{L}]', '', 'g')) as l, length(regexp_replace(t, '[^\\p{Lu}]', '', 'g')) as c"


@query(f"select doc_id, round({_FACTOR}, 6)::double as factor from (select doc_id, t, {_LETTERS} from (select doc_id, text as t from documents))")
def clickbait(spark, sf):
    return _docs(spark, sf).select("doc_id", F.round(tx.clickbait_factor(F.col("text")), 6).alias("factor"))


@query("select doc_id, md5(case when length(t) <= 300 then t else regexp_replace(substr(t, 1, 300), ' [^ ]*$', '') || '…' end) as snippet from (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from documents)")
def snippets(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(tx.snippet(F.col("text"), 300)).alias("snippet"))


@query("select o_orderkey, round(exp(-greatest((1717200000.0 - epoch(o_orderdate)) / 86400.0, 0.0) / 365.0), 9) as fresh from orders")
def freshness(spark, sf):
    orders = tables.table(spark, sf, "orders")
    return orders.select("o_orderkey", F.round(tr.freshness(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6, AS_OF), 9).alias("fresh"))


@query("""select event_id, case event_id % 4 when 0 then epoch(ts) when 1 then epoch(date_trunc('second', ts)) when 2 then epoch(date_trunc('day', ts)) end::double as seconds from events""")
def parse_dates(spark, sf):
    """The times of all events as epoch seconds, ISO times, dates with words behind them, and words."""
    ts = F.col("ts").cast("timestamp")
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.format_string("%.6f", F.unix_micros(ts) / 1e6)).when(kind == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == 2, F.date_format(ts, "yyyy-MM-dd 'at noon'")).otherwise("soon")
    return tables.table(spark, sf, "events").select("event_id", tr.to_seconds(text).alias("seconds"))


@query("select page_id, round(least(n / 3.0 + 0.05, 1.0), 9)::double as score from (select page_id, len(list_intersect(list_distinct(regexp_extract_all(lower(html), '\\b[a-z]{3,}\\b')), ['the', 'and', 'zebra'])) as n from pages)")
def link_keyword_score(spark, sf):
    terms = F.array(F.lit("the"), F.lit("and"), F.lit("zebra"))
    return _pages(spark, sf).select("page_id", F.round(tx.keyword_overlap(F.col("html"), terms), 9).alias("score"))


@query("select doc_id, substr(sha256(text), 1, 32) as content_hash, 'emb:' || md5(text) as cache_key, substr(sha256(source || '#' || doc_id), 1, 32) as chunk_id from documents")
def text_hashes(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", ur.content_hash(t).alias("content_hash"), ur.cache_key(t).alias("cache_key"), ur.chunk_id(F.col("source"), F.col("doc_id")).alias("chunk_id"))


@query(f"select doc_id, md5(array_to_string(terms, '|')) as terms from ({_distinct("select doc_id, [x for x in regexp_split_to_array(lower(text), '\\s+') if length(x) > 2] as l from documents")})")
def query_terms(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(F.array_join(tx.query_terms(F.col("text")), "|")).alias("terms"))


@query(f"select doc_id, md5(array_to_string(terms, '|')) as terms from ({_distinct(f"select doc_id, {_KEYWORDS.format('text')} as l from documents")})")
def keyword_tokens(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(F.array_join(tx.keyword_tokens(F.col("text")), "|")).alias("terms"))


@query("select doc_id, md5(nullif(trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s\\-'']', ' ', 'g'), '\\s{2,}', ' ', 'g')), '')) as normalised from documents")
def query_normalise(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(tx.normalise_query(F.col("text"))).alias("normalised"))


@query("""select item_id, coalesce(array_to_string((list(syn order by p, syn))[1:3], '|'), '') as expanded from benchmark left join (select item_id, syn, min(p) as p from
      (select item_id, unnest(w) as x, generate_subscripts(w, 1) as p from (select item_id, [y for y in regexp_split_to_array(lower(text), '\\s+') if length(y) > 2] as w from benchmark))
      join (values ('the', 'article'), ('and', 'with'), ('and', 'plus'), ('for', 'with'), ('that', 'which'), ('der', 'article'), ('les', 'article')) s(term, syn) on x = term group by item_id, syn) using (item_id) group by item_id""")
def synonym_expansion(spark, sf):
    asked = tables.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("query"))
    synonyms = spark.createDataFrame([("the", "article"), ("and", "with"), ("and", "plus"), ("for", "with"), ("that", "which"), ("der", "article"), ("les", "article")], "term string, synonym string")
    return expansion.expand_by_synonyms(asked, synonyms, most=3).select("item_id", F.array_join("expanded_terms", "|").alias("expanded"))


# --- HTML ---------------------------------------------------------------------------------------------

@query("""select page_id, (i - 1)::int as pos, hrefs[i] as href from (select page_id, hrefs, unnest(range(1, len(hrefs) + 1)) as i from (select page_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) as hrefs from pages))""")
def html_links(spark, sf):
    return html.href_links(_pages(spark, sf)).select("page_id", "pos", "href")


@query()
def html_link_scores(spark, sf):
    return html.extract_links(_pages(spark, sf), ["the", "and"], threshold=0.0)


def _content() -> str:
    """(page_id, url, title, text, published_date): what the parser reads, by pattern."""
    def unescaped(x: str) -> str:
        for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&nbsp;", " "), ("&amp;", "&")):
            x = f"replace({x}, '{code}', '{char}')"
        return x

    squeezed = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    body = "regexp_replace(html, '<!--.*?-->', '', 'gs')"
    for tag in (*sorted(html.SKIPPED), "title"):
        body = f"regexp_replace({body}, '<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'gis')"
    body = f"regexp_replace({body}, '<br\\b[^>]*>', chr(10), 'gi')"
    body = f"regexp_replace({body}, '</?({'|'.join(sorted(html.CONTENT))})(\\s[^>]*)?/?>', chr(1), 'gi')"
    body = f"regexp_replace({body}, '<[/!a-zA-Z][^>]*>', '', 'g')"
    title = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"
    return f"""select page_id, url, title, array_to_string(case when len([x for x in l if length(x) > {html.BLOCK_LEAST}]) > 0 then [x for x in l if length(x) > {html.BLOCK_LEAST}] else l end, chr(10)) as text, published_date from
      (select page_id, url, [y for y in [{squeezed('x')} for x in string_split({unescaped(body)}, chr(1))] if y <> ''] as l, {squeezed(unescaped(title))} as title,
         coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]*(?:property|name)="(?:article:published_time|date|datepublished|pubdate)"[^>]*content="([^"]*)"', 1), ''), regexp_extract(html, '(?i)<time[^>]*datetime="([^"]*)"', 1)) as published_date from pages)"""


@query(f"select page_id, url, title, text, published_date, 'en' as lang, len([w for w in regexp_split_to_array(text, '\\s+') if w <> ''])::int as word_count, length(trim(text)) < 100 as is_empty from ({_content()})")
def html_content(spark, sf):
    return html.extract_content(_pages(spark, sf), keep=["page_id", "url"])


@query()
def page_main_content(spark, sf):
    """The main content of all pages and the method that found it."""
    return content.main_content(_pages(spark, sf)).select("page_id", "title", "extraction_method", "word_count", "published_date", F.md5("text").alias("text"))


# --- Retrieval and ranking ----------------------------------------------------------------------------

def _vectors(spark, sf):
    return tables.table(spark, sf, "embeddings")


def _knn(spark, sf, k, where=None):
    vectors = _vectors(spark, sf)
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))
    return asked, ranking.nearest(asked, vectors, k, where=where)


_SCORES = "select q.vec_id as query_id, v.vec_id, q.label as query_label, v.label, list_dot_product(q.embedding::double[], v.embedding::double[]) as score from embeddings q, embeddings v where q.vec_id % 20 = 0"
_KNN = f"select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from ({_SCORES})"


@query(f"select query_id, vec_id, round(score, 6) as score, rank::int as rank from ({_KNN}) where rank <= 10")
def knn_topk(spark, sf):
    return _knn(spark, sf, 10)[1].select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query()
def knn_by_lists(spark, sf):
    """The same search over a vector store of inverted lists. A fifth of the vectors is added after the lists were made. Approximate: a test holds its recall."""
    vectors = tables.table(spark, sf, "embeddings")
    rows = vectors.select(F.col("vec_id").cast("string").alias("id"), F.lit("").alias("text"), "embedding", F.create_map().cast("map<string,string>").alias("metadata"))
    late = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    store = VectorTable(spark, f"{checkpoints.folder(spark)}/vectors-{uuid.uuid4().hex}")
    store.add(rows.where(~late))
    store.index(16)
    store.add(rows.where(late))
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return store.search(asked, 10, approximate=True).select("query_id", F.col("id").cast("long").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query(f"select query_id, vec_id, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from ({_SCORES} and v.label = 3)) where rank <= 5")
def knn_filtered(spark, sf):
    return _knn(spark, sf, 5, F.col("label") == 3)[1].select("query_id", "vec_id", "rank")


@query("select source, lang, doc_id, n_chars from (select *, row_number() over (partition by source, lang order by n_chars desc, doc_id) as r from documents) where r = 1")
def max_per_url(spark, sf):
    return ranking.best_per_url(_docs(spark, sf).select("source", "lang", "doc_id", "n_chars"), by=["source", "lang"], score_col="n_chars", tie_col="doc_id")


@query("select source, doc_id from (select *, row_number() over (partition by source order by n_chars desc, doc_id) as r from documents) where r <= 3")
def cap_per_domain(spark, sf):
    return ranking.cap_per_domain(_docs(spark, sf), 3, by=["source"], order=[F.desc("n_chars"), F.asc("doc_id")]).select("source", "doc_id")


@query("select source, lang, doc_id, r::int as rank from (select *, row_number() over (partition by source, lang order by n_chars desc, doc_id) as r from documents) where r <= 2")
def top2_per_page(spark, sf):
    return ranking.top_rows(_docs(spark, sf), 2, by=["source", "lang"], order=[F.desc("n_chars"), F.asc("doc_id")]).select("source", "lang", "doc_id", "rank")


_SHINGLES = "list_distinct(case when len(w) < 4 then w else [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] end)"


@query(f"""with recursive found as (select query_id, vec_id, score from ({_KNN}) where rank <= 30),
      r as (select query_id, vec_id, source, {_SHINGLES} as g, row_number() over (partition by query_id, source order by score desc, vec_id) as k from
        (select query_id, vec_id, score, source, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') as w from found join documents on doc_id = vec_id)),
      fold(query_id, source, k, vec_id, stay, seen) as (select query_id, source, k, vec_id, true, g from r where k = 1
        union all select query_id, source, k, vec_id, stay, case when stay then list_distinct(list_concat(seen, g)) else seen end from
          (select r.*, seen, len(list_intersect(g, seen)) / greatest(1, len(g)) <= {C.NEAR_DUPLICATE} as stay from fold f join r on r.query_id = f.query_id and r.source = f.source and r.k = f.k + 1))
    select query_id, vec_id, source from fold where stay""")
def near_dup(spark, sf):
    """Of each query's 30 nearest documents those that repeat a better one of their source go."""
    found = _knn(spark, sf, 30)[1].join(_docs(spark, sf).select(F.col("doc_id").alias("vec_id"), "source", "text"), "vec_id")
    return ranking.near_duplicate_filter(found, by=["query_id", "source"], tie_col="vec_id").select("query_id", "vec_id", "source")


@query(f"""select page_id, round((0.5 * ((page_id % 100) / 100.0) + 0.3 * ({_TRUST} / 3.0) + 0.2 * exp(-greatest(page_id % 900, 0) / 365.0)), 6)::double as score from pages order by 2 desc, 1 limit 10""")
def blend_rank(spark, sf):
    rated = trust.with_trust(_pages(spark, sf).select("page_id", "url"), "url", _lists(spark))
    score = tr.blended_score(F.col("page_id") % 100 / 100.0, F.col("trust"), tr.freshness(F.lit(AS_OF) - F.col("page_id") % 900 * 86400.0, AS_OF), F.lit(1.0))
    return rated.select("page_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "page_id").limit(10)


@query("select vec_id, round(0.6 * e + 0.4 / (1 + exp(-(label - 5)::double)), 4) as fused from (select vec_id, label, embedding[1]::double as e from embeddings)")
def fusion(spark, sf):
    return _vectors(spark, sf).select("vec_id", ve.fused_score(F.get("embedding", F.lit(0)).cast("double"), (F.col("label") - 5).cast("double"), F.lit(2)).alias("fused"))


@query("""select vec_id, round(n, 6) as norm, round(exp(embedding[1]) / (exp(embedding[1]) + exp(embedding[2]) + exp(embedding[3])), 6) as p, (list_position(embedding[1:3], list_max(embedding[1:3])) - 1)::int as best
    from (select vec_id, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n, embedding::double[] as embedding from embeddings)""")
def vector_functions(spark, sf):
    few = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    return _vectors(spark, sf).select("vec_id", F.round(ve.norm(F.col("embedding")), 6).alias("norm"), F.round(F.get(ve.softmax(few), F.lit(0)), 6).alias("p"), ve.argmax(few).alias("best"))


@query("""with e as (select a.vec_id, [0.8 * a.embedding[i]::double + 0.2 * ((b.embedding[i]::double + c.embedding[i]::double) / 2) for i in range(1, 65)] as m
      from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 join embeddings c on c.vec_id = a.vec_id + 2)
    select vec_id, round(m[1] / (sqrt(list_dot_product(m, m)) + 1e-9), 6) as first, round(sqrt(list_dot_product(m, m)), 6) as len from e""")
def query_centroid(spark, sf):
    v = _vectors(spark, sf).select("vec_id", "embedding")
    near = lambda i: v.select((F.col("vec_id") - i).alias("vec_id"), F.col("embedding").alias(f"e{i}"))
    rows = v.join(near(1), "vec_id").join(near(2), "vec_id")
    full = ve.weighted_centroid(F.col("embedding"), F.array("e1", "e2"))
    mixed = F.transform(F.col("embedding"), lambda x, i: 0.8 * x.cast("double") + 0.2 * ((F.get("e1", i).cast("double") + F.get("e2", i).cast("double")) / 2))
    return rows.select("vec_id", F.round(F.get(full, F.lit(0)), 6).alias("first"), F.round(ve.norm(mixed), 6).alias("len"))


# --- Verdicts -----------------------------------------------------------------------------------------

_EVIDENCE = """select doc_id % 50 as claim_id, doc_id, 'https://www.' || source || '.org/' || doc_id as url, 0.3 + (doc_id % 70) / 100.0 as w, case when doc_id % 5 = 0 then 2.0 else 1.3 end as cred,
      case when quality = 1 then 0.7 else 0.1 end as ps, case when toxic = 1 then 0.9 when quality = 0 then 0.6 else 0.1 end as pr, 0.2 as pn,
      case when toxic = 1 then 'REFUTES' when quality = 1 then 'SUPPORTS' else 'REFUTES' end as label
    from labels join documents using (doc_id)"""
_SHARES = f"""select claim_id, sum(ps * w * cred) / sum((ps + pr + pn) * w * cred) as s, sum(pr * w * cred) / sum((ps + pr + pn) * w * cred) as r, sum(pn * w * cred) / sum((ps + pr + pn) * w * cred) as n, max(pr) as top from ({_EVIDENCE}) group by claim_id"""
_VERDICT = f"""select claim_id, case when top >= 0.85 and r >= 0.35 then 'REFUTES' when s >= 0.55 then 'SUPPORTS' when r >= 0.55 then 'REFUTES' else 'NOT ENOUGH INFO' end as verdict,
      case when top >= 0.85 and r >= 0.35 then top when s >= 0.55 then s when r >= 0.55 then r else greatest(s, r) end as confidence, s, r, n from ({_SHARES})"""


def _evidence(spark, sf):
    labels = tables.table(spark, sf, "labels")
    rows = labels.join(_docs(spark, sf).select("doc_id", "source"), "doc_id")
    return rows.select(
        (F.col("doc_id") % 50).alias("claim_id"),
        "doc_id",
        F.concat(F.lit("https://www."), "source", F.lit(".org/"), F.col("doc_id").cast("string")).alias("url"),
        (0.3 + F.col("doc_id") % 70 / 100.0).alias("retrieval_score"),
        F.when(F.col("doc_id") % 5 == 0, 2.0).otherwise(1.3).alias("credibility"),
        F.when(F.col("quality") == 1, 0.7).otherwise(0.1).alias("p_supports"),
        F.when(F.col("toxic") == 1, 0.9).when(F.col("quality") == 0, 0.6).otherwise(0.1).alias("p_refutes"),
        F.lit(0.2).alias("p_no_info"),
        F.when(F.col("toxic") == 1, C.REFUTES).when(F.col("quality") == 1, C.SUPPORTS).otherwise(C.REFUTES).alias("label"),
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("text "), F.col("doc_id").cast("string")).alias("text"),
    )


@query(f"select claim_id, verdict, round(confidence, 6)::double as confidence, round(s, 6)::double as supports, round(r, 6)::double as refutes, round(n, 6)::double as no_info from ({_VERDICT})")
def claim_verdict(spark, sf):
    return verdict.claim_verdicts(_evidence(spark, sf)).select("claim_id", "verdict", *[F.round(c, 6).alias(c) for c in ("confidence", "supports", "refutes", "no_info")])


@query(f"""with e as (select * from ({_EVIDENCE}) join (select claim_id, verdict from ({_VERDICT})) using (claim_id)),
      d as (select claim_id, verdict, replace(split_part(url, '/', 3), 'www.', '') as dom, bool_or(label = verdict) as a, bool_or(label = verdict and cred >= 2) as ta, bool_or(label <> verdict and verdict <> 'NOT ENOUGH INFO' and cred >= 2) as tc from e group by all),
      c as (select claim_id, verdict, (count(*) filter (a))::int as n, coalesce(list(dom order by dom) filter (ta), []) as ta, coalesce(list(dom order by dom) filter (tc), []) as tc from d group by all)
    select claim_id, verdict in ('SUPPORTS', 'REFUTES') and n >= 2 and len(ta) > 0 and len(tc) = 0 as verified, n as independent_sources, array_to_string(ta, ',') as trusted_agree, array_to_string(tc, ',') as trusted_contradict,
      case when verdict = 'NOT ENOUGH INFO' then 'Not enough reliable evidence to verify this claim.' when n >= 2 and len(ta) > 0 and len(tc) = 0 then verdict || ' — ' || n || ' independent sources agree (' || len(ta) || ' trusted).'
        when n >= 1 and len(ta) = 0 then 'Leans ' || verdict || ', but only low-authority sources agree (' || n || '). Treat with caution.' when len(tc) > 0 then 'Conflicting evidence: ' || verdict || ' disputed by ' || len(tc) || ' trusted source(s).'
        else 'Leans ' || verdict || ' (' || n || ' source(s)) — weak support.' end as statement from c""")
def verify_sources(spark, sf):
    rows = _evidence(spark, sf)
    out = verdict.verify_sources(rows, verdict.claim_verdicts(rows))
    return out.withColumns({c: F.array_join(c, ",") for c in ("trusted_agree", "trusted_contradict")})


@query(f"""select claim_id, doc_id from (select *, row_number() over (partition by claim_id order by doc_id) as r from (select e.*, case when label = verdict then 0 else 1 end as o, min(case when label = verdict then 0 else 1 end) over (partition by claim_id) as least_o
      from ({_EVIDENCE}) e join (select claim_id, verdict from ({_VERDICT})) using (claim_id)) where o = least_o) where r <= 5""")
def explanation_input(spark, sf):
    rows = _evidence(spark, sf)
    return verdict.explanation_input(rows, verdict.claim_verdicts(rows)).select("claim_id", "doc_id")


@query(f"""select claim_id, verdict as final_prediction, round(confidence, 4)::double as confidence, urls, n::int as shown, independent_sources from
    (select claim_id, verdict, confidence from ({_VERDICT})) join
    (select claim_id, string_agg(url, ' ' order by w desc, url) as urls, count(*) as n from (select *, row_number() over (partition by claim_id order by w desc, url) as k from ({_EVIDENCE})) where k <= 10 group by claim_id) using (claim_id) join
    (select claim_id, (count(distinct dom) filter (label = verdict))::int as independent_sources from (select e.claim_id, label, verdict, replace(split_part(url, '/', 3), 'www.', '') as dom from ({_EVIDENCE}) e join (select claim_id, verdict from ({_VERDICT})) using (claim_id)) group by claim_id) using (claim_id)""")
def result_envelope(spark, sf):
    """The JSON documents, read back."""
    rows = _evidence(spark, sf)
    verdicts = verdict.claim_verdicts(rows)
    out = verdict.result_envelope(verdicts, verdict.verify_sources(rows, verdicts), rows)
    form = "final_prediction string, confidence double, evidence array<struct<url: string, retrieval_score: double>>, verification struct<verified: boolean, independent_sources: int>"
    got = out.select("claim_id", F.from_json("result", form).alias("r"))
    return got.select("claim_id", "r.final_prediction", "r.confidence", F.array_join(F.col("r.evidence.url"), " ").alias("urls"), F.size("r.evidence").alias("shown"), "r.verification.independent_sources")


@query("select count(*) as total, count(*) filter (quality = toxic) as passed, count(*) filter (quality <> toxic) as failed from labels")
def battery_tally(spark, sf):
    return verdict.battery_tally(tables.table(spark, sf, "labels").select(F.col("quality").alias("expected"), F.col("toxic").alias("actual")))


@query("""select label as video_id, round(avg((vec_id % 100) / 100.0), 6)::double as avg_real, round(avg(1 - (vec_id % 100) / 100.0), 6)::double as avg_fake, count(*) as n,
      case when avg((vec_id % 100) / 100.0) > avg(1 - (vec_id % 100) / 100.0) then 'REAL' else 'FAKE' end as verdict from embeddings group by label""")
def video_mean(spark, sf):
    frames = _vectors(spark, sf).select(F.col("label").alias("video_id"), (F.col("vec_id") % 100 / 100.0).alias("p_real"), (1 - F.col("vec_id") % 100 / 100.0).alias("p_fake"))
    return verdict.video_verdicts(frames).withColumns({c: F.round(c, 6) for c in ("avg_real", "avg_fake")})


@query("""select post_id, f as fake_image, t as refuted_text, case when f and t then 'FAKE' when f then 'FAKE IMAGE' when t then 'MISLEADING TEXT' else 'AUTHENTIC' end as verdict, 0.85::double as confidence
    from (select doc_id % 100 as post_id, bool_or(quality = 0) as f, bool_or(toxic = 1) as t from labels group by 1)""")
def post_verdict(spark, sf):
    labels = tables.table(spark, sf, "labels")
    return verdict.post_verdicts(labels.select((F.col("doc_id") % 100).alias("post_id"), (F.col("quality") == 0).alias("fake_image"), (F.col("toxic") == 1).alias("refuted_text")))


# --- Evaluation ---------------------------------------------------------------------------------------

_METRICS = f"""with r as (select query_id, vec_id, rank, (label = query_label)::int as hit from ({_KNN}) where rank <= 30),
      rel as (select q.vec_id as query_id, count(*) as n from embeddings q join embeddings v on q.label = v.label where q.vec_id % 20 = 0 group by 1),
      c as (select *, sum(hit) over (partition by query_id order by rank) as c from r)
    select query_id, sum(case when rank <= 10 then hit else 0 end) / 10.0 as p, sum(case when rank <= 10 then hit else 0 end) / any_value(n) as rc, sum(case when hit = 1 then c / rank else 0 end) / any_value(n) as ap,
      sum(case when rank <= 10 and hit = 1 then 1 / log2(rank + 1) else 0 end) / list_sum([1 / log2(i + 1) for i in range(1, least(any_value(n), 10) + 1)]) as nd, coalesce(1.0 / min(case when hit = 1 then rank end), 0) as rr
    from c join rel using (query_id) group by query_id"""


def _metrics(spark, sf):
    """Items of the query's label are relevant: marked by the label, counted by label."""
    asked, found = _knn(spark, sf, 30)
    vectors = _vectors(spark, sf)
    marked = found.join(vectors.select("vec_id", "label"), "vec_id").join(asked.select("query_id", "query_label"), "query_id").withColumn("hit", (F.col("label") == F.col("query_label")).cast("int"))
    sizes = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n_relevant"))
    relevant = asked.join(sizes, F.col("query_label") == F.col("label")).select("query_id", "n_relevant")
    return evaluation.metrics_of_hits(marked, relevant, 10)


@query(f"select query_id, round(p, 6)::double as precision_at_k, round(rc, 6)::double as recall_at_k, round(ap, 6)::double as average_precision, round(nd, 6)::double as ndcg_at_k, round(rr, 6)::double as reciprocal_rank from ({_METRICS})")
def retrieval_metrics(spark, sf):
    out = _metrics(spark, sf)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(f"select count(*) as n_queries, round(avg(p), 6)::double as mean_precision, round(avg(rc), 6)::double as mean_recall, round(avg(ap), 6)::double as map, round(avg(nd), 6)::double as mean_ndcg, round(avg(rr), 6)::double as mrr from ({_METRICS})")
def map_mrr(spark, sf):
    out = evaluation.mean_metrics(_metrics(spark, sf))
    return out.select("n_queries", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


# --- Stores, frontier, caches -------------------------------------------------------------------------

@query("select distinct source, substr(sha256(text), 1, 32) as h from documents d where not exists (select 1 from documents s where s.doc_id % 3 = 0 and s.source = d.source and sha256(s.text) = sha256(d.text))")
def incremental_index(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "source", "text")
    stored = docs.where("doc_id % 3 = 0").select(F.col("source").alias("url"), ur.content_hash(F.col("text")).alias("content_hash"), F.lit(True).alias("indexed"))
    return store.to_index(docs, stored, url_col="source").select("source", F.col("content_hash").alias("h"))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def metadata_upsert_latest(spark, sf):
    events = tables.table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    stored = store.latest(events.where("event_id % 2 = 0"), ["user_id"], ["ts", "event_id"])
    newer = events.join(stored.select("user_id", F.col("ts").alias("t"), F.col("event_id").alias("e")), "user_id", "left").where("t is null or struct(ts, event_id) > struct(t, e)").drop("t", "e")
    return store.upsert(stored, newer, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("select page_id, url from (select page_id, url, regexp_replace(url, '^[^:]+://[^/?#]*', '') as path from pages) where path not like '/de/1%' and (path not like '/fr%' or path like '/fr/8%')")
def robots_allowed(spark, sf):
    """The pages' own URLs against the rules of their hosts, by the longest one that matches."""
    pages = _pages(spark, sf).select("page_id", "url", F.lower(F.regexp_extract("url", "^[^:]+://([^/?#]*)", 1)).alias("domain"))
    rules = fetch.robots_rules(pages.select("domain").distinct().withColumn("text", F.lit("User-agent: *\nDisallow: /fr\nAllow: /fr/8\nDisallow: /de/1")))
    return fetch.allowed_by_robots(pages, rules).select("page_id", "url")


@query("select count(*) as pages, count(*) filter (quality = 1) as indexed, count(*) filter (toxic = 1) as failed, avg(doc_id % 5)::double as mean_depth from labels")
def store_counters(spark, sf):
    labels = tables.table(spark, sf, "labels")
    return store.counters(labels.select((F.col("quality") == 1).alias("indexed"), F.when(F.col("toxic") == 1, 500).otherwise(200).alias("http_status"), (F.col("doc_id") % 5).alias("depth")))


@query("select event_id, event_type from events order by ts desc, event_id limit 25")
def recent_rows(spark, sf):
    return store.recent(tables.table(spark, sf, "events"), 25, time_col="ts", tie_col="event_id").select("event_id", "event_type")


@query("select event_id from events where 1704800000.0 - epoch(ts) < 86400")
def ttl_cache_live(spark, sf):
    events = tables.table(spark, sf, "events").withColumn("added_at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return store.alive_entries(events, 1704800000.0, 86400).select("event_id")


@query("select event_id from (select event_id, row_number() over (order by ts, event_id) as r, count(*) over () as n from events) where n <= 200 or r > 50")
def evict_oldest(spark, sf):
    return store.evict_oldest(tables.table(spark, sf, "events"), time_col="ts", key="event_id").select("event_id")


@query(f"""with f as (select page_id, url, {_HOST} as domain, (page_id % 97)::double as priority from pages),
      best as (select * from f order by priority desc, page_id limit 50), free as (select * from best left join (select distinct {_HOST} as domain, 5.0 as nxt from pages where page_id % 4 = 0) using (domain) where coalesce(nxt, 0) <= 1)
    select page_id, domain from (select *, row_number() over (partition by domain order by priority desc, page_id) as r from free) where r = 1""")
def frontier_pop_polite(spark, sf):
    pages = _pages(spark, sf).select("page_id", "url")
    frontier = pages.select("page_id", "url", (F.col("page_id") % 97).cast("double").alias("priority"), F.lit(0).alias("depth"), F.col("page_id").cast("double").alias("discovered_at"), ur.fingerprint(F.col("url")).alias("fingerprint"), F.lit("pending").alias("status"))
    clock = pages.where("page_id % 4 = 0").select(ur.host_domain(F.col("url")).alias("domain"), F.lit(5.0).alias("next_allowed_at")).distinct()
    return crawl.pop_polite(frontier, clock, 1.0, take=None).select("page_id", "domain")


@made("""with recursive e as (select (range)::bigint as a, (range * 7 + 1) % 500 as b from range(500) union all select range, (range * 13 + 5) % 500 from range(500)),
      w(n, d) as (select 0::bigint, 0 union select e.b, w.d + 1 from w join e on e.a = w.n where w.d < 6)
    select 'u' || n as url, min(d)::int as depth from w group by n""")
def crawl_bfs_depth(spark, sf):
    n = spark.range(500)
    name = lambda c: F.concat(F.lit("u"), c.cast("string"))
    links = n.select(name(F.col("id")).alias("parent_url"), F.explode(F.array((F.col("id") * 7 + 1) % 500, (F.col("id") * 13 + 5) % 500)).alias("b")).select("parent_url", name(F.col("b")).alias("url"))
    checkpoints.folder(spark)
    return crawl.crawl_depths(spark.createDataFrame([("u0",)], "url string"), links, max_depth=6).select("url", "depth")


_LINKS = rf"""select distinct root || href as url from (select regexp_extract(url, '^[^:]+://[^/?#]*') as root, replace(unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)), '&amp;', '&') as href from pages where page_id in (select min(page_id) from ({_CANONICAL}) group by canonical)) where href like '/%'"""


@query(f"select canonical as url, 0 as depth from ({_CANONICAL}) union select url, 1 from ({_LINKS}) where url not in (select canonical from ({_CANONICAL}))")
def crawl_flow(spark, sf):
    """From all pages over their links, in two rounds; what is linked is held as an empty page."""
    checkpoints.folder(spark)
    pages = _pages(spark, sf).groupBy(ur.canonical_url(F.col("url")).alias("url")).agg(F.min_by("html", "page_id").alias("html"), F.min("page_id").alias("page_id"))
    links = html.extract_links(pages, [], threshold=0.0).select(F.col("url"), F.lit("").alias("html")).join(pages.select("url"), "url", "left_anti")
    held = pages.select("url", "html").unionByName(links)
    return crawl.crawl(pages.select("url"), fetch.from_table(held), _link_scores, max_depth=1, max_pages=None).select("url", "depth")


def _link_scores(got: DataFrame) -> DataFrame:
    """Links of fetched pages; without query terms each scores 0.5."""
    return html.extract_links(got.withColumn("page", F.col("url")), [], threshold=0.0, key="page").select(F.col("page").alias("parent_url"), "url", "relevance_score")


_STAGE = "(case event_type when 'view' then 'queued' when 'click' then 'searching' when 'signup' then 'fetching' when 'error' then 'nli' else 'done' end)"


@query(f"""select task_id, stage, (case stage when 'queued' then 1 when 'searching' then 12 when 'fetching' then 25 when 'nli' then 90 else 100 end)::int as pct from
      (select user_id as task_id, {_STAGE} as stage, ts, row_number() over (partition by user_id order by ts desc, {_STAGE} desc) as r from events) where r = 1 and 1706600000.0 - epoch(ts) < 600""")
def task_progress_state(spark, sf):
    stage = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "searching").when(F.col("event_type") == "signup", "fetching").when(F.col("event_type") == "error", "nli").otherwise("done")
    updates = tables.table(spark, sf, "events").select(F.col("user_id").alias("task_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), stage.alias("stage"))
    return incremental.task_states(updates, 1706600000.0).select("task_id", "stage", "pct")


# --- Media --------------------------------------------------------------------------------------------

def _blocks(spark):
    i = F.col("id")
    return spark.range(2000).select((i % 40).alias("image_id"), (i * 37 % 800).cast("int").alias("x"), (i * 53 % 600).cast("int").alias("y"), F.lit(20).alias("w"), F.lit(10).alias("h"), F.concat(F.lit("w"), i.cast("string")).alias("text"))


_BLOCKS = "select range % 40 as image_id, range * 37 % 800 as x, range * 53 % 600 as y, 20 as w, 10 as h, 'w' || range as text, range as id from range(2000)"


@made(f"select text from ({_BLOCKS}) b where exists (select 1 from range(40) r where r.range = b.image_id and x + 10 between r.range * 10 and r.range * 10 + 200 and y + 5 between 100 and 400)")
def text_in_region(spark, sf):
    regions = spark.range(40).select(F.col("id").alias("image_id"), (F.col("id") * 10).alias("x"), F.lit(100).alias("y"), F.lit(200).alias("width"), F.lit(300).alias("height"))
    return media.blocks_in_regions(_blocks(spark), regions).select("text")


@made(f"""select image_id, line::int as line, string_agg(text, ' ' order by x, text) as text from (select *, sum(b) over (partition by image_id order by y, x, text rows unbounded preceding) as line from
      (select *, coalesce((abs(y + 5 - lag(y + 5) over (partition by image_id order by y, x, text)) > 15)::int, 0) as b from ({_BLOCKS}))) group by 1, 2""")
def ocr_lines(spark, sf):
    return media.text_lines(_blocks(spark)).select("image_id", "line", "text")


@made("""select by_, min(pos) as first, max(pos) as last, count(*) as size from (select *, pos - row_number() over (partition by by_ order by pos) as g from
      (select range as pos, range // 1000 as by_, range // 7 * 7919 % 101 as value from range(10000)) where value < 60) group by by_, g having count(*) >= 3""")
def low_variance_bands(spark, sf):
    i = F.col("id")
    profile = spark.range(10000).select(i.alias("pos"), F.floor(i / 1000).alias("by_"), (F.floor(i / 7) * 7919 % 101).alias("value"))
    return media.low_bands(profile, by="by_", below=60, least=3)


@made("""select range as video_id, array_to_string([round_even(i * (t - 1) / greatest(n - 1, 1)::double, 0)::int for i in range(0, n)], ',') as frames from
      (select range, (range * 31 % 400 + 1)::int as t, least(greatest(least(round_even(range * 1.7, 0)::int, 60), 8), (range * 31 % 400 + 1)::int)::int as n from range(200))""")
def frame_samples(spark, sf):
    rows = spark.range(200).select(F.col("id").alias("video_id"), (F.col("id") * 31 % 400 + 1).cast("int").alias("t"), (F.col("id") * 1.7).alias("d"))
    return rows.select("video_id", F.array_join(media.frame_indexes(F.col("t"), F.col("d")), ",").alias("frames"))


@made("select image_id, x as pos, round(stddev_pop(v), 6) as value from (select range % 5 as image_id, range // 5 % 40 as x, range // 200 as y, range * 37 % 256 as v from range(6000)) group by 1, 2")
def deviation_profile(spark, sf):
    i = F.col("id")
    pixels = spark.range(6000).select((i % 5).alias("image_id"), (F.floor(i / 5) % 40).alias("x"), F.floor(i / 200).alias("y"), (i * 37 % 256).alias("value"))
    return media.deviation_profile(pixels, by="image_id", axis="x").select("image_id", "pos", F.round("value", 6).alias("value"))


@made("select range as image_id, 'x' || range as content, (case range % 3 when 0 then '.png' when 1 then '.jpg' else '.webp' end) as extension from range(30)")
def data_urls(spark, sf):
    kind = F.when(F.col("id") % 3 == 0, "image/unknown").when(F.col("id") % 3 == 1, "image/jpeg").otherwise("image/webp")
    made = spark.range(30).select(F.col("id").alias("image_id"), media.decode_data_url(F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(F.encode(F.concat(F.lit("x"), F.col("id").cast("string")), "utf-8")))).alias("d"))
    return made.select("image_id", F.decode("d.content", "utf-8").alias("content"), "d.extension")


@made("""with r as (select range % 20 as image_id, range * 37 % 300 as x, range * 53 % 300 as y, range * 11 % 97 + 1 as w, range * 17 % 89 + 1 as h from range(600)),
      once as (select *, row_number() over (partition by image_id, x // 30, y // 30, w // 30, h // 30 order by w * h desc, x, y) as n from r where w * h / 10000.0 between 0.02 and 0.95)
    select image_id, x, y, w as width, h as height from (select *, row_number() over (partition by image_id order by w * h desc, x, y) as k from once where n = 1) where k <= 10""")
def region_filter(spark, sf):
    i = F.col("id")
    regions = spark.range(600).select((i % 20).alias("image_id"), (i * 37 % 300).alias("x"), (i * 53 % 300).alias("y"), (i * 11 % 97 + 1).alias("width"), (i * 17 % 89 + 1).alias("height"), F.lit(10000).alias("image_area"))
    return media.keep_regions(regions).select("image_id", "x", "y", "width", "height")


@made("""with c as (select id, range % 40 as x, range // 40 as y, (range % 40 - 20) * (range % 40 - 20) + (range // 40 - 20) * (range // 40 - 20) < id * 50 as hot from range(6) i(id), range(1600))
    select id as image_id, min(x)::int as x, min(y)::int as y, (max(x) - min(x) + 1)::int as width, (max(y) - min(y) + 1)::int as height, count(*)::int as area, 0.9::double as avg_confidence, round(100.0 * count(*) / 1600, 6)::double as coverage_pct, 0.9::double as max_confidence, true as forged
    from c where hot group by id having count(*) >= 100""")
def mask_regions(spark, sf):
    masks = spark.range(6).select(F.col("id").alias("image_id"), F.lit(40).alias("width"), F.transform(F.sequence(F.lit(0), F.lit(1599)), lambda i: F.when(((i % 40) - 20) * ((i % 40) - 20) + (F.floor(i / 40) - 20) * (F.floor(i / 40) - 20) < F.col("id") * 50, 0.9).otherwise(0.1)).alias("cells"))
    return media.mask_regions(masks).join(media.mask_summary(masks), "image_id").withColumns({c: F.round(c, 6) for c in ("avg_confidence", "coverage_pct")})


# --- Flows --------------------------------------------------------------------------------------------

def _claims(spark, sf):
    claims = tables.table(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"), tx.squeeze(F.col("text")).alias("claim"))
    pages = _docs(spark, sf).select(F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("url"), "text")
    return claims, flows.trusted_evidence_pages(claims, pages, _lists(spark))


@query(rf"""with c as (select item_id as claim_id, unnest(list_distinct([x for x in regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+') if regexp_full_match(x, '[a-z]{{3,}}')])) as term from benchmark),
      p as (select 'https://' || source || '.example.org/' || doc_id as url, list_distinct([x for x in regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+') if regexp_full_match(x, '[a-z]{{3,}}')]) as t from documents),
      w as (select url, len(t) as size, unnest(t) as term from p), o as (select term, count(*) as often from w group by term),
      h as (select claim_id, url, size, sum(round(ln(1 + (select count(*) from documents) / often) * 1e6)::bigint) as hits from w join c using (term) join o using (term) group by all)
    select claim_id, url, rank::int as rank from (select *, row_number() over (partition by claim_id order by hits / sqrt(size) desc, size, url) as rank from h) where rank <= 15""")
def claim_pages(spark, sf):
    """The pages of each claim of the benchmark by shared terms, all of one trust."""
    docs = _docs(spark, sf).select(F.format_string("https://%s.example.org/%d", "source", "doc_id").alias("url"), "text", F.lit(1.3).alias("trust"))
    claims = tables.table(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"))
    return retrieval.best_pages(claims, docs, 15, terms=tx.letters_tokens).select("claim_id", "url", "rank")


@query()
def claim_check(spark, sf):
    claims, pages = _claims(spark, sf)
    seen, verdicts, verified = flows.check_claims(claims, pages)
    return claims.select("claim_id").join(verdicts, "claim_id", "left").join(verified, "claim_id", "left").select("claim_id", F.coalesce("verdict", F.lit(C.NO_INFO)).alias("verdict"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "verified", "independent_sources", "statement")


@query(f"""with recursive found as (select query_id, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from ({_SCORES} and v.vec_id in (select doc_id from documents))) where rank <= 30),
      r as (select query_id, vec_id, source, score, {_SHINGLES} as g, row_number() over (partition by query_id, source order by score desc, vec_id) as k from
        (select query_id, vec_id, score, source, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') as w from found join documents on doc_id = vec_id)),
      fold(query_id, source, k, vec_id, score, stay, seen) as (select query_id, source, k, vec_id, score, true, g from r where k = 1
        union all select query_id, source, k, vec_id, score, stay, case when stay then list_distinct(list_concat(seen, g)) else seen end from
          (select r.*, seen, len(list_intersect(g, seen)) / greatest(1, len(g)) <= {C.NEAR_DUPLICATE} as stay from fold f join r on r.query_id = f.query_id and r.source = f.source and r.k = f.k + 1)),
      capped as (select * from (select *, row_number() over (partition by query_id, source order by score desc, vec_id) as n from fold where stay) where n <= {C.PER_DOMAIN_SEARCH}),
      titled as (select *, {_LETTERS} from (select query_id, vec_id, capped.source, score, text, substr(text, 1, 60) as t from capped join documents on doc_id = vec_id)),
      blended as (select query_id, vec_id, source, t, text, (0.5 * score + 0.3 * (1.3 / 3) + 0.2 * exp(-vec_id / 365.0)) * {_FACTOR} as score from titled),
      ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as k from blended where score >= 0.15)
    select query_id, k::int as rank, 'https://' || source || '.example.org/' || vec_id as url, t as title, md5(case when length(q) <= 800 then q else regexp_replace(substr(q, 1, 800), ' [^ ]*$', '') || '…' end) as snippet, round(score, 6)::double as score
    from (select *, trim(regexp_replace(text, '\\s+', ' ', 'g')) as q from ranked) where k <= 10""")
def search_flow(spark, sf):
    """Every vector is the chunk of the document of its number."""
    vectors = _vectors(spark, sf)
    docs = _docs(spark, sf).select(F.col("doc_id").alias("id"), F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("url"), "text")
    rated = trust.with_trust(vectors.select(F.col("vec_id").alias("id"), "embedding").join(docs, "id"), "url", _lists(spark)).withColumns({"title": F.substring("text", 1, 60), "published": F.lit(AS_OF) - F.col("id") * 86400.0})
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return flows.search(asked, rated, AS_OF).withColumns({"snippet": F.md5("snippet"), "score": F.round("score", 6)})


_FRESH = f"(select min(page_id) as doc_id, url, any_value(title) as title, text from ({_content()}) where length(trim(text)) >= 100 group by url, text)"


@query(f"""select substr(sha256(url || '#' || chunk_index), 1, 32) as id, url, chunk_index, c.text, substr(title, 1, 200) as title, {_HOST} as domain from ({_packs(512, 3, 100, 0, _FRESH)}) c join {_FRESH} f on f.doc_id = c.doc_id""")
def index_flow(spark, sf):
    pages = _pages(spark, sf)
    stored = spark.createDataFrame([], "url string, content_hash string, indexed boolean")
    return flows.index_pages(pages, stored).select("id", "url", "chunk_index", "text", "title", "domain")


# --- Streams ------------------------------------------------------------------------------------------

@query("select date_trunc('hour', ts) as start, date_trunc('hour', ts) + interval 1 hour as end_, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def windowed_counts(spark, sf):
    events = tables.table(spark, sf, "events")
    out = incremental.windowed_counts(events)
    return out.select("start", F.col("end").alias("end_"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""select user_id, min(ts) as start, max(ts) + interval 30 minute as end_, count(*) as n from (select *, sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from
      (select *, coalesce((ts > lag(ts) over (partition by user_id order by ts, event_id) + interval 30 minute)::int, 0) as b from events)) group by user_id, s""")
def session_counts(spark, sf):
    return incremental.session_counts(tables.table(spark, sf, "events")).select("user_id", "start", F.col("end").alias("end_"), "n")


@query("select substr(sha256(canonical), 1, 16) as fingerprint from (" + _CANONICAL + ") group by 1")
def stream_seen_set(spark, sf):
    """The seen set as a stream over the pages, run until all are read, into a table in memory."""
    from ..sources.tables import table

    schema = table(spark, sf, "pages").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_stream_folder(sf)).withColumn("url", ur.canonical_url(F.col("url")))
    return _run_stream(spark, incremental.unseen_urls(stream.select("url")).select("fingerprint"), "seen_set")


def _stream_folder(sf: str) -> str:
    """A stream reads folders: the table's own, or the files named like it."""
    return f"{sf}/pages.parquet*"


def _run_stream(spark: SparkSession, out: DataFrame, name: str) -> DataFrame:
    import uuid

    checkpoints.folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").queryName(f"{name}_{uuid.uuid4().hex[:8]}").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
