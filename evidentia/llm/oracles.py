"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from . import rules, secrets

OP1 = """
with recursive n as (select source, count(*) as n from documents group by source),
w as (select source, n, pow(n::double, 0.5) as weight from n),
r as (select source, (select sum(n) from w)::double * weight / (n * (select sum(weight) from w)) as rate from w),
p as (select source, greatest(1, ceil(rate / 8.0))::int as parts, rate / greatest(1, ceil(rate / 8.0))::int as mean from r),
t(source, parts, mean, k, q, c) as (
  select source, parts, mean, 0, exp(-mean), exp(-mean) from p
  union all select source, parts, mean, k + 1, q * mean / (k + 1), c + q * mean / (k + 1) from t where k < 48),
u as (select d.doc_id, d.source, p.parts, unnest(range(0, p.parts)) as j from documents d join p on d.source is not distinct from p.source),
h as (select *, ('0x' || substr(md5('17|' || coalesce(doc_id::varchar, 'null') || '|' || j), 1, 13))::bigint / 4503599627370496.0 as x from u),
c as (select h.doc_id, h.source, count(*) as n from h join t on h.source is not distinct from t.source and t.c <= h.x group by 1, 2),
e as (select d.*, unnest(range(0, c.n))::int as copy from documents d join c on d.doc_id = c.doc_id and d.source is not distinct from c.source)
select *, ('0x' || substr(md5('order17|' || doc_id || '|' || copy), 1, 13))::bigint as shuffle_key from e
"""

_COUNT = r"length(regexp_replace({0}, '[^\\\\<\[]', '', 'g'))"

OP2 = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(role) + {_COUNT.format("role")} + length(text) + {_COUNT.format("text")} + {len("<|turn|><|says|><|end|>")})::bigint as formatted_chars,
  0::bigint as n_attachments, sum((strlen(text) + 3) // 4)::bigint as n_tokens
from t group by conv_id
"""

_STATS = {"symbol_ratio": "n_symbols / word_chars", "dup_line_ratio": "n_dup_lines / n_lines", "repeat_ratio": "n_repeat_words / n_words", "capital_ratio": "n_capitals / word_chars", "mean_word_chars": "word_chars / n_words"}


def _op3(alpha: float = 0.05, delta: float = 0.1) -> str:
    stat = {k: f"(case when {v.split(' / ')[1]} > 0 then ({v})::double else 0.0 end)" for k, v in _STATS.items()}
    steps = ", ".join(f"case when {stat[rules.RULES[r][1]]} {'>' if rules.RULES[r][2] > 0 else '<'} {rules.RULES[r][3][j]!r} then {t} else {rules.NEVER} end" for t, (r, j) in enumerate(rules.STEPS))
    return f"""
with words as (select doc_id, lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
grams as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from words)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as m from grams) where m > 1),
covered as (select doc_id, count(distinct i + k) as n from twice, range(3) t(k) group by doc_id),
stats as (select doc_id, lang as stratum, len(w) as n_words, coalesce(list_sum([length(x) for x in w]), 0)::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_capitals,
  len([x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')]) as n_lines,
  len([x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')]) - len(list_distinct([x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')])) as n_dup_lines,
  coalesce(c.n, 0) as n_repeat_words from words left join covered c using (doc_id)),
based as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, least({steps}) as step from stats),
good as (select b.* from based b where not base_failed and doc_id in (select doc_id from labels where quality = 1)),
sizes as (select stratum, count(*) as n, pow({1 - alpha!r}, count(*)) > {delta!r} / (select count(*) from (select distinct stratum from good)) as small from good group by stratum),
grouped as (select case when small then null else s.stratum end as own, small, step from good g join sizes s on g.stratum is not distinct from s.stratum),
tests as (select own, small, t, count(*) as n, count(*) filter (step <= t) as k from grouped, range({len(rules.STEPS)}) r(t) group by own, small, t),
judged as (select *, case when k >= n * {alpha!r} then 1.0 else (select sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({alpha!r}) + (n - i) * ln({1 - alpha!r}))) from range(0, k + 1) x(i)) end
  <= {delta!r} / (select count(*) from sizes) as ok from tests),
limits as (select own, small, coalesce(min(t) filter (not ok), {len(rules.STEPS)}) - 1 as last from judged group by own, small),
cut as (select s.stratum, last from sizes s join limits l on s.small = l.small and (s.small or s.stratum is not distinct from l.own))
select doc_id, n_words::bigint as n_words, word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and step > coalesce(last, -1) as kept
from based left join cut on based.stratum is not distinct from cut.stratum
"""


def _found(kind: int, pattern: str, keep: str = "true") -> str:
    p = pattern.replace("'", "''")
    return f"""select doc_id, {kind} as kind_no, s, s + length(m) as e from (
      select doc_id, ms[k] as m, coalesce(list_sum([length(x) for x in ps[1:k]]), 0)::bigint + coalesce(list_sum([length(x) for x in ms[1:k - 1]]), 0)::bigint as s from (
        select doc_id, ms, ps, unnest(range(1, len(ms) + 1)) as k from (select doc_id, regexp_extract_all(text, '{p}') as ms, string_split_regex(text, '{p}') as ps from t where regexp_matches(text, '{p}')))) where {keep}"""


def _op8() -> str:
    window = secrets.WINDOW
    letters = "length(regexp_replace(m, '[^{}]', '', 'g'))"
    changes = "len([i for i in range(1, length(m)) if regexp_matches(substr(m, i, 2), '^([a-z][A-Z]|[A-Z][a-z])$')])"
    mixed = f"{changes} >= {secrets.CHANGES} * length(m) and least({letters.format('A-Z')}, {letters.format('a-z')}) >= {secrets.CASE_SHARE} * {letters.format('A-Za-z')}"
    kinds = f"case when not regexp_matches(m, '[0-9]') then {secrets.ENTROPY['word']} when regexp_matches(m, '^[0-9]+$') then 9.0 " + f"when regexp_matches(m, '^[0-9a-f]+$|^[0-9A-F]+$') then {secrets.ENTROPY['hex']} when regexp_matches(m, '^[A-Za-z0-9]+$') then {secrets.ENTROPY['alnum']} else {secrets.ENTROPY['base64']} end"
    allowed = " or ".join([f"not regexp_matches(m, '{secrets.NOT_ALLOWED}')", *[f"regexp_matches(m, '{p}')" for p in secrets.ALLOW]])
    per_window = f"list_sum([((length(w) - length(replace(w, ch, ''))) / {window}.0) * -log2((length(w) - length(replace(w, ch, ''))) / {window}.0) for ch in list_distinct(string_split(w, ''))])"
    highest = f"round(list_max([{per_window} for w in [substr(m, i, {window}) for i in range(1, length(m) - {window} + 2)]]), 9)"
    assign_keep = f"length(regexp_extract(m, '{secrets.ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 12"
    return f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
found as ({_found(0, secrets.ASSIGN, assign_keep)}
  union all {_found(1, secrets.ACCESS)}
  union all {_found(2, secrets.HEX)}
  union all {_found(3, secrets.CANDIDATE, f"case when regexp_matches(m, '[0-9]') then not ({allowed}) else {mixed} end and {kinds} < 9 and {highest} >= {kinds}")}),
named as (select doc_id, kind_no, s, ['assign', 'access', 'hex', 'entropy'][kind_no + 1] || ':' || s || ':' || e as line from found)
select t.doc_id, count(*) filter (kind_no = 0) as n_assign, count(*) filter (kind_no = 1) as n_access, count(*) filter (kind_no = 2) as n_hex,
  sha256(coalesce(string_agg(line, ',' order by s, kind_no) filter (kind_no < 3), '')) as base_sha256, coalesce(string_agg(line, ',' order by s, kind_no), '') as spans
from t left join named using (doc_id) group by t.doc_id
"""


OP5 = """
with t as (select doc_id, row_number() over (order by doc_id) as r, hex(encode(coalesce(text, ''))) as h from documents),
w as (select r, i, md5_number(substr(h, 2 * i + 1, 400)) as m from (select r, h, unnest(range(0, length(h) // 2 - 199)) as i from t)),
hit as (select r, i, lag(i) over (partition by r order by i) as before from (select r, i, count(*) over (partition by m) as n from w) where n > 1),
span as (select r, min(i) as s, max(i) + 200 as e from (select r, i, sum((before is null or i > before + 200)::int) over (partition by r order by i) as k from hit) group by r, k),
piece as (select r, s, e, lag(e, 1, 0) over (partition by r order by s) as before from span),
cut as (select t.r, sum(e - s)::bigint as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' order by s) || substr(any_value(h), 2 * max(e) + 1) as kept from piece join t using (r) group by t.r)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from t left join cut using (r)
"""

OP9 = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (select distinct doc_id, md5_number_lower(array_to_string(w[i:least(i + 4, len(w))], ' ') || case when len(w) < 5 then '|' || len(w) else '' end) as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) as i from w)),
n as (select doc_id, count(*) as n from g group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as common from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from pairs join n p on p.doc_id = x join n q on q.doc_id = y where 100 * common >= 75 * (p.n + q.n - common)),
sym as (select x, y from links union all select y, x from links),
reach(x, y) as (select doc_id, doc_id from w union select r.x, s.y from reach r join sym s on r.y = s.x)
select w.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id from w left join n using (doc_id) join (select x as doc_id, min(y) as component_id from reach group by x) c using (doc_id)
"""

OP10 = """
with lowered as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
items as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
windows as (select item_id, least(len(w), 10) as k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from items where len(w) > 0)),
hits as (select d.doc_id, d.i, x.k, x.item_id from (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as g from
    (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from lowered, (select distinct k from windows))) d join windows x on x.k = d.k and x.g = d.g),
words as (select doc_id, count(distinct i + o) as n_hit from (select distinct doc_id, i, k from hits), range(10) t(o) where o < k group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id::varchar as item_id from hits) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from lowered left join words using (doc_id) left join found using (doc_id)
"""

OP11 = """
with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w, min(doc_id) over (partition by text) as first from t),
marks as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
f as (select part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::int
  + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, false)::int as fails, coalesce(good, false) as good, coalesce(toxic, false) as toxic from w left join marks using (doc_id)),
kinds as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by part, fails),
b(i, letter) as (select i::int, substr('ABCDE', i::int + 1, 1) from range(5) r(i)),
orders as (select [p.i, q.i, r.i, s.i, t.i] as o, p.letter || q.letter || r.letter || s.letter || t.letter as filter_order from b p, b q, b r, b s, b t where len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
steps as (select filter_order, k::int as step, o[k] as own, coalesce(list_sum([(1 << x)::int for x in o[1:k - 1]]), 0)::int as before from orders, range(1, 6) r(k)),
figures as (select part, filter_order, step, own,
  coalesce(sum(n) filter (fails & (before | (1 << own)) = 0), 0) as kept,
  coalesce(sum(n) filter (fails & before = 0 and (fails >> own) & 1 = 1), 0) as removed,
  coalesce(sum(n) filter (fails & before <> 0 and (fails >> own) & 1 = 1), 0) as redundant,
  coalesce(sum(n) filter (fails = 1 << own), 0) as unique_fails,
  coalesce(sum(good) filter (fails & before = 0 and (fails >> own) & 1 = 1), 0) as good_lost,
  coalesce(sum(toxic) filter (fails & before = 0 and (fails >> own) & 1 = 1), 0) as toxic_lost
  from kinds, steps group by part, filter_order, step, own)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  (sum(removed) over (partition by part, own))::bigint as shapley from figures
"""

OP12 = """
with t as (select page_id, coalesce(html, '') as html from pages),
f as (select page_id, html, case when strlen(html) >= 100 then min(page_id) over (partition by html) end as first from t)
select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest, case when first is not null and (page_id is null or page_id > first) then 'revisit' else 'response' end as record_type,
  case when first is not null and (page_id is null or page_id > first) then first end as refers_to from f
"""


def _op13(k: int = 40, rounds: int = 5) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} as (select row, c, d from (select row, c, d, row_number() over (partition by row order by d, c) as rank from
  (select row, c, list_sum([(v[i] - m[i]) * (v[i] - m[i]) for i in range(1, 65)]) as d from v, c{r})) where rank = 1),""")
        if r < rounds:
            steps.append(f"""
s{r} as (select c, i, ((s - ((s % n) + n) % n) // n)::bigint as m from (select c, i, sum(x)::bigint as s, count(*) as n from (select c, unnest(v) as x, unnest(range(1, 65)) as i from a{r} join v using (row)) group by c, i)),
c{r + 1} as (select o.c, coalesce(n.m, o.m) as m from c{r} o left join (select c, list(m order by i) as m from s{r} group by c) n using (c)),""")
    return f"""
with k as (select vec_id, embedding from embeddings where len(embedding) = 64 and len([x for x in embedding if x is not null and isfinite(x)]) = 64),
v as (select row_number() over () as row, vec_id, [floor(256 * x::double)::bigint for x in embedding] as v from k),
c0 as (select c, m from (select row_number() over (order by sha256('2:' || vec_id), v) - 1 as c, v as m from v where vec_id is not null) where c < {k}),{"".join(steps)}
t as (select row, c, d, sum(d) over (partition by c) as own, sum(d) over () as every from a{rounds})
select v.vec_id, t.c::int as cluster, t.d::bigint as distance, t.own::bigint as cluster_inertia, t.every::bigint as inertia, sha256(array_to_string(m, ',')) as centroid_sha256 from t join v using (row) join c{rounds} f on f.c = t.c
"""


ORACLES = {
    "op1_poisson_mix": OP1,
    "op2_chat_format": OP2,
    "op3_quality_rules": _op3(),
    "op5_suffix_dedup": OP5,
    "op8_secret_scan": _op8(),
    "op9_signature_trees": OP9,
    "op10_decontamination": OP10,
    "op11_filter_audit": OP11,
    "op12_warc_archives": OP12,
    "op13_ball_tree_clusters": _op13(),
}
