"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from quillspark.llm import drake, pii, resampling

OP8 = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e as (
  select *, replace(regexp_replace(replace(text, '\', '\\'), '<(/turn>)', '<\\\1', 'g'), '###', '#\#\#') as x0 from t
), f as (
  select *, length(regexp_replace(text, '[^\\]', '', 'g'))
    + len(regexp_extract_all(text, '</turn>'))
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '##+'), lambda r: greatest(length(r) - 2, 0))), 0)
    + length(text) as said from e
)
select conv_id, cast(count(*) as bigint) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(said + length(role) + length('### : </turn>') + 1) as bigint) as formatted_chars
from f group by conv_id
"""


def _spans(kind: str, rank: int, pattern: str, test: str) -> str:
    """Matches of ``pattern`` with their positions, from the pieces between them, and what stands around in the text; ``test`` sees the match as m."""
    p = pattern.replace("'", "''")
    return f"""select * from (select doc_id, {rank} as rank, '{kind}' as kind, m, s, s + length(m) as e,
        substr(text, greatest(s - {pii.CONTEXT_CHARS}, 0) + 1, least(s, {pii.CONTEXT_CHARS})) as before, substr(text, s + length(m) + 1, {pii.CONTEXT_CHARS}) as after from (
      select doc_id, text, unnest(hits) as m, unnest(list_transform(range(1, len(hits) + 1), lambda i: cast(length(pieces[i])
          + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0)
          + coalesce(list_sum(list_transform(pieces[1:i - 1], lambda h: length(h))), 0) as bigint))) as s
      from (select doc_id, text, regexp_extract_all(text, '{p}') as hits, regexp_split_to_array(text, '{p}') as pieces from documents where text is not null)
    )) where {test}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""length({_DIGITS}) between 12 and 19 and list_sum(list_transform(range(0, length({_DIGITS})), lambda i:
  case when i % 2 = 0 then cast({_DIGITS}[length({_DIGITS}) - i] as int)
  else (cast({_DIGITS}[length({_DIGITS}) - i] as int) * 2) % 10 + (cast({_DIGITS}[length({_DIGITS}) - i] as int) * 2) // 10 end)) % 10 = 0"""
_IBAN = "replace(m, ' ', '')"
_MOD97 = f"""cast(list_reduce(list_prepend(0::bigint, list_transform(string_split({_IBAN}[5:] || {_IBAN}[1:4], ''), lambda c:
  case when c >= 'A' then cast(ascii(c) - 55 as bigint) else cast(c as bigint) end)), lambda a, b: (a * (case when b > 9 then 100 else 10 end) + b) % 97) as bigint) = 1"""
_NEAR = "(coalesce(before, '') || ' ' || coalesce(after, ''))"
_score = "case kind " + " ".join(
    f"when '{k}' then {pii.PRIOR[k]} + case when regexp_matches({_NEAR}, '(?i)\\b(?:{pii.CONTEXT[k]})\\b') then {pii.BONUS} else 0 end - case when regexp_matches({_NEAR}, '(?i)\\b(?:{pii.AGAINST[k]})\\b') then {pii.PENALTY} else 0 end"
    for k in pii.KINDS
) + " end"
OP2 = f"""
with s as (
  {_spans("email", 0, "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "true")}
  union all {_spans("ip", 1, "[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 or coalesce(try_cast(x as bigint), 999) > 255)) = 0")}
  union all {_spans("card", 2, "[0-9](?:[\\x20-]?[0-9])+", _LUHN)}
  union all {_spans("phone", 3, "\\+[0-9][\\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 9 and 15")}
  union all {_spans("iban", 4, pii.iban_pattern(r"\b", r"\b"), _MOD97)}
  union all {_spans("ssn", 5, r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "not regexp_matches(m, '^(?:000|666|9..)|-00-|-0000$') and right(coalesce(before, ''), 1) <> '-' and left(coalesce(after, ''), 1) <> '-'")}
), p as (
  select *, {_score} as score from s
), r as (
  select * from p where rank < 4 or score >= {pii.REPORT_FROM}
)
select d.doc_id, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip,
  count(*) filter (kind = 'card') as n_card, count(*) filter (kind = 'phone') as n_phone,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (rank < 4), '')) as base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank), '') as spans,
  coalesce(string_agg(score, ',' order by s, rank), '') as scores
from documents d left join r using (doc_id) group by d.doc_id
"""


def _op10() -> str:
    from quillspark.llm import licenses

    listed = lambda text: "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"
    phrases = " union all ".join(f"select {listed(p)} as p, '{label}' as label" for p, label in licenses.PHRASES.items())
    templates = " union all ".join(f"select '{label}' as label, list_distinct({listed(t)}) as t, {licenses.block_words(t)} as size" for label, t in licenses.TEMPLATES.values())
    return rf"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
p as ({phrases}), t as ({templates}),
e as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from w),
b as (select doc_id, i - 1 as word, label from e join p on w[i] = p[1] where w[i:i + len(p) - 1] = p),
bs as (select doc_id, count(*) as n, min(word) as f, max(word) as l, string_agg(distinct label, ',' order by label) as labels from b group by doc_id),
blocks as (select doc_id, size, list_distinct(w[k * size // 2 + 1:k * size // 2 + size]) as held
  from (select doc_id, w, size, unnest(range(0, cast(greatest(0, ceil((len(w) - size) / (size / 2e0))) as bigint) + 1)) as k from w, (select distinct size from t))),
m as (select doc_id, label, len(list_intersect(held, t)) / cast(len(t) as double) as share from blocks join t on blocks.size = t.size where len(list_intersect(held, t)) >= ceil({licenses.THRESHOLD}e0 * len(t))),
both_labels as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from b union all select doc_id, label from m) group by doc_id)
select w.doc_id, len(w.w) as n_words, coalesce(bs.n, 0) as n_base, bs.f as first_word, bs.l as last_word, coalesce(bs.labels, '') as base_labels, coalesce(both_labels.labels, '') as labels,
  coalesce(greatest(case when bs.n > 0 then {licenses.PHRASE_SCORE}e0 else 0e0 end, ms.share), 0e0) as score
from w left join bs on w.doc_id = bs.doc_id left join both_labels on w.doc_id = both_labels.doc_id left join (select doc_id, max(share) as share from m group by doc_id) ms on w.doc_id = ms.doc_id
"""


def _op11() -> str:
    """Every round written out: the nearest centroids, then the floors of the means."""
    near = lambda c: f"""(select vec_id, r, q, c as cluster, d as distance from (
      select v.vec_id, v.r, v.q, c.c, list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d,
        row_number() over (partition by v.r order by list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.c) as k
      from v cross join {c} c) where k = 1)"""  # noqa: E731
    rounds = ", ".join(
        f"""a{i} as materialized (select * from {near(f"c{i}")} x),
        c{i + 1} as materialized (select c.c, coalesce(m.q, c.q) as q from c{i} c left join (
          select cluster, list(cast(s // n - case when s % n < 0 then 1 else 0 end as bigint) order by place) as q from (
            select cluster, place, sum(x) as s, count(*) as n from (select cluster, unnest(q) as x, unnest(range({drake.DIMENSION})) as place from a{i}) group by cluster, place) group by cluster) m on c.c = m.cluster)"""
        for i in range(drake.ROUNDS)
    )
    last = f"c{drake.ROUNDS}"
    return f"""
with v as materialized (
  select vec_id, row_number() over () as r, list_transform(embedding, lambda x: cast(floor({drake.SCALE} * cast(x as double)) as bigint)) as q from embeddings
  where len(embedding) = {drake.DIMENSION} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {drake.DIMENSION}
), c0 as materialized (
  select row_number() over (order by h, q) - 1 as c, q from (select sha256('{drake.SEED}:' || coalesce(cast(vec_id as varchar), '')) as h, q from v order by h, q limit {drake.CLUSTERS})
), {rounds}, f as materialized (select * from {near(last)} x)
select f.vec_id, cast(f.cluster as integer) as cluster, cast(f.distance as bigint) as distance, cast(sum(f.distance) over (partition by f.cluster) as bigint) as cluster_inertia,
  cast(sum(f.distance) over () as bigint) as inertia, sha256(array_to_string(c.q, ',')) as centroid_sha256
from f join {last} c on f.cluster = c.c
"""


#: The pages of the tables hold their article in an element of that name; the query finds that out by itself.
OP12 = r"""
with a as (
  select page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '<[^>]*$', '') as a from pages
), b as (
  select page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(a, '</?(?:p|h[1-6]|li|ul|ol|div)(?:\s[^>]*)?>', chr(1), 'g'), '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), chr(1)) as blocks from a
), c as (
  select page_id, url, coalesce(array_to_string(list_filter(list_transform(blocks, lambda x:
    trim(regexp_replace(regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)), '') as text from b
)
select page_id, url, text, cast(length(text) as bigint) as n_chars from c
"""

#: The table of the usual CRC of 32 bits, from its polynomial.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(cast(i as bigint), range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end))"
OP13 = rf"""
with w as materialized (
  select kind, id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from (select 's' as kind, doc_id as id, text from documents union all select 't', item_id, text from benchmark)
), f as materialized (
  select kind, r, array_to_string(w[i:i + n - 1], ' ') as f, count(*) as m from (select kind, r, w, unnest(range(1, len(w) + 1)) as i from w), (select unnest([1, 2, 3]) as n)
  where i + n - 1 <= len(w) group by all
), t as materialized (select {_CRC_TABLE} as t), h as materialized (
  select f, cast(xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(octet_length(encode(f))), lambda k: cast(('0x' || hex(encode(f))[2 * k + 1:2 * k + 2]) as bigint))),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), cast(4294967295 as bigint)) % {resampling.BUCKETS} as int) as b
  from (select distinct f from f), t
), g as materialized (
  select b, cast(floor(1000 * ln((t + 1) * (all_s + {resampling.BUCKETS}) / ((s + 1) * (all_t + {resampling.BUCKETS})))) as bigint) as g from (
    select b, s, t, sum(s) over () as all_s, sum(t) over () as all_t from (
      select b, cast(coalesce(sum(m) filter (kind = 's'), 0) as double) as s, cast(coalesce(sum(m) filter (kind = 't'), 0) as double) as t from f join h using (f) group by b))
), d as (
  select w.id as doc_id, len(w.w) as n_words, cast(coalesce(x.n, 0) as bigint) as n_features, cast(coalesce(x.weight, 0) as bigint) as weight
  from w left join (select r, sum(m) as n, sum(m * g) as weight from f join h using (f) join g using (b) group by r) x using (r) where kind = 's'
), s as (
  select *, weight + cast(floor(-1000 * ln(-ln((cast(('0x' || sha256('{resampling.SEED}:' || coalesce(cast(doc_id as varchar), ''))[1:8]) as bigint) + 0.5e0) / 4294967296e0))) as bigint) as score from d
), o as (
  select *, row_number() over (order by n_words < {resampling.LEAST_WORDS}, score desc, doc_id nulls last) as k, {resampling.PERCENT} * (count(*) filter (n_words >= {resampling.LEAST_WORDS}) over ()) // 100 as take from s
)
select doc_id, n_features, weight, score, case when n_words >= {resampling.LEAST_WORDS} and k <= take then k end as rank from o
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_personal_data": OP2, "op8_chat_formatting": OP8, "op10_license_scan": _op10(), "op11_centroid_clustering": _op11(), "op12_html_extraction": OP12, "op13_importance_resampling": OP13}
