"""DuckDB SQL for the queries, written apart from the DataFrame code."""

from __future__ import annotations

from quillspark.functions import langid
from quillspark.functions.seeds import SEEDS

VIEWS = r"""
v_scores as (select o_orderkey as id, o_orderpriority as grp, cast(year(o_orderdate) as int) as yr,
  cast(o_orderkey % 5 + 1 as int) as rating, (floor(o_totalprice / 25) - 10000) / 10000e0 as score from orders),
v_ties as (select l_returnflag as grp, cast(year(l_shipdate) as int) as yr, l_quantity as score from lineitem),
v_docs as (select d.doc_id as id, case when cast(substr(d.source, 4) as int) % 2 = 0 then 'A' else 'B' end as category,
  cast(2015 + d.doc_id % 9 as int) as yr, cast(1 + d.n_chars % 5 as int) as rating, d.text, d.lang, l.quality
  from documents d left join labels l on d.doc_id = l.doc_id),
v_daily as (select event_type as grp, cast(ts as date) as day, value as score from events),
v_turns as (select conv_id * 1000 + turn as id, role as grp, text from conversations where role in ('user', 'assistant')),
v_reviews as (select doc_id, cast(1 + n_chars % 5 as double) as rating, case when doc_id % 3 = 0 then '  A title ' end as title,
  case when doc_id % 11 = 0 then '  ' || chr(10) || ' ' else text end as text,
  case when doc_id % 7 <> 0 then 1388534400000 + doc_id % 4000 * 86400000 end as "timestamp",
  case when doc_id % 2 = 0 then doc_id % 10 end as helpful_vote, case when doc_id % 5 = 0 then true end as verified_purchase from documents),
v_labelled as (select *, case when score >= 0.05 then 'positive' when score <= -0.05 then 'negative' else 'neutral' end as pred,
  case when rating in (4, 5) then 'positive' when rating in (1, 2) then 'negative' else 'neutral' end as "true" from v_scores)
"""


def _with(body: str, *more: str) -> str:
    return "with " + ",\n".join([VIEWS.strip(), *more]) + "\n" + body


WS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
STRIPPED = rf"regexp_replace(coalesce(text, ''), '^{WS}+|{WS}+$', '', 'g')"
YEAR_OF = """cast(year(make_timestamp("timestamp" * 1000)) as int)"""
PARSED = f"""v_parsed as (select {YEAR_OF} as year, rating, regexp_replace(coalesce(title, ''), '^{WS}+|{WS}+$', '', 'g') as title, {STRIPPED} as text,
  coalesce(helpful_vote, 0) as helpful_vote, coalesce(verified_purchase, false) as verified_purchase, "timestamp"
  from v_reviews where "timestamp" is not null and {STRIPPED} <> '')"""
ASCII = r"(case when length(text) = 0 then 0e0 else length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / cast(length(text) as double) end)"
WORDS = r"""regexp_extract_all(regexp_replace(regexp_replace(lower(text), '[^\x00-\x7F\p{L}\p{N}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g'), '\b[a-z]+(?:''[a-z]+)?\b', 0)"""
MISMATCH = "case when rating >= 4 and score <= -0.5 then 'high_star_negative' when rating <= 2 and score >= 0.5 then 'low_star_positive' end"
HASHED = "md5('42|' || id)"
GRID = "(select a as \"true\", b as pred from unnest(['negative', 'neutral', 'positive']) x(a), unnest(['negative', 'neutral', 'positive']) y(b))"


def _stop_list() -> str:
    from quillspark.functions.text import STOP_WORDS

    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + "]"


def _kept() -> str:
    return f"list_filter({WORDS}, lambda w: not list_contains({_stop_list()}, w))"


def _terms() -> str:
    return f"""v_kept as (select id, grp, {_kept()} as k from v_turns),
v_grams as (select id, grp, list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) as g from v_kept),
v_terms as (select id, grp, term, count(*) as tf from (select id, grp, unnest(g) as term from v_grams) group by all)"""


def _mann_whitney(source: str, value: str, group: str, a: str, b: str, by: str = "", exact: bool = False) -> str:
    lead, part = (f"{by}, ", f"partition by {by}") if by else ("", "")
    tail = f"group by {by}" if by else ""
    digits = 15 if exact else 6
    return f"""r as (select {lead}{group} as g, rank() over ({part} order by {value}) + (count(*) over (partition by {lead}{value}) - 1) / 2e0 as rk,
    count(*) over (partition by {lead}{value}) as t from {source} where {group} in ('{a}', '{b}')),
s as (select {lead}count(*) filter (g = '{a}') as n1, count(*) filter (g = '{b}') as n2, sum(rk) filter (g = '{a}') as r1, sum(cast(t as double) * t - 1) as tie from r {tail}),
u as (select *, r1 - n1 * (n1 + 1) / 2e0 as u0, cast(n1 + n2 as double) as n from s)
select {lead}n1, n2, round(u0, 6) as u, round(tie, 6) as tie_term,
  round((greatest(u0, cast(n1 as double) * n2 - u0) - cast(n1 as double) * n2 / 2 - 0.5) / sqrt(cast(n1 as double) * n2 / 12 * (n + 1 - tie / (n * (n - 1)))), {digits}) as z,
  round(2 * u0 / (cast(n1 as double) * n2) - 1, 6) as delta from u"""


def _ks(source: str, value: str, group: str, a: str, b: str) -> str:
    return f"""h as (select {value} as v, count(*) filter ({group} = '{a}') as a, count(*) filter ({group} = '{b}') as b from {source} where {group} in ('{a}', '{b}') group by 1),
c as (select sum(a) over (order by v) / cast(sum(a) over () as double) as fa, sum(b) over (order by v) / cast(sum(b) over () as double) as fb, sum(a) over () as n1, sum(b) over () as n2 from h),
k as (select cast(max(n1) as bigint) as n1, cast(max(n2) as bigint) as n2, max(abs(fa - fb)) as d0, round(cast(max(n1) as double) * max(n2) / (max(n1) + max(n2))) as m from c)
select n1, n2, round(d0, 6) as d, round({ks_two_sided_p("d0", "m")}, 6) as p from k"""


def _spearman(by: str = "") -> str:
    part, comma = (f"partition by {by}", f"{by}, ") if by else ("", "")
    return f"""k as (select {comma}rank() over ({part} order by rating) + (count(*) over (partition by {comma}rating) - 1) / 2e0 as rx,
  rank() over ({part} order by score) + (count(*) over (partition by {comma}score) - 1) / 2e0 as ry from v_scores),
sp as (select {comma}count(*) as n, corr(rx, ry) as rho from k {'group by ' + by if by else ''})"""


DAILY = "d as (select grp, day, round(avg(score), 6) as x, count(*) as m from v_daily group by all), i as (select grp, x, row_number() over (partition by grp order by day) - 1 as i from d)"
PAIRS = DAILY + ", p as (select a.grp, a.i, b.i as j, a.x, b.x as y from i a join i b on a.grp = b.grp and a.i < b.i)"
SEN = _with(
    """select s.grp, round(slope, 6) as slope, round(mx - mi * slope, 6) as intercept from (select grp, median((y - x) / (j - i)) as slope from p group by grp) s
join (select grp, median(x) as mx, median(i) as mi from i group by grp) m on s.grp = m.grp""",
    PAIRS,
)


SEED_ROWS = "(select * from (values " + ", ".join("('{}', '{}')".format(lang, text.replace("'", "''")) for lang, text in SEEDS.items()) + ") x(lang, text))"
#: The table of the usual CRC of 32 bits, from its polynomial.
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(cast(i as bigint), range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end))"


def _detected(train: str) -> str:
    """v_lang: id and detected, the language of each of v_docs by profiles counted from ``train`` (lang, text)."""
    said = r"string_split(' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ', '')"
    runs = " union all ".join(f"select {{0}}, {n} as n, unnest(list_transform(range(1, greatest(len(c) - {n - 2}, 1)), lambda i: {' || '.join(f'c[i + {k}]' for k in range(n))})) as g from {{1}}" for n in langid.ORDERS)
    return f"""lc as (select lang, {said} as c from {train} t where lang is not null and text is not null),
dc as (select id, {said} as c from v_docs where text is not null),
lg as materialized (select lang, n, g, count(*) as m from ({runs.format("lang", "lc")}) group by all),
dg as materialized (select id, g, count(*) as m from ({runs.format("id", "dc")}) group by all),
crc as materialized (select {CRC_TABLE} as t),
h as materialized (select g, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(octet_length(encode(g))), lambda k: cast(('0x' || hex(encode(g))[2 * k + 1:2 * k + 2]) as bigint))),
  lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), cast(4294967295 as bigint)) % {langid.BUCKETS} as bucket from (select g from lg union select g from dg), crc),
lw as materialized (select lang, bucket, sum(cast(round({langid.SCALE} * ln(1 + m * {langid.PER}e0 / total / {langid.FLOOR})) as bigint)) as w from (
  select lang, n, bucket, sum(m) as m, sum(sum(m)) over (partition by lang, n) as total from lg join h using (g) group by lang, n, bucket) group by lang, bucket),
ls as (select id, lang, sum(m * w) as s from dg join h using (g) join lw using (bucket) group by all),
v_lang as (select id, case when s > 0 and not tied and 1 / p >= {langid.LEAST} then lang end as detected from (
  select id, any_value(lang) filter (s = top) as lang, any_value(top) as s, count(*) filter (s = top) > 1 as tied,
    sum(exp((s - top) / ({langid.SCALE} * {langid.TEMPER}))) + (any_value(k) - count(*)) * exp(-any_value(top) / ({langid.SCALE} * {langid.TEMPER})) as p
  from (select *, max(s) over (partition by id) as top, (select count(distinct lang) from lw) as k from ls) group by id))"""


def two_sided_p(z: str) -> str:
    """Two-sided normal probability, by a power series near 0 and a continued fraction beyond."""
    down = "list_transform(range(1, 121), lambda i: cast(121 - i as double))"
    density = f"(exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()))"
    series = f"list_reduce(list_prepend(1e0, {down}), lambda t, k: 1 + ({z}) * ({z}) / (2 * k + 1) * t)"
    fraction = f"list_reduce(list_prepend(0e0, {down}), lambda t, k: k / (abs({z}) + t))"
    return f"(case when abs({z}) < 2 then 1 - 2 * {density} * abs({z}) * {series} else 2 * {density} / (abs({z}) + {fraction}) end)"


def t_two_sided_p(t: str, v: str) -> str:
    """Two-sided t probability: the density after t = sqrt(v) tan(a), summed by Simpson's rule from a to where nothing is left."""
    a, v = f"atan(abs({t}) / sqrt({v}))", f"cast({v} as double)"
    h = f"((least(pi() / 2, {a} + 40 / sqrt({v})) - {a}) / 2000)"
    f = f"(case when k in (0, 2000) then 1 when k % 2 = 1 then 4 else 2 end) * exp(({v} - 1) * ln(greatest(cos({a} + k * {h}), 1e-300)))"
    return f"(2 * exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2)) / sqrt(pi()) * list_sum(list_transform(range(0, 2001), lambda k: {f})) * {h} / 3)"


def ks_two_sided_p(d: str, n: str) -> str:
    """Twice Smirnov's one-sided sum, each term by itself."""
    part = f"exp(lgamma({n} + 1) - lgamma(j + 1) - lgamma({n} - j + 1) + (j - 1) * ln({d} + j / {n}) + case when j < {n} then ({n} - j) * ln(1 - {d} - j / {n}) else 0 end)"
    return f"least(1, 2 * {d} * list_sum(list_transform(range(0, cast(floor({n} * (1 - {d})) as bigint) + 1), lambda j: case when j < {n} and 1 - {d} - j / {n} <= 0 then 0 else {part} end)))"


def _holm() -> str:
    exact = _mann_whitney("v_scores", "score", "grp", "1-URGENT", "5-LOW", "yr", exact=True)
    return f"""{_inner("w", exact)}, p as (select yr, {two_sided_p("z")} as p from w),
o as (select *, row_number() over (order by p) as r, count(*) over () as m from p),
a as (select yr, p, max(least(1e0, p * (m - r + 1))) over (order by p) as p_adj from o)"""


OLS = """select {g} count(*) as n, regr_slope(score, yr) as slope, regr_intercept(score, yr) as intercept, regr_r2(score, yr) as r2,
  regr_sxx(score, yr) as sxx, regr_syy(score, yr) as syy, regr_syy(score, yr) - regr_slope(score, yr) * regr_sxy(score, yr) as sse, avg(yr) as xm, avg(score) as ym from v_scores"""
INTERACTION = f"""f as ({OLS.format(g='grp,')} where grp in ('1-URGENT', '5-LOW') group by grp),
b as (select * from f where grp = '1-URGENT'), c as (select * from f where grp = '5-LOW'),
w as (select b.n + c.n as n, (b.sse + c.sse) / (b.n + c.n - 4) as s2, b.intercept as i0, c.intercept as i1, b.slope as k0, c.slope as k1,
  1e0 / b.sxx as vs0, 1e0 / c.sxx as vs1, 1e0 / b.n + b.xm ** 2 / b.sxx as vi0, 1e0 / c.n + c.xm ** 2 / c.sxx as vi1,
  1 - (b.sse + c.sse) / (b.syy + c.syy + b.n * c.n / cast(b.n + c.n as double) * (b.ym - c.ym) ** 2) as r2 from b, c),
t as (select 'Intercept' as term, i0 as coef, sqrt(s2 * vi0) as se, n, r2 from w
  union all select 'C(grp)[T.5-LOW]', i1 - i0, sqrt(s2 * (vi0 + vi1)), n, r2 from w
  union all select 'yr', k0, sqrt(s2 * vs0), n, r2 from w
  union all select 'yr:C(grp)[T.5-LOW]', k1 - k0, sqrt(s2 * (vs0 + vs1)), n, r2 from w)"""
SUMMARY = """g as (select c as grp, cast(y as int) as yr from unnest(['1-URGENT', '5-LOW', 'absent']) a(c), range(1994, 2003) b(y)),
n as (select grp, yr, count(*) as n from v_scores group by all),
m as (select g.grp, g.yr, coalesce(n.n, 0) as population_count from g left join n on g.grp = n.grp and g.yr = n.yr)"""
SUMMARY_ROWS = "select grp, yr, population_count, least(population_count, 400) as sampled_count, cast(400 as bigint) as target_count, cast(greatest(0, 400 - population_count) as bigint) as shortfall from m"
CONFUSION = "c as (select \"true\", pred, count(*) as n from v_labelled group by all), x as (select g.\"true\", g.pred, coalesce(c.n, 0) as n from " + GRID + " g left join c on g.\"true\" = c.\"true\" and g.pred = c.pred)"
CONFUSION_BY = "c as (select grp, \"true\", pred, count(*) as n from v_labelled group by all), x as (select q.grp, g.\"true\", g.pred, coalesce(c.n, 0) as n from (select distinct grp from v_labelled) q cross join " + GRID + " g left join c on q.grp = c.grp and g.\"true\" = c.\"true\" and g.pred = c.pred)"
LABEL_LIST = "['negative', 'neutral', 'positive']"
CONFUSION_SETS = "s as (select case when grouping(grp) = 1 then 'all' else 'each' end as scope, grp, \"true\", pred, count(*) as n from v_labelled group by grouping sets ((grp, \"true\", pred), (\"true\", pred))), x as (select q.scope, q.grp, g.\"true\", g.pred, coalesce(s.n, 0) as n from (select distinct scope, grp from s) q cross join " + GRID + " g left join s on q.scope = s.scope and q.grp is not distinct from s.grp and g.\"true\" = s.\"true\" and g.pred = s.pred)"
RHO_P = t_two_sided_p("rho * sqrt((n - 2) / (1 - rho * rho))", "(n - 2)")
METRICS = """t as (select {g} "true" as label, sum(n) as support, sum(n) filter ("true" = pred) as hits from x group by all),
q as (select {g} pred as label, sum(n) as predicted from x group by all),
f as (select {tg} t.label, support, coalesce(hits / nullif(predicted, 0), 0) as p, coalesce(hits / nullif(support, 0), 0) as r from t join q on t.label = q.label {on})"""
COUNTS = "y as (select term, count(*) as df, coalesce(sum(tf) filter (grp = 'user'), 0) as y_i, coalesce(sum(tf) filter (grp = 'assistant'), 0) as y_j from v_terms group by term)"


def _log_odds(source: str) -> str:
    return f"""w as (select *, sum(y_i) over () as n_i, sum(y_j) over () as n_j, sum(alpha) over () as a_0 from {source}),
e as (select term, y_i, y_j, alpha, ln((y_i + alpha) / cast(n_i + a_0 - y_i - alpha as double)) - ln((y_j + alpha) / cast(n_j + a_0 - y_j - alpha as double)) as delta,
  1e0 / (y_i + alpha) + 1e0 / (y_j + alpha) as sigma2 from w),
fw as (select term, cast(y_i as bigint) as y_i, cast(y_j as bigint) as y_j, cast(alpha as bigint) as alpha, round(delta, 6) as delta, round(sigma2, 6) as sigma2, round(delta / sqrt(sigma2), 6) as z from e)"""


FW = COUNTS + ", k as (select *, y_i + y_j as alpha from y where df >= 10)"
TOP = "tb as ((select term, z, 'user' as distinctive_of from fw order by z desc, term limit 25) union all (select term, z, 'assistant' from fw order by z, term limit 25))"
DOMINANCE = """h as (select score as v, count(*) filter (grp = 'A') as a, count(*) filter (grp = 'R') as b from v_ties where grp in ('A', 'R') group by 1),
q as (select cast(sum(x.a * y.b) as bigint) as n_pairs, cast(sum(x.a * y.b) filter (x.v > y.v) as bigint) as wins, cast(sum(x.a * y.b) filter (x.v < y.v) as bigint) as losses from h x, h y)"""


def _clean(source: str) -> str:
    return f"""c0 as (select page_id as id, replace(replace(replace(replace(html, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') as t from {source}),
c1 as (select id, regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '\\[\\[ASIN:[^\\]]*\\]\\]', ' ', 'g') as t from c0),
c2 as (select id, regexp_replace(regexp_replace(translate(t, 'â’‘', ''''''''), '{WS}+', ' ', 'g'), '^ +| +$', '', 'g') as t from c1)"""


def _lexicon() -> str:
    from quillspark.plans.queries import LEXICON

    return "l as (select * from (values " + ", ".join(f"('{w}', {v}e0)" for w, v in LEXICON.items()) + ") x(word, valence))"


def _rules() -> str:
    """The sentiment rules over windows: each word is joined with the three words before it, whatever they are."""
    from quillspark.functions import sentiment as m
    from quillspark.plans.queries import LEXICON

    rated = LEXICON | {p.replace(" ", "_"): v for p, v in m.IDIOMS.items()}
    listed = lambda words: ", ".join(f"'{w}'" for w in words)
    text = rf"regexp_replace(coalesce(text, ''), '({m._EMOJI})', ' \1 ', 'g')"
    for phrase in m.IDIOMS:
        text = f"regexp_replace({text}, '(?i)\\b{phrase}\\b', '{phrase.replace(' ', '_')}', 'g')"
    bare = rf"regexp_replace(w, '^{m._PUNCTUATION}+|{m._PUNCTUATION}+$', '', 'g')"
    boost = "case word " + " ".join(f"when '{w}' then {b}e0" for w, b in m.BOOSTERS.items()) + " else 0e0 end"
    step = ""
    for k in (1, 2, 3):
        nearer = [f"coalesce(w{j}, '')" for j in range(1, k)]
        among = lambda names, nearer=tuple(nearer): "(" + " or ".join([f"{w} in ({listed(names)})" for w in nearer] or ["false"]) + ")"
        step += f"""s{k} as (select *, (v{k - 1} + case when w{k} is not null and x{k} is null then sign(v{k - 1}) * (o{k} + case when o{k} <> 0 and u{k} and mixed then {m.CAPITALS} else 0 end) * {m.FADE[k - 1]} else 0 end)
            * case when w{k} is null or x{k} is not null then 1 when w{k} = 'never' and {among(("so", "this"))} then {m.NEVER_SO} when w{k} = 'without' and {among(("doubt",))} then 1 when g{k} then {m.NEGATED} else 1 end as v{k} from s{k - 1}), """
    lags = ", ".join(f"lag({c}, {k}) over z as {a}{k}" for k in (1, 2, 3) for c, a in (("word", "w"), ("valence", "x"), ("boost", "o"), ("negates", "g"), ("upper", "u")))
    return _with(
        f"""select id, round(coalesce(down / nullif(everything, 0), 0), 6) as neg, round(coalesce(rest / nullif(everything, 0), 0), 6) as neu, round(coalesce(up / nullif(everything, 0), 0), 6) as pos, round(total / sqrt(total * total + {m.ALPHA}), 6) as compound
        from (select id, total + sign(total) * emphasis as total, n - hits as rest, up0 + case when up0 > down0 then emphasis else 0 end as up, down0 + case when up0 < down0 then emphasis else 0 end as down,
          n - hits + up0 + down0 + case when up0 <> down0 then emphasis else 0 end as everything from (
          select t.id, any_value(len(w)) as n, any_value(emphasis) as emphasis, coalesce(sum(v), 0) as total, count(v) filter (v <> 0) as hits, coalesce(sum(v + 1) filter (v > 0), 0) as up0, -coalesce(sum(v - 1) filter (v < 0), 0) as down0 from t left join f on t.id = f.id group by t.id))""",
        f"""t0 as (select id, coalesce(text, '') as text, list_transform(list_filter(regexp_split_to_array({text}, '{WS}+'), lambda w: w <> ''), lambda w: case when length({bare}) > 2 then {bare} else w end) as w from v_turns),
t as (select *, len(list_filter(w, lambda x: regexp_matches(x, '\p{{Lu}}') and not regexp_matches(x, '\p{{Ll}}'))) as us,
  least(length(text) - length(replace(text, '!', '')), {m.MOST_EXCLAMATIONS}) * {m.EXCLAMATION} + case when length(text) - length(replace(text, '?', '')) > 3 then {m.MANY_QUESTIONS} when length(text) - length(replace(text, '?', '')) > 1 then (length(text) - length(replace(text, '?', ''))) * {m.QUESTION} else 0 end as emphasis from t0),
e as (select id, us > 0 and us < len(w) as mixed, unnest(w) as raw, unnest(range(len(w))) as at_ from t),
l as (select * from (values {", ".join(f"('{w}', {v}e0)" for w, v in rated.items())}) x(word, valence)),
c as (select id, mixed, at_, lower(raw) as word, valence, {boost.replace("word", "lower(raw)", 1)} as boost, lower(raw) in ({listed(m.NEGATIONS)}) or lower(raw) like '%n''t' as negates, regexp_matches(raw, '\p{{Lu}}') and not regexp_matches(raw, '\p{{Ll}}') as upper
  from e left join l on lower(raw) = l.word),
g as (select *, min(at_) filter (word = 'but') over (partition by id) as but_at, {lags} from c window z as (partition by id order by at_)),
s0 as (select *, valence + case when upper and mixed then sign(valence) * {m.CAPITALS} else 0 end as v0 from g where valence <> 0),
{step}f as (select id, v3 * case when w1 = 'least' and x1 is null and coalesce(w2, '') not in ('at', 'very') then {m.NEGATED} else 1 end * case when at_ < but_at then {m.BEFORE_BUT} when at_ > but_at then {m.AFTER_BUT} else 1 end as v from s3)""",
    )


def oracle_sql() -> dict[str, str]:
    terms, stop = _terms(), _kept()
    clean = _with("select id, md5(t) as clean_md5, length(t) as n_chars from c2", _clean("pages"))
    return {
        "src_parquet": "select o_orderkey, o_orderpriority, round(o_totalprice, 2) as o_totalprice from orders",
        "src_jsonl": _with('select rating, title, md5(text) as text_md5, "timestamp", helpful_vote, verified_purchase from v_reviews'),
        "sink_parquet": _with("select id, yr, round(score, 4) as score from v_scores"),
        "sink_csv": _with("select grp, yr, count(score) as n, round(avg(score), 6) as mean from v_scores group by all"),
        "sink_json": _with("select grp, yr, count(score) as n, round(avg(score), 6) as mean from v_scores group by all"),
        "stage_cache": _with('select grp, yr, count(*) as population, false as before, true as same, false as other from v_scores group by all'),
        "parse_record": _with("select 'A' as category, year, rating, title, md5(text) as text_md5, helpful_vote, verified_purchase, \"timestamp\" from v_parsed", PARSED),
        "epoch_year": _with(f"select doc_id, {YEAR_OF} as year from v_reviews"),
        "year_range": _with("select year, count(*) as n from v_parsed where year between 2016 and 2019 group by year", PARSED),
        "drop_empty": _with(f"select doc_id from v_reviews where {STRIPPED} <> ''"),
        "concat_title": _with("select doc_id, md5(case when trim(coalesce(title, '')) <> '' then trim(title) || '. ' || text else text end) as joined_md5 from v_reviews"),
        "fast_reject": _with(f"select id from v_docs where {ASCII} >= 0.85"),
        "lang_en": _with(f"select id, lang from v_docs join v_lang using (id) where {ASCII} >= 0.85 and detected = 'en'", _detected(SEED_ROWS)),
        "lang_detect": _with("select id, lang, detected from v_docs left join v_lang using (id)", _detected("v_docs")),
        "group_filter": _with("select grp, yr, count(*) as n, round(sum(score), 6) as total from v_scores group by all"),
        "label_filter": _with('select id, "true" from v_labelled where "true" <> \'neutral\''),
        "mismatch_pred": _with(f"select id, {MISMATCH} as kind from v_scores where {MISMATCH} is not null"),
        "shortfall_filter": _with(f"select * from ({SUMMARY_ROWS}) where shortfall > 0", SUMMARY),
        "term_regex": _with(f"select term, round(coef, 6) as coef, round(se, 6) as se, n, round(r2, 6) as r2, round({t_two_sided_p('coef / se', '(n - 4)')}, 6) as p from t where regexp_matches(term, 'yr.*LOW|LOW.*yr')", INTERACTION),
        "col_select": _with("select id, grp, yr, rating from v_scores"),
        "reservoir": _with(f"select id, grp, yr from (select *, row_number() over (partition by grp, yr order by {HASHED}, id) as r from v_scores) where r <= 20"),
        "streaming_sample": _with(f"select id, grp, yr from (select *, row_number() over (partition by grp, yr order by {HASHED}, id) as r from v_scores) where r <= 20"),
        "pop_count": _with("select grp, yr, count(*) as population from v_scores group by all"),
        "equal_cells": _with(f"select id, grp, yr from (select *, row_number() over (partition by grp, yr order by {HASHED}, id) as r from v_scores) where r <= (select min(n) from (select count(*) as n from v_scores group by grp, yr))"),
        "sampling_summary": _with(SUMMARY_ROWS, SUMMARY),
        "mismatch_sample": _with(f"select id, grp, kind from (select *, row_number() over (partition by grp, kind order by {HASHED}, id) as r from (select *, {MISMATCH} as kind from v_scores) where kind is not null) where r <= 50"),
        "dedupe": _with("select id from (select id, row_number() over (partition by category, lang, text order by id) as r from v_docs) where r = 1"),
        "stage_log": _with(
            f"""select step, cast(n as bigint) as rows_remaining, cast(lag(n, 1, n) over (order by i) - n as bigint) as rows_dropped from (
            select 0 as i, 'start' as step, count(*) as n from v_docs union all select 1, 'ascii', count(*) from v_docs where {ASCII} >= 0.85
            union all select 2, 'english', count(*) from v_docs where {ASCII} >= 0.85 and lang = 'en'
            union all select 3, 'long', count(*) from v_docs where {ASCII} >= 0.85 and lang = 'en' and length(text) > 500)"""
        ),
        "vocab_align": _with("select term, cast(y_i as bigint) as y_i, cast(y_j as bigint) as y_j from y", terms, COUNTS),
        "star_map": _with("select id, case when trunc(rating - 0.1) in (4, 5) then 'positive' when trunc(rating - 0.1) in (1, 2) then 'negative' else 'neutral' end as label from v_scores"),
        "cat_dim": _with("select case category when 'A' then 'even_sources' else 'odd_sources' end as file_name, count(*) as n from v_docs group by 1"),
        "mask_align": _with(f"select id, {ASCII} >= 0.85 and coalesce(detected = 'en', false) as kept from v_docs left join v_lang using (id)", _detected(SEED_ROWS)),
        "pairwise_dominance": _with("select n_pairs, wins, losses, round((wins - losses) / cast(n_pairs as double), 6) as delta from q", DOMINANCE),
        "cliffs_delta": _with("select round((wins - losses) / cast(n_pairs as double), 6) as delta from q", DOMINANCE),
        "sen_pairs": SEN,
        "sens_slope": SEN,
        "lexicon_join": _with(
            f"""select v.id, coalesce(hits, 0) as hits, round(coalesce(s, 0), 6) as valence, round(coalesce(s, 0) / sqrt(coalesce(s, 0) ** 2 + 15), 6) as compound from v_docs v
            left join (select id, count(*) as hits, sum(valence) as s from (select id, unnest({WORDS}) as word from v_docs) join l using (word) group by id) h on v.id = h.id""",
            _lexicon(),
        ),
        "stopword_anti": _with("select id, len(w) as n, md5(array_to_string(w, ' ')) as words_md5 from (select id, " + stop + " as w from v_turns)"),
        "grid_left": _with("select grp, yr, population_count from m", SUMMARY),
        "union_all": _with("select id, grp from v_scores where grp in ('1-URGENT', '5-LOW')"),
        "set_difference": _with("select distinct lang from v_docs where lang <> 'en'"),
        "value_counts": _with("select pred as value, count(*) as n from v_labelled group by 1"),
        "value_counts_norm": _with("select pred as value, round(count(*) / cast(sum(count(*)) over () as double), 6) as share from v_labelled group by 1"),
        "label_distribution": _with(
            """select grp, label_source, count(*) filter (label = 'positive') as positive, count(*) filter (label = 'neutral') as neutral, count(*) filter (label = 'negative') as negative, count(label) as total
            from (select grp, 'true' as label_source, "true" as label from v_labelled union all select grp, 'pred', pred from v_labelled) group by all"""
        ),
        "describe": _with("select grp, count(score) as n, round(avg(score), 6) as mean, round(stddev_samp(score), 6) as std, round(min(score), 6) as min, round(quantile_cont(score, 0.25), 6) as q25, round(median(score), 6) as q50, round(quantile_cont(score, 0.75), 6) as q75, round(max(score), 6) as max from v_scores group by grp"),
        "group_vc": _with("select category, yr, count(*) as n from v_docs group by all"),
        "descriptives": _with(
            """select grp, count(*) as n, round(avg(score), 6) as mean, round(median(score), 6) as median, round(stddev_pop(score), 6) as std, round(quantile_cont(score, 0.75) - quantile_cont(score, 0.25), 6) as iqr,
            round(100e0 * count(*) filter (pred = 'positive') / count(*), 6) as pct_positive, round(100e0 * count(*) filter (pred = 'neutral') / count(*), 6) as pct_neutral, round(100e0 * count(*) filter (pred = 'negative') / count(*), 6) as pct_negative from v_labelled group by grp"""
        ),
        "yearly_means": _with("select grp, yr, count(score) as n, round(avg(score), 6) as mean from v_scores group by all"),
        "confusion": _with('select "true", pred, n from x', CONFUSION),
        "confusion_norm": _with('select grp, "true", pred, n, round(n / nullif(cast(sum(n) over (partition by grp, "true") as double), 0), 6) as row_share from x', CONFUSION_BY),
        "confusion_with_total": _with('select scope, grp, "true", pred, n, round(n / nullif(cast(sum(n) over (partition by scope, grp, "true") as double), 0), 6) as row_share from x', CONFUSION_SETS),
        "agreement_with_total": _with(
            f"""select m.scope, m.grp, m.n, m.accuracy, macro_f1, kappa, label as majority, round(share, 6) as share from
            (select scope, grp, cast(sum(n) as bigint) as n, round(sum(n) filter ("true" = pred) / cast(sum(n) as double), 6) as accuracy from x group by all) m
            join (select scope, grp, round(avg(coalesce(2e0 * hits / nullif(t + p, 0), 0)), 6) as macro_f1 from (select scope, grp, label, sum(hits) as hits, sum(t) as t, sum(p) as p from (
              select scope, grp, "true" as label, n as t, 0 as p, case when "true" = pred then n else 0 end as hits from x union all select scope, grp, pred, 0, n, 0 from x) group by all) group by scope, grp) f on m.scope = f.scope and m.grp is not distinct from f.grp
            join (select scope, grp, round(1 - sum(d * n) / sum(d * rn * cn / cast(tn as double)), 6) as kappa from (select scope, grp, n, (list_position({LABEL_LIST}, "true") - list_position({LABEL_LIST}, pred)) ** 2 as d,
              sum(n) over (partition by scope, grp, "true") as rn, sum(n) over (partition by scope, grp, pred) as cn, sum(n) over (partition by scope, grp) as tn from x) group by scope, grp) k on m.scope = k.scope and m.grp is not distinct from k.grp
            join (select scope, grp, label, n / cast(tn as double) as share from (select scope, grp, "true" as label, sum(n) as n, sum(sum(n)) over (partition by scope, grp) as tn, row_number() over (partition by scope, grp order by sum(n) desc, "true") as r from x group by scope, grp, "true") where r = 1) j
              on m.scope = j.scope and m.grp is not distinct from j.grp""",
            CONFUSION_SETS,
        ),
        "term_counts": _with("select grp, term, cast(sum(tf) as bigint) as n from v_terms group by all", terms),
        "doc_freq": _with("select term, count(*) as df, cast(sum(tf) as bigint) as tf from v_terms group by term having count(*) >= 10", terms),
        "unique_years": _with("select distinct yr from v_scores"),
        "bool_mean": _with('select grp, round(avg(case when "true" = pred then 1e0 else 0 end), 6) as accuracy from v_labelled group by grp'),
        "mannwhitney": _split(_mann_whitney("v_scores", "score", "grp", "1-URGENT", "5-LOW")),
        "mannwhitney_ties": _split(_mann_whitney("v_ties", "score", "grp", "A", "R")),
        "mannwhitney_yearly": _split(_mann_whitney("v_scores", "score", "grp", "1-URGENT", "5-LOW", "yr")),
        "mannwhitney_wide": _split(_mann_whitney("lineitem", "l_extendedprice", "l_returnflag", "A", "R")),
        "rank_biserial": _with("select delta as r from mw", _inner("mw", _mann_whitney("v_scores", "score", "grp", "1-URGENT", "5-LOW"))),
        "ks_2samp": _split(_ks("v_scores", "score", "grp", "1-URGENT", "5-LOW")),
        "ks_2samp_wide": _split(_ks("lineitem", "l_extendedprice", "l_returnflag", "A", "R")),
        "holm": _with("select yr, round(p, 6) as p, round(p_adj, 6) as p_adj, p_adj < 0.05 as significant from a", _holm()),
        "sig_flag": _with("select yr, case when p_adj < 0.05 then 'yes' else 'no' end as answer from a", _holm()),
        "mann_kendall": _with(
            f"""select s.grp, n, s, round(v, 6) as var_s, round(s / (n * (n - 1) / 2e0), 6) as tau, round((s - sign(s)) / sqrt(v), 6) as z, round({two_sided_p("((s - sign(s)) / sqrt(v))")}, 6) as p from (select grp, cast(sum(sign(y - x)) as bigint) as s from p group by grp) s
            join (select grp, cast(sum(t) as bigint) as n, (sum(t) * (sum(t) - 1) * (2 * sum(t) + 5) - sum(t * (t - 1) * (2 * t + 5))) / 18e0 as v from (select grp, x, count(*) as t from i group by all) group by grp) t on s.grp = t.grp""",
            PAIRS,
        ),
        "ols_simple": _with(f"select grp, n, round(slope, 6) as slope, round(intercept, 6) as intercept, round(r2, 6) as r2, round(sqrt(sse / (n - 2) / sxx), 6) as se, round({t_two_sided_p('slope / sqrt(sse / (n - 2) / sxx)', '(n - 2)')}, 6) as p from ({OLS.format(g='grp,')} group by grp)"),
        "ols_interaction": _with(f"select term, round(coef, 6) as coef, round(se, 6) as se, n, round(r2, 6) as r2, round({t_two_sided_p('coef / se', '(n - 4)')}, 6) as p from t", INTERACTION),
        "spearman": _with(f"select n, round(rho, 6) as rho, round({RHO_P}, 6) as p from sp", _spearman()),
        "spearman_grouped": _with(f"select grp, n, round(rho, 6) as rho, round({RHO_P}, 6) as p from sp", _spearman("grp")),
        "spearman_ci": _with("select round(tanh(atanh(rho) - 1.959963984540054 / sqrt(n - 3)), 6) as ci_lo, round(tanh(atanh(rho) + 1.959963984540054 / sqrt(n - 3)), 6) as ci_hi from sp", _spearman()),
        "classification_metrics": _with("select label, cast(support as bigint) as support, round(p, 6) as precision, round(r, 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1 from f", CONFUSION, METRICS.format(g="", tg="", on="")),
        "agreement_overall": _with(
            """select f.grp, cast(any_value(n) as bigint) as n, round(any_value(acc), 6) as accuracy, round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 6) as macro_f1 from f
            join (select grp, sum(n) as n, sum(n) filter ("true" = pred) / cast(sum(n) as double) as acc from x group by grp) o on f.grp = o.grp group by f.grp""",
            CONFUSION_BY,
            METRICS.format(g="grp,", tg="t.grp,", on="and t.grp = q.grp"),
        ),
        "kappa_quadratic": _with(
            """select grp, round(1 - sum(d * n) / sum(d * rn * cn / cast(tn as double)), 6) as kappa from (select grp, n, (list_position(['negative', 'neutral', 'positive'], "true") - list_position(['negative', 'neutral', 'positive'], pred)) ** 2 as d,
            sum(n) over (partition by grp, "true") as rn, sum(n) over (partition by grp, pred) as cn, sum(n) over (partition by grp) as tn from x) group by grp""",
            CONFUSION_BY,
        ),
        "majority_baseline": _with(
            """select grp, label, round(n / cast(t as double), 6) as share from (select *, sum(n) over (partition by grp) as t, row_number() over (partition by grp order by n desc, label) as r
            from (select grp, "true" as label, count(*) as n from v_labelled group by all)) where r = 1"""
        ),
        "chi2_2x2": _with(
            f"""select a_hit, a_miss, b_hit, b_miss, round(chi2, 6) as chi2, round({two_sided_p("sqrt(chi2)")}, 6) as p from (select *, (a_hit + a_miss + b_hit + b_miss) * greatest(0, abs(cast(a_hit as double) * b_miss - cast(a_miss as double) * b_hit) - (a_hit + a_miss + b_hit + b_miss) / 2e0) ** 2
            / (cast(a_hit + a_miss as double) * (b_hit + b_miss) * (a_hit + b_hit) * (a_miss + b_miss)) as chi2 from (select count(*) filter (grp = '1-URGENT' and h) as a_hit, count(*) filter (grp = '1-URGENT' and not h) as a_miss,
            count(*) filter (grp = '5-LOW' and h) as b_hit, count(*) filter (grp = '5-LOW' and not h) as b_miss from (select grp, "true" = pred as h from v_labelled)))"""
        ),
        "agreement_by_length": _with(
            f"""select bucket, n, round(a, 6) as accuracy, round((a + zz / (2 * n) - sqrt(zz) * sqrt(a * (1 - a) / n + zz / (4e0 * n * n))) / (1 + zz / n), 6) as ci_lo, round((a + zz / (2 * n) + sqrt(zz) * sqrt(a * (1 - a) / n + zz / (4e0 * n * n))) / (1 + zz / n), 6) as ci_hi
            from (select bucket, count(*) as n, avg(case when "true" = pred then 1e0 else 0 end) as a, 1.959963984540054e0 ** 2 as zz from (select case when t <= 0 then null when t <= 5 then '≤5' when t <= 20 then '6–20' when t <= 50 then '21–50' else '>50' end as bucket,
              case when rating in (4, 5) then 'positive' when rating in (1, 2) then 'negative' else 'neutral' end as "true", case when c >= 0.05 then 'positive' when c <= -0.05 then 'negative' else 'neutral' end as pred
              from (select v.id, rating, len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')) as t, round(coalesce(s, 0) / sqrt(coalesce(s, 0) ** 2 + 15), 6) as c from v_docs v
              left join (select id, sum(valence) as s from (select id, unnest({WORDS}) as word from v_docs) join l using (word) group by id) h on v.id = h.id))
            where bucket is not null group by bucket)""",
            _lexicon(),
        ),
        "mismatch_counts": _with(f"select grp, count(*) filter (k = 'high_star_negative') as high_star_negative, count(*) filter (k = 'low_star_positive') as low_star_positive from (select grp, {MISMATCH} as k from v_scores) group by grp"),
        "clean_text": clean,
        "clean_text_native": clean,
        "ascii_ratio": _with(f"select id, round({ASCII}, 6) as ratio from v_docs"),
        "text_lengths": _with(f"select id, length(text) as char_len, len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')) as token_len from v_docs"),
        "tokenise": _with(f"select id, len(w) as n, md5(array_to_string(w, ' ')) as words_md5 from (select id, {WORDS} as w from v_docs)"),
        "ngrams": _with("select id, len(g) as n, md5(array_to_string(g, '|')) as grams_md5 from v_grams", terms),
        "vocab_prune": _with("select term, count(*) as df, cast(sum(tf) as bigint) as tf from v_terms group by term having count(*) >= 10 order by sum(tf) desc, term limit 100", terms),
        "fighting_words": _with("select * from fw", terms, FW, _log_odds("k")),
        "fw_prior": _with("select * from fw", terms, COUNTS, "k0 as (select term, y_i, y_j from y where df >= 10), a as (select term, 2 * sum(tf) as alpha from v_terms group by term), k as (select a.term, coalesce(y_i, 0) as y_i, coalesce(y_j, 0) as y_j, alpha from a left join k0 on a.term = k0.term where alpha >= 20)", _log_odds("k")),
        "top_bottom_k": _with("select * from tb", terms, FW, _log_odds("k"), TOP),
        "tfidf_top": _with(
            """select "group", term, round(m, 6) as mean_tfidf from (select grp as "group", term, sum(w) / any_value(n_group) as m, row_number() over (partition by grp order by sum(w) / any_value(n_group) desc, term) as r from (
            select grp, id, term, n_group, w0 / sqrt(sum(w0 * w0) over (partition by id)) as w from (select t.grp, t.id, t.term, g.n_group, tf * (ln((1e0 + g.n_all) / (1 + df)) + 1) as w0 from v_terms t
            join (select term, count(*) as df from v_terms group by term having count(*) >= 10) d on t.term = d.term
            join (select grp, count(*) as n_group, sum(count(*)) over () as n_all from v_turns group by grp) g on t.grp = g.grp)) group by grp, term) where r <= 25""",
            terms,
        ),
        "lexicon_sentiment": _rules(),
        "sql_surface": _with(f"""select gram, count(*) as n, count(distinct id) as docs from (
            select id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as gram from (select id, {WORDS} as w from v_turns where grp = 'user')) group by gram having count(*) >= 5"""),
        "sentiment_label": _with("select id, pred as label from v_labelled"),
        "star_label": _with("select id, case when trunc(id % 12 / 2e0) in (4, 5) then 'positive' when trunc(id % 12 / 2e0) in (1, 2) then 'negative' else 'neutral' end as label from v_scores"),
        "ecdf_points": _with("select grp, v, round(sum(n) over (partition by grp order by v) / cast(sum(n) over (partition by grp) as double), 6) as f from (select grp, score as v, count(*) as n from v_ties group by all)"),
        "box_stats": _with(
            """select s.grp, round(q1, 6) as q1, round(med, 6) as median, round(q3, 6) as q3, round(min(score), 6) as whisker_lo, round(max(score), 6) as whisker_hi from v_scores s
            join (select grp, quantile_cont(score, 0.25) as q1, median(score) as med, quantile_cont(score, 0.75) as q3 from v_scores group by grp) q on s.grp = q.grp
            where score between q1 - 1.5e0 * (q3 - q1) and q3 + 1.5e0 * (q3 - q1) group by all"""
        ),
        "kde_grid": _with(
            """select h.grp, round(x, 6) as x, round(sum(n * exp(-0.5 * ((x - v) / bw) ** 2) / (bw * 2.5066282746310002)) / any_value(all_n), 6) as density from (select grp, score as v, count(*) as n from v_ties group by all) h
            join (select grp, count(*) as all_n, stddev_samp(score) * count(*) ** -0.2e0 as bw from v_ties group by grp) s on h.grp = s.grp, (select cast(i as double) as x from range(0, 51) r(i)) group by h.grp, x"""
        ),
        "word_bars": _with("select row_number() over (order by z, term) as place, term, z, distinctive_of from tb", terms, FW, _log_odds("k"), TOP),
        "rq1": _with(
            "select mw.*, ks.d, round((select avg(score) from v_scores where grp = '1-URGENT'), 6) as mean_1, round((select avg(score) from v_scores where grp = '5-LOW'), 6) as mean_2 from mw, ks",
            _inner("mw", _mann_whitney("v_scores", "score", "grp", "1-URGENT", "5-LOW")),
            _inner("ks", _ks("v_scores", "score", "grp", "1-URGENT", "5-LOW")),
        ),
    }


def _split(parts: str) -> str:
    """A query whose text begins with the bodies of its WITH clause."""
    ctes, _, body = parts.rpartition("\nselect ")
    return _with("select " + body, ctes)


def _inner(name: str, parts: str) -> str:
    ctes, _, body = parts.rpartition("\nselect ")
    return f"{name} as (with {ctes} select {body})"
