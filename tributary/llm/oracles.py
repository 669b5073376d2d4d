"""SQL of those queries that SQL can express, over the same tables."""

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_CHUNKS = r"""with l as (select doc_id, string_split(text, chr(10)) as lines from documents),
u as (select doc_id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as i from l),
f as (select doc_id, i, lead(i) over (partition by doc_id order by i) as j from u where regexp_matches(line, '[^ \t\x0b\f\r]')),
w as (select f.doc_id, i, j, array_to_string(lines[i:j], chr(10)) as body from f join l using (doc_id) where j is not null),
g as (select doc_id, i, j from w qualify row_number() over (partition by body order by doc_id, i) > 1),
x as (select distinct doc_id, unnest(range(i, j + 1)) as i from g),
r as (select doc_id, count(*) as n, count(*) filter (prev is null or i - prev > 1) as chunks from (select doc_id, i, lag(i) over (partition by doc_id order by i) as prev from x) group by 1)
select l.doc_id, cast(coalesce(len(lines), 0) as bigint) as n_lines, coalesce(r.chunks, 0) as chunks_removed, coalesce(r.n, 0) as lines_removed,
 md5(case when r.n is null then array_to_string(lines, chr(10)) else coalesce(k.t, '') end) as clean_md5
 from l left join r using (doc_id) left join (select u.doc_id, string_agg(line, chr(10) order by u.i) as t from u left join x on x.doc_id = u.doc_id and x.i = u.i where x.i is null group by 1) k using (doc_id)"""

NEAR_DUPLICATES = rf"""with recursive w as (select doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
 else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
x as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e as (select a, b from p union all select b, a from p),
r(d, c) as (select a, a from e union select e.b, r.c from r join e on e.a = r.d)
select s.doc_id, cast(len(s) as bigint) as n_shingles, coalesce(m.c, s.doc_id) as component_id, coalesce(m.c, s.doc_id) = s.doc_id as kept
from s left join (select d, min(c) as c from r group by d) m on m.d = s.doc_id"""

_FENCE = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
_VALUES = "\n union all ".join(f"select doc_id, lang, source, '{m}' as metric, floor({a} * 1000 / greatest({b}, 1)) as v, {a} as top, {b} as bottom from b where not base_failed" for m, (a, b) in _FENCE.items())


def _quantile(q: str) -> str:
    return f"coalesce(min(case when bucket = 0 then 0 else round(2 * pow(gamma, bucket - 1) / (1 + gamma), 3) end) filter (run >= ceil(total * {q})), 0)"


def _level(keys: str) -> str:
    by = f"partition by {keys}, metric" if keys else "partition by metric"
    group = f"{keys}, metric" if keys else "metric"
    inner = f"select {group}, bucket, any_value(gamma) as gamma, sum(n) as n from k group by {group}, bucket"
    cum = f"select *, sum(n) over ({by} order by bucket) as run, sum(n) over ({by}) as total from ({inner})"
    low, high = ("(case metric when 'word_length' then {} else {} end)".format(*q) for q in ((0.25, 0.1), (0.75, 0.9)))
    inner = f"select {group}, any_value(total) as total, {_quantile(low)} as low, {_quantile('0.5')} as mid, {_quantile(high)} as high from ({cum}) group by {group}"
    return f"select {group}, total, mid, round(high - mid, 3) as up, round(mid - low, 3) as down from ({inner})"


def _chosen(n: str) -> str:
    return f"case when a.total >= 100 then a.{n} when b.total >= 100 then b.{n} else c.{n} end as {n}"


QUALITY = rf"""with t as (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
g as (select doc_id, i, array_to_string(w[i:i + 2], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from t)),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by doc_id, g) as c from g) where c > 1) group by 1),
b0 as (select t.doc_id, lang, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols,
 len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words from t left join rep on rep.doc_id = t.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b0),
v as ({_VALUES}),
k as (select lang, source, metric, case when v <= 0 then 0 else ceil(round(ln(v) / ln(1.01 / 0.99), 6)) + 1 end as bucket, cast(1.01 as double) / cast(0.99 as double) as gamma, count(*) as n from v group by 1, 2, 3, 4),
q0 as ({_level("lang, source")}), q1 as ({_level("lang")}), q2 as ({_level("")}),
votes as (select metric, count(*) as voters, quantile_disc(up, 0.5) as up, quantile_disc(down, 0.5) as down from q0 where total >= 20 group by 1),
q as (select a.lang, a.source, a.metric, {_chosen("mid")}, {_chosen("up")}, {_chosen("down")}, a.total >= 100 as own, v.voters, v.up as all_up, v.down as all_down
 from q0 a join q1 b on a.lang is not distinct from b.lang and a.metric = b.metric join q2 c on a.metric = c.metric left join votes v on v.metric = a.metric),
fence as (select lang, source, metric, mid + 8 * least(up, 3 * case when voters >= 3 then all_up when own then down end) as hi, mid - 8 * least(down, 3 * case when voters >= 3 then all_down when own then up end) as lo from q),
out_of as (select v.*, hi, lo, greatest(hi, 0) * bottom / 1000 as e_hi, greatest(lo, 0) * bottom / 1000 as e_lo from v join fence q on v.lang is not distinct from q.lang and v.source is not distinct from q.source and v.metric = q.metric),
bad as (select distinct doc_id from out_of where case when metric = 'word_length' then v > hi * (1 + 2 * cast(0.01 as double)) or v < lo * (1 - 2 * cast(0.01 as double))
 else top > e_hi + 5 * sqrt(e_hi + 1) or top < e_lo - 5 * sqrt(e_lo + 1) end)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and doc_id not in (select doc_id from bad) as kept from b"""

_ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATION = rf"""with d as (select doc_id, regexp_extract_all(coalesce({_LOW}, ''), '{_ITEM_WORDS}') as w from documents),
i as (select item_id, regexp_extract_all(coalesce({_LOW}, ''), '{_ITEM_WORDS}') as w from benchmark),
iw as (select distinct item_id, least(len(w), 10) as m, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') as g from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from i where len(w) > 0)),
dw as (select doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') as g from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as k from d, (select distinct m from iw))),
hit as (select doc_id, iw.item_id, k, iw.m from dw join iw on iw.m = dw.m and iw.g = dw.g),
n as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(k, k + m)) as p from hit) group by 1),
it as (select doc_id, count(distinct item_id) as n, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hit group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n.n, 0) as n_hit, coalesce(it.n, 0) as n_items, sha256(coalesce(it.ids, '')) as items_sha256, coalesce(n.n, 0) > 0 as contaminated
from d left join n on n.doc_id = d.doc_id left join it on it.doc_id = d.doc_id"""

_BIT = " + ".join(f"{16 >> k} * cast(substr(bits, cast(5 * i + {k + 1} as bigint), 1) = '1' as integer)" for k in range(5))
WARC = rf"""with p as (select page_id, encode(coalesce(html, '')) as body from pages),
s as (select page_id, octet_length(body) as n, sha1(body) as h from p),
b as (select *, array_to_string(list_transform(range(1, 41), lambda j: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(h, cast(j as bigint), 1)) - 1) + 1, 4)), '') as bits from s),
f as (select *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_BIT}, 1)), '') as digest, min(page_id) over (partition by h) as first from b)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from f"""



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licenses() -> str:
    """The sentence rules of ``licenses`` as SQL: its fixed tables, with each rule a step that uses matches up."""
    from tributary.llm import licenses as L

    known = " ".join(f"when {_quoted(s)} then {_quoted(i)}" for s, i in L.SENTENCES.items())
    version, opening = _quoted(L.VERSION), L._OPENINGS
    cut = lambda c: rf"string_split(regexp_replace({c}, '([.!?])( |\n|$)', concat('\1', chr(10), '\2'), 'g'), chr(10))"
    trimmed = lambda c: rf"list_transform({cut(c)}, lambda s: regexp_replace(trim(s), '[ .:;!?*/]+$', ''))"
    name = f"coalesce(case regexp_replace(regexp_replace(s, {_quoted(L.HOLDER)}, {_quoted(L.ANY_HOLDER)}), {version}, '#', 'g') {known} end, case when regexp_matches(s, {_quoted(L.NAMES)}) then 'UNKNOWN' end)"
    ids = lambda c: f"array_to_string(list_filter(list_transform(list_filter({trimmed(c)}, lambda s: regexp_matches(s, {_quoted(L.ANCHORS)})), lambda s: '|' || {name} || ':' || regexp_extract(s, {version}) || '|'), lambda s: s is not null), '')"
    steps = []
    for k, (rule, licence) in enumerate(L.RULES):
        p = _quoted(L._pattern(rule))
        got = lambda c: f"list_transform(regexp_extract_all({c}, {p}, 1), lambda v: regexp_replace(replace({_quoted(licence)}, '{{v}}', v), '-(-|$)', '\\1', 'g'))"  # noqa: B023, E731
        steps.append(f"r{k + 1} as (select doc_id, ids, regexp_replace(l, {p}, '', 'g') as l, regexp_replace(p, {p}, '', 'g') as p, list_concat(list_concat(f, {got('l')}), {got('p')}) as f from r{k})")
    return rf"""with t as (select doc_id, coalesce(text, '') as text, regexp_matches(lower(coalesce(text, '')), {_quoted(L.ANCHORS)}) as fit from documents),
f as (select doc_id, fit, case when fit then regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(text, '["''`“”‘’]', '', 'g')), '(?m)^[ \t]*(?://+|#+|/?\*+/?|;+|--+)', '', 'g'),
 '[ \t\x0b\f\r]+', ' ', 'g'), '\bv\. (\d)', 'v \1', 'g'), '\b(inc|corp|ltd)\. (nor|and|or)\b', '\1 \2', 'g') else '' end as x from t),
y as (select doc_id, x, replace(regexp_replace(regexp_replace(regexp_replace(x, '\n *\n', chr(1), 'g'), '\n *({opening})', concat(chr(1), '\1'), 'g'), '[ \n]+', ' ', 'g'), chr(1), chr(10)) as y from f),
r0 as (select doc_id, {ids("x")} as ids, {ids("x")} as l, {ids("y")} as p, cast([] as varchar[]) as f from y),
{", ".join(steps)}
select doc_id, ids as identifiers, array_to_string(list_sort(list_distinct(f)), ',') as licenses,
 cast(least(len(regexp_extract_all(l, '\|UNKNOWN:')), len(regexp_extract_all(p, '\|UNKNOWN:'))) as bigint) as unknown from r{len(L.RULES)}"""


ORACLES = {
    "op2_licenses": _licenses(),
    "op3_line_chunks": LINE_CHUNKS,
    "op5_near_duplicates": NEAR_DUPLICATES,
    "op6_quality": QUALITY,
    "op7_decontamination": DECONTAMINATION,
    "op8_warc": WARC,
}
