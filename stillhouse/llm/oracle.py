"""The queries that SQL can express, as DuckDB SQL."""

from __future__ import annotations

from stillhouse.llm import quality

ORACLE: dict[str, str] = {}

ORACLE["op3_suffix_array_dedup"] = """
with hexed as (
    select doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents
), places as (
    select doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) as i from hexed
), windows as (
    select doc_id, i, substr(h, 2 * i + 1, 100) as w from places
), first as (
    select w, min(doc_id) as d from windows group by w
), hits as (
    select doc_id, i from windows join first using (w) where d < doc_id
), stretches as (
    select doc_id, min(i) as a, max(i) + 50 as b
    from (select *, sum(fresh) over (partition by doc_id order by i) as g
        from (select *, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as fresh from hits))
    group by doc_id, g
), sums as (
    select doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans from stretches group by doc_id
), gaps as (
    select doc_id, coalesce(lag(b) over w, 0) as a, stretches.a as b from stretches window w as (partition by doc_id order by a)
    union all select doc_id, max(b), 1000000000 from stretches group by doc_id
), left_over as (
    select g.doc_id, string_agg(substr(h, 2 * g.a + 1, 2 * (g.b - g.a)), '' order by g.a) as h
    from gaps g join hexed x on x.doc_id = g.doc_id group by g.doc_id
)
select x.doc_id, (len(x.h) // 2)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
    sha256(unhex(coalesce(l.h, x.h))) as kept_sha256
from hexed x left join sums s on s.doc_id = x.doc_id left join left_over l on l.doc_id = x.doc_id
"""

ORACLE["op4_minhash_near_dedup"] = r"""
with recursive words as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
        lambda w: w != '') as w
    from documents
), sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 2 then [w[1]]
        else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s
    from words
), tokens as (
    select doc_id, unnest(s) as t from sets
), common as (
    select x.doc_id as a, y.doc_id as b, count(*) as n
    from tokens x join tokens y on x.t = y.t and x.doc_id < y.doc_id group by all
), links as (
    select a, b from common join sets p on p.doc_id = a join sets q on q.doc_id = b
    where 100 * n >= 80 * (len(p.s) + len(q.s) - n)
), both_ways as (
    select a, b from links union all select b, a from links
), reach(doc_id, root) as (
    select doc_id, doc_id from sets
    union
    select l.b, r.root from reach r join both_ways l on l.a = r.doc_id
)
select doc_id, len(s) as n_shingles, root as component_id, doc_id = root as kept
from sets join (select doc_id, min(root) as root from reach group by 1) using (doc_id)
"""

# The base32 digest is spelled out of the hexadecimal one, five bits at a time.
ORACLE["op6_warc"] = """
with hashed as (
    select page_id, coalesce(html, '') as html, max(page_id) over same as last_id, sha1(coalesce(html, '')) as hex
    from pages window same as (partition by coalesce(html, ''))
), bits as (
    select *, list_aggregate(list_transform(range(1, 41), lambda i:
        lpad(bin(('0x' || substr(hex, i, 1))::int), 4, '0')), 'string_agg', '') as b from hashed
)
select page_id, strlen(html)::bigint as payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + list_sum(list_transform(range(1, 6), lambda k:
            substr(b, 5 * i + k, 1)::int << (5 - k)))::int, 1)), 'string_agg', '') as payload_digest,
    case when page_id = last_id then 'response' else 'revisit' end as record_type,
    case when page_id <> last_id then last_id end as refers_to
from bits
"""

ORACLE["op7_line_dedup"] = r"""
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
    from documents
), numbered as (
    select *, ('0x' || substr(md5(line), 1, 8))::bigint as h from lines
), ends as (
    select *, lag(h) over w as before, lead(i) over w as after from numbered
    window w as (partition by doc_id order by i)
), marked as (
    select doc_id, i, line, sum(case when i > 1 and (3 * lag_h + lag_h2) % 4 = 0 then 1 else 0 end)
        over (partition by doc_id order by i) as chunk
    from (select e.*, lag(before) over w as lag_h, lag(h) over w as lag_h2 from ends e
        window w as (partition by doc_id order by i))
), chunks as (
    select doc_id, chunk, count(*) as n, string_agg(line, chr(10) order by i) as piece
    from marked group by doc_id, chunk
), judged as (
    select *, n >= 2 and regexp_matches(piece, '[^\x20\x09-\x0D]')
        and row_number() over (partition by piece order by doc_id, chunk) > 1 as gone
    from chunks
)
select doc_id, sum(n)::bigint as n_lines, count(*) as n_chunks,
    count(*) filter (gone) as n_removed_chunks,
    coalesce(sum(n) filter (gone), 0)::bigint as n_removed_lines,
    sha256(coalesce(string_agg(piece, chr(10) order by chunk) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""

ORACLE["op8_exact_dedup"] = """
with low as (
    select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') as low
    from documents
)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
    doc_id = max(doc_id) over same as kept, sha256(low) as text_sha256
from low window same as (partition by low)
"""


def _measures() -> str:
    return ", ".join(
        f"({k}, '{name}', {list(cuts)})" for k, (name, _, cuts) in enumerate(quality.MEASURES)
    )


def _values() -> str:
    return "[" + ", ".join(value.replace(" div ", " // ") for _, value, _ in quality.MEASURES) + "]"


_SHARE = quality.RISK / len(quality.MEASURES)

ORACLE["op9_quality_rules"] = rf"""
with texts as (
    select doc_id, lang, coalesce(text, '') as text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w != '') as w,
        list_filter(string_split(coalesce(text, ''), chr(10)),
            lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
    from documents
), windows as (
    select doc_id, i, array_to_string(w[i:i + 7], ' ') as win
    from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from texts)
), often as (
    select doc_id, i from (select *, count(*) over (partition by doc_id, win) as n from windows) where n > 1
), covered as (
    select doc_id, sum(least(8, coalesce(i - before, 8)))::bigint as n_repeat_words
    from (select *, lag(i) over (partition by doc_id order by i) as before from often) group by doc_id
), counts as (
    select t.doc_id, lang as stratum, len(w)::bigint as n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        len(lines)::bigint as n_lines,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words
    from texts t left join covered c on c.doc_id = t.doc_id
), based as (
    select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counts
), measured as (
    select *, case when base_failed then null else {_values()} end as v from based
), marks as (
    select doc_id, min(quality) > 0 as good from labels group by doc_id
), measures(m, name, cuts) as (values {_measures()}
), steps as (
    select m, unnest(cuts) as cutoff, unnest(range(0, len(cuts))) as step from measures
), labelled as (
    select stratum, good, v from measured join marks using (doc_id) where not base_failed
), strata as (
    select count(distinct coalesce(stratum, chr(0))) as strata from labelled
), hits as (
    select stratum, m, step, cutoff, count(*) filter (good) as n,
        count(*) filter (good and v[m + 1] >= cutoff) as x,
        count(*) filter (not good and v[m + 1] >= cutoff) as caught
    from labelled, steps group by all
), tested as (
    select *, x <= n * {_SHARE} and (
        select sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({_SHARE}) + (n - k) * ln({1 - _SHARE})))
        from (select unnest(range(0, x + 1)) as k)
    ) <= {quality.DELTA / len(quality.MEASURES)} / strata as passed
    from hits, strata
), certified as (
    select * from tested t where passed and caught > 0 and caught >= {quality.BAD_PER_GOOD} * x and not exists (
        select 1 from tested f where f.stratum is not distinct from t.stratum and f.m = t.m
            and f.step <= t.step and not f.passed)
), chosen as (
    select stratum, m, arg_min(cutoff, struct_pack(lost := -caught, step := step)) as cutoff
    from certified group by stratum, m
), rejected as (
    select distinct doc_id from measured d join chosen c
        on c.stratum is not distinct from d.stratum and d.v[c.m + 1] >= c.cutoff
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and doc_id not in (select doc_id from rejected) as kept
from measured
"""

ORACLE["op11_source_divergence"] = r"""
with docs as (
    select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
    from documents
), words as (
    select row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs
), kept as (
    select lang, term, count(*) as lang_n from words group by lang, term having count(distinct row) >= 30
), langs as (
    select lang, sum(lang_n)::hugeint as lang_total, count(*) as terms from kept group by lang
), counts as (
    select lang, source, term, count(*) as n from words group by lang, source, term
), sources as (
    select distinct lang, source from docs
), totals as (
    select lang, source, sum(n)::hugeint as total from counts join kept using (lang, term) group by lang, source
), grid as (
    select s.lang, s.source, k.term, coalesce(c.n, 0) as n,
        1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * terms) as p,
        1 + (1000000000::hugeint * (lang_n + 5)) // (lang_total + 5 * terms) as q
    from sources s join kept k on k.lang = s.lang join langs l on l.lang = s.lang
    left join totals t on t.lang = s.lang and t.source = s.source
    left join counts c on c.lang = s.lang and c.source = s.source and c.term = k.term
), differences as (
    select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
    from grid a join grid b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
    select a.lang, a.source, b.source as item, coalesce(d.value, 0)::bigint as value
    from sources a join sources b on a.lang = b.lang and a.source <> b.source
    left join differences d on d.lang = a.lang and d.source = a.source and d.item = b.source
), ranked as (
    select lang, source, 'pair' as part, item, value from pairs
    union all select lang, source, 'term', term, (p - q)::bigint from grid where n > 0 and p > q
)
select lang, source, part, item, value,
    (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from ranked qualify part = 'pair' or rank <= 50
"""

ORACLE["op12_mixing"] = r"""
with sizes as (
    select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
        lambda w: w != ''))::bigint as size
    from documents
), sources as (
    select source, sum(size)::bigint as source_size, count(*) as n,
        [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
    from sizes group by source
), filled as (
    select *, (sum(source_size) over ())::hugeint - 3 * (coalesce(sum(source_size) over before, 0))::hugeint as shared,
        (sum(weight) over ())::hugeint - (coalesce(sum(weight) over before, 0))::hugeint as weights
    from sources window before as (order by source_size / weight, source nulls first rows between unbounded preceding and 1 preceding)
), judged as (
    select *, 3 * source_size::hugeint * weights < shared * weight as stops from filled
), level as (
    select shared as level_shared, weights as level_weights from judged where not stops order by weights desc limit 1
), targets as (
    select source, source_size,
        case when stops then (3 * source_size)::double
            else (level_shared * weight)::double / level_weights::double end as target,
        case when source_size = 0 then 0 when stops then 3 * 16777216
            else (level_shared * weight * 16777216) // (level_weights * source_size) end as rate,
        ('0x' || substr(md5(case when source is null then 'mix' else 'mix:' || source end), 1, 6))::bigint as shift
    from judged, level
), placed as (
    select doc_id, source, size, row_number() over (partition by source order by size desc,
        md5(coalesce(cast(doc_id as varchar), '')), doc_id) as place
    from sizes
)
select doc_id, size, source_size, target,
    (size * ((place * rate + shift) // 16777216 - ((place - 1) * rate + shift) // 16777216))::bigint as taken
from placed p join targets t on p.source is not distinct from t.source
"""

# Least (cost, audit, text) from the first row on per grammar state; the checksum is spelled out bit by bit.
ORACLE["op13_conversation_repair"] = r"""
with recursive keyed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k
    from conversations
), coded as (
    select *, xor(list_reduce(list_concat([4294967295::bigint],
        list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i::int, 1))::bigint)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
            lambda x, j: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 as code
    from keyed
), damaged as (
    select conv_id, turn, case when code = 4 then 'user' else role end as role,
        case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
    from coded, (values (1), (2)) v(copy) where code <> 0 and (copy = 1 or code = 3)
), placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role,
        md5(strlen(role) || ':' || role || ':' || text)) as i
    from damaged
), seen as (
    select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank,
        row_number() over (partition by conv_id, role, text order by i) > 1 as again,
        not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as open_end,
        lag(substr(role, 1, 1)) over (partition by conv_id order by i) || substr(role, 1, 1) as step
    from placed
), judged as (
    select *, blank or again as gone, not blank and again as duplicate,
        not blank and not again and open_end as truncated, substr(role, 1, 1) as r,
        chr(10) || role || ':' || text as line, chr(10) || 'user:' || text as as_user,
        chr(10) || 'assistant:' || text as as_assistant
    from seen
), counts as (
    select conv_id, count(*) as n,
        coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
        count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate,
        count(*) filter (truncated) as truncated,
        count(*) filter (step is not null and step not in ('su', 'ua', 'au')) as illegal
    from judged group by conv_id
), ids as (
    select distinct conv_id from conversations
), walk(conv_id, i, s0, s1, s2, s3) as (
    select conv_id, 0::bigint, {'c': 0::bigint, 'a': '', 't': ''}, {'c': 1000000000::bigint, 'a': '', 't': ''},
        {'c': 2::bigint, 'a': 'I', 't': chr(10) || 'user:'},
        {'c': 4::bigint, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}
    from ids
    union all
    select conv_id, i, n0, n1, m2,
        least(n3, {'c': m2.c + 2, 'a': m2.a || 'I', 't': m2.t || chr(10) || 'assistant:'})
    from (
        select conv_id, i, n0, n1, n3, least(n2,
            {'c': n0.c + 2, 'a': n0.a || 'I', 't': n0.t || chr(10) || 'user:'},
            {'c': n1.c + 2, 'a': n1.a || 'I', 't': n1.t || chr(10) || 'user:'},
            {'c': n3.c + 2, 'a': n3.a || 'I', 't': n3.t || chr(10) || 'user:'}) as m2
        from (
            select w.conv_id, j.i,
                {'c': s0.c + 3, 'a': s0.a || 'D', 't': s0.t} as n0,
                least({'c': s1.c + 3, 'a': s1.a || 'D', 't': s1.t},
                    {'c': s0.c + z + case when r = 's' then 0 else 1000000000 end, 'a': s0.a || 'K', 't': s0.t || line}) as n1,
                least({'c': s2.c + 3, 'a': s2.a || 'D', 't': s2.t},
                    {'c': s0.c + z + u, 'a': s0.a || 'K', 't': s0.t || line},
                    {'c': s1.c + z + u, 'a': s1.a || 'K', 't': s1.t || line},
                    {'c': s3.c + z + u, 'a': s3.a || 'K', 't': s3.t || line},
                    {'c': s0.c + z + 2, 'a': s0.a || 'R', 't': s0.t || as_user},
                    {'c': s1.c + z + 2, 'a': s1.a || 'R', 't': s1.t || as_user},
                    {'c': s3.c + z + 2, 'a': s3.a || 'R', 't': s3.t || as_user}) as n2,
                least({'c': s3.c + 3, 'a': s3.a || 'D', 't': s3.t},
                    {'c': s2.c + z + case when r = 'a' then 0 else 1000000000 end, 'a': s2.a || 'K', 't': s2.t || line},
                    {'c': s2.c + z + 2, 'a': s2.a || 'R', 't': s2.t || as_assistant}) as n3
            from walk w join (
                select *, case when gone then 1000000000 when truncated then 1 else 0 end as z,
                    case when r = 'u' then 0 else 1000000000 end as u from judged
            ) j on j.conv_id is not distinct from w.conv_id and j.i = w.i + 1
        )
    )
), ends as (
    select w.conv_id, least(s0, s3) as best
    from walk w left join counts c on c.conv_id is not distinct from w.conv_id
    where w.i = coalesce(c.n, 0)
)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
    coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, best.c as cost, best.a as audit,
    sha256(substr(best.t, 2)) as repaired_sha256
from ends e left join counts c on c.conv_id is not distinct from e.conv_id
"""
