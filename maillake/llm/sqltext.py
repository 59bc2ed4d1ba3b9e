"""DuckDB SQL that states the results of queries."""

MIXING_PLAN = r"""
sized as (
  select *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from {docs}
), sources as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighed as (
  select *, 3.0::double * source_size as lim,
    [5.0::double, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
  from sources
), shared as (
  select *,
    (sum(source_size) over ())::double - coalesce(sum(lim) over before, 0.0::double) as words_left,
    sum(weight) over () - coalesce(sum(weight) over before, 0.0::double) as weight_left
  from weighed
  window before as (order by lim / weight, source nulls last rows between unbounded preceding and 1 preceding)
), limited as (
  select *, lim * weight_left <= weight * words_left as reached from shared
), first_free as (
  select words_left, weight_left from limited where not reached order by weight_left desc limit 1
), rates as (
  select l.source, l.source_size,
    case when l.reached then l.lim else l.weight * f.words_left / f.weight_left end as target
  from limited l left join first_free f on true
), rated as (
  select *, case when source_size > 0 then target / source_size else 0.0::double end as rate from rates
), joined as (
  select d.*, r.source_size, r.target, r.rate from sized d join rated r on d.source is not distinct from r.source
), drawn as (
  select *, floor(rate)::bigint + case when ('0x' || md5(seed || ':' || coalesce(doc_id::varchar, ''))[:13])::bigint::double
      / 4503599627370496.0::double < rate - floor(rate) then 1 else 0 end as copies
  from (select *, unnest(range(16)) as seed from joined)
), misses as (
  select source, seed, abs(sum(size * copies) - any_value(target)) as miss from drawn group by source, seed
), seeds as (
  select source, arg_min(seed, (miss, seed)) as seed from misses group by source
), planned as (
  select d.* from drawn d join seeds s on d.source is not distinct from s.source and d.seed = s.seed
)
"""

MIXING = (
    "with "
    + MIXING_PLAN.format(docs="documents")
    + " select doc_id, size, source_size, target, (size * copies)::bigint as taken, rate from planned"
)

URL_RULES = r"""
with rules(verdict, rule_host, rule_path) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), hosted as (
  select page_id, rest, regexp_extract(rest, '^[^/?#]*') as host from cut
), split as (
  select page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') as path from hosted
), fits as (
  select page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) as rule,
    max_by(r.verdict, length(rule_host || rule_path)) as verdict
  from split join rules r
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by page_id
)
select s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from split s left join fits f using (page_id)
"""

# States of a repair: 1 nothing yet, 2 after s, 3 after u, 4 after a. Each holds the cheapest (cost, audit, text) that leads there.
CONVERSATION_REPAIR = r"""
with recursive crc_table as (
  select list(crc order by i) as crcs from (
    select i, list_reduce([i::bigint] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as crc
    from range(256) t(i))
), hashed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce([4294967295::bigint] || list_transform(range(1, length(name) + 1), lambda k: ascii(name[k])::bigint),
      lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 as kind
  from (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations), crc_table
), damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from hashed, range(2) t(copy) where kind <> 0 and (copy = 0 or kind = 3)
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as nth,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') as trimmed,
    lag(role[1]) over (partition by conv_id order by turn nulls first, role, md5(text)) as last_initial
  from damaged
), faulty as (
  select *, case when trimmed = '' then 'blank' when nth > min(nth) over (partition by conv_id, role, text) then 'duplicate'
      when right(trimmed, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault
  from placed
), summed as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
    count(*) filter (where fault = 'blank')::bigint as blank, count(*) filter (where fault = 'duplicate')::bigint as duplicate,
    count(*) filter (where fault = 'truncated')::bigint as truncated,
    count(*) filter (where last_initial is not null and last_initial || role[1] not in ('su', 'ua', 'au'))::bigint as illegal
  from faulty group by conv_id
), inserted as (
  select conv_id, 0 as nth, {'c': 0, 'a': '', 't': ''} as p1, {'c': 1000000, 'a': '', 't': ''} as p2,
    {'c': 3, 'a': 'I', 't': chr(10) || 'user:'} as p3, {'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} as p4
  from summed
  union all
  select conv_id, nth, q1, q2, list_min([q3, {'c': q1.c + 3, 'a': q1.a || 'I', 't': q1.t || chr(10) || 'user:'},
      {'c': q2.c + 3, 'a': q2.a || 'I', 't': q2.t || chr(10) || 'user:'}, {'c': q4.c + 3, 'a': q4.a || 'I', 't': q4.t || chr(10) || 'user:'}]),
    list_min([q4, {'c': q3.c + 3, 'a': q3.a || 'I', 't': q3.t || chr(10) || 'assistant:'},
      {'c': q1.c + 6, 'a': q1.a || 'II', 't': q1.t || chr(10) || 'user:' || chr(10) || 'assistant:'},
      {'c': q2.c + 6, 'a': q2.a || 'II', 't': q2.t || chr(10) || 'user:' || chr(10) || 'assistant:'}])
  from (
    select i.conv_id, f.nth,
      {'c': p1.c + 4, 'a': p1.a || 'D', 't': p1.t} as q1,
      list_min([{'c': p2.c + 4, 'a': p2.a || 'D', 't': p2.t}, {'c': p1.c + more + if(free and role[1] = 's', 0, 1000000), 'a': p1.a || 'K', 't': p1.t || line}]) as q2,
      list_min([{'c': p3.c + 4, 'a': p3.a || 'D', 't': p3.t},
        {'c': p1.c + more + if(free and role[1] = 'u', 0, 1000000), 'a': p1.a || 'K', 't': p1.t || line},
        {'c': p2.c + more + if(free and role[1] = 'u', 0, 1000000), 'a': p2.a || 'K', 't': p2.t || line},
        {'c': p4.c + more + if(free and role[1] = 'u', 0, 1000000), 'a': p4.a || 'K', 't': p4.t || line},
        {'c': p1.c + more + if(free, 3, 1000000), 'a': p1.a || 'R', 't': p1.t || as_user},
        {'c': p2.c + more + if(free, 3, 1000000), 'a': p2.a || 'R', 't': p2.t || as_user},
        {'c': p4.c + more + if(free, 3, 1000000), 'a': p4.a || 'R', 't': p4.t || as_user}]) as q3,
      list_min([{'c': p4.c + 4, 'a': p4.a || 'D', 't': p4.t},
        {'c': p3.c + more + if(free and role[1] = 'a', 0, 1000000), 'a': p3.a || 'K', 't': p3.t || line},
        {'c': p3.c + more + if(free, 3, 1000000), 'a': p3.a || 'R', 't': p3.t || as_assistant}]) as q4
    from inserted i join (
      select *, fault not in ('blank', 'duplicate') as free, if(fault = 'truncated', 3, 0) as more, chr(10) || role || ':' || text as line,
        chr(10) || 'user:' || text as as_user, chr(10) || 'assistant:' || text as as_assistant from faulty) f
      on f.conv_id is not distinct from i.conv_id and f.nth = i.nth + 1)
), ended as (
  select i.conv_id, list_min([p1, p4, {'c': p2.c + 6, 'a': p2.a || 'II', 't': p2.t || chr(10) || 'user:' || chr(10) || 'assistant:'},
    {'c': p3.c + 3, 'a': p3.a || 'I', 't': p3.t || chr(10) || 'assistant:'}]) as best
  from inserted i join summed s on s.conv_id is not distinct from i.conv_id and s.n = i.nth
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit,
  sha256(substr(coalesce(best.t, ''), 2)) as repaired_sha256
from (select distinct conv_id from conversations) o
left join summed s on s.conv_id is not distinct from o.conv_id left join ended e on e.conv_id is not distinct from o.conv_id
"""
