"""DuckDB SQL of the queries that SQL can express. It computes results its own way: all pairs that share a shingle, and
shares of the mix by the documents' draws in order."""

MIXING = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0::double as draw
  from documents
), s as (
  select source, sum(size)::bigint as source_size, 2.0::double * sum(size)::double as cap,
    [5.0::double, 2.0, 1.0][((row_number() over (order by source nulls last)) - 1) % 3 + 1] as weight
  from d group by source
), f as (
  select *, (least(1.5::double * sum(source_size) over ()::double, sum(cap) over ()) - coalesce(sum(cap) over w, 0))
    / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
  from s window w as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)
), l as (
  select arg_min(level, cap / weight) as level from f where level <= cap / weight
), t as (
  select source, source_size, least(coalesce(l.level, 'inf'::double) * weight, cap) as target from s left join l on true
), r as (
  select *, case when source_size > 0 then target / source_size else 0.0 end as rate from t
), m as (
  select d.doc_id, d.source, d.size, r.source_size, r.target, floor(r.rate)::bigint as whole, (r.rate - floor(r.rate)) * r.source_size as wanted, d.draw,
    sum(d.size) over (partition by d.source order by d.draw) as upto,
    sum(d.size) over (partition by d.source, d.draw) as here
  from d join r on d.source is not distinct from r.source
), b as (
  -- the bin of the threshold, as the query deals draws into 4096
  select *, min(case when upto >= wanted and upto - here < wanted then floor(draw * 4096) end) over (partition by source) as bin from m
), e as (
  select *, max(case when floor(draw * 4096) = bin and upto - here / 2.0 <= wanted then draw end) over (partition by source) as last_in,
    min(case when floor(draw * 4096) = bin then draw end) over (partition by source) as first_draw
  from b
), c as (
  select *, least(whole + case when draw < coalesce(last_in + 1 / 4503599627370496.0::double, first_draw, 0.0) then 1 else 0 end, 2)::bigint as copies from e
)
select doc_id, size, source_size, target, (copies * size)::bigint as taken, source, copies from c
"""

NEARDUP = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents
), g as (
  select distinct doc_id, case when len(words) < 4 then array_to_string(words, ' ') else array_to_string(words[i : i + 3], ' ') end as shingle
  from (select doc_id, words, unnest(generate_series(1, greatest(len(words) - 3, 1))) as i from w where len(words) > 0)
), n as (
  select doc_id, count(*)::bigint as n from g group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared
  from g a join g b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all
), e as (
  select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * shared >= 80 * (x.n + y.n - shared)
), u as (
  select a, b from e union select b, a from e
), reach as (
  select doc_id as node, doc_id as label from documents
  union
  select u.b, reach.label from reach join u on u.a = reach.node where reach.label < u.b
), c as (
  select node, min(label) as component_id from reach group by node
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join n using (doc_id) left join c on c.node = d.doc_id
"""
