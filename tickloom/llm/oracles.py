"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
with d as (select doc_id, length(coalesce(text, '')) n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') norm from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size,
       row_number() over w = 1 as kept, sha256(norm) as text_sha256, cast(n as bigint) as n_points
from d window w as (partition by norm order by n desc, doc_id)"""

_PASS = """
left{k} as (select source s, target - sum(size * copies) as lft from m{k} group by source, target),
near{k} as (select source s, arg_min(place, (abs(abs(lft) - size), size, place)) p, min(sign(lft)) mv
            from m{k} join left{k} on source is not distinct from s
            where size > 0 and case when lft > 0 then copies < 3 else copies > 0 end and abs(abs(lft) - size) < abs(lft) group by source),
m{n} as (select m{k}.* exclude (copies), copies + coalesce(mv, 0) as copies
         from m{k} left join near{k} on source is not distinct from s and place = p)"""

OP10 = (
    r"""
with rows_ as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size from documents),
sized as (select source, cast(sum(size) as bigint) source_size from rows_ group by source),
weighted as (select *, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight, 3 * source_size as lim from sized),
filled as (select *, (select sum(source_size) from sized) - coalesce(sum(lim) over (order by lim / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
                  sum(weight) over (order by lim / weight, source nulls last rows between current row and unbounded following) as shares from weighted),
opened as (select *, lim * shares <= rest * weight as complete from filled),
level as (select arg_max(rest, shares) rest, max(shares) shares from opened where not complete),
goal as (select o.source s, source_size, case when complete then cast(lim as double) else cast(l.rest as double) * weight / l.shares end as target from opened o left join level l on true),
celled as (select *, coalesce(doc_id % cast(ceil(count(*) over (partition by source, size) / 50000) as bigint), 0) as part from rows_),
placed as (select doc_id, source, size, source_size, target, case when source_size = 0 then 0 else round(target / source_size, 9) end as rate,
                  row_number() over (partition by source order by size, part, doc_id nulls first) as place
           from celled join goal on source is not distinct from s),
m0 as (select * exclude (rate), cast(floor(place * rate + 0.5) - floor((place - 1) * rate + 0.5) as bigint) as copies from placed),"""
    + ",".join(_PASS.format(k=k, n=k + 1) for k in range(2))
    + """
select doc_id, size, source_size, target, cast(copies * size as bigint) as taken, cast(copies as bigint) as copies, source from m2"""
)

OP8 = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) e from embeddings
                     where label is not null and embedding is not null),
link as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
         where list_cosine_similarity(a.e, b.e) >= 0.98),
reach(id, other) as (select vec_id, vec_id from embeddings union select r.id, l.b from reach r join link l on l.a = r.other),
comp as (select id, min(other) component_id from reach group by id),
n as (select a, count(*) n_links from link group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings join comp on id = vec_id left join n on a = vec_id"""
