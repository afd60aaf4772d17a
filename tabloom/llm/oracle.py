"""SQL (for DuckDB) of the queries of this subpackage that SQL can express on whole tables.

The others (secret spans, near copies, tokenizer ids, classifier scores, SimHash, line groups, the pipeline) are tested
against brute force.
"""

from __future__ import annotations

_TOP_K = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e)
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""

_MIX = r"""
with d as (
  select doc_id, source, coalesce(text, '') as t,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    (cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 13)) as bigint) + 0.5) / 4503599627370496.0 as u
  from documents
), w as (
  select *, -ln(u) / (1.0 + case when length(t) > 0 then length(regexp_replace(t, '[^A-Za-z]', '', 'g')) / length(t)::double else 0.0 end * 2) as key from d
), s as (
  select source, cast(sum(size) as bigint) as source_size, (row_number() over (order by source asc nulls last) - 1) % 3 + 1 as weight from d group by source
), c as (
  select *, source_size * 3 as cap, sum(source_size) over () as total,
    coalesce(sum(source_size * 3) over f, 0) as before, sum(weight) over () - coalesce(sum(weight) over f, 0) as weight_left
  from s window f as (order by source_size * 3 / weight::double, source asc nulls last rows between unbounded preceding and 1 preceding)
), l as (
  select *, (total - before) / weight_left::double as level, cap <= (total - before) / weight_left::double * weight as is_full from c
), m as (
  select *, (select level from l where not is_full order by cap / weight::double, source asc nulls last limit 1) as final from l
), g as (
  select source, source_size, case when is_full or final is null then cap::double else final * weight end as target from m
), e as (
  select *, case when source_size > 0 then cast(floor(floor(target + 0.5) / source_size) as bigint) else 0 end as epochs from g
), o as (
  select w.*, e.source_size, e.target, e.epochs, cast(floor(e.target + 0.5) as bigint) - e.epochs * e.source_size as rest,
    coalesce(sum(size) over (partition by w.source order by key, doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from w join e on w.source is not distinct from e.source
)
select doc_id, size, source_size, target, cast(epochs * size + greatest(0, least(size, rest - before)) as bigint) as taken from o
"""

_WARC = """
with p as (
  select page_id, encode(coalesce(html, '')) as b, sha1(coalesce(html, '')) as h from pages
), r as (
  select *, max(page_id) over (partition by h, octet_length(b)) as head from p
)
select page_id, cast(octet_length(b) as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast(((cast('0x' || substr(h, cast(floor(j / 4) as integer) * 5 + 1, 5) as bigint) >> cast(15 - 5 * (j % 4) as integer)) & 31) + 1 as integer), 1)), '') as payload_digest,
  case when page_id = head then 'response' else 'revisit' end as record_type,
  case when page_id = head then null else head end as refers_to
from r
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_top_k": _TOP_K, "op5_mix": _MIX, "op6_warc": _WARC}
