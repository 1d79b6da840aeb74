"""SQL counterparts for DuckDB, of the queries that SQL can express."""

JACCARD_JOIN = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select doc_id, unnest(case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
                             when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w
), n as (select doc_id, count(*) as n from s group by doc_id),
o as (
  select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), l as (
  select u, v from o join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 80 * (x.n + y.n - c)
), e as (select u, v from l union all select v, u from l),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.v from r join e on e.u = r.b)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id
from documents d left join n using (doc_id) join (select a as doc_id, min(b) as component_id from r group by 1) c using (doc_id)
"""

WARC = r"""
with p as (
  select page_id, encode(coalesce(html, '')) as b from pages
), d as (
  select page_id, octet_length(b) as payload_bytes, sha1(b) as h, sha256(b) as s from p
), g as (
  select s, max(page_id) as response from d group by s
)
select d.page_id, d.payload_bytes::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
    lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * i + 1)::int, 5))::int >> k) & 31) + 1, 1)), '')), '') as payload_digest,
  case when d.page_id = g.response then 'response' else 'revisit' end as record_type,
  case when d.page_id = g.response then null else g.response end as refers_to
from d join g using (s)
"""

TOP_INNER_PRODUCTS = """
with n as (select max(len(embedding)) as dim from embeddings),
v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as w from embeddings, n
  where vec_id is not null and len(embedding) = dim and len(list_filter(embedding, lambda x: isfinite(x))) = dim
), p as (
  select q.vec_id as query_id, v.vec_id, list_dot_product(q.w, v.w)::bigint as score
  from v q join v on q.vec_id % 50 = 0 and v.vec_id <> q.vec_id
)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p
) where rank <= 5
"""

HARD_NEGATIVES = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as w
  from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
), s as (
  select a.vec_id as anchor_id, v.vec_id, v.label = a.label as same, list_dot_product(a.w, v.w)::bigint as score
  from v a join v on a.vec_id % 100 = 0 and v.vec_id <> a.vec_id and len(v.w) = len(a.w)
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) as place from s where same
), n as (
  select p.anchor_id, p.positive_id, s.vec_id as negative_id, p.positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 100 * s.score between 30 * p.positive_score and 90 * p.positive_score
  where p.place <= 5
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""

ORACLES = {"op12_hard_negatives": HARD_NEGATIVES, "op8_ball_search": TOP_INNER_PRODUCTS, "op4_warc": WARC, "op9_ngram_jaccard_join": JACCARD_JOIN}
