"""DuckDB SQL of the digest queries that SQL can express."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = rf"""
with lines as (
  select doc_id, i, l, {_LOWER.format("trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as k
  from (select doc_id, generate_subscripts(a, 1) as i, unnest(a) as l
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents))
), shared as (
  select k, max(doc_id) as last from lines where length(k) >= 20 group by k having count(distinct doc_id) >= 3
), marked as (
  select doc_id, i, l, coalesce(doc_id < last, false) as gone from lines left join shared using (k)
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(l, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""

JACCARD = rf"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end as s from words
), members as (select doc_id, unnest(s) as g from sets
), shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as n from members a join members b on a.g = b.g and a.doc_id < b.doc_id group by all
), links as (
  select x, y from shared join sets a on a.doc_id = x join sets b on b.doc_id = y where 100 * n >= 75 * (len(a.s) + len(b.s) - n)
), edges as (select x, y from links union all select y, x from links
), reach as (
  select doc_id, doc_id as r from sets union select e.y, reach.r from reach join edges e on e.x = reach.doc_id
)
select doc_id, len(s)::bigint as n_shingles, component_id from sets join (select doc_id, min(r) as component_id from reach group by doc_id) using (doc_id)
"""

HARD_NEGATIVES = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, a.label as own, b.vec_id, b.label, list_dot_product(a.v, b.v)::bigint as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), positive as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where label = own
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id)::int as rank, s.vec_id as negative_id, positive_score, s.score as negative_score
from positive p join scored s on s.anchor_id = p.anchor_id and s.label <> s.own and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) <= 10
"""

SQL = {"op11_hard_negatives": HARD_NEGATIVES, "op1_line_dedup": LINE_DEDUP, "op10_jaccard_join": JACCARD}
