"""DuckDB SQL that must give the rows of those queries that SQL expresses on whole tables."""

#: Shingle sets joined on shingles, and components by recursion.
OP3 = """with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
 shingles as materialized (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as h from words),
 sizes as materialized (select doc_id, count(*) as n from shingles group by doc_id),
 shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
 links as materialized (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
 reach as (select doc_id as node, doc_id as seen from documents union select r.node, case when l.a = r.seen then l.b else l.a end from reach r join links l on l.a = r.seen or l.b = r.seen)
 select d.doc_id, coalesce(n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept from documents d left join sizes using (doc_id) join (select node, min(seen) as component_id from reach group by node) c on c.node = d.doc_id"""
#: Every pair of a query and another vector, distances summed in order.
OP6 = """with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0)
 select query_id, cast(rank as int) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score, vec_id) as rank from (select q.vec_id as query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[2] - p[1]) * (p[2] - p[1])), lambda a, b: a + b)) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)) where rank <= 10"""
#: Windows as strings, joined with the strings of as many words of the documents.
OP8 = """with dw as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
 iw as materialized (select item_id, w, least(10, len(w)) as l from (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark) where len(w) > 0),
 win as materialized (select distinct item_id, l, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i : i + l - 1], ' '))) as t from iw),
 seen as (select doc_id, l, generate_subscripts(a, 1) as p, unnest(a) as t from (select doc_id, l, list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i : i + l - 1], ' ')) as a from dw, (select distinct l from iw) where len(w) >= l)),
 hits as materialized (select doc_id, p, l, item_id from seen join win using (l, t)),
 marked as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + l)) as q from hits) group by doc_id),
 named as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as items from (select distinct doc_id, cast(item_id as varchar) as i from hits) group by doc_id)
 select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from dw left join marked using (doc_id) left join named using (doc_id)"""
