"""SQL for DuckDB, for the operators that it can express over whole tables."""

SQL = {
    "op3_embedding_near_dedup": """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
fit as (select * from v where label is not null and e is not null and len([x for x in e if x is null or isnan(x) or isinf(x)]) = 0 and len([x for x in e if x <> 0]) > 0),
links as (select a.vec_id as a, b.vec_id as b from fit a join fit b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) as (select vec_id, vec_id from v union select r.a, l.b from reach r join links l on r.b = l.a),
comp as (select a, min(b) as c from reach group by 1), degree as (select a, count(*) as n from links group by 1)
select vec_id, coalesce(n, 0) as n_links, c as component_id, vec_id = c as kept from v join comp on comp.a = vec_id left join degree on degree.a = vec_id""",
    "op4_quality_rules": r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, [l for l in string_split(t, chr(10)) if regexp_matches(l, '[^\x20\x09-\x0D]')] as lines from d),
win as (select doc_id, i, array_to_string(ws[i:i + 4], ' ') as x from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w)),
twice as (select doc_id, x from win group by 1, 2 having count(*) > 1),
hit as (select distinct win.doc_id, i + k as p from win join twice on win.doc_id = twice.doc_id and win.x = twice.x, range(5) r(k)),
rep as (select doc_id, count(*) as n from hit group by 1),
top as (select doc_id, max(n) as n from (select doc_id, x, count(*) as n from (select doc_id, unnest(ws) as x from w) group by 1, 2) group by 1),
m as (select w.doc_id, len(ws) as n_words, coalesce(list_sum([length(x) for x in ws]), 0) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
 len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, len(lines) as n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) as n_letters, coalesce(top.n, 0) as n_top
 from w left join rep on rep.doc_id = w.doc_id left join top on top.doc_id = w.doc_id),
f as (select *, case when n_words < 10 then 1 else 0 end + case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end + case when 10 * n_symbols > n_words then 4 else 0 end + case when 10 * n_dup_lines > 3 * n_lines then 8 else 0 end
 + case when 2 * n_upper > n_letters then 16 else 0 end + case when word_chars > 20 * n_words or word_chars < 2 * n_words then 32 else 0 end + case when n_words >= 10 and 3 * n_top > n_words then 64 else 0 end as failed from m)
select doc_id, n_words, cast(word_chars as bigint) as word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 as base_failed, failed = 0 as kept, cast(failed as bigint) as failed from f""",
    "op7_minhash_near_dedup": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
each as (select distinct doc_id, unnest(case when len(w) >= 5 then [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d),
sets as (select doc_id, count(*) as n from each group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from each a join each b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
pairs as (select a, b from common join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
links as (select a, b from pairs union all select b, a from pairs),
reach(a, b) as (select doc_id, doc_id from d union select r.a, l.b from reach r join links l on r.b = l.a),
comp as (select a, min(b) as c from reach group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, c as component_id, d.doc_id = c as kept from d join comp on comp.a = d.doc_id left join sets on sets.doc_id = d.doc_id""",
}
