"""DuckDB SQL of the queries that SQL can express."""

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

COVER_DEDUP = f"""with words as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') as ws from documents),
wins as (select doc_id, k, array_to_string(ws[k:k + 49], ' ') as s from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as k from words)),
low as (select s, min(doc_id) as m from wins group by s),
gone as (select doc_id, list(distinct p) as ps from (select w.doc_id, unnest(range(k, k + 50)) as p from wins w join low using (s) where m < w.doc_id) group by doc_id),
kept as (select words.doc_id, ws, coalesce(ps, []) as ps from words left join gone on words.doc_id = gone.doc_id),
each as (select doc_id, ps, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as p from kept),
left_over as (select doc_id, string_agg(w, ' ' order by p) as t from each where not list_contains(ps, p) group by doc_id)
select k.doc_id, len(ws)::bigint as n_words, len(ps)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from kept k left join left_over l on k.doc_id = l.doc_id"""

WINNOW_HITS = f"""with items as (select item_id, regexp_extract_all({_LOW}, '{_WORD}') as ws from benchmark),
sizes as (select *, least(10, len(ws)) as n from items where len(ws) > 0),
wins as (select distinct item_id, n, array_to_string(ws[k:k + n - 1], ' ') as s from (select *, unnest(range(1, len(ws) - n + 2)) as k from sizes)),
docs as (select doc_id, regexp_extract_all({_LOW}, '{_WORD}') as ws from documents),
grams as (select doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') as s from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as k from docs cross join (select distinct n from wins))),
hits as (select distinct g.doc_id, g.n, g.k, w.item_id from grams g join wins w on g.n = w.n and g.s = w.s),
found as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from hits) group by doc_id),
names as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids from (select distinct doc_id, item_id::varchar as i from hits) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join found f on d.doc_id = f.doc_id left join names m on d.doc_id = m.doc_id"""
