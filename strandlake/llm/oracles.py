"""SQL (DuckDB's) for the corpus queries that SQL can express.

The others are held against brute force, the public libraries or held-out labels in tests/llm: models are learned (1, 7, 8),
XXH64 is no SQL function (2), markup needs a parser (3), tokens need their library (5, 6), a shuffle is drawn at random (9), and
audio is decoded byte by byte (10).
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

SQL = {
    "op4_decontamination": f"""
with b as (select item_id, {_WORDS} as w from benchmark),
bw as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as win
       from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)),
d as (select doc_id, {_WORDS} as w from documents),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) where len(w) >= n)),
hits as (select doc_id, i, n, item_id from dw join bw using (n, win)),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as listed
          from (select distinct doc_id, cast(item_id as varchar) as s from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join pos using (doc_id) left join items using (doc_id)""",
}
