"""DuckDB SQL of the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

from quillon.llm import ranked, spelling, toolcalls

NEAR_DUPLICATES = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as sh from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 75 * (x.n + y.n - i)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from r join e on r.b = e.a)
select d.doc_id, coalesce(n, 0) as n_shingles, c as component_id, d.doc_id = c as kept from documents d join (select a, min(b) as c from r group by a) on a = d.doc_id left join n on n.doc_id = d.doc_id
"""

TRANSACTIONS = """
with p as (select page_id, url, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as h from pages),
r as (select *, row_number() over (partition by h order by page_id nulls last, url) as place, first(page_id) over (partition by h order by page_id nulls last, url) as first from p)
select page_id, n as payload_bytes, h as payload_digest, case when n >= 100 and place > 1 then 'revisit' else 'response' end as record_type,
  case when n >= 100 and place > 1 then first end as refers_to from r
"""

ORACLES = {
    "op1_tool_call_linking": toolcalls.ORACLE, "op3_minhash_near_dedup": NEAR_DUPLICATES, "op5_warc_transactions": TRANSACTIONS, "op11_spelling_variants": spelling.ORACLE,
    "op12_ranked_search": ranked.ORACLE,
}
