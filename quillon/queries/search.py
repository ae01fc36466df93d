"""Queries over review text: tokens, BM25, ranked search, segments."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from quillon.fixtures import ctes, items, reviews
from quillon.operators import evaluate as E
from quillon.operators import index as I
from quillon.operators import search as S
from quillon.operators.segments import near_collapse
from quillon.registry import query
from quillon.runtime import shared_dir, table

ASKED = "values (1, 'esat ndon'), (2, 'estion the of'), (3, 'Thing esat esat')"
STOP = ["the", "and", "of", "de", "la"]
TK = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+')"


def search_index(spark, sf_dir, stop=None):
    """The stored index of ``documents`` as they are now, built by the first query that needs it.

    Its folder is named after the files' paths, sizes and times, so other files make another index.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/documents.parquet")
    version = files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.sum("length")).first()
    name = hashlib.md5(repr((tuple(version), stop)).encode()).hexdigest()
    return I.build_index(reviews(spark, sf_dir).select("review_id", "item_id", "text"), f"{shared_dir(spark)}/reviews-{name}", stop)


def asked(spark):
    return spark.sql(f"select * from {ASKED} as t(query_id, query)")


def bm25_sql(q: str = ASKED, stop: list[str] | None = None, key: str = "query_id", text: str = "query") -> str:
    """Expressions toks, st, df, idf, sc (scores of matching reviews) for a table of queries."""
    drop = f"where term not in ({', '.join(repr(s) for s in stop)})" if stop else ""
    return rf"""q({key}, {text}) as ({q}),
toks as (select review_id, item_id, text, {TK.format('text')} as tk from reviews),
qt as (select {key}, term, count(*) as times from (select {key}, unnest({TK.format(text)}) as term from q) {drop} group by all),
one as (select review_id, term, count(*) as tf from (select review_id, unnest(tk) as term from toks) {drop} group by all),
len as (select toks.review_id, coalesce(sum(tf), 0) as n_tokens from toks left join one using (review_id) group by all),
st as (select count(*) as n, avg(n_tokens) as mean from len),
idf0 as (select term, count(*) as df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as idf from one, st group by term),
idf as (select term, df, case when idf < 0 then 0.25 * (select avg(idf) from idf0) else idf end as idf from idf0),
sc as (select {key}, review_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n_tokens / mean))) as score
  from qt join one using (term) join idf using (term) join len using (review_id), st group by all)"""


def hits_sql(topk: int | None, key: str = "query_id", text: str = "query") -> str:
    """Expressions rk and hits after :func:`bm25_sql`."""
    cut = f"where rank <= {topk}" if topk else ""
    return rf"""rk as (select *, row_number() over (partition by {key} order by round(score, 9) desc, review_id) as rank from
  (select q.{key}, toks.review_id, item_id, text, coalesce(score, 0) as score from q cross join toks left join sc on sc.{key} = q.{key} and sc.review_id = toks.review_id)),
hit0 as (select rk.*, list_filter({TK.format('q.' + text)}, lambda t: contains(lower(coalesce(rk.text, '')), t))[1] as hit from (select * from rk {cut}) rk join q using ({key})),
hits as (select *, greatest(0, instr(lower(text), hit) - 1 - 100) as s0, least(length(text), instr(lower(text), hit) - 1 + length(hit) + 100) as e0,
  instr(lower(text), hit) - 1 as a0 from hit0 where hit is not null)"""


SNIPPET = """(case when s0 > 0 then '…' else '' end || substr(text, s0 + 1, a0 - s0) || '**' || substr(text, a0 + 1, length(hit)) || '**'
  || substr(text, a0 + length(hit) + 1, e0 - a0 - length(hit)) || case when e0 < length(text) then '…' else '' end)"""


@query(rf"""with d as (select term, count(*) as df from (select doc_id, unnest(list_distinct({TK.format('text')})) as term from documents) group by term),
i as (select term, df, ln((select count(*) from documents) - df + 0.5) - ln(df + 0.5) as idf from d)
select term, df, round(case when idf < 0 then 0.25 * (select avg(idf) from i) else idf end, 6) as idf from i""")
def corpus_stats(spark, sf_dir):
    return search_index(spark, sf_dir).terms().select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"{ctes('reviews')}, {bm25_sql()} select query_id, review_id, round(score, 6) as score from sc")
def bm25_scores(spark, sf_dir):
    return S.bm25_scores(search_index(spark, sf_dir), asked(spark)).select("query_id", "review_id", F.round("score", 6).alias("score"))


@query(f"{ctes('reviews')}, {bm25_sql(stop=STOP)} select query_id, review_id, round(score, 6) as score from sc")
def stopword_index(spark, sf_dir):
    return S.bm25_scores(search_index(spark, sf_dir, STOP), asked(spark)).select("query_id", "review_id", F.round("score", 6).alias("score"))


@query(f"{ctes('reviews')}, {bm25_sql()} select query_id, review_id, term, times, tf from qt join one using (term)")
def postings_lookup(spark, sf_dir):
    return S.postings_lookup(search_index(spark, sf_dir), S.query_terms(asked(spark))).select("query_id", "review_id", "term", "times", "tf")


@query(f"{ctes('reviews')}, {bm25_sql()}, {hits_sql(200)} select query_id, rank, review_id, item_id, round(score, 6) as score, hit, {SNIPPET} as snippet from hits")
def search_reviews(spark, sf_dir):
    return S.search_reviews(search_index(spark, sf_dir), asked(spark), topk=200).withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


@query(f"{ctes('reviews')}, {bm25_sql()}, {hits_sql(None)} select query_id, review_id, hit, rank from hits where item_id = 7")
def hit_filter(spark, sf_dir):
    found = S.search_reviews(search_index(spark, sf_dir), asked(spark), item_id=7)
    return found.select("query_id", "review_id", "hit", F.col("rank").cast("long").alias("rank"))


@query(f"{ctes('reviews')}, {bm25_sql()}, {hits_sql(200)} select query_id, item_id, review_id, round(score, 6) as score from (select *, row_number() over (partition by query_id, item_id order by rank) as r from hits) where r = 1")
def best_hit_per_item(spark, sf_dir):
    hits = S.search_reviews(search_index(spark, sf_dir), asked(spark), topk=200)
    return S.best_hit_per_item(hits).select("query_id", "item_id", "review_id", F.round("score", 6).alias("score"))


def _items_sql(agg: str, topk: int) -> str:
    return f"""{ctes('reviews', 'items')}, {bm25_sql()}, {hits_sql(20 * topk)},
best as (select query_id, item_id, {agg}(score) as score, count(*) as n_hits, min_by({SNIPPET}, rank) as snippet from hits group by all),
top as (select *, row_number() over (partition by query_id order by round(score, 9) desc, item_id) as rank from best)
select query_id, rank, item_id, name, stars, round(score, 6) as score, n_hits, snippet from top left join items using (item_id) where rank <= {topk}"""


def _items(spark, sf_dir, agg: str, topk: int):
    found = S.item_search(search_index(spark, sf_dir), items(spark, sf_dir), asked(spark), topk=topk, agg=agg)
    return found.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


@query(_items_sql("sum", 5))
def item_search(spark, sf_dir):
    return _items(spark, sf_dir, "sum", 5)


@query(_items_sql("avg", 8))
def item_search_mean(spark, sf_dir):
    return _items(spark, sf_dir, "mean", 8)


@query(_items_sql("max", 8))
def item_search_max(spark, sf_dir):
    return _items(spark, sf_dir, "max", 8)


@query(f"""{ctes('items')} select item_id, name, stars, count(*) as n_reviews from (select doc_id % 130 as item_id from documents) left join items using (item_id) group by all""")
def item_display(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select((F.col("doc_id") % 130).alias("item_id"))
    return hits.join(items(spark, sf_dir).select("item_id", "name", "stars"), "item_id", "left").groupBy("item_id", "name", "stars").agg(F.count(F.lit(1)).alias("n_reviews"))


@query(f"""{ctes('reviews')}, {bm25_sql()}, {hits_sql(500)},
r as (select *, row_number() over (partition by query_id, item_id order by rank) as r from hits),
best as (select query_id, item_id, sum(score) filter (r <= 3) as score, count(*) as support, string_agg(cast(review_id as varchar), ',' order by rank) filter (r <= 3) as evidence from r group by all),
top as (select *, row_number() over (partition by query_id order by round(score, 9) desc, support desc, item_id) as rank from best)
select query_id, rank, item_id, round(score, 6) as score, support, evidence from top where rank <= 5""")
def item_search_topm(spark, sf_dir):
    found = S.item_search_topm(search_index(spark, sf_dir), asked(spark))
    return found.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


SEGMENTS = r"""seg as (select review_id, item_id, unnest(range(len(parts))) as position, unnest(parts) as segment from
  (select review_id, item_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
    lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') as parts from reviews))"""


@query(f"{ctes('reviews')}, {SEGMENTS} select review_id, item_id, cast(position as integer) as position, segment from seg")
def segment_reviews(spark, sf_dir):
    return E.segment_reviews(reviews(spark, sf_dir))


@query(rf"""{ctes('reviews')}, {SEGMENTS}, d as (select md5(lower(regexp_replace(regexp_replace(segment, '\s+', ' ', 'g'), '^ | $', '', 'g'))) as digest, review_id, position from seg)
select digest, min(struct_pack(r := review_id, p := position)).r as review_id, cast(min(struct_pack(r := review_id, p := position)).p as integer) as position, count(*) as support from d group by digest""")
def exact_collapse(spark, sf_dir):
    return E.exact_collapse(E.segment_reviews(reviews(spark, sf_dir)))


NEAR = rf"""{ctes('reviews').replace('with ', 'with recursive ', 1)}, {SEGMENTS},
tx as (select lower(regexp_replace(regexp_replace(segment, '\s+', ' ', 'g'), '^ | $', '', 'g')) as text, min(struct_pack(r := review_id, p := position)) as pl, count(*) as support from seg group by 1),
nd as (select case when len(t) > 0 then array_to_string(t, ' ') else 'text ' || text end as node, t, pl, support from (select *, list_sort(list_distinct({TK.format('text')})) as t from tx)),
no as (select node, any_value(t) as t, len(any_value(t)) as n, min(pl) as pl, sum(support) as support, count(*) as n_texts from nd group by node),
fl as (select node, n, unnest(t) as token from no), df as (select token, count(*) as df from fl group by token),
pre as (select node, n, token from (select *, row_number() over (partition by node order by df, token) as r from fl join df using (token)) where r <= n - (n * 80 + 99) // 100 + 1),
pa as (select distinct a.node as a, b.node as b from pre a join pre b on a.token = b.token and a.node < b.node and a.n * 100 >= b.n * 80 and b.n * 100 >= a.n * 80),
li as (select a, b from (select a, b, x.n + y.n as n, len(list_intersect(x.t, y.t)) as i from pa join no x on x.node = a join no y on y.node = b) where i * 100 >= (n - i) * 80),
ed as (select a, b from li union all select b, a from li),
re(a, b) as (select a, a from ed union select re.a, ed.b from re join ed on re.b = ed.a),
la as (select a as node, min(b) as label from re group by a)
select min(pl).r as review_id, cast(min(pl).p as integer) as position, cast(sum(support) as bigint) as support, cast(sum(n_texts) as bigint) as n_texts from no left join la using (node) group by coalesce(label, node)"""


@query(NEAR)
def near_dup_collapse(spark, sf_dir):
    return near_collapse(E.segment_reviews(reviews(spark, sf_dir)))


KEYWORDS = "values (1, 'esat'), (1, 'ndon the'), (1, 'esat'), (2, 'estion'), (2, 'of'), (2, 'nosuchword'), (3, '')"


@query(f"""{ctes('reviews')}, {bm25_sql(f"select distinct k as keyword, k as query from ({KEYWORDS}) t(i, k)", key='keyword')},
rk as (select keyword, review_id, row_number() over (partition by keyword order by round(score, 9) desc, review_id) as r from sc where score > 0),
fu as (select i as query_id, review_id, sum(1 / (60.0 + r)) as score, count(*) as n_keywords from rk join (select distinct * from ({KEYWORDS}) t(i, k)) on k = keyword where r <= 100 group by all)
select query_id, rank, review_id, round(score::double, 6) as score, n_keywords from (select *, row_number() over (partition by query_id order by round(score::double, 9) desc, review_id) as rank from fu) where rank <= 20""")
def fused_search(spark, sf_dir):
    keywords = spark.sql(f"select * from {KEYWORDS} as t(query_id, keyword)")
    found = S.fused_search(search_index(spark, sf_dir), keywords, topk=20)
    return found.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})
