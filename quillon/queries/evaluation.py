"""Queries that evaluate rankings against gold gains from labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.fixtures import ctes
from quillon.operators import evaluate as E
from quillon.operators import search as S
from quillon.queries.search import asked, bm25_sql, hits_sql, search_index
from quillon.registry import query
from quillon.runtime import table

GOLD = """gold as (select query_id, doc_id % 100 as item_id, cast(count(*) filter (quality = 1) as double) / (count(*) + 1) as gain from labels, q group by all),
best as (select query_id, item_id, sum(score) as score from hits group by all),
ranked as (select query_id, item_id, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, item_id) as rank from best) where rank <= 5),
judged as (select r.*, coalesce(gain, 0) as gain from ranked r left join gold using (query_id, item_id))"""
BASE = f"{ctes('reviews')}, {bm25_sql()}, {hits_sql(100)}, {GOLD}"


def _tables(spark, sf_dir):
    q = asked(spark)
    gold = table(spark, sf_dir, "labels").crossJoin(F.broadcast(q.select("query_id"))).groupBy("query_id", (F.col("doc_id") % 100).alias("item_id"))
    gold = gold.agg((F.count_if(F.col("quality") == 1).cast("double") / (F.count(F.lit(1)) + 1)).alias("gain"))
    hits = S.search_reviews(search_index(spark, sf_dir), q, topk=100)
    by = hits.groupBy("query_id", "item_id").agg(F.sum("score").alias("score"))
    from quillon.plans.recommend import final_ranking

    return final_ranking(by).filter("rank <= 5"), gold, q


@query(f"{BASE} select query_id, round(count(*) filter (rank <= 3 and gain > 0) / 3.0, 6) as precision from judged group by 1")
def precision_at_k(spark, sf_dir):
    ranked, gold, _ = _tables(spark, sf_dir)
    return E.precision_at_k(ranked, gold).select("query_id", F.round("precision", 6).alias("precision"))


@query(f"{BASE} select g.query_id, round(coalesce(any_value(h), 0)::double / count(*), 6) as recall from gold g left join (select query_id, count(*) filter (rank <= 3 and gain > 0) as h from judged group by 1) using (query_id) where gain > 0 group by 1")
def recall_at_k(spark, sf_dir):
    ranked, gold, _ = _tables(spark, sf_dir)
    return E.recall_at_k(ranked, gold).select("query_id", F.round("recall", 6).alias("recall"))


@query(f"""{BASE}, dc as (select query_id, sum(gain / log2(rank + 1)) as dcg from judged where rank <= 3 group by 1),
ideal as (select query_id, sum(gain / log2(r + 1)) as ideal from (select *, row_number() over (partition by query_id order by gain desc, item_id) as r from gold) where r <= 3 group by 1)
select query_id, round(case when ideal > 0 then coalesce(dcg, 0) / ideal else 0 end, 6) as ndcg from ideal left join dc using (query_id)""")
def ndcg_at_k(spark, sf_dir):
    ranked, gold, _ = _tables(spark, sf_dir)
    return E.ndcg_at_k(ranked, gold).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query(f"""{BASE}, p as (select query_id, rank, (pow(2.0, gain) - 1) / 2.0 as p from judged where rank <= 3),
g as (select *, exp(coalesce(sum(ln(1 - p)) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0)) as go from p)
select query_id, round(sum(go * p / rank), 6) as err from g group by 1""")
def err_at_k(spark, sf_dir):
    ranked, gold, _ = _tables(spark, sf_dir)
    return E.err_at_k(ranked, gold).select("query_id", F.round("err", 6).alias("err"))


@query(f"{BASE} select count(*) as requests, round(avg(case when query_id in (select query_id from ranked) then 1 else 0 end::double), 6) as coverage from (select query_id from q union select 99)")
def request_coverage(spark, sf_dir):
    ranked, _, q = _tables(spark, sf_dir)
    return E.request_coverage(q.select("query_id").union(spark.sql("select 99")), ranked).withColumn("coverage", F.round("coverage", 6))


@query("""with r as (select ((doc_id * 37) % 100) / 99.0::double as confidence, quality as correct from labels),
b as (select least(cast(floor(confidence * 10) as bigint), 9) as b, count(*) as n, abs(avg(confidence) - avg(correct)) as gap from r group by 1)
select cast(sum(n) as bigint) as n, round(sum(n * gap) / sum(n), 6) as ece from b""")
def calibration_error(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") * 37 % 100 / 99.0).alias("confidence"), F.col("quality").alias("correct"))
    return E.calibration_error(rows).withColumn("ece", F.round("ece", 6))


@query("""with v as (select doc_id % 100 as item_id, (doc_id % 365)::double as age, quality * 2 - 1 as vote from labels),
p as (select item_id, sum(exp(-age / 30.0)) as n, sum(exp(-age / 30.0) * vote) as s from v group by 1), m as (select sum(s) / sum(n) as mu from p)
select item_id, round((s + 10 * mu) / (n + 10), 6) as score from p, m""")
def time_decayed_votes(spark, sf_dir):
    v = table(spark, sf_dir, "labels").select((F.col("doc_id") % 100).alias("item_id"), (F.col("doc_id") % 365).cast("double").alias("age_days"), (F.col("quality") * 2 - 1).alias("vote"))
    return E.time_decayed_votes(v).withColumn("score", F.round("score", 6))
