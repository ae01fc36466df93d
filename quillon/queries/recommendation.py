"""Queries on verdicts, candidates, evidence scores and recommendation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.fixtures import ctes, review_tag, reviews, rule_hash, rule_sql, tag_vectors
from quillon.operators import enrich as N
from quillon.operators import evaluate as E
from quillon.operators.search import best_first, hit_scores, phrase_hits
from quillon.plans import recommend as R
from quillon.queries.search import bm25_sql, hits_sql, search_index
from quillon.queries.vectors import SIMS, aspect_vectors
from quillon.registry import query
from quillon.runtime import save_stage, shared_path
from quillon.sources.results import ResultStore

REQUESTS = "values (1, ' the, and ,of'), (2, 'esat, , ndon'), (3, 'the,the'), (4, '')"
ASPECT_SQL = f"""rq(query_id, aspects) as ({REQUESTS}),
al as (select query_id, list_filter(list_transform(string_split(aspects, ','), lambda x: trim(x)), lambda x: x <> '') as l from rq),
aspects as (select query_id, cast(unnest(range(len(l))) as integer) as pos, unnest(l) as aspect from al)"""
Q = "select distinct aspect, aspect from aspects"


def requests(spark):
    return spark.sql(f"select * from {REQUESTS} as t(query_id, aspects)")


def aspect_hits(spark, sf_dir):
    """Hits of each aspect, with what orders them (``rank``, best first)."""
    asked = R.aspect_table(requests(spark)).select(F.col("aspect").alias("query_id"), F.col("aspect").alias("query")).distinct()
    return hit_scores(search_index(spark, sf_dir), asked).select(F.col("query_id").alias("aspect"), "item_id", "review_id", best_first().alias("rank"))


def judge(hits):
    return hits.withColumns(N.rule_judgment(rule_hash(F.col("aspect"), F.col("review_id"))))


def score(rows):
    return rows.withColumn("score", N.rule_score(rule_hash(F.col("aspect"), F.col("review_id"))))


HITS = f"{ctes('reviews')}, {ASPECT_SQL}, {bm25_sql(Q, key='aspect', text='query')}, {hits_sql(None, key='aspect')}"
H = rule_sql("aspect", "review_id")
SCOPED = "query_id || '|' || aspect"
VERDICT = f"""jd as (select aspect, item_id, review_id, rank, {H} % 3 as j from hits),
vd as (select aspect, item_id, count(*) filter (j <> 2) > 0 as concluded, coalesce(min_by(j = 0, rank) filter (j <> 2), false) as positive from jd group by all)"""
CAND = """pos as (select distinct aspect, item_id from vd where positive), wa as (select distinct query_id, aspect from aspects),
need as (select query_id, count(*) as need from wa group by 1),
cand as (select query_id, item_id from wa join pos using (aspect) join need using (query_id) group by query_id, item_id having count(*) = any_value(need))"""
SCORED = f"sco as (select query_id, aspect, item_id, review_id, list_value(0.2::double, 0.4, 0.5, 0.6, 0.8)[{H} % 5 + 1] as score from cand join wa using (query_id) join hits using (aspect, item_id))"
RANKED = """gs as (select query_id, aspect, item_id, avg(score) as s from sco where score > 0.5 group by all),
ms as (select query_id, item_id, avg(coalesce(s, 0)) as score from cand join wa using (query_id) left join gs using (query_id, aspect, item_id) group by all),
fin as (select query_id, row_number() over (partition by query_id order by round(score, 9) desc, item_id) as rank, item_id, score from ms)"""


@query(f"with {ASPECT_SQL} select query_id, pos, aspect, count(distinct doc_id) as n_reviews from aspects left join documents on contains(lower(text), aspect) group by all")
def aspect_table(spark, sf_dir):
    a = R.aspect_table(requests(spark))
    found = phrase_hits(search_index(spark, sf_dir), a.select(F.col("aspect").alias("phrase")))
    found = found.groupBy(F.col("phrase").alias("aspect")).agg(F.count(F.lit(1)).alias("n_reviews"))
    return a.join(found, "aspect", "left").select("query_id", "pos", "aspect", F.coalesce("n_reviews", F.lit(0)).alias("n_reviews"))


@query(f"""with {ASPECT_SQL}, k as (select query_id, pos, aspect, list_value('ontological', 'functional', 'teleological')[length(aspect) % 4 + 1] as kind from aspects),
i as (select *, case when kind is null then [aspect] when aspect < 'f' then [aspect, 'a', 'b', 'c'] else [aspect, aspect || 's', 'very ' || aspect, aspect || ' indeed'] end as words from k)
select query_id, pos, aspect, kind as aspect_type, array_to_string(words, '|') as keywords, count(doc_id) as n_reviews from i left join documents on len(list_filter(words, lambda w: contains(lower(text), w))) > 0 group by all""")
def aspect_infos(spark, sf_dir):
    a = R.aspect_table(requests(spark))
    kind = F.get(F.array(*map(F.lit, ("ontological", "functional", "teleological", "none"))), F.length("aspect") % 4)

    def reply(*words):
        return F.to_json(F.struct(kind.alias("aspect_type"), F.array(*words).alias("starter_keywords")))

    stored = a.filter("aspect < 'f'").select("query_id", "aspect").distinct().withColumn("payload", reply(F.lit("a"), F.lit("b"), F.lit("c")))
    aspect = F.col("aspect")
    said = reply(F.concat(aspect, F.lit("s")), F.concat(F.lit("very "), aspect), F.concat(aspect, F.lit(" indeed")))
    infos = R.aspect_infos(a, stored, lambda rows: rows.withColumn("payload", said))
    words = infos.select("query_id", "pos", F.explode("starter_keywords").alias("phrase"))
    found = words.join(phrase_hits(search_index(spark, sf_dir), words), "phrase").groupBy("query_id", "pos").agg(F.countDistinct("review_id").alias("n_reviews"))
    named = infos.select("query_id", "pos", "aspect", "aspect_type", F.array_join("starter_keywords", "|").alias("keywords"))
    return named.join(found, ["query_id", "pos"], "left").withColumn("n_reviews", F.coalesce("n_reviews", F.lit(0)))


@query(f"{HITS}, {VERDICT} select aspect, item_id, concluded, positive from vd")
def verdict_agg(spark, sf_dir):
    return R.verdict_agg(judge(aspect_hits(spark, sf_dir)))


@query(f"{HITS}, {VERDICT} select aspect, item_id, concluded, positive from vd")
def enrich_judge(spark, sf_dir):
    return R.verdict_agg(R.judge_in_rounds(aspect_hits(spark, sf_dir), judge, size=20))


@query(f"{HITS}, {VERDICT}, av as (select aspect, item_id, count(*) filter (j = 0) > 0 as positive, count(*) filter (j <> 2) > 0 as concluded from jd group by all) select aspect, item_id, concluded, positive from av")
def verdict_any(spark, sf_dir):
    return R.verdict_agg(judge(aspect_hits(spark, sf_dir)), verdict="any")


@query(f"{HITS}, {VERDICT}, {CAND} select query_id, item_id from cand")
def aspect_intersection(spark, sf_dir):
    v = R.verdict_agg(judge(aspect_hits(spark, sf_dir)))
    return R.aspect_intersection(v.filter("positive"), R.aspect_table(requests(spark)))


def _evidence(spark, sf_dir):
    a, hits = R.aspect_table(requests(spark)), save_stage(aspect_hits(spark, sf_dir), "hits")  # for verdicts and for evidence
    c = R.aspect_intersection(R.verdict_agg(judge(hits)).filter("positive"), a)
    return a, c, R.candidate_evidence(c, a, hits)


@query(f"{HITS}, {VERDICT}, {CAND}, {SCORED} select query_id, aspect, item_id, review_id from sco")
def candidate_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir)[2].select("query_id", "aspect", "item_id", "review_id")


@query(f"{HITS}, {VERDICT}, {CAND}, {SCORED} select distinct aspect, item_id, review_id, score from sco")
def enrich_score(spark, sf_dir):
    pairs = _evidence(spark, sf_dir)[2].select("aspect", "item_id", "review_id").distinct()

    def model(frames):
        import hashlib

        for f in frames:
            h = [int(hashlib.md5(f"{a}|{r}".encode()).hexdigest()[:4], 16) for a, r in zip(f["aspect"], f["review_id"], strict=True)]
            yield f.assign(score=[(0.2, 0.4, 0.5, 0.6, 0.8)[x % 5] for x in h])

    return N.apply_model(pairs, model, "aspect string, item_id long, review_id long, score double")


def _in_store(spark, sf_dir, query_scoped):
    """Scores by way of the store: a run for one request, then one for all, whose model sees only what is missing."""
    a, c, e = _evidence(spark, sf_dir)
    e = save_stage(e.select("query_id", "aspect", "item_id", "review_id"), "evidence")

    def model(units):
        of = F.concat_ws("|", F.col("query_id").cast("string"), "aspect") if query_scoped else F.col("aspect")
        return units.withColumn("payload", F.to_json(F.struct(N.rule_score(rule_hash(of, F.col("review_id"))).alias("score"), F.lit("by rule").alias("explanation"), F.lit("").alias("evidence"))))

    store = ResultStore(spark, shared_path(spark, "results"))
    store = N.stored_scores(e.filter("query_id = 1"), store, model, query_scoped)[1]
    return N.stored_scores(e, store, model, query_scoped)[0].select("query_id", "aspect", "item_id", "review_id", "score")


@query(f"{HITS}, {VERDICT}, {CAND}, {SCORED} select query_id, aspect, item_id, review_id, score from sco")
def stored_scores(spark, sf_dir):
    return _in_store(spark, sf_dir, False)


@query(f"{HITS}, {VERDICT}, {CAND}, {SCORED.replace(H, rule_sql(SCOPED, 'review_id'))} select query_id, aspect, item_id, review_id, score from sco")
def query_scoped_scores(spark, sf_dir):
    """As if each request had a judge of its own: a review's score of an aspect depends on who asks."""
    return _in_store(spark, sf_dir, True)


@query(f"""{HITS}, {VERDICT}, {CAND}, {SCORED} select query_id, item_id, count(*) filter (score > 0.5) as positives, count(*) filter (score < 0.5) as negatives from sco group by all""")
def split_polarity(spark, sf_dir):
    p = R.split_polarity(score(_evidence(spark, sf_dir)[2]))
    return p.groupBy("query_id", "item_id").agg(F.count_if(F.col("polarity") == "positive").alias("positives"), F.count_if(F.col("polarity") == "negative").alias("negatives"))


@query(f"{HITS}, {VERDICT}, {CAND}, {SCORED}, {RANKED} select query_id, item_id, round(score, 4) as score from fin")
def item_rank_score(spark, sf_dir):
    a, c, e = _evidence(spark, sf_dir)
    return R.item_rank_score(c, a, score(e)).select("query_id", "item_id", F.round("score", 4).alias("score"))


@query(f"{HITS}, {VERDICT}, {CAND}, {SCORED}, {RANKED} select query_id, rank, item_id, round(score, 4) as score from fin where query_id = 1")
def recommend_by_search(spark, sf_dir):
    a = R.aspect_table(requests(spark)).filter("query_id = 1")
    return R.recommend_by_search(search_index(spark, sf_dir), a, judge, score).withColumns({"score": F.round("score", 4), "rank": F.col("rank").cast("long")})


@query(f"{HITS}, {VERDICT}, {CAND}, {SCORED}, {RANKED} select query_id, rank, item_id, round(score, 4) as score from fin")
def multi_query_recommend(spark, sf_dir):
    return R.recommend_by_search(search_index(spark, sf_dir), R.aspect_table(requests(spark)), judge, score).withColumns({"score": F.round("score", 4), "rank": F.col("rank").cast("long")})


@query(f"{HITS}, {VERDICT}, {CAND}, {SCORED}, {RANKED} select query_id, rank, item_id from fin")
def final_ranking(spark, sf_dir):
    a, c, e = _evidence(spark, sf_dir)
    return R.item_rank_score(c, a, score(e)).select("query_id", F.col("rank").cast("long").alias("rank"), "item_id")


TAGGED = f"""{ctes('tag_vectors', 'review_tag')}, {SIMS}, wa as (select 1 as query_id, aspect from asp), pos as (select distinct aspect, item_id from dec join review_tag using (tag)),
hits as (select distinct aspect, item_id, review_id from dec join review_tag using (tag)),
cand as (select query_id, item_id from wa join pos using (aspect) group by all having count(*) = (select count(*) from wa))"""


@query(f"{TAGGED}, {SCORED}, {RANKED} select query_id, rank, item_id, round(score, 4) as score from fin")
def recommend_by_tags(spark, sf_dir):
    v = aspect_vectors(spark, sf_dir)
    a = v.select(F.lit(1).alias("query_id"), "aspect")
    vectors, tagged = tag_vectors(spark, sf_dir), review_tag(spark, sf_dir).select("tag", "review_id")
    stored_tags, stored_vectors = tagged.filter("review_id % 3 = 0"), vectors.filter("tag % 2 = 0")
    # in place of models: the fixture's tags and vectors of whatever is asked for
    found = R.recommend_from_reviews(
        reviews(spark, sf_dir).select("review_id", "item_id"), a, v, stored_tags, stored_vectors,
        lambda rows: rows.join(tagged, "review_id"), lambda tags: tags.join(vectors, "tag"), score,
    )
    return found.withColumns({"score": F.round("score", 4), "rank": F.col("rank").cast("long")})


EVIDENCE = f"{ctes('review_tag')}, sco as (select 1 as query_id, 'tag_' || tag % 5 as aspect, item_id, review_id, list_value(0.2::double, 0.4, 0.5, 0.6, 0.8)[{rule_sql('tag', 'review_id')} % 5 + 1] as score from review_tag)"


def evidence(spark, sf_dir):
    """A score for every tagged review: query, aspect, item, review, score."""
    t = review_tag(spark, sf_dir)
    s = N.rule_score(rule_hash(F.col("tag").cast("string"), F.col("review_id")))
    return t.select(F.lit(1).alias("query_id"), F.concat(F.lit("tag_"), (F.col("tag") % 5).cast("string")).alias("aspect"), "item_id", "review_id", s.alias("score"))


@query(f"{EVIDENCE} select query_id, item_id, aspect, round(ln(1 + max(score)), 6) as by_max, round(ln(1 + sum(exp(score) * score) / sum(exp(score))), 6) as by_softmax from sco group by all")
def aspect_utility(spark, sf_dir):
    return E.aspect_utility(evidence(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("by_max", "by_softmax")})


RISK = """u as (select query_id, item_id, sum(m) as u from (select query_id, item_id, aspect, ln(1 + max(score)) as m from sco group by all) group by all),
s as (select query_id, item_id, var_pop(case when score > 0.5 then 1.0 when score < 0.5 then -1.0 else 0 end::double) as v from sco group by all),
risk as (select query_id, item_id, u - 0.5 * v as score from u join s using (query_id, item_id))"""


def _diverse_sql(k: int, penalty: float = 0.1) -> str:
    """The greedy choice unrolled: each round ranks what is left by score less the penalty per tag shared with those taken."""
    out, so_far = [EVIDENCE, RISK, "tg as (select distinct item_id, tag from review_tag)"], "select null::int as query_id, null::bigint as item_id where false"
    for place in range(1, k + 1):
        out += [
            f"a{place} as ({so_far})", f"t{place} as (select distinct query_id, tag from a{place} join tg using (item_id))",
            f"s{place} as (select query_id, item_id, count(*) as shared from risk join tg using (item_id) join t{place} using (query_id, tag) group by all)",
            f"p{place} as (select query_id, item_id, score - {penalty} * coalesce(shared, 0) as score from risk left join s{place} using (query_id, item_id) where (query_id, item_id) not in (select (query_id, item_id) from a{place}))",
            f"c{place} as (select query_id, {place} as place, item_id, score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, item_id) as r from p{place}) where r = 1)",
        ]
        so_far = " union all ".join(f"select query_id, item_id from c{i}" for i in range(1, place + 1))
    return ", ".join(out) + " select query_id, place, item_id, round(score, 6) as score from (" + " union all ".join(f"select * from c{i}" for i in range(1, k + 1)) + ")"


@query(f"{EVIDENCE}, {RISK} select query_id, item_id, round(score, 6) as score from risk")
def risk_adjusted_score(spark, sf_dir):
    return E.risk_adjusted_score(evidence(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(_diverse_sql(5))
def diverse_topk(spark, sf_dir):
    s = E.risk_adjusted_score(evidence(spark, sf_dir))
    return E.diverse_topk(s, review_tag(spark, sf_dir).select("item_id", "tag").distinct(), k=5).withColumn("score", F.round("score", 6))


@query(f"{EVIDENCE}, c as (select aspect, item_id, count(*) as n, avg(case when score > 0.5 then 1.0 else 0 end) as positive, avg(case when score < 0.5 then 1.0 else 0 end) as negative from sco group by all) select aspect, item_id, n, round(positive, 6) as positive, round(negative, 6) as negative, least(positive, negative) >= 0.25 as mixed from c")
def contradiction_report(spark, sf_dir):
    return E.contradiction_report(evidence(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("positive", "negative")})


@query(f"{EVIDENCE} select item_id, aspect, review_id, round(0.5 * score + 0.2 * (review_id % 7) / 7.0 + 0.2 * (item_id % 5) / 5.0 + 0.1 * (review_id % 3) / 3.0, 6) as segment_score from sco")
def segment_score(spark, sf_dir):
    f = evidence(spark, sf_dir).withColumns({"sim": F.col("score"), "a": F.col("review_id") % 7 / 7.0, "r": F.col("item_id") % 5 / 5.0, "d": F.col("review_id") % 3 / 3.0})
    return E.segment_score(f).select("item_id", "aspect", "review_id", F.round("segment_score", 6).alias("segment_score"))


@query(f"{EVIDENCE}, g as (select distinct aspect from sco where score > 0.7) select query_id, round(avg(case when g.aspect is null then 0 else 1 end::double), 6) as coverage from (select distinct query_id, aspect from sco union select 1, 'never') w left join g using (aspect) group by all")
def aspect_coverage(spark, sf_dir):
    e = evidence(spark, sf_dir)
    wanted = e.select("query_id", "aspect").union(spark.sql("select 1, 'never'"))
    return E.aspect_coverage(wanted, e.filter("score > 0.7")).withColumn("coverage", F.round("coverage", 6))
