"""Recommending items that satisfy every aspect of a request, with evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.prompts import ASPECT_KINDS
from quillon.functions.text import aspect_list
from quillon.operators.enrich import pending_work
from quillon.operators.index import SearchIndex
from quillon.operators.search import best_first, hit_scores, indexed, search_reviews
from quillon.operators.tags import tag_items, top_decile_tags
from quillon.ranking import grouped_rank
from quillon.runtime import save_stage


def aspect_table(queries: DataFrame) -> DataFrame:
    """``query_id``, ``pos``, ``aspect`` from comma-separated text; repeats stay."""
    return queries.select("query_id", F.posexplode(aspect_list(F.col("aspects"))).alias("pos", "aspect"))


def with_keywords(aspects: DataFrame, infos: DataFrame) -> DataFrame:
    """Adds each aspect's type and starter keywords with the aspect itself in front; without an info only the aspect."""
    joined = aspects.join(infos, [c for c in ("query_id", "aspect") if c in infos.columns], "left")
    return joined.withColumn("starter_keywords", F.concat(F.array("aspect"), F.coalesce("starter_keywords", F.array().cast("array<string>"))))


def aspect_infos(aspects: DataFrame, stored: DataFrame, model) -> DataFrame:
    """Typed aspects: ``query_id``, ``pos``, ``aspect``, ``aspect_type``, ``starter_keywords``.

    ``stored`` holds replies of earlier runs (``query_id``, ``aspect``, ``payload``); ``model`` adds ``payload`` to the pairs
    that have none, once each. A reply that does not parse, names an unknown type or has other than 3 to 6 keywords counts
    as no info.
    """
    wanted = aspects.select("query_id", "aspect").distinct()
    fresh = model(pending_work(wanted, stored, ["query_id", "aspect"])).select("query_id", "aspect", "payload")
    replies = stored.select("query_id", "aspect", "payload").unionByName(fresh).dropDuplicates(["query_id", "aspect"])
    infos = replies.select("query_id", "aspect", F.from_json("payload", "aspect_type string, starter_keywords array<string>").alias("i")).select("query_id", "aspect", "i.*")
    infos = infos.filter(F.col("aspect_type").isin(*ASPECT_KINDS) & F.size("starter_keywords").between(3, 6))
    return with_keywords(aspects, infos).select("query_id", "pos", "aspect", "aspect_type", "starter_keywords")


def verdict_agg(judged: DataFrame, verdict: str = "first") -> DataFrame:
    """Per aspect and item: ``concluded`` and ``positive``.

    ``first``: the first conclusive review by rank decides; ``any``: one conclusive positive review is enough. The judged
    reviews are read once.
    """
    said = F.when(F.col("is_conclusive"), F.col("is_positive"))
    positive = F.min_by(said, F.when(F.col("is_conclusive"), F.col("rank"))) if verdict == "first" else F.max(said)
    return judged.groupBy("aspect", "item_id").agg(positive.alias("positive")).select("aspect", "item_id", F.col("positive").isNotNull().alias("concluded"), F.coalesce("positive", F.lit(False)).alias("positive"))


def judge_in_rounds(hits: DataFrame, judge, size: int = 1) -> DataFrame:
    """Judge hits (``aspect``, ``item_id``, ``review_id``, ``rank``) best first until each item is concluded.

    The first round takes the best ``size`` hits of every (aspect, item) and applies ``judge`` (adds is_conclusive and
    is_positive); each later round takes as many more of those still open as had been judged before, so that the rounds
    grow with the logarithm of the hits. Concluded items take no part in later rounds. Returns the judged hits.
    """
    keys = ["aspect", "item_id"]
    batch = F.floor((F.col("place") - 1) / size)
    todo = grouped_rank(hits, keys, ["rank", "review_id"], "place").withColumn("turn", F.when(batch > 0, F.length(F.bin(batch))).otherwise(0))
    todo = save_stage(todo.drop("place"), "todo")
    out, turn = None, 0
    while not todo.isEmpty():
        now = save_stage(judge(todo.filter(F.col("turn") == turn)), "judged")
        out = now if out is None else out.unionByName(now)
        closed = now.filter("is_conclusive").select(*keys).distinct()
        todo = save_stage(todo.filter(F.col("turn") > turn).join(closed, keys, "left_anti"), "todo")
        turn += 1
    return judge(todo.filter("false")) if out is None else out


def aspect_intersection(positives: DataFrame, aspects: DataFrame) -> DataFrame:
    """Items that are positive for every distinct aspect of a query: ``query_id``, ``item_id``. No aspects, no items."""
    wanted = aspects.select("query_id", "aspect").distinct()
    need = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    got = wanted.join(positives.select("aspect", "item_id").distinct(), "aspect").groupBy("query_id", "item_id").agg(F.count(F.lit(1)).alias("got"))
    return got.join(need, "query_id").filter("got = need").select("query_id", "item_id")


def candidate_evidence(candidates: DataFrame, aspects: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits of each candidate for each aspect of its query, in one join."""
    wanted = candidates.join(aspects.select("query_id", "aspect").distinct(), "query_id")
    return wanted.join(hits.select("aspect", "item_id", "review_id"), ["aspect", "item_id"])


def split_polarity(scored: DataFrame) -> DataFrame:
    """Adds ``polarity``: positive above 0.5, negative below, null at 0.5."""
    return scored.withColumn("polarity", F.when(F.col("score") > 0.5, "positive").when(F.col("score") < 0.5, "negative"))


def item_rank_score(candidates: DataFrame, aspects: DataFrame, scored: DataFrame) -> DataFrame:
    """Mean over a query's aspects of the mean positive score (0 without one), ranked: ``query_id``, ``rank``, ``item_id``, ``score``."""
    wanted = candidates.join(aspects.select("query_id", "aspect").distinct(), "query_id")
    good = split_polarity(scored).filter("polarity = 'positive'").groupBy("query_id", "aspect", "item_id").agg(F.avg("score").alias("s"))
    means = wanted.join(good, ["query_id", "aspect", "item_id"], "left").groupBy("query_id", "item_id").agg(F.avg(F.coalesce("s", F.lit(0.0))).alias("score"))
    return final_ranking(means)


def final_ranking(scores: DataFrame) -> DataFrame:
    """Items of each query by score, ties by id; a query with a great many items is ranked by several tasks."""
    placed = grouped_rank(scores.select("query_id", "item_id", "score"), ["query_id"], [F.desc(F.round("score", 9)), "item_id"], "rank")
    return placed.select("query_id", "rank", "item_id", "score")


def _aspect_hits(index: SearchIndex, asked: DataFrame, review_k: int | None) -> DataFrame:
    """``aspect``, ``item_id``, ``review_id`` and what orders the hits of an aspect (``rank``): all of them, or those among
    its ``review_k`` best reviews. Nobody needs their places among all reviews, so none are counted."""
    if review_k is None:
        hits = hit_scores(index, asked)
    else:
        hits = search_reviews(index, asked, topk=review_k)
    return hits.select(F.col("query_id").alias("aspect"), "item_id", "review_id", best_first().alias("rank"))


def recommend_by_search(reviews: DataFrame | SearchIndex, aspects: DataFrame, judge, score, review_k: int | None = None, size: int = 4) -> DataFrame:
    """Search reviews per aspect, judge each item's best ones until it is concluded, intersect the aspects' items, score the
    evidence, rank."""
    asked = aspects.select(F.col("aspect").alias("query_id"), F.col("aspect").alias("query")).distinct()
    hits = save_stage(_aspect_hits(indexed(reviews), asked, review_k), "hits")
    verdicts = verdict_agg(judge_in_rounds(hits, judge, size))
    candidates = aspect_intersection(verdicts.filter("positive"), aspects)
    return item_rank_score(candidates, aspects, score(candidate_evidence(candidates, aspects, hits)))


def tag_and_embed(reviews: DataFrame, stored_tags: DataFrame, stored_vectors: DataFrame, tag_model, embed_model) -> tuple[DataFrame, DataFrame]:
    """Tags of all reviews (``tag``, ``review_id``, ``item_id``) and vectors of all tags (``tag``, ``embedding``).

    ``tag_model`` maps reviews without stored tags to (``review_id``, ``tag``), ``embed_model`` tags without a stored
    vector to (``tag``, ``embedding``): stored results are never made again.
    """
    fresh = tag_model(pending_work(reviews, stored_tags, ["review_id"])).select("tag", "review_id")
    every = stored_tags.select("tag", "review_id").unionByName(fresh).distinct().join(reviews.select("review_id", "item_id"), "review_id")
    every = save_stage(every.select("tag", "review_id", "item_id"), "tags")
    names = every.select("tag").distinct()
    vectors = stored_vectors.select("tag", "embedding").join(names, "tag", "left_semi")
    return every, vectors.unionByName(embed_model(pending_work(names, stored_vectors, ["tag"])).select("tag", "embedding"))


def recommend_from_reviews(reviews: DataFrame, aspects: DataFrame, aspect_vectors: DataFrame, stored_tags: DataFrame, stored_vectors: DataFrame, tag_model, embed_model, score) -> DataFrame:
    """Tag the reviews and embed the tags that have no stored result, then recommend by tags."""
    review_tag, tag_vectors = tag_and_embed(reviews, stored_tags, stored_vectors, tag_model, embed_model)
    return recommend_by_tags(aspects, aspect_vectors, tag_vectors, review_tag, score)


def recommend_by_tags(aspects: DataFrame, aspect_vectors: DataFrame, tag_vectors: DataFrame, review_tag: DataFrame, score) -> DataFrame:
    """Similar tags per aspect give items, which are intersected; evidence is what the tags' reviews say."""
    tags = top_decile_tags(aspect_vectors, tag_vectors, review_tag).select("aspect", "tag")
    candidates = aspect_intersection(tag_items(tags, review_tag), aspects)
    hits = tags.join(review_tag, "tag").select("aspect", "item_id", "review_id").distinct()
    return item_rank_score(candidates, aspects, score(candidate_evidence(candidates, aspects, hits)))
