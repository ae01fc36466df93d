"""BM25 over reviews on stored postings: scores, substring hits, ranked review and item search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.text import TOKEN, snippet, tokens
from quillon.operators.index import SearchIndex, build_index, listed, of_terms, postings_containing
from quillon.ranking import grouped_rank, grouped_sum
from quillon.runtime import measured, save_measured, save_stage, shared_path

K1, B = 1.5, 0.75
#: Scores that differ by less count as equal when blocks are left out.
_SLACK = 1e-6


def indexed(reviews: DataFrame | SearchIndex, stop: list[str] | None = None) -> SearchIndex:
    """An index as it is, or a new one of a table of reviews."""
    if isinstance(reviews, SearchIndex):
        return reviews
    return build_index(reviews, shared_path(reviews.sparkSession, "index"), stop)


def query_terms(queries: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """``query_id``, ``term`` and how often the query has it."""
    t = queries.select("query_id", F.explode(tokens("query", stop)).alias("term"))
    return t.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def _weighted(index: SearchIndex, queries: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """Terms of the queries that the index knows with their weights (``query_id``, ``term``, ``times``, ``w``), and their list
    if they are few."""
    terms = save_measured(query_terms(queries, list(index.stop) or None), "asked")
    names = listed(terms)
    known = index.terms(names).join(terms, "term")
    return save_measured(known.select("query_id", "term", "times", (F.col("times") * F.col("idf")).alias("w")), "weights"), names


def _part(index: SearchIndex, k1: float, b: float, tf: Column, n_tokens: Column) -> Column:
    """What a term of weight 1 adds to the score of a review: grows with tf, falls with length."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * n_tokens / (index.mean_tokens or 1.0)))


def postings_lookup(index: SearchIndex, terms: DataFrame) -> DataFrame:
    """Postings of the query terms: ``query_id``, ``review_id``, ``term``, ``times``, ``tf``, ``n_tokens``."""
    terms = save_measured(terms, "asked")
    found = of_terms(index.blocks, listed(terms)).join(terms, "term")
    return found.select("query_id", "term", "times", F.explode("found").alias("f")).select("query_id", "f.review_id", "term", "times", "f.tf", "f.n_tokens")


def bm25_scores(reviews: DataFrame | SearchIndex, queries: DataFrame, k1: float = K1, b: float = B, stop: list[str] | None = None) -> DataFrame:
    """BM25 of every (query, review) that shares a term: ``query_id``, ``review_id``, ``score``. Only the terms' postings are read."""
    index = indexed(reviews, stop)
    weights, names = _weighted(index, queries)
    found = of_terms(index.blocks, names).join(weights, "term").select("query_id", "w", F.explode("found").alias("f"))
    return found.groupBy("query_id", "f.review_id").agg(F.sum(F.col("w") * _part(index, k1, b, F.col("f.tf"), F.col("f.n_tokens"))).alias("score"))


def _scored(index: SearchIndex, chosen: DataFrame, weights: DataFrame, names: list[str] | None, k1: float, b: float) -> DataFrame:
    """Scores of all reviews in the chosen blocks of each query."""
    found = of_terms(index.blocks, names).join(weights, "term").join(chosen, ["query_id", "segment", "block"])
    found = found.select("query_id", "w", F.explode("found").alias("f"))
    return found.groupBy("query_id", "f.review_id").agg(F.sum(F.col("w") * _part(index, k1, b, F.col("f.tf"), F.col("f.n_tokens"))).alias("score"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "review_id")  # limited before the shuffle
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_scores(index: SearchIndex, queries: DataFrame, k: int, k1: float = K1, b: float = B, report: dict | None = None) -> DataFrame:
    """A table that holds the ``k`` best scores above 0 of each query, ties by id: ``query_id``, ``review_id``, ``score``.

    A block's greatest tf and least length bound what a term adds to any of its reviews, so a query's block is bounded by
    the sum over its terms. The ``k`` blocks of highest bound are scored first; their k-th best score is a threshold, and of
    the other blocks only those whose bound reaches it are scored. No postings of the rest are unpacked. With ``report``,
    the postings unpacked (``read``) and those of all terms (``all``) are counted into it.
    """
    weights, names = _weighted(index, queries)
    sized = of_terms(index.blocks, names).select("term", "segment", "block", "max_tf", "min_tokens", *([F.size("found").alias("n")] if report is not None else [F.lit(0).alias("n")]))
    # a term of negative weight may be missing from a review
    most = F.greatest(F.lit(0.0), F.col("w")) * _part(index, k1, b, F.col("max_tf"), F.col("min_tokens"))
    bounds = sized.join(weights, "term").groupBy("query_id", "segment", "block").agg(F.sum(most).alias("bound"), F.sum("n").alias("n"))
    bounds = save_stage(bounds.filter("bound > 0"), "bounds")
    first = W.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block")
    first = bounds.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k).select("query_id", "segment", "block")
    first = save_measured(first, "first")
    scores = save_stage(_best(_scored(index, first, weights, names, k1, b).filter("score > 0"), k), "scores")
    least = scores.filter(F.col("rank") == k).select("query_id", (F.col("score") - _SLACK).alias("least"))
    rest = bounds.join(measured(least), "query_id", "left").filter(F.col("bound") >= F.coalesce("least", F.lit(0.0)))
    rest = save_measured(rest.join(first, ["query_id", "segment", "block"], "left_anti").select("query_id", "segment", "block", "n"), "rest")
    if report is not None:
        report["all"] = bounds.agg(F.sum("n")).first()[0] or 0
        report["read"] = (rest.agg(F.sum("n")).first()[0] or 0) + (bounds.join(first, ["query_id", "segment", "block"]).agg(F.sum("n")).first()[0] or 0)
    more = _scored(index, rest.drop("n"), weights, names, k1, b).filter("score > 0")
    return scores.drop("rank").union(more)


def fused_search(reviews: DataFrame | SearchIndex, keywords: DataFrame, topk: int = 10, depth: int = 100, flat: int = 60) -> DataFrame:
    """Search with several ``keyword`` rows a ``query_id``: ``query_id``, ``rank``, ``review_id``, ``score``, ``n_keywords``.

    Each distinct keyword ranks its ``depth`` best reviews of score above 0 by itself; a review's score is the sum of
    1 / (``flat`` + rank) over the keywords that rank it (reciprocal rank fusion), so keywords of any weight count alike. A
    keyword that a query has twice counts once; ties by id; keywords without a known term rank nothing.
    """
    index = indexed(reviews)
    pairs = save_measured(keywords.select("query_id", "keyword").filter("keyword is not null").distinct(), "keywords")
    asked = pairs.select(F.col("keyword").alias("query_id"), F.col("keyword").alias("query")).distinct()
    ranked = _best(top_scores(index, asked, depth), depth).select(F.col("query_id").alias("keyword"), "review_id", "rank")
    fused = ranked.join(pairs, "keyword").groupBy("query_id", "review_id").agg(F.sum(1.0 / (flat + F.col("rank"))).alias("score"), F.count(F.lit(1)).alias("n_keywords"))
    return _best(fused, topk).select("query_id", "rank", "review_id", "score", "n_keywords")


def hit_scores(reviews: DataFrame | SearchIndex, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """Reviews in which a query token is a substring: ``query_id``, ``review_id``, ``item_id``, ``place`` (in the query, of the
    first token that is), ``score`` (0 where no whole term is shared).

    A token lies within one term of a text, so terms that hold a token are looked up in the vocabulary, and hits and scores
    come from one pass over those terms' postings; no text is read.
    """
    index = indexed(reviews)
    weights, _ = _weighted(index, queries)
    asked = queries.select("query_id", F.posexplode(tokens("query", list(index.stop) or None)).alias("place", "part"))
    asked = asked.groupBy("query_id", "part").agg(F.min("place").alias("place"))
    asked = asked.join(weights.select("query_id", F.col("term").alias("part"), "w"), ["query_id", "part"], "left")
    whole = F.when(F.col("term") == F.col("part"), F.col("w"))  # a term that only holds the token scores nothing
    found = postings_containing(index, asked).select("query_id", "place", whole.alias("w"), F.explode("found").alias("f"))
    score = F.coalesce(F.sum(F.col("w") * _part(index, k1, b, F.col("f.tf"), F.col("f.n_tokens"))), F.lit(0.0))
    return found.groupBy("query_id", "f.review_id", "f.item_id").agg(F.min("place").alias("place"), score.alias("score"))


def best_first(score: Column | str = "score") -> Column:
    """Orders hits of one query: best first, equal scores by id."""
    return F.struct((-F.round(score, 9)).alias("score"), "review_id")


def phrase_hits(index: SearchIndex, phrases: DataFrame) -> DataFrame:
    """``phrase``, ``review_id``: the reviews whose lower-cased text holds each distinct phrase as a substring.

    A phrase that is one token is found by terms alone. Of one with separators each token lies within a term, so reviews that
    lack such a term for any of its tokens are left out before texts are compared. Phrases without a token are compared with
    all texts. Null and empty phrases have no hits.
    """
    asked = phrases.select("phrase").filter("phrase is not null and phrase <> ''").distinct().withColumn("parts", F.array_distinct(F.regexp_extract_all("phrase", F.lit(TOKEN), 0)))
    asked = save_stage(asked.withColumn("need", F.size("parts")), "phrases")
    single = (F.col("need") == 1) & (F.get("parts", F.lit(0)) == F.col("phrase"))
    parts = asked.select("phrase", "need", single.alias("single"), F.explode("parts").alias("part"))
    found = postings_containing(index, parts).select("phrase", "need", "single", "part", F.explode("found.review_id").alias("review_id"))
    whole = found.groupBy("phrase", "need", "single", "review_id").agg(F.countDistinct("part").alias("got")).filter("got = need")
    whole = save_stage(whole.select("phrase", "single", "review_id"), "candidates")
    hits = whole.filter("single").select("phrase", "review_id")
    texts = index.reviews.select("review_id", F.lower("text").alias("low"))
    if not asked.filter(~single).isEmpty():
        near = whole.filter("not single").join(texts, "review_id").filter(F.contains("low", "phrase"))
        hits = hits.union(near.select("phrase", "review_id"))
    bare = asked.filter("need = 0").select("phrase")
    if not bare.isEmpty():
        hits = hits.union(texts.join(measured(bare), F.contains("low", "phrase")).select("phrase", "review_id"))
    return hits


def search_reviews(reviews: DataFrame | SearchIndex, queries: DataFrame, topk: int | None = None, item_id: int | None = None, window: int = 100, stop: list[str] | None = None) -> DataFrame:
    """Ranked hits per query: ``query_id``, ``rank``, ``review_id``, ``item_id``, ``score``, ``hit``, ``snippet``.

    All reviews rank (those without a term score 0; ties by id), the top ``topk`` are cut, then reviews of other items and
    reviews in whose text no query token is a substring are left out.
    """
    index = indexed(reviews, stop)
    texts = index.reviews if item_id is None else index.reviews.filter(F.col("item_id") == item_id)
    q = measured(queries.select("query_id", tokens("query", list(index.stop) or None).alias("q")))
    if topk is None:
        ranked = _ranked_hits(index, queries, item_id).join(q, "query_id").withColumn("hit", F.get("q", "place"))
        hits = texts.select("review_id", "text").join(ranked, "review_id")
    else:
        ranked = save_measured(_top_ranked(index, queries, topk), "ranked")
        hits = texts.join(ranked, "review_id").join(q, "query_id")
        low = F.lower(F.coalesce("text", F.lit("")))
        hits = hits.withColumn("hit", F.get(F.filter("q", lambda t: F.contains(low, t)), F.lit(0))).filter("hit is not null")
    hits = hits.withColumn("snippet", snippet(F.col("text"), F.col("hit"), window))
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "review_id", "item_id", "score", "hit", "snippet")


def _top_ranked(index: SearchIndex, queries: DataFrame, topk: int) -> DataFrame:
    """The first ``topk`` reviews of each query: ``query_id``, ``review_id``, ``score``, ``rank``.

    Only the first reviews by id can fill up with score 0; those that score 0 or less by terms of negative weight are scored
    whole, which takes an index whose mean idf is negative.
    """
    scores = top_scores(index, queries, topk) if index.mean_idf >= 0 else bm25_scores(index, queries)
    fill = index.reviews.select("review_id").orderBy("review_id").limit(topk)
    every = queries.select("query_id").distinct().crossJoin(fill).select("query_id", "review_id", F.lit(0.0).alias("score")).union(scores.select("query_id", "review_id", "score"))
    return _best(every.groupBy("query_id", "review_id").agg(F.sum("score").alias("score")), topk)


def _ranked_hits(index: SearchIndex, queries: DataFrame, item_id: int | None) -> DataFrame:
    """Reviews that hold a query token as a substring, with their rank among all reviews.

    Only reviews with a score other than 0 are ordered. A hit with score 0 comes after those above 0, at its place by id
    less the reviews before it that have a score.
    """
    hits = save_stage(hit_scores(index, queries).withColumn("r", F.round("score", 9)), "hits")
    scored, zero = hits.filter("r <> 0"), hits.filter("r = 0")
    if item_id is not None:
        zero = zero.filter(F.col("item_id") == item_id)
    n = save_measured(hits.groupBy("query_id").agg(F.count_if(F.col("r") > 0).alias("above"), F.count_if(F.col("r") != 0).alias("scored")), "counts")
    ranked = grouped_rank(scored, ["query_id"], [F.desc("r"), "review_id"], "rank").join(n, "query_id")
    # a score below 0 (an idf that all terms share may be) comes after all reviews without one
    late = F.when(F.col("r") < 0, F.lit(index.n_reviews) - F.col("scored")).otherwise(0)
    columns = ["query_id", "review_id", "item_id", "place", "score", "rank"]
    first = ranked.withColumn("rank", F.col("rank") + late).select(*columns)
    if item_id is not None:
        first = first.filter(F.col("item_id") == item_id)
    if zero.isEmpty():
        return first
    asked = zero.select("query_id").distinct()
    # scored reviews and zero hits of a query by id: how many scored ones come before; and all reviews by id
    both = zero.select("query_id", "review_id", F.lit(0).alias("has")).union(scored.select("query_id", "review_id", F.lit(1)).join(asked, "query_id", "left_semi"))
    before = grouped_sum(both, ["query_id"], ["review_id"], F.col("has"), "before").filter("has = 0")
    places = grouped_rank(index.reviews.select("review_id"), [], ["review_id"], "by_id")
    last = zero.join(before.select("query_id", "review_id", "before"), ["query_id", "review_id"]).join(places, "review_id").join(n, "query_id")
    return first.union(last.withColumn("rank", F.col("above") + F.col("by_id") - F.col("before")).select(*columns))


def best_hit_per_item(hits: DataFrame) -> DataFrame:
    """The best hit of each item: its review, score and snippet."""
    best = F.max_by(F.struct("review_id", "score", "snippet"), F.struct(F.round("score", 9), -F.col("review_id")))
    return hits.groupBy("query_id", "item_id").agg(best.alias("h")).select("query_id", "item_id", "h.review_id", "h.score", "h.snippet")


def item_search(reviews: DataFrame | SearchIndex, items: DataFrame, queries: DataFrame, topk: int = 5, review_k: int | None = None, agg: str = "sum") -> DataFrame:
    """Items by the sum, mean or max of their hits' scores, with name, rating and the best snippet.

    The ``topk`` items come from the ``review_k`` (20 x topk) best reviews; unknown items keep null names.
    """
    hits = search_reviews(reviews, queries, topk=review_k or 20 * topk)
    how = {"sum": F.sum, "mean": F.avg, "max": F.max}[agg]
    by_item = hits.groupBy("query_id", "item_id").agg(
        how("score").alias("score"), F.count(F.lit(1)).alias("n_hits"),
        F.max_by("snippet", F.struct(F.round("score", 9), -F.col("review_id"))).alias("snippet"),
    )
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "item_id")
    top = by_item.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= topk)
    return top.join(items.select("item_id", "name", "stars"), "item_id", "left").select("query_id", "rank", "item_id", "name", "stars", "score", "n_hits", "snippet")


def item_search_topm(reviews: DataFrame | SearchIndex, queries: DataFrame, retrieve: int = 500, topm: int = 3, topk: int = 5, stop: list[str] | None = None) -> DataFrame:
    """Items by the sum of their ``topm`` best hits; ties by more supporting reviews, then id; evidence ids best first."""
    hits = search_reviews(reviews, queries, topk=retrieve, stop=stop)
    w = W.partitionBy("query_id", "item_id").orderBy("rank")
    hits = hits.withColumn("r", F.row_number().over(w))
    by_item = hits.groupBy("query_id", "item_id").agg(
        F.sum(F.when(F.col("r") <= topm, F.col("score"))).alias("score"), F.count(F.lit(1)).alias("support"),
        F.array_sort(F.collect_list(F.when(F.col("r") <= topm, F.struct("rank", "review_id")))).alias("e"),
    )
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.desc("support"), "item_id")
    top = by_item.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= topk)
    return top.select("query_id", "rank", "item_id", "score", "support", F.concat_ws(",", F.transform("e", lambda s: s["review_id"].cast("string"))).alias("evidence"))
