"""Evaluating rankings, and scores over evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.runtime import save_measured, save_stage


def _judged(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    return ranked.filter(F.col("rank") <= k).join(gold, ["query_id", "item_id"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))


def precision_at_k(ranked: DataFrame, gold: DataFrame, k: int = 3) -> DataFrame:
    return _judged(ranked, gold, k).groupBy("query_id").agg((F.sum(F.when(F.col("gain") > 0, 1.0).otherwise(0.0)) / k).alias("precision"))


def recall_at_k(ranked: DataFrame, gold: DataFrame, k: int = 3) -> DataFrame:
    good = gold.filter("gain > 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hit = _judged(ranked, gold, k).groupBy("query_id").agg(F.sum(F.when(F.col("gain") > 0, 1.0).otherwise(0.0)).alias("h"))
    return good.join(hit, "query_id", "left").select("query_id", (F.coalesce("h", F.lit(0.0)) / F.col("n")).alias("recall"))


def ndcg_at_k(ranked: DataFrame, gold: DataFrame, k: int = 3) -> DataFrame:
    """Normalised discounted gain; 0 where the gold has no gain."""
    discount = 1 / F.log2(F.col("rank") + 1)
    dcg = _judged(ranked, gold, k).groupBy("query_id").agg(F.sum(F.col("gain") * discount).alias("dcg"))
    order = W.partitionBy("query_id").orderBy(F.desc("gain"), "item_id")
    ideal = gold.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).groupBy("query_id").agg(F.sum(F.col("gain") * discount).alias("ideal"))
    return ideal.join(dcg, "query_id", "left").select("query_id", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def err_at_k(ranked: DataFrame, gold: DataFrame, k: int = 3, top_gain: float = 1.0) -> DataFrame:
    """Expected reciprocal rank: a gain g stops a reader with the probability (2^g - 1) / 2^top_gain."""
    p = F.least(F.lit(0.999999), (F.pow(F.lit(2.0), F.col("gain")) - 1) / 2.0**top_gain)
    w = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    go = _judged(ranked, gold, k).withColumn("p", p).withColumn("go", F.exp(F.coalesce(F.sum(F.log(1 - F.col("p"))).over(w), F.lit(0.0))))
    return go.groupBy("query_id").agg(F.sum(F.col("go") * F.col("p") / F.col("rank")).alias("err"))


def request_coverage(requests: DataFrame, ranked: DataFrame) -> DataFrame:
    """The share of requests with a candidate."""
    got = ranked.select("query_id").distinct().withColumn("got", F.lit(1.0))
    return requests.join(got, "query_id", "left").agg(F.count(F.lit(1)).alias("requests"), F.avg(F.coalesce("got", F.lit(0.0))).alias("coverage"))


def aspect_coverage(aspects: DataFrame, good: DataFrame) -> DataFrame:
    """Per query the share of its distinct aspects with a good segment."""
    wanted = aspects.select("query_id", "aspect").distinct()
    got = wanted.join(good.select("aspect").distinct().withColumn("g", F.lit(1.0)), "aspect", "left")
    return got.groupBy("query_id").agg(F.avg(F.coalesce("g", F.lit(0.0))).alias("coverage"))


def segment_score(features: DataFrame, alpha: float = 0.5, beta: float = 0.2, gamma: float = 0.2, delta: float = 0.1) -> DataFrame:
    """alpha x similarity + beta x aspect score + gamma x rating + delta x distance score."""
    total = alpha * F.col("sim") + beta * F.col("a") + gamma * F.col("r") + delta * F.col("d")
    return features.withColumn("segment_score", total)


def aspect_utility(scored: DataFrame) -> DataFrame:
    """Per query, item and aspect: ln(1 + best score), and ln(1 + softmax-weighted mean score)."""
    keys = ["query_id", "item_id", "aspect"]
    e = F.exp(F.col("score"))
    return scored.groupBy(*keys).agg(F.log1p(F.max("score")).alias("by_max"), F.log1p(F.sum(e * F.col("score")) / F.sum(e)).alias("by_softmax"))


def risk_adjusted_score(scored: DataFrame, risk: float = 0.5) -> DataFrame:
    """Sum of aspect utilities less ``risk`` times the variance of polarity over the item's evidence."""
    utility = aspect_utility(scored).groupBy("query_id", "item_id").agg(F.sum("by_max").alias("u"))
    sign = F.when(F.col("score") > 0.5, 1.0).when(F.col("score") < 0.5, -1.0).otherwise(0.0)
    spread = scored.groupBy("query_id", "item_id").agg(F.var_pop(sign).alias("v"))
    return utility.join(spread, ["query_id", "item_id"]).select("query_id", "item_id", (F.col("u") - risk * F.col("v")).alias("score"))


def diverse_topk(scores: DataFrame, item_tags: DataFrame, k: int = 3, penalty: float = 0.1, batch: int = 64, report: dict | None = None) -> DataFrame:
    """Greedy choice of ``k`` items per query, each time by score less ``penalty`` (not negative) per tag shared with those chosen.

    All items of a query stand in every round; ties go to the least item. More chosen items only lower a score, so the one
    that an item had last is a bound: a round scores the ``batch`` items of highest bound anew, and ends when the best of
    them beats all other bounds, else it takes twice as many. ``report`` counts the rows scored anew (``rescored``).
    """
    keys = ["query_id", "item_id"]
    pool = save_stage(scores.select(*keys, "score"), "pool")
    tags = save_stage(item_tags.join(pool.select("item_id").distinct(), "item_id", "left_semi").distinct(), "tags")
    bounds, chosen = None, None  # scores of a few items as of some earlier round

    def order(score: str) -> Column:
        return F.struct(F.col(score).isNull(), -F.round(score, 9), F.col("item_id"))

    for place in range(1, k + 1):
        rest = pool.withColumn("bound", F.col("score"))
        if chosen is not None:
            taken = chosen.select(*keys)
            rest = pool.join(taken, keys, "left_anti").join(bounds, keys, "left").withColumn("bound", F.coalesce("bound", "score"))
            used = save_measured(taken.join(tags, "item_id").select("query_id", "tag").distinct(), "used")
        size, best, open_ = batch, None, None
        while True:
            now = rest if open_ is None else rest.join(open_, "query_id", "left_semi")
            first = W.partitionBy("query_id").orderBy(order("bound"))  # limited before the shuffle
            top = save_measured(now.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= size + 1), "top")
            anew = top.filter(F.col("r") <= size)
            if chosen is not None:
                shared = anew.select(*keys).join(tags, "item_id").join(used, ["query_id", "tag"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("shared"))
                anew = anew.join(shared, keys, "left").withColumn("bound", F.col("score") - penalty * F.coalesce("shared", F.lit(0)))
            anew = save_measured(anew.select(*keys, "bound"), "rescored")
            if report is not None:
                report["rescored"] = report.get("rescored", 0) + anew.count()
            won = anew.groupBy("query_id").agg(F.min(order("bound")).alias("o"), F.min_by(F.struct("item_id", "bound"), order("bound")).alias("b"))
            beaten = top.filter(F.col("r") == size + 1).select("query_id", order("bound").alias("next"))
            won = save_measured(won.join(beaten, "query_id", "left").select("query_id", "b.item_id", F.col("b.bound").alias("score"), F.coalesce(F.col("o") < F.col("next"), F.lit(True)).alias("sure")), "won")
            best = won.filter("sure") if best is None else best.union(won.filter("sure"))
            old = bounds if bounds is None else bounds.join(anew.select(*keys), keys, "left_anti")
            bounds = save_measured(anew if old is None else old.union(anew), "bounds")
            if won.filter("not sure").isEmpty():
                break
            open_, size = won.filter("not sure").select("query_id"), 2 * size
        best = save_measured(best.select("query_id", F.lit(place).alias("place"), "item_id", "score"), "chosen")
        chosen = best if chosen is None else chosen.union(best)
    return chosen


def contradiction_report(scored: DataFrame, mixed_from: float = 0.25) -> DataFrame:
    """Per item and aspect the shares of positive and negative evidence; mixed if both reach ``mixed_from``."""
    good, bad = F.avg(F.when(F.col("score") > 0.5, 1.0).otherwise(0.0)), F.avg(F.when(F.col("score") < 0.5, 1.0).otherwise(0.0))
    out = scored.groupBy("aspect", "item_id").agg(F.count(F.lit(1)).alias("n"), good.alias("positive"), bad.alias("negative"))
    return out.withColumn("mixed", F.least("positive", "negative") >= mixed_from)


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error of ``confidence`` against the 0/1 column ``correct``."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    per = rows.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("confidence") - F.avg(F.col("correct").cast("double"))).alias("gap"))
    return per.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def time_decayed_votes(votes: DataFrame, tau_days: float = 30.0, shrink: float = 10.0) -> DataFrame:
    """Per item the votes weighted by exp(-age / tau), shrunk to the global weighted mean by ``shrink`` pseudo-votes."""
    w = F.exp(-F.col("age_days") / tau_days)
    per = votes.groupBy("item_id").agg(F.sum(w).alias("n"), F.sum(w * F.col("vote")).alias("s"))
    mean = per.agg((F.sum("s") / F.sum("n")).alias("mu"))  # one row
    return per.crossJoin(F.broadcast(mean)).select("item_id", ((F.col("s") + shrink * F.col("mu")) / (F.col("n") + shrink)).alias("score"))


def segment_reviews(reviews: DataFrame) -> DataFrame:
    """Sentences with their position: ``review_id``, ``item_id``, ``position``, ``segment``; blank ones go."""
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return reviews.select("review_id", "item_id", F.posexplode(parts).alias("position", "segment"))


def normal_segment(segment):
    """A segment in lower case with single blanks."""
    return F.lower(F.regexp_replace(F.regexp_replace(segment, r"\s+", " "), r"^ | $", ""))


def exact_collapse(segments: DataFrame) -> DataFrame:
    """Copies of a segment (any case and spacing) as one: the first place and how many support it."""
    text = normal_segment(F.col("segment"))
    place = F.struct("review_id", "position")
    out = segments.groupBy(F.md5(text).alias("digest")).agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("support"))
    return out.select("digest", "p.review_id", "p.position", "support")
