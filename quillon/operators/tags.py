"""Tags, their vectors, and sampling in vector space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.vectors import cosine
from quillon.ranking import greatest_rows, grouped_rank
from quillon.runtime import small


def inverted_tags(review_tag: DataFrame) -> DataFrame:
    """Reviews and items per tag (distinct); tags of any frequency stay counts, not lists."""
    return review_tag.select("tag", "review_id", "item_id").distinct().groupBy("tag").agg(F.count(F.lit(1)).alias("n_reviews"), F.countDistinct("item_id").alias("n_items"))


def tag_items(tags: DataFrame, review_tag: DataFrame) -> DataFrame:
    """Distinct items of given tags (``tag`` and any keys beside it)."""
    keys = [c for c in tags.columns if c != "tag"]
    return tags.join(review_tag, "tag").select(*keys, "item_id").distinct()


def top_decile_tags(aspects: DataFrame, tag_vectors: DataFrame, review_tag: DataFrame, share: float = 0.1) -> DataFrame:
    """For each aspect (``aspect``, ``vector``) the most similar tenth of the tags in use, at least one, not of negative similarity."""
    used = tag_vectors.join(review_tag.select("tag").distinct(), "tag", "left_semi")
    keep = used.agg(F.greatest(F.lit(1), F.floor(F.lit(float(share)) * F.count(F.lit(1))).cast("int")).alias("keep"))
    sims = used.crossJoin(small(aspects, aspects.count(), 10_000)).withColumn("similarity", cosine(F.col("embedding"), F.col("vector")))
    sims = sims.select("aspect", "tag", "similarity", F.round("similarity", 9).alias("r"))
    wanted = aspects.select("aspect").distinct().crossJoin(F.broadcast(keep))
    top = greatest_rows(sims, "aspect", "r", "tag", wanted).filter("similarity >= 0")
    return grouped_rank(top, ["aspect"], [F.desc("r"), "tag"], "rank").select("aspect", "rank", "tag", "similarity")


def vector_moments(vectors: DataFrame, col: str = "embedding") -> DataFrame:
    """Mean and population deviation per dimension; a deviation of 0 becomes 1."""
    flat = vectors.select(F.posexplode(col).alias("dim", "x"))
    s = F.stddev_pop("x")
    return flat.groupBy("dim").agg(F.avg("x").alias("mean"), F.when(s == 0, 1.0).otherwise(s).alias("std"))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) from md5 of seed and keys: the same on any partitioning and in SQL."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def sample_points(moments: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` Gaussian points around the vectors' moments: ``point``, ``vector`` (Box-Muller over hashed uniforms)."""
    points = moments.sparkSession.range(n).withColumnRenamed("id", "point")
    grid = points.crossJoin(moments)
    z = F.sqrt(-2 * F.log(uniform(seed, F.col("point"), F.col("dim"), F.lit("a")))) * F.cos(2 * F.lit(3.141592653589793) * uniform(seed, F.col("point"), F.col("dim"), F.lit("b")))
    rows = grid.withColumn("x", F.col("mean") + F.col("std") * z).groupBy("point").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v"))
    return rows.select("point", F.transform("v", lambda s: s["x"]).alias("vector"))


def nearest_vector(points: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """The most similar row of ``vectors`` for each point (smallest key on ties); points are broadcast when few."""
    sims = vectors.select(key, "embedding").crossJoin(small(points, points.count(), 10_000)).withColumn("s", F.round(cosine(F.col("embedding"), F.col("vector")), 9))
    return sims.groupBy("point").agg(F.max_by(key, F.struct("s", -F.col(key))).alias(key), F.max("s").alias("similarity"))


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42, out: str = "place") -> DataFrame:
    """A hash that orders rows in a seeded random order."""
    return df.withColumn(out, F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))))


def first_seen_limit(nearest: DataFrame, vectors: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` distinct nearest keys in order of points, filled up from a seeded shuffle of the rest."""
    seen = nearest.groupBy(key).agg(F.min("point").alias("point")).select(key, F.lit(0).alias("part"), F.lpad(F.col("point").cast("string"), 20, "0").alias("place"))
    rest = seeded_shuffle(vectors.select(key).join(seen, key, "left_anti"), key, seed).select(key, F.lit(1).alias("part"), "place")
    # a top-n list is the result: a global order of at most n rows
    top = seen.union(rest).orderBy("part", "place", key).limit(n)
    return top.withColumn("position", F.row_number().over(W.orderBy("part", "place", key))).select("position", key)


def keyword_dedup(rows: DataFrame) -> DataFrame:
    """The first row (by ``position``) of each keyword in any case; blank keywords go."""
    w = W.partitionBy(F.lower("keyword")).orderBy("position")
    return rows.filter("keyword <> ''").withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def bundle_assign(keywords: DataFrame, requests: int, per_request: int, seed: int = 42) -> DataFrame:
    """Deal keywords (``position``, ``keyword``) round robin, reshuffled each cycle: ``request``, ``slot``, ``keyword``, labels."""
    pool = keywords.count()
    slots = keywords.sparkSession.range(requests * per_request).select(F.col("id").alias("n"))
    if not pool:
        return slots.filter("false").select(F.col("n").alias("request"), F.col("n").alias("slot"), F.lit("").alias("keyword"), F.lit("").alias("importance"), F.lit("").alias("performance"))
    cycles = -(-requests * per_request // pool)
    dealt = keywords.crossJoin(keywords.sparkSession.range(cycles).withColumnRenamed("id", "cycle"))
    dealt = dealt.withColumn("place", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("cycle").cast("string"), F.col("position").cast("string"))))
    dealt = grouped_rank(dealt, ["cycle"], ["place", "position"], "r").withColumn("n", F.col("cycle") * pool + F.col("r") - 1)

    def label(kind: str, names: list[str]) -> Column:
        h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}{kind}"), F.col("n").cast("string"))), 1, 4), 16, 10).cast("int")
        return F.get(F.array(*map(F.lit, names)), h % len(names))

    joined = slots.join(dealt, "n")
    return joined.select((F.floor(F.col("n") / per_request)).alias("request"), (F.col("n") % per_request).alias("slot"), "keyword", label("i", ["low", "medium", "high"]).alias("importance"), label("p", ["poor", "fair", "good"]).alias("performance"))
