"""Cleaning and slicing the user-item-review graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import strip
from quillon.runtime import save_measured, save_stage


def drop_short_reviews(reviews: DataFrame, least: int = 200) -> DataFrame:
    """Reviews of at least ``least`` characters; a missing text counts as empty."""
    return reviews.filter(F.length(F.coalesce("text", F.lit(""))) >= least)


def shape_items(items: DataFrame) -> DataFrame:
    """City without surrounding white space, coordinates as doubles; rows with unreadable coordinates are rejected."""
    shaped = items.withColumns({"city": strip(F.col("city")), "latitude": F.col("latitude").try_cast("double"), "longitude": F.col("longitude").try_cast("double")})
    return shaped.filter("latitude is not null and longitude is not null")


def shape_reviews(raw: DataFrame) -> DataFrame:
    """Text, stars (null if absent) and timestamp out of raw records."""
    return raw.select("review_id", "item_id", "user_id", "kind", "text", F.col("stars").try_cast("double").alias("stars"), F.try_to_timestamp("date").alias("datetime"))


def semi_reviews_items(reviews: DataFrame, items: DataFrame) -> DataFrame:
    return reviews.join(items.select("item_id"), "item_id", "left_semi")


def drop_dangling(edges: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Edges of which both the user and the item are there."""
    return edges.join(users.select("user_id"), "user_id", "left_semi").join(items.select("item_id"), "item_id", "left_semi")


def city_slice(items: DataFrame, reviews: DataFrame, users: DataFrame, city: str, restrict_users: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items of a city (any case), their reviews, and all users, or with ``restrict_users`` those who wrote them."""
    here = items.filter(F.lower("city") == city.lower())
    theirs = semi_reviews_items(reviews, here)
    return here, theirs, users.join(theirs.select("user_id"), "user_id", "left_semi") if restrict_users else users


def allowlist_slice(items: DataFrame, reviews: DataFrame, verdicts: DataFrame, aspect: str) -> tuple[DataFrame, DataFrame]:
    """Items that an earlier run found positive for ``aspect``, and their reviews."""
    good = verdicts.filter((F.col("aspect") == aspect) & F.col("positive")).select("item_id")
    here = items.join(good, "item_id", "left_semi")
    return here, semi_reviews_items(reviews, here)


def friends_existing(users: DataFrame) -> DataFrame:
    """``user_id`` and the sorted friends that are users themselves; users without such friends have an empty list.

    ``friends`` may be an array or one comma-separated string.
    """
    friends = F.col("friends")
    if dict(users.dtypes)["friends"] == "string":
        friends = F.split(friends, r",\s*")
    pairs = users.select("user_id", F.explode(friends).alias("friend_id")).distinct()
    known = pairs.join(users.select(F.col("user_id").alias("friend_id")), "friend_id", "left_semi")
    kept = known.groupBy("user_id").agg(F.array_sort(F.collect_list("friend_id")).alias("friends"))
    empty = F.array().cast(dict(kept.dtypes)["friends"])
    return users.select("user_id").join(kept, "user_id", "left").withColumn("friends", F.coalesce("friends", empty))


def degrees(edges: DataFrame, key: str) -> DataFrame:
    return edges.groupBy(key).agg(F.count(F.lit(1)).alias("degree"))


def core_prune(edges: DataFrame, users: DataFrame, items: DataFrame, least_user: int = 50, least_item: int = 50, passes: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """At most ``passes`` rounds: degrees over edges with both ends, drop weak users and items by them, drop dangling edges.

    Not run to a fixpoint. A round that removes nothing ends it. Degrees are counted once; a later round takes off what the
    edges removed in the one before it had given to their other ends, so it touches those ends only. Each round is cut off
    by a table in the shared folder.
    """
    edges = save_stage(drop_dangling(edges, users, items), "edges")
    kept = {key: save_stage(nodes.select(key).join(degrees(edges, key), key, "left").select(key, F.coalesce("degree", F.lit(0)).alias("degree")), key) for key, nodes in (("user_id", users), ("item_id", items))}
    least = {"user_id": least_user, "item_id": least_item}
    for _ in range(passes):
        weak = {key: save_measured(nodes.filter(F.col("degree") < least[key]).select(key, F.lit(True).alias(f"__{key}")), "weak") for key, nodes in kept.items()}
        if all(w.isEmpty() for w in weak.values()):
            break
        marked = edges
        for key, gone in weak.items():
            marked = marked.join(gone.distinct(), key, "left")
        marked = save_stage(marked.withColumn("__gone", F.coalesce(*[F.col(f"__{key}") for key in weak], F.lit(False))), "marked")
        edges, lost = marked.filter("not __gone").select(*edges.columns), marked.filter("__gone")
        for key, nodes in kept.items():
            taken = save_measured(lost.filter(F.col(f"__{key}").isNull()).groupBy(key).agg(F.count(F.lit(1)).alias("taken")), "taken")
            left = nodes.filter(F.col("degree") >= least[key]).join(taken, key, "left")
            kept[key] = save_stage(left.select(key, (F.col("degree") - F.coalesce("taken", F.lit(0))).alias("degree")), key)
    return edges, kept["user_id"].select("user_id"), kept["item_id"].select("item_id")
