"""From source files to a cleaned user-item-review graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.operators import clean as C
from quillon.sources import jsonlines as J


def prepare_dataset(spark: SparkSession, path: str, least_user: int = 50, least_item: int = 50, least_chars: int = 200, category: str = "restaurant") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users, items and reviews out of the JSON-lines files ``business``, ``user``, ``review`` and ``tip`` under ``path``.

    Items of the category with readable places; reviews and tips of enough characters; users and items with enough of them
    (two passes); friends of each user that are still there.
    """
    items = C.shape_items(J.load_items(spark, f"{path}/business", category))
    users = J.load_users(spark, f"{path}/user")
    both = J.load_reviews_and_tips(spark, f"{path}/review", f"{path}/tip")
    reviews = C.drop_short_reviews(C.shape_reviews(both), least_chars)
    edges, kept_users, kept_items = C.core_prune(reviews.select("review_id", "user_id", "item_id"), users, items, least_user, least_item)
    here = users.join(kept_users.select("user_id"), "user_id", "left_semi")
    here = here.drop("friends").join(C.friends_existing(here), "user_id")
    return here, items.join(kept_items.select("item_id"), "item_id", "left_semi"), reviews.join(edges.select("review_id"), "review_id", "left_semi")
