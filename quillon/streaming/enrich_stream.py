"""Incremental indexing: new reviews become searchable once, however often and however late they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import tokens
from quillon.operators.index import SearchIndex, append_reviews, fold_segments, open_index

REVIEW = "review_id bigint, item_id bigint, text string, ts timestamp"


def postings_of(reviews: DataFrame) -> DataFrame:
    """``term``, ``review_id``, ``item_id``, ``tf``."""
    return reviews.select("review_id", "item_id", F.explode(tokens("text")).alias("term")).groupBy("term", "review_id", "item_id").agg(F.count(F.lit(1)).alias("tf"))


def stream_enrich(
    spark: SparkSession, source: str, target: str, max_files: int = 100, stop: list[str] | None = None, tag_model: Callable | None = None, fold: bool = True,
) -> SearchIndex:
    """Read the Parquet files that are new under ``source`` into the search index at ``target``, and return it.

    Each batch becomes a segment of the index (:func:`append_reviews`); search reads all segments, so after every batch it
    answers as an index of all reviews so far would. Ids are compared with those stored, not with a watermark: a review counts
    once no matter how late it is, and times may be null. ``tag_model`` (reviews to ``tag``, ``review_id``, ``item_id``) is
    applied to new reviews only. With ``fold`` small segments are folded after each batch.

    Processes what is there and ends (available now). Progress is kept at ``<target>_progress``, so the next run goes on where
    the last one stopped, also with another ``max_files``: files that were read are not read again and may be pruned from the
    source. A batch that is repeated after a failure finds its reviews in the index, or adds them.
    """
    target = target.rstrip("/")
    stream = spark.readStream.schema(REVIEW).option("maxFilesPerTrigger", max_files).parquet(source)

    def append(batch: DataFrame, number: int) -> None:
        if append_reviews(batch, target, stop, tag_model) and fold:
            fold_segments(batch.sparkSession, target, stop)

    done = stream.writeStream.foreachBatch(append).option("checkpointLocation", f"{target}_progress").trigger(availableNow=True).start()
    done.awaitTermination()
    return open_index(spark, target, stop)
