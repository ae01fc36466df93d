"""Synthesising test requests from sampled segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import clean_keyword, tokens
from quillon.operators.tags import bundle_assign, first_seen_limit, keyword_dedup, nearest_vector, sample_points, vector_moments


def longest_token(text):
    """The longest token, the first on ties: a rule in place of a keyword model."""
    t = tokens(text)
    best = F.array_max(F.transform(t, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))
    return best["x"]


def request_from_bundle(bundles: DataFrame) -> DataFrame:
    """One request per bundle: its keywords joined by a comma, and the bundle."""
    one = bundles.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("slot", "keyword", "importance", "performance"))).alias("aspects"))
    return one.select("request", F.array_join(F.transform("aspects", lambda a: a["keyword"]), ", ").alias("request_text"), "aspects")


def keywords_of(segments: DataFrame, keyword=None) -> DataFrame:
    """``position`` and a clean, distinct keyword of each segment (``position``, ``text``); ``keyword`` maps text to raw keyword."""
    raw = (keyword or longest_token)(F.col("text"))
    return keyword_dedup(segments.select("position", clean_keyword(raw).alias("keyword")))


def synthesize_requests(segments: DataFrame, vectors: DataFrame, requests: int, per_request: int, multiplier: int = 3, seed: int = 42) -> DataFrame:
    """Sample points around the vectors, take their nearest segments, and deal their keywords into requests.

    ``vectors``: ``segment``, ``embedding``; ``segments``: ``segment``, ``text``.
    """
    points = sample_points(vector_moments(vectors), requests * per_request * multiplier, seed)
    near = nearest_vector(points, vectors, "segment")
    chosen = first_seen_limit(near, vectors, "segment", requests * per_request, seed).join(segments, "segment")
    return request_from_bundle(bundle_assign(keywords_of(chosen), requests, per_request, seed))
