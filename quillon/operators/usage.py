"""Model usage: prices by model name, cost roll-ups, latency reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: USD per million tokens in and out
RATES = [
    ("gpt-5", 1.25, 10.00), ("gpt-5-mini", 0.25, 2.00), ("gpt-5-nano", 0.05, 0.40), ("gpt-4.1", 5.00, 15.00), ("gpt-4.1-mini", 0.40, 1.60), ("gpt-4o", 5.00, 15.00),
    ("gpt-4o-mini", 0.50, 1.50), ("gpt-4-turbo", 10.00, 30.00), ("text-embedding-3-small", 0.02, 0.0), ("text-embedding-3-large", 0.13, 0.0),
]


def rate_card(spark) -> DataFrame:
    """``key``, ``place`` (order of the card), ``usd_in`` and ``usd_out`` per token."""
    return spark.createDataFrame([(k, i, a / 1e6, b / 1e6) for i, (k, a, b) in enumerate(RATES)], "key string, place int, usd_in double, usd_out double")


def rate_lookup(models: DataFrame, rates: DataFrame, match: str = "longest") -> DataFrame:
    """Price of each distinct ``model``: the card's exact name, else a key that the name begins with, else 0.

    ``longest``: the longest such key; ``card_order``: the first on the card.
    """
    names = models.select("model").distinct().withColumn("name", F.lower("model"))
    hits = names.join(F.broadcast(rates), F.startswith("name", "key"), "left")
    order = [F.desc_nulls_last(F.col("name") == F.col("key")), F.desc(F.length("key")) if match == "longest" else F.col("place")]
    best = hits.withColumn("r", F.row_number().over(W.partitionBy("model").orderBy(*order))).filter("r = 1")
    return best.select("model", "key", F.coalesce("usd_in", F.lit(0.0)).alias("usd_in"), F.coalesce("usd_out", F.lit(0.0)).alias("usd_out"))


def priced(usage: DataFrame, rates: DataFrame) -> DataFrame:
    found = rate_lookup(usage, rates)
    return usage.join(found, "model").withColumn("usd", F.col("prompt_tokens") * F.col("usd_in") + F.col("completion_tokens") * F.col("usd_out"))


def usage_rollup(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Tokens and cost by model and task with subtotals (nulls) and the total."""
    p = priced(usage, rates)
    sums = [F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "usd")]
    return p.rollup("model", "task").agg(*sums)


def latency_cost_report(log: DataFrame, rates: DataFrame) -> DataFrame:
    """Median and 95th percentile latency and cost of a thousand queries, by task."""
    p = priced(log, rates)
    return p.groupBy("task").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("latency_ms", F.lit(0.5)).alias("p50"), F.percentile("latency_ms", F.lit(0.95)).alias("p95"),
        (F.sum("usd") / F.count(F.lit(1)) * 1000).alias("usd_per_1k"),
    )


#: Size of latency sketches, and how far the rank of a quantile that is read off one may be from the asked one.
SKETCH, SKETCH_ERROR = 400, 0.02


def latency_sketches(log: DataFrame, keys: list[str] | None = None, size: int = SKETCH) -> DataFrame:
    """A quantile sketch of ``latency_ms`` for each group (by default ``task`` and ``day``): ``n``, ``usd`` and ``sketch``.

    A sketch takes a few kilobytes however many rows it stands for. Sketches of any groups can be merged, so one table of
    them by day answers for any range of days; null latencies are left out of it.
    """
    return log.groupBy(*(keys or ["task", "day"])).agg(F.count(F.lit(1)).alias("n"), F.sum("usd").alias("usd"), F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), F.lit(size)).alias("sketch"))


def report_from_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """:func:`latency_cost_report` from stored sketches, merged within ``by``: quantiles whose rank is off by ``SKETCH_ERROR`` at most."""
    merged = sketches.groupBy(*(by or ["task"])).agg(F.sum("n").alias("n"), F.sum("usd").alias("usd"), F.kll_merge_agg_double("sketch").alias("s"))
    at = [F.kll_sketch_get_quantile_double("s", F.lit(q)).alias(name) for name, q in (("p50", 0.5), ("p95", 0.95))]
    return merged.select(*(by or ["task"]), "n", *at, (F.col("usd") / F.col("n") * 1000).alias("usd_per_1k"))
