"""Work around a model: what is pending, batches, applying a function, validating its output, storing results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.vectors import normalise
from quillon.runtime import save_stage, ship_package
from quillon.sources.results import ResultStore
from quillon.sources.store import add_missing, exists

ONE_TAG = "name string, sentiment string, evidence string, confidence double"
TAGS = f"tags array<struct<{ONE_TAG.replace(' string', ':string').replace(' double', ':double')}>>"


def pending_work(rows: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a stored result."""
    return rows.join(store.select(*keys).distinct(), keys, "left_anti")


def work_batches(rows: DataFrame, key: str, size: int = 64) -> DataFrame:
    """Batch numbers of ``size`` rows by key, from ranks over ranges of the key rather than one global window."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = save_stage(rows.repartitionByRange(n, key).withColumn("__p", F.spark_partition_id()), "batches")
    counts = laid.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    before = counts.withColumn("skip", F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(W.partitionBy("__p").orderBy(key)) + F.col("skip") - 1
    return laid.join(F.broadcast(before), "__p").withColumn("batch", F.floor(place / size)).drop("__p", "skip")


def apply_model(rows: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn`` from an iterator of pandas frames to an iterator of pandas frames, on Arrow batches of the executors."""
    ship_package(rows.sparkSession)
    return rows.mapInPandas(fn, schema)


def enrich(rows: DataFrame, store: DataFrame, task: str, keys: list[str], fn: Callable, schema: str) -> DataFrame:
    """Apply ``fn`` to the rows that ``store`` has no result of ``task`` for."""
    return apply_model(pending_work(rows, store.filter(F.col("task") == task), keys), fn, schema)


def embed_missing(tags: DataFrame, path: str, fn: Callable, kind: str = "float") -> DataFrame:
    """Unit vectors of all tags stored at ``path``, after adding those of ``tags`` that were not there.

    ``fn`` maps frames of distinct missing tags to frames with ``embedding``; it sees each tag once, ever. Null tags are left
    out; what the model gives is scaled to length one.
    """
    spark = tags.sparkSession
    names = tags.select("tag").filter("tag is not null").distinct()
    if exists(spark, path):
        names = pending_work(names, spark.read.parquet(path), ["tag"])
    made = apply_model(names, fn, f"tag {dict(tags.dtypes)['tag']}, embedding array<{kind}>")
    return add_missing(spark, path, made.select("tag", normalise(F.col("embedding")).cast(f"array<{kind}>").alias("embedding")), "tag")


def validate_tags(rows: DataFrame, json: str = "payload") -> DataFrame:
    """One row per tag of a JSON payload: the tag's fields and ``reason`` (null if valid).

    Contract: a name of 1 to 64 characters in lower-case words joined by hyphens, sentiment positive or negative, evidence
    that is not empty, confidence from 0 to 1, no further keys. A payload that does not parse gives one row.
    """
    raw = rows.withColumn("__tags", F.from_json(json, "tags array<string>", {"mode": "PERMISSIVE"})["tags"])
    bad = raw.filter("__tags is null").select(*rows.columns, *[F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in ONE_TAG.split(", "))], F.lit("unparseable").alias("reason"))
    one = raw.select(*rows.columns, F.explode("__tags").alias("__tag"))
    one = one.withColumn("t", F.from_json("__tag", ONE_TAG)).withColumn("k", F.json_object_keys("__tag"))
    name, evidence, confidence = F.col("t.name"), F.col("t.evidence"), F.col("t.confidence")
    reason = (
        F.when(F.size(F.array_except("k", F.array(*map(F.lit, ("name", "sentiment", "evidence", "confidence"))))) > 0, "extra key")
        .when(name.isNull() | ~name.rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*$") | (F.length(name) > 64), "name")
        .when(F.col("t.sentiment").isNull() | ~F.col("t.sentiment").isin("positive", "negative"), "sentiment")
        .when(evidence.isNull() | (evidence == ""), "evidence").when(confidence.isNull() | (confidence < 0) | (confidence > 1), "confidence")
    )
    return one.select(*rows.columns, "t.*", reason.alias("reason")).union(bad)


def validate_judgments(rows: DataFrame) -> DataFrame:
    """Adds ``reason``: null for a valid judgment (known status, flags, confidence 0 to 1, reasoning of at most 300, consistent)."""
    status = F.col("aspect_status")
    reason = (
        F.when(status.isNull() | ~status.isin("positive", "negative", "inconclusive"), "status").when(F.col("is_conclusive").isNull() | F.col("is_positive").isNull(), "flag")
        .when(F.col("confidence").isNull() | ~F.col("confidence").between(0, 1), "confidence").when(F.col("reasoning").isNull() | (F.length("reasoning") > 300), "reasoning")
        .when(F.col("is_positive") != (status == "positive"), "inconsistent")
    )
    return rows.withColumn("reason", reason)


def validate_scores(rows: DataFrame) -> DataFrame:
    """Adds ``reason``: null for a valid score (0 to 1, explanation of at most 300 and evidence of at most 200 characters)."""
    reason = (
        F.when(F.col("score").isNull() | ~F.col("score").between(0, 1), "score").when(F.col("explanation").isNull() | (F.length("explanation") > 300), "explanation")
        .when(F.col("evidence").isNull() | (F.length("evidence") > 200), "evidence")
    )
    return rows.withColumn("reason", reason)


def evidence_grounding(tags: DataFrame, reviews: DataFrame) -> DataFrame:
    """Whether each tag's evidence stands in its review word for word."""
    joined = tags.join(reviews.select("review_id", "text"), "review_id")
    return joined.withColumn("grounded", F.coalesce(F.contains("text", "evidence"), F.lit(False))).drop("text")


def upsert(store: DataFrame, new: DataFrame, overwrite: bool = True) -> DataFrame:
    """One payload per (key, tag): of the old and new rows the latest version, or without ``overwrite`` the earliest."""
    both = store.unionByName(new)
    by = F.struct("version", "payload")
    pick = F.max(by) if overwrite else F.min(by)
    return both.groupBy("task", "key", "tag").agg(pick.alias("p")).select("task", "key", "tag", "p.version", "p.payload")


SCORE_REPLY = "score double, explanation string, evidence string"


def stored_scores(evidence: DataFrame, store: ResultStore, model: Callable, query_scoped: bool = False, version: int = 0, city: str = "", system: str = "") -> tuple[DataFrame, ResultStore]:
    """``evidence`` (``query_id``, ``aspect``, ``review_id``) with ``score``, and the store with the replies that were new.

    A stored score is of a review and an aspect within ``city`` and ``system``, whichever request asked for it; with
    ``query_scoped`` it is of the request too, as the model's prompt holds that. ``model`` adds ``payload`` (a JSON reply) to
    the distinct (``query_id`` if scoped, ``aspect``, ``review_id``) that have none. Replies that do not parse or break
    the form are not stored: their rows have a null score and are asked for again next time, as have rows without a review
    or an aspect, which no model sees. A ``score`` that ``evidence`` has is replaced.
    """
    unit = [*["query_id"] * query_scoped, "aspect", "review_id"]
    tag = F.to_json(F.array(F.col("query_id").cast("string"), "aspect")) if query_scoped else F.col("aspect")
    names = {"__key": F.col("review_id").cast("string"), "__tag": tag}
    scope = {"task": "query_score" if query_scoped else "score", "city": city, "system": system}

    def stored(results: ResultStore) -> DataFrame:
        mine = results.rows()
        for column, value in scope.items():
            mine = mine.filter(F.col(column) == value)
        return mine.select(F.col("key").alias("__key"), F.col("tag").alias("__tag"), "payload")

    wanted = evidence.select(*unit).dropna().distinct().withColumns(names)
    replies = model(pending_work(wanted, stored(store), list(names)).select(*unit)).select(*unit, "payload")
    valid = validate_scores(replies.select(*unit, "payload", F.from_json("payload", SCORE_REPLY).alias("r")).select(*unit, "payload", "r.*")).filter("reason is null")
    named = valid.withColumns(names).select(*[F.lit(v).alias(c) for c, v in scope.items()], F.col("__key").alias("key"), F.col("__tag").alias("tag"), F.lit(version).alias("version"), "payload")
    store = store.put(save_stage(named, "scores"))
    found = stored(store).select(*names, F.from_json("payload", SCORE_REPLY)["score"].alias("score"))
    return evidence.drop("score").withColumns(names).join(found, list(names), "left").drop(*names), store


def rule_judgment(h: Column) -> dict[str, Column]:
    """A deterministic stand-in for a judge: a third each positive, negative, inconclusive."""
    return {"is_conclusive": h % 3 != 2, "is_positive": h % 3 == 0, "aspect_status": F.get(F.array(*map(F.lit, ("positive", "negative", "inconclusive"))), h % 3)}


def rule_score(h: Column) -> Column:
    return F.get(F.array(*map(F.lit, (0.2, 0.4, 0.5, 0.6, 0.8))), h % 5)
