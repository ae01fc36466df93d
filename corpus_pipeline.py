"""Corpus preparation in five stages over ``documents``: language, quality, near-duplicates, benchmark leaks, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.bpe import encode_digests
from quillon.llm.decontaminate import contamination
from quillon.llm.langid import UNKNOWN, identify, learnable
from quillon.llm.neardup import near_duplicates
from quillon.llm.quality import learnable_labels, quality_scores
from quillon.runtime import measured, save_stage, shared_path


def _same() -> Column:
    """Whether a row has the id and the text (by its 128-bit digest) of a named one; nulls are alike."""
    return F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & F.unhex(F.md5("text")).eqNullSafe(F.col("__md5"))


def _named(rows: DataFrame) -> DataFrame:
    """The ids and text digests of ``rows``, written and broadcast if they are few."""
    named = rows.select(F.col("doc_id").alias("__id"), F.col("text_md5").alias("__md5")).distinct()
    return measured(save_stage(named, "named"))


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` without the rows that have the id and text of a row of ``bad`` (``doc_id``, ``text_md5``)."""
    return docs.join(_named(bad), _same(), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, and those for which no language is likelier than the others together."""
    found = identify(docs, learnable(docs))
    return _without(docs, found.filter((F.col("lang_pred") == UNKNOWN) | (F.col("score") < 0.5)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be of low quality go."""
    scored = quality_scores(docs, learnable_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return _without(docs, scored.filter("predicted = 0"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays; of repeated rows (one id, one text) one stays."""
    found = near_duplicates(docs)
    kept = _without(docs, found.filter("not kept"))
    again = found.filter("kept").groupBy("doc_id", "text_md5").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = _named(again)
    if again.isEmpty():
        return kept
    return kept.join(again, _same(), "left_anti").union(kept.join(again, _same(), "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.filter("contaminated"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return encode_digests(docs)


STAGES = [("language_id", language_id), ("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", bpe)]

#: SQL cannot express the fitted stages; the tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
