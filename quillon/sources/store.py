"""Tables that outlive a run."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path holds files, in whatever store it names, by Spark's own readers."""
    try:
        return bool(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").head(1))
    except Exception as e:  # Spark raises one class for every missing path
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; if there is none it is built and written first.

    The data go to a folder of their own, and only when all of it is written is that folder's name published in a table of
    one row beside it. What a run that was cut off left behind has no name there, so it is never read and the table is
    built anew. An empty table is a table.
    """
    named = f"{path}/published"
    name = spark.read.schema("name string").parquet(named).agg(F.max("name")).first()[0] if exists(spark, named) else None
    if name is None:
        name = f"data-{uuid.uuid4().hex}"
        build().write.parquet(f"{path}/{name}")
        spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("overwrite").parquet(named)
    return spark.read.parquet(f"{path}/{name}")


def add_missing(spark: SparkSession, path: str, rows: DataFrame, key: str) -> DataFrame:
    """Append the rows whose key the table at ``path`` lacks (one row per key), and read it."""
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    rows.dropDuplicates([key]).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def check_vectors(rows: DataFrame, col: str = "embedding") -> DataFrame:
    """One row of checks on a table of vectors: rows, missing vectors, vectors of another length than the most frequent."""
    sizes = rows.groupBy(F.size(col).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.agg(F.max(F.struct("n", "d")).alias("t"), F.sum("n").alias("rows"), F.sum(F.when(F.col("d") < 0, F.col("n")).otherwise(0)).alias("missing"))
    return top.select("rows", "missing", F.col("t.d").cast("int").alias("dims"), (F.col("rows") - F.col("missing") - F.col("t.n")).alias("odd"))
