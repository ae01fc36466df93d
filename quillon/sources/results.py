"""A stored table of model results: put, keep, and get by key, with versions."""

from __future__ import annotations

import uuid
from zlib import crc32

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new store; a store keeps the number that it was made with.
BUCKETS = 64
#: Columns that say what a result is of: a result of one scope is never taken for one of another.
SCOPE = ("task", "city", "system")
_MANIFEST = "bucket int, folder string, buckets int, version long"
ROW = "task string, city string, system string, key string, tag string, version long, payload string"


def _bucket(key: Column, buckets: int) -> Column:
    return (F.crc32(key.cast("binary")) % buckets).cast("int")


class ResultStore:
    """Results by scope, key and tag in hash buckets of the key, at ``path``.

    A version names a folder for each bucket that has rows, in one file that is there whole or not at all. A put rewrites the
    buckets that it touches into new folders and then publishes the next version; readers of an earlier one are not disturbed,
    and what a put that was cut off has left is never read. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        try:
            rows = spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").collect()  # a row a bucket and version
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = []
        last = max((r.version for r in rows), default=-1)
        self.version = last if version is None else version
        mine = [r for r in rows if r.version == self.version]
        self.buckets = mine[0].buckets if mine else BUCKETS
        self.folders = {r.bucket: r.folder for r in mine if r.bucket is not None}

    def _read(self, buckets: list[int]) -> DataFrame:
        paths = [f"{self.path}/{self.folders[b]}/bucket={b}" for b in buckets if b in self.folders]
        return self.spark.read.schema(ROW).parquet(*paths) if paths else self.spark.createDataFrame([], ROW)

    def rows(self) -> DataFrame:
        """All results: the columns of ``ROW``."""
        return self._read(sorted(self.folders))

    def get(self, key: str, tag: str | None = None, **scope: str) -> DataFrame:
        """The results of a key, or of a key and tag, within a scope (``task``, ``city``, ``system``); one bucket is read."""
        found = self._read([crc32(key.encode()) % self.buckets]).filter(F.col("key") == key)
        for name, value in ({} if tag is None else {"tag": tag}).items() | scope.items():
            found = found.filter(F.col(name) == value)
        return found

    def put(self, new: DataFrame, overwrite: bool = True) -> ResultStore:
        """The store with the rows of ``new`` (columns of ``ROW``; a scope column that is missing is empty).

        Of all rows of one scope, key and tag the one of the latest version stays, or without ``overwrite`` that of the
        earliest; ties by payload. Rows without a key are left out.
        """
        names = [f.split()[0] for f in ROW.split(", ")]
        rows = new.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in new.columns else F.lit("")).alias(c) if c in SCOPE else F.col(c).cast("long" if c == "version" else "string").alias(c) for c in names])
        rows = rows.filter("key is not null").withColumn("bucket", _bucket(F.col("key"), self.buckets))
        touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # at most the number of buckets
        if not touched and self.version >= 0:
            return self
        old = self._read(touched).withColumn("bucket", _bucket(F.col("key"), self.buckets))
        by = F.struct("version", "payload")
        best = rows.unionByName(old).groupBy("bucket", *SCOPE, "key", "tag").agg((F.max(by) if overwrite else F.min(by)).alias("p"))
        best = best.select("bucket", *SCOPE, "key", "tag", "p.version", "p.payload")
        folder = f"data-{uuid.uuid4().hex}"
        # a key with very many tags is written by several tasks
        laid = best.repartition("bucket", F.pmod(F.xxhash64("tag"), F.lit(8))).sortWithinPartitions("bucket", "key", "tag")
        laid.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        self._publish({**self.folders, **dict.fromkeys(touched, folder)})
        return ResultStore(self.spark, self.path)

    def _publish(self, folders: dict[int, str]) -> None:
        rows = [(b, f, self.buckets) for b, f in sorted(folders.items())] or [(None, None, self.buckets)]
        named = self.spark.createDataFrame(rows, _MANIFEST.rsplit(",", 1)[0]).coalesce(1)
        named.write.mode("overwrite").parquet(f"{self.path}/manifest/version={self.version + 1}")
