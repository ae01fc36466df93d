"""Session helpers: shared storage for cut lineage, code shipping, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side is broadcast after it has been counted.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


#: Rows up to which a table of a few narrow columns is handled in one partition after it has been counted.
ONE_TASK_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    In local mode (tests), where none is named, a temporary folder is made and set as the checkpoint folder; on a cluster
    that would be another folder on each machine, so there it raises RuntimeError.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def save_stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of any executor, and fixes values that a second evaluation
    might not repeat (range partition ids).
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _row_bytes(df: DataFrame) -> tuple[Column, bool]:
    """About the bytes of a row, and whether they vary."""
    size, varying = F.lit(8 * len(df.columns)), False
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            size, varying = size + F.coalesce(F.octet_length(f.name), F.lit(0)), True
        elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            size, varying = size + F.octet_length(F.to_json(F.struct(f.name))), True
    return size.cast("long"), varying


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are at most ``limit`` and its bytes, which are summed if any
    column has values of varying size, at most ``BROADCAST_BYTES``; else ``df`` for a shuffled join."""
    if rows > limit:
        return df
    size, varying = _row_bytes(df)
    if varying and (df.agg(F.sum(size)).first()[0] or 0) > BROADCAST_BYTES:
        return df
    return F.broadcast(df)


def measured(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """:func:`small` of a table whose rows and bytes are taken in one pass; best given a written table."""
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(df)[0]), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and size <= BROADCAST_BYTES else df


def save_sized(df: DataFrame, label: str, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """:func:`save_stage` and whether what was written is small enough to be broadcast: rows and bytes are observed by the write."""
    seen = Observation()
    saved = save_stage(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(_row_bytes(df)[0]).alias("size")), label)
    got = seen.get
    if "rows" not in got:  # a plan that was found empty observes nothing
        got = saved.agg(F.count(F.lit(1)).alias("rows"), F.sum(_row_bytes(saved)[0]).alias("size")).first().asDict()
    return saved, got["rows"] <= limit and (got["size"] or 0) <= BROADCAST_BYTES


def save_measured(df: DataFrame, label: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """:func:`save_sized` with a broadcast hint if what was written is small."""
    saved, few = save_sized(df, label, limit)
    return F.broadcast(saved) if few else saved


def narrow(df: DataFrame, rows: int, limit: int = ONE_TASK_ROWS) -> DataFrame:
    """``df`` in one partition if its counted ``rows`` are at most ``limit``, so that small steps need no shuffle."""
    return df.coalesce(1) if rows <= limit else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context, as ``--py-files`` would.

    Also lowers the rows of an Arrow batch in this session, since texts may be long.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    sc = spark.sparkContext
    if getattr(sc, "_quillon_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="quillon-code-"), "quillon_code.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(out)
    sc._quillon_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
