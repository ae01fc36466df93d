"""Ranks, running sums and the greatest rows of groups of any size: ranges and histograms instead of a window task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.runtime import measured, save_measured, save_stage

#: Steps of a histogram, and rows within one step that are few enough to be ordered.
STEPS, FEW = 512, 4_096
_MOST = 1.7e308


def range_partitioned(df: DataFrame, keys: list[str | Column], label: str) -> DataFrame:
    """``df`` dealt by ranges of ``keys``, with the partition's number in ``__pid``, written so that it stays fixed."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return save_stage(df.repartitionByRange(n, *keys).withColumn("__pid", F.spark_partition_id()), label)


def grouped_sum(df: DataFrame, group: list[str], order: list[str | Column], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over a row and those before it by ``order`` within ``group``.

    ``order`` must be total within a group. Rows are dealt by ranges of group and order, so a group with a third of all
    rows spreads over many tasks. A group that spans several partitions gets offsets from the sums of the earlier ones:
    at most one row a partition is broadcast, as each partition continues at most one group.
    """
    laid = range_partitioned(df.withColumn("__v", value.cast("long")), [*group, *order], "rank")
    sums = laid.groupBy(*group, "__pid").agg(F.sum("__v").alias("__n"))
    before = W.partitionBy(*group).orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("__skip", F.sum("__n").over(before)).filter("__skip is not null")
    offsets = offsets.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col("__pid").alias("__p"), "__skip")
    same = F.col("__pid") == F.col("__p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    upto = W.partitionBy(*group, "__pid").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = laid.withColumn("__local", F.sum("__v").over(upto))
    total = (F.col("__local") + F.coalesce(F.col("__skip"), F.lit(0))).cast("long").alias(out)
    return local.join(F.broadcast(offsets), same, "left").select(*df.columns, total)


def grouped_rank(df: DataFrame, group: list[str], order: list[str | Column], out: str) -> DataFrame:
    """Add ``out``: 1, 2, ... by ``order`` within ``group`` (``order`` must be total within a group)."""
    return grouped_sum(df, group, order, F.lit(1), out)


def greatest_rows(df: DataFrame, group: str, value: str, tie: str, keep: DataFrame) -> DataFrame:
    """The rows of each ``group`` with the greatest ``value`` (a double; null, NaN and what is beyond 1.7e308 count as least, least and that), as many as ``keep`` (``group``, ``keep``) says; ties: least ``tie``.

    The value that the last of them has is found without ordering a group: a histogram between the least and the greatest
    value tells the step that it lies in, which the next round divides again, until the step holds few rows or one value.
    Whatever lies above is taken, and only rows within that step are ranked. The rounds are the logarithm of the group's size
    to the base ``STEPS`` on even values, and each shuffles no more than ``STEPS`` counts of a group from a task.
    """
    v = F.nanvl(F.coalesce(F.col(value), F.lit(-_MOST)), F.lit(-_MOST))
    # finite ends: the least and the greatest value of a step fall into different steps of the next round, so each makes it smaller
    rows = save_stage(df.withColumn("__value", F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), v))), "values")
    wide = rows.groupBy(group).agg(F.min("__value").alias("lo"), F.max("__value").alias("hi"), F.count(F.lit(1)).alias("rows"))
    state = save_stage(wide.join(keep, group).filter("keep > 0").select(group, "lo", "hi", "rows", F.col("keep").cast("long").alias("need")), "steps")
    settled = None
    while True:
        over = (F.col("rows") > FEW) & (F.col("lo") < F.col("hi")) & (F.col("need") < F.col("rows"))
        done, todo = state.filter(~over), state.filter(over)
        settled = done if settled is None else settled.union(done)
        if todo.isEmpty():
            break
        # halves first, as the difference of two doubles may overflow
        at = F.floor((F.col("hi") / 2 - F.col("__value") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * STEPS)
        inside = rows.select(group, "__value").join(measured(todo), group).filter("__value between lo and hi")
        counts = inside.groupBy(group, "need", F.least(at, F.lit(STEPS - 1)).alias("step")).agg(F.min("__value").alias("lo"), F.max("__value").alias("hi"), F.count(F.lit(1)).alias("rows"))
        upto = F.sum("rows").over(W.partitionBy(group).orderBy("step"))  # at most STEPS rows of a group
        chosen = counts.withColumn("upto", upto).filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("rows") < F.col("need")))
        state = save_stage(chosen.select(group, "lo", "hi", "rows", (F.col("need") - F.col("upto") + F.col("rows")).alias("need")), "steps")
    bounds = save_measured(settled, "bounds")
    near = rows.join(bounds, group).filter("__value >= lo")
    inside = grouped_rank(near.filter("__value <= hi"), [group], [F.desc("__value"), tie], "__r").filter("__r <= need")
    return near.filter("__value > hi").select(*df.columns).union(inside.select(*df.columns))
