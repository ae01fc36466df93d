"""Exact nearest vectors through cells: clusters with radii, of which only those that can hold a better vector are read."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.vectors import normalise
from quillon.runtime import save_measured, save_stage

#: Vectors, at most about twice as many, that the centres of cells are fitted on.
FIT_ROWS = 100_000
#: Similarities that differ by less count as equal when cells are left out.
_SLACK = 1e-7


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@dataclass(frozen=True)
class VectorCells:
    """Unit vectors dealt to cells: ``members`` (``cell``, key, ``unit``), and ``cells`` (``cell``, ``centre``, ``radius``, ``n``)."""

    members: DataFrame
    cells: DataFrame
    key: str


def build_cells(vectors: DataFrame, key: str, n_cells: int | None = None, fit_rows: int = FIT_ROWS, seed: int = 42) -> VectorCells:
    """Cells of the vectors (``key``, ``embedding``): about the square root of their number, or ``n_cells``.

    Centres are k-means of a bounded sample; every vector goes to its nearest centre, and a cell's radius is the largest
    distance of a member from the centre. A wrong sample makes cells wide, never a result wrong. Null vectors are left out.
    """
    units = vectors.filter(F.col("embedding").isNotNull()).select(key, normalise(F.col("embedding").cast("array<double>")).alias("unit"))
    units = save_stage(units, "units")
    n = units.count()
    k = max(1, min(n_cells or math.isqrt(max(1, n)), max(1, n)))
    sample = units if n <= fit_rows else units.filter(F.pmod(F.xxhash64(key, F.lit("cells")), F.lit(1_000_003)) < int(1_000_003 * fit_rows / n))
    found = []
    if k > 1:
        model = KMeans(k=k, seed=seed, maxIter=8, initMode="random", featuresCol="v").fit(sample.select(array_to_vector("unit").alias("v")))
        found = [c.tolist() for c in model.clusterCenters()]  # k rows
        named = model.setPredictionCol("cell").transform(units.withColumn("v", array_to_vector("unit"))).select("cell", key, "unit")
    else:
        named = units.select(F.lit(0).alias("cell"), key, "unit")
    if not found:
        dims = units.select(F.size("unit").alias("d")).first()
        found = [[0.0] * (dims.d if dims else 1)]
    members = save_stage(named.repartitionByRange("cell", key).sortWithinPartitions("cell", key), "members")
    centres = units.sparkSession.createDataFrame([(i, c) for i, c in enumerate(found)], "cell int, centre array<double>")
    away = F.sqrt(F.aggregate(F.zip_with("unit", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    sized = members.join(F.broadcast(centres), "cell").groupBy("cell").agg(F.max(away).alias("radius"), F.count(F.lit(1)).alias("n"))
    return VectorCells(members, save_measured(centres.join(sized, "cell"), "cells"), key)


def nearest_by_cells(points: DataFrame, index: VectorCells, report: dict | None = None) -> DataFrame:
    """The most similar vector (cosine, to nine places; ties: least key) of each point (``point``, ``vector``): ``point``, key, ``similarity``.

    By the inequality of Cauchy and Schwarz no member of a cell is more similar to a unit point than the centre's product
    with it plus the radius. Each point reads the cell of the highest bound first; what it finds rules out the cells whose
    bound stays below, and only the others are read. ``report`` gets the members compared (``read``) and all pairs (``all``).
    """
    units = save_measured(points.select("point", normalise(F.col("vector")).alias("p")), "points")
    bounds = units.crossJoin(index.cells).select("point", "cell", "n", (dot("p", "centre") + F.col("radius")).alias("bound"))  # cells are few: a stated set
    bounds = save_stage(bounds, "bounds")
    first = save_measured(bounds.groupBy("point").agg(F.max_by("cell", F.struct("bound", -F.col("cell"))).alias("cell")), "first")

    def best(chosen: DataFrame) -> DataFrame:
        s = F.round(dot("p", "unit"), 9)
        near = index.members.join(chosen, "cell").join(units, "point").withColumn("s", s)
        return near.groupBy("point").agg(F.max_by(index.key, F.struct("s", -F.col(index.key))).alias(index.key), F.max("s").alias("s"))

    one = save_measured(best(first), "best")
    rest = bounds.join(one.select("point", "s"), "point").filter(F.col("bound") >= F.col("s") - _SLACK).join(first, ["point", "cell"], "left_anti")
    rest = save_measured(rest.select("point", "cell", "n"), "rest")
    if report is not None:
        report["all"] = bounds.agg(F.sum("n")).first()[0] or 0
        report["read"] = (rest.agg(F.sum("n")).first()[0] or 0) + (bounds.join(first, ["point", "cell"]).agg(F.sum("n")).first()[0] or 0)
    both = one.union(best(rest.drop("n")))
    return both.groupBy("point").agg(F.max_by(index.key, F.struct("s", -F.col(index.key))).alias(index.key), F.max("s").alias("similarity"))
