"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import narrow, save_stage


def _both(df: DataFrame, one: tuple, two: tuple) -> DataFrame:
    """Two rows (a, b) for each row: not a union, which would give up a common partitioning."""
    ends = [F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (one, two)]
    return df.select(F.explode(F.array(*ends)).alias("e")).select("e.a", "e.b")


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each node points to one node that points nowhere."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("down")), F.struct(F.col("b").alias("n"), F.lit(0).alias("down")))).alias("e"))
    seen = ends.groupBy("e.n").agg(F.sum("e.down").alias("down"), F.count(F.lit(1)).alias("all"))
    return seen.filter("down > 1 or (down = 1 and all > 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """Label the nodes of undirected ``edges`` (columns ``a`` and ``b``): ``node``, ``label`` = the least node reachable.

    Only nodes with an edge to another node appear. Each step is a map-side combined minimum per node and a join back, so
    a node with very many edges costs a skewed join that adaptive execution splits, never one group in one task. Few
    edges (counted) are handled in one partition, without shuffles. Null ends are ignored; loops and repeated edges do no
    harm; no edges give no rows.
    """
    edges = edges.filter("a is not null and b is not null and a <> b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = save_stage(edges, "cc")
    rows = edges.count()
    edges = narrow(edges, rows)
    while not _is_forest_of_stars(edges):
        # large star: the larger neighbours of a node point to the least of the node and its neighbours
        both = _both(edges, ("a", "b"), ("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # small star: the smaller neighbours of a node and the node itself point to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = _both(large.join(least, "a"), ("b", "m"), ("a", "m")).filter("a <> b").distinct()
        edges = narrow(save_stage(edges, "cc"), rows)
    least = edges.groupBy("a").agg(F.min("b").alias("label"))
    roots = edges.select(F.col("b").alias("node")).distinct().join(least.select(F.col("a").alias("node")), "node", "left_anti")
    return least.select(F.col("a").alias("node"), "label").union(roots.select("node", F.col("node").alias("label")))
