"""Users' centres and distances to items."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.geo import EARTH_KM, haversine
from quillon.runtime import measured, save_stage, small


#: Distinct places of a key up to which they are packed into one row.
PLACES_IN_ROW = 4_096


def geometric_median(points: DataFrame, key: str, steps: int = 128, eps: float = 1e-9, in_row: int = PLACES_IN_ROW) -> DataFrame:
    """Weiszfeld's geometric median of (``lat``, ``lon``) per ``key``, from the centroid, at most ``steps`` steps.

    Equal points are counted first. Keys of at most ``in_row`` distinct places are solved in a row each; the places of larger
    ones, of any number, stay spread, and each step is a grouped sum over all keys that still move. Points at the current
    centre are skipped; it ends when all coincide with the centre or the centre moves by at most ``eps``.
    """
    counted = points.filter("lat is not null and lon is not null").groupBy(key, "lat", "lon").agg(F.count(F.lit(1)).cast("double").alias("w"))
    counted = save_stage(counted, "places")
    large = save_stage(counted.groupBy(key).agg(F.count(F.lit(1)).alias("places")).filter(F.col("places") > in_row).select(F.col(key).alias("__large")), "large")
    if large.isEmpty():
        return _packed_median(counted, key, steps, eps)
    large = measured(large)
    same = F.col(key).eqNullSafe(F.col("__large"))
    few = _packed_median(counted.join(large, same, "left_anti"), key, steps, eps)
    return few.unionByName(_spread_median(counted.join(large, same, "left_semi"), key, steps, eps))


def _spread_median(counted: DataFrame, key: str, steps: int, eps: float) -> DataFrame:
    """Medians of keys whose places are many rows. A step joins the centres that move to the places and adds up by key;
    settled keys take no part in later steps."""
    counted = save_stage(counted, "spread")
    w = F.col("w")
    start = counted.groupBy(key).agg(F.sum("w").alias("n"), (F.sum(F.col("lat") * w) / F.sum("w")).alias("x"), (F.sum(F.col("lon") * w) / F.sum("w")).alias("y"))
    moving, settled = save_stage(start.withColumn("done", F.lit(False)), "centres"), []
    for _ in range(steps):
        centres = measured(moving.drop("done").withColumnRenamed(key, "__key"))
        away = F.sqrt(F.pow(F.col("lat") - F.col("x"), 2) + F.pow(F.col("lon") - F.col("y"), 2))
        v = F.when(away > eps, w / away).otherwise(0.0)
        sums = counted.join(centres, F.col(key).eqNullSafe(F.col("__key"))).groupBy(key, "n", "x", "y")
        sums = sums.agg(F.sum(v).alias("v"), F.sum(v * F.col("lat")).alias("vx"), F.sum(v * F.col("lon")).alias("vy"))
        x, y = F.coalesce(F.try_divide("vx", "v"), "x"), F.coalesce(F.try_divide("vy", "v"), "y")
        shift = F.sqrt(F.pow(x - F.col("x"), 2) + F.pow(y - F.col("y"), 2))
        stepped = save_stage(sums.select(key, "n", x.alias("x"), y.alias("y"), (shift <= eps).alias("done")), "centres")
        settled.append(stepped.filter("done"))
        moving = stepped.filter("not done")
        if moving.isEmpty():
            break
    every = moving
    for part in settled:
        every = every.union(part)
    return every.select(key, F.col("n").cast("long").alias("n"), F.col("x").alias("center_lat"), F.col("y").alias("center_lon"))


def _packed_median(counted: DataFrame, key: str, steps: int, eps: float) -> DataFrame:
    packed = counted.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("lat", "lon", "w"))).alias("p"))

    def total(p, f):
        return F.aggregate(p, F.lit(0.0), lambda s, q: s + f(q))

    packed = packed.withColumn("n", total(F.col("p"), lambda q: q["w"]))
    first = F.struct((total(F.col("p"), lambda q: q["lat"] * q["w"]) / F.col("n")).alias("lat"), (total(F.col("p"), lambda q: q["lon"] * q["w"]) / F.col("n")).alias("lon"), F.lit(False).alias("done"))

    def step(s, _):
        def away(q):
            return F.sqrt(F.pow(q["lat"] - s["lat"], 2) + F.pow(q["lon"] - s["lon"], 2))

        zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

        def add(a, q):
            d = away(q)
            v = F.when(d > eps, q["w"] / d).otherwise(0.0)
            return F.struct((a["w"] + v).alias("w"), (a["x"] + v * q["lat"]).alias("x"), (a["y"] + v * q["lon"]).alias("y"))

        sums = F.aggregate(F.col("p"), zero, add)

        def move(t):
            x, y = t["x"] / t["w"], t["y"] / t["w"]
            shift = F.sqrt(F.pow(x - s["lat"], 2) + F.pow(y - s["lon"], 2))
            new = F.struct(x.alias("lat"), y.alias("lon"), (shift <= eps).alias("done"))
            stay = F.struct(s["lat"].alias("lat"), s["lon"].alias("lon"), F.lit(True).alias("done"))
            return F.when(s["done"] | (t["w"] == 0), stay).otherwise(new)

        # an array of one value lets the sums be computed once
        return F.get(F.transform(F.array(sums), move), F.lit(0))

    centre = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step)
    return packed.select(key, F.col("n").cast("long").alias("n"), centre.alias("c")).select(key, "n", F.col("c.lat").alias("center_lat"), F.col("c.lon").alias("center_lon"))


def _cells(lat: str, lon: str, size: float) -> list[Column]:
    """The cell of a place in a grid of cubes of edge ``size`` around the unit sphere."""
    y, x = F.radians(F.col(lat)), F.radians(F.col(lon))
    return [F.floor(v / size).cast("int") for v in (F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y))]


def distance_pairs(centres: DataFrame, items: DataFrame, radius_km: float | None = None) -> DataFrame:
    """Great-circle km from every centre to every item, or to those within ``radius_km`` by a join over cells.

    Places are points of the unit sphere in a grid of cubes whose edge is the chord of the radius, so a pair within it lies
    in the same or in touching cubes: no seam at the date line, none at the poles. Null places pair with nothing then.
    """
    km = haversine(F.col("center_lat"), F.col("center_lon"), F.col("latitude"), F.col("longitude"))
    if radius_km is None:
        return centres.crossJoin(small(items, items.count(), 100_000)).withColumn("km", km)
    size = max(2 * math.sin(min(radius_km / (2 * EARTH_KM), math.pi / 2)), 1e-8) * (1 + 1e-9)
    names = ["__cx", "__cy", "__cz"]
    near, there = centres, items
    for name, c, i in zip(names, _cells("center_lat", "center_lon", size), _cells("latitude", "longitude", size), strict=True):
        near, there = near.withColumn(name, F.explode(F.sequence(c - 1, c + 1))), there.withColumn(name, i)
    return near.join(there, names).drop(*names).withColumn("km", km).filter(F.col("km") <= radius_km)


def user_location(visits: DataFrame, key: str = "user_id", least: int = 5) -> DataFrame:
    """Centre of each user with at least ``least`` visits, and lambda = 1 / mean distance to them (null if all coincide)."""
    centres = geometric_median(visits, key).filter(F.col("n") >= least)
    far = visits.join(centres, key).withColumn("km", haversine(F.col("center_lat"), F.col("center_lon"), F.col("lat"), F.col("lon")))
    mean = far.groupBy(key).agg(F.avg("km").alias("m"))
    return centres.join(mean, key).select(key, "n", "center_lat", "center_lon", F.when(F.col("m") > 0, 1 / F.col("m")).alias("lambda_per_km"))


def distance_utility(pairs: DataFrame, beta: float = 1.0, gamma: float = 0.1, alpha: float = 0.5, score: str = "stars") -> DataFrame:
    """Linear, exponential and reciprocal decay of a score with distance."""
    s, d = F.col(score), F.col("km")
    return pairs.withColumns({"linear": beta * s - gamma * d, "exponential": s * F.exp(-alpha * d), "reciprocal": s / (1 + alpha * d)})
