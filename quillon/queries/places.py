"""Queries on locations and distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.fixtures import ctes, items, reviews
from quillon.functions.geo import EARTH_KM
from quillon.operators import geo as G
from quillon.registry import query

KM = f"""(2 * {EARTH_KM} * atan2(sqrt({{h}}), sqrt(greatest(0, 1 - ({{h}})))))"""
HAV = "(pow(sin((radians({b}lat) - radians({a}lat)) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))"


def _km(a: str, b: str) -> str:
    return KM.format(h=HAV.format(a=a, b=b))


VISITS = f"{ctes('reviews', 'items')}, vi as (select user_id, latitude as lat, longitude as lon from reviews join items using (item_id))"
CENTROID = f"{VISITS}, ce as (select user_id, avg(lat) as lat, avg(lon) as lon from vi group by 1), pr as (select ce.user_id, item_id, stars, {_km('c.', 'i.')} as km from ce, (select user_id as u, lat, lon from ce) c, (select item_id, stars, latitude as lat, longitude as lon from items) i where c.u = ce.user_id)"


def visits(spark, sf_dir):
    i = items(spark, sf_dir).select("item_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return reviews(spark, sf_dir).select("user_id", "item_id").join(i, "item_id").select("user_id", "lat", "lon")


def centroids(spark, sf_dir):
    return visits(spark, sf_dir).groupBy("user_id").agg(F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon"))


@query(f"{CENTROID} select user_id, item_id, round(km, 6) as km from pr")
def distance_pairs(spark, sf_dir):
    return G.distance_pairs(centroids(spark, sf_dir), items(spark, sf_dir)).select("user_id", "item_id", F.round("km", 6).alias("km"))


@query(f"{CENTROID} select user_id, item_id, round(km, 6) as km from pr where km <= 6")
def distance_within(spark, sf_dir):
    return G.distance_pairs(centroids(spark, sf_dir), items(spark, sf_dir), radius_km=6.0).select("user_id", "item_id", F.round("km", 6).alias("km"))


@query(f"""{CENTROID} select user_id, item_id, round(stars - 0.1 * km, 6) as linear, round(stars * exp(-0.5 * km), 6) as exponential, round(stars / (1 + 0.5 * km), 6) as reciprocal from pr""")
def distance_utility(spark, sf_dir):
    found = G.distance_utility(G.distance_pairs(centroids(spark, sf_dir), items(spark, sf_dir)))
    return found.select("user_id", "item_id", *[F.round(c, 6).alias(c) for c in ("linear", "exponential", "reciprocal")])


MEDIAN = f"""{VISITS.replace('with ', 'with recursive ', 1)}, pt as (select user_id, lat, lon, count(*)::double as w from vi where lat is not null and lon is not null group by all),
st as (select user_id, sum(w)::bigint as n, sum(lat * w) / sum(w) as lat, sum(lon * w) / sum(w) as lon from pt group by user_id),
md(user_id, k, lat, lon, done) as (select user_id, 0, lat, lon, false from st union all
  select user_id, k + 1, case when w = 0 then lat else x / w end, case when w = 0 then lon else y / w end, w = 0 or sqrt(pow(x / w - lat, 2) + pow(y / w - lon, 2)) <= 1e-9
  from (select user_id, k, lat, lon, sum(v) as w, sum(v * a) as x, sum(v * o) as y
    from (select md.*, pt.lat as a, pt.lon as o, case when sqrt(pow(pt.lat - md.lat, 2) + pow(pt.lon - md.lon, 2)) > 1e-9 then pt.w / sqrt(pow(pt.lat - md.lat, 2) + pow(pt.lon - md.lon, 2)) else 0 end as v
      from md join pt using (user_id) where k < 128 and not done) group by user_id, k, lat, lon)),
me as (select user_id, n, arg_max(md.lat, k) as lat, arg_max(md.lon, k) as lon from md join st using (user_id) group by user_id, n)"""


@query(f"{MEDIAN} select user_id, n, round(lat, 6) as center_lat, round(lon, 6) as center_lon from me")
def geometric_median(spark, sf_dir):
    return G.geometric_median(visits(spark, sf_dir), "user_id").withColumns({c: F.round(c, 6) for c in ("center_lat", "center_lon")})


@query(f"""{MEDIAN}, fa as (select me.user_id, avg({_km('me.', 'vi.')}) as m from me join vi using (user_id) group by 1)
select user_id, n, round(lat, 6) as center_lat, round(lon, 6) as center_lon, case when m > 0 then round(1 / m, 6) end as lambda_per_km from me join fa using (user_id) where n >= 5""")
def user_location(spark, sf_dir):
    return G.user_location(visits(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("center_lat", "center_lon", "lambda_per_km")})
