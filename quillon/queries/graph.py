"""Queries on cleaning and slicing the user-item-review graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.fixtures import ctes, interactions, items, reviews, users
from quillon.operators import clean as C
from quillon.plans.prepare import prepare_dataset as prepare
from quillon.registry import query
from quillon.runtime import shared_path, table

LEAST_USER, LEAST_ITEM = 30, 26


@query(f"{ctes('reviews')} select review_id, item_id, user_id, kind, text from reviews where length(coalesce(text, '')) >= 200")
def drop_short_reviews(spark, sf_dir):
    return C.drop_short_reviews(reviews(spark, sf_dir)).select("review_id", "item_id", "user_id", "kind", "text")


@query(f"{ctes('items')}, w as (select doc_id, doc_id % 100 as item_id from documents) select item_id, trim(city, ' ' || chr(9)) as city, latitude, longitude, count(*) as n_reviews from items join w using (item_id) group by all")
def shape_items(spark, sf_dir):
    n = reviews(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_reviews"))
    return C.shape_items(items(spark, sf_dir)).join(n, "item_id").select("item_id", "city", "latitude", "longitude", "n_reviews")


@query(f"""{ctes('reviews')} select review_id, item_id, user_id, kind, text, case when kind = 'tip' then null else cast(1 + review_id % 5 as double) end as stars,
  case when review_id % 7 = 0 then null else timestamp '2020-01-01 00:00:00' + to_days(cast(review_id % 365 as integer)) end as datetime from reviews""")
def shape_reviews(spark, sf_dir):
    day = F.date_format(F.expr("timestamp_ntz '2020-01-01 00:00:00' + make_dt_interval(cast(review_id % 365 as int))"), "yyyy-MM-dd HH:mm:ss")
    raw = reviews(spark, sf_dir).withColumns({
        "stars": F.when(F.col("kind") == "tip", "").otherwise((1 + F.col("review_id") % 5).cast("string")), "date": F.when(F.col("review_id") % 7 == 0, "unknown").otherwise(day),
    })
    shaped = C.shape_reviews(raw)
    return shaped.withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


@query(f"{ctes('reviews', 'items')} select review_id, item_id, user_id from reviews where item_id in (select item_id from items where stars >= 3)")
def semi_reviews_items(spark, sf_dir):
    return C.semi_reviews_items(reviews(spark, sf_dir), items(spark, sf_dir).filter("stars >= 3")).select("review_id", "item_id", "user_id")


@query(f"{ctes('interactions')} select l_orderkey, l_linenumber, user_id, item_id from interactions where user_id in (select c_custkey from customer where c_custkey % 3 > 0) and item_id in (select p_partkey from part where p_partkey % 4 > 0)")
def drop_dangling(spark, sf_dir):
    u = table(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("user_id"))
    i = table(spark, sf_dir, "part").filter("p_partkey % 4 > 0").select(F.col("p_partkey").alias("item_id"))
    return C.drop_dangling(interactions(spark, sf_dir), u, i).select("l_orderkey", "l_linenumber", "user_id", "item_id")


@query(f"{ctes('interactions')} select 'user' as side, user_id as id, count(*) as degree from interactions group by user_id union all select 'item', item_id, count(*) from interactions group by item_id")
def degrees(spark, sf_dir):
    e = interactions(spark, sf_dir)
    one = C.degrees(e, "user_id").select(F.lit("user").alias("side"), F.col("user_id").alias("id"), "degree")
    return one.union(C.degrees(e, "item_id").select(F.lit("item"), "item_id", "degree"))


def _prune_sql(passes: int) -> str:
    out = [ctes("interactions"), "u0 as (select c_custkey as user_id from customer)", "i0 as (select p_partkey as item_id from part)", "e0 as (select * from interactions)"]
    for k in range(1, passes + 1):
        p = k - 1
        alive = f"select * from e{p} where user_id in (select user_id from u{p}) and item_id in (select item_id from i{p})"
        out += [
            f"a{k} as ({alive})", f"u{k} as (select user_id from u{p} where user_id in (select user_id from a{k} group by 1 having count(*) >= {LEAST_USER}))",
            f"i{k} as (select item_id from i{p} where item_id in (select item_id from a{k} group by 1 having count(*) >= {LEAST_ITEM}))",
            f"e{k} as (select * from e{p} where user_id in (select user_id from u{k}) and item_id in (select item_id from i{k}))",
        ]
    return ", ".join(out) + f" select l_orderkey, l_linenumber, user_id, item_id from e{passes}"


@query(_prune_sql(2))
def core_prune(spark, sf_dir):
    u = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    i = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"))
    return C.core_prune(interactions(spark, sf_dir), u, i, LEAST_USER, LEAST_ITEM)[0].select("l_orderkey", "l_linenumber", "user_id", "item_id")


@query(f"""{ctes('users')}, p as (select distinct user_id, unnest(friends) as f from users)
select u.user_id, coalesce(list_sort(list(f) filter (f is not null)), []) as friends from users u left join (select * from p where f in (select user_id from users)) k on k.user_id = u.user_id group by u.user_id""")
def friends_existing(spark, sf_dir):
    return C.friends_existing(users(spark, sf_dir))


CITY = "nation_6"


@query(f"""{ctes('reviews', 'items')}, h as (select item_id from items where lower(trim(city, ' ' || chr(9))) = '{CITY.lower()}')
select review_id, item_id, user_id from reviews where item_id in (select item_id from h)""")
def city_slice(spark, sf_dir):
    r = reviews(spark, sf_dir)
    return C.city_slice(C.shape_items(items(spark, sf_dir)), r, r.select("user_id").distinct(), CITY)[1].select("review_id", "item_id", "user_id")


@query(f"{ctes('reviews')} select review_id, item_id from reviews where item_id in (select doc_id % 100 from documents where doc_id % 11 = 0 and doc_id % 100 < 50)")
def allowlist_slice(spark, sf_dir):
    r, i = reviews(spark, sf_dir), items(spark, sf_dir)
    verdicts = r.filter("review_id % 11 = 0").select("item_id").distinct().select(F.lit("quiet").alias("aspect"), "item_id", (F.col("item_id") < 50).alias("positive"))
    return C.allowlist_slice(i, r, verdicts, "quiet")[1].select("review_id", "item_id")


@query(f"""{ctes('reviews', 'items')} select trim(city, ' ' || chr(9)) as city, count(distinct user_id) as n_users, count(distinct item_id) as n_items, count(*) as n_reviews
from reviews join items using (item_id) group by all""")
def dataset_counts(spark, sf_dir):
    joined = reviews(spark, sf_dir).join(C.shape_items(items(spark, sf_dir)).select("item_id", "city"), "item_id")
    return joined.groupBy("city").agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items"), F.count(F.lit(1)).alias("n_reviews"))


RAW = f"""{ctes('reviews', 'items')}, rv as (select case when kind = 'tip' then 'tip_' || n else cast(review_id as varchar) end as review_id, kind, cast(item_id as varchar) as item_id, cast(user_id as varchar) as user_id, text
  from (select *, row_number() over (partition by kind order by review_id) - 1 as n from reviews)),
us as (select cast(user_id as varchar) as user_id, [cast(user_id * 3 + 1 as varchar), cast(user_id * 5 + 2 as varchar), cast(user_id * 100000 as varchar)] as friends from (select distinct user_id from reviews)),
it as (select cast(item_id as varchar) as item_id, city, stars from items where item_id % 7 > 0)"""


@query(f"""{RAW}, long as (select * from rv where length(coalesce(text, '')) >= 200),
e0 as (select * from long where user_id in (select user_id from us) and item_id in (select item_id from it)),
u1 as (select user_id from e0 group by 1 having count(*) >= 3), i1 as (select item_id from e0 group by 1 having count(*) >= 5),
e1 as (select * from long where user_id in (select user_id from u1) and item_id in (select item_id from i1)),
u2 as (select user_id from u1 where user_id in (select user_id from e1 group by 1 having count(*) >= 3)), i2 as (select item_id from i1 where item_id in (select item_id from e1 group by 1 having count(*) >= 5)),
e2 as (select * from e1 where user_id in (select user_id from u2) and item_id in (select item_id from i2)),
fr as (select user_id, count(distinct f) as n from (select user_id, unnest(friends) as f from us where user_id in (select user_id from u2)) where f in (select user_id from u2) group by user_id)
select review_id, kind, item_id, user_id, trim(city, ' ' || chr(9)) as city, stars, text, coalesce(n, 0) as n_friends from e2 join it using (item_id) left join fr using (user_id)""")
def prepare_dataset(spark, sf_dir):
    path = shared_path(spark, "sources")
    r = reviews(spark, sf_dir)
    names = [F.col("item_id").cast("string").alias("business_id"), F.col("user_id").cast("string").alias("user_id"), "text"]
    r.filter("kind = 'review'").select(F.col("review_id").cast("string").alias("review_id"), *names).write.json(f"{path}/review")
    # files in order of id: the file order numbers the tips
    r.filter("kind = 'tip'").repartitionByRange(4, "review_id").sortWithinPartitions("review_id").select(*names).write.json(f"{path}/tip")
    u = r.select("user_id").distinct()
    friends = F.array(*[c.cast("string") for c in (F.col("user_id") * 3 + 1, F.col("user_id") * 5 + 2, F.col("user_id") * 100_000)])
    u.select(F.col("user_id").cast("string").alias("user_id"), friends.alias("friends")).write.json(f"{path}/user")
    i = items(spark, sf_dir).withColumn("categories", F.when(F.col("item_id") % 7 > 0, "Pizza, Restaurants").otherwise("Shopping"))
    i.withColumn("business_id", F.col("item_id").cast("string")).drop("item_id").write.json(f"{path}/business")
    people, places, kept = prepare(spark, path, 3, 5)
    out = kept.join(places.select("item_id", "city", F.col("stars").alias("item_stars")), "item_id").join(people.select("user_id", F.size("friends").cast("long").alias("n_friends")), "user_id")
    return out.select("review_id", "kind", "item_id", "user_id", "city", F.col("item_stars").alias("stars"), "text", "n_friends")
