"""Logical review tables derived from the given tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.runtime import table

ITEM_COUNT, USER_COUNT, TAG_COUNT = 100, 150, 500


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    user = F.pmod(F.col("doc_id") * 31 + F.floor(F.col("doc_id") / 100) * 7, F.lit(USER_COUNT))
    kind = F.when(F.col("source") == "src0", "tip").otherwise("review")
    return d.select(F.col("doc_id").alias("review_id"), (F.col("doc_id") % ITEM_COUNT).alias("item_id"), user.alias("user_id"), "text", kind.alias("kind"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    i = spark.range(ITEM_COUNT).withColumnRenamed("id", "item_id")
    joined = i.join(F.broadcast(n), F.col("n_nationkey") == F.col("item_id") % 25)
    return joined.select(
        "item_id", F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("name"), (1 + F.col("item_id") * 7 % 9 / 2.0).cast("double").alias("stars"),
        F.concat(F.lit("  "), "n_name", F.lit("\t")).alias("city"), (38 + F.col("item_id") * 37 % 100 / 500.0).cast("double").alias("latitude"),
        (-90 + F.col("item_id") * 53 % 100 / 500.0).cast("double").alias("longitude"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    friends = F.array(F.col("user_id") * 3 + 1, F.col("user_id") * 5 + 2, F.col("user_id") * 100_000)
    return c.withColumn("friends", friends)


def review_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir).select("review_id", "item_id")
    tags = F.array(F.col("review_id") * 7 % TAG_COUNT, (F.col("review_id") * 13 + 1) % TAG_COUNT, (F.col("review_id") * 29 + 2) % TAG_COUNT)
    return r.select(F.explode(tags).alias("tag"), "review_id", "item_id").distinct()


def tag_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tag"), "embedding")


def rule_hash(aspect, key):
    """The integer of the first four hex digits of md5(aspect | key): stands in for a model, alike in Spark and SQL."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", aspect, key.cast("string"))), 1, 4), 16, 10).cast("int")


SQL = {
    "reviews": """reviews as (select doc_id as review_id, doc_id % 100 as item_id, (doc_id * 31 + (doc_id // 100) * 7) % 150 as user_id, text,
  case when source = 'src0' then 'tip' else 'review' end as kind from documents)""",
    "items": """items as (select i as item_id, 'item_' || i as name, cast(1 + (i * 7 % 9) / 2.0 as double) as stars, '  ' || n_name || chr(9) as city,
  cast(38 + (i * 37 % 100) / 500.0 as double) as latitude, cast(-90 + (i * 53 % 100) / 500.0 as double) as longitude
  from range(100) t(i) join nation on n_nationkey = i % 25)""",
    "interactions": """interactions as (select l_orderkey, l_linenumber, o_custkey as user_id, l_partkey as item_id from lineitem join orders on l_orderkey = o_orderkey)""",
    "users": """users as (select c_custkey as user_id, [c_custkey * 3 + 1, c_custkey * 5 + 2, c_custkey * 100000] as friends from customer)""",
    "review_tag": """review_tag as (select distinct unnest([doc_id * 7 % 500, (doc_id * 13 + 1) % 500, (doc_id * 29 + 2) % 500]) as tag, doc_id as review_id, doc_id % 100 as item_id from documents)""",
    "tag_vectors": "tag_vectors as (select vec_id as tag, embedding from embeddings)",
}


def ctes(*names: str) -> str:
    """``with`` clause of the named logical tables (reviews etc.); further expressions may follow after a comma."""
    return "with " + ", ".join(SQL[n] for n in names)


def rule_sql(aspect: str, key: str) -> str:
    return f"(('0x' || substr(md5({aspect} || '|' || {key}), 1, 4))::int)"
