"""JSON-lines sources with declared schemas, and batch request and response files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.prompts import plain_messages

BUSINESS = "business_id string, name string, city string, latitude double, longitude double, stars double, categories string"
USER = "user_id string, name string, friends array<string>"
REVIEW = "review_id string, user_id string, business_id string, text string, stars double, date string"
RESPONSE = (
    "custom_id string, response struct<status_code:int, body:struct<choices:array<struct<message:struct<content:string>>>, usage:struct<prompt_tokens:bigint, completion_tokens:bigint>>>"
)


def load_items(spark: SparkSession, path: str, category: str = "restaurant") -> DataFrame:
    """Businesses whose categories contain ``category`` in any case; null and empty categories go."""
    raw = spark.read.schema(BUSINESS).json(path)
    return raw.filter(F.contains(F.lower("categories"), F.lit(category.lower()))).withColumnRenamed("business_id", "item_id")


def load_users(spark: SparkSession, path: str) -> DataFrame:
    """One row per user; of repeated ids the last in file order."""
    return _last(_placed(spark.read.schema(USER).json(path)), "user_id")


def load_reviews_and_tips(spark: SparkSession, reviews: str, tips: str) -> DataFrame:
    """Reviews and tips in one shape; tips are numbered from 0 in file order and named ``tip_<n>``; of repeated ids the last stays."""
    r = _placed(spark.read.schema(REVIEW).json(reviews)).withColumn("kind", F.lit("review"))
    t = _placed(spark.read.schema(REVIEW).json(tips)).withColumn("kind", F.lit("tip"))
    counts = t.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))  # one row per file split
    before = counts.withColumn("skip", F.coalesce(F.sum("n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    local = F.row_number().over(W.partitionBy("file", "block").orderBy("line"))
    t = t.withColumn("n", local).join(before, ["file", "block"]).withColumn("review_id", F.concat(F.lit("tip_"), (F.col("n") + F.col("skip") - 1).cast("string"))).drop("n", "skip")
    both = _last(r, "review_id").unionByName(t.drop("file", "block", "line"))
    return both.withColumnRenamed("business_id", "item_id")


def _placed(df: DataFrame) -> DataFrame:
    names = df.columns
    out = df.select(*names, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return out.withColumn("line", F.monotonically_increasing_id())


def _last(df: DataFrame, key: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (key, "file", "block", "line")]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("file", "block", "line")).alias("r"))
    return best.select(key, *[F.col(f"r.{c}") for c in rest])


def export_requests(prompts: DataFrame, url: str = "/v1/chat/completions", temperature: float = 0.1) -> DataFrame:
    """``prompts`` (``i``, ``model``, ``messages``) as one JSON request line each (column ``value``).

    Messages are a list, or a text that becomes a user's only message. No temperature for models whose name begins with gpt-5. Two more columns may tell of each reply: where ``use_json`` is
    true it has to be JSON, after ``schema`` (a JSON text with the schema's name and body) if that is not null.
    """
    use, schema = (F.col(c) if c in prompts.columns else F.lit(None).cast(t) for c, t in (("use_json", "boolean"), ("schema", "string")))
    said = plain_messages(F.col("messages")) if dict(prompts.dtypes)["messages"] == "string" else F.col("messages")
    kind = F.when(use, F.when(schema.isNotNull(), "json_schema").otherwise("json_object"))
    form = F.when(kind.isNotNull(), F.struct(kind.alias("type"), F.when(kind == "json_schema", F.parse_json(schema)).alias("json_schema")))
    warm = F.when(~F.startswith(F.lower("model"), F.lit("gpt-5")), F.lit(temperature))
    body = F.struct(F.col("model").alias("model"), said.alias("messages"), warm.alias("temperature"), form.alias("response_format"))
    line = F.struct(F.concat(F.lit("prompt-"), F.col("i").cast("string")).alias("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url"), body.alias("body"))
    return prompts.select("i", F.to_json(line).alias("value"))


def parse_responses(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Response lines (``value``) as (parsed, rejected): ``custom_id``, ``content`` and token counts; lines that are no JSON.

    A status other than 200 and a reply without choices give an empty content. Blank lines are passed over.
    """
    rows = lines.filter(F.trim("value") != "").withColumn("r", F.from_json("value", RESPONSE + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = rows.filter("r is null or r._bad is not null or r.custom_id is null").select("value")
    good = rows.filter("r._bad is null and r.custom_id is not null")
    content = F.when((F.col("r.response.status_code") == 200) & (F.size("r.response.body.choices") > 0), F.get("r.response.body.choices", F.lit(0))["message"]["content"])
    usage = [F.coalesce(f"r.response.body.usage.{c}", F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens")]
    return good.select("r.custom_id", F.coalesce(content, F.lit("")).alias("content"), *usage), bad


def align_outputs(prompts: DataFrame, parsed: DataFrame) -> DataFrame:
    """Contents in the order of the prompts; null where no response came."""
    keyed = prompts.select("i", F.concat(F.lit("prompt-"), F.col("i").cast("string")).alias("custom_id"))
    return keyed.join(parsed, "custom_id", "left").select("i", "content")


def write_requests(bundles: DataFrame, path: str) -> None:
    """Requests as text separated by a blank line, and their bundles as JSON lines."""
    bundles.select("request_text").write.option("lineSep", "\n\n").text(f"{path}/requests")
    bundles.write.json(f"{path}/metadata")
