"""Queries on tags, vectors and request synthesis."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.fixtures import ctes, review_tag, reviews, tag_vectors
from quillon.functions.vectors import cosine
from quillon.operators import tags as T
from quillon.operators.cells import build_cells
from quillon.operators.cells import nearest_by_cells as nearest
from quillon.plans import synthesize as Y
from quillon.registry import query
from quillon.runtime import table
from quillon.sources.store import check_vectors

ASPECTS = (0, 7, 42)
D = "cast({} as double[])"
COS = "list_dot_product({a}, {b}) / (greatest(sqrt(list_dot_product({a}, {a})), 1e-12) * greatest(sqrt(list_dot_product({b}, {b})), 1e-12))"
SIMS = f"""v as (select tag, cast(embedding as double[]) as e from tag_vectors), asp as (select 'aspect_' || tag as aspect, e as a from v where tag in {ASPECTS}),
used as (select * from v where tag in (select tag from review_tag)),
sims as (select aspect, tag, {COS.format(a='a', b='e')} as similarity from used, asp),
top as (select *, row_number() over (partition by aspect order by round(similarity, 9) desc, tag) as rank from sims),
dec as (select * from top where rank <= greatest(1, cast(floor(0.1 * (select count(*) from used)) as integer)) and similarity >= 0)"""


def aspect_vectors(spark, sf_dir):
    v = tag_vectors(spark, sf_dir).filter(F.col("tag").isin(*ASPECTS))
    return v.select(F.concat(F.lit("aspect_"), F.col("tag").cast("string")).alias("aspect"), F.col("embedding").alias("vector"))


@query(f"{ctes('tag_vectors', 'review_tag')}, {SIMS} select aspect, rank, tag, round(similarity, 6) as similarity from dec")
def top_decile_tags(spark, sf_dir):
    found = T.top_decile_tags(aspect_vectors(spark, sf_dir), tag_vectors(spark, sf_dir), review_tag(spark, sf_dir))
    return found.select("aspect", F.col("rank").cast("long").alias("rank"), "tag", F.round("similarity", 6).alias("similarity"))


@query(f"{ctes('tag_vectors', 'review_tag')}, {SIMS} select distinct aspect, item_id from dec join review_tag using (tag)")
def tag_items(spark, sf_dir):
    found = T.top_decile_tags(aspect_vectors(spark, sf_dir), tag_vectors(spark, sf_dir), review_tag(spark, sf_dir)).select("aspect", "tag")
    return T.tag_items(found, review_tag(spark, sf_dir))


@query(f"{ctes('review_tag')} select tag, count(*) as n_reviews, count(distinct item_id) as n_items from review_tag group by tag")
def inverted_tags(spark, sf_dir):
    return T.inverted_tags(review_tag(spark, sf_dir))


MOMENTS = "mo as (select dim - 1 as dim, avg(x) as mean, case when stddev_pop(x) = 0 then 1 else stddev_pop(x) end as std from (select unnest(cast(embedding as double[])) as x, unnest(range(1, len(embedding) + 1)) as dim from embeddings) group by dim)"


@query(f"with {MOMENTS} select cast(dim as integer) as dim, round(mean, 6) as mean, round(std, 6) as std from mo")
def vector_moments(spark, sf_dir):
    found = T.vector_moments(table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")))
    return found.select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _u(side: str) -> str:
    return f"((cast('0x' || substr(md5('42|' || point || '|' || dim || '|{side}'), 1, 8) as bigint) + 0.5::double) / 4294967296.0::double)"


POINTS = f"""po as (select point, dim, mean + std * sqrt(-2 * ln({_u('a')})) * cos(2 * 3.141592653589793 * {_u('b')}) as x from range(24) t(point), mo),
pv as (select point, list(x order by dim) as p from po group by point)"""


@query(f"with {MOMENTS}, {POINTS} select point, cast(dim as integer) as dim, round(x, 6) as x from po")
def sample_points(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    found = T.sample_points(T.vector_moments(v), 24)
    return found.select("point", F.posexplode("vector").alias("dim", "x")).withColumn("x", F.round("x", 6))


NEAR = f"""nn as (select point, vec_id, round({COS.format(a='p', b='e')}, 9) as s from pv, (select vec_id, cast(embedding as double[]) as e from embeddings)),
nr as (select point, vec_id, s from (select *, row_number() over (partition by point order by s desc, vec_id) as r from nn) where r = 1)"""


@query(f"with {MOMENTS}, {POINTS}, {NEAR} select point, vec_id, round(s, 6) as similarity from nr")
def nearest_vector(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    found = T.nearest_vector(T.sample_points(T.vector_moments(v), 24), v, "vec_id")
    return found.withColumn("similarity", F.round("similarity", 6))


@query(f"with {MOMENTS}, {POINTS}, {NEAR} select point, vec_id, round(s, 6) as similarity from nr")
def nearest_by_cells(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    found = nearest(T.sample_points(T.vector_moments(v), 24), build_cells(v, "vec_id"))
    return found.withColumn("similarity", F.round("similarity", 6))


FIRST = """fs as (select vec_id, 0 as part, lpad(cast(min(point) as varchar), 20, '0') as place from nr group by vec_id
 union all select vec_id, 1, md5('42|' || vec_id) from embeddings where vec_id not in (select vec_id from nr)),
ch as (select row_number() over (order by part, place, vec_id) as position, vec_id from fs order by part, place, vec_id limit 40)"""


@query(f"with {MOMENTS}, {POINTS}, {NEAR}, {FIRST} select position, vec_id from ch")
def first_seen_limit(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    near = T.nearest_vector(T.sample_points(T.vector_moments(v), 24), v, "vec_id")
    return T.first_seen_limit(near, v, "vec_id", 40).select(F.col("position").cast("long").alias("position"), "vec_id")


@query("select doc_id, row_number() over (order by md5('7|' || doc_id), doc_id) as place from documents")
def seeded_shuffle(spark, sf_dir):
    from pyspark.sql import Window as W

    d = T.seeded_shuffle(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7, "h")
    # whole-table places come from hash ranges: places before a bucket, then places within it
    d = d.withColumn("b", F.substring("h", 1, 2))
    counts = d.groupBy("b").agg(F.count(F.lit(1)).alias("n"))  # at most 256 rows
    skip = counts.withColumn("skip", F.coalesce(F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("b", "skip")
    place = F.row_number().over(W.partitionBy("b").orderBy("h", "doc_id")) + F.col("skip")
    return d.join(F.broadcast(skip), "b").select("doc_id", place.cast("long").alias("place"))


LONGEST = r"""list_reduce(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), lambda a, b: case when length(b) > length(a) then b else a end)"""
KEYWORDS = f"kw0 as (select doc_id as position, case when len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+')) = 0 then '' else {LONGEST} end as keyword from documents), kw as (select position, keyword from (select *, row_number() over (partition by keyword order by position) as r from kw0 where keyword <> '') where r = 1)"


@query(f"with {KEYWORDS} select position, keyword from kw")
def keyword_dedup(spark, sf_dir):
    return Y.keywords_of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), "text")).select("position", "keyword")


@query(f"with {KEYWORDS} select position as review_id, keyword from kw0 where keyword <> ''")
def keyword_from_segment(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("review_id"), Y.clean_keyword(Y.longest_token(F.col("text"))).alias("keyword")).filter("keyword <> ''")


def _label(kind: str, names: str) -> str:
    return f"list_value({names})[('0x' || substr(md5('42{kind}|' || n), 1, 4))::int % 3 + 1]"


BUNDLES = f"""pool as (select count(*) as p from kw), cy as (select unnest(range(cast(ceil(50.0 / p) as bigint))) as cycle from pool),
dl as (select cycle * p + row_number() over (partition by cycle order by md5('42|' || cycle || '|' || position)) - 1 as n, keyword from kw, cy, pool),
bu as (select n // 5 as request, n % 5 as slot, keyword, {_label('i', "'low', 'medium', 'high'")} as importance, {_label('p', "'poor', 'fair', 'good'")} as performance from dl where n < 50)"""


@query(f"with {KEYWORDS}, {BUNDLES} select request, slot, keyword, importance, performance from bu")
def bundle_assign(spark, sf_dir):
    kw = Y.keywords_of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), "text"))
    return T.bundle_assign(kw, 10, 5)


def bundles(spark, sf_dir):
    """Requests with their text and aspects, out of keywords of all documents."""
    kw = Y.keywords_of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), "text"))
    return Y.request_from_bundle(T.bundle_assign(kw, 10, 5))


@query(f"with {KEYWORDS}, {BUNDLES} select request, string_agg(keyword, ', ' order by slot) as request_text from bu group by request")
def request_from_bundle(spark, sf_dir):
    return bundles(spark, sf_dir).select("request", "request_text")


def _synthesis_sql(requests: int, per: int) -> str:
    n = requests * per
    words = """kw0 as (select position, case when len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) = 0 then '' else %s end as keyword from ch join documents on doc_id = vec_id),
kw as (select position, keyword from (select *, row_number() over (partition by keyword order by position) as r from kw0 where keyword <> '') where r = 1)""" % LONGEST
    dealt = BUNDLES.replace("50.0", f"{n}.0").replace("// 5", f"// {per}").replace("% 5 as slot", f"% {per} as slot").replace("n < 50", f"n < {n}")
    return f"with {MOMENTS}, {POINTS.replace('range(24)', f'range({3 * n})')}, {NEAR}, {FIRST.replace('limit 40', f'limit {n}')}, {words}, {dealt} select request, string_agg(keyword, ', ' order by slot) as request_text from bu group by request"


@query(_synthesis_sql(8, 3))
def synthesize_requests(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("segment"), F.col("embedding").cast("array<double>").alias("embedding"))
    s = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("segment"), "text")
    return Y.synthesize_requests(s, v, 8, 3).select("request", "request_text")


@query("select count(*) as rows, count(*) filter (embedding is null) as missing, mode(len(embedding))::int as dims, count(*) - count(*) filter (embedding is null) - (select max(n) from (select count(*) as n from embeddings group by len(embedding))) as odd from embeddings")
def fixture_source(spark, sf_dir):
    return check_vectors(table(spark, sf_dir, "embeddings"))


@query(f"with v as (select vec_id, cast(embedding as double[]) as e from embeddings) select a.vec_id, round({COS.format(a='a.e', b='b.e')}, 6) as cosine from v a join v b on b.vec_id = case when a.vec_id = (select max(vec_id) from v) then (select min(vec_id) from v) else a.vec_id + 1 end")
def cosine_pairs(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = v.select(F.col("vec_id").alias("o"), F.col("embedding").alias("other"))
    ends = v.agg(F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))  # one row
    paired = v.crossJoin(F.broadcast(ends)).withColumn("o", F.when(F.col("vec_id") == F.col("last"), F.col("first")).otherwise(F.col("vec_id") + 1))
    return paired.join(other, "o").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))
