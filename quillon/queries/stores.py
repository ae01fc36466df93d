"""Queries on sources, result stores, model batches, validation, usage and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import registry
from quillon.fixtures import ctes, interactions, items, review_tag, reviews, tag_vectors, users
from quillon.functions import prompts as P
from quillon.functions.text import aspect_list
from quillon.functions.vectors import normalise
from quillon.operators import enrich as N
from quillon.operators import usage as U
from quillon.operators.search import bm25_scores
from quillon.queries.evaluation import ndcg_at_k, precision_at_k
from quillon.queries.search import ASKED, asked, item_search
from quillon.queries.vectors import BUNDLES, KEYWORDS, bundles, request_from_bundle
from quillon.registry import query
from quillon.runtime import shared_path, table
from quillon.sources import jsonlines as J
from quillon.sources import store as S
from quillon.sources.results import ResultStore
from quillon.streaming import enrich_stream as streams

CATEGORY = "case when {} % 3 = 0 then 'Pizza, Restaurants' when {} % 3 = 1 then 'Shopping' end"


@query(f"{ctes('reviews', 'items')} select cast(item_id as varchar) as item_id, name, stars, count(*) as n_reviews from items join reviews using (item_id) where item_id % 3 = 0 group by all")
def load_items(spark, sf_dir):
    path = shared_path(spark, "business")
    raw = items(spark, sf_dir).withColumnRenamed("item_id", "business_id").withColumn("categories", F.expr(CATEGORY.format("business_id", "business_id")))
    raw.withColumn("business_id", F.col("business_id").cast("string")).write.json(path)
    n = reviews(spark, sf_dir).groupBy(F.col("item_id").cast("string").alias("item_id")).agg(F.count(F.lit(1)).alias("n_reviews"))
    return J.load_items(spark, path).join(n, "item_id").select("item_id", "name", "stars", "n_reviews")


@query("select cast(c_custkey as varchar) as user_id, c_name as name, 3 as n_friends from customer")
def load_users(spark, sf_dir):
    path = shared_path(spark, "users")
    u = users(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name")), "user_id")
    u = u.select(F.col("user_id").cast("string").alias("user_id"), "name", F.transform("friends", lambda f: f.cast("string")).alias("friends"))
    u.union(u.filter("cast(user_id as bigint) % 10 = 0")).write.json(path)
    return J.load_users(spark, path).select("user_id", "name", F.size("friends").alias("n_friends"))


@query(f"""{ctes('reviews')}, t as (select row_number() over (order by review_id) - 1 as n, * from reviews where kind = 'tip')
select case when kind = 'tip' then 'tip_' || n else cast(review_id as varchar) end as review_id, kind, cast(item_id as varchar) as item_id, length(text) as n_chars
from (select n, review_id, item_id, kind, text from t union all select null, review_id, item_id, kind, text from reviews where kind = 'review')""")
def load_reviews_and_tips(spark, sf_dir):
    path = shared_path(spark, "reviews")
    r = reviews(spark, sf_dir).select(F.col("review_id").alias("n"), F.col("item_id").cast("string").alias("business_id"), F.col("user_id").cast("string").alias("user_id"), "text", "kind")
    r.filter("kind = 'review'").select(F.col("n").cast("string").alias("review_id"), "business_id", "user_id", "text").write.json(f"{path}/r")
    # files in order of id: the file order numbers the tips
    r.filter("kind = 'tip'").repartitionByRange(4, "n").sortWithinPartitions("n").select("business_id", "user_id", "text").write.json(f"{path}/t")
    found = J.load_reviews_and_tips(spark, f"{path}/r", f"{path}/t")
    return found.select("review_id", "kind", "item_id", F.length("text").cast("long").alias("n_chars"))


@query(f"{ctes('interactions')} select item_id, count(*) as n from interactions group by 1")
def materialize(spark, sf_dir):
    path = shared_path(spark, "prepared")
    S.materialize(spark, path, lambda: interactions(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n")))
    return S.materialize(spark, path, lambda: spark.sql("select 'built twice' as item_id, 0 as n"))


STORE = """old as (select 'tags' as task, doc_id as key, 'v' as tag, 1 as version, 'a' || n_chars as payload from documents where doc_id % 3 = 0
 union all select 'tags', doc_id, 'v', 2, 'b' || n_chars from documents where doc_id % 9 = 0)"""


def stored(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("string").alias("n"))

    def version(rows, k, letter):
        return rows.select(F.lit("tags").alias("task"), F.col("doc_id").alias("key"), F.lit("v").alias("tag"), F.lit(k).alias("version"), F.concat(F.lit(letter), "n").alias("payload"))

    return version(d.filter("doc_id % 3 = 0"), 1, "a").union(version(d.filter("doc_id % 9 = 0"), 2, "b"))


def _upsert(spark, sf_dir, overwrite):
    new = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(F.lit("tags").alias("task"), F.col("doc_id").alias("key"), F.lit("v").alias("tag"), F.lit(3).alias("version"), F.lit("c").alias("payload"))
    return _plain(ResultStore(spark, shared_path(spark, "results")).put(stored(spark, sf_dir), overwrite).put(new, overwrite).rows())


def _plain(rows):
    """Stored rows with the types of the SQL."""
    return rows.select("task", F.col("key").cast("long").alias("key"), "tag", F.col("version").cast("int").alias("version"), "payload")


def _upsert_sql(order: str) -> str:
    return f"with {STORE}, both_ as (select * from old union all select 'tags', doc_id, 'v', 3, 'c' from documents where doc_id % 2 = 0) select task, key, tag, version, payload from (select *, row_number() over (partition by task, key, tag order by version {order}) as r from both_) where r = 1"


@query(_upsert_sql("desc"))
def result_store_upsert(spark, sf_dir):
    return _upsert(spark, sf_dir, True)


@query(_upsert_sql("asc"))
def result_store_keep(spark, sf_dir):
    return _upsert(spark, sf_dir, False)


@query("select 'tags' as task, doc_id as key, 'v' as tag, max(v) as version, arg_max(c, v) || any_value(n_chars) as payload from documents, (values (1, 'a', 3), (2, 'b', 9)) t(v, c, m) where doc_id % m = 0 and doc_id in (18, 21) group by doc_id")
def result_store_get(spark, sf_dir):
    """Results of two keys, read from their buckets after two puts."""
    store = ResultStore(spark, shared_path(spark, "results"))
    for rows in (stored(spark, sf_dir).filter("version = 1"), stored(spark, sf_dir).filter("version = 2")):
        store = store.put(rows)
    return _plain(store.get("18", task="tags").union(store.get("21", "v")))


@query("select doc_id as key, n_chars from documents where doc_id % 3 <> 0")
def pending_work(spark, sf_dir):
    return N.pending_work(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "n_chars"), stored(spark, sf_dir), ["key"])


@query("select key, (row_number() over (order by key) - 1) // 64 as batch from (select doc_id as key from documents where doc_id % 3 <> 0)")
def work_batches(spark, sf_dir):
    return N.work_batches(pending_work(spark, sf_dir).select("key"), "key", 64)


MODEL = "list_value('gpt-4o', 'gpt-5-mini-2024-01-01', 'GPT-4.1', 'unknown-model')[conv_id % 4 + 1]"
PROMPTS = f"prompts as (select conv_id as i, lower({MODEL}) as model, list(struct_pack(role := role, content := text) order by turn) as messages from conversations group by conv_id)"


def model(key):
    return F.get(F.array(*map(F.lit, ("gpt-4o", "gpt-5-mini-2024-01-01", "GPT-4.1", "unknown-model"))), (F.col(key) % 4).cast("int"))


def prompts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("i")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return c.select("i", F.lower(model("i")).alias("model"), F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


@query(f"""with {PROMPTS} select i, '{{"custom_id":"prompt-' || i || '","method":"POST","url":"/v1/chat/completions","body":{{"model":"' || model || '","messages":' || cast(to_json(messages) as varchar)
|| case when model like 'gpt-5%' then '' else ',"temperature":0.1' end || '}}}}' as value from prompts""")
def export_requests(spark, sf_dir):
    path = shared_path(spark, "requests")
    J.export_requests(prompts(spark, sf_dir)).select("value").write.text(path)
    lines = spark.read.text(path)
    return lines.select(F.regexp_extract("value", r'"custom_id":"prompt-(\d+)"', 1).cast("long").alias("i"), "value")


def _form_sql() -> str:
    shown = "".join(f"json_object('role', 'user', 'content', '{a}'), json_object('role', 'assistant', 'content', '{b}'), " for a, b in P.TAG_SHOTS)
    turns = "json_array(json_object('role', 'system', 'content', ask), {}json_object('role', 'user', 'content', said))"
    body = f"""json_object('model', 'm-' || kind, 'messages', case kind when 'tags' then {turns.format(shown)} else {turns.format("")} end, 'temperature', 0.1"""
    by = {k: f"""json_object('type', 'json_schema', 'json_schema', json('{P.SCHEMAS[k]}'))""" for k in ("tags", "score")}
    whole = "case kind " + " ".join(f"when '{k}' then {body}, 'response_format', {v})" for k, v in by.items()) + f" when 'judge' then {body}, 'response_format', json_object('type', 'json_object')) else {body}) end"
    asks = {"tags": P.TAG, "score": P.SCORE, "keyword": P.KEYWORD} | {f"judge{i}": P.JUDGE[k] + P.JUDGE_REPLY for i, k in enumerate(P.ASPECT_KINDS)}
    ask = "case " + " ".join(f"when kind || case kind when 'judge' then (doc_id % 3)::varchar else '' end = '{k}' then '{v}'" for k, v in asks.items()) + " end"
    said = "case when kind in ('judge', 'score') then 'Review of the place:' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'What to look for: quiet' || chr(10) || chr(10) || 'Because of the request: a quiet place' else coalesce(text, '') end"
    k = "list_value('tags', 'judge', 'score', 'keyword')[doc_id % 4 + 1]"
    line = f"json_object('custom_id', 'prompt-' || doc_id, 'method', 'POST', 'url', '/v1/chat/completions', 'body', {whole})"
    return f"select doc_id as i, md5(cast({line} as varchar)) as digest from (select *, {said} as said, {ask} as ask from (select doc_id, text, {k} as kind from documents))"


@query(_form_sql())
def model_prompts(spark, sf_dir):
    """A request line for every review: tags, a judgment by kind of aspect, a score or a keyword, each with its reply's form."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), "text")
    kind = F.get(F.array(*map(F.lit, ("tags", "judge", "score", "keyword"))), (F.col("i") % 4).cast("int"))
    aspect, asked_, text = F.lit("quiet"), F.lit("a quiet place"), F.col("text")
    sort = F.get(F.array(*map(F.lit, P.ASPECT_KINDS)), (F.col("i") % 3).cast("int"))
    messages = (
        F.when(F.col("kind") == "tags", P.tag_messages(text)).when(F.col("kind") == "judge", P.judge_messages(aspect, sort, asked_, text))
        .when(F.col("kind") == "score", P.score_messages(aspect, asked_, text)).otherwise(P.keyword_messages(text))
    )
    schema = F.when(F.col("kind") == "tags", P.SCHEMAS["tags"]).when(F.col("kind") == "score", P.SCHEMAS["score"])
    rows = d.withColumn("kind", kind).select("i", F.concat(F.lit("m-"), "kind").alias("model"), messages.alias("messages"), (F.col("kind") != "keyword").alias("use_json"), schema.alias("schema"))
    return J.export_requests(rows).select("i", F.md5("value").alias("digest"))


def _planning_sql() -> str:
    def turn(role, said):
        return f"json_object('role', '{role}', 'content', {said})"

    def line(key, kind, turns, form=""):
        said = f"json_object('model', 'planner', 'messages', json_array({', '.join(turns)}), 'temperature', 0.1{form})"
        return f"select {key} as i, md5(cast(json_object('custom_id', 'prompt-' || {key}, 'method', 'POST', 'url', '/v1/chat/completions', 'body', {said}) as varchar)) as digest from {kind}"

    def form(name):
        return f", 'response_format', json_object('type', 'json_schema', 'json_schema', json('{P.SCHEMAS[name]}'))"

    shots = [turn(role, f"'{said}'") for pair in P.DECOMPOSE_SHOTS for role, said in zip(("user", "assistant"), pair, strict=True)]
    parts = line("'parts-' || item_id", "benchmark", [turn("system", f"'{P.DECOMPOSE}'"), *shots, turn("user", "coalesce(text, '')")], form("aspects"))
    infos = line("'info-' || item_id || '-' || pos", "asp", [turn("system", f"'{P.INFO}'"), turn("user", "'Somebody asked: ' || text"), turn("user", "'Of this, tell me about: ' || aspect")], form("info"))
    request = line("'request-' || request", "rq", [turn("system", f"'{P.REQUEST}'"), turn("user", "said")])
    plain = line("'plain-' || doc_id", "documents", [turn("user", "coalesce(text, '')")])
    return rf"""with {KEYWORDS}, {BUNDLES},
rq as (select request, string_agg('- ' || keyword || ' (importance ' || importance || ', performance ' || performance || ')', chr(10) order by slot) as said from bu group by request),
al as (select item_id, text, list_filter(list_transform(string_split(coalesce(text, ''), ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as l from benchmark),
asp as (select item_id, text, unnest(range(len(l))) as pos, unnest(l) as aspect from al)
{parts} union all {infos} union all {request} union all {plain}"""


@query(_planning_sql())
def planning_prompts(spark, sf_dir):
    """Request lines around a request: taking it apart, typing each aspect, writing one from a bundle, and plain texts as they are."""
    b = table(spark, sf_dir, "benchmark")
    parts = b.select(F.concat(F.lit("parts-"), "item_id").alias("i"), P.decompose_messages(F.col("text")).alias("messages"), F.lit(P.SCHEMAS["aspects"]).alias("schema"))
    aspects = b.select("item_id", "text", F.posexplode(aspect_list(F.col("text"))).alias("pos", "aspect"))
    infos = aspects.select(F.concat_ws("-", F.lit("info"), "item_id", "pos").alias("i"), P.info_messages(F.col("aspect"), F.col("text")).alias("messages"), F.lit(P.SCHEMAS["info"]).alias("schema"))
    asked_ = bundles(spark, sf_dir).select(F.concat(F.lit("request-"), "request").alias("i"), P.request_messages(F.col("aspects")).alias("messages"), F.lit(None).cast("string").alias("schema"))
    rows = parts.union(infos).union(asked_).withColumns({"model": F.lit("planner"), "use_json": F.col("schema").isNotNull()})
    plain = table(spark, sf_dir, "documents").select(F.concat(F.lit("plain-"), "doc_id").alias("i"), F.lit("planner").alias("model"), F.col("text").alias("messages"))
    return J.export_requests(rows).union(J.export_requests(plain)).select("i", F.md5("value").alias("digest"))


def sizes(spark, sf_dir):
    """The turns of each conversation, where its texts are not wanted."""
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("i")).agg(F.count(F.lit(1)).alias("n"))


def response_lines(spark, sf_dir):
    p = sizes(spark, sf_dir).select("i", F.concat(F.lit("reply "), F.col("i").cast("string")).alias("c"), "n")
    usage = F.struct((F.col("n") * 10).alias("prompt_tokens"), F.col("n").alias("completion_tokens"))
    choices = F.when(F.col("i") % 10 == 1, F.array().cast("array<struct<message:struct<content:string>>>")).otherwise(F.array(F.struct(F.struct(F.col("c").alias("content")).alias("message"))))
    line = F.to_json(F.struct(F.concat(F.lit("prompt-"), F.col("i").cast("string")).alias("custom_id"), F.struct(F.when(F.col("i") % 10 == 0, 500).otherwise(200).alias("status_code"), F.struct(choices.alias("choices"), usage.alias("usage")).alias("body")).alias("response")))
    return p.filter("i % 10 <> 2").select(F.when(F.col("i") % 10 == 3, F.lit('{"custom_id": broken')).otherwise(line).alias("value"))


@query(f"with {PROMPTS} select i, case when i % 10 in (2, 3) then null when i % 10 in (0, 1) then '' else 'reply ' || i end as content from prompts")
def import_responses(spark, sf_dir):
    path = shared_path(spark, "responses")
    response_lines(spark, sf_dir).write.text(path)
    return J.align_outputs(sizes(spark, sf_dir), J.parse_responses(spark.read.text(path))[0])


@query(f"with {PROMPTS} select i, case when i % 10 in (2, 3) then null when i % 10 in (0, 1) then '' else 'reply ' || i end as content from prompts")
def align_outputs(spark, sf_dir):
    return J.align_outputs(sizes(spark, sf_dir), J.parse_responses(response_lines(spark, sf_dir))[0])


@query(f"""with {PROMPTS} select model, count(*) as n, cast(sum(len(messages) * 10) filter (i % 10 not in (2, 3)) as bigint) as prompt_tokens, count(*) filter (i % 10 > 3) as answered from prompts group by model""")
def batch_inference_roundtrip(spark, sf_dir):
    path = shared_path(spark, "roundtrip")
    p = prompts(spark, sf_dir)
    J.export_requests(p).select("value").write.text(f"{path}/out")
    response_lines(spark, sf_dir).write.text(f"{path}/in")
    sent = spark.read.text(f"{path}/out").select(F.get_json_object("value", "$.custom_id").alias("custom_id"), F.get_json_object("value", "$.body.model").alias("model"))
    got = J.parse_responses(spark.read.text(f"{path}/in"))[0]
    joined = sent.join(got, "custom_id", "left")
    return joined.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("prompt_tokens").alias("prompt_tokens"), F.count_if(F.col("content") != "").alias("answered"))


WORDS = r"len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))"
RATE_ROWS = ", ".join(f"('{k}', {i}, {a} / 1e6::double, {b} / 1e6::double)" for i, (k, a, b) in enumerate(U.RATES))
USAGE = f"""rates(key, place, usd_in, usd_out) as (values {RATE_ROWS}),
usage as (select conv_id, {MODEL} as model, case when conv_id % 2 = 0 then 'judge' else 'score' end as task, cast(sum(case when role <> 'assistant' then {WORDS} else 0 end) as bigint) as prompt_tokens,
  cast(sum(case when role = 'assistant' then {WORDS} else 0 end) as bigint) as completion_tokens from conversations group by conv_id),
found as (select model, key, coalesce(usd_in, 0) as usd_in, coalesce(usd_out, 0) as usd_out from (select m.model, r.*, row_number() over (partition by m.model order by lower(m.model) = key desc nulls last, length(key) desc) as k
  from (select distinct model from usage) m left join rates r on starts_with(lower(m.model), key)) where k = 1),
priced as (select usage.*, prompt_tokens * usd_in + completion_tokens * usd_out as usd from usage join found using (model))"""


def usage(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("n", F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0)))
    per = c.groupBy("conv_id").agg(F.sum(F.when(F.col("role") != "assistant", F.col("n")).otherwise(0)).alias("prompt_tokens"), F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0)).alias("completion_tokens"))
    return per.withColumns({"model": model("conv_id"), "task": F.when(F.col("conv_id") % 2 == 0, "judge").otherwise("score")})


@query(f"with {USAGE} select model, key, round(usd_in * 1e6, 6) as usd_in, round(usd_out * 1e6, 6) as usd_out from found")
def rate_lookup(spark, sf_dir):
    found = U.rate_lookup(usage(spark, sf_dir), U.rate_card(spark))
    return found.select("model", "key", F.round(F.col("usd_in") * 1e6, 6).alias("usd_in"), F.round(F.col("usd_out") * 1e6, 6).alias("usd_out"))


@query(f"with {USAGE} select model, task, cast(sum(prompt_tokens) as bigint) as prompt_tokens, cast(sum(completion_tokens) as bigint) as completion_tokens, round(sum(usd), 9) as usd from priced group by rollup(model, task)")
def usage_rollup(spark, sf_dir):
    return U.usage_rollup(usage(spark, sf_dir), U.rate_card(spark)).withColumn("usd", F.round("usd", 9))


@query(f"with {USAGE} select task, count(*) as n, round(quantile_cont((prompt_tokens * 13 % 997)::double, 0.5), 6) as p50, round(quantile_cont((prompt_tokens * 13 % 997)::double, 0.95), 6) as p95, round(sum(usd) / count(*) * 1000, 6) as usd_per_1k from priced group by task")
def latency_cost_report(spark, sf_dir):
    log = usage(spark, sf_dir).withColumn("latency_ms", (F.col("prompt_tokens") * 13 % 997).cast("double"))
    return U.latency_cost_report(log, U.rate_card(spark)).withColumns({c: F.round(c, 6) for c in ("p50", "p95", "usd_per_1k")})


@query(f"with {USAGE} select task, count(*) as n, round(sum(usd) / count(*) * 1000, 6) as usd_per_1k, true as p50_within, true as p95_within from priced group by task")
def latency_sketch_report(spark, sf_dir):
    """The report from sketches that are stored by task and day; whether the ranks of its quantiles are within the stated error."""
    path = shared_path(spark, "sketches")
    log = usage(spark, sf_dir).withColumn("latency_ms", (F.col("prompt_tokens") * 13 % 997).cast("double")).withColumn("day", F.col("completion_tokens") % 7)
    U.latency_sketches(U.priced(log, U.rate_card(spark))).write.parquet(path)
    found = U.report_from_sketches(spark.read.parquet(path))

    def within(name, q):
        low, upto = F.avg((F.col("latency_ms") < F.col(name)).cast("int")), F.avg((F.col("latency_ms") <= F.col(name)).cast("int"))
        return ((low <= q + U.SKETCH_ERROR) & (upto >= q - U.SKETCH_ERROR)).alias(f"{name}_within")

    ranks = log.select("task", "latency_ms").join(found.select("task", "p50", "p95"), "task").groupBy("task").agg(within("p50", 0.5), within("p95", 0.95))
    return found.join(ranks, "task").select("task", "n", F.round("usd_per_1k", 6).alias("usd_per_1k"), "p50_within", "p95_within")


TAG_CASE = "list_value('quiet-place', 'Loud', '', 'fine-food', 'good')[doc_id % 5 + 1]"


def tag_payloads(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    name = F.get(F.array(*map(F.lit, ("quiet-place", "Loud", "", "fine-food", "good"))), (F.col("doc_id") % 5).cast("int"))
    tag = F.struct(
        name.alias("name"), F.when(F.col("doc_id") % 7 == 0, "mixed").otherwise("positive").alias("sentiment"), F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.substring("text", 3, 12)).alias("evidence"),
        F.when(F.col("doc_id") % 13 == 0, 1.5).otherwise(0.75).alias("confidence"), F.when(F.col("doc_id") % 17 == 0, 1).alias("extra"),
    )
    return d.select(F.col("doc_id").alias("review_id"), F.when(F.col("doc_id") % 19 == 0, "no json").otherwise(F.to_json(F.struct(F.array(tag).alias("tags")))).alias("payload"))


TAG_REASON = f"""case when doc_id % 19 = 0 then 'unparseable' when doc_id % 17 = 0 then 'extra key' when {TAG_CASE} in ('Loud', '') then 'name' when doc_id % 7 = 0 then 'sentiment'
 when doc_id % 11 = 0 or substr(text, 3, 12) = '' then 'evidence' when doc_id % 13 = 0 then 'confidence' end"""


@query(f"select doc_id as review_id, case when doc_id % 19 <> 0 then {TAG_CASE} end as name, {TAG_REASON} as reason from documents where text is not null")
def validate_tags(spark, sf_dir):
    return N.validate_tags(tag_payloads(spark, sf_dir)).select("review_id", "name", "reason")


@query(f"select count(*) as n_tags, count(*) filter (contains(text, case when doc_id % 4 = 0 then reverse(substr(text, 3, 12)) else substr(text, 3, 12) end)) as n_grounded from documents where text is not null and {TAG_REASON} is null")
def evidence_grounding(spark, sf_dir):
    good = N.validate_tags(tag_payloads(spark, sf_dir)).filter("reason is null")
    good = good.withColumn("evidence", F.when(F.col("review_id") % 4 == 0, F.reverse("evidence")).otherwise(F.col("evidence")))
    return N.evidence_grounding(good, reviews(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_tags"), F.count_if("grounded").alias("n_grounded"))


@query("""select doc_id, case when doc_id % 5 = 0 then 'status' when doc_id % 7 = 0 then 'flag' when n_chars % 11 = 0 then 'confidence' when length(text) > 300 then 'reasoning'
 when (doc_id % 2 = 0) <> (doc_id % 3 = 0) then 'inconsistent' end as reason from documents where text is not null""")
def validate_judgments(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    rows = d.select(
        "doc_id", F.when(F.col("doc_id") % 5 == 0, "maybe").when(F.col("doc_id") % 3 == 0, "positive").otherwise("negative").alias("aspect_status"),
        F.when(F.col("doc_id") % 7 != 0, F.lit(True)).alias("is_conclusive"), (F.col("doc_id") % 2 == 0).alias("is_positive"), F.when(F.col("n_chars") % 11 == 0, 2.0).otherwise(0.5).alias("confidence"), F.col("text").alias("reasoning"),
    )
    return N.validate_judgments(rows).select("doc_id", "reason")


@query("""select doc_id, case when doc_id % 5 = 0 then 'score' when length(text) > 300 then 'explanation' when doc_id % 7 = 0 then 'evidence' end as reason from documents where text is not null""")
def validate_scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    rows = d.select("doc_id", F.when(F.col("doc_id") % 5 == 0, 1.2).otherwise(0.4).alias("score"), F.col("text").alias("explanation"), F.when(F.col("doc_id") % 7 != 0, "e").alias("evidence"))
    return N.validate_scores(rows).select("doc_id", "reason")


def lexicon_tags(frames):
    """A rule in place of a tagging model: the longest words become tags."""
    for f in frames:
        out = []
        for text in f["text"]:
            words = sorted({w for w in (text or "").lower().split() if w.isascii() and w.isalpha()}, key=lambda w: (-len(w), w))[:2]
            out.append([{"name": w, "sentiment": "positive" if len(w) % 2 else "negative", "evidence": w, "confidence": 0.5} for w in words])
        yield f[["key"]].assign(tags=out)


BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(rf"""with w as (select distinct doc_id as key, unnest(regexp_split_to_array(lower(text), '{BLANKS}')) as name from documents where doc_id % 3 <> 0),
r as (select key, name, row_number() over (partition by key order by length(name) desc, name) as r from w where regexp_full_match(name, '[a-z]+'))
select key, name, case when length(name) % 2 = 1 then 'positive' else 'negative' end as sentiment, 0.5::double as confidence from r where r <= 2""")
def enrich_tags(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    found = N.enrich(d, stored(spark, sf_dir), "tags", ["key"], lexicon_tags, f"key long, {N.TAGS}")
    return found.select("key", F.explode("tags").alias("t")).select("key", "t.name", "t.sentiment", "t.confidence")


def hash_embedding(frames):
    """Stands in for an embedding model: eight dimensions from a hash of the tag."""
    import hashlib

    for f in frames:
        yield f.assign(embedding=[[int(hashlib.md5(f"{t}|{d}".encode()).hexdigest()[:4], 16) / 65535 - 0.5 for d in range(8)] for t in f["tag"]])


@query(f"""{ctes('review_tag')}, x as (select tag, d as dim, ('0x' || substr(md5(tag || '|' || d), 1, 4))::int / 65535.0 - 0.5 as x from (select distinct tag from review_tag), range(8) r(d))
select tag, dim::int as dim, round((x / sqrt(sum(x * x) over (partition by tag)))::double, 6) as x from x""")
def enrich_embed(spark, sf_dir):
    """Vectors of all tags in use: a model is applied to those that the store lacks, and what it gives is stored."""
    path, tags = shared_path(spark, "vectors"), review_tag(spark, sf_dir).select("tag")
    N.embed_missing(tags.filter("tag % 3 = 0"), path, hash_embedding, "double")
    found = N.embed_missing(tags, path, hash_embedding, "double")
    return found.select("tag", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query(f"{ctes('review_tag')} select tag, count(*) as n from review_tag group by tag")
def vector_store(spark, sf_dir):
    path = shared_path(spark, "vectors")
    v, used = tag_vectors(spark, sf_dir), review_tag(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    unit = v.select("tag", normalise(F.col("embedding")).alias("embedding"))
    S.add_missing(spark, path, unit.filter("tag % 2 = 0"), "tag")
    kept = S.add_missing(spark, path, unit, "tag")
    return used.join(kept.select("tag"), "tag", "left_semi")


@query(registry.ORACLES["request_from_bundle"])
def write_requests(spark, sf_dir):

    path = shared_path(spark, "synthetic")
    J.write_requests(request_from_bundle(spark, sf_dir), path)
    return spark.read.schema("request bigint, request_text string").json(f"{path}/metadata")


@query(f"select query_id, precision, ndcg from ({ASKED}) q(query_id, query) left join ({registry.ORACLES['precision_at_k']}) p using (query_id) left join ({registry.ORACLES['ndcg_at_k']}) n using (query_id)")
def run_artifacts(spark, sf_dir):
    path = shared_path(spark, "run")
    q, found, p, n = asked(spark), item_search(spark, sf_dir), precision_at_k(spark, sf_dir), ndcg_at_k(spark, sf_dir)
    each = q.select("query_id").join(p, "query_id", "left").join(n, "query_id", "left")
    each.write.json(f"{path}/eval")
    q.write.json(f"{path}/requests")
    found.write.json(f"{path}/outcomes")
    each.agg(F.avg("precision").alias("precision"), F.avg("ndcg").alias("ndcg")).write.json(f"{path}/summary")
    return spark.read.schema("query_id int, precision double, ndcg double").json(f"{path}/eval")


@query(rf"""{ctes('reviews')} select term, review_id, item_id, count(*) as tf from (select review_id, item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+')) as term from reviews) group by all""")
def stream_enrich(spark, sf_dir):
    source, target = shared_path(spark, "arrivals"), shared_path(spark, "postings")
    _arrivals(spark, sf_dir).write.parquet(source)
    index = streams.stream_enrich(spark, source, target, max_files=2)
    return index.blocks.select("term", F.explode("found").alias("f")).select("term", "f.review_id", "f.item_id", "f.tf")


def _arrivals(spark, sf_dir):
    """Reviews in files that follow no order of time, a tenth of them twice, some without a time."""
    r = reviews(spark, sf_dir).select("review_id", "item_id", "text", F.expr("timestamp_seconds(case when review_id % 17 > 0 then review_id * 7919 % 100000000 end)").alias("ts"))
    return r.union(r.filter("review_id % 10 = 0")).repartition(4)


@query(registry.ORACLES["bm25_scores"])
def stream_search(spark, sf_dir):
    """Search over what the stream has written."""
    source, target = shared_path(spark, "arrivals"), shared_path(spark, "postings")
    _arrivals(spark, sf_dir).write.parquet(source)
    index = streams.stream_enrich(spark, source, target, max_files=2)
    return bm25_scores(index, asked(spark)).select("query_id", "review_id", F.round("score", 6).alias("score"))


@query(rf"""{ctes('reviews')} select term, count(*) as n_postings, cast(sum(tf) as bigint) as n_tokens from (select term, review_id, count(*) as tf from
(select review_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+')) as term from reviews) group by all) group by term""")
def postings(spark, sf_dir):
    return streams.postings_of(reviews(spark, sf_dir)).groupBy("term").agg(F.count(F.lit(1)).alias("n_postings"), F.sum("tf").alias("n_tokens"))
