"""Tool-call linking with DataFrame functions only.

Calls and results are joined by identifier, calls are ordered topologically by the calls they depend on, arguments are
validated against declared parameters, and messages are written as canonical JSON (keys sorted, no blanks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.ranking import grouped_rank
from quillon.runtime import save_stage


#: Strings, numbers and what lies between them; together all of a text. Repetitions keep what they took, so strings of any
#: length are matched without a stack.
_PARTS = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|-?[0-9]++(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|[^"0-9-]++|[\s\S]'
_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
#: Digits that a number's plain decimal form can have.
DIGITS = 38


def _plain(number: Column) -> Column:
    """A JSON number as a plain decimal without needless zeros; ``!`` (no JSON) if that takes more than ``DIGITS`` digits."""
    fraction = F.regexp_extract(number, r"\.([0-9]+)", 1)
    power = F.regexp_extract(number, r"[eE][+]?(-?[0-9]+)$", 1)
    digits = F.ltrim(F.concat(F.regexp_extract(number, r"^-?([0-9]+)", 1), fraction), F.lit("0"))
    # a power that is no int is far out of range
    shift = F.when(power == "", 0).otherwise(F.coalesce(power.try_cast("int"), F.lit(10**9))) - F.length(fraction)
    kept = F.rtrim(digits, F.lit("0"))
    shift = shift + F.length(digits) - F.length(kept)
    whole = F.length(kept) + shift  # digits before the point
    fits = (F.greatest(F.length(kept), whole) <= DIGITS) & (-shift <= DIGITS)
    text = (
        F.when(shift >= 0, F.concat(kept, F.repeat(F.lit("0"), F.least(shift, F.lit(DIGITS)))))
        .when(whole > 0, F.concat(F.substring(kept, F.lit(1), whole), F.lit("."), F.substring(kept, whole + 1, F.length(kept))))
        .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), F.least(-whole, F.lit(DIGITS))), kept))
    )
    signed = F.concat(F.when(F.startswith(number, F.lit("-")), "-").otherwise(""), text)
    return F.when(kept == "", "0").when(fits, signed).otherwise("!")


def exact_numbers(json: Column) -> Column:
    """A JSON text whose numbers are plain decimals, so that parsing it rounds none; other text is left as it is."""
    parts = F.transform(F.regexp_extract_all(json, F.lit(_PARTS), 0), lambda p: F.when(p.rlike(_NUMBER), _plain(p)).otherwise(p))
    return F.when(json.rlike(r"[0-9][eE][+-]?[0-9]|[0-9.]{39}"), F.array_join(parts, "")).otherwise(json)


def canonical(json: Column) -> Column:
    """Canonical JSON of a JSON text: object keys sorted, no blanks, each number in one exact decimal form (``1e2``, ``100.0``
    and ``100`` are ``100``). Null if it does not parse, repeats a key, or holds a number of more than ``DIGITS`` digits."""
    return F.to_json(F.try_parse_json(exact_numbers(json)))


def levels(calls: DataFrame, depends: DataFrame) -> DataFrame:
    """Topological levels: ``conv_id``, ``call_id`` and ``level`` (0 without dependencies, else one more than the deepest).

    ``depends`` has ``conv_id``, ``call_id`` and ``on_id``. Dependencies on unknown calls are ignored. Calls on a cycle, and
    calls behind one, have no level and are left out. Chains of calls with one dependency each are shortened by doubling
    pointers (rounds: the logarithm of the chain's length). Then each round places the calls with several dependencies
    whose anchors are all placed (rounds: how many such calls follow one another).
    """
    keys = ["conv_id", "call_id"]
    nodes = save_stage(calls.select(*keys).distinct(), "calls")
    known = nodes.select("conv_id", F.col("call_id").alias("on_id"))
    edges = save_stage(depends.select(*keys, "on_id").distinct().join(known, ["conv_id", "on_id"], "left_semi"), "edges")
    degree = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("on_id").alias("up"))
    single = save_stage(degree.filter("n = 1").select(*keys, "up", F.lit(1).alias("dist")), "single")
    most = max(1, nodes.count()).bit_length() + 1
    chains = single.withColumn("moved", F.lit(True))
    for _ in range(most):
        step = chains.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("d2"))
        jumped = chains.join(step, ["conv_id", "up"], "left")
        jumped = jumped.select(*keys, F.coalesce("up2", "up").alias("up"), (F.col("dist") + F.coalesce("d2", F.lit(0))).alias("dist"), F.col("up2").isNotNull().alias("moved"))
        chains = save_stage(jumped, "chains")
        if chains.filter("moved").isEmpty():
            break
    chains = chains.filter("not moved").drop("moved")  # what still moves goes round in a cycle
    placed = save_stage(nodes.join(edges, keys, "left_anti").withColumn("level", F.lit(0)), "levels")
    several = edges.join(degree.filter("n > 1").select(*keys), keys, "left_semi")
    via = chains.select("conv_id", F.col("call_id").alias("on_id"), "up", "dist")
    lone = single.select("conv_id", F.col("call_id").alias("on_id"), F.lit(True).alias("lone"))
    several = several.join(via, ["conv_id", "on_id"], "left").join(lone, ["conv_id", "on_id"], "left")
    # a dependency in a chain stands for the chain's anchor; one in a cycle for nothing, so it is never placed
    anchor = F.when(F.col("lone") & F.col("up").isNull(), F.lit(None)).otherwise(F.coalesce("up", "on_id"))
    waiting = save_stage(several.select(*keys, anchor.alias("anchor"), (F.coalesce("dist", F.lit(0)) + 1).alias("dist")), "several")
    while not waiting.isEmpty():
        there = placed.select("conv_id", F.col("call_id").alias("anchor"), "level")
        ready = waiting.join(there, ["conv_id", "anchor"], "left").groupBy(*keys)
        ready = ready.agg(F.count(F.lit(1)).alias("n"), F.count("level").alias("got"), F.max(F.col("level") + F.col("dist")).alias("level"))
        ready = save_stage(ready.filter("n = got").select(*keys, "level"), "levels")
        if ready.isEmpty():
            break
        placed = placed.union(ready)
        waiting = save_stage(waiting.join(ready, keys, "left_anti"), "several")
    top = placed.select("conv_id", F.col("call_id").alias("up"), "level")
    return placed.union(chains.join(top, ["conv_id", "up"]).select(*keys, (F.col("level") + F.col("dist")).cast("int").alias("level")))


#: Types that a parameter can have, and what ``schema_of_variant`` calls a value of each.
TYPES = {"string": "STRING", "integer": r"(BIGINT|DECIMAL\([0-9]+,0\))", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY<.*>", "object": "OBJECT<.*>", "null": "VOID", "any": ".*"}


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Check each call's ``arguments`` (JSON text) against ``schemas``: adds ``canonical`` and ``errors`` (sorted, empty if valid).

    ``schemas`` has a row per parameter: ``name``, ``param`` (any text), ``type`` (one of :data:`TYPES`), ``required``,
    ``max_length`` (of a string; null: any), ``minimum`` (of a number; null: any) and, if the column is there, ``allowed``
    (JSON texts of the values that are permitted; null: any). Errors: ``not an object``, ``unknown tool``, ``missing <p>``,
    ``unknown <p>``, ``type of <p>``, ``length of <p>``, ``range of <p>``, ``value of <p>``. An unknown type name in the
    schemas raises ValueError. The schemas become one map per tool, joined by name.
    """
    odd = schemas.filter(~F.coalesce(F.col("type").isin(*TYPES), F.lit(False))).select("type").first()
    if odd:
        raise ValueError(f"unknown parameter type: {odd.type}")
    allowed = F.transform("allowed", canonical) if "allowed" in schemas.columns else F.lit(None).cast("array<string>")
    spec = F.struct("type", "required", F.col("max_length").cast("long").alias("max_length"), F.col("minimum").cast("double").alias("minimum"), allowed.alias("allowed"))
    tools = schemas.filter("name is not null and param is not null").dropDuplicates(["name", "param"]).groupBy("name")
    tools = tools.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("param", spec)))).alias("spec"))
    parsed = calls.join(tools, "name", "left").withColumn("canonical", canonical(F.col("arguments")))
    is_object = F.coalesce(F.substring("canonical", 1, 1) == "{", F.lit(False))
    given = F.when(is_object, F.try_parse_json("canonical").cast("map<string,variant>"))
    quoted = F.when(is_object, F.json_object_keys("canonical"))
    parsed = parsed.withColumns({"given": given, "names": F.coalesce(quoted, F.array().cast("array<string>"))})
    wanted = F.coalesce(F.map_keys("spec"), F.array().cast("array<string>"))

    def problem(p: Column) -> Column:
        s, v = F.try_element_at("spec", p), F.try_element_at("given", p)
        kind = F.schema_of_variant(v)
        right = F.coalesce(*[F.when(s["type"] == name, kind.rlike(f"^{pattern}$")) for name, pattern in TYPES.items()], F.lit(False))
        text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        number = F.when(kind.rlike(f"^{TYPES['number']}$"), F.try_variant_get(v, "$", "double"))
        return (
            F.when(~F.array_contains("names", p), F.when(s["required"], F.concat(F.lit("missing "), p)))
            .when(~right, F.concat(F.lit("type of "), p))
            .when(F.length(text) > s["max_length"], F.concat(F.lit("length of "), p))
            .when(number < s["minimum"], F.concat(F.lit("range of "), p))
            .when(~F.array_contains(s["allowed"], F.to_json(v)), F.concat(F.lit("value of "), p))
        )

    extra = F.transform(F.array_except("names", wanted), lambda p: F.concat(F.lit("unknown "), p))
    errors = (
        F.when(~is_object, F.array(F.lit("not an object"))).when(F.col("spec").isNull(), F.array(F.lit("unknown tool")))
        .otherwise(F.array_sort(F.concat(F.array_compact(F.transform(wanted, problem)), extra)))
    )
    return parsed.withColumn("errors", errors).drop("spec", "given", "names")


def link_tool_calls(calls: DataFrame, results: DataFrame, depends: DataFrame, schemas: DataFrame) -> DataFrame:
    """Link calls with their results, order them, validate them, and write each message as canonical JSON.

    ``calls``: ``conv_id``, ``call_id``, ``turn``, ``name``, ``arguments`` (JSON text). ``results``: ``conv_id``,
    ``call_id``, ``turn``, ``content``. ``depends`` as for :func:`levels`, ``schemas`` as for :func:`validate`.

    Returns a row per call and per result: ``conv_id``, ``position`` (1, 2, ... in a topological order: by level, then
    turn of the call, a result right after its call), ``turn``, ``kind`` (call or result), ``call_id``, ``level`` (-1 for
    calls on or behind a cycle, which come last; orphan results too), ``status`` (ok, invalid, no result, no call) and
    ``message`` (canonical JSON). A call without an id is dropped, and so is a result without one; of several calls (or
    results) with one id in a conversation the one of the earliest turn counts. A conversation of any size is ranked over
    many tasks.
    """
    keys = ["conv_id", "call_id"]

    def firsts(t: DataFrame, *columns: str) -> DataFrame:
        best = t.filter("conv_id is not null and call_id is not null").groupBy(*keys).agg(F.min(F.struct(F.col("turn").isNull(), "turn", *columns)).alias("r"))
        return best.select(*keys, "r.turn", *[F.col(f"r.{c}") for c in columns])

    one = validate(firsts(calls, "name", "arguments"), schemas)
    placed = levels(one, depends)
    answers = firsts(results, "content").withColumnRenamed("turn", "result_turn").withColumn("has_result", F.lit(True))
    joined = one.withColumn("has_call", F.lit(True)).join(placed, keys, "left").join(answers, keys, "full_outer")
    level = F.coalesce("level", F.lit(-1))
    status = (
        F.when(F.col("has_call").isNull(), "no call").when(F.size("errors") > 0, "invalid").when(F.col("has_result").isNull(), "no result").otherwise("ok")
    )
    call = F.concat(
        F.lit('{"arguments":'), F.coalesce("canonical", F.to_json(F.struct(F.coalesce("arguments", F.lit("")).alias("raw")))), F.lit(',"id":'), _quote("call_id"),
        F.lit(',"name":'), F.coalesce(_quote("name"), F.lit("null")), F.lit(',"type":"tool_call"}'),
    )
    result = F.concat(F.lit('{"content":'), F.coalesce(_quote("content"), F.lit("null")), F.lit(',"tool_call_id":'), _quote("call_id"), F.lit(',"type":"tool_result"}'))
    sides = F.array(
        F.when(F.col("has_call"), F.struct(F.lit("call").alias("kind"), F.col("turn").alias("turn"), call.alias("message"))),
        F.when(F.col("has_result"), F.struct(F.lit("result").alias("kind"), F.col("result_turn").alias("turn"), result.alias("message"))),
    )
    rows = joined.select(*keys, level.alias("level"), status.alias("status"), F.coalesce("turn", "result_turn").alias("anchor"), F.explode(F.array_compact(sides)).alias("m"))
    rows = rows.select("conv_id", "call_id", "level", "status", F.when(F.col("level") < 0, 2**31 - 1).otherwise(F.col("level")).alias("o"), "anchor", "m.kind", "m.turn", "m.message")
    ranked = grouped_rank(rows, ["conv_id"], ["o", "anchor", "call_id", "kind"], "position")
    return ranked.select("conv_id", "position", "turn", "kind", "call_id", "level", "status", "message")


def _quote(name: str) -> Column:
    """A string column as a JSON string; null for null."""
    whole = F.to_json(F.struct(F.col(name).alias("s")))
    return F.when(F.col(name).isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and dependencies read off a table of turns: each user turn is a call to the assistant, answered by the
    turn after it, and depends on the call before it in its conversation (two turns earlier)."""
    def name(t: Column) -> Column:
        return F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("t"), t.cast("string"))

    users = turns.filter("role = 'user' and turn is not null")
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != ""))
    arguments = F.concat(F.lit('{"query": '), F.coalesce(_quote("text"), F.lit("null")), F.lit(', "limit": '), words.cast("string"), F.lit("}"))
    tool = F.when(F.col("turn") < 2, "search").otherwise("follow_up")
    calls = users.select("conv_id", name(F.col("turn")).alias("call_id"), "turn", tool.alias("name"), arguments.alias("arguments"))
    results = turns.filter("role = 'assistant' and turn is not null").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    depends = users.select("conv_id", name(F.col("turn")).alias("call_id"), name(F.col("turn") - 2).alias("on_id"))
    return calls, results, depends


def op1_tool_call_linking(spark, sf_dir: str) -> DataFrame:
    """Calls and results of every conversation in ``conversations``, linked, ordered, validated and serialised."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    calls, results, depends = conversation_calls(turns)
    schemas = spark.sql(
        """select * from values ('search', 'query', 'string', true, 220, null), ('search', 'limit', 'integer', true, null, 1),
        ('follow_up', 'query', 'string', true, 400, null), ('follow_up', 'limit', 'integer', false, null, 5)
        as t(name, param, type, required, max_length, minimum)"""
    )
    return link_tool_calls(calls, results, depends, schemas)


ORACLE = """
with t as (select conv_id, turn, role, text from conversations where turn is not null),
c as (select conv_id, 'c' || conv_id || 't' || turn as call_id, turn, text,
  case when turn < 2 then 'search' else 'follow_up' end as name,
  len(regexp_extract_all(coalesce(text, ''), '[^ ]+')) as words from t where role = 'user'),
r as (select conv_id, 'c' || conv_id || 't' || (turn - 1) as call_id, turn, text from t where role = 'assistant'),
runs as (select conv_id, call_id, turn, turn // 2 - row_number() over (partition by conv_id, turn % 2 order by turn) as run from c),
lv as (select conv_id, call_id, row_number() over (partition by conv_id, turn % 2, run order by turn) - 1 as level from runs),
v as (select c.*, level, case when length(text) > case name when 'search' then 220 else 400 end
    or words < case name when 'search' then 1 else 5 end or text is null then 'invalid' end as bad from c join lv using (conv_id, call_id)),
j as (select coalesce(v.conv_id, r.conv_id) as conv_id, coalesce(v.call_id, r.call_id) as call_id, v.turn as turn, r.turn as result_turn, v.text as query,
  r.text as content, name, words, coalesce(level, -1) as level,
  case when v.call_id is null then 'no call' when bad is not null then bad when r.call_id is null then 'no result' else 'ok' end as status,
  v.call_id is not null as has_call, r.call_id is not null as has_result from v full join r on v.conv_id = r.conv_id and v.call_id = r.call_id),
m as (select conv_id, call_id, level, status, coalesce(turn, result_turn) as anchor, turn, 'call' as kind,
  '{"arguments":{"limit":' || words || ',"query":' || to_json(query) || '},"id":"' || call_id || '","name":"' || name || '","type":"tool_call"}' as message from j where has_call
 union all select conv_id, call_id, level, status, coalesce(turn, result_turn), result_turn, 'result',
  '{"content":' || to_json(content) || ',"tool_call_id":"' || call_id || '","type":"tool_result"}' from j where has_result)
select conv_id, row_number() over (partition by conv_id order by case when level < 0 then 2147483647 else level end, anchor, call_id, kind) as position,
  turn, kind, call_id, cast(level as integer) as level, status, message from m
"""
