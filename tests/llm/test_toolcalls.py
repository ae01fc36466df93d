import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.llm import toolcalls as C
from quillon.ranking import grouped_rank
from quillon.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_query_equals_its_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    names = ["conv_id", "position", "turn", "kind", "call_id", "level", "status", "message"]
    want = sorted(duck.execute(f"select {', '.join(names)} from ({ORACLES['op1_tool_call_linking']})").fetchall())
    assert sorted(tuple(r[n] for n in names) for r in QUERIES["op1_tool_call_linking"](spark, SF).collect()) == want


CALLS = "conv_id long, call_id string, turn int, name string, arguments string, level string"


def test_links_orders_validates(spark):
    calls = spark.createDataFrame(
        [
            (1, "b", 2, "add", '{ "y": 2, "x": 1.50 }', "q"), (1, "a", 1, "add", '{"x": 1}', "q"), (1, "c", 0, "say", '{"s":"h\\u00e9\\n\\"q\\""}', "q"), (1, "d", 4, "none", "{}", "q"),
            (1, "e", 5, "say", "[1]", "q"), (1, "f", 6, "say", '{"s":1,"z":2}', "q"), (1, "g", 7, "say", '{"s":"a","s":"b"}', "q"), (1, "h", 8, "say", None, "q"), (1, None, 9, "say", "{}", "q"),
            (1, "p", 10, "say", '{"s":"toolong"}', "q"), (1, "q1", 11, "say", '{"s":"x"}', "q"), (1, "q2", 12, "say", '{"s":"x"}', "q"), (1, "b", 3, "say", "{}", "q"), (2, "a", 1, "add", '{"x":-1,"y":0}', "q"),
        ],
        CALLS,
    )
    results = spark.createDataFrame([(1, "a", 3, "one"), (1, "zz", 9, "orphan"), (1, None, 9, "x"), (1, "c", 2, None)], "conv_id long, call_id string, turn int, content string")
    depends = spark.createDataFrame([(1, "c", "b"), (1, "b", "a"), (1, "a", "unknown"), (1, "q1", "q2"), (1, "q2", "q1")], "conv_id long, call_id string, on_id string")
    schemas = spark.createDataFrame([("add", "x", "number", True, None, 0.0), ("add", "y", "integer", True, None, None), ("say", "s", "string", True, 6, None)], "name string, param string, type string, required boolean, max_length int, minimum double")
    out = C.link_tool_calls(calls, results, depends, schemas).collect()
    by = {(r.conv_id, r.call_id, r.kind): r for r in out}
    assert [r.position for r in sorted((r for r in out if r.conv_id == 1), key=lambda r: r.position)] == list(range(1, sum(r.conv_id == 1 for r in out) + 1))
    level = {k: by[1, k, "call"].level for k in "abc"}
    assert level == {"a": 0, "b": 1, "c": 2} and by[1, "q1", "call"].level == -1
    assert by[1, "a", "result"].position == by[1, "a", "call"].position + 1
    assert by[1, "b", "call"].message == '{"arguments":{"x":1.5,"y":2},"id":"b","name":"add","type":"tool_call"}'
    assert by[1, "c", "call"].message == '{"arguments":{"s":"hé\\n\\"q\\""},"id":"c","name":"say","type":"tool_call"}'
    assert by[1, "c", "result"].message == '{"content":null,"tool_call_id":"c","type":"tool_result"}'
    status = {k[1]: r.status for k, r in by.items() if k[0] == 1}
    assert status["b"] == "no result" and status["c"] == "ok" and status["zz"] == "no call" and {status[k] for k in "adefghp"} == {"invalid"}
    assert by[2, "a", "call"].status == "invalid"
    assert C.link_tool_calls(calls.filter("false"), results.filter("false"), depends, schemas).count() == 0


def test_errors_are_named(spark):
    calls = spark.createDataFrame([(1, "a", 1, "say", '{"s":1,"z":2}', ""), (1, "b", 1, "say", "{}", ""), (1, "c", 1, "say", '{"s":"toolong"}', ""), (1, "d", 1, "say", "nope", "")], CALLS)
    schemas = spark.createDataFrame([("say", "s", "string", True, 5, None)], "name string, param string, type string, required boolean, max_length int, minimum double")
    got = {r.call_id: r.errors for r in C.validate(calls, schemas).collect()}
    assert got == {"a": ["type of s", "unknown z"], "b": ["missing s"], "c": ["length of s"], "d": ["not an object"]}


def test_ranks_do_not_depend_on_partitions(spark):
    rng = random.Random(0)
    rows = [(None if rng.random() < 0.1 else rng.choice([1, 1, 1, 2, 3]), i, rng.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, i long, v double")
    want = {}
    for g in {r[0] for r in rows}:
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1]), 1):
            want[r[1]] = k
    for n in (1, 7):
        assert {r.i: r.place for r in grouped_rank(df.repartition(n), ["g"], ["i"], "place").collect()} == want


def test_levels_of_chains_joins_and_cycles(spark):
    n = 60
    calls = [(1, f"c{i}") for i in range(n)] + [(1, x) for x in "xyzuvw"] + [(2, "c0")]
    depends = [(1, f"c{i}", f"c{i - 1}") for i in range(1, n)]
    depends += [(1, "x", "c5"), (1, "x", "c9"), (1, "y", "x"), (1, "z", "y"), (1, "z", "c59"), (1, "u", "v"), (1, "v", "u"), (1, "w", "u"), (1, "w", "c0")]
    got = {(r.conv_id, r.call_id): r.level for r in C.levels(spark.createDataFrame(calls, "conv_id long, call_id string"), spark.createDataFrame(depends, "conv_id long, call_id string, on_id string")).collect()}
    assert got == {**{(1, f"c{i}"): i for i in range(n)}, (1, "x"): 10, (1, "y"): 11, (1, "z"): 60, (2, "c0"): 0}


def test_names_with_quotes_and_nested_types(spark):
    given = [
        """{"it's":1,"a.b[0]":{"x":1},"say \\"q\\"":[1,"two"],"e":"red"}""", """{"it's":"1","a.b[0]":[],"say \\"q\\"":{},"e":"pink"}""", """{"it's":5,"a.b[0]":5,"n":null,"e":{"b":1,"a":2}}""", '{"it\'s":-1,"any":[[]],"n":0}',
    ]
    calls = spark.createDataFrame([(1, c, 1, "t", a, "") for c, a in zip("abcd", given, strict=True)], CALLS)
    names = "name string, param string, type string, required boolean, max_length int, minimum double, allowed array<string>"
    rows = [("t", "it's", "integer", True, None, 0.0, None), ("t", "a.b[0]", "object", False, None, None, None), ("t", 'say "q"', "array", False, None, None, None)]
    rows += [("t", "e", "any", False, None, None, ['"red"', '{ "a": 2, "b": 1 }']), ("t", "n", "null", False, None, None, None), ("t", "any", "any", False, None, None, None)]
    got = {r.call_id: r.errors for r in C.validate(calls, spark.createDataFrame(rows, names)).collect()}
    assert got == {"a": [], "b": ["type of a.b[0]", "type of it's", 'type of say "q"', "value of e"], "c": ["type of a.b[0]"], "d": ["range of it's", "type of n"]}
    with pytest.raises(ValueError, match="text"):
        C.validate(calls, spark.createDataFrame([("t", "p", "text", True, None, None)], names.removesuffix(", allowed array<string>")))


@pytest.mark.parametrize(
    "text, want",
    [
        ("1e2", "100"), ("100.0", "100"), ("100", "100"), ("-0", "0"), ("-0.0", "0"), ("1.50", "1.5"), ("12e-3", "0.012"), ("1E+2", "100"), ("0e999999999999", "0"), ("123.4500e1", "1234.5"),
        ("1e400", None), ("1e-40", None), ("9" * 38, "9" * 38), ("1" * 39, None), ("12345678901234567890123456789012345678901234", None), ("0." + "0" * 37 + "1", "0." + "0" * 37 + "1"),
        ("01", None), ("1e", None), ("[1e1, -2.50E0]", "[10,-2.5]"), ('{"b": 1e1, "a": "1e1 \\\\"}', '{"a":"1e1 \\\\","b":10}'), ('"1e5"', '"1e5"'), ("1e5x", None), ("-1e1", "-10"),
    ],
)
def test_numbers_have_one_exact_form(spark, text, want):
    assert spark.createDataFrame([(text,)], "j string").select(C.canonical(F.col("j"))).first()[0] == want


def test_very_long_strings_beside_exponents(spark):
    text = '{"s": "' + 'a\\"\\\\1e2' * 200_000 + '", "n": 1e2}'
    got = spark.createDataFrame([(text,)], "j string").select(C.canonical(F.col("j"))).first()[0]
    assert got.startswith('{"n":100,"s":"a') and len(got) == len(text) - 3
