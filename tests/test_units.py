"""Small hand-written cases: ties, nulls, empty inputs, documented quirks."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quillon import runtime
from quillon.functions import prompts as P
from quillon.functions import text as X
from quillon.functions.geo import haversine
from quillon.operators import clean as C
from quillon.operators import enrich as N
from quillon.operators import cells as V
from quillon.operators import evaluate as E
from quillon.operators import geo as G
from quillon.operators import index as I
from quillon.operators import search as S
from quillon.operators import tags as T
from quillon.operators import usage as U
from quillon.operators import segments as D
from quillon.operators.segments import near_collapse
from quillon.plans import recommend as R
from quillon import ranking
from quillon.ranking import greatest_rows, grouped_rank, grouped_sum
from quillon.sources import jsonlines as J
from quillon.sources import results as Q
from quillon.sources import store as M
from quillon.streaming.enrich_stream import stream_enrich


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_snippet_marks_the_first_query_token_in_query_order(spark):
    df = spark.createDataFrame([("a" * 150 + " Bar none", ["none", "bar"]), ("plain", ["zzz"]), ("x" * 300, ["zzz"]), (None, ["a"])], "text string, q array<string>")
    hit = X.first_hit(F.col("text"), F.col("q"))
    got = df.select(hit.alias("hit"), X.snippet(F.col("text"), hit).alias("s")).collect()
    assert got[0].hit == "none" and got[0].s.endswith("Bar **none**") and got[0].s.startswith("…")
    assert got[1].hit is None and got[1].s == "plain"
    assert got[2].s == "x" * 200 + "…"
    assert got[3].s is None


@pytest.mark.parametrize("raw, clean", [("- fish", "fish"), ("1. 'old town'", "old town"), ("* x\nsecond", "x"), ("   ", ""), (None, ""), ('"q"', "q")])
def test_clean_keyword(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "k string").select(X.clean_keyword(F.col("k"))).first()[0] == clean


def test_aspect_list_keeps_order_and_repeats(spark):
    assert spark.createDataFrame([(" b, a ,,b",)], "t string").select(X.aspect_list(F.col("t"))).first()[0] == ["b", "a", "b"]


def test_search_ranks_reviews_without_a_term_and_cuts_before_filters(spark):
    r = spark.createDataFrame([(3, 1, "fish and chips"), (1, 1, "tea"), (2, 2, None), (4, 2, "selfish")], "review_id long, item_id long, text string")
    q = spark.createDataFrame([(1, "fish")], "query_id int, query string")
    r = r.union(spark.createDataFrame([(0, 2, "no hit"), (5, 1, "fish"), (9, 1, "jellyfish"), (8, 1, "b"), (7, 1, "c"), (6, 1, "d")], r.schema))
    everything = S.search_reviews(r, q).collect()
    # 5 and 3 have the token; the others come by id: 0, 1, 2, 4, 6, 7, 8, 9
    assert [(h.review_id, h["rank"]) for h in sorted(everything, key=lambda h: h["rank"])] == [(5, 1), (3, 2), (4, 6), (9, 10)]
    assert [(h.review_id, h["rank"]) for h in S.search_reviews(r, q, item_id=2).collect()] == [(4, 6)]
    r = r.filter("review_id in (1, 2, 3, 4)")
    every = S.search_reviews(r, q).collect()
    assert [(h.review_id, h["rank"]) for h in sorted(every, key=lambda h: h["rank"])] == [(3, 1), (4, 4)]
    assert S.search_reviews(r, q, topk=2).count() == 1
    assert S.search_reviews(r.filter("false"), q).count() == 0
    assert S.search_reviews(r, q.filter("false")).count() == 0


def test_partitions_do_not_change_scores(spark):
    r = spark.createDataFrame([(i, i % 3, f"w{i % 7} w{i % 5} common") for i in range(60)], "review_id long, item_id long, text string")
    q = spark.createDataFrame([(1, "w3 common w3")], "query_id int, query string")
    one = {(x.review_id, round(x.score, 9)) for x in S.bm25_scores(r.repartition(1), q).collect()}
    assert one == {(x.review_id, round(x.score, 9)) for x in S.bm25_scores(r.repartition(7), q).collect()}


def test_core_prune_is_not_run_to_a_fixpoint(spark):
    edges = [(u, i) for u in range(4) for i in range(4) if u + i < 5]
    e = spark.createDataFrame(edges, "user_id long, item_id long")
    u, i = e.select("user_id").distinct(), e.select("item_id").distinct()
    one = C.core_prune(e, u, i, 3, 3, passes=1)[0].count()
    two = C.core_prune(e, u, i, 3, 3, passes=2)[0].count()
    assert one > two or one == two
    assert C.core_prune(e, u, i, 1, 1)[0].count() == len(edges)


def test_friends_accept_a_string(spark):
    u = spark.createDataFrame([("a", "b, c"), ("b", None), ("c", "a")], "user_id string, friends string")
    assert rows(C.friends_existing(u)) == [("a", ["b", "c"]), ("b", []), ("c", ["a"])]


def test_rate_lookup_takes_the_longest_prefix_or_the_card_order(spark):
    m = spark.createDataFrame([("gpt-5-mini-2025",), ("GPT-4O",), ("other",)], "model string")
    card = U.rate_card(spark)
    assert {r.model: r.key for r in U.rate_lookup(m, card).collect()} == {"gpt-5-mini-2025": "gpt-5-mini", "GPT-4O": "gpt-4o", "other": None}
    assert {r.model: r.key for r in U.rate_lookup(m, card, "card_order").collect()}["gpt-5-mini-2025"] == "gpt-5"


def test_verdict_first_and_any(spark):
    j = spark.createDataFrame([("a", 1, 1, True, False), ("a", 1, 2, True, True), ("a", 2, 1, False, True)], "aspect string, item_id long, rank int, is_conclusive boolean, is_positive boolean")
    assert rows(R.verdict_agg(j)) == [("a", 1, True, False), ("a", 2, False, False)]
    assert rows(R.verdict_agg(j, "any")) == [("a", 1, True, True), ("a", 2, False, False)]


def test_verdicts_read_what_was_judged_once(spark):
    schema = "aspect string, item_id long, rank int, is_conclusive boolean, is_positive boolean"
    j = runtime.save_stage(spark.createDataFrame([("a", 1, 1, None, True), ("a", 1, 2, False, True), ("a", 2, 1, True, None), ("a", 2, 2, True, True), ("a", 3, 2, True, False), ("a", 3, 1, True, True)], schema), "judged")
    for verdict, second in (("first", False), ("any", True)):
        v = R.verdict_agg(j, verdict)
        assert v._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
        assert rows(v) == [("a", 1, False, False), ("a", 2, second, second), ("a", 3, True, True)]


def test_evidence_is_found_in_one_search(spark, monkeypatch):
    import quillon.registry  # noqa: F401
    from quillon.queries import recommendation as Q2

    monkeypatch.setattr(Q2, "aspect_hits", lambda s, d: s.range(4).selectExpr("'the' as aspect", "id % 2 as item_id", "id as review_id", "id as rank", "monotonically_increasing_id() as extra"))
    plan = Q2._evidence(spark, "")[2]._jdf.queryExecution().analyzed().toString()
    assert "monotonically_increasing_id" not in plan and "Range" not in plan


def test_no_aspects_no_items(spark):
    p = spark.createDataFrame([("a", 1)], "aspect string, item_id long")
    assert R.aspect_intersection(p, spark.createDataFrame([], "query_id int, aspect string")).count() == 0


def test_validation_reasons(spark):
    j = spark.createDataFrame([(1, '{"tags":[{"name":"ok","sentiment":"positive","evidence":"e","confidence":1},{"name":"Bad","sentiment":"positive","evidence":"e","confidence":1}]}'), (2, "{"), (3, None), (4, '{"tags":[]}')], "id int, payload string")
    assert sorted((r.id, r.reason or "") for r in N.validate_tags(j).collect()) == [(1, ""), (1, "name"), (2, "unparseable"), (3, "unparseable")]


def test_upsert_keeps_or_overwrites(spark):
    s = "task string, key long, tag string, version int, payload string"
    old, new = spark.createDataFrame([("t", 1, "v", 1, "a")], s), spark.createDataFrame([("t", 1, "v", 2, "b"), ("t", 2, "v", 2, "c")], s)
    assert [r[4] for r in rows(N.upsert(old, new))] == ["b", "c"]
    assert [r[4] for r in rows(N.upsert(old, new, overwrite=False))] == ["a", "c"]


def test_responses_are_aligned_and_bad_lines_set_aside(spark):
    good = '{"custom_id":"prompt-1","response":{"status_code":200,"body":{"choices":[{"message":{"content":"hi"}}],"usage":{"prompt_tokens":3}}}}'
    lines = spark.createDataFrame([(good,), ("",), ("nonsense",), ('{"custom_id":"prompt-2","response":{"status_code":500}}',)], "value string")
    parsed, bad = J.parse_responses(lines)
    assert rows(parsed) == [("prompt-1", "hi", 3, 0), ("prompt-2", "", 0, 0)] and bad.count() == 1
    p = spark.createDataFrame([(0,), (1,), (2,)], "i long")
    assert rows(J.align_outputs(p, parsed)) == [(0, None), (1, "hi"), (2, "")]


def test_geometric_median_and_distances(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 2.0), (1, 0.0, 1.0), (2, 5.0, 5.0), (2, 5.0, 5.0)], "u int, lat double, lon double")
    got = {r.u: (round(r.center_lat, 5), round(r.center_lon, 5)) for r in G.geometric_median(p, "u").collect()}
    assert got == {1: (0.0, 1.0), 2: (5.0, 5.0)}
    loc = G.user_location(p, "u", least=2).filter("u = 2").first()
    assert loc.lambda_per_km is None
    km = spark.range(1).select(haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()[0]
    assert math.isclose(km, math.pi * 6371.0088, rel_tol=1e-9)


def test_radius_join_equals_the_filtered_product(spark):
    c = spark.createDataFrame([(i, 38 + i * 0.07, -90 + i * 0.05) for i in range(20)], "u long, center_lat double, center_lon double")
    i = spark.createDataFrame([(k, 38 + k * 0.03, -90 + (k * 7 % 30) * 0.05) for k in range(40)], "item_id long, latitude double, longitude double")
    near = {(r.u, r.item_id) for r in G.distance_pairs(c, i, 15.0).collect()}
    assert near == {(r.u, r.item_id) for r in G.distance_pairs(c, i).filter("km <= 15").collect()} and near


def test_ranking_measures(spark):
    ranked = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "query_id int, rank int, item_id long")
    gold = spark.createDataFrame([(1, 11, 1.0), (1, 12, 1.0)], "query_id int, item_id long, gain double")
    assert E.precision_at_k(ranked, gold, 2).first().precision == 0.5
    assert E.recall_at_k(ranked, gold, 2).first().recall == 0.5
    assert math.isclose(E.ndcg_at_k(ranked, gold, 2).first().ndcg, (1 / math.log2(3)) / (1 + 1 / math.log2(3)))


def test_top_decile_keeps_one_and_none_without_tags(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "tag long, embedding array<double>")
    a = spark.createDataFrame([("x", [1.0, 0.1])], "aspect string, vector array<double>")
    used = spark.createDataFrame([(1, 5, 7), (2, 6, 8)], "tag long, review_id long, item_id long")
    assert [r.tag for r in T.top_decile_tags(a, v, used).collect()] == [1]
    assert T.top_decile_tags(a, v, used.filter("false")).count() == 0


def test_judging_in_rounds_stops_at_the_first_conclusion(spark):
    hits = spark.createDataFrame([("a", 1, 10, 1), ("a", 1, 11, 2), ("a", 1, 12, 3)], "aspect string, item_id long, review_id long, rank int")
    judged = R.judge_in_rounds(hits, lambda h: h.withColumn("is_conclusive", F.col("review_id") >= 11).withColumn("is_positive", F.lit(True)))
    assert sorted(r.review_id for r in judged.collect()) == [10, 11]


def test_judging_goes_on_to_the_last_hit_in_few_rounds(spark):
    hits = spark.range(1, 1101).selectExpr("'a' as aspect", "1L as item_id", "id as review_id", "int(id) as rank")
    calls = []

    def judge(h):
        calls.append(1)
        assert len(calls) <= 12
        return h.withColumn("is_conclusive", F.col("review_id") == 1100).withColumn("is_positive", F.lit(True))

    judged = R.judge_in_rounds(hits, judge)
    assert judged.count() == judged.select("review_id").distinct().count() == 1100
    assert rows(R.verdict_agg(judged)) == [("a", 1, True, True)]


def test_every_item_enters_the_diverse_choice(spark):
    s = spark.createDataFrame([(1, i, 1.0 - i / 1000) for i in range(60)], "query_id int, item_id long, score double")
    tags = spark.createDataFrame([(i, t) for i in range(59) for t in range(3)] + [(59, 9)], "item_id long, tag int")
    got = [(r.place, r.item_id, round(r.score, 6)) for r in E.diverse_topk(s, tags).orderBy("place").collect()]
    assert got == [(1, 0, 1.0), (2, 59, 0.941), (3, 1, 0.699)]


def test_an_index_reads_texts_once_and_postings_by_term(spark, tmp_path):
    r = spark.createDataFrame([(i, i % 3, f"w{i % 7} w{i % 5} common") for i in range(60)], "review_id long, item_id long, text string")
    q = spark.createDataFrame([(1, "w3 common w3")], "query_id int, query string")
    index = S.build_index(r, str(tmp_path / "i"))
    want = {(x.review_id, round(x.score, 9)) for x in S.bm25_scores(r, q).collect()}
    again = S.build_index(r.filter("false"), str(tmp_path / "i"))  # what is stored is read, not made again
    assert {(x.review_id, round(x.score, 9)) for x in S.bm25_scores(again, q).collect()} == want
    plan = S.bm25_scores(index, q)._jdf.queryExecution().toString()
    assert "regexp_extract_all(lower(text" not in plan.split("== Physical Plan ==")[1] and "term IN (w3,common)" in plan or "In(term" in plan
    assert S.item_search(index, r.selectExpr("item_id", "'n' as name", "1.0 as stars").distinct(), q).count() == 3


def test_running_sums_do_not_depend_on_partitions(spark):
    rows = [(None if i % 11 == 0 else i % 3 if i % 2 else 0, i, i * 7 % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "g long, i long, v long")
    want, total = {}, {}
    for g, i, v in sorted(rows, key=lambda r: -r[1]):
        want[i] = total[g] = total.get(g, 0) + v
    for n in (1, 7):
        assert {r.i: r.s for r in grouped_sum(df.repartition(n), ["g"], [F.desc("i")], F.col("v"), "s").collect()} == want
    assert sorted(r.place for r in grouped_rank(df, [], ["i"], "place").collect()) == list(range(1, 301))
    assert grouped_rank(df.filter("false"), ["g"], ["i"], "place").count() == 0


def test_half_written_tables_are_built_again(spark, tmp_path):
    path, made = str(tmp_path / "t"), []

    def build():
        made.append(1)
        return spark.range(3)

    spark.range(99).write.parquet(f"{path}/data-cut")  # a run that was cut off before its name was published
    assert M.materialize(spark, path, build).count() == 3
    assert M.materialize(spark, path, build).count() == 3 and len(made) == 1
    assert M.materialize(spark, str(tmp_path / "e"), lambda: spark.range(0)).count() == 0
    assert M.materialize(spark, str(tmp_path / "e"), build).count() == 0
    with pytest.raises(ValueError):
        M.materialize(spark, str(tmp_path / "f"), lambda: (_ for _ in ()).throw(ValueError()))
    assert M.materialize(spark, str(tmp_path / "f"), build).count() == 3


def test_a_broadcast_side_is_measured_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 1000)
    few = spark.createDataFrame([("x" * 600,), ("y" * 600,)], "t string")

    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    assert not hinted(runtime.small(few, 2)) and hinted(runtime.small(few.limit(1), 1)) and hinted(runtime.small(few.selectExpr("1 as a"), 2))
    assert not hinted(runtime.small(few.selectExpr("1 as a"), 10**9))


class Arrivals:
    """Files that arrive one after another; what the index holds is what the stream returned last."""

    def __init__(self, spark, folder):
        self.spark, self.source, self.target, self.index, self.sent = spark, folder / "in", str(folder / "index"), None, []

    def arrive(self, name, rows):
        df = self.spark.createDataFrame(rows, "review_id long, item_id long, text string, at string").withColumn("ts", F.expr("cast(at as timestamp)")).drop("at")
        df.coalesce(1).write.parquet(str(self.source / name))
        self.sent += rows

    def run(self, **more):
        self.index = stream_enrich(self.spark, str(self.source / "*"), self.target, **more)

    def postings(self):
        found = self.index.blocks.select("term", F.explode("found").alias("f")).select("f.review_id", "term", "f.tf")
        return sorted((r.review_id, r.term, r.tf) for r in found.collect())


def test_the_stream_goes_on_where_it_stopped(spark, tmp_path):
    day = "2020-01-01"
    s = Arrivals(spark, tmp_path)
    s.arrive("a", [(1, 1, "tea tea", day), (2, 1, "cake", day)])
    s.arrive("b", [(1, 1, "tea tea", day), (3, 2, "", day)])
    s.run(max_files=1)
    first = [(1, "tea", 2), (2, "cake", 1)]
    assert s.postings() == first and s.index.n_reviews == 3
    s.run()  # nothing new
    assert s.postings() == first
    for f in (s.source / "a").iterdir():
        f.unlink()  # pruned: what was read from it stays
    s.arrive("c", [(2, 1, "cake", day), (4, 2, "pie", day)])
    s.run(max_files=5)
    assert s.postings() == [*first, (4, "pie", 1)]


def test_a_stream_is_searched_like_an_index_of_all_its_reviews(spark, tmp_path):
    """Late, repeated and timeless reviews count once; after every batch scores equal those of an index made at once."""
    q = spark.createDataFrame([(1, "tea the cake"), (2, "scone")], "query_id int, query string")
    s = Arrivals(spark, tmp_path)
    made = []

    def tag(rows):
        made.extend(r.review_id for r in rows.collect())
        return rows.select(F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("tag"), "review_id", "item_id")

    batches = [
        [(1, 1, "the tea the", "2020-06-01"), (2, 1, "cake", None)],
        [(3, 2, "the scone", "2020-01-01"), (1, 9, "another text", "2020-07-01"), (2, 1, "cake", None), (None, 1, "no id", None)],
        [(4, 2, None, "2019-01-01"), (5, 2, "tea cake the the", None), (5, 2, "tea", "2018-01-01"), (3, 2, "the scone", "2030-01-01")],
        [(4, 2, "late", None)] + [(i, 1, f"the w{i}", None) for i in range(10, 22)],
    ]
    kept = {}
    for k, rows in enumerate(batches):
        s.arrive(f"b{k}", rows)
        s.run(fold=k != 1, tag_model=tag)
        for i, item, text, at in sorted((r for r in rows if r[0]), key=lambda r: (r[3] is None, r[3] or "")):
            kept.setdefault(i, (i, item, text))
        everything = spark.createDataFrame(list(kept.values()), "review_id long, item_id long, text string")
        for look in (S.bm25_scores,) if k < 3 else (lambda r, w: S.search_reviews(r, w, topk=4),):
            got, want = ({tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in look(x, q).collect()} for x in (s.index, everything))
            assert got == want
    assert s.index.n_reviews == len(kept) and len(s.index.segments) < 4
    assert len(made) == len(set(made)) == len(kept)
    assert {(r.tag, r.review_id) for r in s.index.tags.collect()} == {(w, i) for i, _, t in kept.values() for w in (t or "").split(" ")}


def test_what_was_cut_off_is_not_seen(spark, tmp_path, monkeypatch):
    """A crash between writing a segment and naming it: readers see the version before, and the batch adds it again."""
    path = str(tmp_path / "i")
    rows = spark.createDataFrame([(1, 1, "tea", None)], "review_id long, item_id long, text string, ts timestamp")
    more = spark.createDataFrame([(1, 1, "tea", None), (2, 1, "tea cake", None)], rows.schema)
    assert I.append_reviews(rows, path) == 1
    before = I.open_index(spark, path)
    with monkeypatch.context() as m:
        m.setattr(I, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("cut off")))
        with pytest.raises(RuntimeError):
            I.append_reviews(more, path)
    assert I.open_index(spark, path).n_reviews == 1
    assert I.append_reviews(more, path) == 1 and I.append_reviews(more, path) == 0
    assert I.open_index(spark, path).n_reviews == 2
    assert I.fold_segments(spark, path) and not I.fold_segments(spark, path)
    old = I.open_index(spark, path, version=before.version)
    assert [r.review_id for r in before.reviews.collect()] == [r.review_id for r in old.reviews.collect()] == [1]
    assert I.open_index(spark, str(tmp_path / "none")).n_reviews == 0


def test_blocks_that_cannot_win_are_not_read(spark, tmp_path):
    """Same best reviews as by full scores, ties included, from under a third of the postings of frequent terms."""
    r = spark.range(20_000).select(
        F.col("id").alias("review_id"), (F.col("id") % 7).alias("item_id"),
        F.expr("concat_ws(' ', 'common', concat('w', id), case when id % 3 = 0 then 'often' end, repeat('pad ', cast(id % 200 as int)), case when id % 5999 = 0 then 'rare rare' end)").alias("text"),
    )
    index = S.build_index(r, str(tmp_path / "i"))
    q = spark.createDataFrame([(1, "often common"), (3, "absent"), (4, "often often pad rare")], "query_id int, query string")
    want = {}
    for x in S.bm25_scores(index, q).collect():
        want.setdefault(x.query_id, []).append((-round(x.score, 9), x.review_id))
    for k in (1, 8):
        report, tops = {}, {}
        for x in S.top_scores(index, q, k, report=report).collect():
            tops.setdefault(x.query_id, []).append((-round(x.score, 9), x.review_id))
        assert {i: sorted(v)[:k] for i, v in tops.items()} == {i: sorted(v)[:k] for i, v in want.items()}
        assert 0 < report["read"] < report["all"] / 3


@pytest.mark.parametrize("limit", [1000, 1])
def test_hits_come_from_terms(spark, monkeypatch, limit):
    """Substring hits of tokens and phrases equal those read off the texts; no plan pairs texts with queries."""
    monkeypatch.setattr(I, "LISTED_TERMS", limit)
    texts = ["Tea-time at the bar", "barely a Tea", None, "", "crème brûlée 𝔘𝔫𝔦", "ab", "teatime", "x" * 30_000 + "tea", "the tea time", "a_b barbar"]
    r = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], "review_id long, item_id long, text string")
    index = S.build_index(r, runtime.shared_path(spark, "hits"))
    asked = ["tea bar", "e", "brû 𝔫", "ab", "zz", "", "TEA_", "a_b", "ime"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    found = S.hit_scores(index, q)
    import regex

    want = {(k, i, first) for k, a in enumerate(asked) for i, t in enumerate(texts) for first in [[p for p, w in enumerate(regex.findall(r"[\p{L}\p{N}_]+", a.lower())) if w in (t or "").lower()][:1]] if first for first in first}
    assert {(x.query_id, x.review_id, x.place) for x in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    phrases = ["tea", "tea time", "-t", "e at", " ", "the tea time", "Tea", "", None, "𝔫", "ea time", "a tea", "bar b"]
    got = {(x.phrase, x.review_id) for x in S.phrase_hits(index, spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect()}
    assert got == {(p, i) for p in phrases if p for i, t in enumerate(texts) if p in (t or "").lower()}


@pytest.mark.parametrize("few", [32, 1])
def test_parts_of_many_terms_do_not_shuffle_the_postings(spark, monkeypatch, tmp_path, few):
    """Terms too many for a broadcast are told where postings are read; only many parts in many terms shuffle them; same hits either way."""
    r = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(["often of off", "roof the loft", "of of", "bathe", "nothing", None, "The the of"])], "review_id long, item_id long, text string")
    index = I.build_index(r, str(tmp_path / "i"))
    q = spark.createDataFrame([(1, "of the of"), (2, "f"), (3, "of off"), (4, "zz")], "query_id int, query string")
    phrases = spark.createDataFrame([("of",), ("the",), ("of of",)], "phrase string")
    want = rows(S.hit_scores(index, q).withColumn("score", F.round("score", 9)))
    assert [x[:2] for x in want] == [*((1, i) for i in (0, 1, 2, 3, 6)), *((k, i) for k in (2, 3) for i in (0, 1, 2, 6))]
    texts = [("of", 0), ("of", 1), ("of", 2), ("of", 6), ("of of", 0), ("of of", 2), ("the", 1), ("the", 3), ("the", 6)]
    monkeypatch.setattr(I, "FEW_PARTS", few)
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 300)  # the parts fit, their terms do not
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = S.hit_scores(index, q)
        assert ("hashpartitioning(term" in found._jdf.queryExecution().executedPlan().toString()) == (few == 1)
        assert rows(found.withColumn("score", F.round("score", 9))) == want
        assert rows(S.phrase_hits(index, phrases)) == texts
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_request_lines_by_kind_of_reply(spark):
    rows = [(1, "gpt-5-x", True, None), (2, "m", True, '{"name":"n","schema":{"type":"object"}}'), (3, "m", False, "{}"), (4, "m", None, None)]
    p = spark.createDataFrame(rows, "i long, model string, use_json boolean, schema string").withColumn("messages", P.tag_messages(F.lit("hi")))
    got = {r.i: json.loads(r.value)["body"] for r in J.export_requests(p).collect()}
    assert got[1]["response_format"] == {"type": "json_object"} and "temperature" not in got[1]
    assert got[2]["response_format"] == {"type": "json_schema", "json_schema": {"name": "n", "schema": {"type": "object"}}} and got[2]["temperature"] == 0.1
    assert "response_format" not in got[3] and "response_format" not in got[4]
    shown = got[3]["messages"]
    assert [m["role"] for m in shown] == ["system", *["user", "assistant"] * len(P.TAG_SHOTS), "user"] and shown[-1]["content"] == "hi"
    texts = spark.createDataFrame([(1, "m", "a text"), (2, "m", None)], "i long, model string, messages string")
    assert [json.loads(r.value)["body"]["messages"] for r in J.export_requests(texts).orderBy("i").collect()] == [[{"role": "user", "content": t}] for t in ("a text", "")]


def test_worked_examples_keep_their_own_contract(spark):
    shots = spark.createDataFrame([(i, said, reply) for i, (said, reply) in enumerate(P.TAG_SHOTS)], "review_id long, text string, payload string")
    tags = N.validate_tags(shots.select("review_id", "payload"))
    assert tags.count() == 5 and tags.filter("reason is not null").isEmpty()
    assert N.evidence_grounding(tags, shots).filter("not grounded").isEmpty()
    assert all(json.loads(reply)["aspects"] for _, reply in P.DECOMPOSE_SHOTS)


def test_scores_are_stored_by_review_and_aspect_or_by_request_too(spark):
    evidence = spark.createDataFrame([(1, "quiet", 5, 10), (2, "quiet", 5, 10), (2, "quiet", 5, 10), (1, "odd", 5, 11), (1, None, 5, 12), (1, "bad", 6, None)], "query_id int, aspect string, item_id long, review_id long")
    asked = []

    def model(units):
        asked.append(rows(units))
        reply = F.when(F.col("aspect") == "odd", F.lit('{"score": 7}')).otherwise(F.lit('{"score": 0.75, "explanation": "e", "evidence": ""}'))
        return units.withColumn("payload", reply)

    store = Q.ResultStore(spark, runtime.shared_path(spark, "scores"))
    for scoped, first in ((False, [("odd", 11), ("quiet", 10)]), (True, [(1, "odd", 11), (1, "quiet", 10), (2, "quiet", 10)])):
        asked.clear()
        for _ in range(2):
            found, store = N.stored_scores(evidence, store, model, scoped)
            assert sorted((r.query_id, r.aspect or "", r.score) for r in found.collect()) == [(1, "", None), (1, "bad", None), (1, "odd", None), (1, "quiet", 0.75), (2, "quiet", 0.75), (2, "quiet", 0.75)]
        assert asked == [first, [u for u in first if "odd" in u]]
    other = N.stored_scores(evidence, store, lambda u: u.withColumn("payload", F.lit(None).cast("string")), city="elsewhere")[0]
    assert other.filter("score is not null").isEmpty()
    assert N.stored_scores(evidence.limit(0), store, model)[0].isEmpty()


def test_prompts_name_what_they_ask(spark):
    a = spark.createDataFrame([("x", "ontological", [("k", "high", "good")])], "t string, kind string, b array<struct<keyword:string,importance:string,performance:string>>")
    t, none = F.col("t"), F.lit(None).cast("string")
    row = a.select(
        P.judge_messages(t, F.col("kind"), t, none).alias("judge"), P.judge_messages(t, none, t, t).alias("odd"), P.info_messages(t, t).alias("info"),
        P.decompose_messages(t).alias("parts"), P.request_messages(F.col("b")).alias("request"), P.keyword_messages(t).alias("keyword"),
    ).first()
    assert row.judge[0].content.startswith(P.JUDGE["ontological"]) and row.judge[1].content == "Review of the place:\n\n\nWhat to look for: x\n\nBecause of the request: x"
    assert row.odd[0].content.startswith(P.JUDGE["functional"]) and [m.role for m in row.info] == ["system", "user", "user"]
    assert row.request[1].content == "- k (importance high, performance good)" and row.parts[0].content == P.DECOMPOSE and row.parts[-1].content == "x" and row.keyword[1].content == "x"
    assert all(json.loads(s)["schema"]["type"] == "object" for s in P.SCHEMAS.values())


def test_aspect_infos_ask_once_and_pass_over_bad_replies(spark):
    a = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (2, 0, "a"), (2, 1, "c")], "query_id int, pos int, aspect string")
    good = '{"aspect_type":"functional","starter_keywords":["x","y","z"]}'
    stored = spark.createDataFrame([(1, "a", good)], "query_id int, aspect string, payload string")
    asked = []

    def model(rows):
        asked.extend(sorted((r.query_id, r.aspect) for r in rows.collect()))
        return rows.withColumn("payload", F.when(F.col("aspect") == "b", "{").when(F.col("aspect") == "c", '{"aspect_type":"odd","starter_keywords":["x","y","z"]}').otherwise(good))

    got = {(r.query_id, r.pos): (r.aspect_type, r.starter_keywords) for r in R.aspect_infos(a, stored, model).collect()}
    assert asked == [(1, "b"), (2, "a"), (2, "c")]
    assert got == {(1, 0): ("functional", ["a", "x", "y", "z"]), (1, 1): (None, ["b"]), (1, 2): ("functional", ["a", "x", "y", "z"]), (2, 0): ("functional", ["a", "x", "y", "z"]), (2, 1): (None, ["c"])}


def test_stored_tags_and_vectors_are_not_made_again(spark):
    reviews = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "review_id long, item_id long")
    tags = spark.createDataFrame([("t", 1)], "tag string, review_id long")
    vectors = spark.createDataFrame([("t", [1.0]), ("unused", [2.0])], "tag string, embedding array<double>")
    seen = {}

    def tag_model(rows):
        seen["reviews"] = sorted(r.review_id for r in rows.collect())
        return rows.select("review_id", F.when(F.col("review_id") == 2, "t").otherwise("u").alias("tag"))

    def embed_model(rows):
        seen["tags"] = sorted(r.tag for r in rows.collect())
        return rows.withColumn("embedding", F.array(F.lit(3.0)))

    got, made = R.tag_and_embed(reviews, tags, vectors, tag_model, embed_model)
    assert rows(got) == [("t", 1, 7), ("t", 2, 7), ("u", 3, 8)] and rows(made) == [("t", [1.0]), ("u", [3.0])]
    assert seen == {"reviews": [2, 3], "tags": ["u"]}


def test_rounds_of_judging_save_work(spark):
    hits = spark.range(400).selectExpr("'a' as aspect", "id % 4 as item_id", "id as review_id", "int(id) as rank")
    judged = R.judge_in_rounds(hits, lambda h: h.withColumns({"is_conclusive": F.lit(True), "is_positive": F.col("item_id") == 1}), size=3)
    assert judged.count() == 12 and rows(R.verdict_agg(judged)) == [("a", i, True, i == 1) for i in range(4)]


def test_near_segments_equal_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for f in range(30):
        base = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 14))]
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            if rng.random() < 0.7:
                w[rng.randrange(len(w))] = f"w{rng.randrange(40)}"
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    texts += ["!", "!", "?", "the", "The  "]
    got = sorted(tuple(r) for r in near_collapse(spark.createDataFrame([(i // 3, i % 3, t) for i, t in enumerate(texts)], "review_id long, position int, segment string")).collect())
    sets = [frozenset(t.lower().split()) if t[0] not in "!?" else t for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            alike = sets[i] == sets[j] or not isinstance(sets[i], str) and not isinstance(sets[j], str) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            if alike:
                up[max(find(i), find(j))] = min(find(i), find(j))
    want = {}
    for i, t in enumerate(texts):
        want.setdefault(find(i), []).append(" ".join(t.lower().split()))
    assert got == sorted((k // 3, k % 3, len(v), len(set(v))) for k, v in want.items()) and len(got) < len({*texts})


@pytest.mark.parametrize("radius", [5.0, 300.0, 19_000.0])
def test_places_within_a_radius_all_over_the_sphere(spark, radius):
    """Date line and poles have no seam: the same pairs as the filtered product."""
    spots = [(0.0, 179.99), (0.0, -179.99), (89.99, 0.0), (89.99, 180.0), (89.98, 90.0), (-90.0, 12.0), (-89.99, -170.0), (10.0, 10.0), (10.01, 10.02), (10.0, 370.0), (45.0, -0.01), (45.0, 0.02), (None, 1.0)]
    c = spark.createDataFrame([(k, *p) for k, p in enumerate(spots)], "u int, center_lat double, center_lon double")
    i = spark.createDataFrame([(k, *p) for k, p in enumerate(spots)], "item_id int, latitude double, longitude double")
    got = [(r.u, r.item_id) for r in G.distance_pairs(c, i, radius).collect()]
    assert sorted(got) == sorted((r.u, r.item_id) for r in G.distance_pairs(c, i).filter(F.col("km") <= radius).collect())
    assert {(0, 1), (2, 3)} <= set(got) and len(got) == len(set(got))


def test_medians_of_large_and_small_groups_agree(spark):
    """A user with a third of all rows, and a null user: the same centres whether places are packed in a row or spread."""
    rows = [(None if k % 9 == 0 else 1 if k % 3 == 0 else k % 5 + 2, 40 + (k * 37 % 101) / 500, 5 + (k * k % 89) / 400) for k in range(600)] + [(50, 1.0, 2.0)] * 4 + [(51, None, 1.0)]
    p = spark.createDataFrame(rows, "u int, lat double, lon double")
    one, two = ({r.u: (r.n, round(r.center_lat, 6), round(r.center_lon, 6)) for r in G.geometric_median(p, "u", in_row=k).collect()} for k in (10_000, 3))
    assert one == two and len(one) == 8 and one[50] == (4, 1.0, 2.0)


def test_nearest_vectors_by_cells(spark):
    """Equal to all products, ties and zero vectors included; on clustered vectors under half of the pairs are compared."""
    rng = random.Random(2)
    hubs = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(8)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in hubs[i % 8]]) for i in range(400)]
    rows += [(900, rows[5][1]), (901, [0.0] * 12), (902, None)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    points = spark.createDataFrame([(p, rows[p * 7][1]) for p in range(30)] + [(40, [0.0] * 12)], "point long, vector array<double>")
    report = {}
    got = {r.point: (r.id, round(r.similarity, 8)) for r in V.nearest_by_cells(points, V.build_cells(v, "id", 8), report).collect()}
    want = {r.point: (r.id, round(r.similarity, 8)) for r in T.nearest_vector(points, v.filter("embedding is not null"), "id").collect()}
    assert got == want and report["read"] < report["all"] / 2
    assert V.nearest_by_cells(points, V.build_cells(v.limit(0), "id")).count() == 0
    assert V.nearest_by_cells(points, V.build_cells(v.limit(1), "id")).count() == 31


@pytest.mark.parametrize("few", [4096, 3])
def test_greatest_rows_of_groups(spark, monkeypatch, few):
    """Even, tied, null and infinite values: the same rows as by a full order, also when histograms are refined to the end."""
    monkeypatch.setattr(ranking, "FEW", few)
    monkeypatch.setattr(ranking, "STEPS", 8)
    rng = random.Random(6)
    rows = [("even", i, rng.random()) for i in range(200)] + [("ties", i, float(i % 3)) for i in range(90)] + [("one", i, 7.0) for i in range(20)]
    rows += [("odd", 1, None), ("odd", 2, float("inf")), ("odd", 3, float("-inf")), ("odd", 4, 1e308), ("odd", 5, -1e308), ("odd", 6, float("inf")), ("odd", 7, 0.0)]
    df = spark.createDataFrame(rows, "g string, i long, v double")
    keep = {"even": 31, "ties": 35, "one": 4, "odd": 3, "absent": 5}
    want = {(g, i) for g, k in keep.items() for _, i in sorted((max(-1.7e308, min(1.7e308, -math.inf if v is None else v)), -i) for h, i, v in rows if h == g)[::-1][:k] for i in [-i]}
    got = greatest_rows(df, "g", "v", "i", spark.createDataFrame(list(keep.items()), "g string, keep int")).collect()
    assert {(r.g, r.i) for r in got} == want and len(got) == len(want)
    assert greatest_rows(df, "g", "v", "i", spark.createDataFrame([("even", 0)], "g string, keep int")).count() == 0


def test_result_store(spark, tmp_path, monkeypatch):
    def rows(*r):
        return spark.createDataFrame(r, "task string, city string, key string, tag string, version int, payload string")

    def all_of(store):
        return sorted((r.city, r.key, r.tag, r.version, r.payload) for r in store.rows().collect())

    path = str(tmp_path / "s")
    empty = Q.ResultStore(spark, path)
    assert empty.rows().count() == 0 and empty.get("k").count() == 0
    one = empty.put(rows(("t", "a", "k1", "x", 1, "p"), ("t", None, "k1", "y", 1, "p"), ("t", "b", "k1", "x", 1, "other city"), ("t", "a", None, "x", 1, "no key")))
    two = one.put(rows(("t", "a", "k1", "x", 2, "newer"), ("t", "a", "k1", "x", 0, "older"), ("t", "a", "kä", "x", 1, "q")))
    assert all_of(two) == [("", "k1", "y", 1, "p"), ("a", "k1", "x", 2, "newer"), ("a", "kä", "x", 1, "q"), ("b", "k1", "x", 1, "other city")]
    assert [r.payload for r in two.get("k1", "x", city="a").collect()] == ["newer"] and two.get("kä", task="t").count() == 1 and two.get("k2").count() == 0
    assert len(two.get("k1").inputFiles()) <= 8 and all("bucket=" in f for f in two.get("k1").inputFiles())
    kept = two.put(rows(("t", "a", "k1", "x", 9, "late"), ("t", "a", "k3", "x", 1, "r")), overwrite=False)
    assert [r.payload for r in kept.get("k1", "x", city="a").collect()] == ["newer"] and kept.get("k3").count() == 1
    with monkeypatch.context() as m:
        m.setattr(Q.ResultStore, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("cut off")))
        with pytest.raises(RuntimeError):
            kept.put(rows(("t", "a", "k1", "x", 99, "never seen")))
    assert all_of(Q.ResultStore(spark, path)) == all_of(kept)
    assert all_of(Q.ResultStore(spark, path, version=one.version)) == all_of(one)  # earlier versions stay
    untouched = {b: f for b, f in one.folders.items() if b not in {k for k, f in two.folders.items() if f != one.folders.get(k)}}
    assert all(two.folders[b] == f for b, f in untouched.items()) and kept.put(kept.rows().limit(0)).version == kept.version


def test_a_stored_vector_is_not_made_again(spark, tmp_path):
    path, seen = str(tmp_path / "v"), str(tmp_path / "seen")
    tags = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "tag string")

    def model(frames):
        for f in frames:
            for t in f["tag"]:
                with open(seen, "a") as log:
                    log.write(t)
            yield f.assign(embedding=[[3.0, 4.0]] * len(f))

    N.embed_missing(tags, path, model)
    got = N.embed_missing(tags.union(spark.createDataFrame([("c",)], "tag string")), path, model).collect()
    assert sorted(open(seen).read()) == ["a", "b", "c"] and {r.tag for r in got} == {"a", "b", "c"}
    assert [round(x, 5) for x in got[0].embedding] == [0.6, 0.8]


def test_a_diverse_choice_scores_few_items_anew(spark):
    rng = random.Random(9)
    s = [(q, i, round(rng.random(), 3)) for q in (1, 2) for i in range(80)]
    tags = [(i, rng.randrange(12)) for i in range(80) for _ in range(3)]
    want = {}
    held = {i: {t for j, t in tags if j == i} for i in range(80)}
    for q in (1, 2):
        left, used = {i: v for p, i, v in s if p == q}, set()
        for place in range(1, 5):
            i = min(left, key=lambda i: (-round(left[i] - 0.1 * len(held[i] & used), 9), i))
            want[q, place] = (i, round(left.pop(i) - 0.1 * len(held[i] & used), 9))
            used |= held[i]
    report = {}
    got = E.diverse_topk(spark.createDataFrame(s, "query_id int, item_id long, score double"), spark.createDataFrame(tags, "item_id long, tag int"), k=4, batch=4, report=report).collect()
    assert {(r.query_id, r.place): (r.item_id, round(r.score, 9)) for r in got} == want and report["rescored"] < 4 * len(s) / 2


def test_pruning_by_what_was_removed(spark):
    """Equal to counting all edges in every pass."""
    rng = random.Random(4)
    edges = [(rng.randrange(30), rng.randrange(20)) for _ in range(160)] + [(99, 1), (None, 2), (1, None)]
    e = spark.createDataFrame(edges, "user_id int, item_id int")
    users, items = spark.range(30).select(F.col("id").cast("int").alias("user_id")), spark.range(20).select(F.col("id").cast("int").alias("item_id"))
    for passes in (0, 1, 2, 6):
        u, i = set(range(30)), set(range(20))
        now = [x for x in edges if x[0] in u and x[1] in i]
        for _ in range(passes):
            u, i = {x for x in u if sum(a == x for a, _ in now) >= 5}, {x for x in i if sum(b == x for _, b in now) >= 7}
            now = [x for x in now if x[0] in u and x[1] in i]
        got = C.core_prune(e, users, items, 5, 7, passes)
        assert sorted(tuple(r) for r in got[0].select("user_id", "item_id").collect()) == sorted(now)
        assert {r[0] for r in got[1].collect()} == u and {r[0] for r in got[2].collect()} == i


def test_quantiles_from_merged_sketches(spark):
    log = spark.range(20_000).selectExpr("id % 2 as task", "id % 30 as day", "cast((id * 7919) % 10007 as double) as latency_ms", "0.5 as usd")
    got = {r.task: r for r in U.report_from_sketches(U.latency_sketches(log).filter("day < 15")).collect()}
    exact = {r.task: r for r in log.filter("day < 15").groupBy("task").agg(F.count("*").alias("n"), F.expr("percentile(latency_ms, array(0.48, 0.52, 0.93, 0.97))").alias("p")).collect()}
    for task, r in got.items():
        assert r.n == exact[task].n and exact[task].p[0] <= r.p50 <= exact[task].p[1] and exact[task].p[2] <= r.p95 <= exact[task].p[3] and r.usd_per_1k == 500


def test_keywords_are_fused_by_rank(spark):
    r = spark.createDataFrame([(1, 1, "tea cake"), (2, 1, "tea"), (3, 1, "pie"), (4, 1, "cake cake pie"), *[(i, 1, "x") for i in range(5, 12)]], "review_id long, item_id long, text string")
    k = spark.createDataFrame([(1, "tea"), (1, "cake"), (1, "cake"), (2, "zz"), (3, None)], "query_id int, keyword string")
    got = [(x["rank"], x.review_id, round(x.score, 6), x.n_keywords) for x in S.fused_search(r, k).orderBy("rank").collect()]
    assert got == [(1, 1, round(1 / 62 + 1 / 62, 6), 2), (2, 2, round(1 / 61, 6), 1), (3, 4, round(1 / 61, 6), 1)]


def test_postings_are_packed_without_a_shuffle(spark):
    r = spark.createDataFrame([(3, 1, "b a b", 0), (1, 2, "a the", 0), (2, 1, None, 0), (4, 2, "B é", 1)], "review_id long, item_id long, text string, block long").coalesce(1)
    packed = I._packed(r, 5, ["the"])
    assert "Exchange" not in packed._jdf.queryExecution().toString()
    got = [(p.term, p.segment, p.block, p.max_tf, p.min_tokens, [tuple(f) for f in p.found]) for p in packed.collect()]
    assert got == [
        ("a", 5, 0, 1, 1, [(1, 2, 1, 1), (3, 1, 1, 3)]), ("b", 5, 0, 2, 3, [(3, 1, 2, 3)]), ("b", 5, 1, 1, 2, [(4, 2, 1, 2)]),
        ("the", 5, 0, 1, 1, [(1, 2, 1, 1)]), ("é", 5, 1, 1, 2, [(4, 2, 1, 2)]),
    ]
    assert I._packed(r.filter("review_id = 2"), 5, None).count() == 0


def test_terms_and_their_frequencies_take_little_reading(spark, tmp_path):
    """Few short parts cut no vocabulary, known grams prune the table, long lists of a term are counted by their tf alone."""
    import pyarrow.parquet as pq

    r = spark.createDataFrame([(i, i % 3, f"often off roof w{i} the the" if i % 2 else "of 𝔫x") for i in range(40)], "review_id long, item_id long, text string")
    index = I.build_index(r, str(tmp_path / "i"), ["the"])
    found = I.terms_containing(index, spark.createDataFrame([("of",), ("𝔫",), ("oft",), ("zz",)], "part string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "EqualTo(gram,oft)" in plan
    assert rows(found) == [("of", "of"), ("of", "off"), ("of", "often"), ("of", "roof"), ("oft", "often"), ("𝔫", "𝔫x")]
    assert index.mean_tokens == (20 * 4 + 20 * 2) / 40
    assert {(x.term, x.df) for x in index.frequencies().collect()} == {("often", 20), ("off", 20), ("roof", 20), ("of", 20), ("𝔫x", 20), *((f"w{i}", 1) for i in range(1, 40, 2))}
    files = list((tmp_path / "i").glob("segment-*/postings/*.parquet"))
    groups = [pq.ParquetFile(f).metadata.row_group(0) for f in files]
    columns = [g.column(c) for g in groups for c in range(g.num_columns)]
    assert columns and not [c.path_in_schema for c in columns if c.path_in_schema.startswith("found") and c.has_dictionary_page]


@pytest.mark.parametrize("hot", [0, 10**9])
def test_sets_that_meet_at_one_token_are_no_rows_unless_alike(spark, monkeypatch, hot):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(30)]
    sets = [frozenset([*rng.sample(common, 8), *(["x"] if i < 60 else [])]) for i in range(200)]
    sets += [s ^ {rng.choice(common)} for s in sets[:40]] + [frozenset(["x"]), frozenset(["c1"]), frozenset(["x", "c1"])]
    sets = sorted(set(sets), key=sorted)
    want = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    seen, save = {}, D.save_stage
    monkeypatch.setattr(D, "save_stage", lambda df, label: seen.setdefault(label, save(df, label)))
    nodes = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "node long, tokens array<string>")
    assert rows(D.similar_sets(nodes, 80, hot)) == want and want
    assert seen["pairs"].count() <= 2 * len(want)
