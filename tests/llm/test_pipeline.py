import zlib

import duckdb
import pytest

import corpus_pipeline as P
from quillon.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_query_runs(spark):
    for name in ("op7_benchmark_decontamination", "op9_html_extraction", "op10_token_counts"):
        assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["op3_minhash_near_dedup", "op5_warc_transactions"])
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall(), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in QUERIES[name](spark, SF).collect()), key=str) == want


def test_the_pipeline_equals_its_parts(spark):
    """Each stage is recomputed from its operator's own answer on what its predecessor kept."""
    from tokenizers import Tokenizer

    from quillon.llm.bpe import word_vocabulary
    from quillon.llm.decontaminate import fold, hashed, tiles
    from tests.llm.test_models import plain_language
    from tests.llm.test_neardup import components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {}
    for name, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids[name] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    start = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    named = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = plain_language([d for d in named if zlib.crc32(str(d[0]).encode()) % 4 != 2], [d[:2] for d in named])
    assert {*ids["language_id"]} == {i for i in start if found[i][0] != "und" and found[i][1] >= 0.5}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [i for i in ids["language_id"] if i in labels]
    assert sum((i in ids["quality"]) == (labels[i] == 1) for i in judged) / len(judged) > 0.95
    comp = components(sorted(ids["quality"].items()))
    assert {*ids["near_dedup"]} == {i for i, (_, c) in comp.items() if i == c}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(text):
        words = [w.decode() for w in fold(text)]
        grams = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for item in items:
            w = [x.decode() for x in fold(item)]
            if len(w) >= 5 and any(tuple(w[k : k + 5]) in grams for k in range(len(w) - 4)):
                a, b = hashed([item, text])
                if sum(n for _, _, n in tiles(a, b)) >= 0.6 * len(w):
                    return True
        return False

    assert {*ids["decontamination"]} == {i for i, t in ids["near_dedup"].items() if not leaks(t)}
    library = Tokenizer.from_file(word_vocabulary())
    got = {r.doc_id: r.n_tokens for r in P.run(spark, SF).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in ids["decontamination"].items()}


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = "the quick brown fox jumps over the lazy dog and runs away from it"
    docs = spark.createDataFrame([(1, words, "en", "s", 1), (1, words, "en", "s", 1), (None, "lone " + words[::-1], "en", None, 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "12 34", "en", "s", 5)], schema)
    kept = P.language_id(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None"]
    assert sorted(str(r.doc_id) for r in P.near_dedup(spark, kept, SF).collect()) == ["1", "None"]
    for _, stage in P.STAGES:
        assert stage(spark, docs.filter("false"), SF).count() == 0


def test_texts_of_no_language_go_and_clashing_columns_do_no_harm(spark):
    long = "the quick brown fox jumps over the lazy dog " * 20_000
    names = ["node", "row_key", "sig", "score", "label", "text_md5", "component_id", "kept", "predicted", "stats", "at", "n"]
    rows = [(1, long, "en"), (2, long, "en"), (3, "the dog and the fox", "en"), (4, "le chien et le chat", "fr"), (5, "dog chien", "en"), (5, "dog chien", "en"), (6, "el perro", "es"), (None, "the fox", "en")]
    docs = spark.createDataFrame([(*r, "s", len(r[1]), *["z"] * len(names)) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'{n} string' for n in names)}")
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        got = sorted(str(r.doc_id) for r in kept.collect())
        if name == "near_dedup":
            assert got == ["1", "3", "4", "5", "6", "None"]
        if name == "decontamination":
            assert len(got) == len(rows)
