import math
import random
from collections import Counter

import duckdb
import numpy as np

from quillon.llm import ranked
from quillon.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(docs, items, topk=10):
    """All documents scored for all items."""
    texts = [(i, Counter(ranked.terms_of(t))) for i, t in docs]
    full = [c for _, c in texts if c]
    n_docs, n_terms = len(full), sum(sum(c.values()) for c in full)
    df = Counter(t for c in full for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(ranked.terms_of(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in texts:
            if c:
                m = 10 + 90 * sum(c.values()) * n_docs // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
                if s > 0:
                    scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:topk])]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_whole_table_equals_plain_and_sql(spark):
    got = result(QUERIES["op12_ranked_search"](spark, SF))
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got == plain(docs, items)
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert sorted(c.execute(f"select item_id, rank, doc_id, score from ({ORACLES['op12_ranked_search']})").fetchall(), key=str) == got


def test_ties_nulls_repeats_and_long_texts(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40])))) for i in range(120)]
    docs += [(500 + i, "w1 w2") for i in range(30)] + [(7, "W1 w2")] * 3 + [(None, "w1 w2 w3"), (None, None), (900, ""), (901, "–!–"), (902, " ".join(rng.choice(words) for _ in range(200_000)))]
    items = [(1, "w1 w2 W1"), (2, "w3, w4; w5"), (3, None), (4, "…"), (5, "unseen"), (6, "w9"), (6, "w10 w9"), (1, "w1 w2 W1"), (None, "w1")]
    frame = spark.createDataFrame([(*d, 0, 1) for d in docs], "doc_id long, text string, score int, item_id int")
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    assert result(ranked.ranked_search(frame, asked)) == plain(docs, items)
    assert result(ranked.ranked_search(frame.limit(0), asked)) == [] == result(ranked.ranked_search(frame, asked.limit(0)))


def test_many_small_trees_and_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(ranked, "TREE_POSTINGS", 40)
    monkeypatch.setattr(ranked, "ITEM_BYTES", 60)
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(9)))) for i in range(200)]
    items = [(i, " ".join(rng.choice("abcdefghij") for _ in range(3))) for i in range(12)]
    got = ranked.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert result(got) == plain(docs, items)


def test_bounds_leave_most_documents_unscored():
    """Two topics: items of one are not scored in the documents of the other, and few nodes are visited."""
    rng = np.random.default_rng(1)
    docs = [(i, 100, np.sort(rng.choice(np.arange(50) + 50 * (i % 2), 12, replace=False)).astype(np.int32), np.ones(12, np.int64)) for i in range(2000)]
    weights = np.full(100, 1000, np.int64)
    items = ranked.Items([np.arange(8), np.arange(50, 60)], weights)
    best, counts = ranked.Best(2, 10), Counter()
    ranked.Tree(docs).search(items, best, np.zeros(100, np.int64), counts)
    exact = sorted(((-sum(1000 * (10**9 // 1800) for t in d[2] if t < 8), d[0]) for d in docs))[:10]
    assert [(-s, i) for s, i in zip(best.scores[0].tolist(), best.ids[0].tolist(), strict=True)] == exact
    assert counts["scored"] < 0.2 * 2 * len(docs)
