import random
from itertools import combinations

import numpy as np
import pytest

from quillon.llm import neardup as N
from quillon.operators.components import connected_components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(docs):
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(rng, n, edits, size=80):
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(size)] = f"e{rng.randrange(60)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("pairs", [N.BUCKET_PAIRS, 0])
def test_equals_brute_force(spark, monkeypatch, pairs):
    monkeypatch.setattr(N, "BUCKET_PAIRS", pairs)
    rng = random.Random(4)
    texts = family(rng, 60, 6) + family(rng, 30, 3) + family(rng, 5, 0)
    texts += [" ".join(f"w{rng.randrange(500)}" for _ in range(40)) for _ in range(40)]
    texts += ["", None, "  \t\n", "one two", "ONE two", "one  two", "Éa éa", texts[0].upper()]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, node string, sig int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df).collect()}
    assert got == components(docs)


def test_edges_of_the_table(spark):
    schema = "doc_id long, text string"
    assert N.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, None), (None, None), (None, "lonely words here")], schema)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 5, False), (5, 5, True), (5, 5, True), (7, 7, True), (None, None, True), (None, None, True)], key=str)


def test_long_text_in_pieces(monkeypatch):
    rng = random.Random(1)
    words = [f"w{rng.randrange(900)}" for _ in range(4000)]
    whole = N.shingle_sets([" ".join(words)])[0]
    monkeypatch.setattr("quillon.llm.textscan.PIECE", 500)
    assert np.array_equal(whole, N.shingle_sets([" ".join(words)])[0])
    assert len(whole) == len(shingles(" ".join(words)))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (12, 12), (None, 3)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3, 4)}, 10: 10, 11: 10, **{100 + i: 100 for i in range(41)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_likely_equals_the_sequential_comparison():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (40, N.HASHES)).astype(np.uint16)
    y = np.where(rng.random((30, N.HASHES)) < rng.random((30, 1)), x[:30], rng.integers(0, 3, (30, N.HASHES))).astype(np.uint16)
    limits = N.keep_from(0.75, 1e-6)
    got = N.likely(x, y, limits)
    for i in range(40):
        for j in range(30):
            same = np.cumsum(x[i] == y[j])[N.BATCH - 1 :: N.BATCH]
            assert got[i, j] == all(m >= least for m, least in zip(same, limits, strict=True))


def test_a_long_text_through_spark(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    other = words[:200_000] + [f"v{i}" for i in range(20_000)] + words[200_000:]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[::-1]))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in N.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}
