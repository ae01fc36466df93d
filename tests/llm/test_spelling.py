import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from quillon.llm import spelling
from quillon.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def near(a, b):
    """By definition: one code point inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs, least_length=6, least_n=5, ratio=5, drop_each=None):
    import regex

    seen = Counter()
    for i, text in docs:
        for w in regex.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if drop_each and h % drop_each == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            seen[w] += 1
    n = {w: k for w, k in seen.items() if len(w) >= least_length and k >= least_n}
    rows = {}
    for w in n:
        around = [v for v in n if near(w, v)]
        best = min(around, key=lambda v: (-n[v], v)) if around else None
        rows[w] = (best if best and n[best] >= ratio * n[w] else None, len(around))
    out = set()
    for w, (form, k) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.add((w, form, root, n[w], k, n[form] if form else None))
    return out


def result(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_whole_table_equals_plain_and_sql(spark):
    got = QUERIES["op11_spelling_variants"](spark, SF)
    rows = result(got)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows == plain(docs, drop_each=199) and any(f for _, f, *_ in rows)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cursor = c.execute(ORACLES["op11_spelling_variants"])
    at = [[d[0] for d in cursor.description].index(k) for k in got.columns]
    assert {tuple(r[i] for i in at) for r in cursor.fetchall()} == rows


@pytest.mark.parametrize("unit", [4096, 3])
def test_dense_neighbourhood_in_blocks(spark, monkeypatch, unit):
    """Words of few letters: long chains, ties, halves shared by all; alike when halves are split to blocks of three."""
    monkeypatch.setattr(spelling, "UNIT_WORDS", unit)
    monkeypatch.setattr(spelling, "TILE_ROWS", 7)
    rng = random.Random(5)
    words = ["".join(rng.choice("abé") for _ in range(rng.choice([6, 7, 8]))) for _ in range(90)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa"]
    text = [w for w in words for _ in range(rng.choice([1, 5, 6, 30, 160, 900]))]
    rng.shuffle(text)
    docs = [(i, " ".join(text[i::4])) for i in range(4)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int")
    assert result(spelling.spelling_variants(frame)) == plain(docs)


def test_odd_rows(spark):
    """Nulls, empty texts, repeated rows, one very long word among others, other scripts, an empty table."""
    long = "ab" * 60_000
    docs = [(None, "Straße straße STRASSE"), (1, None), (1, ""), (2, "…123 日本語日本語日本語"), (3, f"{long} {long}x"), (3, f"{long} {long}x")] + [(4, "Letter lettér letters LETTERS")] * 6
    docs += [(5, f"{long} {long}x")] * 4
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(spelling.spelling_variants(frame)) == plain(docs)
    assert result(spelling.spelling_variants(frame, least_n=1, drop_each=2)) == plain(docs, least_n=1, drop_each=2)
    assert spelling.spelling_variants(frame.limit(0)).count() == 0


def test_prefix_lengths_of_padded_rows():
    rows = [np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.int64) for w in ("abc", "ab", "abd")]
    assert spelling.common(spelling.padded(rows, -1), spelling.padded(rows, -2)).tolist() == [[3, 2, 2], [2, 2, 2], [2, 2, 3]]
