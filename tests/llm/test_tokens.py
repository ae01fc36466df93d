import hashlib
import random
import unicodedata

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillon.llm import bpe, tokencount


def fuzz(n=400):
    rng = random.Random(3)
    parts = list("abcdefthe in'snotre ÀÉßΣσİ日本 ①²\t\n\x85 ") + ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "The", "ΑΣ", "  "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["", "a" * 5000, "ab" * 3000 + " " + "x y " * 2000]


@pytest.mark.parametrize("path", [bpe.word_vocabulary(), tokencount.byte_vocabulary()])
def test_equals_the_library(path):
    texts, library = fuzz(), Tokenizer.from_file(path)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = np.frombuffer(bpe.encode_bytes(path, text), "<u4")
        assert ids.tolist() == want.ids, ascii(text)
        if path == bpe.word_vocabulary():
            assert bpe.codec(path).decode_each(ids, np.array([len(ids)]))[0].decode() == library.decode(want.ids, skip_special_tokens=False)


def test_caches_that_run_full(monkeypatch):
    memo = bpe.Memo(len, 2, {"aa": 2})
    assert [memo[w] for w in ("b", "cc", "ddd", "aa", "b", "x" * 100)] == [1, 2, 3, 2, 1, 100]
    assert len(memo) <= 3


@pytest.mark.parametrize("piece", [bpe.DECODE_IDS, 7])
def test_digests(spark, monkeypatch, piece):
    texts = [*fuzz(60), None]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(None, "x", 1), (1, texts[1], 1)], "doc_id long, text string, ids int")
    library = Tokenizer.from_file(bpe.word_vocabulary())
    out = {r.doc_id: r for r in bpe.encode_digests(df).collect()}
    run = bpe._digests(bpe.word_vocabulary())
    monkeypatch.setattr(bpe, "DECODE_IDS", piece)
    local = next(run(iter(df.filter("doc_id is not null").limit(len(texts)).select("doc_id", "text").toArrow().to_batches()))).to_pylist()
    by_id = {r["doc_id"]: r for r in local}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == want
        if i in by_id:
            assert (by_id[i]["n_tokens"], by_id[i]["ids_sha256"], by_id[i]["decoded_sha256"]) == want
    assert bpe.encode_digests(df.filter("false")).count() == 0


def test_counts(spark):
    texts = [*fuzz(60), None]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    library = Tokenizer.from_file(tokencount.byte_vocabulary())
    for r in tokencount.count_tokens(df, limit=20).collect():
        n = len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 20)
    assert tokencount.count_tokens(df.filter("false")).count() == 0


@pytest.mark.parametrize("path", [bpe.word_vocabulary(), tokencount.byte_vocabulary()])
def test_all_kinds_of_characters_equal_the_library(path):
    """Every character that Python or ``regex`` knows beside a letter and a digit (long runs of ideographs and syllables by steps)."""
    new = bpe.newer_chars()
    known = [c for c in map(chr, range(0xE0200)) if not "\ud800" <= c <= "\udfff" and (c in new or unicodedata.category(c) != "Cn")]
    chars = [c for i, c in enumerate(known) if not ("㐀" < c < "ꀀ" or "가" < c < "힤" or c > "\U00017000") or c in new and c < "\U00020000" or i % 40 == 0]
    rng = random.Random(8)
    texts = [f"a{c}b 1{c}" for c in chars] + ["".join(rng.choice(known) for _ in range(12)) for _ in range(5000)]
    library = Tokenizer.from_file(path)
    for at in range(0, len(texts), 5000):
        part = texts[at : at + 5000]
        for text, want in zip(part, library.encode_batch(part, add_special_tokens=False), strict=True):
            assert np.frombuffer(bpe.encode_bytes(path, text), "<u4").tolist() == want.ids, ascii(text)


def test_repeated_rows_repeat(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, None), (1, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in tokencount.count_tokens(df).collect()) == [0, 0, 2, 2]
    assert sorted(r.n_tokens for r in bpe.encode_digests(df).collect()) == [0, 0, 2, 2]


def test_the_queries_equal_the_library_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    one, two = Tokenizer.from_file(bpe.word_vocabulary()), Tokenizer.from_file(tokencount.byte_vocabulary())
    got = bpe.op8_bpe_encode_decode(spark, sf).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        ids = one.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = one.decode(ids, skip_special_tokens=False).encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest())
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.op10_token_counts(spark, sf).collect()}
    for i, t in texts.items():
        n = len(two.encode(t, add_special_tokens=False).ids)
        assert counts[i] == (len(t.encode()), n, n > 512)
