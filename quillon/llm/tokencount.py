"""Token counts by a two-tier lookup on the map side.

The first tier is a broadcast table from frequent pre-tokens to their token counts. The second encodes what the first lacks
and keeps it in a bounded cache of the Python worker. No pre-token is ever shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bpe import CACHE_CHARS, Codec, Memo, codec
from quillon.llm.sampling import hash_sample
from quillon.runtime import ship_package

#: Entries of the broadcast table; each is a pre-token of at most ``CACHE_CHARS`` characters and a small integer.
FREQUENT = 100_000
#: Expected rows of the sample (by hash of id, at most twice as many) that frequent pre-tokens are gathered from. It only
#: decides which tier answers, never a count.
SAMPLE_ROWS = 2_000
CACHE_PRETOKENS = 250_000

_COUNTS: dict[tuple, Memo] = {}


def byte_vocabulary() -> str:
    """The default vocabulary's file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _tally(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, seen = codec(path), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for _, words in c.parts(text or ""):
                    seen.update(w for w in words if len(w) <= CACHE_CHARS)
        top = seen.most_common(FREQUENT)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    return run


def frequent_counts(texts: DataFrame, path: str) -> dict[str, int]:
    """Token counts of at most ``FREQUENT`` pre-tokens that are common in a bounded sample.

    Each task counts its part of the sample, and the driver adds the tallies up: no pre-token is shuffled.
    """
    sample = hash_sample(texts.filter("text is not null"), "doc_id", SAMPLE_ROWS).select("text")
    tally: Counter = Counter()
    for batch in sample.mapInArrow(_tally(path), "word string, n long").toArrow().to_batches():
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            tally[word] += n
    c = Codec(path)
    return {w: len(c.ids_of(w)) for w, _ in sorted(tally.items(), key=lambda t: (-t[1], t[0]))[:FREQUENT]}


def _counter(path: str, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        key = (path, id(table.value))
        if key not in _COUNTS:
            _COUNTS.clear()
            _COUNTS[key] = Memo(lambda w: len(c.ids_of(w)), CACHE_PRETOKENS, table.value)
        get = _COUNTS[key].__getitem__
        for batch in batches:
            counts = [sum(1 if special else sum(map(get, words)) for special, words in c.parts(text)) if text else 0 for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit).

    Null and empty texts count as 0 bytes and 0 tokens. A special string in a text is one token. Rows are independent, so
    repeated rows repeat; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    path = path or byte_vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = spark.sparkContext.broadcast(frequent_counts(rows, path))
    sized = rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = sized.mapInArrow(_counter(path, table), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every text of ``documents``."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
