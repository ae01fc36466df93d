"""Language identification by word-first backoff.

A known word scores its log frequency in each language. A word that was never seen falls back to its character n-grams, the
longest order first, down to single characters; the first order with a known n-gram decides.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.sampling import hash_sample
from quillon.runtime import save_stage, ship_package

UNKNOWN = "und"
ORDERS = (5, 4, 3, 2, 1)
#: Expected number of labelled documents and bytes of their texts that the model is fitted on (at most twice as many). All
#: words and n-grams of the sample are kept, so this bounds what is broadcast.
FIT_ROWS, FIT_BYTES = 4_000, 12 << 20
#: Tasks that count the sample.
FIT_PARTS = 8
CACHED = 250_000
_LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return _LETTERS.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word between word marks."""
    marked = f" {word} " if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def unit_key(unit: str, order: int = 0) -> int:
    """The 63-bit key of a word (order 0) or an n-gram."""
    return xxhash.xxh64_intdigest(unit.encode("utf-8", "replace"), order) >> 1


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, Counter] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in ((0, pa.string()), (1, pa.string()), (2, pa.int64()))], ["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            seen.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, seen.values())) > 200_000:
            yield out()
    yield out()


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A word's own key and those of its n-grams, with the word's count."""
    for batch in batches:
        seen: Counter = Counter()
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
            seen[lang, unit_key(word), 0] += n
            for order in ORDERS:
                for g in grams_of(word, order):
                    seen[lang, unit_key(g, order), order] += n
        names = (("lang", pa.string()), ("unit", pa.int64()), ("kind", pa.int32()))
        arrays = [pa.array([k[i] for k in seen], t) for i, (_, t) in enumerate(names)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(seen.values()), pa.int64())], [*(c for c, _ in names), "n"])


class Model:
    """Log frequencies per language of words and n-grams: for each kind sorted keys and a row of floats for each."""

    def __init__(self, langs: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        self.tables = {}
        for kind, (units, n) in counts.items():
            order = np.argsort(units)
            n = n[order] + 0.5
            self.tables[kind] = units[order], np.log(n / n.sum(axis=0)).astype(np.float32)

    def known(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are known, and the rows of those."""
        if kind not in self.tables or not len(keys):
            return np.zeros(len(keys), bool), np.empty((0, len(self.langs)), np.float32)
        units, values = self.tables[kind]
        at = np.minimum(np.searchsorted(units, keys), len(units) - 1)
        found = units[at] == keys
        return found, values[at[found]]

    def scores(self, words: list[str]) -> list[bytes]:
        """For each word its own row if it is known, else the mean row of its known n-grams of the longest order that has one."""
        out = np.zeros((len(words), len(self.langs)))
        left = np.arange(len(words))
        found, rows = self.known(0, np.array([unit_key(w) for w in words], np.int64))
        out[left[found]] = rows
        left = left[~found]
        for order in ORDERS:
            if not len(left):
                break
            grams = [[unit_key(g, order) for g in grams_of(words[i], order)] for i in left]
            owner = np.repeat(np.arange(len(left)), [len(g) for g in grams])
            found, rows = self.known(order, np.array([k for g in grams for k in g], np.int64))
            n = np.bincount(owner[found], minlength=len(left))
            sums = np.zeros((len(left), len(self.langs)))
            np.add.at(sums, owner[found], rows)
            hit = n > 0
            out[left[hit]] = sums[hit] / n[hit, None]
            left = left[~hit]
        return [row.tobytes() for row in out]


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Count words and n-grams of a bounded sample of ``docs`` (``doc_id``, ``text``, ``lang``; rows without a language or text are ignored).

    One row per unit holds its counts in all languages, so no unit is known in some languages only.
    """
    sample = hash_sample(docs.filter("lang is not null and text is not null"), "doc_id", fit_rows, "text", FIT_BYTES).repartition(FIT_PARTS)
    words = sample.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    units = words.mapInArrow(_count_units, "lang string, unit long, kind int, n long").groupBy("kind", "unit", "lang").agg(F.sum("n").alias("n"))
    units = save_stage(units, "units")
    langs = sorted(r.lang for r in units.select("lang").distinct().collect())
    if not langs:
        return Model([], {})
    wide = units.groupBy("kind", "unit").agg(*[F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, lang in enumerate(langs)])
    found = wide.toArrow()  # bounded by the sample
    kinds, keys = (found.column(c).to_numpy() for c in ("kind", "unit"))
    n = np.column_stack([found.column(f"n{i}").to_numpy() for i in range(len(langs))]).astype(np.float64)
    return Model(langs, {int(k): (keys[kinds == k], n[kinds == k]) for k in np.unique(kinds)})


#: Words of a text that are looked up in one go, and the longest word (in characters) that a worker remembers.
SLICE, CACHE_CHARS = 100_000, 48
_SCORES: dict[str, tuple[Model, dict[str, bytes]]] = {}


def mean_scores(model: Model, memo: dict[str, bytes], words: list[str]) -> np.ndarray:
    """The mean row of all words; rows of short words are remembered in ``memo``, which starts anew when it is full."""
    total = np.zeros(len(model.langs))
    for at in range(0, len(words), SLICE):
        part = words[at : at + SLICE]
        new = list({w for w in part if w not in memo})
        rows = dict(zip(new, model.scores(new), strict=True))
        total += np.frombuffer(b"".join([memo[w] if w in memo else rows[w] for w in part])).reshape(-1, len(model.langs)).sum(axis=0)
        if len(memo) + len(rows) > CACHED:
            memo.clear()
        memo.update((w, r) for w, r in rows.items() if len(w) <= CACHE_CHARS)
    return total / max(1, len(words))


def _predict(shared, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _SCORES:
            _SCORES.clear()
            _SCORES[name] = shared.value, {}
        model, memo = _SCORES[name]
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                if not words or not model.langs:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                mean = mean_scores(model, memo, words)
                best = int(mean.argmax())
                langs.append(model.langs[best])
                scores.append(1.0 / float(np.exp(mean - mean[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), batch.column("text_md5")], ["doc_id", "lang_pred", "score", "text_md5"])

    return run


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Predict the language of every whole text: ``doc_id``, ``lang_pred``, ``score`` (0 to 1) and ``text_md5`` (binary, null
    for a null text).

    The score is the language's share of the likelihood of the text's average word, so texts of all lengths compare: near 1
    if the words are common in one language only, near one part in the number of languages if they belong to none.

    ``train`` gives labelled texts, of which at most ``2 * fit_rows`` with ``2 * FIT_BYTES`` bytes are used. Null texts and texts without a letter get
    ``und`` and 0, and so does everything if nothing was learned. Ties go to the language first in order. Repeated rows
    repeat; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    named = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    shared = spark.sparkContext.broadcast(fit(train.select(*named, F.col(lang_col).alias("lang")), fit_rows))
    rows = docs.select(*named).withColumn("text_md5", F.unhex(F.md5("text")))
    return rows.mapInArrow(_predict(shared, uuid.uuid4().hex), "doc_id long, lang_pred string, score double, text_md5 binary")


def learnable(docs: DataFrame) -> DataFrame:
    """The documents that may be learned from: crc32(doc_id as text) mod 4 is not 2."""
    return docs.filter("crc32(cast(doc_id as string)) % 4 <> 2")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every text of ``documents``, learned outside the held-out quarter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learnable(docs))
    return found.select("doc_id", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False)).alias("held_out"), "lang_pred", "score")
