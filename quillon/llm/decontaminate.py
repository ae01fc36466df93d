"""Benchmark decontamination by greedy string tiling.

Test items and documents are sequences of word hashes. Documents that share a five-word seed with an item become candidate
pairs, unless the runs that they share cannot cover enough of the item. Greedy string tiling then marks the longest common run
of unmarked words again and again (runs are found from running Karp-Rabin hashes), so passages whose parts were moved around
are covered too. A document is contaminated by an item if the tiles cover enough of the item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.textscan import gram_hashes, pieces, word_hashes
from quillon.runtime import save_stage, ship_package

SEED = 5
#: Words of the shortest tile.
TILE = 3
COVERAGE = 0.6
#: UTF-8 bytes of test items that one pass broadcasts; a larger benchmark takes several passes over the documents.
BLOCK_BYTES = 32 << 20
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


#: What is no letter, mark or digit beyond ASCII (blanks of all widths, quotes, dashes, symbols), and what is not seen in words.
_BREAKS, _UNSEEN = regex.compile(r"[^\p{L}\p{M}\p{N}\x00-\x7f]+"), dict.fromkeys(map(ord, "\u00ad\u200c\u200d\u2060\ufeff"))


def fold(text: str | None) -> list[bytes]:
    """Words of a text: lower case, apart at anything that is neither letter, mark nor digit; soft hyphens and joiners go."""
    if not text:
        return []
    low = text.lower()
    if not low.isascii():
        low = _BREAKS.sub(" ", low.translate(_UNSEEN))
    return low.encode("utf-8", "replace").translate(_FOLD).split()


def hashed(texts: list[str | None]) -> list[np.ndarray]:
    """The word hashes of each text."""
    words = [fold(t) for t in texts]
    full = [i for i, w in enumerate(words) if w]
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for numbers, block in pieces([words[i] for i in full], 0):
        hashes, text = word_hashes(block)
        for k, part in zip(numbers, np.split(hashes, np.flatnonzero(np.diff(text)) + 1), strict=True):
            out[full[k]].append(part)
    return [np.concatenate(o) if o else np.empty(0, np.uint64) for o in out]


_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Runs:
    """A sequence of word hashes with Karp-Rabin hashes of its unmarked runs of any length."""

    def __init__(self, words: np.ndarray, powers: np.ndarray):
        self.words, self.powers, self.used = words, powers, np.zeros(len(words), bool)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers[1 : len(words) + 1])))
        self.blocked = np.zeros(len(words) + 1, np.int64)

    def mark(self, start: int, n: int) -> None:
        self.used[start : start + n] = True

    def settle(self) -> None:
        np.cumsum(self.used, out=self.blocked[1:])

    def free(self, start: int, n: int) -> bool:
        return not self.used[start : start + n].any()

    def hashes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the runs of ``n`` words that were unmarked when last settled."""
        at = np.flatnonzero(self.blocked[n:] == self.blocked[:-n])
        return at, (self.sums[at + n] - self.sums[at]) * self.powers[len(self.powers) - 1 - at]


def tiles(item: np.ndarray, doc: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in document, words) of non-overlapping common runs, longest first.

    Ties go to the earlier start in the item, then in the document. The greatest length of a common run is found by
    bisection over Karp-Rabin hashes, and all runs of that length are marked before shorter ones are looked for. The lengths
    differ and the runs lie apart in the item, so there are few of them, and memory is linear however often words repeat.
    """
    if len(item) < least or len(doc) < least:
        return []
    x, y = gram_hashes(item, least), gram_hashes(doc, least)
    hit = np.isin(y, x)
    if not hit.any():
        return []
    inside = np.zeros(len(doc) + 1, np.int8)  # words of the document that are in a common run
    for k in range(least):
        inside[k : k + len(hit)] |= hit
    at = np.flatnonzero(inside)
    # runs of such words that lie apart stay apart by one marked word
    gaps = np.flatnonzero(np.diff(at) > 1) + 1
    place = np.insert(at, gaps, -1)
    powers = np.full(max(len(item), len(place)) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    one, two = _Runs(item, powers), _Runs(np.where(place >= 0, doc[place], 0), powers)
    two.used[place < 0] = True
    two.settle()
    out, top = [], min(len(item), len(place))
    while top >= least:
        low, high = least - 1, top
        while low < high:
            n = (low + high + 1) // 2
            (_, p), (_, q) = one.hashes(n), two.hashes(n)
            if len(p) and len(q) and np.isin(p, q).any():
                low = n
            else:
                high = n - 1
        if low < least:
            break
        (starts, p), (where, q) = one.hashes(low), two.hashes(low)
        order = np.argsort(q, kind="stable")
        q, where = q[order], where[order]
        lo, hi = np.searchsorted(q, p, "left"), np.searchsorted(q, p, "right")
        next_at: dict[int, int] = {}  # the first place of each hash that may still be free: a place once marked stays so
        for a, i, j in zip(starts[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
            if not one.free(a, low):
                continue
            k = next_at.get(i, i)
            while k < j and not (two.free(int(where[k]), low) and np.array_equal(item[a : a + low], two.words[where[k] : where[k] + low])):
                k += 1
            next_at[i] = k
            if k < j:
                one.mark(a, low)
                two.mark(int(where[k]), low)
                out.append((a, int(place[where[k]]), low))
        one.settle()
        two.settle()
        top = low - 1
    return out


def most_coverage(item: np.ndarray, grams: np.ndarray, least: int = TILE) -> int:
    """A bound on the words of an item that tiles can cover: those in runs of ``least`` words that ``grams`` (sorted) holds."""
    x = gram_hashes(item, least)
    hit = grams[np.minimum(np.searchsorted(grams, x), len(grams) - 1)] == x if len(grams) else np.zeros(len(x), bool)
    inside = np.zeros(len(item), bool)
    for k in range(least):
        inside[k : k + len(hit)] |= hit
    return int(inside.sum())


class _Items:
    """One block of test items with an index from seed hashes to items; an item with fewer words is one seed of its own length."""

    def __init__(self, ids: list, texts: list):
        self.ids, self.words = ids, hashed(texts)
        self.index = {}
        sizes = np.array([min(SEED, len(w)) for w in self.words], int)
        for n in sorted({*sizes.tolist()} - {0}):
            owners = np.flatnonzero(sizes == n)
            grams = [gram_hashes(self.words[i], int(n)) for i in owners]
            flat, owner = np.concatenate(grams), np.repeat(owners, [len(g) for g in grams])
            order = np.argsort(flat, kind="stable")
            self.index[int(n)] = flat[order], owner[order]

    def candidates(self, doc: np.ndarray) -> np.ndarray:
        """Items that share a seed with the document."""
        out = [np.empty(0, int)]
        for n, (seeds, owner) in self.index.items():
            grams = np.unique(gram_hashes(doc, n))
            at = np.minimum(np.searchsorted(seeds, grams), len(seeds) - 1)
            hit = grams[seeds[at] == grams]
            lo, hi = np.searchsorted(seeds, hit, "left"), np.searchsorted(seeds, hit, "right")
            out += [owner[a:b] for a, b in zip(lo, hi, strict=True)]
        return np.unique(np.concatenate(out))

    def matches(self, doc: np.ndarray, coverage: float) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Items whose tiles cover at least ``coverage`` of their words; items that cannot reach it are not tiled."""
        grams = None
        for i in self.candidates(doc):
            words = self.words[i]
            if len(words) < SEED:
                start = int(np.flatnonzero(gram_hashes(doc, len(words)) == gram_hashes(words, len(words))[0])[0])
                yield int(i), [(0, start, len(words))]
                continue
            grams = np.unique(gram_hashes(doc, TILE)) if grams is None else grams
            if most_coverage(words, grams) < coverage * len(words):
                continue
            found = tiles(words, doc)
            if sum(n for _, _, n in found) >= coverage * len(words):
                yield int(i), found


_TILE = T.StructType([T.StructField(c, T.IntegerType()) for c in ("item_start", "doc_start", "words")])
_HITS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text_md5", T.BinaryType()), T.StructField("item_id", T.LongType()), T.StructField("item_words", T.IntegerType()),
        T.StructField("covered", T.IntegerType()), T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.ArrayType(_TILE)),
    ]
)


def _tile(shared, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: _Items = shared.value
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.struct([(c, pa.int32()) for c in ("item_start", "doc_start", "words")]))]
        for batch in batches:
            rows = []
            for k, doc in enumerate(hashed(batch.column("text").to_pylist())):
                for i, found in items.matches(doc, coverage):
                    covered, size = sum(n for _, _, n in found), len(items.words[i])
                    spans = [{"item_start": a, "doc_start": b, "words": n} for a, b, n in found]
                    rows.append((batch.column("doc_id")[k].as_py(), batch.column("text_md5")[k].as_py(), items.ids[i], size, covered, covered / size, spans))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], _HITS.names)

    return run


def tiling_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Pairs of a document and a test item whose tiles cover at least ``coverage`` of the item's words.

    Columns: ``doc_id``, ``text_md5``, ``item_id``, ``item_words``, ``covered``, ``coverage``, ``tiles`` (item_start,
    doc_start, words). An item with fewer words than a seed matches where all of it stands in a row; null and wordless
    texts match nothing. Items with null ids are kept apart from nothing else: their id is null in the result. Items are
    broadcast in blocks of about ``BLOCK_BYTES`` of text, one after the other, one pass over the documents each; the pairs
    found are written, and the block is dropped before the next.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text_col)).alias("text_md5"), F.col(text_col).alias("text"))
    tests = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("text is not null")
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = None
    for k in range(blocks):
        part = tests.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(_Items([r.item_id for r in part], [r.text for r in part]))
        found = save_stage(rows.mapInArrow(_tile(shared, coverage), _HITS), "tiles")
        shared.destroy()
        out = found if out is None else out.union(found)
    return out


def contamination(docs: DataFrame, items: DataFrame, **columns) -> DataFrame:
    """A row per row of ``docs``: ``doc_id``, ``contaminated``, ``n_items``, ``item_ids`` (sorted) and ``coverage`` (the most, else 0).

    Rows with one id and one text get one answer. Only found pairs are shuffled with the documents' ids, never texts.
    """
    id_col, text_col = columns.get("id_col", "doc_id"), columns.get("text_col", "text")
    pairs = tiling_matches(docs, items, **columns)
    best = pairs.groupBy("doc_id", "text_md5").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("most"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text_col)).alias("text_md5")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_md5") == F.col("p.text_md5"))
    out = rows.join(best.alias("p"), same, "left")
    return out.select(
        "d.doc_id", "d.text_md5", F.col("most").isNotNull().alias("contaminated"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("most", F.lit(0.0)).alias("coverage"),
    )


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Which texts of ``documents`` hold passages of ``benchmark``."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).drop("text_md5")
