"""Ranked lexical search by branch and bound over document tries.

The terms of the items are ordered by document frequency, and each document is reduced to those that it holds, in that
order. A block of such vectors, sorted, is a compact FP-tree: a node is a run of vectors with a common beginning, and its
children are the runs that differ in the term that follows. For all documents below a node the greatest tf of each term and
the smallest length norm ``m`` bound every item's score. The tree is walked depth first with the items that can still win;
at a single document the bound is its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.runtime import save_stage, ship_package

#: Maximal runs of letters and digits of ASCII and of all other characters beyond it.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Bytes of item texts that are searched for in one pass over the documents; more items take more passes.
ITEM_BYTES = 16 << 20
#: Postings of a tree; a document with more makes a tree of its own.
TREE_POSTINGS = 2_000_000
#: A null id in ties: after all others.
_LAST = np.iinfo(np.int64).max

_VECTOR = "doc_id long, n long, terms array<int>, tfs array<int>"
_FOUND = "item_id long, doc_id long, score long"


def terms_of(text: str | None) -> list[str]:
    """The terms of a whole text, repeats kept; only A-Z are lower-cased."""
    return TERM.findall(text.translate(_LOWER)) if text else []


def _vectors(numbers: Broadcast):
    """Each document's number of terms, and the numbers and occurrences of those that the items have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in batches:
            count, terms, tfs = [], [], []
            for text in batch.column("text").to_pylist():
                found = terms_of(text)
                tally = Counter(found)
                mine = [(known[t], k) for t, k in tally.items() if t in known]
                count.append(len(found))
                terms.append([a for a, _ in mine])
                tfs.append([k for _, k in mine])
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return run


class Best:
    """The ``k`` best documents of each item so far: scores downwards, equal scores by id."""

    def __init__(self, items: int, k: int):
        self.scores = np.zeros((items, k), np.int64)
        self.ids = np.full((items, k), _LAST, np.int64)

    def open(self, items: np.ndarray, bound: np.ndarray, least_id: int) -> np.ndarray:
        """Which of ``items`` a document of at most this score and at least this id can still enter."""
        last = self.scores[items, -1]
        return (bound > last) | ((bound == last) & (bound > 0) & (least_id < self.ids[items, -1]))

    def add(self, items: np.ndarray, scores: np.ndarray, doc_id: int) -> None:
        s = np.hstack([self.scores[items], scores[:, None]])
        d = np.hstack([self.ids[items], np.full((len(items), 1), doc_id, np.int64)])
        order = np.lexsort((d, -s), axis=-1)[:, :-1]
        self.scores[items], self.ids[items] = np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)


class Items:
    """Terms of all items, by rank, one after another: a document's bound for any of them is a sum over its slice."""

    def __init__(self, lists: list[np.ndarray], weights: np.ndarray):
        self.start = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        self.terms = np.concatenate(lists) if lists else np.empty(0, np.int64)
        self.weights = weights

    def bounds(self, items: np.ndarray, tf: np.ndarray, m: int) -> np.ndarray:
        """The items' scores of a document with these occurrences by term rank; every item has a term."""
        size = self.start[items + 1] - self.start[items]
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        terms = self.terms[np.repeat(self.start[items] - begin, size) + np.arange(size.sum())]
        t = tf[terms]
        part = np.zeros(len(t), np.int64)
        some = np.flatnonzero(t)
        x = t[some]
        part[some] = self.weights[terms[some]] * ((1_000_000_000 * x) // (1000 * x + 8 * m))
        return np.add.reduceat(part, begin)


class Tree:
    """A block of documents as sorted vectors of term ranks (most frequent first), walked as a trie."""

    def __init__(self, docs: list[tuple[int, int, np.ndarray, np.ndarray]]):
        # big-endian ranks sort as the sequences do; among equal vectors ids go upwards
        docs = sorted(docs, key=lambda d: (d[2].astype(">i4").tobytes(), d[0]))
        self.ids = np.array([d[0] for d in docs], np.int64)
        self.m = np.array([d[1] for d in docs], np.int64)
        self.start = np.concatenate(([0], np.cumsum([len(d[2]) for d in docs]))).astype(np.int64)
        self.terms = np.concatenate([d[2] for d in docs])
        self.tfs = np.concatenate([d[3] for d in docs])

    def _children(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """The runs of documents that agree one term further than all of ``lo`` to ``hi`` do; equal vectors are halved."""
        a, b = self.terms[self.start[lo] : self.start[lo + 1]], self.terms[self.start[hi - 1] : self.start[hi]]
        n = min(len(a), len(b))
        apart = np.flatnonzero(a[:n] != b[:n])
        depth = int(apart[0]) if len(apart) else n
        if depth == len(a) == len(b):
            return [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
        at = self.start[lo:hi] + depth
        ended = at >= self.start[lo + 1 : hi + 1]
        following = np.where(ended, -1, self.terms[np.minimum(at, len(self.terms) - 1)])
        cuts = [lo, *(lo + 1 + np.flatnonzero(following[1:] != following[:-1])).tolist(), hi]
        return list(zip(cuts[:-1], cuts[1:], strict=True))

    def search(self, items: Items, best: Best, tf: np.ndarray, counts: Counter) -> None:
        """Put the best documents of this block into ``best``. ``tf`` is a row of zeros, and is one again at the end."""
        todo = [(0, len(self.ids), np.arange(len(items.start) - 1))]
        while todo:
            lo, hi, some = todo.pop()
            a, b = self.start[lo], self.start[hi]
            np.maximum.at(tf, self.terms[a:b], self.tfs[a:b])
            bound = items.bounds(some, tf, int(self.m[lo:hi].min()))
            tf[self.terms[a:b]] = 0
            keep = best.open(some, bound, int(self.ids[lo:hi].min()))
            counts["nodes"] += 1
            counts["bounds"] += len(some)
            if not keep.any():
                continue
            some = some[keep]
            if hi - lo == 1:
                best.add(some, bound[keep], int(self.ids[lo]))
                counts["scored"] += len(some)
            else:
                todo += [(x, y, some) for x, y in reversed(self._children(lo, hi))]


def _search(shared: Broadcast, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rank, weights, lists = shared.value
        items, best = Items(lists, weights), Best(len(lists), k)
        tf, block, size, counts = np.zeros(len(rank), np.int64), [], 0, Counter()

        def done() -> None:
            nonlocal block, size
            if block:
                Tree(block).search(items, best, tf, counts)
            block, size = [], 0

        for batch in batches:
            doc_ids, sizes = batch.column("doc_id").to_pylist(), batch.column("n").to_pylist()
            terms, tfs = batch.column("terms"), batch.column("tfs")
            at = terms.offsets.to_numpy()
            all_terms = rank[terms.values.to_numpy()]
            all_tfs = tfs.values.to_numpy().astype(np.int64)
            for i, (doc_id, n) in enumerate(zip(doc_ids, sizes, strict=True)):
                a, b = at[i], at[i + 1]
                if a == b:
                    continue
                order = np.argsort(all_terms[a:b])
                block.append((_LAST if doc_id is None else doc_id, 100 - 90 + 90 * n * n_docs // n_terms, all_terms[a:b][order], all_tfs[a:b][order]))
                size += b - a
                if size >= TREE_POSTINGS:
                    done()
        done()
        item, place = np.nonzero(best.scores)
        ids = best.ids[item, place]
        columns = [pa.array(names[item]), pa.array(ids, mask=ids == _LAST), pa.array(best.scores[item, place])]
        yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])

    return run


def _blocks(items: DataFrame) -> list[DataFrame]:
    """The items in blocks of about ``ITEM_BYTES`` of text; all texts of an item are in one block."""
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-total // ITEM_BYTES)
    return [items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) for i in range(n)] if n > 1 else [items]


def ranked_search(docs: DataFrame, items: DataFrame, topk: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``topk`` documents of highest score above 0 for each item: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``.

    With N documents that hold a term, L terms in all of them, n in one document, df documents with a term and tf of its
    occurrences in one: a term's weight is w = floor(1000 ln((2N + 2) / (2 df + 1))), a document's norm m = 10 + 90 n N div L,
    its score the sum of w ((10^9 tf) div (1000 tf + 8 m)) over an item's distinct terms.

    Equal scores go by id, null ids last. Null and empty texts are documents without terms, which count in nothing; items
    without terms find nothing; repeated document rows are documents of their own, repeated item rows are searched once,
    an item id with several texts by all their terms together; null item ids are left out. An empty table on either side
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).filter("item_id is not null and text is not null").distinct()
    asked = save_stage(asked, "items")
    found = None
    for block in _blocks(asked):
        part = _ranked(rows, block, topk)
        if part is not None:
            found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))  # cut to topk before the shuffle
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= topk).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _ranked(rows: DataFrame, block: DataFrame, topk: int) -> DataFrame | None:
    """Each task's best documents for one block of items."""
    spark = rows.sparkSession
    of: dict[int, set[str]] = {}
    for r in block.toLocalIterator():  # a block is bounded by ITEM_BYTES
        of.setdefault(r.item_id, set()).update(terms_of(r.text))
    numbers = {t: i for i, t in enumerate(sorted(set().union(*of.values())))} if of else {}
    if not numbers:
        return None
    known = spark.sparkContext.broadcast(numbers)
    vectors = save_stage(rows.mapInArrow(_vectors(known), _VECTOR), "vectors")
    n_docs, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(numbers), np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():  # at most the block's terms
        df[r.term] = r.df
    order = np.lexsort((np.arange(len(df)), -df))
    rank = np.empty(len(df), np.int32)
    rank[order] = np.arange(len(df), dtype=np.int32)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df[order].tolist()], np.int64)
    names = sorted(i for i, terms in of.items() if terms)
    lists = [np.array(sorted(rank[numbers[t]] for t in of[i]), np.int64) for i in names]
    shared = spark.sparkContext.broadcast((np.array(names, np.int64), rank, weights, lists))
    return vectors.filter(F.size("terms") > 0).mapInArrow(_search(shared, n_docs, max(1, n_terms), topk), _FOUND)


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The ten documents of highest score for each item of ``benchmark``, over all of ``documents``."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return ranked_search(docs, items)


ORACLE = r"""
with w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents where text is not null),
s as (select count(*)::bigint as nn, sum(len(w))::bigint as ll from w where len(w) > 0),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
p as (select doc_id, n, t, count(*) as tf from (select doc_id, len(w) as n, unnest(w) as t from w) where t in (select t from q) group by all),
d as (select t, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)))::bigint as wt from p, s group by t, nn),
c as (select doc_id, t, wt * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))) as c from p join d using (t), s),
r as (select item_id, doc_id, sum(c)::bigint as score from q join c using (t) group by all)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from r where score > 0) where rank <= 10
"""
