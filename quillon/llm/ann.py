"""Nearest neighbours by multi-index hashing of learned binary codes.

Codes are signs of rotated principal components (the rotations are learned by iterative quantisation on a bounded sample). A
code is split into substrings, each with a table from its values to rows. A code within a Hamming radius r of a query's
agrees with it up to r // substrings bits in at least one substring, so probing that ball in every table finds every such
row (pigeonhole). A ball of fewer values than a table has is looked up value by value; of a larger one, the table's values
that lie in it are found. Short substrings have small balls but let many rows through: the fit takes the width that costs
least on its sample, and any width finds the same rows. Only rows that pass the full radius are ranked, by their inner
products in double precision. A query that finds too few widens its radius step by step.

Codes and vectors are dealt over index parts once. Queries come in blocks of bounded size, each broadcast to all parts, and
only the best ``k`` of a query leave a part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.sampling import hash_sample
from quillon.runtime import save_stage, ship_package

#: Long codes tell angles well, so few rows have to be ranked.
BITS = 512
WORDS = BITS // 64
#: Widths that substrings may have.
WIDTHS = (16, 32, 64)
#: Bits by which a query that found too few rows widens its radius.
WIDEN = BITS // 16
#: Expected number of vectors that the rotation and the radius are fitted on (at most twice as many).
FIT_ROWS = 8_000
#: Share of the sample's own nearest neighbours that the radius has to cover.
COVER = 0.985
ROUNDS = 30
#: Rows of an index part that are searched at a time, and queries of a block.
PART_ROWS, BLOCK_QUERIES = 8_192, 4_096


class Coder:
    """Binary codes of vectors: rotated principal components of the vectors lifted to one norm.

    The lift appends sqrt(M^2 - |x|^2) to stored vectors and 0 to queries, so nearness of directions is nearness by inner
    product even where norms differ.
    """

    def __init__(self, sample: np.ndarray, longest: float, seed: int = 5):
        self.longest, self.width = longest, 64
        x = self.lift(sample)
        rng = np.random.default_rng(seed)
        self.mean = x.mean(axis=0)
        z = x - self.mean
        _, vectors = np.linalg.eigh(z.T @ z)
        basis = vectors[:, ::-1][:, :BITS]
        turns = []
        while sum(t.shape[1] for t in turns) < BITS:  # fewer dimensions than bits: several rotations
            v = z @ basis
            r, _ = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))
            for _ in range(ROUNDS):
                u, _, wt = np.linalg.svd(np.sign(v @ r).T @ v)
                r = (u @ wt).T
            turns.append(basis @ r)
        self.turn = np.hstack(turns)[:, :BITS]

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        if query:
            norms = np.linalg.norm(x, axis=1, keepdims=True)
            return np.hstack([x * (self.longest / np.where(norms > 0, norms, 1)), np.zeros((len(x), 1))])
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        return np.hstack([x, rest[:, None]])

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """The code of each row as ``WORDS`` 64-bit integers."""
        bits = np.packbits((self.lift(x, query) - self.mean) @ self.turn > 0, axis=1)
        return np.ascontiguousarray(bits).view(np.uint64)


def substrings(codes: np.ndarray, width: int) -> np.ndarray:
    """Each code (the last axis) as substrings of ``width`` bits."""
    return codes.view(np.dtype(f"u{width // 8}"))


def ball_size(width: int, radius: int) -> int:
    return sum(math.comb(width, i) for i in range(min(width, radius) + 1))


@cache
def ball(width: int, radius: int) -> np.ndarray:
    """All values of at most ``radius`` set bits; best asked for after :func:`ball_size`."""
    masks = [sum(1 << b for b in bits) for i in range(min(width, radius) + 1) for bits in combinations(range(width), i)]
    return np.array(masks, np.dtype(f"u{width // 8}"))


def cheapest_width(asked: np.ndarray, stored: np.ndarray, radius: int) -> int:
    """The width whose probing touches least in a part: values looked up or compared, and words of the rows found."""
    costs = {}
    for width in WIDTHS:
        parts, most = BITS // width, radius * width // BITS
        a, b = substrings(asked, width), substrings(stored, width)
        found = np.mean([(np.bitwise_count(b ^ row) <= most).any(axis=1).mean() for row in a])
        costs[width] = parts * min(ball_size(width, most), PART_ROWS) + found * PART_ROWS * WORDS
    return min(costs, key=lambda w: (costs[w], -w))


def fit(sample: np.ndarray, longest: float, k: int) -> tuple[Coder, int]:
    """A coder with its width of substrings, and the radius that covers ``COVER`` of the sample's nearest neighbours."""
    coder = Coder(sample, longest)
    probes = sample[:: max(1, len(sample) // 300)]
    near = np.argsort(-(probes @ sample.T), axis=1)[:, : k + 1]
    a, b = coder.codes(probes, True), coder.codes(sample)
    distance = np.bitwise_count(a[:, None, :] ^ b[near]).sum(axis=2)
    radius = int(np.quantile(distance, COVER, method="higher"))
    coder.width = cheapest_width(a[:: max(1, len(a) // 50)], b, radius)
    return coder, radius


class Index:
    """The codes of some rows, and for each substring its distinct values in order with the rows of each.

    ``looked_up`` counts the values that lookups asked for, ``compared`` those that were compared where the ball is larger than
    the table, ``checked`` the rows whose whole codes were then compared.
    """

    def __init__(self, codes: np.ndarray, width: int = 64):
        self.codes, self.width, self.tables = codes, width, []
        for column in substrings(codes, width).T:
            order = np.argsort(column, kind="stable")
            values, starts = np.unique(column[order], return_index=True)
            self.tables.append((values, np.append(starts, len(order)), order))
        self.looked_up = self.compared = self.checked = 0

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows with a substring in the ball of radius // substrings around the query's."""
        mask, most = np.zeros(len(self.codes), bool), radius // len(self.tables)
        size = ball_size(self.width, most)
        for own, (values, starts, order) in zip(substrings(code, self.width), self.tables, strict=True):
            if size < len(values):
                near = ball(self.width, most) ^ own
                at = np.searchsorted(values, near)
                hits = at[values[np.minimum(at, len(values) - 1)] == near]
                n = starts[hits + 1] - starts[hits]
                mask[order[np.arange(n.sum()) + np.repeat(starts[hits] - np.cumsum(n) + n, n)]] = True
                self.looked_up += size
            else:
                inside = np.bitwise_count(values ^ own) <= most
                mask[order[inside if len(values) == len(order) else np.repeat(inside, np.diff(starts))]] = True
                self.compared += len(values)
        found = np.flatnonzero(mask)
        self.checked += len(found)
        return found

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows within the radius of a query's code."""
        found = self.probed(code, radius)
        return found[np.bitwise_count(self.codes[found] ^ code).sum(axis=1) <= radius]


def search(coder: Coder, radius: int, ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple]:
    """(query id, row id, score) of each query's ``k`` best rows within the radius, its own row left out."""
    index, asked = Index(coder.codes(x), coder.width), coder.codes(q, True)
    for i in range(len(qids)):
        for r, score in _best(index, asked[i], radius, ids, x, int(qids[i]), q[i], k):
            yield int(qids[i]), int(ids[r]), float(score)


def _best(index: Index, code: np.ndarray, radius: int, ids: np.ndarray, x: np.ndarray, own: int, vector: np.ndarray, k: int, least: float = -np.inf) -> Iterator[tuple[int, float]]:
    found = index.within(code, radius)
    found = found[ids[found] != own]
    score = (x[found] * vector).sum(axis=1)
    if len(found) > k:
        least = max(least, float(np.partition(score, len(score) - k)[len(score) - k]))
    found, score = found[score >= least], score[score >= least]
    best = np.lexsort((ids[found], -score))[:k]
    return zip(found[best], score[best], strict=True)


def _answers(shared, k: int, width: int):
    """The best ``k`` rows of a partition for each query of a block; the partition is searched ``PART_ROWS`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, keys, vectors, codes, radii = shared.value
        best: list[list[tuple[float, int]]] = [[] for _ in keys]
        for ids, x, index in _parts(batches, width):
            for i in range(len(keys)):
                least = best[i][-1][0] if len(best[i]) == k else -np.inf
                more = _best(index, codes[i], int(radii[i]), ids, x, int(qids[i]), vectors[i], k, least)
                more = [(float(s), int(ids[r])) for r, s in more]
                if more:
                    best[i] = sorted(best[i] + more, key=lambda t: (-t[0], t[1]))[:k]
        n = [len(b) for b in best]
        flat = [t for b in best for t in b]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(keys, n), pa.int64()), pa.array(np.repeat(qids, n), pa.int64()), pa.array([t[1] for t in flat], pa.int64()), pa.array([t[0] for t in flat], pa.float64())],
            ["key", "query_id", "vec_id", "score"],
        )

    return run


def _parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, Index]]:
    held: list[pa.RecordBatch] = []

    def part():
        ids = np.concatenate([b.column("id").to_numpy() for b in held])
        x = np.concatenate([_matrix(b) for b in held])
        codes = np.frombuffer(b"".join(v for b in held for v in b.column("code").to_pylist()), np.uint64).reshape(-1, WORDS)
        held.clear()
        return ids, x, Index(codes, width)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= PART_ROWS:
            yield part()
    if held:
        yield part()


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _coded(coder: Coder, query: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [c.tobytes() for c in coder.codes(_matrix(batch), query)] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], [*batch.schema.names, "code"])

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``vector`` (doubles) of the rows that take part: an id, finite components, not all of them zero."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return v.filter(F.col("id").isNotNull() & finite & F.exists("vector", lambda c: c != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner products that multi-index hashing finds for each row of ``queries``.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``; ties go to the smaller id, and a query's own id is
    never its neighbour. Vectors that are null, zero or hold null or non-finite components take no part, nor do those
    whose length is not the most frequent one (the larger on a tie). A query that finds fewer than ``k`` rows within the
    radius widens it step by step until it has ``k``, or all rows are within. Repeated ids stay separate rows
    of ``vectors``; queries that agree in id and vector are one query, those that agree in id only have an answer each. No
    usable rows give no rows.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    names = "query_id long, rank int, vec_id long, score double"
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, c: s + c * c)).alias("m"))
    top = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return spark.createDataFrame([], names)
    rows, asked = (t.filter(F.size("vector") == top.d) for t in (rows, asked))
    sample = np.array([r.vector for r in hash_sample(rows, "id", FIT_ROWS).orderBy("id").collect()], np.float64)
    coder, radius = fit(sample, float(np.sqrt(top.m)), k)
    dealt = rows.repartition(-(-top.n // PART_ROWS), F.xxhash64("id", "vector"))
    index = save_stage(dealt.mapInArrow(_coded(coder), "id long, vector array<double>, code binary"), "index")
    # a number for each distinct query, saved since a second evaluation might deal others
    asked = asked.distinct().mapInArrow(_coded(coder, True), "id long, vector array<double>, code binary")
    asked = save_stage(asked.withColumn("key", F.monotonically_increasing_id()).withColumn("radius", F.lit(radius)), "asked")
    order = W.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    done = None
    while not asked.isEmpty():
        found = None
        blocks = -(-asked.count() // BLOCK_QUERIES)
        for k_block in range(blocks):
            block = asked.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k_block).toArrow()  # about BLOCK_QUERIES rows
            if not block.num_rows:
                continue
            vectors_ = np.array(block.column("vector").to_pylist(), np.float64)
            codes = np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint64).reshape(-1, WORDS)
            shared = spark.sparkContext.broadcast((*(block.column(c).to_numpy() for c in ("id", "key")), vectors_, codes, block.column("radius").to_numpy()))
            part = index.mapInArrow(_answers(shared, k, coder.width), "key long, query_id long, vec_id long, score double")
            part = save_stage(part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "near")
            shared.destroy()
            found = part if found is None else found.unionByName(part)
        whole = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        known = asked.join(whole, "key", "left").withColumn("short", (F.coalesce("n", F.lit(0)) < min(k, top.n - 1)) & (F.col("radius") < BITS))
        known = save_stage(known, "known")
        ready = found.join(known.filter("not short").select("key"), "key", "left_semi")
        done = ready if done is None else done.unionByName(ready)
        asked = known.filter("short").select("id", "vector", "code", "key", F.least(F.col("radius") + WIDEN, F.lit(BITS)).alias("radius"))
    if done is None:
        return spark.createDataFrame([], names)
    return done.select("query_id", "rank", "vec_id", "score")


def op2_multi_index_hashing(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of all ``embeddings`` for each row whose vec_id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))
