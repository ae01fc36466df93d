"""MinHash near-duplicates with sequential Bayesian verification.

Texts become sets of five-word shingles. Banded MinHash signatures nominate pairs; signatures are compared batch by batch
and a pair is dropped once the posterior probability that its similarity reaches the threshold falls under ``miss``; the
survivors are verified exactly on full shingle sets. Exact copies are one node from the start, so they never meet in pairs.

A bucket of a band is first tested as a star: every member against the bucket's most central one. Verified links are merged,
and only buckets that still hold several components go on: small ones with their pairs across components, large ones joined to
families in which members outside the main component are compared with all others in blocks (by signatures, then exactly),
without a row per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.components import connected_components
from quillon.llm.textscan import gram_hashes, mix, pieces, word_hashes
from quillon.runtime import measured, narrow, save_stage, ship_package, small

WIDTH = 5
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 16
#: Pairs across components (members outside the main component times all members) up to which a bucket emits pairs.
BUCKET_PAIRS = 1024
#: Nodes on the two sides of a block, and shingles on each.
BLOCK_OTHERS, BLOCK_ALL, BLOCK_SHINGLES = 256, 1024, 1_000_000
_MULT = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; fewer words than ``width`` make one shingle, none make none."""
    words = [[] if t is None else t.encode("utf-8", "replace").lower().split() for t in texts]
    full = [i for i, w in enumerate(words) if w]
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for numbers, block in pieces([words[i] for i in full], width - 1):
        hashes, text = word_hashes(block)
        starts = np.searchsorted(text, np.arange(len(numbers) + 1))
        grams = gram_hashes(hashes, width)
        for k, n in enumerate(numbers):
            s, e = starts[k], starts[k + 1]
            found[full[n]].append(grams[s : e - width + 1] if e - s >= width else gram_hashes(hashes[s:e], int(e - s)))
    return [np.unique(f[0] if len(f) == 1 else np.concatenate(f)) if f else np.empty(0, np.uint64) for f in found]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures (one row of 32-bit minima for each non-empty set)."""
    out = np.empty((len(sets), HASHES), np.uint32)
    done = 0
    while done < len(sets):
        end, size = done, 0
        while end < len(sets) and (end == done or size + len(sets[end]) <= 200_000):
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[done:end])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[done:end]])[:-1]))
        for j in range(HASHES):
            out[done:end, j] = np.minimum.reduceat(((x * _MULT[j]) >> np.uint64(32)).astype(np.uint32), starts)
        done = end
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of the key."""
    x = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(sig), 1))
    for r in range(ROWS):
        x = mix(x ^ sig[:, r::ROWS].astype(np.uint64))
    return x.view(np.int64)


def keep_from(threshold: float, miss: float) -> list[int]:
    """For each number of compared batches, the least number of matches that keeps a pair.

    With a uniform prior, after m matches of n the similarity is Beta(m+1, n-m+1), and it reaches t with the probability
    that a Binomial(n+1, t) is at most m.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def _node(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            part = whole.slice(at, 500)
            sets = shingle_sets(part.column("text").to_pylist())
            full = [s for s in sets if len(s)]
            sig = signatures(full) if full else np.empty((0, HASHES), np.uint32)
            keys = band_keys(sig)
            row = iter(range(len(full)))
            rows = [next(row) if len(s) else -1 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("node"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([sig[r].astype(np.uint16).tobytes() if r >= 0 else None for r in rows], pa.binary()),
                    pa.array([keys[r] if r >= 0 else None for r in rows], pa.list_(pa.int64())),
                ],
                ["doc_id", "node", "n_shingles", "sig", "bands"],
            )


def _column(rows: pa.RecordBatch | pa.Table, name: str) -> list:
    return rows.column(name).to_pylist()


def _signatures(rows: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(_column(rows, name)), np.uint16).reshape(rows.num_rows, HASHES)


def _bayes(limits: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _signatures(batch, "sa"), _signatures(batch, "sb")
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k, least in enumerate(limits):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            kept = batch.take(pa.array(alive))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b"), pa.array(matches[alive])], ["a", "b", "matches"])

    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                part = whole.slice(at, 250)
                x, y = shingle_sets(_column(part, "ta")), shingle_sets(_column(part, "tb"))
                both = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)], np.int64)
                either = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)], np.int64) - both
                kept = part.filter(pa.array((100 * both >= percent * either) & (either > 0)))
                yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 100):
            part = whole.slice(at, 100)
            sets = [x.tobytes() for x in shingle_sets(part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], ["node", "held"])


def intersections(xs: list[np.ndarray], ys: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each of ``xs`` with each of ``ys``: products of 0/1 matrices, some columns at a time."""
    fx, fy = np.concatenate(xs), np.concatenate(ys)
    both = np.intersect1d(fx, fy)
    rx, ry = (np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (xs, ys))
    inx, iny = np.isin(fx, both), np.isin(fy, both)
    rx, ry, cx, cy = rx[inx], ry[iny], np.searchsorted(both, fx[inx]), np.searchsorted(both, fy[iny])
    out = np.zeros((len(xs), len(ys)), np.float32)
    for at in range(0, len(both), columns):
        mx, my = np.zeros((len(xs), columns), np.float32), np.zeros((len(ys), columns), np.float32)
        kx, ky = (cx >= at) & (cx < at + columns), (cy >= at) & (cy < at + columns)
        mx[rx[kx], cx[kx] - at] = 1
        my[ry[ky], cy[ky] - at] = 1
        out += mx @ my.T
    return out


def likely(xs: np.ndarray, ys: np.ndarray, limits: list[int]) -> np.ndarray:
    """Which pairs of signatures (rows of both sides) the sequential comparison keeps: batches of all pairs at once."""
    matches, alive = np.zeros((len(xs), len(ys)), np.int16), np.ones((len(xs), len(ys)), bool)
    for k, least in enumerate(limits):
        for j in range(k * BATCH, (k + 1) * BATCH):
            matches += xs[:, j, None] == ys[None, :, j]
        alive &= matches >= least
        if not alive.any():
            break
    return alive


def _candidates(limits: list[int]):
    """The nodes of a block's two sides that have a likely partner in another component."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            sides = [np.array(_column(t, "comp"), object) for t in (left, right)]
            alive = likely(_signatures(left, "sig"), _signatures(right, "sig"), limits) & (sides[0][:, None] != sides[1][None, :])
            for side, (rows, axis) in enumerate(((left, 1), (right, 0))):
                kept = rows.select(["family", "bx", "by", "node", "comp"]).filter(pa.array(alive.any(axis=axis)))
                found.append(kept.append_column("side", pa.array(np.full(kept.num_rows, side, np.int32))))
        return pa.concat_tables(found) if found else _NONE

    return run


_CANDIDATE = "family binary, bx int, by int, node binary, comp binary, side int"
_NONE = pa.table({"family": pa.array([], pa.binary()), "bx": pa.array([], pa.int32()), "by": pa.array([], pa.int32()), "node": pa.array([], pa.binary()), "comp": pa.array([], pa.binary()), "side": pa.array([], pa.int32())})


def _linked(percent: int):
    """Links between the two sides of a block by full sets, for each node of the first at most one with each component."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        links = []
        if left.num_rows and right.num_rows:
            xs, ys = ([np.frombuffer(v, np.uint64) for v in _column(t, "held")] for t in (left, right))
            total = np.array([len(v) for v in xs], np.float32)[:, None] + np.array([len(v) for v in ys], np.float32)
            both = intersections(xs, ys)
            mine, theirs, a, b = _column(left, "comp"), _column(right, "comp"), _column(left, "node"), _column(right, "node")
            for i, row in enumerate(100 * both >= percent * (total - both)):
                seen = {mine[i]}
                for k in np.flatnonzero(row):
                    if theirs[k] not in seen:
                        seen.add(theirs[k])
                        links.append((a[i], b[k]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})

    return run


class _Linker:
    """The tables of one run: sketches, node texts, and verified links so far."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, threshold: float, miss: float):
        ship_package(docs.sparkSession)
        self.percent = round(100 * threshold)
        self.limits = keep_from(threshold, miss)
        base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _node(F.col(text_col)).alias("node"))
        kinds = "doc_id long, node binary, n_shingles long, sig binary, bands array<long>"
        self.texts = base.select("node", "text").filter("node is not null")
        self.rows = save_stage(base.select("doc_id", "text", "node").mapInArrow(_sketch, kinds), "sketch")
        found = self.rows.filter("n_shingles > 0")
        self.nodes = found.select("node", "n_shingles", "bands").dropDuplicates(["node"])
        self.sigs = found.select("node", "sig").dropDuplicates(["node"])
        self.links: DataFrame | None = None

    def buckets(self) -> DataFrame:
        """Members of the buckets with several nodes: key, node, n_shingles, score, and the bucket's centre.

        A node's score is the size of all its buckets together: it is largest for the text that the copies in a family were
        made from, or the one nearest to it. The centre of a bucket is its member with the best score.
        """
        self.nodes = save_stage(self.nodes, "nodes")
        members = self.nodes.select(F.explode("bands").alias("key"), "node", "n_shingles")
        sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        members = save_stage(members.join(sizes, "key"), "shared")
        scores = members.groupBy("node").agg(F.sum("size").alias("score"))
        return save_stage(self.centred(members.drop("size").join(scores, "node")), "buckets")

    @staticmethod
    def centred(members: DataFrame) -> DataFrame:
        best = members.groupBy("key").agg(F.max(F.struct("score", "node")).alias("best"))
        return members.join(best.select("key", F.col("best.node").alias("centre")), "key")

    def survivors(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that the sequential comparison keeps, with their matches."""
        sa = self.sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
        sb = self.sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
        return pairs.join(sa, "a").join(sb, "b").mapInArrow(_bayes(self.limits), "a binary, b binary, matches long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose full shingle sets reach the threshold."""
        rows = pairs.count()
        need = save_stage(narrow(pairs, rows).select(F.explode(F.array("a", "b")).alias("node")).distinct(), "need")
        texts = self.texts.join(small(need, 2 * rows), "node", "left_semi").dropDuplicates(["node"])
        texts = save_stage(texts, "texts")
        ta = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        tb = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        return pairs.select("a", "b").join(ta, "a").join(tb, "b").mapInArrow(_exact(self.percent), "a binary, b binary")

    def labels(self) -> DataFrame:
        return save_stage(connected_components(self.links), "labels")

    def link(self, pairs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
        """Add the verified links among ``pairs`` that matter for components; returns the labels.

        Without ``labels`` each node's most similar pair is verified first; then come the pairs that still join two
        components.
        """
        alive = save_stage(self.survivors(pairs), "alive")
        if labels is None:
            rows = alive.count()
            few = narrow(alive, rows)
            ends = few.select("a", "b", "matches", F.explode(F.array("a", "b")).alias("node"))
            best = ends.groupBy("node").agg(F.max(F.struct("matches", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
            best = save_stage(best, "best")
            self.add(save_stage(self.verified(best), "links"))
            labels = self.labels()
            rest = self.across(few, narrow(labels, rows)).select("a", "b").join(narrow(best, rows), ["a", "b"], "left_anti")
            alive = save_stage(rest, "across")
        if alive.isEmpty():
            return labels
        self.add(save_stage(self.verified(alive), "links"))
        return self.labels()

    def add(self, links: DataFrame) -> None:
        self.links = links if self.links is None else self.links.union(links)

    @staticmethod
    def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        la = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        lb = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        known = pairs.join(la, "a", "left").join(lb, "b", "left")
        return known.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).drop("la", "lb")

    @staticmethod
    def open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components; adds ``comp``, the bucket's most frequent one (``main``) and
        the number of members (``size``) and of those outside that (``others``)."""
        named = members.drop("comp", "main", "others", "size").join(labels.withColumnRenamed("label", "comp"), "node", "left")
        named = named.withColumn("comp", F.coalesce("comp", "node"))
        parts = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
        wide = parts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("size")).filter("size > top.n")
        return named.join(wide.select("key", F.col("top.comp").alias("main"), "size", (F.col("size") - F.col("top.n")).alias("others")), "key")

    def within_families(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """All links across components among nodes whose large buckets hang together (a family).

        Members outside a family's main component meet all its members in blocks of bounded size, where signatures are
        compared in batches. Only nodes that have a likely partner in a block get their full shingle sets there, which are
        compared by matrix products, so no pair is ever a row.
        """
        linked = members.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
        family = connected_components(linked).withColumnRenamed("label", "family")
        pool = members.select("node", "comp", "n_shingles").distinct().join(family, "node")
        parts = pool.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s")).groupBy("family")
        parts = parts.agg(F.max(F.struct("n", "comp", "s")).alias("top"), F.sum("n").alias("size"), F.sum("s").alias("s"))
        # sides of a block are bounded by nodes and by shingles
        nx = F.ceil(F.greatest((F.col("size") - F.col("top.n")) / BLOCK_OTHERS, (F.col("s") - F.col("top.s")) / BLOCK_SHINGLES)).cast("int")
        ny = F.ceil(F.greatest(F.col("size") / BLOCK_ALL, F.col("s") / BLOCK_SHINGLES)).cast("int")
        parts = parts.select("family", F.col("top.comp").alias("main"), nx.alias("nx"), ny.alias("ny"))
        pool = save_stage(pool.join(parts, "family").join(self.sigs, "node"), "pool")

        def place(n):
            return F.pmod(F.xxhash64("node"), n).cast("int")

        one = pool.filter("comp <> main").select("family", "node", "comp", "sig", place(F.col("nx")).alias("bx"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("by"))
        two = pool.select("family", "node", "comp", "sig", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("bx"), place(F.col("ny")).alias("by"))
        keys = ["family", "bx", "by"]
        near = save_stage(one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInArrow(_candidates(self.limits), _CANDIDATE), "candidates")
        need = save_stage(near.select("node").distinct(), "need")
        texts = self.texts.join(measured(need), "node", "left_semi").dropDuplicates(["node"])
        held = near.join(save_stage(texts.mapInArrow(_sets, "node binary, held binary"), "held"), "node")
        one, two = (held.filter(F.col("side") == k).toDF(*held.columns) for k in (0, 1))
        return one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInArrow(_linked(self.percent), "a binary, b binary")

    def pairs_within(self, members: DataFrame) -> DataFrame:
        """Pairs across components within buckets that have at most ``BUCKET_PAIRS`` of them."""
        few = members.filter(F.col("others") * F.col("size") <= BUCKET_PAIRS)
        x = few.filter("comp <> main").select("key", "main", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("n_shingles").alias("na"), F.col("centre").alias("xc"))
        y = few.select("key", F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("n_shingles").alias("nb"))
        near = (100 * F.col("na") >= self.percent * F.col("nb")) & (100 * F.col("nb") >= self.percent * F.col("na"))
        once = (F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))
        tested = F.coalesce((F.col("a") == F.col("xc")) | (F.col("b") == F.col("xc")), F.lit(False))
        return x.join(y, "key").filter((F.col("ca") != F.col("cb")) & near & once & ~tested).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def run(self) -> DataFrame:
        """Labels of all nodes that have a link."""
        members = self.buckets()
        stars = members.filter("node <> centre").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
        labels = self.link(stars)
        rest = save_stage(self.open_buckets(members, labels), "open")
        if rest.isEmpty():
            return labels
        labels = self.link(self.pairs_within(rest), labels)
        large = rest.filter(F.col("others") * F.col("size") > BUCKET_PAIRS)
        if large.isEmpty():
            return labels
        large = save_stage(self.open_buckets(large, labels), "large")
        self.add(save_stage(self.within_families(large, labels), "links"))
        return self.labels()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75, miss: float = 1e-6) -> DataFrame:
    """Group documents whose five-word shingle sets have a Jaccard similarity of at least ``threshold`` into components.

    Returns a row per row of ``docs``: ``doc_id``, ``text_md5`` (binary, null for a null text), ``n_shingles``,
    ``component_id`` (least doc_id reachable, itself included) and ``kept`` (doc_id = component_id).

    Words are runs of bytes other than ASCII white space, after lower-casing A-Z. A text with fewer than five words is one
    shingle. Null or blank texts have no shingles and link with nothing. A null id takes part in links, is never a
    component's id unless the component has no other, and is kept then. Rows with one id and one text get one answer; other
    columns are ignored; no rows give no rows. ``miss`` is the chosen posterior probability at which a pair is dropped.
    """
    run = _Linker(docs, id_col, text_col, threshold, miss)
    labels = run.run()
    groups = run.rows.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    named = groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    joint = named.filter(F.col("label") != F.col("node")).select("label").distinct().withColumn("joint", F.lit(True))
    named = save_stage(named.join(joint, "label", "left").filter("copies > 1 or joint"), "groups")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    known = named.select("node", "label").join(least, "label").select("node", "component_id")
    out = run.rows.select("doc_id", "node", "n_shingles").join(known, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", F.col("node").alias("text_md5"), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
    )


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
