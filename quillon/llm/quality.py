"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.sampling import hash_sample
from quillon.runtime import save_stage, ship_package

#: Expected number of labelled rows that the model is fitted on (at most twice as many).
FIT_ROWS = 60_000
FEATURES = 384
#: Ridge strengths (a row) of which the one with the least leave-one-out error is taken.
RIDGES = (1e-5, 1e-4, 1e-3, 1e-2)
#: Partitions of the fit: each returns one matrix of FEATURES x FEATURES sums to the driver.
FIT_PARTS = 8
#: Steps of the raw score that the calibration is fitted on, over three units.
STEPS = 600

_CLASS = np.zeros(256, np.int8)  # 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 space, 5 newline, 6 everyday punctuation, 7 not ASCII
for _k, _set in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, b" \t\r\x0b\x0c"), (5, b"\n"), (6, b".,;:'\"()-?"), (7, range(128, 256))):
    _CLASS[list(_set)] = _k
STATISTICS = (
    "log_bytes", "log_words", "lower", "upper", "digit", "space", "newline", "punctuation", "not_ascii", "symbol", "bar", "exclamation",
    "word_bytes", "distinct_words", "same_as_before", "same_as_two_before", "log_distinct", "symbol_end", "distinct_lines", "log_line", "entropy",
    "distinct_bytes", "letterless_words", "stops",
)


def statistics(text: str | None) -> list[float]:
    """The ``STATISTICS`` of a whole text; a null text counts as empty."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(1, len(raw))
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=hist, minlength=8) / n
    words = raw.split()
    w = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    p = hist[hist > 0] / n
    distinct = len(set(words))
    ends = sum(1 for x in words if not x[-1:].isalnum() and x[-1] < 128 and x[-1] not in b".,;:'\")?-")
    return [
        math.log1p(len(raw)), math.log1p(len(words)), *kinds[1:4], kinds[4], kinds[5] * 10, kinds[6], kinds[7], kinds[0] * 2,
        hist[124] / w, hist[33] / w, math.log1p(len(raw) / w), distinct / w, sum(map(eq, words, words[1:])) / w, sum(map(eq, words, words[2:])) / w,
        math.log1p(distinct), ends / w, len(set(lines)) / max(1, len(lines)), math.log1p(len(raw) / max(1, len(lines))), float(-(p * np.log2(p)).sum()),
        len(p) / 64, sum(1 for x in words if not x.islower() and not x.isupper() and not x.istitle()) / w, hist[46] / w,
    ]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [statistics(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "stats"])


class Fourier:
    """cos(Wx + b) with Gaussian W: inner products approximate a Gaussian kernel of the standardised statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, width: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.standard_normal((len(mean), FEATURES - len(mean) - 1)) / width
        self.b = rng.uniform(0, 2 * np.pi, FEATURES - len(mean) - 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.w + self.b) * math.sqrt(2 / len(self.b))
        return np.hstack([np.ones((len(x), 1)), z * 0.1, waves])


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, len(STATISTICS)))


def _sums(make):
    """Sums over a partition of the matrices that ``make`` gives for each batch, as one binary row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(_matrix(batch, "stats"), batch.column("label").to_numpy(zero_copy_only=False).astype(float))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def _added(df: DataFrame, make) -> np.ndarray | None:
    rows = [np.frombuffer(r.sums, np.float64) for r in df.mapInArrow(_sums(make), "sums binary").collect()]
    return sum(rows) if rows else None


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and non-decreasing values for points sorted by ``x``."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def _scorer(fourier: Fourier | None, beta: np.ndarray | None, xs: np.ndarray, ys: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = fourier(_matrix(batch, "stats")) @ beta if fourier is not None else np.zeros(batch.num_rows)
            score = np.clip(np.interp(raw, xs, ys), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(raw), pa.array(score)], [*batch.schema.names[:-1], "raw", "score"])

    return run


def _outside(fourier: Fourier, axes: np.ndarray, sizes: np.ndarray, weights: np.ndarray, strengths: np.ndarray):
    """For each ridge strength, the score of each row by the fit without it (``out``) and by the fit with it (``raw``).

    With eigenvectors ``axes`` and eigenvalues ``sizes`` of the gram matrix, a row's leverage h is a weighted sum of squares,
    and leaving the row out moves its score from raw to (raw - h label) / (1 - h).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            p = fourier(_matrix(batch, "stats")) @ axes
            shrunk = 1 / (sizes[:, None] + strengths)
            raw, h = p @ (weights[:, None] * shrunk), np.minimum((p * p) @ shrunk, 1 - 1e-6)
            out = (raw - h * y[:, None]) / (1 - h)
            lists = [pa.array(list(v), pa.list_(pa.float64())) for v in (raw, out)]
            yield pa.RecordBatch.from_arrays([pa.array(y), *lists], ["label", "raw", "out"])

    return run


def _fitted(known: DataFrame, rows: int) -> tuple:
    """Features, weights and calibration from labelled rows of both classes.

    One gram matrix gives the weights and, through leverages, the score of each row by a fit that has not seen it. Those
    scores of all rows choose the ridge and are what the isotonic steps are fitted on, so no row is set apart and both
    classes take part. If they say nothing (one step), the scores by the whole fit are used.
    """
    k = len(STATISTICS)
    moments = _added(known, lambda x, y: np.concatenate(([len(y)], x.sum(axis=0), (x * x).sum(axis=0))))
    n, mean = moments[0], moments[1 : 1 + k] / moments[0]
    scale = np.sqrt(np.maximum(moments[1 + k :] / n - mean**2, 0))
    fourier = Fourier(mean, np.where(scale > 1e-9, scale, 1.0), math.sqrt(k) * 0.7)

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = fourier(x)
        return np.concatenate(((z.T @ z).ravel(), z.T @ y))

    sums = _added(known, normal)
    sizes, axes = np.linalg.eigh(sums[: FEATURES * FEATURES].reshape(FEATURES, FEATURES))
    sizes, weights, strengths = np.maximum(sizes, 0), axes.T @ sums[FEATURES * FEATURES :], np.array(RIDGES) * rows
    left = known.mapInArrow(_outside(fourier, axes, sizes, weights, strengths), "label double, raw array<double>, out array<double>")
    left = save_stage(left, "outside")
    clipped = [F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col("out")[i])) for i in range(len(RIDGES))]
    errors = left.agg(*[F.sum((c - F.col("label")) ** 2).alias(str(i)) for i, c in enumerate(clipped)]).first()
    best = int(np.argmin(errors))
    beta = axes @ (weights / (sizes + strengths[best]))

    def steps(column: str) -> tuple[np.ndarray, np.ndarray]:
        raw = F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col(column)[best]))
        cells = left.groupBy(F.floor(raw * (STEPS / 3)).alias("step")).agg(F.avg(raw).alias("x"), F.avg("label").alias("y"), F.count(F.lit(1)).alias("w")).orderBy("step").collect()
        return isotonic(*(np.array([float(r[c]) for r in cells]) for c in ("x", "y", "w")))

    xs, ys = steps("out")
    if len(ys) == 1 or ys[0] == ys[-1]:
        xs, ys = steps("raw")
    return fourier, beta, xs, ys


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Score every text for the 0/1 label of ``labels``: ``doc_id``, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on)
    and ``text_md5`` (binary, null for a null text).

    Learns from at most ``2 * fit_rows`` labelled rows whose text is in ``docs``: all of them give the ridge weights, and
    their scores by fits that leave each one out give the calibration. Labels other than 0 and 1 and labels of unknown or
    null ids are ignored; an id with several labels counts with each. Without labels every score is 0.5, with one class it
    is that class. Null texts count as empty; repeated rows repeat; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(F.col(text_col))).alias("text_md5"), F.col(text_col).alias("text"))
    stats = save_stage(rows.mapInArrow(_stats, "doc_id long, text_md5 binary, stats array<double>"), "stats")
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).filter("label in (0, 1)")
    known = save_stage(hash_sample(stats.join(marked, "doc_id"), "doc_id", fit_rows).select("label", "stats"), "known").coalesce(FIT_PARTS)
    total, good = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    model = _fitted(known, total) if 0 < good < total else (None, None, np.array([0.0, 1.0]), np.full(2, good / total if total else 0.5))
    scored = stats.mapInArrow(_scorer(*model), "doc_id long, text_md5 binary, raw double, score double")
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_md5")


def learnable_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: crc32(doc_id as text) mod 3 is not 1."""
    return labels.filter("crc32(cast(doc_id as string)) % 3 <> 1")


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality of every text of ``documents``, learned from the labels outside the held-out third."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_scores(docs, learnable_labels(labels))
    return scored.select("doc_id", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False)).alias("held_out"), "score", "predicted")
