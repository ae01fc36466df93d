"""Near-duplicate segments as one: an exact set-similarity join on tokens, and components of its links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import tokens
from quillon.operators.components import connected_components
from quillon.operators.evaluate import normal_segment
from quillon.runtime import save_measured, save_stage, ship_package

#: Counts of tokens that are kept, by their hash; they order tokens and decide nothing else.
COUNTS = 1 << 20
#: Sets that may meet at one token; a token with more is paired with a second one.
HOT = 300


def prefix_keys(hashes: pa.ListArray, counts: np.ndarray, percent: int, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of sets of 64-bit hashes: (set number, key), and of each set two words whose bits are parities of its hashes.

    Tokens are ordered by their counts. Sets that share ``percent`` % share their least common token within the first
    p = n - ceil(percent n / 100) + 1 of both, and the next common one within p + 1: so a token with more than ``hot``
    counts is keyed together with each token after it there, on both sides alike.
    """
    n = np.diff(hashes.offsets.to_numpy()).astype(np.int64)
    flat = hashes.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    count = counts[flat & (COUNTS - 1)]
    order = np.lexsort((flat, count, row))
    flat, count = flat[order].view(np.uint64), count[order]
    start = np.cumsum(n) - n
    at = np.arange(len(flat)) - start[row]
    p = n - (n * percent + 99) // 100 + 1
    alone = (count <= hot) | (n[row] < 2) | (percent <= 70)  # at 70 % or less, sets that share one token may be alike
    first = at < p[row]
    one, more = np.flatnonzero(first & alone), np.flatnonzero(first & ~alone)
    after = np.minimum(p, n - 1)[row[more]] - at[more]  # tokens behind it, up to place p + 1
    left = np.repeat(more, after)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
    both = (flat[left] ^ (flat[left] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + flat[right]
    bit = (flat >> np.uint64(40)) & np.uint64(127)
    words = np.zeros((2, len(n)), np.uint64)
    for k in range(2):
        if len(flat):
            here = (bit >> np.uint64(6)) == k
            np.bitwise_xor.at(words[k], row[here], np.uint64(1) << (bit[here] & np.uint64(63)))
    return np.concatenate((row[one], row[left])), np.concatenate((flat[one], both)).view(np.int64), words[0].view(np.int64), words[1].view(np.int64)


def similar_sets(nodes: DataFrame, percent: int = 80, hot: int = HOT) -> DataFrame:
    """Pairs (``a`` < ``b``) of ``nodes`` (``node`` long, ``tokens``: distinct) whose Jaccard similarity is at least ``percent`` %.

    Exact, by prefixes (:func:`prefix_keys`): sets meet at rare tokens or at pairs of tokens. In the join itself pairs are
    dropped whose sizes, or whose parities of hashes, differ more than the similarity allows (each token that only one of two
    sets has changes one bit at most), so hardly more than the links leave it. What is left is compared in full.
    """
    ship_package(nodes.sparkSession)
    hashed = nodes.filter(F.size("tokens") > 0).select("node", F.transform("tokens", lambda t: F.xxhash64(t)).alias("h"))
    seen = hashed.select(F.explode("h").alias("h")).groupBy(F.col("h").bitwiseAND(COUNTS - 1).alias("slot")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(COUNTS, np.int64)
    counts[seen.column("slot").to_numpy()] = seen.column("n").to_numpy()
    shared = nodes.sparkSession.sparkContext.broadcast(counts)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, key, s, t = prefix_keys(batch.column("h"), shared.value, percent, hot)
            n = np.diff(batch.column("h").offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("node").take(pa.array(row)), pa.array(n[row]), pa.array(s[row]), pa.array(t[row])], names=["key", "node", "n", "s", "t"])

    # one shuffle serves both sides
    keyed = hashed.mapInArrow(keys, "key long, node long, n int, s long, t long").repartition("key")
    a, b = (keyed.select("key", F.col("node").alias(k), *(F.col(c).alias(f"{c}{k}") for c in "nst")) for k in "ab")
    near = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    apart = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) + F.bit_count(F.col("ta").bitwiseXOR(F.col("tb")))
    # shared tokens s of a link: 100 s >= percent (na + nb - s)
    near = near & ((F.col("na") + F.col("nb") - apart) * (100 + percent) >= 2 * percent * (F.col("na") + F.col("nb")))
    pairs = save_stage(a.join(b, "key").filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct(), "pairs")
    ends = save_measured(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    met = save_measured(nodes.select("node", "tokens").join(ends, "node", "left_semi"), "met")
    ta, tb = (met.select(F.col("node").alias(k), F.col("tokens").alias(f"t{k}")) for k in "ab")
    both = F.size(F.array_intersect("ta", "tb"))
    met = pairs.join(ta, "a").join(tb, "b").withColumn("i", both)
    return met.filter(F.col("i") * 100 >= (F.size("ta") + F.size("tb") - F.col("i")) * percent).select("a", "b")


def near_collapse(segments: DataFrame, percent: int = 80) -> DataFrame:
    """Segments (``review_id``, ``position``, ``segment``) that are alike as one: the first place (``review_id``, ``position``),
    how many segments support it and how many distinct texts they have (case and spacing aside).

    Copies are counted first, then texts with the same tokens; what is left is linked by the Jaccard similarity of its
    tokens, also through others. Texts without tokens are alike only as copies.
    """
    text = normal_segment(F.col("segment"))
    place = F.min(F.struct("review_id", "position"))
    texts = segments.groupBy(text.alias("text")).agg(place.alias("p"), F.count(F.lit(1)).alias("support"))
    words = F.array_sort(F.array_distinct(tokens("text")))
    named = texts.withColumn("tokens", words).withColumn("node", F.md5(F.when(F.size("tokens") > 0, F.concat_ws(" ", "tokens")).otherwise(F.concat(F.lit("text "), "text"))))
    nodes = named.groupBy("node").agg(F.first("tokens").alias("tokens"), F.min("p").alias("p"), F.sum("support").alias("support"), F.count(F.lit(1)).alias("n_texts"))
    # numbers, which are shorter than digests, hold once they are written
    nodes = save_stage(nodes.withColumn("node", F.monotonically_increasing_id()), "segments")
    labels = save_measured(connected_components(similar_sets(nodes.select("node", "tokens"), percent)), "labels")
    joined = nodes.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label"))
    return joined.agg(F.min("p").alias("p"), F.sum("support").alias("support"), F.sum("n_texts").alias("n_texts")).select("p.review_id", "p.position", "support", "n_texts")
