"""Search index in segments: postings in blocks of reviews, statistics that add up over segments, substrings of terms.

A segment holds the reviews of one load in tables of its own. A version of the index is a list of segments, published when
all their tables are written; what adds up (reviews, words, document frequencies) is added when a version is read. New reviews
make a new segment, and folding replaces the newest segments by one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import tokens
from quillon.runtime import measured, save_measured, save_sized, save_stage, ship_package

EPSILON = 0.25
#: Reviews of a block: their postings of a term are one row.
BLOCK = 16
#: Tokens from which on postings are written as a run, and its rows that travel at once.
RUN_TOKENS, RUN_ROWS = 2_000_000, 100_000
#: Length of the substrings of terms that are filed; longer ones are found by theirs.
GRAM = 3
#: Parts shorter than ``GRAM`` that are compared with every term of the vocabulary; more are looked up by substrings. Also parts
#: of any length that are compared with the terms of postings, if they are in too many terms for a broadcast.
FEW_PARTS = 32
#: Names up to which a table is read by a list of terms, which Parquet's statistics can prune by; the join follows anyhow.
LISTED_TERMS = 1_000
#: A fold takes the newest segments as long as the next older one has at most this many times their reviews.
FOLD_RATIO = 2

_MANIFEST = "folder string, segment long, n_reviews long, words long, id_type string, item_type string, tagged boolean, version long"


@dataclass(frozen=True)
class SearchIndex:
    """One version of an index; readers keep it while later versions are published."""

    spark: SparkSession
    path: str
    version: int
    segments: tuple
    stop: tuple[str, ...] = ()

    @property
    def n_reviews(self) -> int:
        return sum(s.n_reviews for s in self.segments)

    @property
    def mean_tokens(self) -> float | None:
        """Mean tokens of a review; None without reviews."""
        return sum(s.words for s in self.segments) / self.n_reviews if self.n_reviews else None

    def _types(self) -> tuple[str, str]:
        return (self.segments[0].id_type, self.segments[0].item_type) if self.segments else ("bigint", "bigint")

    def _read(self, name: str, schema: str, only: Callable = lambda s: True) -> DataFrame:
        folders = [f"{self.path}/{s.folder}/{name}" for s in self.segments if only(s)]
        reader = self.spark.read.schema(schema)
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    @property
    def reviews(self) -> DataFrame:
        """``review_id``, ``item_id``, ``text``."""
        i, j = self._types()
        return self._read("reviews", f"review_id {i}, item_id {j}, text string")

    @property
    def blocks(self) -> DataFrame:
        """Postings by blocks: ``term``, ``segment``, ``block``, ``max_tf``, ``min_tokens``, ``found`` (a struct a review)."""
        i, j = self._types()
        found = f"array<struct<review_id:{i},item_id:{j},tf:bigint,n_tokens:int>>"
        return self._read("postings", f"term string, segment bigint, block bigint, max_tf bigint, min_tokens int, found {found}")

    @property
    def grams(self) -> DataFrame:
        """``gram`` and the terms that hold it (a term once for each segment)."""
        return self._read("grams", "gram string, term string")

    @property
    def tags(self) -> DataFrame:
        """``tag``, ``review_id``, ``item_id`` of the segments that were tagged."""
        i, j = self._types()
        return self._read("tags", f"tag string, review_id {i}, item_id {j}", lambda s: s.tagged)

    @property
    def vocabulary(self) -> DataFrame:
        """``term``, those of the stop list too (once for each segment)."""
        return self._read("vocabulary", "term string")

    def frequencies(self, names: list[str] | None = None) -> DataFrame:
        """``term``, ``df`` over all segments, of all terms or the named ones."""
        terms = self._read("terms", "term string, df bigint")
        if names is not None:
            terms = terms.filter(F.col("term").isin(names))
        return terms.groupBy("term").agg(F.sum("df").alias("df"))

    def _raw_idf(self) -> Column:
        return F.log(F.lit(self.n_reviews) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)

    @property
    def mean_idf(self) -> float:
        """Mean over all terms before negative ones are replaced; a published version never changes, so it is kept."""
        key = (self.path, self.version)
        if key not in _MEANS:
            _MEANS[key] = self.frequencies().agg(F.avg(self._raw_idf())).first()[0] or 0.0
        return _MEANS[key]

    def terms(self, names: list[str] | None = None) -> DataFrame:
        """``term``, ``df``, ``idf``; a negative idf becomes a quarter of the mean idf over all terms."""
        raw = self._raw_idf()
        return self.frequencies(names).select("term", "df", F.when(raw < 0, F.lit(EPSILON * self.mean_idf)).otherwise(raw).alias("idf"))


_MEANS: dict[tuple[str, int], float] = {}


def _versions(spark: SparkSession, path: str, version: int | None) -> list:
    """Rows of the asked or latest published version."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").collect()  # a row a segment and version
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    version = max((r.version for r in rows), default=None) if version is None else version
    return [r for r in rows if r.version == version]


def open_index(spark: SparkSession, path: str, stop: list[str] | None = None, version: int | None = None) -> SearchIndex:
    """The latest published version of the index at ``path``, or a given one; an index without segments if there is none."""
    rows = _versions(spark, path, version)
    return SearchIndex(spark, path, rows[0].version if rows else -1, tuple(sorted((r for r in rows if r.folder), key=lambda r: r.segment)), tuple(stop or ()))


def _publish(spark: SparkSession, path: str, version: int, segments: list) -> None:
    """Name the segments of a version in one file, which is there whole or not at all. One writer at a time."""
    rows = [tuple(s) for s in segments] or [(None,) * 7]
    frame = spark.createDataFrame(rows, _MANIFEST.rsplit(",", 1)[0])
    frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")


def _substrings(term: Column, size: int) -> Column:
    """Distinct substrings of ``size`` code points."""
    points = F.split(term, "")
    runs = points
    for k in range(1, size):  # pairs, triples, ... of neighbours; those that go beyond the end are null
        runs = F.zip_with(runs, F.slice(points, k + 1, F.size(points)), lambda x, y: F.concat(x, y))
    return F.array_distinct(F.array_compact(runs))


def _pack_rows(rows: pa.Table, segment: int) -> pa.RecordBatch:
    """Postings of whole blocks in the order of terms and blocks: a row a term and block, its reviews by id."""
    rows = rows.take(pc.sort_indices(rows.select(["block", "review_id"]), sort_keys=[("block", "ascending"), ("review_id", "ascending")]))
    ids, items, blocks, sizes, terms = (rows.column(c).combine_chunks() for c in ("review_id", "item_id", "block", "n_tokens", "terms"))
    coded = terms.flatten().dictionary_encode()
    by_term = pc.sort_indices(coded.dictionary)
    place = np.empty(len(by_term), np.int64)
    place[by_term.to_numpy()] = np.arange(len(by_term))
    block = blocks.to_numpy(zero_copy_only=False)
    order = np.cumsum(np.concatenate(([0], block[1:] != block[:-1])))  # the number of a row's block
    n, width = rows.num_rows, int(order[-1]) + 1
    row = np.repeat(np.arange(n), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    keys, tf = np.unique((place[coded.indices.to_numpy()] * width + order[row]) * n + row, return_counts=True)
    row, group = keys % n, keys // n
    starts = np.flatnonzero(np.concatenate((np.ones(len(group[:1]), bool), group[1:] != group[:-1])))
    sizes = sizes.to_numpy(zero_copy_only=False)[row].astype(np.int32)
    taken = pa.array(row)
    found = pa.StructArray.from_arrays([ids.take(taken), items.take(taken), pa.array(tf, pa.int64()), pa.array(sizes)], names=["review_id", "item_id", "tf", "n_tokens"])
    found = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), found)
    most, least = (np.maximum.reduceat(tf, starts), np.minimum.reduceat(sizes, starts)) if len(starts) else (tf, sizes)
    columns = [
        coded.dictionary.take(by_term.take(pa.array(group[starts] // width))), pa.array(np.full(len(starts), segment, np.int64)), pa.array(block[row[starts]], pa.int64()),
        pa.array(most, pa.int64()), pa.array(least, pa.int32()), found,
    ]
    return pa.RecordBatch.from_arrays(columns, names=["term", "segment", "block", "max_tf", "min_tokens", "found"])


def _packed(stored: DataFrame, segment: int, stop: list[str] | None) -> DataFrame:
    """Postings of ``stored`` reviews, packed where they are read: the reviews of a block follow one another in a file.

    They come in runs of ``RUN_TOKENS`` tokens, each in the order of terms. A block that lies in two splits of a file gets two
    rows for a term, each with reviews of its own, which bounds and scores add up as they do with one.
    """
    ship_package(stored.sparkSession)
    terms = stored.select("review_id", "item_id", "block", tokens("text").alias("terms"))
    kept = F.filter("terms", lambda t: ~t.isin(stop)) if stop else F.col("terms")
    types = dict(stored.dtypes)
    found = f"array<struct<review_id:{types['review_id']},item_id:{types['item_id']},tf:bigint,n_tokens:int>>"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                size += pc.sum(batch.column("n_tokens")).as_py()
            if size >= RUN_TOKENS:
                rows = pa.concat_tables(held)
                last = pc.equal(rows.column("block"), rows.column("block")[-1])  # more of it may follow
                held, rows = [rows.filter(last)], rows.filter(pc.invert(last))
                size = pc.sum(held[0].column("n_tokens")).as_py()
                if rows.num_rows:
                    run = _pack_rows(rows, segment)
                    yield from (run.slice(k, RUN_ROWS) for k in range(0, run.num_rows, RUN_ROWS))
        if held:
            run = _pack_rows(pa.concat_tables(held), segment)
            yield from (run.slice(k, RUN_ROWS) for k in range(0, run.num_rows, RUN_ROWS))

    return terms.withColumn("n_tokens", F.size(kept)).mapInArrow(pack, f"term string, segment bigint, block bigint, max_tf bigint, min_tokens int, found {found}")


def write_segment(reviews: DataFrame, path: str, segment: int, stop: list[str] | None = None, tag_model: Callable | None = None) -> tuple:
    """Write the tables of a new segment and return its manifest row (which is not published yet).

    Reviews are dealt to blocks by the size of their texts, so a block's least length says much about all of it. Texts are
    split into tokens once, and postings are packed and written by the tasks that split them, in sorted runs: they are not
    shuffled, and of each run a reader takes only the pages of the terms it asks for. Terms of the stop list keep their
    postings, by which substrings are found, but have no statistics and count in no length.
    """
    spark = reviews.sparkSession
    folder = f"segment-{segment}-{uuid.uuid4().hex}"
    base = f"{path}/{folder}"

    def write(df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.option("compression", "zstd").options(**options).parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    rows = reviews.select("review_id", "item_id", "text").withColumn("size", F.coalesce(F.length("text"), F.lit(0)))
    rows = rows.repartitionByRange("size", "review_id").sortWithinPartitions("size", "review_id")
    # numbers go up by one within a partition, whose first is a multiple of a power of two
    stored = write(rows.withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK)).drop("size"), "reviews")
    # at most BLOCK reviews are in a list; ids and lengths of one repeat too little for a dictionary to pay
    plain = {f"parquet.enable.dictionary#found.list.element.{c}": "false" for c in ("review_id", "item_id", "tf", "n_tokens")}
    postings = write(_packed(stored, segment, stop), "postings", **plain)
    tf = F.col("found.tf")  # nothing else of a list is read
    uses = F.when(F.col("max_tf") == 1, F.size(tf)).otherwise(F.aggregate(tf, F.lit(0).cast("bigint"), lambda n, x: n + x))
    frequencies = postings.groupBy("term").agg(F.sum(F.size(tf)).alias("df"), F.sum(uses).alias("uses"))
    vocabulary = write(frequencies.repartitionByRange("term").sortWithinPartitions("term"), "vocabulary")
    terms = write(vocabulary.filter(~F.col("term").isin(stop)) if stop else vocabulary, "terms")
    grams = vocabulary.select(F.explode(_substrings(F.col("term"), GRAM)).alias("gram"), "term")
    # dealt by hash, as ranges would make the substrings twice; a gram that a great many terms hold goes to several tasks
    write(grams.repartition("gram", F.pmod(F.hash("term"), F.lit(16))).sortWithinPartitions("gram", "term"), "grams")
    if tag_model is not None:
        tag_model(stored.select("review_id", "item_id", "text")).select("tag", "review_id", "item_id").distinct().write.parquet(f"{base}/tags")
    n, words = stored.count(), terms.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    types = dict(reviews.dtypes)
    return folder, segment, n, words, types["review_id"], types["item_id"], tag_model is not None


def build_index(reviews: DataFrame, path: str, stop: list[str] | None = None) -> SearchIndex:
    """The index of ``reviews`` (``review_id``, unique; ``item_id``, ``text``) under ``path``; one that is there is opened.

    Reviews without tokens count in the totals.
    """
    spark = reviews.sparkSession
    index = open_index(spark, path, stop)
    if index.version < 0:
        _publish(spark, path, 0, [write_segment(reviews, path, 0, stop)])
        index = open_index(spark, path, stop)
    return index


def append_reviews(batch: DataFrame, path: str, stop: list[str] | None = None, tag_model: Callable | None = None) -> int:
    """Add the reviews of ``batch`` that the index lacks as a segment; returns how many they are.

    An id is indexed once, whenever and however often it arrives: ids are compared with all that are stored, no matter their
    time. Of several rows of an id in one batch the one with the earliest ``ts`` (nulls last) counts, ties by text and item;
    rows without an id are left out. A batch that comes again after a failure adds what was not published.
    """
    spark = batch.sparkSession
    index = open_index(spark, path, stop)
    first = F.min(F.struct(F.col("ts").isNull().alias("late"), "ts", "text", "item_id")).alias("r")
    rows = batch.filter("review_id is not null").groupBy("review_id").agg(first).select("review_id", "r.item_id", "r.text")
    rows = save_stage(rows, "batch")
    ids = measured(rows.select("review_id"))
    seen = save_measured(index.reviews.select("review_id").join(ids, "review_id", "left_semi"), "seen")  # the index is read, not shuffled
    fresh = rows.join(seen, "review_id", "left_anti")
    row = write_segment(fresh, path, index.version + 1, stop, tag_model)
    if row[2] or index.version < 0:
        _publish(spark, path, index.version + 1, [*map(_fields, index.segments), row])
    return row[2]


def _fields(s) -> tuple:
    return s.folder, s.segment, s.n_reviews, s.words, s.id_type, s.item_type, s.tagged


def fold_segments(spark: SparkSession, path: str, stop: list[str] | None = None, ratio: int = FOLD_RATIO) -> bool:
    """Replace the newest segments by one if the older of them is not much larger; returns whether it did.

    Sizes of segments then fall geometrically, so there are logarithmically many and a review is rewritten as often. Earlier
    versions stay readable until their folders are removed. Tags are carried over, not made again.
    """
    index = open_index(spark, path, stop)
    segments, total, first = list(index.segments), 0, len(index.segments)
    while first and (first == len(segments) or segments[first - 1].n_reviews <= ratio * total):
        first -= 1
        total += segments[first].n_reviews
    if len(segments) - first < 2:
        return False
    some = SearchIndex(spark, path, index.version, tuple(segments[first:]), index.stop)
    tags = some.tags if any(s.tagged for s in some.segments) else None
    row = write_segment(some.reviews, path, index.version + 1, stop, (lambda _: tags) if tags is not None else None)
    _publish(spark, path, index.version + 1, [*map(_fields, segments[:first]), row])
    return True


def listed(terms: DataFrame, name: str = "term") -> list[str] | None:
    """The distinct terms (or grams) of a written table if it has at most ``LISTED_TERMS`` rows."""
    names = [r[0] for r in terms.select(name).limit(LISTED_TERMS + 1).collect()]
    return sorted(set(names)) if len(names) <= LISTED_TERMS else None


def of_terms(table: DataFrame, names: list[str] | None) -> DataFrame:
    return table.filter(F.col("term").isin(names)) if names is not None else table


def _holding(table: DataFrame, parts: list[str]) -> DataFrame:
    """Rows of a table of terms with each ``part`` that their term holds."""
    holds = [F.contains("term", F.lit(p)) for p in sorted(parts)]
    held = F.explode(F.array_compact(F.array(*[F.when(h, F.lit(p)) for h, p in zip(holds, sorted(parts), strict=True)])))
    return table.filter(reduce(Column.__or__, holds)).withColumn("part", held)


def terms_containing(index: SearchIndex, parts: DataFrame) -> DataFrame:
    """Pairs (``part``, ``term``): the terms of the vocabulary that hold each distinct ``part``, a non-empty string.

    Parts of ``GRAM`` code points or more are looked up by all their substrings of that length, and compared; for shorter
    ones the vocabulary is cut into substrings of theirs. Either way parts and terms meet in a join of equal strings; only
    up to ``FEW_PARTS`` short ones are compared with each term, which takes less than cutting it.
    """
    parts = save_measured(parts.select("part", F.length("part").alias("size")).distinct(), "parts")
    grams = parts.filter(F.col("size") >= GRAM).withColumn("grams", _substrings(F.col("part"), GRAM))
    wanted = grams.select("part", F.size("grams").alias("need"), F.explode("grams").alias("gram"))
    wanted = save_measured(wanted, "grams")
    filed, names = index.grams, listed(wanted, "gram")
    filed = filed.filter(F.col("gram").isin(names)) if names is not None else filed
    found = filed.join(wanted, "gram").groupBy("part", "need", "term").agg(F.countDistinct("gram").alias("got"))
    found = found.filter((F.col("got") == F.col("need")) & F.contains("term", "part")).select("part", "term")
    short = [r.part for r in parts.filter(F.col("size") < GRAM).select("part").limit(FEW_PARTS + 1).collect()]
    if len(short) <= FEW_PARTS:
        return found.union(_holding(index.vocabulary, short).select("part", "term")) if short else found
    for size in sorted(r.size for r in parts.filter(F.col("size") < GRAM).select("size").distinct().collect()):  # less than GRAM rows
        cut = index.vocabulary.select("term", F.explode(_substrings(F.col("term"), size)).alias("part"))
        found = found.union(cut.join(parts.filter(F.col("size") == size).select("part"), "part").select("part", "term"))
    return found


def postings_containing(index: SearchIndex, parts: DataFrame) -> DataFrame:
    """Rows of ``parts`` (``part``, a non-empty string, and other columns) with ``term`` and ``found`` of all postings whose term holds
    the part.

    The terms are looked up in the vocabulary and meet their postings in a broadcast join. The terms that hold a common part
    grow with the vocabulary; when they are too many for that, up to ``FEW_PARTS`` parts are compared with the terms of the
    postings where those are read. Only more parts in that many terms take a join that shuffles the postings.
    """
    parts = save_measured(parts, "parts")
    wanted, small = save_sized(terms_containing(index, parts).join(parts, "part"), "wanted")
    postings = index.blocks.select("term", "found")
    if small:
        return of_terms(postings, listed(wanted)).join(F.broadcast(wanted), "term")
    few = [r.part for r in parts.select("part").distinct().limit(FEW_PARTS + 1).collect()]
    return _holding(postings, few).join(parts, "part") if len(few) <= FEW_PARTS else postings.join(wanted, "term")
