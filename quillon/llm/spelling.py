"""Spelling variants: words one edit apart, and the frequent form that each rare one stands for.

Words are compared in dense tiles: padded matrices of code points, of which each pair of rows gets the lengths of its common
prefix and its common suffix. Prefix and suffix that together reach the longer length less one mean a single edit. One of the
two then covers half of the longer word, so only blocks of words that share such a half meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.runtime import save_stage, ship_package

RUN = r"[A-Za-zÀ-ÿ]+"
#: Rows of a side of a tile, and code points of a tile's matrix at most (one row if a word is longer).
TILE_ROWS, TILE_POINTS = 384, 1 << 22
#: Words of a half that are compared as one unit; more are dealt to blocks whose pairs are units of their own.
UNIT_WORDS = 4_096
#: Words of neighbouring units that are compared in one go.
BATCH_WORDS = 8_192

_NEAR = "word string, n_near long, best_n long, best_word string"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(docs: DataFrame, id_col: str, text_col: str, run: str, drop_each: int | None) -> DataFrame:
    """One row a run of letters (``word``), lower-cased.

    With ``drop_each``, a run of which the crc32 of ``<id>:<run>`` is divisible by it loses the code point at that crc32
    modulo its length. A null id is written as nothing.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(run), 0)).alias("w"))
    runs = runs.withColumn("w", lower_ascii(F.col("w")))
    if drop_each is None:
        return runs.select(F.col("w").alias("word"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "w").cast("binary")))
    at = (F.col("h") % F.length("w")).cast("int")
    cut = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    return runs.select(F.when(F.col("h") % drop_each == 0, cut).otherwise(F.col("w")).alias("word"))


def _units(words: DataFrame) -> DataFrame:
    """Each word in the units in which it is compared: ``unit``, ``side``, ``first`` and ``second`` (whether it is in the
    first or second block of the unit), ``word``, ``n``.

    For each length that the longer word of a pair can have (its own, or one more), a word is filed under its first and under
    its last half. Halves that a single word has are left out. A half of many words is dealt to blocks, and each pair of blocks
    is a unit, so no half is compared in one task.
    """
    length = F.length("word")
    longer = F.explode(F.array(length, length + 1)).alias("longer")
    filed = words.select("word", "n", longer).withColumn("half", F.floor(F.col("longer") / 2).cast("int"))
    halves = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), F.col("half")).alias("part")), F.struct(F.lit(1).alias("side"), F.substring("word", F.length("word") - F.col("half") + 1, F.col("half")).alias("part"))))
    filed = filed.select("word", "n", "longer", halves.alias("h")).select("word", "n", "longer", "h.side", "h.part")
    key = ["longer", "side", "part"]
    sizes = filed.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    sized = filed.join(sizes, key).withColumn("blocks", F.ceil(F.col("size") / UNIT_WORDS).cast("int"))
    sized = sized.withColumn("mine", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    met = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    one, two = F.least("mine", "other"), F.greatest("mine", "other")
    unit = F.xxhash64("longer", "side", "part", one, two)
    return met.select(unit.alias("unit"), "side", "longer", F.when(one == two, 2).when(F.col("mine") == one, 0).otherwise(1).alias("block"), "word", "n")


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the common beginning of each row of ``a`` with each row of ``b``; padding never agrees."""
    alive = np.ones((len(a), len(b)), bool)
    total = np.zeros((len(a), len(b)), np.int32)
    for j in range(min(a.shape[1], b.shape[1])):
        alive &= a[:, j, None] == b[None, :, j]
        if not alive.any():
            break
        total += alive
    return total


def padded(points: list[np.ndarray], pad: int) -> np.ndarray:
    """Rows of code points, filled up with ``pad`` (no code point)."""
    out = np.full((len(points), max(map(len, points))), pad, np.int64)
    for i, p in enumerate(points):
        out[i, : len(p)] = p
    return out


class Tiles:
    """Rows sorted by unit, compared in tiles along the diagonal of units."""

    def __init__(self, units: np.ndarray, sides: np.ndarray, longer: np.ndarray, blocks: np.ndarray, words: list[str], n: np.ndarray):
        self.units, self.sides, self.longer, self.blocks, self.words, self.n = units, sides, longer, blocks, words, n
        self.points = [np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.int64) for w in words]
        self.sizes = np.array([len(p) for p in self.points])
        self.found = np.zeros(len(words), np.int64)
        self.best = np.full(len(words), -1, np.int64)

    def cuts(self) -> list[int]:
        """Ends of the tiles: ``TILE_ROWS`` rows, or fewer where words are long."""
        ends, begin, widest = [0], 0, 1
        for i, size in enumerate(self.sizes.tolist()):
            widest = max(widest, size)
            if i > begin and (i - begin >= TILE_ROWS or (i - begin + 1) * widest > TILE_POINTS):
                ends.append(i)
                begin, widest = i, size
        return [*ends, len(self.words)]

    def compare(self, a: slice, b: slice) -> None:
        """All pairs of a row of ``a`` with a later row of ``b`` that are in one unit, and in both of its blocks if it has two."""
        same = self.units[a, None] == self.units[None, b]
        rows_a, rows_b = np.arange(a.start, a.stop), np.arange(b.start, b.stop)
        same &= rows_a[:, None] < rows_b[None, :]
        ka, kb = self.blocks[a, None], self.blocks[None, b]
        same &= (ka == 2) | (ka != kb)
        if not same.any():
            return
        front = common(padded(self.points[a], -1), padded(self.points[b], -2))
        back = common(padded([p[::-1] for p in self.points[a]], -1), padded([p[::-1] for p in self.points[b]], -2))
        long = np.maximum(self.sizes[a, None], self.sizes[None, b])
        near = same & (long == self.longer[a, None]) & (long == self.longer[None, b]) & (front + back >= long - 1)
        # a pair that shares both halves counts on the first side
        near &= np.where(self.sides[a, None] == 0, front >= long // 2, (back >= long // 2) & (front < long // 2))
        for i, j in zip(*np.nonzero(near), strict=True):
            self.link(a.start + int(i), b.start + int(j))

    def link(self, i: int, j: int) -> None:
        if self.words[i] == self.words[j]:
            return
        for x, y in ((i, j), (j, i)):
            self.found[x] += 1
            k = self.best[x]
            if k < 0 or (self.n[y], self.words[k]) > (self.n[k], self.words[y]):
                self.best[x] = y

    def run(self) -> None:
        ends = self.cuts()
        tiles = [slice(x, y) for x, y in zip(ends[:-1], ends[1:], strict=True) if x < y]
        for i, a in enumerate(tiles):
            for b in tiles[i:]:
                if b is not a and self.units[b.start] != self.units[a.stop - 1]:
                    break  # units are runs of rows
                self.compare(a, b)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words within the units of a partition, which are sorted; whole units are compared together."""

    def out(rows: pa.Table) -> pa.RecordBatch:
        c = {k: rows.column(k) for k in rows.column_names}
        t = Tiles(*(c[k].to_numpy() for k in ("unit", "side", "longer", "block")), c["word"].to_pylist(), c["n"].to_numpy())
        t.run()
        hit = np.flatnonzero(t.found)
        best = t.best[hit]
        return pa.RecordBatch.from_arrays([pa.array([t.words[i] for i in hit], pa.string()), pa.array(t.found[hit]), pa.array(t.n[best]), pa.array([t.words[i] for i in best], pa.string())], ["word", "n_near", "best_n", "best_word"])

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        more = pa.Table.from_batches([batch])
        held = more if held is None else pa.concat_tables([held, more])
        if held.num_rows < BATCH_WORDS:
            continue
        units = held.column("unit").to_numpy()
        whole = int(np.searchsorted(units, units[-1]))  # the last unit may go on in the next batch
        if whole:
            yield out(held.slice(0, whole))
            held = held.slice(whole)
    if held is not None and held.num_rows:
        yield out(held)


def near_words(words: DataFrame) -> DataFrame:
    """Words of a table of distinct words (``word``, ``n``) that are one edit from another: ``n_near``, and of the near words
    the one of largest n, ties by code points (``best_word``, ``best_n``)."""
    ship_package(words.sparkSession)
    units = _units(words)
    parts = max(1, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = units.repartition(parts, "unit").sortWithinPartitions("unit")
    found = laid.mapInArrow(_near, _NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best_word").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.w").alias("best_word"), (-F.col("b.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """The end of each word's chain of forms (``word``, ``form``): ``word``, ``root``. Forms lead to ever larger n, so no chain
    is a ring; each round doubles the steps, so a chain of c words takes log2(c) rounds."""
    links = save_stage(forms.filter("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        then = links.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        moved = save_stage(links.join(then, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved")), "roots")
        links = moved.drop("__moved")
        if moved.filter("__moved").isEmpty():
            return links


def spelling_variants(docs: DataFrame, least_length: int = 6, least_n: int = 5, ratio: int = 5, drop_each: int | None = None, run: str = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of all texts with their spelling variants: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are the lower-cased runs of at least ``least_length`` code points and ``least_n`` occurrences. Two are near if one
    inserted, deleted or replaced code point makes one of the other. A word's form is its near word of largest n (ties:
    smallest in code-point order) if that is at least ``ratio`` times its own, else null; its root is the last form that
    following forms leads to, or itself. ``drop_each`` damages some runs first (see :func:`words_of`).

    Null and empty texts have no words; repeated rows count again; an empty table gives an empty result; other columns are
    ignored; words of any length are compared whole.
    """
    runs = words_of(docs, id_col, text_col, run, drop_each)
    words = runs.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_n)
    words = save_stage(words, "words")
    near = save_stage(near_words(words), "near")
    chosen = F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best_word"))
    formed = words.join(near, "word", "left").withColumn("form", chosen)
    formed = save_stage(formed.select("word", "form", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")), "formed")
    joined = formed.join(roots(formed), "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of ``documents``, after the stated damage."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), drop_each=199)


#: Both relations are joins of equal strings here: words less one code point, and words with one code point masked.
ORACLE = r"""
with recursive r as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from documents),
u as (select doc_id, w, count(*) as n from r group by all),
k as (select list_transform(range(256), lambda i: list_reduce([i::ubigint, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, x: case when c % 2 = 1 then xor(c // 2, 3988292384::ubigint) else c // 2 end)) as k),
h as (select w, n, xor(list_reduce(list_concat([4294967295::ubigint], list_transform(range(octet_length(encode(doc_id || ':' || w))), lambda i: (('0x' || substr(hex(encode(doc_id || ':' || w)), 2 * i + 1, 2))::ubigint))),
  lambda c, b: xor(c // 256, k[(xor(c, b) % 256)::bigint + 1])), 4294967295::ubigint) as h from u, k),
d as (select case when h % 199 = 0 then substr(w, 1, (h % length(w))::bigint) || substr(w, (h % length(w))::bigint + 2) else w end as word, n from h),
v as (select word, sum(n)::bigint as n from d where length(word) >= 6 group by 1 having sum(n) >= 5),
p as (select word, n, unnest(range(1, length(word) + 1)) as i from v),
c as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as less, substr(word, 1, i - 1) || chr(1) || substr(word, i + 1) as mask from p),
a as (select distinct c.word as a, v.word as b from c join v on c.less = v.word union select x.word, y.word from c x join c y on x.mask = y.mask and x.word <> y.word),
b as (select a, b from a union select b, a from a),
m as (select a as word, count(*) as n_near, arg_min(b, (-v.n, b)) as w, max(v.n) as bn from b join v on v.word = b.b group by 1),
f as (select v.word, case when bn >= 5 * v.n then w end as form, v.n, coalesce(n_near, 0) as n_near, case when bn >= 5 * v.n then bn end as form_n from v left join m using (word)),
g(word, root) as (select word, word from f union all select g.word, f.form from g join f on f.word = g.root where f.form is not null)
select f.word, form, e.root, f.n, n_near, form_n from f join (select g.word, g.root from g join f on f.word = g.root where f.form is null) e using (word)
"""
