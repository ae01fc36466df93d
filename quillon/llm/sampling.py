"""Bounded samples for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARTS = 1_000_000_007
#: Slices that the chosen share of hashes is counted by.
_SLICES = 4096


def hash_sample(df: DataFrame, key: str, rows: int, text: str | None = None, size: int = 0) -> DataFrame:
    """About ``rows`` rows of ``df`` chosen by a hash of ``key``, at most twice as many; with ``text``, about as many as hold
    ``size`` bytes of that column, if these are fewer, and at most twice those bytes.

    The choice depends on keys only, not on partitions or order, and moves no row: a share of the hashes is counted in
    slices, and slices that would lead beyond the bound (as one key that repeats very often can) are left out whole.
    """
    weight = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") if text else F.lit(0)
    n, whole = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    if n <= rows and whole <= size:
        return df
    place = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(_PARTS))
    share = max(1, min(_PARTS, int(_PARTS * min(rows / n, size / whole if whole else 1))))
    at = F.floor(place * F.lit(_SLICES) / F.lit(share)).cast("int")
    chosen = df.filter(place < share)
    taken, held, over = 0, 0, []
    for r in chosen.groupBy(at.alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w")).orderBy("slice").collect():  # at most _SLICES rows
        if taken + r.n > 2 * rows or held + r.w > 2 * size:
            over.append(r.slice)
        else:
            taken, held = taken + r.n, held + r.w
    return chosen.filter(~at.isin(over)) if over else chosen
