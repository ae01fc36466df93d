"""Text columns: tokens, snippets, keyword cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column | str, stop: list[str] | None = None) -> Column:
    """Lower-case word tokens of a text, repeats kept; null gives none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(TOKEN), 0)
    if stop:
        found = F.filter(found, lambda t: ~t.isin(stop))
    return found


def first_hit(text: Column, query_tokens: Column) -> Column:
    """The first query token that is a substring of the lower-cased text; null if none is."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.get(F.filter(query_tokens, lambda t: F.contains(low, t)), F.lit(0))


def snippet(text: Column, hit: Column, window: int = 100) -> Column:
    """Text around the first place of ``hit``, which is set in ``**``; cut sides get an ellipsis."""
    n = F.length(text)
    at = F.instr(F.lower(text), hit) - 1
    start, end = F.greatest(F.lit(0), at - window), F.least(n, at + F.length(hit) + window)

    def cut(a: Column, b: Column) -> Column:
        return F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))

    marked = F.concat(cut(start, at), F.lit("**"), cut(at, at + F.length(hit)), F.lit("**"), cut(at + F.length(hit), end))
    found = F.concat(F.when(start > 0, "…").otherwise(""), marked, F.when(end < n, "…").otherwise(""))
    return F.when(hit.isNotNull(), found).otherwise(F.when(n > 2 * window, F.concat(F.substring(text, 1, 2 * window), F.lit("…"))).otherwise(text))


def aspect_list(text: Column) -> Column:
    """Comma-separated aspects, trimmed, blanks dropped, order and repeats kept."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def clean_keyword(text: Column) -> Column:
    """First line without list marks and surrounding quotes."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    x = F.regexp_replace(F.split_part(x, F.lit("\n"), F.lit(1)), r"^\s+|\s+$", "")
    for pattern in (r"^- +", r"^\* +", r"^\d+\. *", r"^[\"'“”]+|[\"'“”]+$"):
        x = F.regexp_replace(x, pattern, "")
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")
