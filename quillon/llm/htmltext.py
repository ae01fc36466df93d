"""Main text of web pages by markup and by differencing with the page of the nearest URL.

Each page becomes text lines (one per block). Markup tells what a line is: ``chrome`` (menus, headers, footers, sidebars,
notices, adverts, forms, comments), ``body`` (inside an article or main element), ``maybe`` (inside one, in a block whose name
speaks of sharing, of related pages or of what is chrome elsewhere, like ``notice``) or ``open`` (none of these). Pages are then paired with the neighbour of the most similar
URL path within their host, and the lines of both are aligned by a longest common subsequence. Shared lines are deleted: open
and maybe lines and lines of links at once, prose of a body if it is shared all over the host, since articles quote each other.
Two pages that share nearly all their text are copies or stubs of one template. Stubs are told by their host: of such a pair
open lines, maybe lines and lines of links go that nearly all pages of the host share, in several different pages.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.ranking import range_partitioned
from quillon.runtime import save_stage, ship_package, small

CHROME, OPEN, BODY, LINK, MAYBE = 0, 1, 2, 3, 4
#: Share of a page's lines from which a pair counts as copies, and different pages that show that they are stubs.
COPY_SHARE, COPY_VERSIONS = 0.9, 3
#: Pages of a host (share and least number) that share a line of prose with their pairs, from which it counts as template.
HOST_SHARE, HOST_PAGES = 0.8, 5
#: Bits of alignment masks that are kept at a time.
MASK_BITS = 1 << 28

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\"[^\"<]*\"|'[^'<]*'|[^>\"'<])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*)>|<[!?/][^>]*>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split()
)
_DROP = frozenset("head nav aside footer form menu dialog select button option fieldset".split())
# names in class, id and role of blocks: the first kind marks chrome, the second unless the names also speak of the article
_ALWAYS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer contentinfo ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promotion "
    "comment comments disqus respond reply replies cookie cookies consent gdpr newsletter subscribe subscription share sharing social related recommended recommendations pagination pager".split()
)
# of these, what is no contract of its own: within an article differencing decides, as it does on names of the second kind
_SOCIAL = frozenset("share sharing social related recommended recommendations".split())
_OFTEN = frozenset("header masthead banner notice notices alert complementary widget toolbar search login signup popup modal overlay skip dialog form".split())
_ABOUT = frozenset("article post entry content main story body text title headline".split())
_ANSWER = frozenset("comment comments reply".split())
# parts of a name: "has-sidebar" is what a page has; "ad-slot" is an ad; "sidebar-wrap" is a sidebar, "content-sidebar-wrap" is not
_HAVING = frozenset("has no not with without".split())
_PIECE = frozenset("list item items link links button buttons icon icons bar box banner block section slot unit widget form notice posts thread left right top bottom primary secondary".split())
_WRAP = frozenset("wrap wrapper container holder layout outer inner area".split())

# elements whose end tag may be left out, by what ends them: a sibling's start, up to the nearest of some elements around
_P_ENDS = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre search section summary table ul hr".split()
)
_CELLS = ("td", "th", "caption")
_SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "table", *_CELLS)), "dd": (("dd", "dt"), ("dl", "table", *_CELLS)), "dt": (("dd", "dt"), ("dl", "table", *_CELLS)),
    "tr": (("tr",), ("table",)), "td": (_CELLS, ("table", "tr")), "th": (_CELLS, ("table", "tr")), "option": (("option",), ("select",)),
    **{t: (("tr", "tbody", "thead", "tfoot", "caption"), ("table",)) for t in ("tbody", "thead", "tfoot")},
}
_TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
#: Added to the kind of a line of an article within an element that only its names (or being a form) mark as chrome.
_HELD = 8


def _named(value: str, marks: frozenset) -> bool:
    """Whether a whole name in ``value`` is one of ``marks``, by its last part or by a first part before words of the article."""
    for name in value.split():
        parts = [x.lower() for x in _NAME.findall(name)]
        while len(parts) > 1 and len(parts[-1]) < 2 or parts and parts[-1].isdigit():
            parts.pop()
        if not parts or parts[0] in _HAVING:
            continue
        end = len(parts)
        while end > 1 and (parts[end - 1] in _PIECE or parts[end - 1] in _WRAP) and parts[end - 1] not in marks:
            end -= 1
        if parts[end - 1] in marks and (_ABOUT.isdisjoint(parts[: end - 1]) or _WRAP.isdisjoint(parts[end:])):
            return True
        if end > 1 and parts[0] in marks and _ABOUT.issuperset(parts[1:end]):
            return True
    return False


def _hidden(attrs: str) -> bool:
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs), re.I))


_UNSURE, _SURE, _NAMED = 3, 2, 1


def _is_chrome(tag: str, attrs: str, inside: bool) -> int:
    """Whether a block is chrome: ``_NAMED`` if only its names say so or it is a form (which may hold a whole page), ``_UNSURE`` for blocks of an article that differencing decides on, else ``_SURE``; 0 if not."""
    if (tag in _DROP and tag != "form") or (tag == "header" and not inside) or (attrs and _hidden(attrs)):
        return _SURE
    if tag == "form":
        return _NAMED
    if not attrs:
        return 0
    values = [m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs) if m[1].lower() in ("class", "id") or (m[1].lower() == "role" and tag not in ("article", "main"))]
    if tag in ("article", "main"):
        return _SURE if tag == "article" and any(_named(v, _ANSWER) for v in values) else 0
    if any(_named(v, _ALWAYS - _SOCIAL if inside else _ALWAYS) for v in values):
        return _NAMED
    if inside and any(_named(v, _SOCIAL) for v in values):
        return _UNSURE
    if any(_named(v, _OFTEN) for v in values) and _ABOUT.isdisjoint(x.lower() for v in values for x in _NAME.findall(v)):
        return _UNSURE if inside else _NAMED
    return 0


def page_lines(page: str | None) -> tuple[list[str], list[int]]:
    """Text lines of a page in order and the kind of each.

    Open blocks are kept in a stack and end as in HTML, also where an end tag is left out: with their parent, or at the
    start of a sibling. A stray end tag never closes an article from within. An article in an element that only its names
    mark as chrome is body if no other line is and it has no less text than the open lines; a main element always is.
    """
    lines: list[str] = []
    kinds: list[int] = []
    if not page:
        return lines, kinds
    buffer: list[str] = []
    linked: list[bool] = []
    stack: list[str] = []
    where: dict[str, list[int]] = {}
    bodies: list[int] = []
    marks: list[tuple[int, int]] = []  # places in the stack where text becomes chrome, or (0) is no longer
    held: list[int] = []
    anchors, mute, mute_depth = 0, "", 0
    at = 0

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                lines.append(text)
                mark = marks[-1][1] if marks else 0
                if mark:
                    kinds.append(MAYBE + _HELD * bool(held) if mark == _UNSURE and bodies and not all(linked) else CHROME)
                else:
                    kinds.append((LINK if all(linked) else BODY) + _HELD * bool(held) if bodies else OPEN)
            buffer.clear()
            linked.clear()

    def add(raw: str) -> None:
        if raw and not mute:
            buffer.append(html.unescape(raw) if "&" in raw else raw)
            if not raw.isspace():
                linked.append(anchors > 0)

    def last(tags: tuple) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=-1)

    def close(place: int) -> None:
        while len(stack) > place:
            where[stack.pop()].pop()
        while marks and marks[-1][0] >= place:
            marks.pop()
        for places in (bodies, held):
            while places and places[-1] >= place:
                places.pop()

    def close_sibling(tags: tuple, around: tuple) -> None:
        place = last(tags)
        if place > max(last(around), bodies[-1] if bodies else -1):
            close(place)

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag in _RAW and not closing:
            if not attrs.rstrip().endswith("/") or tag not in ("svg", "math"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else (size if tag in ("script", "style", "textarea") else at)
            continue
        if tag in _INLINE:
            if tag == "br":
                buffer.append(" ")
            elif tag == "a":
                anchors = max(0, anchors - 1) if closing else anchors + 1
            if mute:
                mute_depth += (tag == mute) * (-1 if closing else 1)
                if not mute_depth:
                    mute = ""
            elif not closing and attrs and tag not in _VOID and _hidden(attrs):
                mute, mute_depth = tag, 1
            continue
        flush()
        mute = ""
        if tag in ("html", "body"):
            if closing and marks:
                close(marks[0][0])
            continue
        if closing:
            place = where[tag][-1] if where.get(tag) else -1
            around = -1 if tag in ("article", "main") or not bodies else bodies[-1]
            if tag not in _TABLE:
                around = max(around, last(_CELLS))
            if place > around:
                close(place)
            continue
        if tag in _P_ENDS:
            close_sibling(("p",), ("table", "button", *_CELLS))
        if tag in _SIBLINGS:
            close_sibling(*_SIBLINGS[tag])
        if tag in _VOID:
            continue
        place, skipping = len(stack), marks[-1][1] if marks else 0
        chrome = _is_chrome(tag, attrs, bool(bodies)) if skipping in (0, _UNSURE) or tag == "article" else 0
        if tag in ("article", "main") and not chrome and (skipping != _SURE or tag == "main"):
            bodies.append(place)
            if skipping:
                marks.append((place, 0))
                if tag == "article":
                    held.append(place)
        elif chrome and skipping in (0, _UNSURE):
            marks.append((place, chrome))
        stack.append(tag)
        where.setdefault(tag, []).append(place)
    flush()
    if any(k >= _HELD for k in kinds):
        chars = {k: sum(len(x) for x, y in zip(lines, kinds, strict=True) if y == k) for k in set(kinds)}
        whole = not chars.keys() & {BODY, LINK} and sum(n for k, n in chars.items() if k >= _HELD) >= chars.get(OPEN, 0)
        kinds = [(k - _HELD if whole else CHROME) if k >= _HELD else k for k in kinds]
    return lines, kinds


def common_subsequence(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``.

    A row of the table of lengths is one integer, whose zero bits tell where the length grows (bit-parallel). Only every
    so many rows are kept and those between are made again on the way back, so memory is about the square root of the rows
    times the columns in bits, however often lines repeat.
    """
    head, enda, endb = 0, len(a), len(b)
    while head < min(enda, endb) and a[head] == b[head]:
        head += 1
    while enda > head and endb > head and a[enda - 1] == b[endb - 1]:
        enda -= 1
        endb -= 1
    mid, where, width = a[head:enda], {}, endb - head
    for j, x in enumerate(b[head:endb]):
        where.setdefault(x, []).append(j)
    full, masks = (1 << width) - 1, {}

    def mask(x: int) -> int:
        if x in masks or x not in where:
            return masks.get(x, 0)
        bits = np.zeros(width, bool)
        bits[where[x]] = True
        m = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        if len(masks) * width < MASK_BITS:
            masks[x] = m
        return m

    def row_after(v: int, x: int) -> int:
        u = v & mask(x)
        return ((v + u) | (v - u)) & full

    step = max(1, math.isqrt(len(mid)))
    kept, v = [full], full
    for i, x in enumerate(mid):
        v = row_after(v, x)
        if (i + 1) % step == 0:
            kept.append(v)
    found, j, rows, first = [], width, [], len(mid) + 1
    i = len(mid)
    while i and j:
        if i - 1 < first:  # rows first..i of the table, row k being what is known after k lines
            first = (i - 1) // step * step
            rows = [kept[first // step]]
            for x in mid[first:i]:
                rows.append(row_after(rows[-1], x))
        if rows[i - first] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if i and not rows[i - first] >> (j - 1) & 1:
            continue
        found.append(head + i)
        j -= 1
    return [*range(head), *reversed(found), *range(enda, len(a))]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [page_lines(t) for t in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array([x for x, _ in found], pa.list_(pa.string())), pa.array([k for _, k in found], pa.list_(pa.int8()))],
            ["page_id", "url", "lines", "kinds"],
        )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line that can be deleted and that the page shares with its pair, with the digest of all its lines and
    whether the two count as copies; prose of copies has none.

    A page with maybe lines also gives a row with place -1, which tells that it has a pair.
    """
    names = (("row", pa.int64()), ("host", pa.string()), ("at", pa.int32()), ("kind", pa.int8()), ("line", pa.int64()), ("version", pa.int64()), ("copy", pa.bool_()))
    for batch in batches:
        out = []
        for row, host, version, kinds, mine, other in zip(*(batch.column(c).to_pylist() for c in ("row", "host", "version", "kinds", "mine", "other")), strict=True):
            if MAYBE in kinds:
                out.append((row, host, -1, MAYBE, None, version, False))
            same = common_subsequence(mine, other)
            copy, has_body = len(same) >= COPY_SHARE * len(mine), any(k in (BODY, LINK) for k in kinds)
            kept = (LINK, MAYBE, *[BODY] * (not copy), *[OPEN] * (not has_body))
            out += [(row, host, i, kinds[i], mine[i], version, copy) for i in same if kinds[i] in kept]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(names)], [n for n, _ in names])


def nearest_pairs(pages: DataFrame) -> DataFrame:
    """Pair each row (``row``, ``host``, ``path``, ``kinds``, ``mine``) with the neighbour by path within its host: adds
    ``other`` and ``version``, a digest of ``mine``.

    Of the neighbours before and after in the order of paths, the one with the longer common path prefix; on ties the one
    before. Rows are dealt by ranges of host and path, so a host of any size spreads over tasks; each range also
    gets the last row before it and the first row after it.
    """
    laid = range_partitioned(pages, ["host", "path", "row"], "urls")
    key = F.struct("host", "path", "row", "mine")
    edges = laid.groupBy("__pid").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    by_pid = W.orderBy("__pid")  # one row a partition
    edges = edges.select("__pid", F.lag("high").over(by_pid).alias("above"), F.lead("low").over(by_pid).alias("below"))
    order = W.partitionBy("__pid").orderBy("host", "path", "row")
    near = laid.withColumns({"prev": F.lag(key).over(order), "next": F.lead(key).over(order)}).join(F.broadcast(edges), "__pid", "left")
    near = near.withColumns({"prev": F.coalesce("prev", "above"), "next": F.coalesce("next", "below")})

    def alike(c: str):
        """Length of the common prefix of both paths."""
        differ = F.array_position(F.zip_with(F.split("path", ""), F.split(f"{c}.path", ""), lambda x, y: x.eqNullSafe(y)), F.lit(False))
        return F.when(F.col(f"{c}.host") == F.col("host"), F.when(differ == 0, F.length("path") + 1).otherwise(differ))

    near = near.withColumns({"p": alike("prev"), "n": alike("next")})
    other = F.when(F.coalesce("p", F.lit(-1)) >= F.coalesce("n", F.lit(-1)), F.col("prev.mine")).otherwise(F.col("next.mine"))
    return near.filter("p is not null or n is not null").select("row", "host", F.xxhash64("mine").alias("version"), "kinds", "mine", other.alias("other"))


def deletions(keyed: DataFrame) -> DataFrame:
    """What differencing deletes from each page (``row``, ``host``, ``path``, ``kinds``, ``mine``) that has a pair: ``row``, ``drop`` (places).

    Shared lines that are open, maybe or links go, those of copies only if all over the host several different pages share
    them; shared prose goes if pages all over the host share it with their pairs. Both are counted per host and line. A page
    with maybe lines and a pair has a row even if nothing is deleted from it.
    """
    shared = nearest_pairs(keyed).mapInArrow(_shared, "row long, host string, at int, kind byte, line long, version long, copy boolean")
    shared = save_stage(shared.withColumn("prose", F.col("kind") == BODY), "shared")
    sizes = keyed.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    held = shared.filter("at >= 0").groupBy("host", "line", "prose").agg(F.countDistinct("row").alias("n"), F.countDistinct("version").alias("versions"), F.max("copy").alias("copy"))
    held = held.filter(F.when(F.col("prose"), F.col("n") >= HOST_PAGES).otherwise(F.col("copy") & (F.col("versions") >= COPY_VERSIONS)))
    common = held.join(sizes, "host").filter(F.col("n") >= HOST_SHARE * F.col("pages"))
    common = save_stage(common.select("host", "line", "prose", F.lit(True).alias("common")), "common")
    judged = shared.join(small(common, common.count(), 100_000), ["host", "line", "prose"], "left")
    return judged.filter(~(F.col("prose") | F.col("copy")) | F.col("common")).groupBy("row").agg(F.collect_set("at").alias("drop"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: ``page_id``, ``url``, ``text`` (blocks joined by a newline, empty if none), ``n_chars``.

    If a page has an article or main element with text, its text is that of these elements; else it is that of all blocks
    that markup does not mark as chrome. Maybe lines of pages that have no pair go. Null html has no text. Pages without a
    host (null or odd URLs) share the host ''. Repeated rows repeat (as copies of one page, they alone delete nothing from each
    other); other columns are ignored.
    """
    ship_package(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    parsed = rows.mapInArrow(_parse, "page_id long, url string, lines array<string>, kinds array<byte>")
    parsed = save_stage(parsed.withColumn("row", F.monotonically_increasing_id()), "lines")
    address = F.lower(F.coalesce("url", F.lit("")))
    host = F.regexp_extract(address, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(address, r"^(?:[a-z][a-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    keyed = parsed.select("row", host.alias("host"), path.alias("path"), "kinds", F.transform("lines", lambda x: F.xxhash64(x)).alias("mine"))
    drops = save_stage(deletions(keyed), "drops")
    marked = parsed.join(small(drops, drops.count(), 100_000), "row", "left")
    has_body = F.exists("kinds", lambda k: k.isin(BODY, LINK))
    at = F.zip_with("lines", "kinds", lambda x, k: F.struct(x.alias("x"), k.alias("k")))
    indexed = F.transform(at, lambda s, i: F.struct(s["x"].alias("x"), s["k"].alias("k"), i.alias("i")))
    right = lambda s: F.when(has_body, s["k"].isin(BODY, LINK) | ((s["k"] == MAYBE) & F.col("drop").isNotNull())).otherwise(s["k"] == OPEN)
    kept = F.filter(indexed, lambda s: right(s) & ~F.coalesce(F.array_contains("drop", s["i"]), F.lit(False)))
    text = F.array_join(F.transform(kept, lambda s: s["x"]), "\n")
    return marked.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every page of ``pages``."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
