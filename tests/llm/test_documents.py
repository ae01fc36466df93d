import os
import random
import re
from collections import Counter

import numpy as np

from quillon.llm import decontaminate as D
from quillon.llm import htmltext as H
from quillon.llm import warc


def test_archives_come_back(spark, tmp_path):
    body = "<p>a\r\n\r\nb\r\n\r\n\r\nWARC/1.1\r\n\r\n</p>" + "x" * 200 + "é\r"
    pages = [(1, "http://h/a", body), (2, "http://h/b", body), (3, "http://h/c d\r\nX: y", None), (4, None, "short"), (5, "http://h/e", "short"), (0, "http://h/z", ""), (None, "http://h/n", body), (2, "http://h/b", body)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, record string")
    warc.write_archives(df, str(tmp_path / "w"))
    out = {(r.metadata.page_id, r.response.target_uri): r for r in warc.assemble(warc.read_records(spark, str(tmp_path / "w"))).collect()}
    rows = warc.assemble(warc.read_records(spark, str(tmp_path / "w"))).collect()
    assert len(rows) == len(pages) and len(out) == 7 and all(r.request and r.metadata for r in rows)
    assert len({r.record for r in rows}) == len(pages) and sum(r.response.kind == "revisit" for r in rows) == 3
    first = out[1, "http://h/a"]
    assert first.response.kind == "response" and bytes(first.response.payload) == body.encode() and first.response.payload_digest == first.response.named_digest
    assert {r.response.refers_to for k, r in out.items() if k[0] in (2, None)} == {first.record}
    assert out[2, "http://h/b"].response.payload_bytes == len(body.encode()) and out[2, "http://h/b"].response.payload_digest == first.response.payload_digest
    assert out[4, ""].response.kind == out[5, "http://h/e"].response.kind == "response"
    assert bytes(out[3, "http://h/c%20d%20%20X:%20y"].response.payload) == b""
    warc.write_archives(df.filter("false"), str(tmp_path / "none"))
    assert warc.assemble(warc.read_records(spark, str(tmp_path / "none"))).count() == 0


def test_cut_off_and_stray_chunks():
    got = list(warc.parse(iter([("f", b"junk"), ("f", b"WARC/1.1\r\nContent-Length: 7"), ("f", b"a"), ("f", b"bc"), ("f", b"WARC/1.1\r\nContent-Length: 99"), ("f", b"cut"), ("g", b"WARC/1.1\r\nContent-Length: 0"), ("g", b"")])))
    assert [b for _, b in got] == [b"a\r\n\r\nbc", b"cut", b""]


def test_payloads_may_end_in_line_ends(spark, tmp_path):
    bodies = [f"page {n}" + "\r\n" * n for n in range(6)] + ["\r\n", "x" * 200 + "\r\n", "x" * 200 + "\r\n"]
    df = spark.createDataFrame([(n, f"http://h/{n}", b) for n, b in enumerate(bodies)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"))
    out = {r.metadata.page_id: r for r in warc.assemble(warc.read_records(spark, str(tmp_path / "w"))).collect()}
    assert {n: r.request and r.request.request_line for n, r in out.items()} == {n: f"GET http://h/{n} HTTP/1.1" for n in range(len(bodies))}
    assert all(bytes(out[n].response.payload) == bodies[n].encode() for n in range(8)) and out[8].response.kind == "revisit"


def test_a_response_after_a_response_is_kept():
    blocks = [b"a\r\n", b"b\r\n\r\n\r\n", b"", b"c", b"d\r\n"]
    file = b"".join(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks)
    assert [b for _, b in warc.parse(("f", c) for c in file.split(b"\r\n\r\n"))] == blocks


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><script>var x="</p>";</script>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Title &amp; more</h1></header><p><b>First   para.<br>Same block&nbsp;here<p>Second <a href="x">link</a> 5 &lt; 6 &am</p><aside>See also</aside>
<form><p>Name</p></form><ul><li>Item</ul><!-- <p>hidden</p> --></article><div id="comments"><article class="comment"><p>First!</p></article></div>
<div class="sidebar"><p>Side</p></div><footer>&copy; me</footer></body></html>"""


def test_page_lines():
    lines, kinds = H.page_lines(PAGE)
    assert [x for x, k in zip(lines, kinds, strict=True) if k >= H.BODY] == ["Title & more", "First para. Same block here", "Second link 5 < 6 &am", "Item"]
    assert H.page_lines(None) == H.page_lines("") == ([], [])
    assert H.page_lines("plain & text") == (["plain & text"], [H.OPEN])
    assert H.page_lines("<p>a<script>b")[0] == ["a"] and H.page_lines("<" * 2000 + "a='")[0]


def body_of(page):
    return [x for x, k in zip(*H.page_lines(page), strict=True) if k in (H.BODY, H.LINK)]


def test_wrappers_with_chrome_in_their_names_keep_their_article():
    for wrapper in ('div class="content has-sidebar"', 'div id="content-sidebar-wrap"', 'section class="post no-comments"', 'div class="sidebar"', "form id=aspnetForm"):
        tag = wrapper.split()[0]
        assert body_of(f'<{wrapper}><nav>Menu</nav><article><p>Words<div class="ad-slot">Buy</div></article><div class="comment-list"><p>First!</p></div></{tag}><p>Open') == ["Words"]
    assert body_of('<div class="related"><article>Teaser</article></div><main><p>Words</main>') == ["Words"]
    assert H.page_lines('<div class="related"><article>Teaser</article></div><p>Longer open text') == (["Teaser", "Longer open text"], [H.CHROME, H.OPEN])
    assert body_of('<div class="sidebar"><main><p>Words</main><p>Side</div>') == ["Words"]


def test_inline_elements_stay_whatever_their_names():
    assert body_of('<article><p>x = 1 <span class="hljs-comment"># one</span> costs <b class="share-price">5</b><i aria-hidden="true">icon</i> today</article>') == ["x = 1 # one costs 5 today"]


def test_skipped_elements_end_without_an_end_tag():
    assert body_of('<article><p class="ad">Buy<p>One<ul><li class="social">Like<li>Two<li class="share">Tell</ul><p>Three<p class="ad">More</article><p>Out') == ["One", "Two", "Three"]
    assert body_of('<main><dl><dt class="ad">Buy<dd>One</dl><table><tr class="ad"><td>Buy<tr><td class="ad">Buy<td>Two</table><div class="ad">Buy</main>') == ["One", "Two"]


def test_differencing(spark):
    def page(n, extra=""):
        return f"<div>Welcome to the shop</div><h1>About {n}</h1><p>Text {n} is all its own.</p>{extra}<div>All rights reserved</div>"

    rows = [(i, f"http://h/a/{i}", page(i), "z") for i in range(6)] + [(9, "http://other/x", page(9), "z"), (10, None, None, "z"), (11, "http://c/1", page(11), "z"), (12, "http://c/2", page(11), "z")]
    got = {r.page_id: r for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, lines string")).collect()}
    assert got[2].text == "About 2\nText 2 is all its own." and got[2].n_chars == len(got[2].text)
    assert got[9].text.startswith("Welcome") and got[10].text == "" and got[10].n_chars == 0
    assert got[11].text == got[12].text and got[11].text.startswith("Welcome")
    assert H.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_names_of_sharing_within_an_article_are_judged_by_differencing(spark):
    def page(n, block, name):
        return f'<body><article><p>Own text {n}.</p><div class="{name}"><p>{block}</p></div><p>End of {n}.</p><p>Subscribe to our letter</p><p>More of {n}</p></article></body>'

    rows = [(i, f"http://h/a/{i}", page(i, "Tell your friends", "story-social")) for i in range(6)] + [(6, "http://h/a/6", page(6, "A story of its own", "story-social"))]
    rows += [(7, "http://lone/7", page(7, "A story of its own", "share")), (8, "http://two/8", page(8, "One", "related-work")), (9, "http://two/9", page(9, "Two", "related-work"))]
    rows += [(10, "http://h/a/95", "<p>Subscribe to our letter<p>and nothing else here<p>at all")]
    got = {r.page_id: r.text.split("\n") for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == [f"Own text {i}.", f"End of {i}.", f"More of {i}"] for i in range(6))
    assert got[6] == ["Own text 6.", "A story of its own", "End of 6.", "More of 6"]
    assert got[7] == ["Own text 7.", "End of 7.", "Subscribe to our letter", "More of 7"]
    assert got[8] == ["Own text 8.", "One", "End of 8.", "Subscribe to our letter", "More of 8"]


def test_evidence_of_the_host_goes_before_names(spark):
    menu, foot = "".join(f"<div>Menu {j}</div>" for j in range(12)), "".join(f"<div>Foot {j}</div>" for j in range(8))
    rows = [(i, f"http://stubs/{i}", f"{menu}<div>Only of {i}</div>{foot}") for i in range(4)]
    rows += [(10 + i, f"http://copies/{i}", f"{menu}<div>One text</div>{foot}") for i in range(4)]
    rows += [(20 + i, f"http://bare/{i // 5}/{i}", f"<div>Home</div><div>Shop</div><p>First of {i}</p><p>Second of {i}</p><div>Imprint</div>") for i in range(20)]
    verbs = '<article><section id="modal"><p>Modal verbs {0}</p></section><div class="notice"><p>Mind the {0}</p><p>Closed on Sundays</p></div><p>End {0}</p></article>'
    rows += [(50 + i, f"http://verbs/{i}", verbs.format(i)) for i in range(3)] + [(60, "http://single/", verbs.format(0))]
    got = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(4)] == [f"Only of {i}" for i in range(4)]
    assert all(got[10 + i].split("\n")[12] == "One text" and got[10 + i].count("\n") == 20 for i in range(4))
    assert all(got[20 + i] == f"First of {i}\nSecond of {i}" for i in range(20))
    assert all(got[50 + i] == f"Modal verbs {i}\nMind the {i}\nEnd {i}" for i in range(3)) and got[60] == "End 0"


def plain_extract(rows):
    """The whole query by loops: pairs by position in the sorted host, a table of lengths, counts per host."""
    parsed = []
    for n, (page, url, text) in enumerate(rows):
        lines, kinds = H.page_lines(text)
        m = re.match(r"[a-z][a-z0-9+.-]*://([^/?#]*)([^?#]*)", (url or "").lower())
        parsed.append((m[1] if m else "", m[2] if m else re.match(r"[^?#]*", (url or "").lower())[0], n, lines, kinds))
    parsed.sort(key=lambda p: p[:3])
    shared, copies, paired, pages = {}, set(), set(), Counter(p[0] for p in parsed)
    for at, (host, path, n, lines, kinds) in enumerate(parsed):
        near = [(len(os.path.commonprefix([path, q[1]])) + (path != q[1] or 1), -k, q[3]) for k, q in enumerate(parsed[max(0, at - 1) : at] + parsed[at + 1 : at + 2]) if q[0] == host]
        if near:
            paired.add(n)
            same = H.common_subsequence(lines, max(near)[2])
            shared[n] = same
            if len(same) >= 0.9 * len(lines):
                copies.add(n)
    kinds_of, lines_of, host_of = ({p[2]: p[k] for p in parsed} for k in (4, 3, 0))
    bodies = {n for n, kinds in kinds_of.items() if H.BODY in kinds or H.LINK in kinds}
    holders = {}
    for n, same in shared.items():
        for i in same:
            prose = kinds_of[n][i] == H.BODY
            if kinds_of[n][i] in (H.LINK, H.MAYBE) or prose and n not in copies or kinds_of[n][i] == H.OPEN and n not in bodies:
                holders.setdefault((host_of[n], lines_of[n][i], prose), set()).add(n)
    out = []
    for n, (page, _, _) in enumerate(rows):
        kinds, same, body = kinds_of[n], set(shared.get(n, ())), n in bodies
        keep = []
        for i, (x, k) in enumerate(zip(lines_of[n], kinds, strict=True)):
            here = holders.get((host_of[n], x, k == H.BODY), set())
            common = len(here) >= 0.8 * pages[host_of[n]]
            if k == H.BODY:
                gone = i in same and n not in copies and len(here) >= 5 and common
            else:
                gone = i in same and (n not in copies or common and len({tuple(lines_of[m]) for m in here}) >= 3)
            if not gone and ((k in (H.BODY, H.LINK) or k == H.MAYBE and n in paired) if body else k == H.OPEN):
                keep.append(x)
        out.append((page, "\n".join(keep)))
    return out


def test_the_whole_query_equals_plain_loops(spark, tmp_path):
    given = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    rng = random.Random(6)
    hosts = {g[1].split("/")[2] for g in given}
    extra = []
    for i in range(120):
        parts = [rng.choice(["<nav>Home</nav>", "<div>Welcome</div>", "<p>Read on</p>", f"<p>Own {i}</p>", f"<p>Other {i}</p>", "<p><a href=x>More</a></p>", '<div class="share"><p>Tell</p></div>', f'<div class="related">Rel {i}</div>', "<p>Often</p>"]) for _ in range(rng.randrange(9))]
        tag = rng.choice(["article", "main", "div"])
        extra.append((1000 + i, f"http://{rng.choice(['x', 'y', sorted(hosts)[0]])}/{rng.choice('ab')}/{i % 50}", f"<{tag}>{''.join(parts)}</{tag}>"))
    extra += [(1500 + i, f"http://stubs/{i}", "".join(f"<div>Menu {j}</div>" for j in range(20)) + f"<div>Stub {min(i, 6)}</div>") for i in range(9)]
    rows = given + extra + [(2000, None, "<p>No host</p>"), (2001, "odd", None), (2002, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = [(r.page_id, r.text) for r in H.op9_html_extraction(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(plain_extract(rows))


def test_very_long_pages_and_addresses(spark):
    rng = random.Random(9)
    long = [f"<p>line {rng.randrange(5)}</p>" for _ in range(20000)]
    rows = [(1, "http://h/" + "a" * 20000, "".join(long)), (2, "http://h/" + "a" * 19999 + "b", "".join(rng.sample(long, len(long))) + "<p>own</p>"), (3, "http://h/z", "<article>" + "word " * 200000 + "</article>")]
    got = {r.page_id: r.n_chars for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == 5 * 200000 - 1 and 0 < got[1] < 20000 * 7 and 0 < got[2] < 20000 * 7


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        got = H.common_subsequence(a, b)
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        assert len(got) == best[-1, -1] and got == sorted(set(got))
        it = iter(b)
        assert all(a[i] in it for i in got)


def greedy(item, doc, least):
    used_a, used_b, out = set(), set(), []
    while True:
        best = None
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and a + n not in used_a and b + n not in used_b:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (a, b, n)
        if not best:
            return out
        out.append(best)
        used_a |= set(range(best[0], best[0] + best[2]))
        used_b |= set(range(best[1], best[1] + best[2]))


def test_tiles_equal_plain_greedy_tiling():
    rng = random.Random(5)
    for _ in range(200):
        item, doc = (np.array([rng.randrange(3) for _ in range(rng.randrange(14))], np.uint64) for _ in range(2))
        assert D.tiles(item, doc, 2) == greedy(item.tolist(), doc.tolist(), 2)


def test_tiles_of_repetitive_texts_need_little_memory():
    import tracemalloc

    item, doc = np.full(1000, 7, np.uint64), np.full(1_000_000, 7, np.uint64)
    doc[::5000] = np.arange(200, dtype=np.uint64) + 100
    tracemalloc.start()
    assert D.tiles(item, doc) == [(0, 1, 1000)]
    assert sum(n for _, _, n in D.tiles(np.tile(np.array([1, 2, 3, 4, 9], np.uint64), 200), np.tile(np.array([1, 2, 3, 4, 8, 9, 9], np.uint64), 100_000))) == 999
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()


def test_the_whole_query_equals_plain_tiling(spark):
    """The items of each document, from plain greedy tiling of every pair that shares a seed."""
    sf = "/root/testdata/sf0.001"
    items = {r.item_id: D.fold(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r.doc_id: D.fold(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}

    def grams(words, n):
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}

    seeds, want = {i: grams(w, min(5, len(w))) for i, w in items.items() if w}, {}
    for d, words in docs.items():
        mine = grams(words, 5)
        near = [i for i, s in seeds.items() if s & mine]
        want[d] = [i for i in sorted(near) if sum(n for _, _, n in greedy(items[i], words, 3)) >= 0.6 * len(items[i])]
    assert min(map(len, items.values())) >= 5 and any(want.values())
    got = D.op7_benchmark_decontamination(spark, sf).collect()
    assert {r.doc_id: r.item_ids for r in got} == want and all(r.contaminated == bool(want[r.doc_id]) == (r.n_items > 0) for r in got)


def test_contamination(spark, monkeypatch):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    half = item.split()
    moved = " ".join(half[10:]) + " filler words go here " + " ".join(half[:10]).upper()
    items = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, "")], "item_id long, text string")
    docs = [(1, "x " + item + "."), (2, moved), (3, " ".join(half[:7])), (4, None), (5, ""), (6, "clean words only in this one here"), (7, "not Too, short."), (8, "short too"), (None, item), (1, "x " + item + ".")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int")
    for size in (D.BLOCK_BYTES, 50):
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        got = sorted(((r.doc_id, r.contaminated, r.n_items, tuple(r.item_ids)) for r in D.contamination(df, items).collect()), key=str)
        assert got == sorted([(1, True, 1, (1,)), (1, True, 1, (1,)), (2, True, 1, (1,)), (3, False, 0, ()), (4, False, 0, ()), (5, False, 0, ()), (6, False, 0, ()), (7, True, 1, (2,)), (8, False, 0, ()), (None, True, 1, (1,))], key=str)
    assert D.contamination(df.filter("false"), items).count() == 0
    assert D.contamination(df, items.filter("false")).filter("contaminated").count() == 0


def test_repeated_captures_have_a_row_each(spark, tmp_path):
    body = "y" * 100
    rows = [(5, "u", body)] * 3 + [(6, "u", "short")] * 2 + [(7, "v", body), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in warc.op5_warc_transactions(spark, str(tmp_path)).collect())
    again = ("revisit", "5")
    assert got == sorted([("5", "response", "None"), ("5", *again), ("5", *again), ("7", *again)] + [("6", "response", "None")] * 2 + [("None", "response", "None")] * 2)


def test_separators_beyond_ascii(spark):
    """A copy whose blanks, quotes and dashes are other code points is found like one with blanks."""
    words = [f"wörd{i}" for i in range(40)]
    item = " ".join(words)
    odd = "“" + " ".join(words[:20]) + "”—…" + "　".join(w[:2] + "­" + w[2:] for w in words[20:]) + "’"
    docs = spark.createDataFrame([(1, item), (2, odd), (3, "—".join(words)), (4, "— “"), (5, "".join(words))], "doc_id long, text string")
    got = {r.doc_id: r.contaminated for r in D.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False}
