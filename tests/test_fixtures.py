"""Exact expected values for small inputs."""

import io
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions import models as mf
from tessera.functions import python_text as py
from tessera.functions import text as tx
from tessera.operators import catalog, intervals, relational, state, structure, sync
from tessera.sources import epub

NOW = datetime(2024, 5, 1, 12, 0, 0)


def ts(d):
    return F.lit(d).cast("timestamp_ntz")


def ago(**kw):
    return NOW - timedelta(**kw)


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_stuck_jobs(spark):
    rows = [
        ("a", "processing", ago(minutes=20), 500), ("b", "processing", ago(minutes=120), 500), ("c", "processing", ago(minutes=60), 500),
        ("d", "pending", ago(minutes=20), None), ("e", "pending", ago(minutes=20), 700), ("f", "pending", ago(minutes=20), 0), ("g", "processing", ago(minutes=20), 1),
    ]
    jobs = spark.createDataFrame([(i, s, c, ago(minutes=15), k) for i, s, c, k in rows], "id string, status string, created_at timestamp_ntz, updated_at timestamp_ntz, cost_cents int")
    flying = spark.createDataFrame([("g",)], "id string")
    assert dict(values(state.stuck_jobs(jobs, ts(NOW), flying), "id", "action")) == {"a": "retry", "b": "fail", "c": "fail", "d": "retry"}


def test_backoff(spark):
    got = spark.createDataFrame([(n,) for n in (1, 2, 3, 12, 500)], "n int").select("n", state.backoff_ms(F.col("n")).alias("w"))
    assert values(got, "n", "w") == [(1, 30_000), (2, 60_000), (3, 120_000), (12, 21_600_000), (500, 21_600_000)]


@pytest.mark.parametrize(
    ("client", "server", "want"),
    [
        (((1, False, None)), (0, True, ago(days=9)), (False, None)),
        ((0, False, None), (1, True, ago(days=9)), (True, ago(days=9))),
        ((0, True, ago(days=3)), (0, False, None), (True, ago(days=3))),
        ((1, True, ago(days=3)), (0, False, None), (True, ago(days=3))),
        ((1, True, None), (0, False, None), (True, NOW)),
        ((0, False, None), (1, False, None), (False, None)),
    ],
)
def test_merge(spark, client, server, want):
    row = (ago(days=5) + timedelta(days=client[0]), client[1], client[2], 0.7, ago(days=5) + timedelta(days=server[0]), server[1], server[2], 0.5)
    schema = ", ".join(f"{p}_updated_at timestamp_ntz, {p}_is_read boolean, {p}_read_at timestamp_ntz, {p}_scroll double" for p in "cs")
    got = sync.merge_progress(spark.createDataFrame([row], schema), ts(NOW)).collect()[0]
    assert (got["is_read"], got["read_at"]) == want
    assert got["scroll"] == 0.7
    assert got["changed"]


def test_unit(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.3, 7.0, float("nan"), float("inf"))], "x double")
    assert [r[0] for r in df.select(sync.unit(F.col("x"))).collect()] == [0.0, 0.3, 1.0, 0.0, 0.0]


def test_keyset_pages_concatenate(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    after, seen, cursors = None, [], []
    while True:
        rows = relational.keyset_page(df, after, 3).collect()
        seen += [r["id"] for r in rows]
        after = rows[0]["next_after"]
        cursors.append(after)
        if after is None:
            break
    assert sorted(seen) == list(range(1, 8))
    assert cursors == [3, 6, None]


@pytest.mark.parametrize(
    ("old", "end", "read"),
    [
        ([(1, 5, True), (6, 10, True)], 10, True), ([(1, 3, True), (4, 6, True), (7, 9, False)], 9, True), ([(1, 3, True), (4, 6, False), (7, 9, False)], 9, False),
        ([(1, 4, True), (2, 4, True), (3, 5, True), (6, 10, False)], 10, False), ([(-5, 3, True), (8, 99, True)], 10, True),
    ],
)
def test_coverage(spark, old, end, read):
    before = spark.createDataFrame([(1, a, b, r, NOW if r else None) for a, b, r in old], "book int, start_page int, end_page int, is_read boolean, read_at timestamp_ntz")
    new = spark.createDataFrame([(1, 1, 1, end)], "book int, ord int, start int, end int")
    assert intervals.carry_over(before, new, "book").collect()[0]["is_read"] is read


def test_exact_claim_once(spark):
    old = spark.createDataFrame([(1, 10, 1, "a")], "s int, e int, o int, text string")
    new = spark.createDataFrame([(1, 10, 1), (1, 10, 2)], "s int, e int, n int")
    assert sorted(values(intervals.exact_claims(old, new, ["s", "e"], "o", "n"), "n", "text")) == [(1, "a"), (2, None)]


@pytest.mark.parametrize(
    ("sections", "pages", "want"),
    [
        ([("A", 30, 30), ("B", 30, 45)], [(30, "page 30 md")], {"A": "page 30 md", "B": None}),
        ([("S", 10, 12)], [(10, "x"), (12, "y")], {"S": None}),
        ([("S", 10, 12), ("T", 13, 20), ("U", 5, None)], [(5, "p5"), (10, "p10"), (11, "p11"), (12, "p12")], {"S": "p10\n\np11\n\np12", "T": None, "U": "p5"}),
        ([("S", 10, 12)], [(10, "p10"), (11, ""), (12, "p12")], {"S": "p10\n\np12"}),
    ],
)
def test_page_text(spark, sections, pages, want):
    got = intervals.covered(spark.createDataFrame(sections, "id string, start_page int, end_page int"), spark.createDataFrame(pages, "page int, md string"), ["id"], "md")
    assert dict(values(got, "id", "text")) == want


OUTLINES = [
    (140, {(0,): ("Ch3", 100), (0, 0): ("3.1", 100), (0, 1): ("3.2", 105), (0, 1, 0): ("3.2.1", 105), (0, 1, 1): ("3.2.2", 110), (0, 2): ("3.3", 120), (0, 3): ("Exercises", 130)},
     [("3.1", 100, 104), ("3.2.1", 105, 109), ("3.2.2", 110, 119), ("3.3", 120, 129), ("Exercises", 130, 140)], [("Ch3", 100, 104), ("Ch3 > 3.2", 105, 119), ("Ch3", 120, 140)]),
    (10, {(0,): ("Part 1", 1), (0, 0): ("Ch1", 3), (0, 0, 0): ("1.1", 3), (0, 0, 1): ("1.2", 5), (0, 1): ("Afterword", 8)},
     [("Part 1 — Introduction", 1, 2), ("1.1", 3, 4), ("1.2", 5, 7), ("Afterword", 8, 10)], [("Part 1", 1, 2), ("Part 1 > Ch1", 3, 7), ("Part 1", 8, 10)]),
    (9, {(0,): ("Ch1", 1), (0, 0): ("1.1", 1), (0, 1): ("1.2", 4), (1,): ("Ch2", 6), (1, 0): ("2.1", 6)}, [("1.1", 1, 3), ("1.2", 4, 5), ("2.1", 6, 9)], [("Ch1", 1, 5), ("Ch2", 6, 9)]),
]


@pytest.mark.parametrize(("total", "nodes", "sections", "chapters"), OUTLINES)
def test_outline(spark, total, nodes, sections, chapters):
    df = spark.createDataFrame([("d", list(p), t, n) for p, (t, n) in nodes.items()], "doc string, path array<int>, title string, page int")
    got = intervals.range_ends(structure.outline_leaves(df), "doc", F.lit(total)).orderBy("ord")
    assert values(got, "title", "start", "end") == sections
    assert list(dict.fromkeys(values(got, "chapter", "chapter_title", "chapter_start", "chapter_end"))) == [(k, *c) for k, c in enumerate(chapters, 1)]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>Butter<span>nut</span> Squash</p>", "Butternut Squash"), ("<p>a</p><p>b</p>", "a\n\nb"), ("<div>a<div>b</div></div>", "a\nb"),
        ("<table><tr><td>1 cup</td><td>rice</td></tr></table>", "1 cup rice"), ('<p>one<img src="x.png"/>two<hr/>three</p>', "one two three"), ("<p>&amp;lt; &#8364;</p>", "&lt; €"),
    ],
)
def test_xhtml(spark, html, want):
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(tx.xhtml_text(F.col("html"), tx.decode_entities)).collect()[0][0] == want


def test_xhtml_titles(spark):
    df = spark.createDataFrame([(1, "<h1>Q&amp;A with the Chef</h1>"), (2, "<title>T</title><body><h2>&nbsp;</h2></body>"), (3, "<p>x</p>")], "i int, html string")
    assert values(df.select("i", tx.xhtml_title(F.col("html")).alias("t")), "i", "t") == [(1, "Q&A with the Chef"), (2, "T"), (3, None)]


def test_page_offset(spark):
    entries = spark.createDataFrame([(1, "Chapter 1. Alpha Beginnings", 1), (2, "Beta Continues", 20), (3, "Gamma Concludes", 41)], "ord int, title string, start_page int")
    page = lambda rows: spark.createDataFrame(rows, "page int, text string")
    hits = [(15, "alpha beginnings"), (34, "BETA continues"), (55, "Gamma: concludes!")]
    toc = [(3, "alpha beginnings beta continues")]
    labels = spark.createDataFrame(list(enumerate(["Cover", "i", "ii", "iii", "iv", "1", "2"], 1)), "page int, label string")
    assert structure.page_offset(entries, page(hits)).collect()[0] == (14, "titles")
    assert structure.page_offset(entries, page(toc + hits)).collect()[0] == (14, "titles")
    assert structure.page_offset(entries, page([(2, "gamma concludes"), *hits[:2]])).collect()[0] == (14, "titles")
    assert structure.page_offset(entries, page([(1, "nothing")])).collect()[0] == (0, "none")
    assert structure.page_offset(entries, page(hits), labels).collect()[0] == (5, "labels")


def test_ranking_and_cost(spark):
    ids = [("gpt-4o", 2.5, 10.0), ("text-embedding-3-small", 0.0, 0.0), ("gpt-4.1-nano", 0.1, 0.4), ("whisper-1", 0.0, 0.0), ("gpt-4o-mini", 0.15, 0.6)]
    df = spark.createDataFrame([("openai", *x) for x in ids], "provider string, model string, input double, output double")
    assert [r["model"] for r in catalog.rank(df).orderBy("rank").collect()] == ["gpt-4.1-nano", "gpt-4o-mini", "gpt-4o"]
    assert df.limit(1).select(mf.cost_micro_usd(F.lit(1.0), F.lit(5.0), F.lit(1000), F.lit(100))).collect()[0][0] == 1500


def test_longest_prefix_boundary(spark):
    ids = spark.createDataFrame([("m-1-2024",), ("m-10",), ("m-1",), ("x",)], "id string")
    keys = spark.createDataFrame([("m", 1), ("m-1", 2)], "key string, price int")
    assert dict(values(catalog.longest_prefix(ids, keys, "id", "key"), "id", "price")) == {"m-1-2024": 2, "m-10": 1, "m-1": 2, "x": None}


def test_webhooks(spark):
    rows = [("processed", ago(hours=1)), ("processing", ago(seconds=30)), ("processing", ago(seconds=90)), ("failed", ago(seconds=1)), (None, None)]
    df = spark.createDataFrame(rows, "status string, created_at timestamp_ntz")
    assert [r["action"] for r in state.webhook_action(df, ts(NOW)).collect()] == ["skip", "skip", "process", "process", "process"]


def test_caps(spark):
    df = spark.createDataFrame([("books", i) for i in range(3)] + [("words", 1)], "kind string, i int")
    assert relational.capped(df, {"books": 3, "words": 1}).count() == 4
    with pytest.raises(Exception, match="payload too large: books: 3"):
        relational.capped(df, {"books": 2, "words": 1}).count()


def test_lines_and_markers(spark):
    df = spark.createDataFrame([("  - item one",), ("Figure 1.2: A view",), ("* note text",)], "l string")
    got = df.select(tx.list_item(F.col("l")).alias("i"), tx.caption(F.col("l")).alias("c"), tx.footnote(F.col("l")).alias("f")).collect()
    assert tuple(got[0]["i"]) == ("-", "item one", 1)
    assert tuple(got[1]["c"]) == ("Figure 1.2", "A view")
    assert got[2]["f"]["marker"] == "*"


def test_hrefs_and_signatures():
    assert py.resolve("../text/ch%201.xhtml#x", "OEBPS/nav") == "OEBPS/text/ch 1.xhtml"
    assert py.resolve("a%zz.xhtml", "") == "a%zz.xhtml"
    assert py.resolve("a+b.xhtml", "d") == "d/a+b.xhtml"
    text = "one " * 30 + "two " * 30 + "three " * 30
    assert py.signature_pages(text, ["one one", "two two", "three three"]) == [w.strip() for w in ("one " * 30, "two " * 30, "three " * 30)]


def _book(toc_nav: bool) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>')
        nav = '<item id="nav" href="nav/toc.xhtml" properties="nav"/>' if toc_nav else '<item id="ncx" href="toc.ncx"/>'
        spine = "" if toc_nav else ' toc="ncx"'
        z.writestr("OEBPS/book.opf", f'<package xmlns:dc="d"><metadata><dc:title>007</dc:title><dc:creator>An Author</dc:creator></metadata><manifest>{nav}<item id="a" href="text/ch%201.xhtml"/><item id="b" href="text/b.xhtml"/></manifest><spine{spine}><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("OEBPS/nav/toc.xhtml", '<html xmlns:epub="http://www.idpf.org/2007/ops"><nav epub:type="landmarks"><a href="../text/b.xhtml">wrong</a></nav><nav epub:type="toc"><ol><li><a href="../text/ch%201.xhtml#top">1.10</a><ol><li><a href="../text/b.xhtml">B</a></li></ol></li></ol></nav></html>')
        z.writestr("OEBPS/toc.ncx", '<ncx><navMap><navPoint><navLabel><text>1.10</text></navLabel><content src="text/ch%201.xhtml"/><navPoint><navLabel><text>B</text></navLabel><content src="text/b.xhtml#x"/></navPoint></navPoint></navMap></ncx>')
        z.writestr("OEBPS/text/ch 1.xhtml", "<html><body><h1>First</h1><p>" + "word " * 40 + "</p></body></html>")
        z.writestr("OEBPS/text/b.xhtml", "<html><body><p>short</p></body></html>")
    return out.getvalue()


@pytest.mark.parametrize("toc_nav", [True, False])
def test_epub(spark, tmp_path, toc_nav):
    (tmp_path / "a.epub").write_bytes(_book(toc_nav))
    (tmp_path / "b.epub").write_bytes(b"PK\x03\x04 broken")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert {r[0] for r in files.select(epub.sniff(F.col("content"), F.col("path"))).collect()} == {"epub"}
    rows = epub.chapters(files)
    assert rows.filter("error is not null").count() == 1
    assert sorted(values(rows.filter("error is null"), "title", "author", "ord", "toc_title")) == [("007", "An Author", 0, "1.10"), ("007", "An Author", 1, "B")]
    assert values(epub.readable(rows), "chapter_title", "heading") == [("1.10", "First")]
