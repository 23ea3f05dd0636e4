"""EPUB archives: where titles come from, and what a broken part costs."""

import io
import zipfile

import pytest

from tessera.plans.archives import package
from tessera.sources import epub

LONG = "Lorem ipsum dolor sit amet. " * 10


def titles(spark, *books):
    files = spark.createDataFrame([(f"{k}.epub", bytearray(b)) for k, b in enumerate(books)], "path string, content binary")
    out = {}
    for r in epub.readable(epub.chapters(files)).orderBy("path", "ord").collect():
        out.setdefault(r["path"], []).append(r["chapter_title"])
    return [out.get(f"{k}.epub", []) for k in range(len(books))]


CHAPTERS = [("The Bronze Key", None, LONG), (None, "An Untocced Chapter", LONG), (None, "My Great Book", LONG), (None, "my great", LONG), ("Tiny", "Tiny", "x"), (None, None, LONG), ("2", "Two", LONG)]
FULL = ["The Bronze Key", "An Untocced Chapter", "Chapter 3", "Chapter 4", "Chapter 5", "2"]
BARE = ["Chapter 1", "An Untocced Chapter", "Chapter 3", "Chapter 4", "Chapter 5", "Two"]


def test_fallback_chain(spark):
    shapes = ("ncx", "nav", "toc elsewhere", "named characters", "no toc", "broken toc", "broken archive")
    assert titles(spark, *(package("My Great Book", "A", CHAPTERS, s) for s in shapes)) == [FULL] * 4 + [BARE] * 2 + [[]]


@pytest.mark.parametrize("toc", ["<<<not xml at all", "", "<ncx><broken", "<html><body>none</body></html>", "<ncx/>"])
def test_a_broken_table_costs_titles_only(toc):
    assert epub.toc_titles(toc, "") == {}


def test_tables():
    nav = '<html xmlns:e="http://www.idpf.org/2007/ops"><nav role="doc-toc"><a href="a.xhtml">Role</a></nav><nav e:type="x TOC"><ol><li><a href="b%20c.xhtml#f"> One <em>and</em>&nbsp;two </a></li><li><a href="b%20c.xhtml">later</a><a href="d.xhtml"></a><a href="./d.xhtml">D &amp; d</a></li></ol></nav></html>'
    assert epub.toc_titles(nav, "x") == {"x/b c.xhtml": "One and two", "x/d.xhtml": "D & d"}
    assert epub.toc_titles(nav.replace("x TOC", "page-list"), "") == {"a.xhtml": "Role"}
    ncx = '﻿<?xml version="1.0"?><ncx xmlns="n"><navMap><navPoint><navLabel><text>007</text></navLabel><content src="../a.xhtml"/><navPoint><navLabel><text>In</text></navLabel><content src="b.xhtml#1"/></navPoint></navPoint></navMap></ncx>'
    assert epub.toc_titles(ncx, "toc") == {"a.xhtml": "007", "toc/b.xhtml": "In"}


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr({"container": "META-INF/container.xml"}.get(name, name.replace("__", "/").replace("_", ".")), text)
    return out.getvalue()


CONTAINER = '<container xmlns="urn:c"><rootfiles><rootfile full-path="b.opf"/><rootfile full-path="other.opf"/></rootfiles></container>'


def test_packages():
    opf = '<package xmlns:dc="d"><metadata><dc:title id="t">1984</dc:title></metadata><manifest><item id="a" href="a.xhtml"/><item id="i" href="i.png" media-type="image/png"/><item id="gone" href="gone.html"/><item id="n" href="nav.xhtml" properties="x nav"/></manifest><spine toc="missing"><itemref idref="i"/><itemref idref="gone"/><itemref idref="?"/><itemref idref="a"/><itemref idref="n"/></spine></package>'
    nav = '<html><nav><a href="a.xhtml">A</a></nav></html>'
    book = archive(container=CONTAINER, b_opf=opf, a_xhtml="<p>a</p>", i_png="", nav_xhtml=nav)
    assert epub.read_package(book) == ("1984", None, [("a.xhtml", None, "<p>a</p>"), ("nav.xhtml", None, nav)])
    book = archive(container=CONTAINER, b_opf=opf.replace(' toc="missing"', "").replace("1984", " "), a_xhtml="<p>a</p>", i_png="", nav_xhtml=nav)
    assert epub.read_package(book)[0] == "Untitled" and epub.read_package(book)[2][0][1] == "A"


@pytest.mark.parametrize("files", [{}, {"container": "<container/>"}, {"container": CONTAINER}, {"container": CONTAINER, "b_opf": "<package"}, {"container": "no xml"}])
def test_broken_archives_give_one_row(spark, files):
    rows = epub.chapters(spark.createDataFrame([("x.epub", bytearray(archive(**files)))], "path string, content binary")).collect()
    assert len(rows) == 1 and rows[0]["error"] and rows[0]["html"] is None


def test_archives_are_dealt_over_tasks(spark, sf):
    """A small table in one file is one split, and its archives took one task; now as many as a shuffle has."""
    from tessera.plans import archives

    files = archives._files(spark, sf)
    assert files.rdd.getNumPartitions() == 4
    assert files.select("path").distinct().count() == files.count() == spark.read.parquet(f"{sf}/customer.parquet").count()


def test_texts_are_read_once(spark):
    """The filter on the length of a text stays above the window, so that no text is made twice."""
    files = spark.createDataFrame([("0.epub", bytearray(package("B", "A", CHAPTERS)))], "path string, content binary")
    plan = epub.readable(epub.chapters(files))._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window") :]
    assert "regexp_replace" in below and not [x for x in below.splitlines() if "Filter" in x and "regexp_replace" in x]
