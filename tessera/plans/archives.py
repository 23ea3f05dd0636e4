"""EPUB archives made of the test data, read again."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..sources import epub
from ..sources.tables import read
from .registry import query

CONTAINER = '<container><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>'


#: kinds of archives, by customer: where their titles come from
SHAPES = ("ncx", "nav", "no toc", "broken toc", "named characters", "toc elsewhere", "broken archive")


def package(title: str, author: str, chapters: list[tuple[str | None, str | None, str]], shape: str = "ncx") -> bytes:
    """An archive of (label of the table of contents, heading, text) chapters; a null label or heading is left out."""
    if shape == "broken archive":
        return b"PK\x03\x04 and no more"
    names = [f"text/ch%20{k}.xhtml" for k in range(len(chapters))]
    items = "".join(f'<item id="c{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names))
    spine = "".join(f'<itemref idref="c{k}"/>' for k in range(len(chapters)))
    listed = [(n, label) for n, (label, _, _) in zip(names, chapters, strict=True) if label is not None]
    nbsp = "&nbsp;" if shape == "named characters" else ""
    if shape in ("nav", "toc elsewhere"):
        toc, up = ("nav.xhtml", "") if shape == "nav" else ("more/nav.xhtml", "../")
        links = "".join(f'<li><a href="{up}{n}#top"><em>{label[:1]}</em>{label[1:]}</a></li>' for n, label in listed)
        text = f'<html xmlns:epub="http://www.idpf.org/2007/ops"><nav epub:type="landmarks"><a href="{up}{names[0]}">Not this</a></nav><nav epub:type="toc"><ol>{links}</ol></nav></html>'
        items += f'<item id="nav" href="{toc}" media-type="application/xhtml+xml" properties="nav"/>'
        of_spine = ""
    else:
        toc, of_spine = "toc.ncx", ' toc="ncx"'
        points = "".join(f'<navPoint><navLabel><text>{label}{nbsp}</text></navLabel><content src="{n}#a"/></navPoint>' for n, label in listed)
        text = "<ncx><broken" if shape == "broken toc" else f"<ncx><navMap>{points}</navMap></ncx>"
        items += '<item id="ncx" href="toc.ncx"/>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("OEBPS/book.opf", f'<package xmlns:dc="d"><metadata><dc:title>{title}</dc:title><dc:creator>{author}</dc:creator></metadata><manifest>{items}</manifest><spine{of_spine}>{spine}</spine></package>')
        if shape != "no toc":
            z.writestr(f"OEBPS/{toc}", text)
        for k, (_, heading, body) in enumerate(chapters):
            h = f"<h1>{heading}</h1>" if heading is not None else ""
            z.writestr(f"OEBPS/text/ch {k}.xhtml", f"<html><body>{h}<p>{body} &amp; more</p></body></html>")
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def _packages(key: pd.Series, title: pd.Series, author: pd.Series) -> pd.Series:
    def one(k, t, a):
        text = "word " * 40 + t
        chapters = [(f"First of {t}", "Own 0", text), ("Second", "Own 1", "short"), (None, "Own 2", text), (None, t.upper(), text), (None, None, text)]
        return package(t, a, chapters, SHAPES[k % len(SHAPES)])

    return pd.Series([one(k, t, a) for k, t, a in zip(key, title, author, strict=True)])


def _files(spark, sf_dir):
    """Archives in as many tasks as the session shuffles into: a row of a few bytes is a millisecond of work, and a file of them one split."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").repartition(parts, "c_custkey")
    return c.select(F.concat(F.col("c_custkey").cast("string"), F.lit(".epub")).alias("path"), _packages("c_custkey", "c_name", "c_mktsegment").alias("content"))


_TITLED = "(c_custkey % 7 in (0, 1, 4, 5))"


@query(f"""select c_custkey || '.epub' as path, c_name as title, c_mktsegment as author, cast(k as int) as ord, 'OEBPS/text/ch ' || k || '.xhtml' as href, case when {_TITLED} and k = 0 then 'First of ' || c_name when {_TITLED} and k = 1 then 'Second' else '-' end as toc_title, '-' as error
from customer, (select unnest([0, 1, 2, 3, 4]) as k) where c_custkey % 7 <> 6
union all select c_custkey || '.epub', '-', '-', -1, '-', '-', 'BadZipFile' from customer where c_custkey % 7 = 6""")
def epub_chapters(spark, sf_dir):
    """Container, package, reading order and table of contents of archives of all kinds; broken ones are one row."""
    dash = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    c = epub.chapters(_files(spark, sf_dir))
    return c.select("path", dash("title"), dash("author"), F.coalesce("ord", F.lit(-1)).alias("ord"), dash("href"), dash("toc_title"), F.coalesce(F.substring_index("error", ":", 1), F.lit("-")).alias("error"))


@query(f"""select c_custkey || '.epub' as path, cast(case k when 0 then 1 else k end as int) as number,
  case when k = 0 then case when {_TITLED} then 'First of ' || c_name else 'Own 0' end when k = 2 then 'Own 2' else 'Chapter ' || k end as chapter_title,
  case k when 0 then 'Own 0' when 2 then 'Own 2' when 3 then upper(c_name) else '-' end as heading,
  case k when 0 then 'Own 0' || chr(10) || chr(10) when 2 then 'Own 2' || chr(10) || chr(10) when 3 then upper(c_name) || chr(10) || chr(10) else '' end || repeat('word ', 40) || c_name || ' & more' as text
from customer, (select unnest([0, 2, 3, 4]) as k) where c_custkey % 7 <> 6""")
def epub_text(spark, sf_dir):
    """Readable chapters: the second is too short; titles from the table, the text, or their number where the text has the book's or none."""
    return epub.readable(epub.chapters(_files(spark, sf_dir))).select("path", "number", "chapter_title", F.coalesce("heading", F.lit("-")).alias("heading"), "text")


@query("""select doc_id, case doc_id % 4 when 0 then 'pdf' when 1 then 'epub' else '-' end as kind from documents""")
def sniffed_formats(spark, sf_dir):
    """First bytes of files: a PDF, an EPUB, an archive by another name, and plain text."""
    d = read(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 4
    head = F.when(kind == 0, "%PDF-1.7 ").when(kind == 3, "").otherwise("PK\x03\x04")
    name = F.when(kind == 1, "a.EPUB").otherwise("a.zip")
    return d.select("doc_id", F.coalesce(epub.sniff(F.concat(head, "text").cast("binary"), name), F.lit("-")).alias("kind"))


@query("""select page_id, substr(trim(regexp_replace(url, '[0-9]', '', 'g')), 1, 12) as short from pages""")
def clamped_fields(spark, sf_dir):
    """Over-long values cut by code point."""
    return read(spark, sf_dir, "pages").select("page_id", tx.clamped(F.concat(F.lit("  "), F.regexp_replace("url", "[0-9]", "")), 12).alias("short"))
