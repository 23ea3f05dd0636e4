"""EPUB packages: from binary files to chapters, by the Python standard library."""

from __future__ import annotations

import html
import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.python_text import resolve

LEAST_CHARS = 120
CHAPTERS = "path string, title string, author string, ord int, href string, toc_title string, html string, error string"


def sniff(content: Column, name: Column) -> Column:
    """pdf, epub or null by the first bytes, with the name to tell a package from any archive."""
    head = F.substring(content, 1, 4)
    return F.when(head == F.lit(b"%PDF"), "pdf").when((head == F.lit(b"PK\x03\x04")) & F.lower(name).endswith(".epub"), "epub")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


_NAMED = re.compile(r"&([A-Za-z][A-Za-z0-9]*);")
_TEXT_NAME = re.compile(r"\.x?html?$", re.I)
_XML_NAMES = {"amp", "lt", "gt", "quot", "apos"}


def _parse(xml: str) -> ET.Element:
    """Well-formed XML in which HTML's names of characters, which XML does not know, may occur."""
    known = lambda m: m[0] if m[1] in _XML_NAMES else html.unescape(m[0])
    xml = xml.lstrip("\ufeff \t\r\n")
    return ET.fromstring(_NAMED.sub(known, xml) if "&" in xml else xml)


def _all(root: ET.Element, name: str) -> list[ET.Element]:
    return [e for e in root.iter() if isinstance(e.tag, str) and _local(e.tag) == name]


def _text(e: ET.Element | None) -> str:
    return " ".join("".join(e.itertext()).split()) if e is not None else ""


def _kinds(nav: ET.Element) -> set[str]:
    """What a nav element says it is, by epub:type or role."""
    return {x for name, value in nav.attrib.items() if _local(name) in ("type", "role") for x in value.lower().split()}


def _links(root: ET.Element) -> list[tuple[str, str]]:
    """(reference, label) in the order of a table of contents, an NCX or a navigation document."""
    if _local(root.tag) == "ncx":
        child = lambda point, name: next((c for c in point if _local(c.tag) == name), None)
        points = [(child(p, "content"), child(p, "navLabel")) for p in _all(root, "navPoint")]
        return [(src.get("src", ""), _text(label)) for src, label in points if src is not None]
    navs = _all(root, "nav")
    of_kind = [n for kind in ("toc", "doc-toc") for n in navs if kind in _kinds(n)]
    return [(a.get("href", ""), _text(a)) for a in _all((of_kind + navs)[0], "a")] if navs else []


def toc_titles(xml: str, folder: str) -> dict[str, str]:
    """path -> title, the first one that is not empty for each path; nothing from a table that cannot be parsed."""
    try:
        links = _links(_parse(xml))
    except ET.ParseError:
        return {}
    found: dict[str, str] = {}
    for href, label in links:
        if href and label:
            found.setdefault(resolve(href, folder), label)
    return found


def _is_text(item: ET.Element) -> bool:
    return "html" in item.get("media-type", "").lower() or bool(_TEXT_NAME.search(item.get("href", "")))


def read_package(content: bytes) -> tuple[str, str | None, list[tuple[str, str | None, str]]]:
    """(title, author, [(href, title of the table of contents, XHTML)]) in reading order.

    The table of contents is the one that the spine names, else the first item that is a
    navigation document. Items that are missing or no text are passed over. Without a
    container, its path, or a package the archive is broken.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        get = lambda path: z.read(path).decode("utf-8", "replace")
        opf = next((e.get("full-path", "") for e in _all(_parse(get("META-INF/container.xml")), "rootfile")), "")
        if not opf:
            raise ValueError("no path of a package in META-INF/container.xml")
        folder = posixpath.dirname(opf)
        parts: dict[str, list[ET.Element]] = {n: [] for n in ("title", "creator", "item", "spine")}
        for e in _parse(get(opf)).iter():
            if isinstance(e.tag, str) and (name := _local(e.tag)) in parts:
                parts[name].append(e)
        title, author = (_text(parts[n][0]) if parts[n] else "" for n in ("title", "creator"))
        listed = [e for e in parts["item"] if e.get("id") and e.get("href")]
        items = {e.get("id"): e for e in listed}
        spine = parts["spine"][0] if parts["spine"] else None
        named = spine.get("toc") if spine is not None else None
        toc = items.get(named) if named else next((e for e in listed if "nav" in re.findall(r"\w+", e.get("properties", ""))), None)
        where = resolve(toc.get("href"), folder) if toc is not None else ""
        titles = toc_titles(get(where), posixpath.dirname(where)) if where in names else {}
        chapters = []
        for ref in _all(spine, "itemref") if spine is not None else []:
            e = items.get(ref.get("idref"))
            path = resolve(e.get("href"), folder) if e is not None and _is_text(e) else ""
            if path in names:
                chapters.append((path, titles.get(path), get(path)))
        return title or "Untitled", author or None, chapters


def chapters(files: DataFrame) -> DataFrame:
    """One row a chapter from ``binaryFile`` rows (path, content); a broken file gives one row with an error."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    title, author, found = read_package(content)
                    rows += [(path, title, author, k, href, toc, text, None) for k, (href, toc, text) in enumerate(found)]
                except Exception as e:  # noqa: BLE001  a broken file must not stop the others
                    rows.append((path, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHAPTERS.split(", ")]).astype({"ord": "Int32"})

    return files.select("path", "content").mapInPandas(run, CHAPTERS)


def readable(chapters_: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """Chapters with a title and plain text, numbered from 1; those under ``least`` characters are dropped.

    The title is that of the table of contents, else the text's own unless that is the
    book's, or how the book's begins, else "Chapter" and the number. The numbers count
    what is left of a book, in one window a book; short chapters go after it, as a filter
    before it would read every text twice.
    """
    from ..functions import text as tx

    source, kept = F.col("html"), F.length("text") >= least
    out = chapters_.filter("error is null").withColumn("text", tx.xhtml_text(source, tx.decode_entities)).withColumn("heading", tx.xhtml_title(source, tx.decode_entities)).drop("html")
    upto = Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("number", F.count_if(kept).over(upto).cast("int")).filter(kept)
    own = F.when(~F.startswith(F.lower(tx.trim(F.col("title"))), F.lower(tx.trim(F.col("heading")))), tx.trim(F.col("heading")))
    return out.withColumn("chapter_title", F.coalesce(F.nullif(tx.trim(F.col("toc_title")), F.lit("")), own, F.concat(F.lit("Chapter "), F.col("number").cast("string"))))


__all__ = ["chapters", "content_hash", "read_package", "readable", "sniff", "toc_titles"]
