"""HTML extraction by line-block distribution.

The page becomes a list of lines, one for each block of text, with markup, scripts,
styles and comments stripped, and each line has a length. Over this list, a window of
``WINDOW`` lines slides; the sums of lengths in it surge where the article begins and
dive to zero where it ends. The text between a surge and its dive is kept, whole, if the
surge is high or the stretch holds a good part of the page; a lower stretch between two
that are kept in the same container is kept too.

Tags only shape the lengths; the surges and dives alone decide. A line whose text is
mostly links has length zero. Containers put empty lines where they meet, so that
neighbours of different kinds do not share a window. What lies in an element that names
itself as something else than the article (menu, advert, form, reader comments and so
on) is empty lines. Where the page marks its article, lines inside it are as long as a
surge at least, and those outside have length zero.

Everything works on one page at a time, in one pass over its whole text.

Cases: null, empty and textless pages give an empty text; unclosed elements end
with the page, or where an article begins; a page of one short line is kept; rows
alike give texts alike; other columns are ignored by ``extract``.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import small_batches

WINDOW = 3
SURGE_CHARS = 200
SURGE_SHARE = 0.35
REGION_SHARE = 0.2
LINK_SHARE = 0.6

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*>?"
    r"|<(?P<raw>script|style|noscript|template|title|textarea|iframe|select|button)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
# fixed values: HTML element names by their kind
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OTHER = frozenset("nav footer aside form dialog menu fieldset".split())
ARTICLE = frozenset(("article", "main"))
# fixed values: words by which elements name themselves as something else than the article
WORDS = frozenset("ad ads adbox adslot advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommended related replies reply share sharing sidebar signup sitefooter siteheader social sponsor sponsored subscribe subscription toolbar widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())


def _names_itself(attrs: str) -> bool:
    """Whether an element's attributes say that it is no part of the article."""
    for m in ATTR.finditer(attrs):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind in ("class", "id"):
            if not WORDS.isdisjoint(re.split(r"[^a-z]+", value)) or "site-header" in value or "page-header" in value:
                return True
        elif kind == "role":
            if value.strip() in ROLES:
                return True
        elif kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


class Line(NamedTuple):
    """A line of a page: its length in the distribution, and the containers around it."""

    text: str
    length: int
    own: int = 0
    around: int = 0


GAP = Line("", 0)


def lines_of(html: str) -> list[Line]:
    """The lines of a page in order, with empty ones between containers."""
    out: list[Line] = []
    inner: list[bool] = []
    text: list[str] = []
    links = 0
    in_link = False
    skip, depth = "", 0
    inside: list[str] = []
    boxes, count = [0, 0], 0

    def flush() -> None:
        nonlocal links
        line = " ".join(unescape("".join(text)).split())
        text.clear()
        if line:
            out.append(Line(line, 0 if links > LINK_SHARE * len(line) else len(line), boxes[-1], boxes[-2]))
            inner.append(bool(inside))
        links = 0

    def gap(n: int) -> None:
        flush()
        out.extend([GAP] * n)
        inner.extend([False] * n)

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at and not skip:
            piece = html[at : m.start()]
            text.append(piece)
            if in_link:
                links += len(piece.strip())
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"] and not skip:
                text.append(" ")
            continue
        opens = not m["close"]
        if skip:
            if tag == skip:
                depth += 1 if opens else -1
                if not depth:
                    skip = ""
                    gap(WINDOW)
            elif opens and tag in ARTICLE:
                skip = ""
            if skip or not opens:
                continue
        if tag in ARTICLE:
            gap(WINDOW)
            if opens:
                inside.append(tag)
            elif tag in inside:
                inside.pop()
        elif opens and tag not in VOID and tag not in ("html", "body") and (tag in OTHER or tag == "header" and not inside or m["attrs"] and _names_itself(m["attrs"])):
            gap(WINDOW)
            if not m["attrs"].endswith("/"):
                skip, depth = tag, 1
        elif tag in ("div", "section"):
            gap(1 if opens else WINDOW - 1)
            if opens:
                count += 1
                boxes.append(count)
            elif len(boxes) > 2:
                boxes.pop()
        elif tag in BLOCKS:
            flush()
        elif tag in ("br", "td", "th", "img", "wbr"):
            text.append(" ")
        elif tag == "a":
            in_link = opens
    if not skip:
        text.append(html[at:])
    flush()
    if any(inner):
        return [x._replace(length=max(len(x.text), SURGE_CHARS) if i else 0) for x, i in zip(out, inner, strict=True)]
    return out


class Stretch(NamedTuple):
    """Lines ``lo`` to ``hi`` between a surge and its dive: the highest window and all lengths."""

    lo: int
    hi: int
    peak: int
    mass: int


def stretches(lengths: list[int]) -> list[Stretch]:
    """From where a window rises above zero to where it is zero again, without the empty ends."""
    n = len(lengths)
    windows = [sum(lengths[i : i + WINDOW]) for i in range(n)]
    out, i = [], 0
    while i < n:
        if windows[i] == 0:
            i += 1
            continue
        dive = i
        while dive < n and windows[dive] > 0:
            dive += 1
        full = [k for k in range(i, dive) if lengths[k]]
        out.append(Stretch(full[0], full[-1] + 1, max(windows[i:dive]), sum(lengths[k] for k in full)))
        i = dive
    return out


def article_of(html: str | None) -> str:
    """The main text: blocks joined by an empty line."""
    if not html:
        return ""
    lines = lines_of(html)
    found = stretches([x.length for x in lines])
    if not found:
        return ""
    surge = min(SURGE_CHARS, SURGE_SHARE * max(x.peak for x in found))
    least = REGION_SHARE * max(x.mass for x in found)
    high = [x.peak >= surge and (x.peak >= SURGE_CHARS or x.mass >= least) for x in found]
    kept, left, after = list(high), [], None
    for k, ok in enumerate(high):
        left.append(k if ok else left[-1] if left else None)
    for k in range(len(found) - 1, -1, -1):
        if high[k]:
            after = k
        elif left[k] is not None and after is not None:
            box = lines[found[k].lo].around
            kept[k] = all(box in lines[found[x].lo][2:] for x in (left[k], after))
    return "\n\n".join(lines[k].text for x, ok in zip(found, kept, strict=True) if ok for k in range(x.lo, x.hi) if lines[k].text)


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id, url, text, n_chars."""
    small_batches(pages)
    slim = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [article_of(x.as_py()) for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return slim.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").toDF(id_col, url, "text", "n_chars")
