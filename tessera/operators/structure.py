"""Document structure from positioned text items and outlines.

Lines, paragraphs and words are expressions, windows and folds on a page's items; only the
walk over an outline, a tree of titles, is a grouped map by document.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import python_text as py
from ..functions import text as tx


@dataclass(frozen=True)
class Layout:
    """Thresholds of the page parser, as shares of the page height or of a median."""

    paragraph_gap: float = 1.5
    header_band: float = 0.1
    footer_band: float = 0.1
    heading: float = 1.15
    footnote: float = 0.85


# fixed values: lines of page heads and feet by pattern
HEAD = (r"(?i)^(chapter|part|section)\s+[\divxlc]+", r"(?i)^\d+\s+(chapter|part|section)", r"^[IVXLC]+\.\s", r"^\d+(?:\.\d+)+\s+\S", r"^\d+\s+[A-Z][A-Z\s\d]+\z", r"^[A-Z][A-Z\s]{10,}\d*\z")
FOOT = (r"^\d+\z", r"^[-–—]\s*\d+\s*[-–—]\z", r"(?i)^page\s+\d+")
NOTE = r"^(\d+|[*†‡§¶]|\(\d+\))\s*(.+)"

def numbered(items: DataFrame) -> DataFrame:
    """The items with ``line`` and ``place`` (their order on the page), and ``top``.

    From the top, an item belongs to the line whose first item is less than half the
    greater of the two heights away. That is a fold over a page's items in order, of
    which only heights and places are held.
    """
    top = F.col("page_height") - F.col("y")
    fields = [c for c in items.columns if c not in ("doc", "page")]
    rest = F.struct(*(F.col(c) for c in fields))
    pages = items.groupBy("doc", "page").agg(F.sort_array(F.collect_list(F.struct(top.alias("top"), F.col("x").cast("double").alias("at"), rest.alias("item")))).alias("items"))
    start = F.struct(F.lit(-1).alias("n"), F.lit(0.0).alias("anchor"), F.lit(0.0).alias("height"), F.array().cast("array<int>").alias("lines"))

    def step(s: Column, x: Column) -> Column:
        h = x["item"]["height"].cast("double")
        new = (s["n"] < 0) | (F.abs(x["top"] - s["anchor"]) >= F.greatest(h, s["height"]) * 0.5)
        n = F.when(new, s["n"] + 1).otherwise(s["n"])
        return F.struct(n.alias("n"), F.when(new, x["top"].cast("double")).otherwise(s["anchor"]).alias("anchor"), F.when(new, h).otherwise(s["height"]).alias("height"), F.array_append(s["lines"], n).alias("lines"))

    lines_ = F.aggregate("items", start, step, lambda s: s["lines"])
    rows = pages.select("doc", "page", F.posexplode(F.arrays_zip(F.col("items").alias("i"), lines_.alias("l"))).alias("place", "z"))
    return rows.select("doc", "page", F.col("z.l").alias("line"), "place", F.col("z.i.top").alias("top"), "z.i.item.*")


def lines(items: DataFrame) -> DataFrame:
    """doc, page, line, y (from the top), height, text... from doc, page, page_height, str, x, y, height, font."""
    across = F.array_sort(F.collect_list(F.struct("x", "place", "str", "font")))
    out = numbered(items).groupBy("doc", "page", "line").agg(F.min_by("top", "place").alias("y"), F.avg("height").alias("height"), F.min_by("page_height", "place").alias("page_height"), across.alias("r"))
    part = lambda f: F.transform("r", f)
    text = F.trim(F.array_join(part(lambda x: x["str"]), " "))
    return out.select("doc", "page", "line", "y", "height", "page_height", text.alias("text"), part(lambda x: x["font"]).alias("fonts"), part(lambda x: F.length(x["str"])).alias("chars"))


def classify_lines(lines_: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Adds ``kind``: header, footer, footnote or body; and ``heading`` for larger body lines.

    Footnotes count from a little above the foot band, but only those inside it leave
    the body. A line in a band with none of the page's dominant font is no body either.
    """
    foot_of = lambda height: height * (1 - layout.footer_band)
    in_middle = lambda x: (x["y"] > x["page_height"] * layout.header_band) & (x["y"] < foot_of(x["page_height"]))
    note = lambda y, height, page_height, text: (height < F.col("median") * layout.footnote) & (y > foot_of(page_height) * 0.85) & text.rlike(NOTE)
    named = lambda **x: F.named_struct(*(y for k, v in x.items() for y in (F.lit(k), v)))
    # what a page says of its lines is found once a page, whose lines are one row for that
    line = F.struct(*(c for c in lines_.columns if c not in ("doc", "page")))
    df = lines_.groupBy("doc", "page").agg(F.median("height").alias("median"), F.collect_list(line).alias("every"))
    known = F.col("doc").isNotNull() & F.col("page").isNotNull()  # else the page has no main font
    each = F.transform(F.filter("every", lambda x: known & in_middle(x)), lambda x: F.transform(x["fonts"], lambda f, at: named(font=f, n=F.get(x["chars"], at).cast("long"), line=x["line"], at=at)))
    df = df.withColumn("items", F.filter(F.flatten(each), lambda z: F.coalesce(z["font"], F.lit("")) != ""))

    def weight(font: Column) -> Column:
        """What decides between fonts: more characters, then the first place."""
        its = F.filter("items", lambda z: z["font"] == font)
        n = F.aggregate(its, F.lit(None).cast("long"), lambda a, z: F.coalesce(a + z["n"], a, z["n"]))
        return named(n=-n, first=F.array_min(F.transform(its, lambda z: named(line=z["line"], at=z["at"]))), font=font)

    main = F.array_min(F.transform(F.array_distinct(F.transform("items", lambda z: z["font"])), weight))["font"]
    has_notes = F.exists("every", lambda x: note(x["y"], x["height"], x["page_height"], x["text"]))
    df = df.select("doc", "page", "median", "every", main.alias("main_font"), has_notes.alias("has_notes"))  # before the lines are apart, else once a line
    df = df.withColumn("x", F.explode("every")).select("doc", "page", "x.*", "median", "main_font", "has_notes")
    head, foot = F.col("page_height") * layout.header_band, foot_of(F.col("page_height"))
    df = df.withColumn("in_head", F.col("y") < head).withColumn("in_foot", F.col("y") > foot)
    text = F.col("text")
    strange = F.col("main_font").isNotNull() & ~F.array_contains("fonts", F.col("main_font")) & (F.length(text) < 100)
    larger, small = F.col("height") > F.col("median") * layout.heading, F.col("height") < F.col("median") * layout.footnote
    header = F.col("in_head") & (tx.any_of(text, HEAD) | larger | strange)
    footer = F.col("in_foot") & (tx.any_of(text, FOOT) | tx.any_of(text, HEAD) | ((F.length(text) < 80) & (F.col("height") <= F.col("median"))) | strange)
    df = df.withColumn("noted", note(F.col("y"), F.col("height"), F.col("page_height"), text))
    kind = F.when(header, "header").when(F.col("has_notes") & F.col("in_foot") & small, "footnote").when(footer, "footer").otherwise("body")
    return df.withColumn("kind", kind).withColumn("heading", (kind == "body") & larger).drop("in_head", "in_foot", "has_notes")


def paragraphs(classified: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """doc, page, paragraph, text, heading: body lines joined.

    A paragraph ends where the gap is over 1.5 times the page's median gap or where
    headings begin or end; a hyphen at a line's end goes.
    """
    body = classified.filter("kind = 'body'")
    per = Window.partitionBy("doc", "page")
    order = per.orderBy("line")
    gap = F.col("y") - F.lag("y").over(order)
    df = body.withColumn("gap", gap).withColumn("before", F.lag("heading").over(order))
    most = F.coalesce(F.median("gap").over(per), F.col("median") * 1.5) * layout.paragraph_gap
    new = F.coalesce((F.col("gap") > most) | (F.col("heading") != F.col("before")), F.lit(False)).cast("int")
    df = df.withColumn("new", new).withColumn("paragraph", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("line", "text")))
    return df.groupBy("doc", "page", "paragraph").agg(tx.dehyphenate(F.transform(parts, lambda x: x["text"])).alias("text"), F.min("heading").alias("heading"))


def merge_pages(paragraphs_: DataFrame) -> DataFrame:
    """Paragraphs that run on to the next page joined.

    A page's first paragraph goes to the last one of the page before, if neither is a
    heading, the one before has no closing mark and this one begins in lower case. A page
    whose only paragraph has gone has nothing to add to, so that in a row of such pages
    every other one goes: a count within the row, and no page waits for another.
    """
    every = F.sort_array(F.collect_list(F.struct("paragraph", "text", "heading")))
    pages = paragraphs_.filter("doc is not null and page is not null").groupBy("doc", "page").agg(every.alias("every"))
    first, last = F.col("every")[0], F.element_at("every", -1)
    # all that a page's place among others takes of its text is found before the windows; a page goes through them as one row
    opens = ~first["heading"] & (first["text"] != "") & first["text"].rlike("^[a-z]")
    ends_open = ~last["heading"] & (last["text"] != "") & ~last["text"].rlike(r'[.!?:;"”]\z')
    pages = pages.select("doc", "page", "every", opens.alias("opens"), ends_open.alias("ends_open"), (F.size("every") == 1).alias("single"))
    order = Window.partitionBy("doc").orderBy("page")
    pages = pages.withColumn("may", F.coalesce(F.lag("ends_open").over(order) & F.col("opens"), F.lit(False)))
    pages = pages.withColumn("link", F.col("may") & F.coalesce(F.lag("may").over(order) & F.lag("single").over(order), F.lit(False)))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    pages = pages.withColumn("row", F.sum((F.col("may") & ~F.col("link")).cast("int")).over(upto))
    place = F.sum(F.col("link").cast("int")).over(Window.partitionBy("doc", "row").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    pages = pages.withColumn("goes", F.col("may") & (place % 2 == 0))
    pages = pages.withColumn("more", F.when(F.lead("goes").over(order), F.lead(first["text"]).over(order))).withColumn("last", last["paragraph"])
    out = pages.select("doc", "page", "goes", "more", "last", F.explode("every").alias("x")).select("doc", "page", "goes", "more", "last", "x.*")
    out = out.filter(~(F.col("goes") & (F.col("paragraph") == 0)))
    text = F.when((F.col("paragraph") == F.col("last")) & F.col("more").isNotNull(), F.concat_ws(" ", "text", "more")).otherwise(F.col("text"))
    return out.select("doc", "page", (F.col("paragraph") - F.col("goes").cast("int")).alias("paragraph"), text.alias("text"), "heading")


def styled_words(items: DataFrame) -> DataFrame:
    """doc, page, line, word, text, bold, italic, x, width: words of each line with style and place.

    A word lies in one item, as items are apart by a space, so that all its characters
    have the item's style; its place is interpolated in the item.
    """
    # runs of white and of other characters, with the offset of each
    runs = F.split("str", r"(?<=\s)(?=\S)|(?<=\S)(?=\s)")
    sizes = F.transform("runs", lambda r: F.length(r))
    offset = lambda i: F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, b: a + b)
    found = F.filter(F.transform("runs", lambda r, i: F.struct(r.alias("text"), offset(i).alias("at"))), lambda r: r["text"].rlike(r"\S"))
    rows = numbered(items).withColumn("runs", runs).withColumn("sizes", sizes).withColumn("w", F.explode(found))
    font, step = F.coalesce("font", F.lit("")), F.col("width") / F.greatest(F.lit(1), F.length("str"))
    word = F.row_number().over(Window.partitionBy("doc", "page", "line").orderBy("x", "place", "w.at")) - 1
    return rows.select(
        "doc", "page", "line", word.alias("word"), F.col("w.text").alias("text"), font.rlike("(?i)bold|black|heavy|demi").alias("bold"), font.rlike("(?i)italic|oblique").alias("italic"),
        (F.col("x") + F.col("w.at") * step).alias("x"), (step * F.length("w.text")).alias("width"),
    )


def text_pages(classified: DataFrame, key: str = "doc_id", n: str = "n") -> DataFrame:
    """key, header, level, paragraphs, lists, figures, footnotes: a page of a text whose lines have a ``kind``.

    Body lines make paragraphs of one kind; a blank line ends one, a line of another kind
    too, and a subheading stands alone. Headers are joined, the least level counts.
    """
    order, kind = Window.partitionBy(key).orderBy(n), F.col("kind")
    flows = ~kind.isin("junk", "header", "figure", "list", "footnote")
    before = F.last(F.when(flows, kind), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = flows & ((kind != F.coalesce("before", F.lit("blank"))) | (kind == "subheading"))
    run = F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = classified.withColumn("before", before).withColumn("run", run).withColumn("run", F.when(flows & (kind != "blank"), F.col("run")))
    # one pass: lines of a run, and those of each kind apart from runs, are a row; then a page is
    held = F.when(~kind.isin("blank", "junk"), F.struct(F.col(n).alias("n"), F.col("line").alias("c")))
    parts = rows.groupBy(key, "run", "kind").agg(F.transform(F.array_sort(F.collect_list(held)), lambda x: x["c"]).alias("lines"))
    block = F.when(F.col("run").isNotNull(), F.struct("run", "kind", tx.dehyphenate(F.transform("lines", tx.trim)).alias("text")))
    names = ("header", "list", "figure", "footnote")
    out = parts.groupBy(key).agg(F.array_sort(F.collect_list(block)).alias("blocks"), *(F.first(F.when(kind == k, F.col("lines")), ignorenulls=True).alias(k) for k in names))
    some = lambda name, f: F.coalesce(F.transform(name, f), F.array())
    return out.select(
        key, F.nullif(F.array_join(F.transform("header", tx.trim), " | "), F.lit("")).alias("header"), F.array_min(F.transform("header", lambda x: tx.header_level(tx.trim(x)))).alias("level"),
        some("list", tx.list_item).alias("lists"), some("figure", lambda x: tx.caption(tx.trim(x))).alias("figures"), some("footnote", lambda x: tx.footnote(tx.trim(x))).alias("footnotes"),
        F.when(F.size("blocks") > 0, F.transform("blocks", lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text")))).alias("paragraphs"),
    )


def outline_paths(nodes: DataFrame, most_levels: int = 100) -> DataFrame:
    """doc, path, title, page from rows that name their parents: doc, id, parent, place, title, page.

    ``parent`` is null at the top; siblings are in order of ``place``. Levels are found one
    after the other by a recursive query. Rows below a parent that is not there, or in a
    circle, are in no level; more than ``most_levels`` levels raise an error.
    """
    spark = nodes.sparkSession
    limit = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(limit, -1)  # levels are bounded, rows are not
    return spark.sql(
        f"""with recursive t(doc, id, path, title, page) max recursion level {int(most_levels)} as (
              select doc, id, array(place), title, page from {{nodes}} where parent is null
              union all
              select n.doc, n.id, array_append(t.path, n.place), n.title, n.page from t join {{nodes}} n on n.doc = t.doc and n.parent = t.id)
            select doc, path, title, page from t""",
        nodes=nodes,
    )


def outline_leaves(nodes: DataFrame) -> DataFrame:
    """Leaves in document order from outline rows: doc, path (array of places), title, page.

    A node whose children are all leaves is a chapter; one with deeper children groups
    them, and its own runs of leaves are chapters too. A node that starts before its
    children opens with a section of its own. Chapters are named by the path of titles,
    except that a leaf at the top names itself.

    Titles of ancestors come by an equi join on every prefix of a path, what a node needs
    of its children by one aggregation; only the numbers need a document's leaves in
    order. Of rows with one path the greatest title counts; rows below a node that is not
    there are left out.
    """
    up = lambda path: F.slice(path, F.lit(1), F.size(path) - 1)
    node = nodes.groupBy("doc", "path").agg(F.max(F.struct("title", "page")).alias("x")).select("doc", "path", "x.title", F.col("x.page").cast("int").alias("page"))
    inner = node.filter(F.size("path") > 1).select("doc", up(F.col("path")).alias("path")).distinct()
    marked = node.join(inner.withColumn("inner", F.lit(True)), ["doc", "path"], "left").withColumn("inner", F.coalesce("inner", F.lit(False)))
    below = marked.filter(F.size("path") > 1).groupBy("doc", up(F.col("path")).alias("path")).agg(F.min_by("page", "path").alias("first"), F.min("page").alias("least"), F.bool_or("inner").alias("deep"))
    steps = inner.withColumn("d", F.explode(F.sequence(F.lit(1), F.size("path")))).withColumn("step", F.slice("path", F.lit(1), F.col("d")))
    titles = node.select("doc", F.col("path").alias("step"), "title")
    names = steps.join(titles, ["doc", "step"]).groupBy("doc", "path").agg(F.array_sort(F.collect_list(F.struct("d", "title"))).alias("t"))
    names = names.filter(F.size("t") == F.size("path")).select("doc", F.col("path").alias("owner"), F.array_join(F.transform("t", lambda x: x["title"]), " > ").alias("chapter_title"))

    leaves = marked.filter(~F.col("inner")).select("doc", "path", "title", "page", up(F.col("path")).alias("owner"))
    own = marked.filter("inner and page is not null").join(below, ["doc", "path"]).filter(F.col("page") < F.when(F.col("deep"), F.col("least")).otherwise(F.col("first")))
    own = own.select("doc", "path", F.concat("title", F.lit(" — Introduction")).alias("title"), "page", F.col("path").alias("owner"))
    top = leaves.filter(F.size("owner") == 0).withColumn("chapter_title", F.col("title")).withColumn("owner", F.col("path"))
    rows = leaves.filter(F.size("owner") > 0).unionByName(own).join(names, ["doc", "owner"]).unionByName(top)

    order = Window.partitionBy("doc").orderBy("path")
    fresh = F.coalesce(F.lag("owner").over(order) != F.col("owner"), F.lit(True)).cast("int")
    rows = rows.withColumn("fresh", fresh).withColumn("chapter", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return rows.withColumn("ord", F.row_number().over(order)).select("doc", "ord", "chapter", "chapter_title", "title", "page")


def page_offset(entries: DataFrame, pages: DataFrame, labels: DataFrame | None = None, first: int = 1, last: int = 150, most_entries: int = 5, most_found: int = 3) -> DataFrame:
    """offset, source: how far printed page numbers are from places in the file.

    ``labels`` (page from 1, label) decides if one is "1". Else titles vote: a page that
    names exactly one entry (ord, title, start_page) gives an offset; the first three
    entries found count, the most frequent offset wins, and the first seen on a tie.
    """
    spark = entries.sparkSession
    e = entries.orderBy("ord").withColumn("needles", py.title_needles("title")).filter(F.size("needles") > 0).limit(most_entries)
    # at most ``most_entries`` entries, as one array that every page is held against
    looked_for = e.agg(F.collect_list(F.struct("ord", "start_page", "needles"))).scalar()
    p = pages.filter(F.col("page").between(max(1, first), first + last - 1)).select("page", py.normalize("text").alias("norm"))
    named = F.filter("entries", lambda x: F.exists(x["needles"], lambda n: F.contains(F.col("norm"), n)))
    hits = p.withColumn("entries", looked_for).select("page", F.explode(named).alias("x")).select("page", "x.ord", "x.start_page").distinct()
    single = hits.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("page"))).filter("n = 1")
    found = single.groupBy("ord", "start_page").agg(F.min("page").alias("page")).orderBy("page").limit(most_found)
    votes = found.select((F.col("page") - F.col("start_page")).alias("offset"), "page").groupBy("offset").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("first"))
    best = votes.orderBy(F.desc("n"), "first").limit(1).select(F.lit(1).alias("rank"), F.col("offset").cast("int").alias("offset"), F.lit("titles").alias("source"))
    every = best.union(spark.createDataFrame([(2, 0, "none")], "rank int, offset int, source string"))
    if labels is not None:
        one = labels.filter(tx.trim(F.col("label")) == "1").agg(F.min("page").alias("p")).filter("p is not null")
        every = every.union(one.select(F.lit(0), (F.col("p") - 1).cast("int"), F.lit("labels")))
    return every.orderBy("rank").limit(1).select("offset", "source")


def flatten_chapters(nested: DataFrame, column: str = "chapters") -> DataFrame:
    """Chapters with sections to rows named ``A > B``; a chapter without sections stays one row."""
    rows = nested.select(F.posexplode(column).alias("i", "c")).select("i", "c.title", F.posexplode_outer("c.sections").alias("j", "s"))
    return rows.select(F.col("i"), F.coalesce("j", F.lit(0)).alias("j"), F.when(F.col("s").isNull(), F.col("title")).otherwise(F.concat("title", F.lit(" > "), F.col("s"))).alias("title"))


def knowledge_text(word: Column, translation: Column, context: Column) -> Column:
    """Optional parts as one text."""
    part = lambda label, c: F.when(F.coalesce(tx.trim(c), F.lit("")) != "", F.concat(F.lit(label), tx.trim(c)))
    return F.concat_ws(". ", part("", word), part("Translation: ", translation), part("Context: ", context))
