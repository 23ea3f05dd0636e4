"""Interval algebra over page ranges.

Unions of ranges are bitmaps that merge: one row for 64 pages, combined by OR. A key
with very many ranges is split over tasks like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


WORD, BLOCK = 64, 4096


def page_words(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Bitmaps of the integers in closed ranges: keys, word, bits; one row a word of a key.

    Even words, 2 n, have a bit for each page from 64 n on; odd ones, 2 n + 1, for each
    block of 4096 pages from block 64 n on, set where one range covers the block whole.
    Words of two ranges combine by OR, so they are merged before the shuffle, and a
    key's ranges are neither sorted nor gathered. A range takes a row for 64 of its
    pages, or of its blocks where it covers some; one of 10^9 pages takes 3,900. Null
    and reversed ranges hold nothing; they leave an empty word to the key.
    """
    a, b = F.col(start).cast("long"), F.col(end).cast("long")
    rows = df.select(*keys, a.alias("__a"), F.when(a <= b, b).alias("__b"))
    a, b = F.col("__a"), F.col("__b")
    c, d = F.shiftright(a + (BLOCK - 1), 12), F.shiftright(b + 1, 12)  # whole blocks from c up to, and without, d
    span = lambda lo, hi, odd: F.sequence(F.shiftleft(F.shiftright(lo, 6), 1) + odd, F.shiftleft(F.shiftright(hi, 6), 1) + odd, F.lit(2).cast("long"))
    none = F.array().cast("array<bigint>")
    head = F.when(a < c * BLOCK, span(a, c * BLOCK - 1, 0)).otherwise(none)
    tail = F.when(d * BLOCK <= b, span(d * BLOCK, b, 0)).otherwise(none)
    codes = F.when(b.isNull(), F.array(F.lit(0).cast("long"))).when(c < d, F.concat(head, span(c, d - 1, 1), tail)).otherwise(span(a, b, 0))
    rows = rows.select(*keys, "__a", "__b", F.explode(codes).alias("word"))
    odd, at = F.col("word") % 2 != 0, F.shiftleft(F.shiftright("word", 1), 6)
    first = F.greatest(F.when(odd, c).otherwise(a) - at, F.lit(0))
    last = F.least(F.when(odd, d - 1).otherwise(b) - at, F.lit(WORD - 1))
    bits = F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (WORD - 1 - last + first).cast("int")), first.cast("int"))
    return rows.groupBy(*keys, "word").agg(F.bit_or(F.when(b.isNull(), F.lit(0)).otherwise(bits)).alias("bits"))


def merge_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """One row a word from several, such as bitmaps kept from day to day and those of today."""
    return words.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))


def measure_words(words: DataFrame, keys: list[str], name: str = "pages") -> DataFrame:
    """Integers in the union that the words of a key stand for; a block counts once, by whichever level has more of it."""
    odd, at = F.col("word") % 2 != 0, F.shiftright("word", 1)
    marked = F.transform(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit("bits", i) == 1), lambda i: at * WORD + i)
    places = F.when(odd, marked).otherwise(F.array(F.shiftright(at, 6)))
    blocks = words.select(*keys, F.explode(places).alias("__block"), F.when(odd, F.lit(BLOCK)).otherwise(F.bit_count("bits")).alias("__n"))
    blocks = blocks.groupBy(*keys, "__block").agg(F.least(F.lit(BLOCK), F.sum("__n")).alias("__n"))
    return blocks.groupBy(*keys).agg(F.sum("__n").cast("long").alias(name))


def union_measure(df: DataFrame, keys: list[str], start: str, end: str, name: str = "pages") -> DataFrame:
    """Integers covered by the union of closed ranges, by key; a key whose ranges are all null or reversed has 0."""
    return measure_words(page_words(df, keys, start, end), keys, name)


def exact_claims(old: DataFrame, new: DataFrame, keys: list[str], order_old: str, order_new: str) -> DataFrame:
    """Equal ranges, each old row claimed at most once, first come first served: the new rows with what they claim.

    Both sides are one table, so that rows dealt by a part of ``keys`` are not shuffled again.
    Null keys equal none.
    """
    mine, theirs = ([c for c in df.columns if c not in keys] for df in (new, old))
    none = lambda df, names: (F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names)
    both = new.select(*keys, *mine, *none(old, theirs), F.lit(True).alias("__new")).unionByName(old.select(*keys, *none(new, mine), *theirs, F.lit(False).alias("__new")))
    place = Window.partitionBy(*keys, "__new").orderBy(F.when(F.col("__new"), F.col(order_new)), F.when(~F.col("__new"), F.col(order_old)))
    claim = F.first(F.when(~F.col("__new"), F.struct(*theirs)), ignorenulls=True).over(Window.partitionBy(*keys, "__n"))
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    out = both.withColumn("__n", F.row_number().over(place)).withColumn("__claim", F.when(known, claim)).filter("__new")
    return out.select(*(F.col(k).cast(new.schema[k].dataType).alias(k) for k in keys), *mine, *(F.col(f"__claim.{c}").alias(c) for c in theirs))


def overlaps(old: DataFrame, new: DataFrame, key: str, old_range: tuple[str, str], new_range: tuple[str, str], step: int = 32, wide: int = 4096) -> DataFrame:
    """Pairs of one key whose closed ranges meet, with the common part.

    Both sides are cut at multiples of ``step`` and meet by key and cut, so that ranges
    far apart are never paired, however many a key has; a pair counts at its first cut.
    A range of more than ``wide`` steps is cut at multiples of ``wide * step`` instead: it
    meets the long ones of the other side there, and the short ones, which are cut in
    both ways but meet each other only at the fine cuts. One of 10^9 pages takes 7,600
    rows. Null and reversed ranges meet none.
    """
    (a, b), (c, d) = old_range, new_range

    def cuts(df: DataFrame, x: str, y: str, coarse: int) -> DataFrame:
        """Four times the cut and its kind: 0 short and short, 1 long and long, 2 old long and new short, 3 old short and new long."""
        large, four = step * wide, F.lit(4).cast("long")
        at = lambda kind, s: F.sequence(F.floor(F.col(x) / s) * 4 + kind, F.floor(F.col(y) / s) * 4 + kind, four)
        is_long = F.col(y) - F.col(x) >= large
        codes = F.when(is_long, F.concat(at(1, large), at(coarse, large))).otherwise(F.concat(at(0, step), at(5 - coarse, large)))
        return df.filter(F.col(x) <= F.col(y)).withColumn("__cut", F.explode(codes))

    both = cuts(new, c, d, 3).join(cuts(old, a, b, 2), [key, "__cut"]).filter((F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)))
    unit = F.when(F.col("__cut") % 4 == 0, step).otherwise(step * wide)
    both = both.filter(F.floor(F.col("__cut") / 4) == F.floor(F.greatest(a, c) / unit)).drop("__cut")
    return both.withColumn("from", F.greatest(a, c)).withColumn("to", F.least(b, d))


def overlapping_keys(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Keys of which two ranges overlap: those whose ranges together are longer than their union.

    Both sides are sums that combine before the shuffle. Null and reversed ranges overlap none.
    """
    rows = df.filter(F.col(start) <= F.col(end))
    every = rows.groupBy(key).agg(F.sum(F.col(end).cast("long") - F.col(start) + 1).alias("__all"))
    union = measure_words(page_words(rows, [key], start, end), [key], "__once").withColumnRenamed(key, "__key")
    return every.join(union, F.col(key).eqNullSafe(F.col("__key"))).filter(F.col("__all") > F.col("__once")).select(key)


def covered(sections: DataFrame, pages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Sections all of whose pages are there, with the texts joined by an empty line.

    ``sections`` has start_page and end_page (null: one page); ``pages`` has page and the
    text. An empty page counts as there and adds nothing; sections of one key are one. Each
    range of pages is read once, however many sections have it, and only a range without
    a gap carries its texts. Sections of one range, most of them, meet their text after the
    shuffle by key; only the texts of a key with several ranges are shuffled.
    """
    last = F.greatest("start_page", F.coalesce("end_page", "start_page"))
    wide = sections.filter("start_page is not null").select(*keys, F.col("start_page").alias("__a"), last.alias("__b"))
    ranges = wide.select("__a", "__b").distinct().withColumn("page", F.explode(F.sequence("__a", "__b")))
    parts = F.collect_list(F.when(F.coalesce(F.col(text), F.lit("")) != "", F.struct("page", F.col(text).alias("t"))))
    joined = lambda p: F.array_join(F.transform(p, lambda x: x["t"]), "\n\n")
    read = ranges.join(pages, "page", "left").groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col(text).isNull()).alias("n_missing"), F.sort_array(parts).alias("parts"))
    read = read.select(F.col("__a").alias("__ra"), F.col("__b").alias("__rb"), "n_pages", "n_missing", F.when(F.col("n_missing") == 0, F.col("parts")).alias("parts"))
    meets = (F.col("__a") == F.col("__ra")) & (F.col("__b") == F.col("__rb"))
    by_key = wide.groupBy(*keys).agg(F.collect_list(F.struct("__a", "__b")).alias("__r"))
    single = by_key.filter(F.size("__r") == 1).select(*keys, F.col("__r")[0]["__a"].alias("__a"), F.col("__r")[0]["__b"].alias("__b"))
    single = single.join(read.withColumn("text", joined("parts")).drop("parts"), meets).select(*keys, "n_pages", "n_missing", "text")
    several = by_key.filter(F.size("__r") > 1).select(*keys, F.explode("__r").alias("__r")).select(*keys, "__r.__a", "__r.__b").join(read, meets)
    several = several.groupBy(*keys).agg(F.sum("n_pages").alias("n_pages"), F.sum("n_missing").alias("n_missing"), F.sort_array(F.flatten(F.collect_list("parts"))).alias("parts"))
    return single.unionByName(several.select(*keys, "n_pages", "n_missing", F.when(F.col("n_missing") == 0, joined("parts")).alias("text")))


def _read_before(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, ord, read_pages, last_read: what read old ranges say of new ones; new ones that meet none have no row."""
    pairs = overlaps(old.filter("is_read"), new, key, ("start_page", "end_page"), ("start", "end"))
    pages = union_measure(pairs, [key, "ord"], "from", "to", "read_pages")
    return pages.join(pairs.groupBy(key, "ord").agg(F.max("read_at").alias("last_read")), [key, "ord"])


def _mostly(pages: Column) -> Column:
    return pages * 2 > F.col("end") - F.col("start") + 1


def carry_over(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Read state of new ranges from old ones.

    ``old``: key, start_page, end_page, is_read, read_at. ``new``: key, ord, start, end. A
    new range is read if read old ranges cover more than half of it; read_at is their latest.
    """
    out = new.join(_read_before(old, new, key), [key, "ord"], "left")
    n = F.coalesce("read_pages", F.lit(0))
    return out.select(key, "ord", "start", "end", n.alias("read_pages"), _mostly(n).alias("is_read"), F.when(_mostly(n), F.col("last_read")).alias("read_at"))


def replace_structure(old: DataFrame, new: DataFrame, key: str, now: Column, texts: Sequence[str] = ("text",)) -> DataFrame:
    """Sections after a new structure is saved: live old ones as tombstones, and the new ones.

    ``old``: key, ord, start_page, end_page, is_read, read_at, deleted_at and ``texts``;
    ``new``: key, ord, start, end. A new section with exactly an old one's range keeps its
    texts and the time it was read, each old one claimed once; read state is carried over.
    """
    alive = old.filter("deleted_at is null")
    gone = old.withColumn("deleted_at", F.coalesce("deleted_at", now)).withColumn("is_new", F.lit(False))
    kept = [F.col(x).alias(f"__{x}") for x in ("read_at", *texts)]
    ranges = alive.select(key, F.col("start_page").alias("start"), F.col("end_page").alias("end"), F.col("ord").alias("__ord"), *kept)
    claimed = exact_claims(ranges, new.select(key, "start", "end", "ord"), [key, "start", "end"], "__ord", "ord")
    before = _read_before(alive.select(key, "start_page", "end_page", "is_read", "read_at"), new, key)
    both = claimed.join(before, [key, "ord"], "left").withColumn("is_read", _mostly(F.coalesce("read_pages", F.lit(0))))
    read_at = F.when(F.col("is_read"), F.coalesce("__read_at", "last_read", now))
    made = {"start_page": F.col("start"), "end_page": F.col("end"), "read_at": read_at, "deleted_at": F.lit(None).cast(old.schema["deleted_at"].dataType)}
    made |= {x: F.col(f"__{x}") for x in texts} | {x: F.col(x) for x in (key, "ord", "is_read")}
    columns = [c for c in old.columns if c in made]
    fresh = both.select(*(made[c].cast(old.schema[c].dataType).alias(c) for c in columns), F.lit(True).alias("is_new"))
    return gone.select(*columns, "is_new").unionByName(fresh)


def range_ends(leaves: DataFrame, doc: str, total: Column) -> DataFrame:
    """Ends of leaves in document order: doc, ord, chapter, page.

    A chapter ends before the leaf after its last section, else at the last page; a
    section ends before the next section, the last of a chapter where the chapter
    does; none ends before it starts. A missing page falls back and is not skipped.
    """
    order = Window.partitionBy(doc).orderBy("ord")
    next_page, next_chapter = F.lead("page").over(order), F.lead("chapter").over(order)
    start = F.coalesce("page", F.lit(1))
    df = leaves.withColumn("start", start).withColumn("__next", next_page).withColumn("__last", next_chapter.isNull() | (next_chapter != F.col("chapter")))
    bound = F.max(F.when(F.col("__last"), F.coalesce(F.col("__next") - 1, total))).over(Window.partitionBy(doc, "chapter"))
    first = F.min_by("start", "ord").over(Window.partitionBy(doc, "chapter"))
    df = df.withColumn("chapter_start", first).withColumn("chapter_end", F.greatest(first, bound))
    end = F.when(F.col("__last"), F.col("chapter_end")).otherwise(F.coalesce(F.col("__next") - 1, F.col("chapter_end")))
    return df.withColumn("end", F.greatest(F.col("start"), end)).drop("__next", "__last")


def batch_size(pages: Column) -> Column:
    """Pages a chapter for a book without an outline."""
    return F.when(pages <= 20, pages).when(pages <= 100, 10).when(pages <= 500, 20).otherwise(30)


def batch_structure(books: DataFrame, pages: str) -> DataFrame:
    """One row a page: its chapter (from 0) and place; chapters of ``batch_size`` pages."""
    size = batch_size(F.col(pages)).cast("int")
    out = books.filter(F.col(pages) > 0).withColumn("size", size).withColumn("page", F.explode(F.sequence(F.lit(1), F.col(pages).cast("int"))))
    chapter = F.floor((F.col("page") - 1) / F.col("size")).cast("int")
    return out.withColumn("chapter", chapter).withColumn("place", (F.col("page") - chapter * F.col("size")).cast("int"))
