"""Column expressions over plain text and XHTML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: abbreviations that end no sentence, as suffixes without a word boundary
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "vs", "etc", "Inc", "Ltd", "Corp", "St", "Ave", "approx", "ca", "cf", "e.g", "i.e", "al")

# fixed values: kinds of lines by pattern; the first kind that matches wins
JUNK = (r"^\d+\s*\z", r"^[-–—]\s*\d+\s*[-–—]\z", r"^(?i:page)\s+\d+", r"^\d+\s+[A-Z][A-Z\s]+[A-Z]\s+\d+\z")
HEADER = (r"^(?i)(chapter|part|section)\s+[\divxlc]+", r"^(?i)\d+\s+(chapter|part|section)", r"^(\d+\.)+\d*\s+\S", r"^[IVXLC]+\.\s", r"^\d+\s+[A-Z][A-Z\s]{4,}\z", r"^[A-Z][A-Z\s]{10,}\z")
CAPTION = (r"^(?i)(figure|fig\.|table|diagram|chart)\s+\d",)
BULLETS = "•‣◦⁃∙•·"
LIST_ITEM = (rf"^\s*[{BULLETS}-]\s+", r"^\s*\d+[.)\]]\s+", r"^(?i)\s*\([a-z\d]+\)\s+", r"^\s*[a-z][.)\]]\s+")
FOOTNOTE = (r"^(\d+|[*†‡§¶]|\(\d+\))\s+\S",)
QUOTE = (r"^\s{4,}", '^["“]', r"^—\s*[A-Z]")

# fixed values: content that needs a better reader: formulas, rules and tables
RICH = r"(?m)\$.*\$|\\frac|\\sum|\\int|\\sqrt|\\begin\{|\\end\{|\|[-+|]+\||[│┃┆┊]|^\s*[-|]+\s*$"
TABLE = r"(?m)(\t.*){2,}|(\s{2,}\S+){3,}"

EDGE_SPACE = " \t\n\v\f\r"  # what \s stands for in patterns
SQL_SPACE = " \t\n\f\r"  # what it stands for in the SQL, without the vertical tab


def trim(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(EDGE_SPACE))


def collapse(text: Column) -> Column:
    return trim(F.regexp_replace(text, r"\s+", " "))


def sentence_parts(text: Column) -> Column:
    """Split after ``.!?`` and white space before a capital or a quote, except after an abbreviation; not trimmed.

    Abbreviations are read from the left and share no mark: in ``Ave.g.`` and ``i.e.g.`` there is no ``e.g.``.
    """
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS).replace(r"e\.g", r"(?<!Av|i\.)e\.g")
    # the one-character test comes first, so that the long one is tried at sentence ends only
    return F.split(text, rf'(?<=[.!?])(?<!(?:{short})[.!?])[{SQL_SPACE}]+(?=[A-Z"“])')


def sentences(text: Column) -> Column:
    """The parts of a text without white space at their ends; the text itself if nothing is left."""
    kept = F.filter(F.transform(sentence_parts(text), trim), lambda s: s != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(text))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-case words, each padded by two spaces and one."""
    parts = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(parts, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams, at single precision; 0 without any."""
    x, y = trigrams(a), trigrams(b)
    every = F.size(F.array_union(x, y))
    return F.when(every > 0, F.size(F.array_intersect(x, y)) / every).otherwise(0.0).cast("float")


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def subheading(line: Column) -> Column:
    """3 to 80 characters, a capital first, no closing mark, at most 10 words, 40 % of them capitalised."""
    w = F.split(line, r"\s+")
    capital = F.size(F.filter(w, lambda x: x.rlike("^[A-Z]")))
    return (
        F.length(line).between(3, 80) & line.rlike("^[A-Z]") & ~line.rlike(r"[.,;:]\z") & (F.size(w) <= 10)
        & (capital >= F.size(w) * 0.4) & ~line.rlike(r"\(\d+\)")
    )


#: what a line is before and after the first header, by what it looks like alone; other kinds do not change
CONTEXT = {"subheading or quote": ("blockquote", "subheading"), "subheading": ("introduction", "subheading"), "body": ("introduction", "body")}


def line_look(line: Column, trimmed: Column) -> Column:
    """blank, junk, header, figure, list, footnote, blockquote or a key of ``CONTEXT``.

    ``trimmed`` is a column that holds ``trim(line)``, as it is looked at by most patterns.
    """
    t, quote = trimmed, any_of(line, QUOTE)
    return (
        F.when(t == "", "blank").when(any_of(t, JUNK), "junk").when(any_of(t, HEADER), "header").when(any_of(t, CAPTION), "figure")
        .when(any_of(line, LIST_ITEM), "list").when(any_of(t, FOOTNOTE), "footnote")
        .when(subheading(t), F.when(quote, "subheading or quote").otherwise("subheading")).when(quote, "blockquote").otherwise("body")
    )


def in_context(look: Column, after_header: Column) -> Column:
    """The kind of a line from its ``line_look``."""
    of = lambda kinds: F.when(after_header, kinds[1]).otherwise(kinds[0])
    return reduce(lambda rest, k: F.when(look == k, of(CONTEXT[k])).otherwise(rest), CONTEXT, look)


def line_kind(line: Column, after_header: Column) -> Column:
    """blank, junk, header, figure, list, footnote, subheading, blockquote, introduction or body."""
    return in_context(line_look(line, trim(line)), after_header)


def is_header(line: Column) -> Column:
    t = trim(line)
    return (t != "") & ~any_of(t, JUNK) & any_of(t, HEADER)


def header_level(line: Column) -> Column:
    """1 to 3; numbering decides before names."""
    named = F.when(line.rlike(r"^(?i)(chapter|part)\s") | line.rlike(r"^[A-Z][A-Z\s]{10,}\z"), 1).otherwise(2)
    return F.when(line.rlike(r"^(\d+\.){2,}\d*\s"), 3).when(line.rlike(r"^(\d+\.)\d+\s"), 2).when(line.rlike(r"^\d+\s+[A-Z]"), 1).otherwise(named)


def list_item(line: Column) -> Column:
    """Struct of marker, text and depth for the first list pattern that fits, else null."""
    depth = F.floor(F.length(F.regexp_extract(line, r"^(\s*)", 1)) / 2).cast("int").alias("depth")

    def item(p: str) -> Column:
        head = F.regexp_extract(line, f"({p})", 1)
        return F.struct(trim(head).alias("marker"), trim(F.substring(line, F.length(head) + 1, F.length(line))).alias("text"), depth)

    return reduce(lambda rest, p: F.when(line.rlike(p), item(p)).otherwise(rest), reversed(LIST_ITEM), F.lit(None))


def caption(line: Column) -> Column:
    """Struct of label and caption, else null."""
    label = F.regexp_extract(line, r"^((?i)(?:figure|fig\.|table|diagram|chart)\s+\d+(?:\.\d+)?)", 1)
    rest = trim(F.regexp_replace(F.substring(line, F.length(label) + 1, F.length(line)), r"^[.:;,]?\s*", ""))
    return F.when(any_of(line, CAPTION), F.struct(label.alias("label"), F.when(rest == "", line).otherwise(rest).alias("caption")))


def footnote(line: Column) -> Column:
    """Struct of marker and text, else null. The pattern takes the text's first character with it."""
    head = F.regexp_extract(line, f"({FOOTNOTE[0]})", 1)
    rest = trim(F.substring(line, F.length(head) + 1, F.length(line)))
    return F.when(any_of(line, FOOTNOTE), F.struct(F.regexp_extract(line, FOOTNOTE[0], 1).alias("marker"), F.when(rest == "", line).otherwise(rest).alias("text")))


def pages(text: Column) -> Column:
    """Page texts: split at form feeds or two empty lines, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, "\n{3,}|\f"), trim), lambda p: p != "")


def dehyphenate(lines: Column) -> Column:
    """Lines of an array joined: a closing hyphen goes, other ends become a space."""
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "-\n", ""), "\n", " ")


def rich(text: Column) -> Column:
    return text.rlike(RICH) | text.rlike(TABLE)


def needs_ocr(text: Column) -> Column:
    return F.length(trim(F.coalesce(text, F.lit("")))) < 20


# fixed values: entities by name, in the order of decoding; the ampersand comes last
ENTITIES = (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"))


def decode_named(text: Column) -> Column:
    out = reduce(lambda t, e: F.regexp_replace(t, f"(?i)&{e[0]};", e[1]), ENTITIES, text)
    return F.regexp_replace(out, "(?i)&amp;", "&")


NUMBER = r"(?is)\A(?:x0*([0-9a-f]{1,6})|0*([0-9]{1,7}));(.*)\z"


def decode_numeric(text: Column) -> Column:
    """References by number, in decimal or hexadecimal; those of no character stay as they are.

    The text is cut at ``&#``; each piece that begins with a number and a semicolon gives its character.
    """

    def piece(p: Column) -> Column:
        hexadecimal, decimal = F.regexp_extract(p, NUMBER, 1), F.regexp_extract(p, NUMBER, 2)
        code = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).when(decimal != "", decimal).cast("long")
        fits = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        character = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code), 8, "0"))), "UTF-32")  # after a mark of the order of bytes
        known = (hexadecimal != "") | (decimal != "")
        return F.when(known & fits, F.concat(character, F.regexp_extract(p, NUMBER, 3))).otherwise(F.concat(F.lit("&#"), p))

    pieces = F.split(text, "&#")
    decoded = F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), piece), ""))
    return F.when(F.contains(text, F.lit("&#")), decoded).otherwise(text)


def decode_entities(text: Column) -> Column:
    """Named and numeric references, each once; the ampersand last."""
    out = reduce(lambda t, e: F.regexp_replace(t, f"(?i)&{e[0]};", e[1]), ENTITIES, text)
    return F.regexp_replace(decode_numeric(out), "(?i)&amp;", "&")


def resolve_href(href: Column, folder: Column) -> Column:
    """A path in a package: no fragment, percent-decoded where that gives valid text, normalised from ``folder``.

    A reference of a fragment alone, or an empty one, is empty.
    """
    bare = F.split(href, "#")[0]
    decoded = F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))
    valid = ~bare.rlike("%(?![0-9a-fA-F]{2})") & (F.contains(bare, F.lit("\ufffd")) | ~F.contains(decoded, F.lit("\ufffd")))
    path = F.when(valid, decoded).otherwise(bare)
    root = F.startswith(path, F.lit("/"))
    folder = F.coalesce(folder, F.lit(""))
    joined = F.when(root | (folder == ""), path).otherwise(F.concat(folder, F.lit("/"), path))
    root = F.startswith(joined, F.lit("/"))

    def step(done: Column, part: Column) -> Column:
        back = (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != "..")
        up = F.when(back, F.slice(done, F.lit(1), F.size(done) - 1)).when(root, done).otherwise(F.array_append(done, part))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.array_append(done, part))

    parts = F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), step)
    normal = F.concat(F.when(root, "/").otherwise(""), F.array_join(parts, "/"))
    return F.when(path == "", "").when(normal == "", ".").otherwise(normal)


BLOCK = "p|div|li|h[1-6]|blockquote|section|article"


def body_of(xhtml: Column) -> Column:
    """Inside of the body element if there is one, without scripts and styles."""
    inner = F.regexp_extract(xhtml, r"(?is)<body[^>]*>(.*)</body>", 1)
    body = F.when(xhtml.rlike(r"(?is)<body[^>]*>.*</body>"), inner).otherwise(xhtml)
    return F.regexp_replace(body, r"(?is)<(script|style)\b[^>]*>.*?</\1>", "")


def xhtml_text(xhtml: Column, decode=decode_named) -> Column:
    """Readable text: blocks apart by empty lines, cells by spaces, inline tags without a trace."""
    steps = (
        (r"(?i)<br\b[^>]*>", "\n"), (rf"(?i)</({BLOCK})\s*>", "\n\n"), (r"(?i)</(tr|table)\s*>", "\n"),
        (rf"(?i)<({BLOCK}|tr|table)\b[^>]*>", "\n"), (r"(?i)</?(td|th|img|hr)\b[^>]*>", " "), (r"<[^>]+>", ""),
    )
    out = decode(reduce(lambda t, s: F.regexp_replace(t, *s), steps, body_of(xhtml)))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?m)^[ \t\r\f]+|[ \t\r\f]+$", ""), r"\n{3,}", "\n\n")
    return trim(out)


def xhtml_title(xhtml: Column, decode=decode_named) -> Column:
    """First heading of the body, else the title element, else null."""
    clean = lambda t: F.nullif(collapse(decode(t)), F.lit(""))
    heading = F.regexp_replace(F.regexp_extract(body_of(xhtml), r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", 1), r"<[^>]+>", "")
    return F.coalesce(clean(heading), clean(F.regexp_extract(xhtml, r"(?is)<title[^>]*>([^<]*)</title>", 1)))


def strip_fences(text: Column) -> Column:
    """The inside of a fenced block, else the trimmed text."""
    inside = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return trim(F.when(inside != "", inside).otherwise(text))


def first_json(text: Column, shape: str = "object") -> Column:
    """From the first opening to the last closing brace (``array``: bracket); null without them."""
    pattern = {"object": r"(?s)(\{.*\})", "array": r"(?s)(\[.*\])"}[shape]
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def safe_name(title: Column, most: int = 100) -> Column:
    """A file name: no quotes, backslashes or control characters, ``_`` for path marks, ``most`` code points."""
    bare = F.regexp_replace(F.regexp_replace(title, r'["\\\x00-\x1f\x7f]', ""), r"[/:*?<>|]", "_")
    return F.coalesce(F.nullif(trim(F.substring(bare, 1, most)), F.lit("")), F.lit("download"))


def clamped(value: Column, most: int) -> Column:
    """Trimmed and cut at ``most`` code points, without white space at the cut."""
    return F.regexp_replace(F.substring(trim(value), 1, most), r"\s+\z", "")


# fixed values: what form encoding writes in another way than percent encoding of attributes
PERCENT = (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%21", "!"))


def content_disposition(title: Column, ext: str) -> Column:
    """A download header with an ASCII name and the whole name in percent-encoded UTF-8."""
    name = F.concat(safe_name(title), F.lit(f".{ext}"))
    ascii_name = F.regexp_replace(name, r"[^\x20-\x7e]", "_")
    encoded = reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), PERCENT, F.url_encode(name))
    return F.concat(F.lit('attachment; filename="'), ascii_name, F.lit("\"; filename*=UTF-8''"), encoded)


def clean_markers(markdown: Column) -> Column:
    """Markdown lines without footnote references; notes become paragraphs of their own."""

    def line(x: Column) -> Column:
        bare = F.regexp_replace(x, r"\[\^\d+\]", "")
        formula = F.when(bare.rlike(r"^\s+\$\{\s*\}\s*\^\{?\d+\}?\$"), F.concat(F.lit("\n"), bare)).otherwise(bare)
        return F.when(x.rlike(r"^\[\^\d+\]:\s*"), F.concat(F.lit("\n    "), F.regexp_replace(x, r"^\[\^\d+\]:\s*", ""))).when(trim(x).rlike(r"^\[\^\d+\]\z"), "").otherwise(formula)

    return trim(F.array_join(F.transform(F.split(markdown, "\n"), line), "\n"))
