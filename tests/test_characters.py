"""References of characters and paths of packages, as columns, against plain ones."""

import random
import re

from pyspark.sql import functions as F

from tessera.functions import python_text as py
from tessera.functions import text as tx


def decoded(text):
    def one(m):
        n = int(m[1], 16) if m[1] else int(m[2])
        return chr(n) if n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else m[0]

    for name, c in tx.ENTITIES:
        text = re.sub(f"&{name};", c, text, flags=re.I)
    return re.sub("&amp;", "&", re.sub(r"&#(?:x([0-9a-f]+)|([0-9]+));", one, text, flags=re.I), flags=re.I)


def test_references(spark):
    rng = random.Random(1)
    parts = ["&#65;", "&#x41;", "&#X1F600;", "&#38;", "#65;", "&#", "&#;", "&#x;", "&#xD800;", "&#1114112;", "&#1114111;", "&#99999999999999999999999;", "&#000000000000000000000065;", "&#xFEFF;", "&#0;", "&#x0;", "&amp;", "&AMP;lt;", "&lt;", "&nbsp;", "a", "\n", "é", "$1", "\\"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(500)] + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.decode_entities(F.col("t"))).collect()
    assert {i: t for i, t in rows} == {i: t if t is None else decoded(t) for i, t in enumerate(texts)}


def test_paths(spark):
    rng = random.Random(2)
    parts = ["a", "b c", "%20", "%C3%A9", "%zz", "%ff", "%", "+", "..", ".", "", "é", "#x"]
    hrefs = ["/".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(600)] + ["#only", "", "../../../x"]
    rows = [(k, h, rng.choice(["", "OEBPS", "a/b", "..", "/r/s"])) for k, h in enumerate(hrefs)]
    got = spark.createDataFrame(rows, "k int, h string, d string").select("k", tx.resolve_href(F.col("h"), F.col("d"))).collect()
    bad = [(r, g, py.resolve(r[1], r[2])) for r, (_, g) in zip(rows, sorted(got), strict=True) if g != py.resolve(r[1], r[2]).replace("//", "/", 1 if py.resolve(r[1], r[2]).startswith("//") else 0)]
    assert not bad, bad[:5]
    assert spark.createDataFrame([(None,)], "h string").select(tx.resolve_href(F.col("h"), F.lit("x"))).first()[0] is None
