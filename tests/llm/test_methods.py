"""The methods themselves against brute force: trees, Bayes, EM, pairs of terms, line blocks, suffixes."""

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import brute_host, brute_repeats, brute_rule, by_id, edited, text

from tessera.llm import _chunks, _filters, decontam, html, langid, lines, neardup, quality, repeats, toxicity, urls
from tessera.llm._text import blocks
from tessera.llm.queries import QUERIES

# --- 1 lines


def test_lines_with_ids_of_any_type(spark):
    rows = [("b", "one line of text\nmine"), ("a", "One line of text "), (None, "one line of text"), ("c", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup(df).collect()}
    assert got == {"a": "One line of text ", "b": "mine", None: "", "c": None}
    assert {r["doc_id"]: r["n_dropped"] for r in lines.digest(df).collect()} == {"a": 0, "b": 1, None: 1, "c": 0}


def test_a_slice_has_two_filters():
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 1 << 62, 6000, dtype=np.uint64))
    lists = [np.sort(rng.choice(pool, 1500, replace=False)) for _ in range(3)]
    many = [rng.random(1500) < 0.1 for _ in range(3)]
    n = Counter(x for s in lists for x in s.tolist())
    flagged = {x for s, f in zip(lists, many, strict=True) for x in s[f].tolist()}
    extra = 0
    for s, mark in zip(lists, _filters.seen_twice(lists, many), strict=True):
        for x, m in zip(s.tolist(), mark.tolist(), strict=True):
            assert m or (n[x] == 1 and x not in flagged)
            extra += m and n[x] == 1 and x not in flagged
    assert extra < 100


def test_asks_and_answers():
    """Bits come back to the names that asked, for cut and whole names."""
    rng = np.random.default_rng(5)
    for bits, width in ((0, 8), (4, 8), (4, 4)):
        pool = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
        held = [np.unique(_chunks.cut_names(rng.choice(pool, 120), bits) if width == 4 else rng.choice(pool, 120)) for _ in range(3)]
        n = Counter(x for h in held for x in h.tolist())
        by_slice = defaultdict(list)
        for c, h in enumerate(held):
            batch = _chunks.asks(c, h, np.zeros(len(h), bool), bits, width)
            for r in batch.to_pylist():
                by_slice[r["slice"]].append(r)
        parts = defaultdict(list)
        for s, rows in by_slice.items():
            names = [np.frombuffer(r["names"], np.uint64 if width == 8 else np.uint32) for r in rows]
            marks = _chunks.met_twice(names, [None] * len(names), [np.zeros(len(x), bool) for x in names])
            for r, m in zip(rows, marks, strict=True):
                parts[r["c"]].append({"slice": s, "bits": np.packbits(m).tobytes()})
        for c, h in enumerate(held):
            assert _chunks.lookup(h, parts[c], bits).tolist() == [n[x] > 1 for x in h.tolist()]


def test_ties_are_resolved_by_the_second_name():
    same = np.array([7, 7, 9], np.uint64)
    marks = _chunks.met_twice([same[:1], same[1:]], [np.array([1], np.uint32), np.array([2, 3], np.uint32)], [np.zeros(1, bool), np.zeros(2, bool)])
    assert [m.tolist() for m in marks] == [[False], [False, False]]
    three = [np.array([7], np.uint64)] * 3
    marks = _chunks.met_twice(three, [np.array([x], np.uint32) for x in (1, 2, 1)], [np.zeros(1, bool)] * 3)
    assert [m.tolist() for m in marks] == [[True], [False], [True]]


# --- 2 repeats


def test_suffix_dedup_of_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op2_suffix_dedup"](spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows, repeats.LENGTH)


def test_suffix_dedup_of_a_hot_passage(spark):
    """One passage in every third of many texts, and each text many times."""
    passage = text(70, 120)
    rows = [(i, text(1000 + i % 150, 40) + (passage if i % 3 == 0 else text(3000 + i % 150, 60))) for i in range(450)]
    got = repeats.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert sorted(map(tuple, got.collect()), key=str) == brute_repeats(rows, 400)


# --- 3 html

NAMES = re.compile(r"<(/?)(nav|footer|aside|header|article|main|section|form)\b[^>]*>", re.I)


def nameless(page):
    """The page without the names of its elements: all containers are plain."""
    return re.sub(r"<(div|p|h1|ul|li)\b[^>]*>", r"<\1>", NAMES.sub(r"<\1div>", page))


def test_html_without_names(spark):
    """Line blocks alone find the article where no element names itself."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    same = [html.article_of(nameless(p)) == html.article_of(p) for p in pages]
    assert np.mean(same) > 0.9


def test_html_thresholds_decide(monkeypatch):
    """Short lines beside a long text are no surge; with no thresholds they would be."""
    long = "a sentence of the text itself. " * 12
    page = f"<div>Short advert here</div><div><p>{long}</p><p>{long}</p></div><div>(c) somebody</div>"
    assert html.article_of(page) == f"{long.strip()}\n\n{long.strip()}"
    monkeypatch.setattr(html, "SURGE_SHARE", 0)
    monkeypatch.setattr(html, "SURGE_CHARS", 0)
    monkeypatch.setattr(html, "REGION_SHARE", 0)
    assert html.article_of(page) == f"Short advert here\n\n{long.strip()}\n\n{long.strip()}\n\n(c) somebody"


def test_html_short_blocks_between():
    """A short block of the same container stays between two long ones, and goes at the end."""
    long = "a sentence of the text itself. " * 12
    page = f"<div><div><p>{long}</p></div><div><h2>Heading</h2></div><div><p>{long}</p></div></div><div>tail</div>"
    assert html.article_of(page) == f"{long.strip()}\n\nHeading\n\n{long.strip()}"


def test_html_drops_nothing_of_an_article():
    """Formulas, drawings, objects and lines of links inside an article are its text."""
    page = "<nav><a>n</a></nav><article><p>x</p><math><mi>a</mi><mo>+</mo></math><svg><text>label</text></svg><object>fallback</object><p><a>only a link</a></p><select><option>o</option></select></article>"
    assert html.article_of(page) == "x\n\na+labelfallback\n\nonly a link"
    assert html.article_of("<div><p>" + "text of a page. " * 20 + "</p><p><a>only a link</a></p><p>" + "more of a page. " * 20 + "</p></div>").split("\n\n")[1] == "only a link"


def test_html_frame_with_long_pages(spark):
    rows = [(k, "u", "<p>" + "word " * n + "</p>") for k, n in enumerate((1, 200_000, 0))]
    got = by_id(html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert [got[k]["n_chars"] for k in range(3)] == [4, 999_999, 0]


# --- 4 near duplicates


def test_keep_one_with_any_column_name(spark):
    rows = [(1, text(1), 1, 1), (2, text(1), 2, 2), (None, text(1), 3, 3)]
    out = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lost long, __lost long"))
    assert out.columns == ["doc_id", "text", "lost", "__lost"]
    assert {r["doc_id"] for r in out.collect()} == {1, None}


def test_pairs_around_hubs(spark, monkeypatch):
    """Many pairs of one text, in several parts, and texts that are hubs and members."""
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 7)
    base = text(5, 200)
    rows = [(0, base)] + [(i, edited(base, i % 9, i)) for i in range(1, 40)] + [(50, text(6, 50)), (51, "")]
    texts = spark.createDataFrame(rows, "id long, text string")
    pairs = [(i, 0) for i in range(1, 40)] + [(i, i + 1) for i in range(1, 30)] + [(50, 0), (51, 50)]
    got = {tuple(r) for r in neardup._verified(spark.createDataFrame(pairs, "a long, b long"), texts, 0.8).collect()}
    grams = {i: Counter(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in rows}
    like = lambda a, b: sum((grams[a] & grams[b]).values()) >= 0.8 * sum((grams[a] | grams[b]).values()) > 0
    assert got == {p for p in pairs if like(*p)}


# --- 5 decontamination


def test_windows_are_found_by_their_fingerprints(monkeypatch):
    """Every window that shares a shingle is fingerprinted; what the index rejects is not verified."""
    item = text(80, 40)
    bench = decontam.Benchmark([1], [item])
    w = item.split()
    near = " ".join([*text(81, 30).split(), w[0], "other", *w[2:], *text(82, 30).split()])
    far = " ".join([*text(83, 30).split(), *w[:8], *text(84, 60).split()])
    verified, windows = [], []
    exact, prints = bench.similarities, decontam.fingerprints
    monkeypatch.setattr(bench, "similarities", lambda h, at, width, k: verified.append(len(at)) or exact(h, at, width, k))
    monkeypatch.setattr(decontam, "fingerprints", lambda h, size: windows.append(len(h) - size + 1) or prints(h, size))
    assert [m[0] for m in bench.matches(pa.array([near, far]))] == [0]
    assert 0 < 2 * sum(verified) < sum(windows)


def test_similarities_of_windows():
    """The running sum and the count window by window are the exact weighted similarity."""
    rng = np.random.default_rng(12)
    for distinct in (True, False):
        items = [" ".join(f"w{x}" for x in (rng.permutation(60)[:30] if distinct else rng.integers(0, 3, 30))) for _ in range(3)]
        bench = decontam.Benchmark([0, 1, 2], items)
        for item in range(3):
            own = bench.shingles[item]
            h = np.concatenate([rng.integers(1, 1 << 60, 40, dtype=np.uint64), own, rng.integers(1, 1 << 60, 40, dtype=np.uint64)])
            at = np.arange(20, 60, 3)
            want = [decontam.weighted_jaccard(h[x : x + len(own)], own) for x in at.tolist()]
            assert bench.similarities(h, at, len(own), item).tolist() == pytest.approx(want)


# --- 6 urls

SHAPE = re.compile(r"[0-9a-f]{8}-[0-9a-f-]{27}|[0-9a-f]{32,}|[0-9]+")


def brute_tree(paths):
    """path -> template, for one scope: {path: (labelled, bad)}."""
    out = {}

    def grow(template, rows):
        ended = [r for r in rows if not r[1]]
        rows = [r for r in rows if r[1]]
        out.update({p: template for p, _ in ended})
        if len(rows) < urls.LEAST_VALUES:
            out.update({p: template + "/" + "/".join(rest) for p, rest in rows})
            return
        values, labels = defaultdict(set), Counter()
        for p, rest in rows:
            values[SHAPE.sub("#", rest[0])].add(rest[0])
            labels[SHAPE.sub("#", rest[0])] += paths[p][0]
        wild = {s for s, v in values.items() if "#" in s and len(v) >= urls.LEAST_VALUES}
        crowded = sum(len(v) for s, v in values.items() if s not in wild) > urls.MAX_CHILDREN
        below = defaultdict(list)
        for p, rest in rows:
            s = SHAPE.sub("#", rest[0])
            token = s.replace("#", "*") if s in wild else "*" if crowded and not labels[s] else rest[0]
            below[token].append((p, rest[1:]))
        for token, some in below.items():
            grow(f"{template}/{token}", some)

    grow("", [(p, (p[1:] if p.startswith("/") else p).split("/") if p else []) for p in paths])
    return out


def brute_merged(paths, tree):
    one = defaultdict(lambda: [0, 0])
    for p, (n, bad) in paths.items():
        one[tree[p]][0] += n
        one[tree[p]][1] += bad
    one = {t: x for t, x in one.items() if x[0]}
    kin = defaultdict(list)
    for t in one:
        kin[t.rsplit("/", 1)[0] if "/" in t else t].append(t)
    out = dict(one)
    for some in kin.values():
        some = [t for t in some if one[t][0] >= urls.LEAST_LABELS]
        alln, allb = sum(one[t][0] for t in some), sum(one[t][1] for t in some)
        near = []
        for t in some:
            n, b = one[t]
            if alln > n:
                share = allb / alln
                if abs(b / n - (allb - b) / (alln - n)) <= 1.96 * math.sqrt(share * (1 - share) * (1 / n + 1 / (alln - n))):
                    near.append(t)
        for t in near:
            out[t] = [sum(one[x][0] for x in near), sum(one[x][1] for x in near)]
    return out


def brute_purity(rows):
    """(host, path) -> (template, purity) from (host, path, bad)."""
    scope = lambda h: ("=" + h, "+" + ".".join(h.split(".")[-2:]), "*")
    trees = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for h, p, bad in rows:
        for s in scope(h):
            trees[s][p][0] += bad is not None
            trees[s][p][1] += bad or 0
    tree = {s: brute_tree(paths) for s, paths in trees.items()}
    counts = {s: brute_merged(paths, tree[s]) for s, paths in trees.items()}
    out = {}
    for h, p, _ in rows:
        purity = 0.5
        for s in reversed(scope(h)):
            n, bad = counts[s].get(tree[s][p], (0, 0))
            purity = (bad + urls.STRENGTH * purity) / (n + urls.STRENGTH)
        out[h, p] = (tree["=" + h][p], purity)
    return out


def check_tree(pages, got):
    rows = []
    for u in pages:
        host, path = brute_host(u)
        verdict = brute_rule(host, path)[1]
        rows.append((host, path, None if verdict is None else int(verdict == "block")))
    want = brute_purity(rows)
    for (host, path, bad), r in zip(rows, got, strict=True):
        template, purity = want[host, path]
        assert (r["template"], r["purity"]) == (template, pytest.approx(purity))
        assert r["verdict"] == ("block" if (purity >= urls.REJECT if bad is None else bad) else "allow")


def test_url_tree_against_brute_force(spark):
    rng = random.Random(11)
    hosts = ["example.com", "a.example.com", "x.org", "b.x.org", "shop.net", "example.net", "h.io"]
    slug = lambda: "".join(rng.choice("pqrs") for _ in range(4))
    part = lambda: rng.choice([str(rng.randrange(500)), f"id-{rng.randrange(90)}", slug(), rng.choice(["de", "en", "fr", "shop"]), ""])
    pages = [f"http://{rng.choice(hosts)}/" + "/".join([rng.choice(["de", "en", "fr", slug()]), *(part() for _ in range(rng.randrange(4)))]) for _ in range(1500)]
    pages += ["http://h.io" + "/a" * 40, "http://h.io" + "/a" * 40 + "/b", "http://h.io" + "/a" * 39, None, "no scheme", "http://h.io"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    got = by_id(urls.judge(df), "page_id")
    check_tree(pages, [got[k] for k in range(len(pages))])


def test_url_tree_of_pages(spark, sf):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    got = by_id(QUERIES["op6_url_filters"](spark, sf), "page_id")
    check_tree([pages[k] for k in sorted(pages)], [got[k] for k in sorted(pages)])


def test_url_verdicts_that_were_hidden(spark):
    """A fifth of the rules' verdicts are hidden and found again by the trees."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    ruled = urls.judge(pages).filter("rule is not null").select("page_id", "verdict").join(pages, "page_id").withColumn("hidden", F.crc32(F.col("page_id").cast("string")) % 5 == 0)
    labels = ruled.filter("not hidden").select("url", (F.col("verdict") == "block").cast("int").alias("bad"))
    out = urls.judge(pages, rules=(), labels=labels).select("page_id", F.col("verdict").alias("found")).join(ruled.filter("hidden"), "page_id").collect()
    assert len({r["found"] for r in out}) == 2
    assert np.mean([r["found"] == r["verdict"] for r in out]) > 0.9


# --- 7 language


def brute_grams(t):
    letters = [(lambda low: ord(low) if len(low) == 1 else ord(c))(c.lower()) if c.isalpha() else 0 for c in t]
    mask, out = (1 << 64) - 1, []
    for n in langid.SIZES:
        for k in range(len(letters) - n + 1):
            if any(letters[k : k + n]):
                h = n
                for c in letters[k : k + n]:
                    h = ((h ^ c) * 0x9E3779B97F4A7C15) & mask
                    h ^= h >> 29
                out.append(((h * 0xBF58476D1CE4E5B9) & mask) >> (64 - langid.BITS))
    return out


def test_naive_bayes_against_brute_force(spark):
    rng = random.Random(6)
    alphabet = {"a": "abcde", "b": "defgh", "c": "ßéü aİ"}
    rows = [(k, x, "".join(rng.choice(alphabet[x] + " 1") for _ in range(rng.randint(1, 60)))) for k, x in enumerate(rng.choices("aaabbc", k=90))] + [(200, "a", None), (201, None, "abc"), (202, "b", "")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = by_id(langid.predict(df, df.select("lang", "text")))
    counts, docs = defaultdict(Counter), Counter()
    for _, x, t in rows:
        if x is not None and t is not None:
            docs[x] += 1
            counts[x].update(brute_grams(t))
    total = {x: sum(counts[x].values()) + langid.SMOOTHING * langid.BUCKETS for x in docs}
    for k, _, t in rows:
        if t is None or not any(c.isalpha() for c in t):
            assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0)
            continue
        s = {x: math.log(docs[x] + 1) + sum(math.log((counts[x][g] + langid.SMOOTHING) / total[x]) for g in brute_grams(t)) for x in docs}
        best = max(s, key=s.get)
        assert got[k]["lang_pred"] == best
        assert got[k]["score"] == pytest.approx(1 / sum(math.exp(v - s[best]) for v in s.values()), abs=1e-3)


def test_counts_of_many_languages(spark, monkeypatch):
    df = spark.createDataFrame([(f"l{k % 5}", text(k, 9)) for k in range(40)], "lang string, text string").coalesce(1)
    dense = {tuple(r) for r in langid._counts(df).collect()}
    table = pa.table({"lang": [f"l{k % 5}" for k in range(40)]})
    assert table.num_rows == 40
    monkeypatch.setattr(langid, "FEW_LANGS", 1)
    assert {tuple(r) for r in langid._counts(df).collect()} == dense


# --- 9 quality


def brute_em(patterns, n_rules, prior=0.85, accuracy=0.9, strength=0.05, rounds=200):
    """Dawid and Skene's estimate, document by document, with the same start and the same rules of order."""
    wrong, breaks = (1 - accuracy) / n_rules, 1 / n_rules
    start = np.array([[0.1, 0.9 - wrong, wrong], [0.1, 0.9 - breaks, breaks]])
    rate = np.repeat(start[:, None, :], n_rules, axis=1)
    share = np.array([prior, 1 - prior])
    pseudo = np.array([prior, 1 - prior]) * strength * len(patterns) + 1
    votes = np.array(patterns)
    for _ in range(rounds):
        like = np.stack([share[y] * np.prod(rate[y][np.arange(n_rules), votes], axis=1) for y in (0, 1)])
        post = like / like.sum(axis=0)
        seen = np.stack([[np.bincount(votes[:, k], weights=post[y], minlength=3) for k in range(n_rules)] for y in (0, 1)])
        seen = seen + pseudo[:, None, None] * start[:, None, :]
        rate = seen / seen.sum(axis=2, keepdims=True)
        for k in range(n_rules):
            for v, better in ((1, 0), (2, 1)):
                if rate[better, k, v] < rate[1 - better, k, v]:
                    rate[:, k, v] = rate[:, k, v].mean()
        share = (post.sum(axis=1) + pseudo) / (len(patterns) + pseudo.sum())
    like = np.stack([share[y] * np.prod(rate[y][np.arange(n_rules), votes], axis=1) for y in (0, 1)])
    return (like / like.sum(axis=0))[0]


def test_quality_model_against_brute_force(spark, sf):
    """The posterior and the verdict of every document, from a model fitted document by document."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = quality.features(docs, keep=("doc_id",)).select("doc_id", quality.votes().alias("v")).collect()
    n = len(quality.RULES)
    want = dict(zip([r["doc_id"] for r in rows], brute_em([quality.digits(r["v"], n) for r in rows], n).tolist(), strict=True))
    for r in QUERIES["op9_quality_rules"](spark, sf).collect():
        assert r["p_good"] == pytest.approx(want[r["doc_id"]], abs=1e-5)
        assert r["kept"] == (not r["base_failed"] and want[r["doc_id"]] >= 0.5)


def test_variety_has_no_size_switch():
    rule = next(r for r in quality.RULES if r.name == "variety")
    assert not re.search(r"n_words (>=|<|>|<=) \d", rule.good + rule.bad)


# --- 10 toxicity


def test_pair_of_neutral_terms(spark):
    """Label 1 where exactly one of two words is there: neither word tells anything alone."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [*(f"filler{rng.randrange(40)}x" for _ in range(12)), *(["quarrel"] if a else []), *(["harbour"] if b else [])]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(a != b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, table).filter("held_out").join(table, "doc_id").collect()
    assert len(got) > 500
    assert np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in got]) > 0.95


def test_partner_of_a_strong_term():
    """A group word that counts only beside an insult is admitted; a free one is not."""
    rng = np.random.default_rng(7)
    n = 20_000
    insult, group, free = rng.random(n) < 0.04, rng.random(n) < 0.1, rng.random(n) < 0.3
    y = (insult & (group | (rng.random(n) < 0.2))).astype(float)
    lists = [np.flatnonzero(x) for x in np.stack([insult, group, free], axis=1)]
    indptr = np.append(0, np.cumsum([len(x) for x in lists]))
    assert toxicity.partners(indptr, np.concatenate(lists), y, 1, 3).tolist() == [1]


def test_gain_is_the_likelihood_ratio():
    n = np.array([[50, 20], [20, 40]])
    t = np.array([[25, 18], [18, 20]])
    cells = [(18, 20), (2, 20), (7, 30), (23, 30)]
    rows, hits = 50, 25
    want = 2 * sum(o * math.log(o * rows / (of * side)) for (o, of), side in zip(cells, (hits, rows - hits, hits, rows - hits), strict=True))
    assert toxicity._gain(n, t)[0, 1] == pytest.approx(want)


def test_letters_are_those_of_unicode():
    column = pa.array(["Ünï ß1 İ"])
    block = next(iter(blocks(column)))
    from tessera.llm._text import letters

    code = letters(block).code.tolist()
    assert [chr(c) if c else " " for c in code[:6]] == list(unicodedata.normalize("NFC", "ünï ß "))
