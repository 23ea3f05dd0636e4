"""Queries that take all rows of their tables, against brute force at the smallest scale."""

from collections import defaultdict

from pyspark.sql import functions as F

from tessera.operators import structure, sync
from tessera.plans.registry import QUERIES
from tessera.sources.tables import read, sections


def test_page_cover_all(spark, sf):
    pages = {r.p_partkey: "" if r.p_partkey % 7 == 0 else r.p_name for r in read(spark, sf, "part").collect() if r.p_partkey % 101}
    spans, want = defaultdict(list), {}
    for r in sections(spark, sf).collect():
        spans[r.book_id, r.no] += range(r.start_page, r.end_page + 1)
    for key, span in spans.items():
        found = [pages.get(k) for k in sorted(span)]
        gone = found.count(None)
        want[key] = len(found), gone, "-" if gone else "\n\n".join(x for x in found if x)
    assert {(r.book_id, r.no): (r.n_pages, r.n_missing, r.text) for r in QUERIES["page_cover_all"](spark, sf).collect()} == want


def test_log_tail_all(spark, sf):
    rows = read(spark, sf, "conversations").select("conv_id", "turn", "role").collect()
    want = sorted((r.turn, r.conv_id, r.role) for r in rows if r.turn >= 2)
    assert [(r.turn, r.conv_id, r.role) for r in QUERIES["log_tail_all"](spark, sf).collect()] == want


def test_all_rows_are_given(spark, sf, monkeypatch):
    """What the operators get from the queries."""
    got = {}

    def kept(name, f):
        return lambda *a, **b: got.setdefault(name, a) and f(*a, **b)

    for module, name in ((sync, "insert_missing"), (structure, "page_offset"), (structure, "outline_leaves")):
        monkeypatch.setattr(module, name, kept(name, getattr(module, name)))
    out = {k: QUERIES[k](spark, sf) for k in ("insert_do_nothing", "page_offset", "outline_leaves")}
    n = {t: read(spark, sf, t).count() for t in ("customer", "supplier", "part")}
    assert got["insert_missing"][1].count() == n["customer"] + n["supplier"] == out["insert_do_nothing"].count()
    assert [x.count() for x in got["page_offset"]] == [n["part"]] * 2
    assert tuple(out["page_offset"].first()) == (14, "titles")
    texts = read(spark, sf, "conversations").select(F.col("conv_id").cast("string"), "text")
    assert sorted(map(tuple, got["outline_leaves"][0].select("doc", "title").collect())) == sorted(map(tuple, texts.collect()))
    assert out["outline_leaves"].count() > 0
