"""Leaves of outlines against a plain walk, and trees by parents."""

import random

import pytest

from tessera.operators import structure


def walk(node):
    """(ord, chapter, chapter_title, title, page) from {path: (title, page)}, depth first."""
    kids, chapters = {}, []
    for p in sorted(node):
        kids.setdefault(p[:-1], []).append(p)

    def visit(p, above):
        title, page = node[p]
        below = kids.get(p, [])
        if not below:
            chapters.append((title, [(title, page)]))
            return
        name = f"{above} > {title}" if above else title
        flat = not any(c in kids for c in below)
        pages = [node[c][1] for c in (below[:1] if flat else below) if node[c][1] is not None]
        run = [(f"{title} — Introduction", page)] if page is not None and pages and page < min(pages) else []
        for c in below:
            if c in kids:
                chapters.append((name, run))
                run = []
                visit(c, name)
            else:
                run.append(node[c])
        chapters.append((name, run))

    for p in kids.get((), []):
        visit(p, "")
    kept = [(name, sections) for name, sections in chapters if sections]
    rows = [(k, name, *section) for k, (name, sections) in enumerate(kept, 1) for section in sections]
    return [(i, *r) for i, r in enumerate(rows, 1)]


def outlines():
    rng = random.Random(5)
    for doc in range(40):
        paths = {(rng.randint(0, 3),)}
        for _ in range(rng.randint(0, 25)):
            paths.add((*rng.choice(sorted(paths))[: rng.randint(0, 4)], rng.randint(0, 3)))
        if doc % 4:
            paths = {p for p in paths if all(p[:k] in paths for k in range(1, len(p)))} or {(0,)}
        yield doc, {p: (f"t{rng.randint(0, 5)}", rng.choice([None, *range(1, 30)])) for p in paths}


def test_leaves_against_a_walk(spark):
    docs = dict(outlines())
    df = spark.createDataFrame([(d, list(p), t, n) for d, node in docs.items() for p, (t, n) in node.items()], "doc int, path array<int>, title string, page int").repartition(5)
    out = structure.outline_leaves(df)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in out.collect():
        got.setdefault(r["doc"], []).append(tuple(r)[1:])
    for d, node in docs.items():
        assert sorted(got.get(d, [])) == walk(node), (d, node)


def test_paths_by_parents(spark):
    rows = [("a", 1, None, 0, "A", 1), ("a", 2, 1, 1, "A2", 2), ("a", 3, 1, 0, "A1", 3), ("a", 4, 2, 0, "A21", None), ("a", 9, 8, 0, "lost", 1), ("a", 5, 6, 0, "round", 1), ("a", 6, 5, 0, "round", 1), ("b", 1, None, 3, "B", 1)]
    df = spark.createDataFrame(rows, "doc string, id int, parent int, place int, title string, page int")
    got = sorted((r["doc"], r["path"], r["title"]) for r in structure.outline_paths(df).collect())
    assert got == [("a", [0], "A"), ("a", [0, 0], "A1"), ("a", [0, 1], "A2"), ("a", [0, 1, 0], "A21"), ("b", [3], "B")]
    assert [r["title"] for r in structure.outline_leaves(structure.outline_paths(df)).orderBy("doc", "ord").collect()] == ["A — Introduction", "A1", "A21", "B"]
    assert structure.outline_paths(df.limit(0)).count() == 0


def test_too_deep(spark):
    df = spark.range(12).selectExpr("'a' as doc", "id", "if(id > 0, id - 1, null) as parent", "0 as place", "'t' as title", "1 as page")
    assert structure.outline_paths(df).count() == 12
    with pytest.raises(Exception, match="(?i)recursion"):
        structure.outline_paths(df, 5).count()
