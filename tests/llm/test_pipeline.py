"""The pipeline's stages on a small corpus, each on what the one before kept, against brute force."""

import hashlib
from collections import Counter

import duckdb
from test_llm import brute_classes, brute_features, brute_leaks, brute_lines

import corpus_pipeline
from tessera.llm import mixing


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        seen.append(docs)
    rows = [[(r["doc_id"], r["text"]) for r in d.collect()] for d in seen]
    ids = [{i for i, _ in r} for r in rows]

    failed = {i for i, f in ((i, brute_features(t)) for i, t in rows[0]) if f[0] < 20 or 100 * f[4] > 30 * f[0]}
    assert ids[1] <= ids[0] - failed
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()} & (ids[0] - failed)
    assert len(good & ids[1]) > 0.97 * len(good)

    kept = {i: sha for i, _, _, sha in brute_lines(rows[1])}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows[2]} == kept
    assert all(r["n_chars"] == len(r["text"]) for r in seen[2].collect())

    assert ids[3] == set(brute_classes(rows[2]).values())

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert ids[4] == ids[3] - {i for i, _ in brute_leaks(rows[3], items)}

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/3/*.parquet'")
    times = Counter({r[0]: r[4] // r[1] for r in con.execute(mixing.ORACLE).fetchall() if r[4]})
    assert Counter(i for i, _ in rows[5]) == times


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "mix_sources"]


def test_stages_without_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert out.count() == 0
