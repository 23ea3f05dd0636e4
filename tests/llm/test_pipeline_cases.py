"""The pipeline's stages on awkward tables: nulls, ties, repeated rows, and columns with names used inside."""

import pytest
from test_llm import text

import corpus_pipeline

SCHEMA = "doc_id long, text string, source string, n_chars long, c int, rows string, lost string, digest binary, id string, f0 double, __text string, row array<int>"
GOOD = [text(k, 120) for k in range(8)]
SHARED = "a line that two of them have in common and that is long"


def row(i, t, source="s"):
    return (i, t, source, 7, 1, "r", "l", b"d", "x", 0.5, "u", [1, 2])


ROWS = [
    row(1, GOOD[0]), row(2, GOOD[0]), row(3, GOOD[1], None), row(3, GOOD[1], None), row(3, GOOD[2]), row(None, GOOD[3]), row(None, GOOD[4]), row(4, None), row(5, ""), row(6, " \n\t"),
    row(7, GOOD[5] + "\n" + SHARED), row(8, SHARED.upper() + "\n" + GOOD[6]), row(9, GOOD[7] + " " + text(99, 5000)), row(10, "few words"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, None), (2, ""), (None, GOOD[5][:300])], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_keeps_columns(spark, folder, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    assert out.schema.simpleString() == docs.schema.simpleString()
    rows = out.collect()
    others = {tuple(r[c] for c in ("c", "rows", "lost", "digest", "id", "f0", "__text", "row")) for r in map(lambda r: {**r.asDict(), "digest": bytes(r["digest"]), "row": tuple(r["row"])}, rows)}
    assert others == {(1, "r", "l", b"d", "x", 0.5, "u", (1, 2))}
    ids = [r["doc_id"] for r in rows]
    if name == "quality_rules":
        assert sorted(ids, key=str) == sorted([1, 2, 3, 3, 3, 7, 8, 9, None, None], key=str)
    if name == "line_dedup":
        assert sorted(ids, key=str) == sorted((r[0] for r in ROWS), key=str)
        texts = {r["doc_id"]: r for r in rows}
        assert (texts[1]["text"], texts[2]["text"], texts[4]["text"], texts[8]["text"]) == (GOOD[0], "", None, GOOD[6])
        assert (texts[2]["n_chars"], texts[4]["n_chars"], texts[8]["n_chars"]) == (0, None, len(GOOD[6]))
    if name == "near_dedup":
        assert sorted(ids, key=str) == sorted([1, 3, 3, 3, 4, 5, 6, 7, 8, 9, 10, None, None], key=str)
    if name == "decontamination":
        assert sorted(ids, key=str) == sorted((r[0] for r in ROWS if r[0] != 7), key=str)
    if name == "mix_sources":
        assert not {4, 5, 6} & set(ids)


def test_stages_one_after_another(spark, folder, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
