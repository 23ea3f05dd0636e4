"""Sentences of odd texts against the SQL."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

from tessera.functions.text import ABBREVIATIONS
from tessera.plans.registry import ORACLES, QUERIES

ODD = [
    None, "", " \n\t ", "\v", "\x01", "\x02", " \x01 A. B", "A.\x01 B", "Mr.\x01 B", "One. Two\x02three. \x02Four", "A.\vB", "A. \v B", "\vA. B.\v",
    "x Ave.g. Then", "x i.e.g. Then", "Ave.g! “So”", "i.e. Then e.g. That", "Ave. A", "vse.g. A", "Wait... What?! Yes", "He said. \"No.\" “So.” X",
    "a\x00. B", "A. B. C", "a. É. b", "A." + " " * 100_000 + "B", "Ab. " * 100_000,
]


def test_sentences_of_odd_texts(spark, same_rows, tmp_path):
    rng = random.Random(1)
    parts = [*ABBREVIATIONS, *".!?", ".", ".", *"  \n\t\r\f\v\x00\x01\x02\x1c\x85 ", *"ABXaigeé", "Av", "i.", *'“”"|', "😀", "$1"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    same_rows(QUERIES["sentences"](spark, str(tmp_path)), ORACLES["sentences"], tmp_path)
