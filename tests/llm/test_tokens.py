"""Token files: encoding by pieces, streams, and the round trip through files."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import tokens
from tessera.llm._spark import shared_folder
from tessera.llm.queries import QUERIES

FILE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "a", "B", "é", "ß", "×", "÷", "ñ", "1", "7", "²", "٣", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "　", "\u0085", "\x1c", "\x7f", "\x00", ".", ",", "'", "'s",
    "'re", "'LL", "’", "-", "(", "_", "中", "я", "😀", "́", "the", " word", "ing", "<|endoftext|>", "<|", "endoftext", "|>",
]


def joined(texts):
    raw = [x.encode() for x in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw]))


def test_pieces_give_what_whole_texts_give():
    encoder, rng = tokens.Encoder(FILE), random.Random(5)
    assert encoder.pieces
    for _ in range(3000):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 5))]
        ids, n = encoder.encode(*joined(texts))
        whole = encoder.whole([x.encode() for x in texts])
        assert n.tolist() == [len(x) for x in whole] and ids.tolist() == [i for x in whole for i in x], texts


def test_pieces_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "PIECES", 3)
    encoder = tokens.Encoder(FILE)
    for text in ("one two three four", "two three, five! six", "one one seven"):
        assert encoder.encode(*joined([text]))[0].tolist() == encoder.whole([text.encode()])[0]


def test_other_tokenizers_encode_whole_texts():
    encoder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not encoder.pieces
    texts = ["Hello  World", "", "lower case"]
    ids, n = encoder.encode(*joined(texts))
    assert n.tolist() == [len(x) for x in encoder.whole([t.encode() for t in texts])] and ids.tolist() == [i for x in encoder.whole([t.encode() for t in texts]) for i in x]


def test_streams():
    rng = np.random.default_rng(1)
    for _ in range(50):
        counts = rng.integers(0, 30, rng.integers(0, 20))
        ranks = (rng.integers(0, 1 << 32, counts.sum(), dtype=np.uint64) >> (8 * rng.integers(0, 4, counts.sum())).astype(np.uint64)).astype(np.uint32)
        out, sizes = tokens.pack(ranks, counts)
        assert len(out) == sizes.sum()
        assert tokens.unpack(out, sizes, counts).tolist() == ranks.tolist()
    out, sizes = tokens.pack(np.array([5, 256, 70_000, 1 << 24, 1]), np.array([5]))
    assert out.tolist() == [0b11_10_01_00, 0, 5, 0, 1, 0x70, 0x11, 1, 0, 0, 0, 1, 1] and sizes.tolist() == [13]


def plain(rows, end=2):
    """(id, start, n, ids) in order of id, by the library as it is."""
    out, at = [], 0
    for (i, _), ids in zip(rows, tokens.Encoder(FILE).whole([(t or "").encode() for _, t in rows]), strict=True):
        ids = ids + ([] if end is None else [end])
        out.append((i, at, len(ids), ids))
        at += len(ids)
    return out


def found(df):
    rows = [(r["doc_id"], r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in df.collect()]
    return sorted(rows, key=lambda r: r[1:3])


AWKWARD = [(None, "null id"), (None, "null id"), (1, None), (2, ""), (3, " \t\n "), (4, "x"), (5, "ünïcode — ß 中文"), (6, "a <|endoftext|> b"), (7, "same"), (7, "same"), (8, "word " * 20_000), (9, "q" * 50_000), (10, "\x00\n\n\r\n")]


@pytest.mark.parametrize(("block_bytes", "blocks"), [(1, 1), (64, 3), (1 << 22, 8)])
def test_round_trip(spark, tmp_path, block_bytes, blocks):
    """Blocks of every size; lost columns, line feeds in the bytes, ties and nulls."""
    docs = spark.createDataFrame([(i, t, 1, "n", 2) for i, t in AWKWARD], "doc_id long, text string, n long, name string, part long").repartition(3)
    path = f"{tmp_path}/out"
    tokens.write(docs, path, FILE, block_bytes=block_bytes, blocks=blocks)
    assert found(tokens.read(spark, path)) == plain(AWKWARD)
    n = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    assert [r["rank"] for r in n] == list(range(len(n))) and [(-r["n"], r["token"]) for r in n] == sorted((-r["n"], r["token"]) for r in n)


def test_string_ids_no_end_and_empty(spark, tmp_path):
    rows = [(f"d{k:03}", f"text {k} " * k) for k in range(60)] + [("d1,\nx", "y")]
    docs = spark.createDataFrame(rows, "name string, body string").repartition(4)
    tokens.write(docs, f"{tmp_path}/a", FILE, None, "name", "body", block_bytes=100)
    assert found(tokens.read(spark, f"{tmp_path}/a", "string")) == plain(sorted(rows), None)
    tokens.write(docs.limit(0), f"{tmp_path}/b", FILE, 2, "name", "body")
    assert tokens.read(spark, f"{tmp_path}/b", "string").count() == 0


def test_an_end_beyond_two_bytes(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    tokens.write(docs, f"{tmp_path}/c", FILE, 1 << 20)
    assert found(tokens.read(spark, f"{tmp_path}/c")) == plain([(1, "a b"), (2, None)], 1 << 20)


def test_broken_file():
    with pytest.raises(ValueError, match="no block"):
        list(tokens.headers(b"x" * 80))


def test_query_against_whole_texts(spark, sf):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op13_token_ids"](spark, sf).collect()}
    assert got == {i: (i, at, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for i, at, n, ids in plain(rows)}
    assert shared_folder(spark)
