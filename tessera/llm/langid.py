"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts become lower-case letters with everything else as one mark between words;
n-grams of these are hashed to ``BUCKETS`` columns. Training counts them by
language over all training documents (summed before the shuffle). The matrix of
log probabilities has ``BUCKETS`` rows and a column a language, so its broadcast
does not grow with the data. A batch is scored with numpy: the matrix rows of a
text's n-grams are added up.

Cases: a null text and one without a letter get ``und`` and score 0; rows with a
null language, or a null text, teach nothing; a null id counts as held out; with
nothing to learn from, all get ``und``; an empty table gives an empty result.
More than ``MAX_LANGS`` languages raise an error rather than an oversized matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut, small_batches
from ._text import Block, blocks, letters

BITS = 15
BUCKETS = 1 << BITS
SIZES = (2, 3)
MAX_LANGS = 1000
#: up to here a batch counts in one array of all its languages' buckets, beyond by sorting
FEW_LANGS = 16
SMOOTHING = 0.5
BLOCK = 1 << 20


def grams(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and documents of all n-grams, and which documents have a letter."""
    text = letters(block)
    code = text.code.astype(np.uint64)
    n_docs = len(block.bounds) - 1
    owner = np.repeat(np.arange(n_docs), np.diff(text.bounds))
    has = np.zeros(n_docs, bool)
    has[owner[code > 0]] = True
    found, of = [], []
    for n in SIZES:
        m = len(code) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        some = np.zeros(m, bool)
        for j in range(n):
            h = (h ^ code[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            some |= code[j : j + m] > 0
        ok = np.flatnonzero(some & (owner[:m] == owner[n - 1 : n - 1 + m]))
        found.append((h[ok] * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64))
        of.append(owner[ok])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), has
    return np.concatenate(found), np.concatenate(of), has


def _counts(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) from (lang, text); bucket -1 counts documents."""

    def run(batches):
        for batch in batches:
            langs, code = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
            keys, counts = [], []
            for block in blocks(batch.column(1), BLOCK):
                h, doc, _ = grams(block)
                key = code[block.lo : block.hi][doc] * BUCKETS + h
                n = np.bincount(key) if len(langs) <= FEW_LANGS else None
                at, n = (np.flatnonzero(n), n[n > 0]) if n is not None else np.unique(key, return_counts=True)
                keys.append(at)
                counts.append(n)
            at, place = np.unique(np.concatenate([np.empty(0, np.int64), *keys]), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate([np.empty(0, np.int64), *counts]), minlength=len(at)).astype(np.int64)
            docs = np.bincount(code, minlength=len(langs))
            which, bucket = np.append(at // BUCKETS, np.arange(len(langs))), np.append(at % BUCKETS, np.full(len(langs), -1))
            yield pa.record_batch([pa.array(langs[which].tolist(), pa.string()), pa.array(bucket, pa.int32()), pa.array(np.append(n, docs), pa.int64())], ["lang", "bucket", "n"])

    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and the (bucket, language) log probabilities, from (lang, text)."""
    counts = _counts(rows.select("lang", "text").filter("lang is not null and text is not null"))
    counts = cut(counts)
    docs = {r["lang"]: r["n"] for r in counts.filter("bucket < 0").limit(MAX_LANGS + 1).collect()}
    if len(docs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(docs)
    at = {x: k for k, x in enumerate(langs)}
    total = np.full((BUCKETS, len(langs)), SMOOTHING)
    for r in counts.filter("bucket >= 0").toLocalIterator():
        total[r["bucket"], at[r["lang"]]] += r["n"]
    prior = np.log([docs[x] + 1.0 for x in langs])
    return langs, prior, (np.log(total) - np.log(total.sum(axis=0))).astype(np.float32)


def held_out(id_col: str, parts: int, rest: int) -> Column:
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % parts == rest


def score_block(block: Block, prior: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its posterior, and whether there is a letter, for each text."""
    h, doc, has = grams(block)
    n = len(block.bounds) - 1
    total = np.stack([np.bincount(doc, weights=logp[:, k][h], minlength=n) for k in range(logp.shape[1])], axis=1) + prior
    best = total.argmax(axis=1)
    rel = np.exp(total - total.max(axis=1, keepdims=True))
    return best, 1 / rel.sum(axis=1), has


def predict(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, lang_pred, score; ``train`` has lang and text."""
    small_batches(docs)
    langs, prior, logp = fit(train)
    model = docs.sparkSession.sparkContext.broadcast((langs, prior, np.asfortranarray(logp)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        langs, prior, logp = model.value
        for batch in batches:
            names, scores = [], []
            for block in blocks(batch.column(1), BLOCK):
                if not langs:
                    names += ["und"] * (block.hi - block.lo)
                    scores.append(np.zeros(block.hi - block.lo))
                    continue
                best, score, has = score_block(block, prior, logp)
                names += [langs[b] if ok else "und" for b, ok in zip(best.tolist(), has.tolist(), strict=True)]
                scores.append(np.where(has, score, 0.0))
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(np.concatenate([np.empty(0), *scores]))], ["id", "lang_pred", "score"])

    out = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def predict_held_out(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", parts: int = 5) -> DataFrame:
    """id, held_out, lang_pred, score; learns from the rows that are not held out."""
    train = docs.filter(~held_out(id_col, parts, 0)).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    out = predict(docs, train, id_col, text)
    return out.select(id_col, held_out(id_col, parts, 0).alias("held_out"), "lang_pred", "score")
