"""Toxicity: a factorization machine over hashed terms.

Terms are a text's distinct words (runs of letters, in lower case) and their
first 4 and 5 letters, hashed to ``BUCKETS``. From a sample of at most
``max_rows`` labelled rows, the ``n_terms`` buckets with the strongest chi-square
statistic are kept, counted over the whole sample. Terms that tell nothing alone are
kept for a partner: of the ``FREQUENT`` buckets in most texts, those that are strongly
associated with the label within the rows that hold another term, as that term is
within theirs (``partners``). On all of them a second-order factorization machine learns

    w0 + sum w_i x_i + sum_(i<j) <v_i, v_j> x_i x_j

with x = 1 for present terms, so that pairs of terms have weights of their own
that linear weights miss. The model has a fixed size (``BUCKETS`` and ``n_terms``
bound its broadcast). Every text is scored whole.

The sample: the labelled training rows with the least hashes of their id, for
inputs of every size. Ids with several labels count as toxic if one is 1; of several
rows with one id the least text is learned from. Ids may be of any type, and are
compared as texts unless both tables have whole numbers.

Cases: null and empty texts have no terms and get the score of the constant
term; a null id is not held out and has no label; without labels of both kinds,
every score is the smoothed share of label 1 (0.5 with none); rows alike get
scores alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import cut, small_batches
from ._text import Block, Roller, blocks, letters, mix
from .langid import held_out

BITS = 20
BUCKETS = 1 << BITS
PREFIXES = (4, 5)
MAX_ROWS = 40_000
N_TERMS = 4096
LEAST_DOCS = 5
#: of some ten thousand terms without a meaning, one or two pass
LEAST_CHI = 15.0
FREQUENT = 512
PANEL = 256
#: passed by chance by one in 10^9 pairs, of some 4 * 10^5
LEAST_PAIR = 40.0
FACTORS = 8
BLOCK = 1 << 20


class Terms:
    """Extracts distinct hashed terms."""

    def __init__(self):
        self.roller = Roller(23)

    def of(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(document, bucket) pairs, distinct, in order."""
        text = letters(block)
        code = text.code
        n = len(code)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        full = code > 0
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = full[:-1], full[1:]
        first = text.bounds[:-1]
        before[first[first < n]] = False
        last = text.bounds[1:]
        after[last[last > 0] - 1] = False
        start = np.flatnonzero(full & ~before)
        end = np.flatnonzero(full & ~after) + 1
        doc = text.doc_of(start)
        table = mix(code.astype(np.uint64))
        r = self.roller
        sums = r.sums(table)
        keys = [(doc, r.names(sums, start, end))]
        for k in PREFIXES:
            far = end - start >= k
            keys.append((doc[far], r.names(sums, start[far], start[far] + k) ^ np.uint64(k)))
        doc = np.concatenate([d for d, _ in keys])
        h = np.concatenate([x for _, x in keys])
        pair = np.unique(doc << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64))
        return pair >> BITS, pair & (BUCKETS - 1)


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text: str, max_rows: int) -> DataFrame:
    """(y, text) of the sample: at most ``max_rows`` rows, one an id, which bounds the broadcast and what one task trains on."""
    numbers = all(isinstance(df.schema[id_col].dataType, T.IntegralType) for df in (docs, labels))
    own = F.col(f"`{id_col}`").cast("long" if numbers else "string").alias("id")
    one = labels.filter(F.col("toxic").isNotNull() & F.col(f"`{id_col}`").isNotNull() & ~held_out(id_col, 3, 1))
    one = one.groupBy(own).agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    sample = one.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(own, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
    return texts.groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text")).select("y", "text")


def _stats(sample: DataFrame) -> DataFrame:
    """(bucket, docs, toxic): documents with the term, and toxic ones; bucket -1: all."""

    def run(batches):
        terms = Terms()
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            n, t = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
            for block in blocks(batch.column(1), BLOCK):
                doc, h = terms.of(block)
                n += np.bincount(h, minlength=BUCKETS)
                t += np.bincount(h[y[block.lo : block.hi][doc] > 0], minlength=BUCKETS)
            at = np.flatnonzero(n)
            cols = np.append(at, -1), np.append(n[at], len(y)), np.append(t[at], y.sum())
            yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["bucket", "docs", "toxic"])

    return sample.mapInArrow(run, "bucket int, docs long, toxic long").groupBy("bucket").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))


def _select(stats: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Rows, toxic rows, the chosen buckets in order of strength, and frequent ones among the others."""
    stats = cut(stats)
    whole = stats.filter("bucket < 0").first()
    n, t = (whole["docs"], whole["toxic"]) if whole else (0, 0)
    none = np.empty(0, np.int64)
    if not 0 < t < n:
        return n, t, none, none
    d, x = F.col("docs").cast("double"), F.col("toxic").cast("double")
    chi = n * F.pow(x * n - d * t, 2) / (d * (n - d) * F.lit(float(t) * (n - t)))
    some = stats.filter(f"bucket >= 0 and docs >= {LEAST_DOCS} and docs < {n}").withColumn("chi", chi)
    best = some.orderBy(F.desc("chi"), "bucket").limit(n_terms).filter(f"chi > {LEAST_CHI}")
    chosen = np.array([r["bucket"] for r in best.select("bucket").collect()], np.int64)
    often = some.orderBy(F.desc(F.least(F.col("docs"), F.lit(n) - F.col("docs"))), "bucket").limit(FREQUENT)
    frequent = np.array([r["bucket"] for r in often.select("bucket").collect()], np.int64)
    return n, t, chosen, frequent[~np.isin(frequent, chosen)]


def _gain(n: np.ndarray, t: np.ndarray) -> np.ndarray:
    """G-squared of b against the label within the rows of a, at [a, b].

    ``n`` and ``t`` count rows, and rows of label 1, that hold a and b; a and a on the diagonal.
    """
    rows, hits = np.diag(n)[:, None].astype(float), np.diag(t)[:, None].astype(float)
    out = np.zeros(n.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        for seen, of, share in ((t, n, hits), (n - t, n, rows - hits), (hits - t, rows - n, hits), (rows - hits - n + t, rows - n, rows - hits)):
            out += np.where(seen > 0, seen * np.log(seen * rows / (of * share)), 0.0)
    return 2 * out


def partners(indptr: np.ndarray, terms: np.ndarray, y: np.ndarray, n_chosen: int, n_terms: int) -> np.ndarray:
    """Terms from ``n_chosen`` on that matter beside another one, which matters beside them."""
    panel = np.append(np.arange(min(PANEL, n_chosen)), np.arange(n_chosen, n_terms))
    slot = np.full(n_terms, -1)
    slot[panel] = np.arange(len(panel))
    n, t = np.zeros((len(panel), len(panel))), np.zeros((len(panel), len(panel)))
    for lo in range(0, len(y), 4096):
        hi = min(len(y), lo + 4096)
        row, at = np.repeat(np.arange(hi - lo), np.diff(indptr[lo : hi + 1])), slot[terms[indptr[lo] : indptr[hi]]]
        x = np.zeros((hi - lo, len(panel)), np.float32)
        x[row[at >= 0], at[at >= 0]] = 1
        n += x.T @ x
        x = x[y[lo:hi] > 0]
        t += x.T @ x
    gain = _gain(n, t)
    strong = (np.minimum(gain, gain.T) >= LEAST_PAIR) & (n >= LEAST_DOCS)
    found = panel[strong.any(axis=1)]
    return found[found >= n_chosen]


def train_fm(indptr: np.ndarray, terms: np.ndarray, y: np.ndarray, n_terms: int, factors: int = FACTORS, steps: int = 2000, rate: float = 0.1, decay: float = 1e-5, batch: int = 256, seed: int = 7):
    """AdaGrad on log loss; rows in CSR form with x = 1. Returns w0, w, v.

    Takes ``steps`` batches at least and whole epochs. Rows of label 1 weigh as much
    as the others together, at most 8 each, so that few of them are not outvoted.
    """
    epochs = max(5, -(-steps // max(1, -(-len(y) // batch))))
    weight = np.where(y > 0, min(8.0, max(1.0, (len(y) - y.sum()) / max(1.0, y.sum()))), 1.0)
    rng = np.random.default_rng(seed)
    share = (y.sum() + 0.5) / (len(y) + 1)
    w0, w, v = float(np.log(share / (1 - share))), np.zeros(n_terms), rng.normal(0, 0.02, (n_terms, factors))
    g0, gw, gv = 1e-8, np.full(n_terms, 1e-8), np.full((n_terms, factors), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            rows = order[lo : lo + batch]
            lens = indptr[rows + 1] - indptr[rows]
            of = np.repeat(np.arange(len(rows)), lens)
            at = np.repeat(indptr[rows] - np.append(0, np.cumsum(lens)[:-1]), lens) + np.arange(lens.sum())
            f = terms[at]
            sums = np.stack([np.bincount(of, weights=v[f, k], minlength=len(rows)) for k in range(factors)], axis=1)
            squares = np.bincount(of, weights=(v[f] ** 2).sum(axis=1), minlength=len(rows))
            z = w0 + np.bincount(of, weights=w[f], minlength=len(rows)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows]
            d0 = e.mean()
            used, inv = np.unique(f, return_inverse=True)
            ef = e[of]
            dw = np.bincount(inv, weights=ef, minlength=len(used)) / len(rows) + decay * w[used]
            grad = ef[:, None] * (sums[of] - v[f])
            dv = np.stack([np.bincount(inv, weights=grad[:, k], minlength=len(used)) for k in range(factors)], axis=1) / len(rows) + decay * v[used]
            g0 += d0**2
            gw[used] += dw**2
            gv[used] += dv**2
            w0 -= rate * d0 / np.sqrt(g0)
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
    return w0, w, v


def _fit(sample: DataFrame, chosen: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """The buckets used, and their weights, from one task on the sample's terms (``max_rows`` bounds it)."""
    offered = np.append(chosen, frequent)
    slot = np.full(BUCKETS, -1, np.int32)
    slot[offered] = np.arange(len(offered))
    shared = sample.sparkSession.sparkContext.broadcast(slot)
    n_chosen = len(chosen)

    def rows(batches):
        terms = Terms()
        for batch in batches:
            y, packed = batch.column(0), []
            for block in blocks(batch.column(1), BLOCK):
                doc, h = terms.of(block)
                s = shared.value[h]
                doc, s = doc[s >= 0], s[s >= 0]
                ends = np.searchsorted(doc, np.arange(block.hi - block.lo + 1))
                packed += [s[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([y, pa.array(packed, pa.binary())], ["y", "terms"])

    def learn(key, table):
        y = table.column("y").to_numpy().astype(float)
        lists = [np.frombuffer(x, np.int32) for x in table.column("terms").to_pylist()]
        order = sorted(range(len(y)), key=lambda k: (y[k], lists[k].tobytes()))  # the order of arrival must not matter
        y, lists = y[order], [lists[k] for k in order]
        indptr = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64)
        flat = np.concatenate(lists).astype(np.int64)
        used = np.append(np.arange(n_chosen), partners(indptr, flat, y, n_chosen, len(offered)))
        place = np.full(len(offered), -1)
        place[used] = np.arange(len(used))
        keep = place[flat] >= 0
        indptr = np.append(0, np.cumsum(keep))[indptr]
        w0, w, v = train_fm(indptr, place[flat[keep]], y, len(used))
        return pa.table({"used": [used.astype(np.int64).tobytes()], "w0": [w0], "w": [w.tobytes()], "v": [v.tobytes()]})

    packed = sample.mapInArrow(rows, "y int, terms binary")
    model = packed.groupBy(F.lit(0).alias("all")).applyInArrow(learn, "used binary, w0 double, w binary, v binary").first()
    used = offered[np.frombuffer(model["used"], np.int64)]
    return used, model["w0"], np.frombuffer(model["w"]), np.frombuffer(model["v"]).reshape(len(used), FACTORS)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.7, max_rows: int = MAX_ROWS, n_terms: int = N_TERMS) -> DataFrame:
    """id, held_out, score, predicted."""
    small_batches(docs)
    sample = _labelled(docs, labels, id_col, text, max_rows)
    n, t, chosen, frequent = _select(_stats(sample), n_terms)
    if len(chosen) + len(frequent):
        chosen, w0, w, v = _fit(sample, chosen, frequent)
    else:
        w0, w, v = float(np.log((t + 0.5) / (n - t + 0.5))), np.zeros(0), np.zeros((0, FACTORS))
    slot = np.zeros(BUCKETS, np.int32)
    slot[chosen] = np.arange(1, len(chosen) + 1)
    table = np.vstack([np.zeros((1, FACTORS + 2)), np.column_stack([w, v, (v**2).sum(axis=1)])])
    model = docs.sparkSession.sparkContext.broadcast((w0, slot, table))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        terms = Terms()
        w0, slot, table = model.value
        for batch in batches:
            out = [np.empty(0)]
            for block in blocks(batch.column(1), BLOCK):
                doc, h = terms.of(block)
                s = slot[h]
                doc, s = doc[s > 0], s[s > 0]
                sums = [np.bincount(doc, weights=table[s, k], minlength=block.hi - block.lo) for k in range(FACTORS + 2)]
                z = w0 + sums[0] + 0.5 * (sum(x**2 for x in sums[1:-1]) - sums[-1])
                out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(out))], ["id", "score"])

    out = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"id {kind}, score double")
    out = out.withColumnRenamed("id", id_col)
    return out.select(id_col, held_out(id_col, 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
