"""Importance resampling toward a target: hashed word n-grams through word-id suffix arrays.

A text's features are its runs of 1 to ``SIZES`` words, repeats counted; a feature's
bucket is its crc32 modulo ``buckets``. The gain of a bucket is the log ratio, in
thousandths, of its smoothed shares in the target's and in the corpus's features, a
text's weight the sum of gains over its features. With Gumbel noise from the id, the
texts of highest weight plus noise are a sample without replacement whose odds follow
the weights.

Each task takes its texts in blocks and works on word ids:

1. Words get ids, and the places of a block are sorted by the ``SIZES`` words that
   start there: a suffix array cut off at that depth, as no feature is longer.
2. LCP values of neighbours, stopped at the ends of texts, enumerate repeated n-grams:
   a run of neighbours with LCP >= n is one n-gram, however often it occurs.
3. The n-gram is hashed once a run, from the crc32 of its words, as the crc32 of a
   join follows from those of its parts. Counting takes the runs' lengths; scoring
   scatters the runs' gains back to the places where they occur.

Counting sums buckets in the task before the shuffle, so 2 * ``buckets`` sums reach the
driver and ``buckets`` gains are broadcast, whatever the input. Texts are read twice, to
count and to score, and never stored or moved. Ranks come from one range sort of ids
and scores, whose numbers of rows a partition give each partition's first rank.

Cases: a null or empty text, or one without a word, has no feature and weight 0; an
empty target leaves every gain to the smoothing; an empty table gives an empty result;
equal scores go to the smaller id, null ids last; rows with one id and one text have
ranks of their own in no set order; a null id has the noise of an empty one; ids may be
of any type that sorts; other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, small_batches
from ._text import Block, blocks, word_spans

SIZES = 3
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
SCALE = 1000
BLOCK = 4 << 20

#: bytes that are in no word: ASCII but digits and letters
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _step(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[crc & np.uint32(255)] ^ (crc >> np.uint32(8))


def _crc_table() -> np.ndarray:
    """The register after one more byte, by its low byte."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & np.uint32(1), crc >> np.uint32(1) ^ np.uint32(0xEDB88320), crc >> np.uint32(1))
    return crc


ONE = _crc_table()


def _shift_tables(most: int = 64) -> np.ndarray:
    """[length, byte of the register, its value]: what that byte adds to the register ``length`` zero bytes on."""
    out = np.empty((most, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(1, most):
        out[n] = _step(out[n - 1], ONE)
    return out


SHIFT = _shift_tables()


def join_crc(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of a + b from crc32 of a, crc32 of b, and b's number of bytes."""
    crc, left_over = left.copy(), length.copy()
    while True:
        n = np.minimum(left_over, len(SHIFT) - 1)
        crc = SHIFT[n, 0, crc & 255] ^ SHIFT[n, 1, crc >> 8 & 255] ^ SHIFT[n, 2, crc >> 16 & 255] ^ SHIFT[n, 3, crc >> 24]
        left_over = left_over - n
        if not left_over.any():
            return crc ^ right


class Runs:
    """The runs of equal n-grams in a block's suffix array.

    ``order`` is the suffix array of the block's words, ``doc`` the text of each word;
    ``heads[n - 1]`` are the places in ``order`` where a run of n-grams begins, and
    ``sizes[n - 1]`` the runs' lengths; ``crc(n)`` hashes each run once.
    """

    def __init__(self, block: Block, depth: int = SIZES):
        data = LOWER[block.data]
        start, end = word_spans(block, BETWEEN)
        self.doc = block.doc_of(start)
        self.count = len(start)
        self.depth = depth
        self.n_docs = len(block.bounds) - 1
        if not self.count:
            return
        inside = ~BETWEEN[data]
        offsets = np.append(0, np.cumsum(end - start)).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), self.count, [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        names = words.dictionary.to_pylist()
        self.word = words.indices.to_numpy()
        self.crcs = np.array([zlib.crc32(x) for x in names], np.uint32)
        self.lengths = np.array([len(x) for x in names], np.int64)
        following = [self._after(j) for j in range(depth)]
        base = len(names) + 1
        if base**depth < 1 << 63:
            key = np.zeros(self.count, np.int64)
            for ids in following:
                key = key * base + ids
            self.order = np.argsort(key, kind="stable")
        else:
            self.order = np.lexsort(following[::-1])
        self.lcp = np.zeros(self.count, np.int8)
        same = np.ones(self.count - 1, bool)
        for ids in following:
            ids = ids[self.order]
            same &= (ids[1:] == ids[:-1]) & (ids[1:] > 0)
            self.lcp[1:] += same
        self.full = [ids[self.order] > 0 for ids in following]

    def _after(self, j: int) -> np.ndarray:
        """1 + the id of the word j places on; 0 beyond the end of the text."""
        out = np.zeros(self.count, np.int64)
        if j < self.count:
            inside = self.doc[j:] == self.doc[: self.count - j]
            out[: self.count - j][inside] = 1 + self.word[j:][inside]
        return out

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the runs of n-grams: places in the text of all, in order of runs; first of each; length of each."""
        at = np.flatnonzero(self.full[n - 1])
        first = np.flatnonzero(self.lcp[at] < n)
        return self.order[at], first, np.diff(np.append(first, len(at)))

    def crc(self, places: np.ndarray, n: int) -> np.ndarray:
        """crc32 of the n words at each place, joined by one space."""
        word = self.word[places]
        out = self.crcs[word]
        for j in range(1, n):
            word = self.word[places + j]
            spaced = ~_step(~out ^ np.uint32(0x20), ONE)
            out = join_crc(spaced, self.crcs[word], self.lengths[word])
        return out


def bucket_counts(texts: DataFrame, sizes: int, buckets: int) -> np.ndarray:
    """Features by bucket over all rows of (text); summed in each task before the shuffle."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0), BLOCK):
                found = Runs(block, sizes)
                for n in range(1, sizes + 1) if found.count else ():
                    places, first, length = found.runs(n)
                    total += np.bincount(found.crc(places[first], n) % buckets, weights=length, minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """By bucket: thousandths of the log ratio of smoothed shares, rounded down."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = (target + 1.0) * (s_all + n) / ((corpus + 1.0) * (t_all + n))
    return np.array([math.floor(scale * math.log(x)) for x in ratio.tolist()], np.int64)


def noise(name: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """Gumbel noise in thousandths from the id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(name.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / F.lit(float(1 << 32))))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", sizes: int = SIZES, buckets: int = BUCKETS) -> DataFrame:
    """id, n_words, n_features, weight of each row; ``target`` has a column of the same name for its texts."""
    small_batches(docs)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    gain = gains(bucket_counts(slim.select("text"), sizes, buckets), bucket_counts(target.select(F.col(f"`{text}`").cast("binary").alias("text")), sizes, buckets))
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        gain = shared.value
        for batch in batches:
            for block in blocks(batch.column(1), BLOCK):
                found = Runs(block, sizes)
                n_words = np.bincount(found.doc, minlength=found.n_docs)
                weight, n_features = np.zeros(found.n_docs, np.int64), np.zeros(found.n_docs, np.int64)
                if found.count:
                    value = np.zeros(found.count, np.int64)
                    for n in range(1, sizes + 1):
                        places, first, length = found.runs(n)
                        value[places] += np.repeat(gain[found.crc(places[first], n) % buckets], length)
                        n_features += np.maximum(n_words - n + 1, 0)
                    total = np.append(0, np.cumsum(value))
                    edge = np.append(0, np.cumsum(n_words))
                    weight = total[edge[1:]] - total[edge[:-1]]
                ids = batch.column(0).slice(block.lo, block.hi - block.lo)
                yield pa.record_batch([ids, pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(weight, pa.int64())], ["id", "n_words", "n_features", "weight"])

    return slim.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds ``place``: 1, 2, 3... over all rows in this order, by one range sort.

    A row's place is its number in its partition, which monotonically_increasing_id
    holds in its low 33 bits, after the rows of the partitions before. Rows that tie
    are spread by their place in the input, so that no group of them is one task.
    """
    tie, at = F.monotonically_increasing_id(), "place"
    dealt = cut(rows).withColumn("tie", tie).repartitionByRange(*order, F.col("tie")).sortWithinPartitions(*order, F.col("tie")).drop("tie")
    dealt = cut(dealt.withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftrightunsigned(at, 33)
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    dealt = dealt.withColumn("part", part).join(parts, "part")
    return dealt.withColumn(at, F.col("before") + F.col(at) - F.shiftleft("part", 33) + 1).drop("part", "before")


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, sizes: int = SIZES, buckets: int = BUCKETS) -> DataFrame:
    """id, n_features, weight, score, rank: the drawn rows have ranks from 1, the others null.

    Drawn are ``percent`` of a hundred, rounded down, of the rows with at least ``least_words`` words.
    """
    rows = weigh(docs, target, id_col, text, sizes, buckets).withColumnRenamed(id_col, "id")
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("able", F.col("n_words") >= least_words)
    rows = ranked(rows, F.col("able").desc(), F.col("score").desc(), F.col("id").asc_nulls_last())
    wanted = F.expr(f"{percent} * n_able div 100")
    n_able = rows.agg(F.count_if("able").alias("n_able")).select(wanted.alias("wanted"))
    picked = F.col("able") & (F.col("place") <= n_able.scalar())
    return rows.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(picked, F.col("place")).alias("rank"))


ORACLE = """
with texts as (
  select 0 as side, doc_id, text from documents union all select 1, null, text from benchmark),
words as (
  select side, doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from texts),
feats as (
  select side, doc_id, r, unnest(flatten([list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')) for n in [1, 2, 3]])) as f from words),
names as (select f, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: cast('0x' || x as bigint))),
            lambda a, b: xor(a >> 8, {TAB}[cast(xor(a, b) & 255 as integer) + 1])) as c from (select distinct f from feats)),
hashed as (select f, xor(c, 4294967295) % 10000 as b from names),
buckets as (select side, doc_id, r, b from feats join hashed using (f)),
counts as (select b, count(*) filter (side = 0) as s, count(*) filter (side = 1) as t from buckets group by b),
sums as (select sum(s)::double as s_all, sum(t)::double as t_all from counts),
gains as (select b, cast(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) as bigint) as gain from counts, sums),
weights as (select r, count(*) as n_features, sum(gain) as weight from buckets join gains using (b) where side = 0 group by r),
scores as (
  select doc_id, r, len(w) >= 20 as able, coalesce(n_features, 0) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
    cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('42:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
  from words left join weights using (r) where side = 0),
placed as (select *, row_number() over (order by able desc, score desc, doc_id nulls last) as place from scores)
select doc_id, n_features, weight, score, case when able and place <= (select 5 * count(*) // 100 from scores where able) then place end as rank from placed
""".replace("{TAB}", str(ONE.tolist()))
