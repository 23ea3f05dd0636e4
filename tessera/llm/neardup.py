"""Near-duplicate documents by ProbMinHash.

1. A document's shingles of five words carry their counts as weights. Every
   shingle has a Poisson process of arrivals, seeded by its hash, with its weight
   as the rate; each arrival falls into one of the signature's registers, which
   keeps its earliest. A shingle stops when its next arrival is later than the
   latest register of the document. Two signatures agree in a register with the
   probability Jaccard similarity of the weighted sets.
2. Texts alike are collapsed to the one of least id.
3. Signatures are cut into bands; documents that agree in a band meet in a bucket.
   A bucket links each member to two members, the one that meets most documents and the
   first in an order of its own (aggregations, so no bucket is gathered in a task).
4. Links are verified with the exact probability Jaccard of both whole texts: each
   document's best link first, then all that join classes which are still apart.
5. What is left of a bucket, without those two members, is dealt into blocks if it still
   has more than one class. Each block meets each other one in a task of its own, where
   matrix products rule out pairs by a bound and the exact similarity decides the rest.
   So every pair of a bucket is compared, or its documents are in one class already.
6. Classes are the connected components of the verified links; a class's id is its
   least document id.

Cases: texts without a word (null, empty, blank) are classes of their own; texts
of fewer than five words have one shingle of all their words; rows with one id are
one document; rows with a null id are not in the result, and ``keep_one`` keeps them; ids
are integers (other types are cast to bigint, what can't be cast is an error); an
empty table gives an empty result. ``keep_one`` keeps all columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, fresh, small_batches
from ._text import Block, Roller, blocks, combine, mix, word_spans
from .graph import components

SHINGLE = 5
LEAST = 0.8
BANDS = 24
ROWS = 5
BLOCK_DOCS = 1000
BLOCK_BYTES = 4 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(block: Block, roller: Roller, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) of every window of ``k`` words, in order."""
    start, end = word_spans(block)
    words = roller.names(roller.prefix(block.data), start, end)
    doc = block.doc_of(start)
    h = combine(words, k)
    same = doc[: len(h)] == doc[k - 1 :][: len(h)]
    first = np.searchsorted(doc, np.arange(len(block.bounds)))
    n = np.diff(first)
    owner, found = [doc[: len(h)][same]], [h[same]]
    for d in np.flatnonzero((n > 0) & (n < k)):
        owner.append(np.array([d]))
        found.append(combine(words[first[d] : first[d + 1]], int(n[d])) ^ np.uint64(n[d]))
    return np.concatenate(owner), np.concatenate(found)


def weighted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with counts, in order of document."""
    _, at, n = np.unique(mix(h + doc.astype(np.uint64) * GOLDEN), return_index=True, return_counts=True)
    order = np.argsort(at)
    return doc[at[order]], h[at[order]], n[order]


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """(n_docs, m) shingle hashes; rows of documents without shingles are 0."""
    soonest = np.full(n_docs * m, np.inf)
    holder = np.zeros(n_docs * m, np.uint64)
    time, step, size = np.zeros(len(h)), 0, 1
    while len(h):
        t = np.arange(step, step + size, dtype=np.uint64)
        x = mix(h[:, None] + (t + np.uint64(1)) * GOLDEN)
        gaps = -np.log((x >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weight[:, None]
        at = time[:, None] + np.cumsum(gaps, axis=1)
        register = ((mix(x) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        slot = (doc[:, None] * m + register).ravel()
        when = at.ravel()
        np.minimum.at(soonest, slot, when)
        won = np.flatnonzero(soonest[slot] == when)
        holder[slot[won]] = h[won // size]
        time = at[:, -1]
        latest = soonest.reshape(n_docs, m).max(axis=1)
        go = np.flatnonzero(time < latest[doc])
        doc, h, weight, time = doc[go], h[go], weight[go], time[go]
        step += size
        size = min(2 * size, 256)
    return holder.reshape(n_docs, m)


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact J_P of two arrays of shingle hashes, counts as weights."""
    if not len(a) or not len(b):
        return 0.0
    ha, va = np.unique(a, return_counts=True)
    hb, wb = np.unique(b, return_counts=True)
    if len(ha) == len(a) and len(hb) == len(b):
        both = len(np.intersect1d(ha, hb, assume_unique=True))
        return both / (len(ha) + len(hb) - both)
    every = np.union1d(ha, hb)
    v, w = np.zeros(len(every)), np.zeros(len(every))
    v[np.searchsorted(every, ha)] = va
    w[np.searchsorted(every, hb)] = wb
    both = (v > 0) & (w > 0)
    with np.errstate(divide="ignore"):
        ratio = np.where(v > 0, w / np.where(v > 0, v, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    rs, vs, ws = ratio[order], np.append(0, np.cumsum(v[order])), np.append(0, np.cumsum(w[order]))
    upto = np.searchsorted(rs, ratio[both], side="right")
    r, x = ratio[both], v[both]
    return float((x / (vs[upto] + (ws[-1] - ws[upto]) / r)).sum())


def _signed_docs(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, digest, keys): the digest of the text and one key a band."""

    def run(batches):
        roller = Roller(31)
        for batch in batches:
            digests, keys, offsets = [], [], [np.zeros(1, np.int64)]
            for block in blocks(batch.column(1), 1 << 20):
                n = len(block.bounds) - 1
                doc, h, weight = weighted(*shingles(block, roller))
                sig = signatures(doc, h, weight, n, bands * rows).reshape(n, bands, rows)
                key = np.tile(np.arange(bands, dtype=np.uint64), (n, 1))
                for j in range(rows):
                    key = mix(key * GOLDEN + sig[:, :, j])
                some = np.zeros(n, bool)
                some[doc] = True
                keys.append(key[some].ravel())
                offsets.append(some * bands)
                edges = block.bounds.tolist()
                raw = block.data.tobytes()
                digests += [hashlib.blake2b(raw[a:b], digest_size=16).digest() if ok else None for a, b, ok in zip(edges[:-1], edges[1:], some.tolist(), strict=True)]
            flat = np.concatenate([np.empty(0, np.uint64), *keys]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(offsets)), pa.int32()), pa.array(flat))
            yield pa.record_batch([batch.column(0), pa.array(digests, pa.binary()), lists], ["id", "digest", "keys"])

    return docs.mapInArrow(run, "id long, digest binary, keys array<long>")


def _links(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, n): a member, another of its bucket, and the number of their common buckets.
    (key, rep): the members of a bucket that the others do not all meet.

    The members of a bucket meet two of them: the one that meets most documents over all
    its buckets, and the first in an order of the bucket's own. A text from which many
    others were made agrees with each of them more than they do among themselves, so it
    is the one that all its copies meet.
    """
    member = reps.select("rep", F.posexplode("keys").alias("band", "key"))
    sizes = cut(member.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), narrow=True)
    shared = cut(member.join(sizes, "key"))
    meets = cut(shared.groupBy("rep").agg(F.sum("size").alias("meets")), narrow=True)
    known = cut(shared.select("key", "band", "rep").join(meets, "rep"))
    most = F.max(F.struct("meets", F.xxhash64("rep").alias("o"), "rep")).alias("hub")
    first = F.min(F.struct(F.xxhash64("rep", "band").alias("o"), "rep")).alias("first")
    ends = cut(known.groupBy("key").agg(most, first).select("key", F.array_distinct(F.array("hub.rep", "first.rep")).alias("ends")))
    met = known.join(ends, "key")
    pairs = met.select(F.col("rep").alias("a"), F.explode("ends").alias("b")).filter("a <> b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), met.filter(~F.array_contains("ends", F.col("rep"))).select("key", "rep")


def _undirected(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sets(column, roller: Roller) -> Iterator[np.ndarray]:
    """The shingle hashes of each text."""
    for block in blocks(column, 1 << 20):
        doc, h = shingles(block, roller)
        order = np.argsort(doc, kind="stable")
        at = np.searchsorted(doc[order], np.arange(block.hi - block.lo + 1))
        h = h[order]
        yield from (h[x:y] for x, y in zip(at[:-1], at[1:], strict=True))


def _parts(n, size):
    """Into how many blocks texts go, by number and bytes."""
    return F.greatest(F.ceil(n / BLOCK_DOCS), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose similarity is ``least`` or more.

    The partners of each b are dealt into blocks, and b goes before each block, so that the
    text of a hub is sent once a block and not once a pair.
    """
    size = texts.select(F.col("id").alias("of"), F.octet_length("text").cast("long").alias("bytes"))
    many = pairs.join(size, F.col("a") == F.col("of")).groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    many = cut(many.select("b", _parts(F.col("n"), F.col("bytes")).alias("parts")), narrow=True)
    of_pairs = pairs.join(many, "b").select("b", F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"), F.lit(1).alias("side"), F.col("a").alias("id"))
    heads = many.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("b").alias("id"))
    rows = of_pairs.unionByName(heads).join(texts.hint("merge"), "id").select("b", "part", "side", "id", "text")
    rows = rows.repartition("b", "part").sortWithinPartitions("b", "part", "side")

    def run(batches):
        roller, hub, shared = Roller(31), None, np.empty(0, np.uint64)
        for batch in batches:
            found = ([], [])
            for b, part, side, i, own in zip(*(batch.column(k).to_pylist() for k in range(4)), _sets(batch.column(4), roller), strict=True):
                if not side:
                    hub, shared = (b, part), own
                elif hub == (b, part) and probability_jaccard(own, shared) >= least - 1e-12:
                    found[0].append(i)
                    found[1].append(b)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def joined(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of labels, as many as join the classes that pairs of ``left`` and ``right`` join.

    With the counts p and q as distributions and m the sum of min(p, q), the similarity is
    at most m and at most (a + b - m) / (2 - m), where a and b are the shares of p and of q
    on what both have: a + b is least * (3 - least) or more for every pair that is sought.
    """
    n = len(sets)
    doc, h, count = weighted(np.repeat(np.arange(n), [len(x) for x in sets]), np.concatenate(sets))
    _, column, holders = np.unique(h, return_inverse=True, return_counts=True)
    some = np.flatnonzero(holders[column] > 1)
    share = (count / np.array([len(x) for x in sets])[doc])[some].astype(np.float32)
    doc, column = doc[some], (np.cumsum(holders > 1) - 1)[column[some]]
    order = np.argsort(column, kind="stable")
    doc, column, share = doc[order], column[order], share[order]
    both, width = np.zeros((len(left), len(right))), 2048
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        x, y = np.searchsorted(column, [lo, lo + width])
        p = np.zeros((n, width), np.float32)
        p[doc[x:y], column[x:y] - lo] = share[x:y]
        on = (p > 0).astype(np.float32)
        both += p[left] @ on[right].T
        both += on[left] @ p[right].T
    i, j = np.nonzero(both >= least * (3 - least) - 1e-3)
    order = np.argsort(-both[i, j], kind="stable")
    i, j = left[i[order]], right[j[order]]
    apart = label[i] != label[j]
    parent, found = {x: x for x in label.tolist()}, []

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
        x, y = find(int(label[a])), find(int(label[b]))
        if x != y and probability_jaccard(sets[a], sets[b]) >= least - 1e-12:
            parent[y] = x
            found.append((int(label[a]), int(label[b])))
    return found


def _rest(rest: DataFrame, labels: DataFrame, texts: DataFrame, least: float) -> DataFrame | None:
    """(a, b): labels of classes that a pair of the members left in a bucket joins; None if all are in one class.

    A bucket's largest class, if it is large, has blocks that do not meet each other.
    """
    size = texts.select(F.col("id").alias("of"), F.octet_length("text").cast("long").alias("bytes"))
    member = rest.join(size, F.col("rep") == F.col("of")).join(labels, F.col("rep") == F.col("node"), "left")
    member = cut(member.select("key", "rep", F.coalesce("label", "rep").alias("label"), "bytes"))
    of_class = member.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    top = F.max(F.struct("n", "bytes", "label")).alias("top")
    found = of_class.groupBy("key").agg(top, F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    large = F.col("top.n") * 8 >= BLOCK_DOCS
    few = _parts(F.col("n") - F.when(large, F.col("top.n")).otherwise(0), F.col("bytes") - F.when(large, F.col("top.bytes")).otherwise(0))
    many = F.when(large, _parts(F.col("top.n"), F.col("top.bytes"))).otherwise(0)
    found = cut(found.select("key", F.when(large, F.col("top.label")).alias("main"), few.alias("few"), many.alias("many")), narrow=True)
    if found.isEmpty():
        return None
    dealt = member.join(found, "key").withColumn("in_main", F.coalesce(F.col("label") == F.col("main"), F.lit(False)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("rep", "key"), F.when(F.col("in_main"), F.col("many")).otherwise(F.col("few"))).cast("int"))
    all_few = F.sequence(F.lit(0), F.col("few") - 1)
    # a task is (i, j): j counts on from the blocks of the other classes to those of the main one
    of_main = F.transform(all_few, lambda x: F.struct(x.alias("i"), (F.col("few") + F.col("mine")).alias("j"), F.lit(1).alias("side")))
    own = F.transform(all_few, lambda x: F.struct(F.least(x, "mine").alias("i"), F.greatest(x, "mine").alias("j"), (F.col("mine") > x).cast("int").alias("side")))
    meets = F.when(F.col("many") > 0, F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda x: F.struct(F.col("mine").alias("i"), (F.col("few") + x).alias("j"), F.lit(0).alias("side"))))
    tasks = F.when(F.col("in_main"), of_main).otherwise(F.concat(own, F.coalesce(meets, F.array().cast("array<struct<i:int,j:int,side:int>>"))))
    dealt = cut(dealt.select("key", "rep", "label", F.explode(tasks).alias("t")).select("key", "t.*", "rep", "label"))

    def run(table: pa.Table) -> pa.Table:
        side, label = table.column("side").to_numpy(), table.column("label").to_numpy()
        sets = list(_sets(table.column("text"), Roller(31)))
        every = np.arange(len(sets))
        diagonal = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        found = joined(sets, label, every if diagonal else every[side == 0], every if diagonal else every[side == 1], least)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    full = dealt.join(texts, F.col("rep") == F.col("id")).select("key", "i", "j", "side", "label", "text")
    return full.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def _contracted(labels: DataFrame, more: DataFrame) -> DataFrame:
    """(node, label) after links ``more`` between labels."""
    over = components(more).toDF("old", "new")
    lone = over.join(labels, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("old").alias("label"))
    labels = labels.union(lone)
    return labels.join(over, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))


def class_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = LEAST, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, class_id), one row an id; documents alone have a class of their own."""
    small_batches(docs)
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).filter("id is not null")
    signed = cut(_signed_docs(slim, bands, rows))
    reps = cut(signed.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("keys").alias("keys")))
    links, rest = _links(reps)
    links = cut(links)
    ends = cut(links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct(), narrow=True)
    texts = cut(slim.join(ends, "id", "left_semi").dropDuplicates(["id"]).select("id", "text"))
    # a document's best link first: most of the others then lie within a class
    best = links.groupBy("a").agg(F.max(F.struct("n", F.xxhash64("b").alias("o"), "b")).alias("x"))
    first = cut(_undirected(best.select("a", F.col("x.b").alias("b"))), narrow=True)
    labels = components(_verified(first, texts, least))
    la, lb = labels.toDF("na", "la"), labels.toDF("nb", "lb")
    apart = _undirected(links.select("a", "b")).join(first, ["a", "b"], "left_anti")
    apart = apart.join(la, F.col("a") == F.col("na"), "left").join(lb, F.col("b") == F.col("nb"), "left")
    apart = cut(apart.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")).filter("la <> lb"), narrow=True)
    more = _verified(apart.select("a", "b"), texts, least).join(apart, ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b"))
    # the classes are contracted to their labels, and only links between them are left
    labels = cut(_contracted(labels, more), narrow=True)
    more = _rest(rest, labels, texts, least)
    if more is not None:
        labels = _contracted(labels, more)
    own = signed.join(reps.select("digest", "rep"), "digest", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    own = own.join(labels, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("label", "rep").alias("class_id"))
    return own.groupBy("id").agg(F.min("class_id").alias("class_id"))


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = LEAST, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, class_id, n_class), one row an id."""
    own = cut(class_of(docs, id_col, text, least, bands, rows))
    # written out, so that the join below shuffles on its own and a large class can be split
    sizes = cut(own.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_class")))
    return own.join(sizes, "class_id").select(F.col("id").alias(id_col), "class_id", "n_class")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` without the documents that are not the least of their class."""
    own = fresh(docs, "lost")
    lost = class_of(docs, id_col, text, least).filter("id <> class_id").select(F.col("id").alias(own))
    return docs.join(lost, F.col(f"`{id_col}`") == F.col(own), "left_anti")
