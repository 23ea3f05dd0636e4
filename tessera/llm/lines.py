"""Line dedup: two Bloom filters, then exact confirmation of the suspects.

1. Rows lie in chunks (``_chunks``); a chunk names the distinct line keys of its
   documents with 64-bit hashes and asks the slices of the names, each name once.
2. A slice has two Bloom filters: once-seen names go into the first, those seen again
   into the second. They follow the number of its names, and no filter is broadcast.
3. Lines whose name the second filter holds are suspects; only they shuffle, as
   a 128-bit digest of the key with the document's id. Keys with two different
   ids are repeated, and the smallest id keeps them.
4. Each document drops the lines whose digest it holds but does not keep. The chunks
   stay where they are; only the digests move.

A key is the line stripped of ASCII white space at both ends with A-Z in lower
case. A false suspect costs a shuffled row, never a line.

Cases: a null or empty text is one empty line; keys under ``min_chars`` code
points are never dropped; rows with one id are one document, so that none of
them loses a line to another; a null id counts as one id above all others; ids may be
of any type with an order; an empty table gives an empty result. ``dedup`` keeps all columns; ``n_chars`` is
brought up to date where it exists.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _chunks, _filters
from ._spark import cut, slices_for, small_batches
from ._text import Block, Roller, blocks, word_spans

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MIN_CHARS = 10
CHUNK_BYTES = 1 << 20
SLICE_BYTES = 16 << 20
LAST_ID = (1 << 63) - 1


class Lines:
    """Lines of a block and the span of each line's key."""

    def __init__(self, block: Block, min_chars: int):
        data, bounds = block.data, block.bounds
        breaks = np.flatnonzero(data == 10)
        first = bounds[:-1]
        self.start = np.sort(np.concatenate([first, breaks + 1]), kind="stable")
        # a break at the end of a text starts a line at the next text's bound: texts come first there
        doc = np.concatenate([np.arange(len(first)), block.doc_of(breaks)])
        order = np.lexsort((np.concatenate([first, breaks + 1]), doc))
        self.start, self.doc = np.concatenate([first, breaks + 1])[order], doc[order]
        last = np.append(self.doc[1:] != self.doc[:-1], True)
        after = np.append(self.start[1:], 0) - 1
        self.end = np.where(last, bounds[self.doc + 1], after)
        ws, we = word_spans(block)
        lo = np.searchsorted(ws, self.start)
        hi = np.searchsorted(we, self.end, side="right")
        full = hi > lo
        self.key_start = np.where(full, np.append(ws, 0)[np.minimum(lo, len(ws))], 0)
        self.key_end = np.where(full, np.append(we, 0)[hi - 1], 0)
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        self.long = np.flatnonzero(points[self.key_end] - points[self.key_start] >= min_chars)

    def names(self, block: Block, roller: Roller) -> np.ndarray:
        """Of the long keys."""
        lower = LOWER[block.data]
        return roller.names(roller.prefix(lower), self.key_start[self.long], self.key_end[self.long])


def _digest(data: np.ndarray, lo: int, hi: int) -> bytes:
    return hashlib.blake2b(data[lo:hi].tobytes().lower(), digest_size=16).digest()


def _chunked(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, int, int]:
    """Chunks of the rows of ``docs``, whose columns go by position, and the places of id and text."""
    small_batches(docs)
    count = F.lit(slices_for(docs, CHUNK_BYTES, 64, 1 << 30))
    c = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text}`")), count).cast("int")
    rows = docs.select(c.alias("c"), *(F.col(f"`{x}`").alias(f"f{k}") for k, x in enumerate(docs.columns)))
    return _chunks.chunked(rows), docs.columns.index(id_col), docs.columns.index(text)


class _Held:
    """The long keys of a chunk: names, the code of each one's id, and where they lie."""

    def __init__(self, ids: pa.Array, texts: pa.Array, roller: Roller, min_chars: int):
        codes = ids.dictionary_encode().indices.fill_null(-1).to_numpy()
        self.blocks, names, owners = [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for block in blocks(texts):
            lines = Lines(block, min_chars)
            self.blocks.append((block, lines))
            names.append(lines.names(block, roller))
            owners.append(block.lo + lines.doc[lines.long])
        self.every, self.row = np.concatenate(names), np.concatenate(owners).astype(np.int64)
        self.code = codes[self.row].astype(np.int64) if len(self.row) else self.row
        order = np.lexsort((self.code, self.every))
        s, who = self.every[order], self.code[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        first = np.flatnonzero(new)
        self.names = s[first]
        #: names that two ids of the chunk hold
        self.many = who[first] != who[np.append(first, len(s))[1:] - 1] if len(s) else np.empty(0, bool)

    def marked(self, parts, bits: int) -> list[tuple[int, bytes]]:
        """(row, digest) of the lines whose name is marked, once an id."""
        hit = _chunks.lookup(self.names, parts, bits)[np.searchsorted(self.names, self.every)]
        out, at = {}, 0
        for block, lines in self.blocks:
            here = np.flatnonzero(hit[at : at + len(lines.long)])
            for k, a, b in zip((at + here).tolist(), lines.key_start[lines.long[here]].tolist(), lines.key_end[lines.long[here]].tolist(), strict=True):
                digest = _digest(block.data, a, b)
                out.setdefault((int(self.code[k]), digest), (int(self.row[k]), digest))
            at += len(lines.long)
        return list(out.values())


def _lost(chunks: DataFrame, docs: DataFrame, id_at: int, text_at: int, min_chars: int, twice_bits: int | None) -> DataFrame:
    """(c, lost): the (id, digest) of the lines that the rows of a chunk lose."""
    bits = slices_for(docs, SLICE_BYTES, 16, 1 << 24).bit_length() - 1

    def ask(batches):
        roller = Roller(11)
        for c, columns, _ in _chunks.chunk_rows(batches):
            held = _Held(columns[id_at], columns[text_at], roller, min_chars)
            yield _chunks.asks(c, held.names, held.many, bits)

    def find(names, more, many):
        return _filters.seen_twice(names, many, twice_bits)

    twice = cut(_chunks.answered(chunks.mapInArrow(ask, _chunks.ASKS), find))
    kind = docs.schema.fields[id_at].dataType

    def suspect(batches):
        roller = Roller(11)
        for c, columns, (parts,) in _chunks.chunk_rows(batches):
            found = _Held(columns[id_at], columns[text_at], roller, min_chars).marked(parts, bits)
            rows = pa.array([x for x, _ in found], pa.int64())
            yield pa.record_batch([pa.array([c] * len(found), pa.int32()), columns[id_at].take(rows), pa.array([x for _, x in found], pa.binary())], ["c", "id", "digest"])

    schema = T.StructType([T.StructField("c", T.IntegerType()), T.StructField("id", kind), T.StructField("digest", T.BinaryType())])
    # null ids are one id above all others
    who = F.struct(F.col("id").isNull().alias("last"), "id")
    suspects = cut(chunks.join(twice.hint("merge"), "c").mapInArrow(suspect, schema).withColumn("who", who))
    # written out, so that the join below shuffles on its own and a hot line can be split
    keepers = cut(suspects.groupBy("digest").agg(F.min("who").alias("keeper"), F.max("who").alias("other")).filter("keeper < other").select("digest", "keeper"))
    return suspects.join(keepers, "digest").filter("who <> keeper").groupBy("c").agg(F.collect_list(F.struct("id", "digest")).alias("lost"))


def _drops(lost) -> dict:
    out: dict = {}
    for x in lost or ():
        out.setdefault(x["id"], set()).add(x["digest"])
    return out


def _kept(text: bytes, drop: set[bytes], min_chars: int) -> tuple[bytes, int]:
    """The text without the dropped lines, and their number."""
    kept = []
    lines = text.split(b"\n")
    for line in lines:
        key = line.strip(b" \t\n\x0b\x0c\r").lower()
        if len(key) < min_chars or hashlib.blake2b(key, digest_size=16).digest() not in drop:
            kept.append(line)
    return b"\n".join(kept), len(lines) - len(kept)


def digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, twice_bits: int | None = None) -> DataFrame:
    """id, n_lines, n_dropped, kept_sha256."""
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    chunks, id_at, text_at = _chunked(docs, "id", "text")
    lost = _lost(chunks, docs, id_at, text_at, min_chars, twice_bits)

    def run(batches):
        for _, (ids, texts), (drops,) in _chunks.chunk_rows(batches):
            drops, n, gone, sha = _drops(drops), [], [], []
            for i, x in zip(ids.to_pylist(), texts, strict=True):
                t = x.as_buffer().to_pybytes() if x.is_valid else b""
                mine = drops.get(i) if drops else None
                kept, dropped = _kept(t, mine, min_chars) if mine else (t, 0)
                n.append(t.count(b"\n") + 1)
                gone.append(dropped)
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["id", "n", "lost", "sha"])

    kind = docs.schema["id"].dataType.simpleString()
    out = chunks.join(lost.hint("merge"), "c", "left").mapInArrow(run, f"id {kind}, n long, lost long, sha string")
    return out.toDF(id_col, "n_lines", "n_dropped", "kept_sha256")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, twice_bits: int | None = None) -> DataFrame:
    """``docs`` with each text cut to the lines that it keeps."""
    chunks, id_at, text_at = _chunked(docs, id_col, text)
    lost = _lost(chunks, docs, id_at, text_at, min_chars, twice_bits)
    size_at = docs.columns.index("n_chars") if "n_chars" in docs.columns and text != "n_chars" else None
    schema = T.StructType([T.StructField(f"f{k}", f.dataType) for k, f in enumerate(docs.schema.fields)])
    kind = pa.int64() if size_at is None else {T.IntegerType: pa.int32(), T.ShortType: pa.int16(), T.DoubleType: pa.float64(), T.StringType: pa.string()}.get(type(schema.fields[size_at].dataType), pa.int64())

    def run(batches):
        for _, columns, (drops,) in _chunks.chunk_rows(batches):
            drops = _drops(drops)
            if drops:
                pairs = zip(columns[id_at].to_pylist(), columns[text_at].to_pylist(), strict=True)
                columns[text_at] = pa.array([x if x is None or i not in drops else _kept(x.encode(), drops[i], min_chars)[0].decode() for i, x in pairs], pa.string())
            if size_at is not None:
                columns[size_at] = pc.utf8_length(columns[text_at]).cast(kind)
            yield pa.record_batch(columns, [f"f{k}" for k in range(len(columns))])

    return chunks.join(lost.hint("merge"), "c", "left").mapInArrow(run, schema).toDF(*docs.columns)


ORACLE = """
with l as (
  select doc_id, generate_subscripts(ls, 1) as n, unnest(ls) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)),
k as (
  select *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from l),
r as (select key, min(doc_id) as keeper from k where length(key) >= 10 group by key having min(doc_id) < max(doc_id)),
d as (select k.*, r.keeper is not null and r.keeper <> k.doc_id as lost from k left join r on k.key = r.key)
select doc_id, count(*) as n_lines, count(*) filter (where lost) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by n) filter (where not lost), '')) as kept_sha256
from d group by doc_id
"""
