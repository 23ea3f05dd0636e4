"""Token ids as files: frequency-ranked, byte-aligned codes with control bytes apart.

Writing:

1. Every text is encoded once, in its task, and its ids are kept in a table (``cut``).
2. Ids are counted over all texts; the most frequent gets rank 0, ties go to the
   smaller id. There is one rank an id of the vocabulary, so this table is bounded.
3. The ids of texts move once, by a range sort on the id of the row. Each task then turns
   them into streams of ranks (below), packs these into blocks of about ``BLOCK_BYTES``
   and writes them, in order, ``BLOCKS`` a file.

Reading takes each file to a task, which decodes blocks by numpy table lookup. Where a
document starts among all ids follows from the blocks' numbers in ``index``.

A folder holds

- ``ranks``: Parquet, (rank, token, n) by rank;
- ``index``: Parquet, one row a block: (part, block, start), start being the number of
  ids in all blocks before;
- ``blocks``: binary files of blocks in ascending order of (part, block). All numbers are
  little-endian. A block is the header ``TSRA``, uint32 version, uint32 part, uint32
  block, uint32 documents, uint32 bytes of all names, uint64 ids, uint64 bytes of all
  streams; then by document the int32 bytes of its name (-1: null), the uint32 ids,
  and the uint32 bytes of its stream; the names, as UTF-8; the streams; a line feed.

A stream of n ids is (n + 3) // 4 control bytes, then the ranks' bytes: two bits a rank,
lowest first, hold its number of bytes less one, and the bytes are the lowest first.

A plain byte-level BPE is asked for each distinct piece of a block of texts only:
texts are cut where no token can lie across (``cuts``), and a piece's ids go to all
its places. Any other tokenizer, and any text that holds an added token, is encoded
whole.

Cases: a null or empty text is the end id alone; null ids come first; rows with one id
come in the order of the input, and equal ones are spread over tasks; ids may be of any
type that sorts and that casts to text and back; texts of more than 2^32 ids do not
fit; an empty table gives no block and reads as an empty table; other columns are not
read.
"""

from __future__ import annotations

import json
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut, input_bytes, small_batches
from ._text import byte_view

END = 2
BLOCK_BYTES = 4 << 20
BLOCKS = 8
MAGIC, VERSION = b"TSRA", 1
HEADER = struct.Struct("<4sIIIIIQQ")
#: texts whose pieces are looked up together, in bytes
TEXTS = 8 << 20
#: pieces that a task remembers
PIECES = 1 << 19

# --- pieces of a text


def _bytes(*spans: tuple[int, int]) -> np.ndarray:
    """Which bytes lie in one of the spans, ends included."""
    out = np.zeros(256, bool)
    for lo, hi in spans:
        out[lo : hi + 1] = True
    return out


#: classes of bytes; marks are printable ASCII without the apostrophe, which takes letters to itself, FAR may begin white space beyond ASCII
SPACE, BREAK, LETTER, DIGIT, MARK, OTHER, HIGH, FAR = range(8)
CLASS = np.full(256, OTHER, np.uint8)
for _spans, _kind in (
    ([(0x20, 0x20)], SPACE), ([(0x09, 0x0D)], BREAK), ([(0x41, 0x5A), (0x61, 0x7A)], LETTER), ([(0x30, 0x39)], DIGIT),
    ([(0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)], MARK), ([(0x80, 0xFF)], HIGH), ([(0xC2, 0xC2), (0xE1, 0xE3)], FAR),
):
    for _lo, _hi in _spans:
        CLASS[_lo : _hi + 1] = _kind
#: by class of a byte and of the next one: whether a text may be cut between the two, and before the first of them
BETWEEN, BEFORE = np.zeros((8, 8), bool), np.zeros((8, 8), bool)
BETWEEN[LETTER, [SPACE, BREAK, DIGIT, MARK, OTHER]] = True
BETWEEN[DIGIT, [SPACE, BREAK, LETTER, MARK, OTHER]] = True
BETWEEN[MARK, [LETTER, DIGIT]] = True
BETWEEN[BREAK, [LETTER, DIGIT, MARK]] = BEFORE[BREAK, [LETTER, DIGIT, MARK]] = True
BEFORE[SPACE, [LETTER, DIGIT, MARK, OTHER, HIGH]] = True
#: one token class of the pattern from end to end: letters up to U+00FF, digits, or marks, with a space before or not
ONE_CLASS = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places where a byte-level BPE with the usual pattern may be cut, the texts' bounds among them.

    The pattern takes runs of letters, of digits and of marks, each with a space before,
    contractions, and white space but for its last character if a word follows. So a
    token ends after a letter or digit before an ASCII character of another kind, after
    a mark before a letter or digit, before a space that a word follows, and around
    other white space that an ASCII word follows. Fewer cuts than that do no harm.
    """
    edge = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        kind = CLASS[data]
        lead = np.flatnonzero(data[:-1] == 0xC3) + 1
        kind[lead[(data[lead] != 0x97) & (data[lead] != 0xB7)]] = LETTER
        pair = kind[:-1] << 3 | kind[1:]
        edge[1:-1] = BETWEEN.ravel()[pair]
        before = BEFORE.ravel()[pair]
        last = bounds[(bounds > 0) & (bounds < len(data))]
        before[last - 1] = False  # what follows is another text
        edge[:-2] |= before
    edge[bounds] = True
    return np.flatnonzero(edge)


def byte_letters() -> dict[int, str]:
    """The character by which a byte-level BPE names a byte: its own if that can be printed, or the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


LETTERS = byte_letters()


class Encoder:
    """Ids of texts by one tokenizer file of the tokenizers library."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        made = json.loads(self.tokenizer.to_str())
        self.added = [x["content"].encode() for x in made["added_tokens"]]
        pre, model = made["pre_tokenizer"] or {}, made["model"]
        self.pieces = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not made["normalizer"]
            and not made["truncation"] and not made["padding"] and model["type"] == "BPE" and not model.get("dropout")
            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in made["added_tokens"])
        )
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        #: piece to number; piece k has the ids ``flat[ends[k]:ends[k + 1]]``
        self.known: dict[bytes, int] = {}
        self.flat, self.ends = array("I"), array("q", [0])

    def whole(self, texts: list[bytes]) -> list[list[int]]:
        """Each text by the library as it is."""
        return [x.ids for x in self.tokenizer.encode_batch([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)]

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The numbers of the pieces; a piece of one class is asked of the model, another of the whole tokenizer."""
        if len(self.known) > PIECES:
            self._forget()
        known, flat, ends, tokenize, alike = self.known, self.flat, self.ends, self.model.tokenize, ONE_CLASS.fullmatch
        rest = []
        for x in pieces:
            if x in known:
                continue
            if not alike(x):
                rest.append(x)
                continue
            name = x.decode("latin-1")
            name = name.replace(" ", LETTERS[0x20]) if x.isascii() else name.translate(LETTERS)
            known[x] = len(known)
            flat.extend([t.id for t in tokenize(name)])
            ends.append(len(flat))
        for x, ids in zip(rest, self.whole(rest), strict=True):
            known[x] = len(known)
            flat.extend(ids)
            ends.append(len(flat))
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts ``data[bounds[k]:bounds[k + 1]]``, and the number of ids of each."""
        n = len(bounds) - 1
        if not self.pieces:
            found = self.whole([data[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
            return np.array([i for x in found for i in x], self.kind), np.array([len(x) for x in found], np.int64)
        edge = cuts(data, bounds)
        raw = data.tobytes()
        if any(x in raw for x in self.added):
            split = [any(x in raw[a:b] for x in self.added) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            whole = np.repeat(np.array(split), np.diff(bounds))
            edge = edge[~np.append(whole, False)[edge] | np.isin(edge, bounds)]
        if len(edge) < 2:
            return np.empty(0, self.kind), np.zeros(n, np.int64)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        number = self._numbers(pieces.dictionary.to_pylist())
        ends, flat = np.array(self.ends), np.array(self.flat)
        long = (ends[number + 1] - ends[number]).astype(np.int32)
        upto = np.append(0, np.cumsum(long, dtype=np.int32))
        own = flat[np.repeat((ends[number] - upto[:-1]).astype(np.int32), long) + np.arange(upto[-1], dtype=np.int32)].astype(self.kind)
        placed = pa.ListArray.from_arrays(pa.array(upto), pa.array(own)).take(pieces.indices)
        ids, upto = placed.flatten().to_numpy(), placed.offsets.to_numpy()
        return ids, np.diff(upto[np.searchsorted(edge, bounds)].astype(np.int64))


_encoders: dict[str, Encoder] = {}


def encoder_of(file: str) -> Encoder:
    """The encoder of this worker, which goes on to remember pieces from task to task."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


# --- streams


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The streams of consecutive texts of ``counts`` ranks each, as bytes, and their lengths."""
    ranks = ranks.astype(np.uint32)
    upto = np.append(0, np.cumsum(counts))
    control = (counts + 3) // 4
    text = np.repeat(np.arange(len(counts)), counts)
    wide = 1 + sum((ranks >= 1 << (8 * k)).astype(np.int64) for k in (1, 2, 3))
    data = np.append(0, np.cumsum(wide))
    sizes = control + data[upto[1:]] - data[upto[:-1]]
    begin = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    inside = np.arange(len(ranks)) - upto[text]
    for k in range(4):
        at = np.flatnonzero(inside % 4 == k)
        out[begin[text[at]] + inside[at] // 4] |= ((wide[at] - 1) << (2 * k)).astype(np.uint8)
    place = (begin + control - data[upto[:-1]])[text] + data[:-1]
    for k in range(4):
        at = np.flatnonzero(wide > k) if k else slice(None)
        out[place[at] + k] = (ranks[at] >> np.uint32(8 * k)).astype(np.uint8)
    return out, sizes


#: by control byte: the bytes of its four ranks, and where each begins among them
WIDE = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
BEGIN = np.cumsum(WIDE, axis=1) - WIDE
TOTAL = WIDE.sum(axis=1)
MASK = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def unpack(data: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks of consecutive streams."""
    control = (counts + 3) // 4
    begin = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(counts)), control)
    nth = np.arange(len(text)) - (np.cumsum(control) - control)[text]
    byte = data[begin[text] + nth]
    upto = np.append(0, np.cumsum(TOTAL[byte]))
    group = upto[:-1] + (begin + control - upto[np.cumsum(control) - control])[text]
    place, wide = (group[:, None] + BEGIN[byte]).ravel(), WIDE[byte].ravel()
    used = (nth[:, None] * 4 + np.arange(4) < counts[text][:, None]).ravel()
    place, wide = place[used], wide[used]
    padded = np.append(data, np.zeros(3, np.uint8)).astype(np.uint32)
    value = padded[place] | padded[place + 1] << 8
    if (wide > 2).any():
        value |= padded[place + 2] << 16 | padded[place + 3] << 24
    return value & MASK[wide - 1]


# --- blocks


def make_block(part: int, block: int, names: list[str | None], counts: np.ndarray, sizes: np.ndarray, streams: list[bytes]) -> bytes:
    texts = [None if x is None else x.encode() for x in names]
    rows = np.zeros(len(names), [("name", "<i4"), ("ids", "<u4"), ("size", "<u4")])
    rows["name"] = [-1 if x is None else len(x) for x in texts]
    rows["ids"], rows["size"] = counts, sizes
    name_bytes = b"".join(x for x in texts if x)
    head = HEADER.pack(MAGIC, VERSION, part, block, len(names), len(name_bytes), int(counts.sum()), int(sizes.sum()))
    return b"".join([head, rows.tobytes(), name_bytes, *streams, b"\n"])


def headers(content: bytes):
    """(part, block, documents, bytes of names, ids, bytes of streams, place) of each block of a file, the place that of its first row."""
    at = 0
    while at < len(content):
        magic, version, part, block, n, names, ids, streams = HEADER.unpack_from(content, at)
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"no block at byte {at}")
        at += HEADER.size
        yield part, block, n, names, ids, streams, at
        at += 12 * n + names + streams + 1


def _encoded(docs: DataFrame, id_col: str, text: str, tokenizer: str, end: int | None) -> DataFrame:
    """(id, n, ids): the ids of each text as bytes, written."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = encoder_of(tokenizer)
        width = np.dtype("<u4") if end is not None and end >= 1 << 8 * encoder.kind.itemsize else encoder.kind
        for batch in batches:
            data, at = byte_view(batch.column(1))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + TEXTS, side="right")) - 1)
                ids, counts = encoder.encode(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                if end is not None:
                    ids = np.insert(ids.astype(width), np.cumsum(counts), end)
                    counts = counts + 1
                offsets = np.append(0, np.cumsum(counts)) * width.itemsize
                kept = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids.astype(width))])
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), kept], ["id", "n", "ids"])
                lo = hi

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    return cut(rows.mapInArrow(run, f"id {kind}, n long, ids binary"), codec="zstd")


def _ids(counts: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Ids from the bytes of ``_encoded``, whose width follows from their number."""
    n = int(counts.sum())
    return data.view("<u2" if n and len(data) == 2 * n else "<u4")


def _counted(rows: DataFrame) -> DataFrame:
    """(token, n) over (n, ids)."""

    def run(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            data, _ = byte_view(batch.column(1))
            seen = np.bincount(_ids(batch.column(0).to_numpy(), data), minlength=len(total))
            seen[: len(total)] += total
            total = seen
        token = np.flatnonzero(total)
        yield pa.record_batch([pa.array(token, pa.int64()), pa.array(total[token], pa.int64())], ["token", "n"])

    return rows.select("n", "ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, tokenizer: str, end: int | None = END, id_col: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, blocks: int = BLOCKS) -> None:
    """Write the ids of all texts, each followed by ``end``, in ascending order of the ids of their rows.

    ``tokenizer`` is a file of the tokenizers library that all executors can read;
    ``path`` a folder that does not exist, in any store that Spark writes.
    """
    spark = small_batches(docs).sparkSession
    rows = _encoded(docs, id_col, text, tokenizer, end)
    ranks = _counted(rows).withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "token")) - 1)
    ranks.select("rank", "token", "n").coalesce(1).write.parquet(f"{path}/ranks")
    found = spark.read.parquet(f"{path}/ranks").select("token", "rank").toPandas()
    rank_of = np.zeros(int(found["token"].max()) + 1 if len(found) else 1, np.uint32)
    rank_of[found["token"]] = found["rank"]
    shared = spark.sparkContext.broadcast(rank_of)

    def pack_blocks(batches):
        part, block, size = TaskContext.get().partitionId(), 0, 0
        names, counts, sizes, streams = [], [], [], []

        def flush():
            made = make_block(part, block, names, np.concatenate(counts), np.concatenate(sizes), streams)
            return pa.record_batch([pa.array([made[:-1]], pa.binary())], ["block"])

        for batch in batches:
            data, _ = byte_view(batch.column(2))
            n = batch.column(1).to_numpy()
            out, each = pack(shared.value[_ids(n, data)], n)
            upto, raw, name = np.append(0, np.cumsum(each)), out.tobytes(), batch.column(0).to_pylist()
            lo = 0
            while lo < len(n):
                hi = min(len(n), int(np.searchsorted(upto, upto[lo] + block_bytes - size)))
                names += name[lo:hi]
                counts.append(n[lo:hi])
                sizes.append(each[lo:hi])
                streams.append(raw[upto[lo] : upto[hi]])
                size, lo = size + int(upto[hi] - upto[lo]), hi
                if size >= block_bytes:
                    yield flush()
                    block, size = block + 1, 0
                    names, counts, sizes, streams = [], [], [], []
        if names:
            yield flush()

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(rows) // (block_bytes * blocks))
    order = ["id", "tie"]
    moved = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    moved = moved.select(F.col("id").cast("string").alias("name"), "n", "ids").mapInArrow(pack_blocks, "block binary")
    # the text writer puts the bytes of a value as they are, and a line feed after it
    moved.select(F.col("block").cast("string").alias("value")).write.option("maxRecordsPerFile", blocks).text(f"{path}/blocks")

    def numbers(batches):
        for batch in batches:
            for content in batch.column(0):
                found = [x[:2] + (x[4],) for x in headers(content.as_buffer())]
                yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], ["part", "block", "ids"])

    told = _files(spark, path).mapInArrow(numbers, "part long, block long, ids long")
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    told = cut(told, narrow=True)
    parts = told.groupBy("part").agg(F.sum("ids").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    index = told.join(parts, "part").select("part", "block", (F.col("base") + F.coalesce(F.sum("ids").over(inside), F.lit(0))).alias("start"))
    index.write.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/blocks").select("content")


def read(spark: SparkSession, path: str, id_type: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """id, start (ids of all documents before), n_tokens, ids: little-endian uint32 values as bytes."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").select("token").toPandas()["token"].to_numpy()
    shared = spark.sparkContext.broadcast(ranks.astype("<u4"))

    def decode(batches):
        tokens = shared.value
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_buffer()
                for part, block, n, name_bytes, _, streams, at in headers(raw):
                    rows = np.frombuffer(raw, [("name", "<i4"), ("ids", "<u4"), ("size", "<u4")], n, at)
                    at += 12 * n
                    long = np.maximum(rows["name"], 0).astype(np.int32)
                    names = pa.StringArray.from_buffers(n, pa.py_buffer(np.append(0, np.cumsum(long)).astype(np.int32)), pa.py_buffer(raw[at : at + name_bytes]))
                    names = pc.if_else(pa.array(rows["name"] >= 0), names, None)
                    at += name_bytes
                    counts = rows["ids"].astype(np.int64)
                    ids = tokens[unpack(np.frombuffer(raw, np.uint8, streams, at), rows["size"].astype(np.int64), counts)]
                    upto = np.append(0, np.cumsum(counts))
                    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(upto * 4), pa.py_buffer(ids)]).cast(pa.binary())
                    where = [pa.array(np.full(n, x), pa.int64()) for x in (part, block)]
                    yield pa.record_batch([*where, names, pa.array(upto[:-1], pa.int64()), pa.array(counts, pa.int64()), kept], ["part", "block", "name", "before", "n_tokens", "ids"])

    rows = _files(spark, path).mapInArrow(decode, "part long, block long, name string, before long, n_tokens long, ids binary")
    rows = rows.join(spark.read.schema("part long, block long, start long").parquet(f"{path}/index"), ["part", "block"])
    return rows.select(F.col("name").cast(id_type).alias(id_col), (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def digest(docs: DataFrame, path: str, tokenizer: str, end: int | None = END, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, start, n_tokens, ids_crc32 from the files that it writes to ``path``."""
    write(docs, path, tokenizer, end, id_col, text)
    rows = read(docs.sparkSession, path, docs.schema[id_col].dataType.simpleString(), id_col)
    return rows.select(f"`{id_col}`", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
