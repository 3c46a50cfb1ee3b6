"""Token ids in Parquet files, in document order, readable in parts.

Documents are dealt by ranges of their id and tokenised once, in order, and each range is one file
(or a few). A row holds doc_id, the id list, and metadata; where a document starts among all ids is
its place in the file's part plus the part's start, and the parts' starts are a small table beside
the files, so nothing is numbered twice.

The files are ordinary Parquet, written and read by Spark, in any store that Spark reaches:

* ids are dictionary encoded (a vocabulary of 50,000 packs into 16 bits at most), doc_id, place and
  length are delta encoded (version 2 pages), so metadata takes a few bits a row;
* row groups and pages have a set size (``ROW_GROUP_BYTES``, ``PAGE_ROWS``) and carry column and
  offset indexes. As doc_id ascends, a range of ids reads only its row groups' and pages' bytes, and a
  read of metadata alone never touches the id lists.

Encoding splits a text where the tokeniser's own rules cannot join what stands on both sides (see
``unit_starts``), and the tokenizers library encodes every distinct unit once while a worker keeps it: new
units by the hundred in one text, where the same rules cut them apart, and others one by one. Strings of special tokens in a text are
ordinary text.

Null text is empty: it has the end id alone. Order is by doc_id, null first, and rows of one id by
the 64-bit hash of their text, then the text. Repeated rows are documents of their own. Of an empty
table the files are empty. Metadata columns may have any name; they stay under ``meta``.
"""

from __future__ import annotations

import json
import uuid
import zlib
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Texts, byte_strings, split_batch

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 1000
CACHE_UNITS = 600_000
CACHE_IDS = 6_000_000
JOINED = 256  # new units in one text
ENCODED_BYTES = 3 << 20  # of text at once: a unit is looked up once in them

# White space (more than any tokeniser's), by its last byte or code point.
IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
WIDE_BLANKS = np.array([0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
BLANKS = bytes(np.flatnonzero(IS_BLANK).tolist())
JOINTS = b" \n"
IS_JOINT = np.zeros(256, dtype=bool)
IS_JOINT[[*JOINTS]] = True
IS_MARK = np.zeros(256, dtype=bool)
IS_MARK[[*b".,;:!?#*$%&|<>()"]] = True
IS_LETTER = np.zeros(256, dtype=bool)
IS_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def tokenizer_json(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as f:
        return f.read()


def unit_starts(t: Texts) -> np.ndarray:
    """Bytes at which a unit starts: each document's first, a space or line break between characters
    that are no white space, and a mark of punctuation after an ASCII letter. The tokeniser's rules join
    nothing across these."""
    b, n = t.data, len(t.data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    blank = IS_BLANK[b]  # bytes that end a white-space character, and those that start one
    start = blank.copy()
    for last in np.flatnonzero((b == 0x85) | (b == 0xA0)):
        if last and b[last - 1] == 0xC2:
            blank[last] = start[last - 1] = True
    if n > 2:
        lead = np.flatnonzero((b[:-2] >= 0xE1) & (b[:-2] <= 0xE3))
        if len(lead):
            code = (b[lead].astype(np.int64) - 0xE0) << 12 | (b[lead + 1].astype(np.int64) & 0x3F) << 6 | (b[lead + 2] & 0x3F)
            wide = lead[np.isin(code, WIDE_BLANKS)]
            start[wide] = True
            blank[wide + 2] = True
    cut = np.zeros(n, dtype=bool)
    cut[1:-1] = IS_JOINT[b[1:-1]] & ~blank[:-2] & ~start[2:]
    cut[1:] |= IS_MARK[b[1:]] & IS_LETTER[b[:-1]]
    # A document's first and last bytes have no neighbour in another one.
    inner = t.off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    cut[inner - 1] &= ~IS_JOINT[b[inner - 1]]
    cut[t.off[:-1][t.off[:-1] < t.off[1:]]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of texts, unit by unit; units' ids are kept between slices."""

    def __init__(self, spec: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        known = json.loads(spec)
        # A byte-level token has one character for each byte of its text, so ids tell where they lie.
        byte_level = known.get("normalizer") is None and (known.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        vocabulary = self.tokenizer.get_vocab() if byte_level else {}
        self.id_bytes = np.zeros(max(vocabulary.values(), default=-1) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.id_bytes[i] = len(token)
        self.index: dict[bytes, int] = {}
        self.store, self.stored = np.zeros(0, dtype=np.int32), 0
        # Of each unit its ids' first place and number, and the slices it was met in; rows beyond the index are spare.
        self.start = self.size = self.seen = np.zeros(0, dtype=np.int64)

    def shrink(self) -> None:
        """Drop the units that were met in one slice only."""
        keep = np.flatnonzero(self.seen[:len(self.index)] > 1)
        names = list(self.index)
        self.index = {names[i]: k for k, i in enumerate(keep.tolist())}
        size = self.size[keep]
        begin = np.cumsum(size) - size
        self.store = self.store[np.repeat(self.start[keep] - begin, size) + np.arange(int(size.sum()))]
        self.start, self.size, self.seen, self.stored = begin, size, np.zeros(len(keep), dtype=np.int64), len(self.store)

    def joined_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and their numbers of units that each start with a space or line break before other characters and end
        without white space, encoded in texts of many; None if they don't come apart where they should."""
        texts = ["".join(units[k:k + JOINED]) for k in range(0, len(units), JOINED)]
        t = Texts(pa.array(texts, pa.large_string()))
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, units)), dtype=np.int64, count=len(units)))
        cut = np.zeros(len(t.data) + 1, dtype=bool)
        cut[unit_starts(t)] = True
        if not cut[ends[:-1]].all():
            return None
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate([np.array(x, dtype=np.int32) for x in ids])
        if flat.max(initial=-1) >= len(self.id_bytes):
            return None
        upto = np.cumsum(self.id_bytes[flat])
        last = np.searchsorted(upto, ends)
        if not len(upto) or last[-1] != len(upto) - 1 or not np.array_equal(upto[last], ends):
            return None
        return flat, np.diff(last, prepend=-1)

    def single_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(size.sum())), size

    def add(self, units: list[bytes], flat: np.ndarray, size: np.ndarray) -> None:
        old, n = len(self.index), len(self.index) + len(units)
        if n > len(self.start):
            self.start, self.size, self.seen = (np.append(v, np.zeros(2 * n - len(v), dtype=np.int64)) for v in (self.start, self.size, self.seen))
        if self.stored + len(flat) > len(self.store):
            self.store = np.append(self.store[:self.stored], np.zeros(self.stored + 2 * len(flat), dtype=np.int32))
        self.start[old:n], self.size[old:n], self.seen[old:n] = self.stored + np.cumsum(size) - size, size, 0
        self.store[self.stored:self.stored + len(flat)] = flat
        self.stored += len(flat)
        self.index.update(zip(units, range(old, n)))

    def learn(self, units: list[bytes]) -> np.ndarray:
        """Encodes new units; their numbers."""
        # White space and its like beyond ASCII goes by the characters.
        fit = np.zeros(len(units), dtype=bool)
        if len(self.id_bytes):
            fit[:] = [len(u) > 1 and u[0] in JOINTS and (u.strip(BLANKS) == u[1:] if u[1] < 0x80 > u[-1] else (x := u.decode()).strip() == x[1:])
                      for u in units]
        joint, first = list(compress(units, fit.tolist())), len(self.index)
        found = self.joined_ids([u.decode() for u in joint]) if joint else None
        if found is None:
            joint, fit[:] = [], False
        else:
            self.add(joint, *found)
        if len(joint) < len(units):
            alone = list(compress(units, (~fit).tolist()))
            self.add(alone, *self.single_ids([u.decode() for u in alone]))
        return first + np.where(fit, np.cumsum(fit) - 1, len(joint) + np.cumsum(~fit) - 1)

    def encode(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and offsets (n + 1); ``end`` closes each."""
        t = Texts(column)
        starts = unit_starts(t)
        # Units lie side by side and cover the texts.
        spans = pa.py_buffer(np.append(starts, len(t.data)))
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, spans, pa.py_buffer(t.data)]).dictionary_encode()
        which, units, index = found.indices.to_numpy(), byte_strings(found.dictionary), self.index
        code = np.fromiter(map(index.get, units, repeat(-1)), dtype=np.int64, count=len(units))
        missing = np.flatnonzero(code < 0)
        if len(missing):
            code[missing] = self.learn([units[i] for i in missing.tolist()])
        self.seen[code] += 1
        start, size = self.start[code][which], self.size[code][which]
        total = np.append(0, np.cumsum(size))
        flat = self.store[np.repeat(start - total[:-1], size) + np.arange(total[-1])]
        per_doc = np.diff(total[np.searchsorted(starts, t.off)])
        if end is not None:
            flat = np.insert(flat, np.cumsum(per_doc), end)
            per_doc = per_doc + 1
        if len(self.index) > CACHE_UNITS or self.stored > CACHE_IDS:
            self.shrink()
        return flat.astype(np.int32, copy=False), np.append(0, np.cumsum(per_doc))


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str, held) -> Encoder:
    """The worker's encoder for a broadcast tokeniser, built once."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(held.value)
    return _ENCODERS[name]


def write(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = (),
          tokenizer: str | None = None, end: int | None = END_ID, row_group_bytes: int = ROW_GROUP_BYTES,
          page_rows: int = PAGE_ROWS) -> None:
    """Writes ``path``/tokens (part, place, doc_id, n_tokens, ids, meta) and ``path``/parts."""
    spark = documents.sparkSession
    held, name = spark.sparkContext.broadcast(tokenizer_json(tokenizer)), uuid.uuid4().hex
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"),
                            F.coalesce(F.col(text), F.lit("")).alias("text"),
                            F.struct(*[F.col(f"`{c}`") for c in metadata] or [F.lit(None).cast("string").alias("none")]).alias("meta"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    meta = rows.schema["meta"].dataType
    schema = (T.StructType().add("part", T.IntegerType()).add("place", T.LongType()).add("doc_id", T.LongType())
              .add("n_tokens", T.LongType()).add("ids", T.ArrayType(T.IntegerType())).add("meta", meta))

    def run(batches):
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in split_batch(batch, "text", ENCODED_BYTES):
                ids, off = encoder(name, held).encode(piece.column(2), end)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(piece.num_rows, part, dtype=np.int32)), pa.array(place + off[:-1]), piece.column(0),
                     pa.array(np.diff(off)), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids)), piece.column(3)],
                    ["part", "place", "doc_id", "n_tokens", "ids", "meta"])
                place += int(off[-1])

    (dealt.mapInArrow(run, schema).write.option("compression", "zstd")
     .option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "true")
     .option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#place", "false")
     .option("parquet.enable.dictionary#n_tokens", "false")
     .option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size", str(PAGE_BYTES))
     .option("parquet.page.row.count.limit", str(page_rows)).parquet(f"{path}/tokens"))
    # One row per written range.
    sums = (spark.read.schema(schema).parquet(f"{path}/tokens").groupBy("part")
            .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("first_id"),
                 F.max("doc_id").alias("last_id")).orderBy("part").collect())
    parts, start = [], 0
    for r in sums:
        parts.append((r["part"], start, r["n_docs"], r["n_tokens"], r["first_id"], r["last_id"]))
        start += r["n_tokens"]
    (spark.createDataFrame(parts, "part int, part_start long, n_docs long, n_tokens long, first_id long, last_id long")
     .coalesce(1).write.parquet(f"{path}/parts"))


def read(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids"),
         first: int | None = None, last: int | None = None) -> DataFrame:
    """Some columns (doc_id, start, n_tokens, ids, meta) of the documents with ids from ``first`` to
    ``last``; only those columns' pages in that range are read."""
    found = spark.read.parquet(f"{path}/tokens")
    if first is not None:
        found = found.filter(F.col("doc_id") >= first)
    if last is not None:
        found = found.filter(F.col("doc_id") <= last)
    if "start" in columns:
        starts = spark.read.parquet(f"{path}/parts").select("part", "part_start")
        found = found.join(F.broadcast(starts), "part").withColumn("start", F.col("part_start") + F.col("place"))
    return found.select(*columns)


def with_checksum(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian 32-bit numbers."""
    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            values = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<u4")).cast("B")
            off = ids.offsets.to_numpy().tolist()
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(3)], pa.array([zlib.crc32(values[4 * a:4 * b]) for a, b in zip(off, off[1:])], pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
