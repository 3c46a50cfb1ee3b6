"""Vectorised text primitives shared by the operators of this folder.

Texts reach a Python worker as Arrow batches. They are worked on as one flat byte array with
document offsets, in slices of a MB, so memory in a task is bounded by the slice size (or by
one document, where a document is larger).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

SLICE_BYTES = 1 << 20

# Word separators: space and \x09-\x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# Bytes that continue a UTF-8 character; every other byte starts a code point.
IS_LEAD = np.ones(256, dtype=bool)
IS_LEAD[0x80:0xC0] = False

_RNG = np.random.default_rng(20240229)
_BYTE_HASH = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, 2 * SLICE_BYTES), base, dtype=np.uint64)
        grown[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(grown)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (in place on a fresh array)."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def split_batch(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES):
    """Row slices of a batch whose texts hold about ``limit`` bytes (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


class Texts:
    """A slice of texts as bytes: ``data`` (uint8) and ``off`` (document offsets, n + 1)."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column, "").cast(pa.large_binary())
        _, offsets, values = column.buffers()
        self.n = len(column)
        off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + self.n + 1] if self.n \
            else np.zeros(1, dtype=np.int64)
        whole = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
        self.data = whole[off[0]:off[-1]]
        self.off = off - off[0]

    def per_doc(self, marks: np.ndarray) -> np.ndarray:
        """Sums of a per-byte (or bool) array over each document."""
        total = np.zeros(len(marks) + 1, dtype=np.int64)
        np.cumsum(marks, out=total[1:])
        return total[self.off[1:]] - total[self.off[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and the index of each document's first word (n + 1)."""
        return self.pieces(IS_SPACE[self.data])

    def pieces(self, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs without a gap byte, never across documents."""
        solid = ~gap
        begin = solid.copy()
        begin[1:] &= gap[:-1]
        end = solid.copy()
        end[:-1] &= gap[1:]
        first = self.off[:-1][self.off[:-1] < self.off[1:]]  # first bytes of non-empty documents
        last = self.off[1:][self.off[:-1] < self.off[1:]] - 1
        begin[first] = solid[first]
        end[last] = solid[last]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        return starts, ends, np.searchsorted(starts, self.off)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of every byte span, equal for equal bytes wherever they stand."""
        n = len(self.data)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_HASH[self.data] * _powers(_BASE, n), out=total[1:])
        h = (total[ends] - total[starts]) * _powers(_INVERSE, n + 1)[starts]
        return mix(h + (ends - starts).astype(np.uint64))

    def chars_before(self) -> np.ndarray:
        """Code points before each byte offset (length + 1)."""
        total = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(IS_LEAD[self.data], out=total[1:])
        return total


def window_hashes(h: np.ndarray, k: int, multiplier: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of k consecutive values of a flat array (documents not yet separated)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    m = np.uint64(multiplier)
    for i in range(k):
        out *= m
        out += h[i:i + n]
    return mix(out)


def window_mask(first: np.ndarray, total: int, k: int) -> np.ndarray:
    """Which runs of k words lie inside one document (first: index of each document's first word)."""
    at = np.arange(max(total - k + 1, 0))
    return at + k <= first[np.searchsorted(first, at, side="right")] if len(at) else at.astype(bool)


def doc_key(column: str):
    """A document id as a number to order and join by; a null id sorts first."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(1 << 63)))


def map_texts(df: DataFrame, fn, schema: str | T.StructType, text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """``fn`` over slices of Arrow batches; ``fn`` returns a RecordBatch of ``schema`` or None."""
    def run(batches):
        for batch in batches:
            for part in split_batch(batch, text, limit):
                out = fn(part)
                if out is not None:
                    yield out
    return df.mapInArrow(run, schema)


def hash_sample(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """The ``size`` rows that come first by a hash of ``keys``, the same at any partitioning (all of a
    smaller table). A share of the hash range that holds about twice as many is cut out first, so a task
    ranks and sends only its part of the sample, however many tasks there are; where keys repeat so much
    that the share holds too few rows, it grows."""
    n, span = df.count(), 1 << 52
    share = span if n <= size else min(span, max(1, 2 * size * span // n))
    key = F.pmod(F.xxhash64(*keys), F.lit(span))
    while share < span and df.filter(key < share).limit(size).count() < size:
        share = min(span, 8 * share)
    return df.filter(key < share).orderBy(key, *keys).limit(size)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fixed(column, dtype, width: int) -> np.ndarray:
    """A binary column of equal-length values as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros((0, width), dtype=dtype)
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)[off[0]:off[-1]]
    return np.ascontiguousarray(raw).view(dtype).reshape(len(column), width)


def byte_strings(column: pa.Array) -> list[bytes]:
    """The values of a large binary column without nulls; about four times as fast as its own list."""
    if not len(column):
        return []
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw, off = column.buffers()[2][off[0]:off[-1]].to_pybytes(), (off - off[0]).tolist()
    return [raw[a:b] for a, b in zip(off, off[1:])]


def to_binary(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column."""
    n, width = matrix.shape[0], matrix.shape[1] * matrix.itemsize
    off = pa.array((np.arange(n + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, off.buffers()[1], pa.py_buffer(np.ascontiguousarray(matrix).tobytes())])


def whole_groups(batches, keys: list[str]):
    """From batches sorted by ``keys``: tables in which every group of equal keys is complete, with
    the groups' first rows (n + 1)."""
    held = None

    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[:1] = True
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        table = table.combine_chunks()
        at = bounds(table)
        if len(at) > 2:
            yield table.slice(0, at[-2]), at[:-1]
        held = table.slice(at[-2])
    if held is not None:
        yield held, bounds(held)


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph (columns u, v): node, root (the smallest node).

    Alternating large-star and small-star rounds (Kiveris et al., 2014) on tables in the shared
    checkpoint folder; only a round's row count and checksum reach the driver. Nodes without an edge
    do not appear."""
    def checked(df: DataFrame) -> tuple[DataFrame, tuple]:
        kept = materialise(df, name)
        r = kept.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        return kept, tuple(r)

    def star(pairs: DataFrame) -> DataFrame:
        """Of pairs (u, neighbour): every neighbour, with the smallest of u and its neighbours. A centre's
        pairs meet one row, so adaptive execution can split a large centre's side of the join."""
        low = pairs.groupBy("u").agg(F.min("v").alias("low"))
        return pairs.join(low.withColumn("low", F.least("u", "low")), "u")

    now, mark = checked(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")).toDF("u", "v"))
        large = star(both).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.filter("u != v")  # repeated pairs end with the round
        small = star(large)  # v < u here, so u's own row is added
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("low").alias("y")),
                                               F.struct(F.col("v").alias("x"), F.col("low").alias("y")))).alias("e"))
        small = small.select(F.col("e.x").alias("u"), F.col("e.y").alias("v")).filter("u != v").distinct()
        now, new = checked(small)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"{name}: components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
