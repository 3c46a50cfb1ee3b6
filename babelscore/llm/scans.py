"""Running totals along an order, for groups of any size.

A window over a group sends the whole group to one task. Here rows are dealt by ranges of (group,
order), so a large group lies in several tasks; each task scans its own range in Arrow batches, and
what the tasks before it hold of its first group is composed in front afterwards. A scanned value is
an element of a monoid: the place of a row with, per lane,

* a plain sum, or
* a fingerprint: sum of value * base^place modulo ``PRIME``. (n, f) followed by (m, g) is
  (n + m, f + base^n * g), so a piece's fingerprint does not depend on what stands before it.

One row per range reaches the driver, for the offsets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

PRIME = (1 << 31) - 1
BLOCK = 1 << 16
_TABLES: dict[int, list[np.ndarray]] = {}


def powers(base: int, exponent: np.ndarray) -> np.ndarray:
    """base^exponent modulo PRIME, from two tables."""
    if base not in _TABLES:
        low = np.ones(BLOCK, dtype=np.uint64)
        for i in range(16):  # doubling
            low[1 << i:2 << i] = low[:1 << i] * np.uint64(pow(base, 1 << i, PRIME)) % np.uint64(PRIME)
        _TABLES[base] = [low, np.ones(1, dtype=np.uint64)]
    low, high = _TABLES[base]
    most = int(exponent.max(initial=0)) >> 16
    while len(high) <= most:
        high = np.concatenate([high, high * np.uint64(pow(base, len(high) << 16, PRIME)) % np.uint64(PRIME)])
    _TABLES[base][1] = high
    return low[exponent & (BLOCK - 1)] * high[exponent >> 16] % np.uint64(PRIME)


def scan_batch(group: np.ndarray, values: list[np.ndarray], bases: list[int | None], state):
    """Places, and per lane the totals before and up to each row. state: what the batches before
    hold of their last group (group, count, totals)."""
    n = len(group)
    new = np.ones(n, dtype=bool)
    new[1:] = group[1:] != group[:-1]
    begin = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    goes_on = state is not None and state[0] == int(group[0])
    place = np.arange(n) - begin[run] + 1
    if goes_on:
        place[run == 0] += state[1]
    before, upto = [], []
    for k, (v, base) in enumerate(zip(values, bases)):
        term = v.astype(np.int64) if base is None else (v.astype(np.uint64) * powers(base, place) % np.uint64(PRIME)).astype(np.int64)
        total = np.cumsum(term)
        inside = total - term
        b = inside - inside[begin][run]
        if goes_on:
            b[run == 0] += state[2][k]
        u = b + term
        before.append(b if base is None else b % PRIME)
        upto.append(u if base is None else u % PRIME)
    return place, before, upto, (int(group[-1]), int(place[-1]), [int(u[-1]) for u in upto])


def running(rows: DataFrame, group: str, order: list[str], lanes: dict[str, int | None], name: str,
            deal: list[Column] | None = None) -> DataFrame:
    """Adds ``place`` (1, 2, ... in each group along ``order``) and for every lane the total up to
    the row (``lane``, replacing the value) and before it (``lane_before``). lanes: column to base,
    None for a plain sum. ``group`` is a long without nulls, lane values are longs in [0, PRIME) for
    fingerprints. ``deal``: what the ranges are cut by in place of ``order``, where that is long; it never
    falls along ``order``. The result is a written table."""
    keep = [c for c in rows.columns if c not in lanes]
    names, bases = list(lanes), list(lanes.values())
    extra = ["part", "place", *names, *[f"{c}_before" for c in names]]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["part int"] + [f"`{c}` long" for c in extra[1:]])
    dealt = rows.repartitionByRange(group, *(deal or order)).sortWithinPartitions(group, *order)

    def run(batches):
        part, state = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            place, before, upto, state = scan_batch(get[group].to_numpy(), [get[c].to_numpy() for c in names], bases, state)
            yield pa.RecordBatch.from_arrays(
                [*[get[c] for c in keep], pa.array(np.full(batch.num_rows, part, dtype=np.int32)),
                 *[pa.array(x) for x in (place, *upto, *before)]], [*keep, *extra])

    done = materialise(dealt.mapInArrow(run, schema), name)
    # The first group of each range, and its last with the totals there.
    ends = done.groupBy("part").agg(F.min(group).alias("first"), F.max(F.struct(group, "place", *names)).alias("last")).collect()
    offsets, held = [], None
    for r in sorted(ends, key=lambda r: r["part"]):
        last = [r["last"][i] for i in range(2 + len(names))]
        if held is not None and held[0] == r["first"]:
            shift = [1 if b is None else pow(b, held[1], PRIME) for b in bases]
            offsets.append((r["part"], r["first"], held[1], *held[2:], *shift))
            if last[0] == held[0]:
                last = [last[0], last[1] + held[1],
                        *[(h + x) if b is None else (h + s * x) % PRIME for h, x, s, b in zip(held[2:], last[2:], shift, bases)]]
        held = last
    if not offsets:
        return done.drop("part")
    spec = "part int, __group long, __n long" + "".join(f", __f{k} long" for k in range(len(names))) + \
        "".join(f", __s{k} long" for k in range(len(names)))
    # One row per range at most.
    joined = done.join(F.broadcast(rows.sparkSession.createDataFrame(offsets, spec)), "part", "left")
    mine = F.col("__group") == F.col(group)

    def composed(c: str, k: int) -> Column:
        if bases[k] is None:
            whole = F.col(f"__f{k}") + F.col(c)
        else:
            whole = (F.col(f"__f{k}") + F.col(c) * F.col(f"__s{k}") % PRIME) % PRIME
        return F.when(mine, whole).otherwise(F.col(c)).alias(c)

    return joined.select(*[F.col(f"`{c}`") for c in keep], F.when(mine, F.col("place") + F.col("__n")).otherwise(F.col("place")).alias("place"),
                         *[composed(c, k) for k, c in enumerate(names)], *[composed(f"{c}_before", k) for k, c in enumerate(names)])


def block_of(place: str) -> Column:
    """The stretch of places that a row of a large group is dealt by."""
    return (F.col(place) / F.lit(BLOCK)).cast("long").alias("block")


def per_block(rows: DataFrame, most: str) -> DataFrame:
    """One row per group to one per group and block of places 0 to ``most``: the other side of a join
    on (group, block), which splits a hot group."""
    return rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (F.col(most) / F.lit(BLOCK)).cast("long"))))


def same_runs(columns: list[np.ndarray]) -> np.ndarray:
    """First rows of runs of equal keys in sorted columns."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def streamed_groups(batches, keys: list[str]):
    """(key, batch, first row, end) of sorted batches; a group that goes on in the next batch comes in pieces."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = same_runs([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys])
        firsts = zip(*[batch.column(batch.schema.get_field_index(k)).take(pa.array(at)).to_pylist() for k in keys])
        for key, s, e in zip(firsts, at.tolist(), [*at[1:].tolist(), batch.num_rows]):
            yield key, batch, s, e
