"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of shingles of five words (a shorter document is one shingle); two are linked if
the sets' Jaccard similarity is 0.8 or more.

1. One pass gives each document a 128-bit digest of its word sequence and a MinHash signature.
   Documents with equal digests are one class; a class is compared once, through one member.
2. Signatures are cut into bands; classes that agree on a band are candidates. Pairs are looked at in
   memory, never written out.
3. A candidate pair's MinHash values are compared 16 at a time. With a uniform prior, the similarity
   after n comparisons with m equal has a Beta posterior; when its probability of reaching 0.8 falls
   below ``TOLERANCE`` the pair is dropped. Pairs that survive join classes into families (connected
   components).
4. Inside a family the pairs are compared again in blocks, now exactly: the same pruning, then the
   intersection of the shingle sets (a product of incidence matrices over shared shingles). Links
   are summed per class and their components form the groups.

A group (a band value, a family) of more than ``BLOCK`` classes is compared with a pivot first, which
moves each row once:

* a band value's pivot is one of its classes; two that both survive against it are in one family with
  it, so they need no look at each other;
* a family's pivot is the set of the shingles that over half of it have. With d the size of the symmetric
  difference to it, two sets of which each has 9 d <= its size differ by at most a ninth of their sizes
  together (the triangle inequality), which is a similarity of 0.8: all of them are linked, and are
  counted without a comparison.

Only what is far from the pivot is cut into blocks of ``BLOCK`` and meets everything else, a pair of
blocks to a task. A family of any number of near copies thus moves in proportion to its size; one
without a centre (a chain of ever new versions) still meets in blocks.

With 32 bands of 4 values a pair of similarity 0.8 misses all bands with probability 5e-8, and the
pruning loses it with a probability of the order of ``TOLERANCE``; nothing is capped or sampled.

Result: doc_id, class_id (the smallest document id of the group) and n_links (other documents at 0.8
or more, equal ones included). Null text and text without words have no links and their own id as
class. Repeated rows are copies of each other. A null id takes part; it sorts before all others.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (Texts, components, doc_key, fixed, map_texts, materialise, mix, to_binary, whole_groups,
                     window_hashes, window_mask)

WORDS = 5
HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
STEP = 16
TOLERANCE = 1e-6
BLOCK = 512  # classes compared with each other at once
PAIRS = 1 << 18  # pairs in memory at once
# The threshold as a fraction, so that verification is exact: 0.8 = 4 / 5.
TOP, BOTTOM = 4, 5

_RNG = np.random.default_rng(815)
_FLIP = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)
_TIMES = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)


def least_matches(tolerance: float = TOLERANCE, threshold: float = TOP / BOTTOM) -> list[int]:
    """For 16, 32, ... comparisons: the fewest matches with which a pair stays in play. The posterior
    of the similarity after m of n matches is Beta(m + 1, n - m + 1); its mass above the threshold is
    the chance that a binomial (n + 1, threshold) is at most m."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold)**(n + 1 - m)
        out.append(m)
    return out


def shingles(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes by document, their first index per document (n + 1), and two hashes of each
    document's word sequence."""
    starts, ends, first = t.words()
    h = t.hashes(starts, ends)
    n = np.diff(first)
    doc = np.repeat(np.arange(t.n), n)
    at = np.flatnonzero(window_mask(first, len(h), WORDS))
    value, owner = window_hashes(h, WORDS)[at], doc[at]
    # Sequence hashes: sums of word hashes keyed by their place.
    place = (np.arange(len(h)) - np.repeat(first[:-1], n)).astype(np.uint64)
    digest = np.zeros((t.n, 2), dtype=np.uint64)
    some = np.flatnonzero(n)
    for k, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        keyed = mix(h ^ mix(place * np.uint64(salt) + np.uint64(salt)))
        if len(some):
            digest[some, k] = np.add.reduceat(keyed, first[:-1][some]) + n[some].astype(np.uint64)
    short = np.flatnonzero((n > 0) & (n < WORDS))  # one shingle: the whole text
    value, owner = np.concatenate([value, digest[short, 0]]), np.concatenate([owner, short])
    order = np.argsort(owner, kind="stable")
    value, owner = value[order], owner[order]
    return value, np.searchsorted(owner, np.arange(t.n + 1)), digest, n


def signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash signatures (low 16 bits of each minimum); zero for documents without shingles."""
    out = np.zeros((len(first) - 1, HASHES), dtype=np.uint16)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        x = (value >> np.uint64(32)).astype(np.uint32)
        at = first[:-1][some]
        for k in range(HASHES):
            out[some, k] = np.minimum.reduceat((x ^ _FLIP[k]) * _TIMES[k], at) & np.uint32(0xFFFF)
    return out


def prune(left: np.ndarray, right: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs of signature rows survive the incremental comparison (as indices)."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), dtype=np.int64)
    for k, m in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= m]
    return alive


def pairs_in(at: np.ndarray, block: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Row pairs to compare in every group, about ``PAIRS`` at a time: all pairs of one block, or all
    pairs between two."""
    held_a, held_b, size = [], [], 0
    for s, e in zip(at.tolist(), at[1:].tolist()):
        if low[s] == high[s]:
            rows = np.arange(s, e)
            cuts = [(rows[i:i + 1], rows[i + 1:]) for i in range(e - s - 1)] if e - s > 256 else []
            if not cuts:
                a, b = np.triu_indices(e - s, 1)
                held_a.append(a + s)
                held_b.append(b + s)
                size += len(a)
        else:
            mine = block[s:e] == low[s]
            rows, other = s + np.flatnonzero(mine), s + np.flatnonzero(~mine)
            cuts = [(rows[i:i + 1], other) for i in range(len(rows))]
        for a, b in cuts:
            held_a.append(np.repeat(a, len(b)))
            held_b.append(np.tile(b, len(a)))
            size += len(b)
            if size >= PAIRS:
                yield np.concatenate(held_a), np.concatenate(held_b)
                held_a, held_b, size = [], [], 0
        if size >= PAIRS:
            yield np.concatenate(held_a), np.concatenate(held_b)
            held_a, held_b, size = [], [], 0
    if size:
        yield np.concatenate(held_a), np.concatenate(held_b)


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give rows that pairs connect one label, the smallest row of all they reach (in place). ``label``
    holds each row's root, a row that is its own label; earlier calls' links stay."""
    while len(a):
        u, v = label[a], label[b]
        differ = u != v
        a, b, u, v = a[differ], b[differ], u[differ], v[differ]
        if not len(a):
            break
        # The roots are lowered, not the rows, so all that hangs on a root follows it.
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def blocked(df: DataFrame, key: list[str], of: str, block: int) -> DataFrame:
    """Rows with ``grp``, ``lo``, ``hi`` and ``blk``, from rows with ``far``, ``n_far`` and ``n_near``: far
    rows are cut into blocks by a hash of ``of`` and go to every pair of blocks with their own in it, near
    rows to every pair with a far block. Near rows do not meet."""
    far_blocks = F.ceil(F.col("n_far") / F.lit(block)).cast("int")
    near_blocks = F.ceil(F.col("n_near") / F.lit(block)).cast("int")

    def mine(blocks):
        return F.pmod(F.xxhash64(of), F.greatest(blocks, F.lit(1))).cast("int")
    cut = df.filter("n_far > 0").withColumn("blk", F.when(F.col("far"), mine(far_blocks)).otherwise(far_blocks + mine(near_blocks)))
    last = F.when(F.col("far"), far_blocks + near_blocks).otherwise(far_blocks) - 1
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return cut.select(F.xxhash64(*key).alias("grp"), F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk",
                      *[c for c in df.columns if c not in (*key, "far", "n_far", "n_near")])


def all_far(df: DataFrame, size: str) -> DataFrame:
    """Rows of groups that fit one block."""
    return df.select("*", F.lit(True).alias("far"), F.col(size).alias("n_far"), F.lit(0).cast("long").alias("n_near")).drop(size)


def with_counts(judged: DataFrame, key: list[str]) -> DataFrame:
    """Rows with ``far`` of the groups that have a far row, with how many of either they have."""
    counts = judged.groupBy(*key).agg(F.sum(F.col("far").cast("long")).alias("n_far"), F.sum((~F.col("far")).cast("long")).alias("n_near"))
    return judged.join(counts.filter("n_far > 0"), key)


def together(df: DataFrame) -> DataFrame:
    """Rows of one group and pair of blocks in one partition, next to each other."""
    return df.repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi")


def classes(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, tie (tells rows with the same id apart), cls (null without words), sig: written once, read
    for classes and for membership."""
    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        value, first, digest, n = shingles(Texts(part.column(2)))
        cls = to_binary(digest)
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array([c if k else None for c, k in zip(cls.to_pylist(), n.tolist())], pa.binary()),
             to_binary(signatures(value, first))], ["doc", "tie", "cls", "sig"])
    rows = documents.select(doc_key(doc_id).alias("doc"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    return map_texts(rows, fn, "doc long, tie long, cls binary, sig binary")


def band_values(reps: DataFrame) -> DataFrame:
    """cls, band, value: one row per class and band."""
    def run(batches):
        for batch in batches:
            values = fixed(batch.column(1), np.uint64, BANDS)  # four 16-bit values are a band
            n = len(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(n), BANDS))),
                 pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(values.reshape(-1).view(np.int64))],
                ["cls", "band", "value"])
    return reps.select("cls", "sig").mapInArrow(run, "cls binary, band int, value long")


def family_edges(candidates: DataFrame) -> DataFrame:
    """u, v: each class and the first class of its group that surviving pairs connect it to."""
    least = least_matches()

    def run(batches):
        for table, at in whole_groups(batches, ["grp", "lo", "hi"]):
            sig = fixed(table.column("sig"), np.uint16, HASHES)
            bands = sig.view(np.uint64)
            band = table.column("band").to_numpy()
            label = np.arange(table.num_rows)
            for a, b in pairs_in(at, *(table.column(c).to_numpy() for c in ("blk", "lo", "hi"))):
                # A pair that agrees on an earlier band is judged there.
                earlier = (bands[a] == bands[b]) & (np.arange(BANDS) < band[a][:, None])
                new = ~earlier.any(axis=1)
                a, b = a[new], b[new]
                alive = prune(sig[a], sig[b], least)
                join_labels(label, a[alive], b[alive])
            moved = np.flatnonzero(label != np.arange(len(label)))
            cls = table.column("cls").combine_chunks()
            yield pa.RecordBatch.from_arrays([cls.take(pa.array(moved)), cls.take(pa.array(label[moved]))], ["u", "v"])
    return together(candidates).mapInArrow(run, "u binary, v binary")


def against_pivots(rows: DataFrame) -> DataFrame:
    """band, value, cls, sig, pivot, far: whether the comparison with the pivot's signature drops the class."""
    least = least_matches()
    names = ["band", "value", "cls", "sig", "pivot", "far"]

    def run(batches):
        for batch in batches:
            sig, pivot = (fixed(batch.column(batch.schema.get_field_index(c)), np.uint16, HASHES) for c in ("sig", "pivot_sig"))
            far = np.ones(batch.num_rows, dtype=bool)
            far[prune(sig, pivot, least)] = False
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names[:-1]], pa.array(far)], names)
    return rows.select("band", "value", "cls", "sig", "pivot", "pivot_sig").mapInArrow(
        run, "band int, value long, cls binary, sig binary, pivot binary, far boolean")


def all_family_edges(reps: DataFrame, block: int) -> DataFrame:
    """u, v: what connects classes to families, from all band values that classes share."""
    values, signed = band_values(reps), reps.select("cls", "sig")
    shared = materialise(values.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "jaccard-bands")
    small = all_far(values.join(shared.filter(F.col("n") <= block), ["band", "value"]).join(signed, "cls"), "n")
    small = small.withColumn("band_key", F.col("band"))
    if (shared.agg(F.max("n")).first()[0] or 0) <= block:  # nothing else to look at
        return family_edges(blocked(small, ["band_key", "value"], "cls", block))
    large = values.join(shared.filter(F.col("n") > block).select("band", "value"), ["band", "value"])
    pivots = large.groupBy("band", "value").agg(F.min("cls").alias("pivot")).join(
        reps.select(F.col("cls").alias("pivot"), F.col("sig").alias("pivot_sig")), "pivot")
    judged = materialise(against_pivots(large.join(pivots, ["band", "value"]).join(signed, "cls")), "jaccard-pivots")
    far = with_counts(judged.drop("pivot"), ["band", "value"]).withColumn("band_key", F.col("band"))
    meet = blocked(small, ["band_key", "value"], "cls", block).unionByName(blocked(far, ["band_key", "value"], "cls", block))
    near = judged.filter("not far and cls != pivot").select(F.col("cls").alias("u"), F.col("pivot").alias("v"))
    return family_edges(meet).unionByName(near)


def incidence_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products over the shingles that two sets share."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    use = shared[column]
    column, owner = number[column[use]], owner[use]
    out = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 4096
    for c in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [c, c + width])
        x = np.zeros((n, width), dtype=np.float32)
        x[owner[a:b], column[a:b] - c] = 1
        out += x @ x.T
    return out.astype(np.int64)


def verified(members: DataFrame) -> DataFrame:
    """cls, links (documents of other classes linked to it) and root, within each block pair."""
    least = least_matches()

    def run(batches):
        for table, at in whole_groups(batches, ["grp", "lo", "hi"]):
            sig = fixed(table.column("sig"), np.uint16, HASHES)
            sets = [np.frombuffer(s, dtype=np.uint64) for s in table.column("shingles").to_pylist()]
            size = np.array([len(s) for s in sets])
            copies = table.column("n_copies").to_numpy()
            blk, lo, hi = (table.column(c).to_numpy() for c in ("blk", "lo", "hi"))
            links = np.zeros(table.num_rows, dtype=np.int64)
            label = np.arange(table.num_rows)
            for s, e in zip(at.tolist(), at[1:].tolist()):
                both, own = None, np.arange(e - s)
                for a, b in pairs_in(np.array([0, e - s]), blk[s:e], lo[s:e], hi[s:e]):
                    alive = prune(sig[s + a], sig[s + b], least)
                    a, b = a[alive], b[alive]
                    if not len(a):
                        continue
                    if both is None:
                        both = incidence_counts(sets[s:e])
                    inter = both[a, b]
                    near = (TOP + BOTTOM) * inter >= TOP * (size[s + a] + size[s + b])
                    a, b = a[near], b[near]
                    np.add.at(links, s + a, copies[s + b])
                    np.add.at(links, s + b, copies[s + a])
                    join_labels(own, a, b)
                label[s:e] = s + own
            cls = table.column("cls").combine_chunks()
            yield pa.RecordBatch.from_arrays([cls, pa.array(links), cls.take(pa.array(label))], ["cls", "links", "root"])
    return together(members).mapInArrow(run, "cls binary, links long, root binary")


def with_shingles(documents: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The wanted classes (columns doc, cls and others) with their distinct shingles."""
    rows = documents.select(doc_key(doc_id).alias("doc"), F.col(text).alias("text"))
    joined = wanted.join(rows, "doc")
    names = [f for f in joined.schema.fields if f.name != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names) + ", shingles binary, same boolean"

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        get = {n: part.column(i) for i, n in enumerate(part.schema.names)}
        value, first, digest, _ = shingles(Texts(get["text"]))
        # Several rows may have the id: only those with the class's own words count.
        same = [a == b for a, b in zip(get["cls"].to_pylist(), to_binary(digest).to_pylist())]
        sets = [np.unique(value[a:b]).tobytes() for a, b in zip(first, first[1:])]
        return pa.RecordBatch.from_arrays([get[f.name] for f in names] + [pa.array(sets, pa.binary()), pa.array(same)],
                                          [f.name for f in names] + ["shingles", "same"])
    return map_texts(joined, fn, schema).filter("same").dropDuplicates(["cls"]).drop("same", "doc")


def centres(members: DataFrame) -> DataFrame:
    """root and pivot_shingles: what over half of a family have, so at most twice their mean size."""
    def counts(batches):
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            of = get["root"].dictionary_encode()
            which = of.indices.to_numpy()
            sets = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in get["shingles"]]
            for k, root in enumerate(of.dictionary):
                value, n = np.unique(np.concatenate([sets[i] for i in np.flatnonzero(which == k)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([root.as_py()] * len(value), pa.binary()), pa.array(value.view(np.int64)), pa.array(n)],
                                                 ["root", "value", "c"])

    def packed(batches):
        for batch in batches:
            sets = [np.sort(np.array(v, dtype=np.int64).view(np.uint64)).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["root", "pivot_shingles"])
    common = (members.select("root", "shingles").mapInArrow(counts, "root binary, value long, c long").groupBy("root", "value").agg(F.sum("c").alias("c"))
              .join(members.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root").filter("2 * c > n"))
    return common.groupBy("root").agg(F.collect_list("value").alias("v")).mapInArrow(packed, "root binary, pivot_shingles binary")


def differing(rows: DataFrame) -> DataFrame:
    """The rows with ``far``: whether nine times the symmetric difference to the pivot's set is over the own size."""
    names = [f.name for f in rows.schema.fields if f.name != "pivot_shingles"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names) + ", far boolean"

    def run(batches):
        for batch in batches:
            own, pivot = (batch.column(batch.schema.get_field_index(c)) for c in ("shingles", "pivot_shingles"))
            far = []
            for a, b in zip(own, pivot):
                x, y = (np.frombuffer(v.as_buffer() if v.is_valid else b"", dtype=np.uint64) for v in (a, b))
                shared = np.intersect1d(x, y, assume_unique=True)
                far.append((TOP + BOTTOM) * (len(x) + len(y) - 2 * len(shared)) > len(x))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(far, pa.bool_())],
                                             [*names, "far"])
    return rows.mapInArrow(run, schema)


def all_links(documents: DataFrame, families: DataFrame, sizes: DataFrame, reps: DataFrame, doc_id: str, text: str, block: int) -> DataFrame:
    """cls, links (documents of other classes linked to it) and root: partial sums and connections."""
    chosen = families.join(sizes, "root").withColumnRenamed("node", "cls").join(reps, "cls").select("root", "n", "cls", "doc", "n_copies", "sig")
    members = with_shingles(documents, chosen, doc_id, text)
    if (sizes.agg(F.max("n")).first()[0] or 0) <= block:
        return verified(blocked(all_far(members, "n"), ["root"], "cls", block))
    members = materialise(members, "jaccard-members")  # the texts travel once, for small and large families
    small = all_far(members.filter(F.col("n") <= block), "n")
    big = members.filter(F.col("n") > block).drop("n")
    # A family may have no common core; all of it is far then.
    judged = materialise(differing(big.join(centres(big), "root", "left")), "jaccard-centres")
    near = judged.filter("not far")
    core = near.groupBy("root").agg(F.sum("n_copies").alias("total"))
    counted = near.select("root", "cls", "n_copies").join(core, "root").select("cls", (F.col("total") - F.col("n_copies")).alias("links"), "root")
    meet = blocked(small, ["root"], "cls", block).unionByName(blocked(with_counts(judged, ["root"]), ["root"], "cls", block))
    return verified(meet).unionByName(counted)


def grouped(documents: DataFrame, doc_id: str, text: str, block: int) -> DataFrame:
    """One row per document: doc, tie, root (the group; null without words), class_id, n_links."""
    every = materialise(classes(documents, doc_id, text), "jaccard-docs")
    reps = materialise(every.filter("cls is not null").groupBy("cls").agg(
        F.min("doc").alias("doc"), F.count(F.lit(1)).alias("n_copies"), F.any_value("sig").alias("sig")), "jaccard-classes")

    families = components(all_family_edges(reps, block), "jaccard-families")
    sizes = materialise(families.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "jaccard-sizes")
    found = materialise(all_links(documents, families, sizes, reps, doc_id, text, block), "jaccard-links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = components(found.filter("cls != root").select(F.col("cls").alias("u"), F.col("root").alias("v")),
                        "jaccard-groups")

    named = (reps.select("cls", "doc", "n_copies").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
             .withColumn("root", F.coalesce("root", "cls")))
    least = named.groupBy("root").agg(F.min("doc").alias("class_id"))
    named = named.join(least, "root").join(links, "cls", "left").select(
        "cls", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    out = every.select("doc", "tie", "cls").join(named, "cls", "left")
    return out.select("doc", "tie", "root", F.coalesce("class_id", "doc").alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id, n_links."""
    null_id = F.lit(-(1 << 63))
    return grouped(documents, doc_id, text, block).select(
        F.nullif("doc", null_id).alias("doc_id"), F.nullif("class_id", null_id).alias("class_id"), "n_links")


def representatives(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The documents, all columns, of which one row of each group stays: the smallest id, and of rows
    with that id the one with the least hash of its text. Documents without words all stay, but equal
    rows of one id become one."""
    found = grouped(documents, doc_id, text, block)
    first = (found.filter(F.col("root").isNotNull() & (F.col("doc") == F.col("class_id")))
             .groupBy("root").agg(F.min(F.struct("doc", "tie")).alias("k")).select("k.*"))
    wordless = found.filter(F.col("root").isNull()).select("doc", "tie").distinct()
    kept = first.union(wordless)
    rows = documents.select(doc_key(doc_id).alias("_doc"), F.xxhash64(text).alias("_tie"), F.struct("*").alias("_row"))
    # The rows meet by id and tie once, for the join and for dropping repeated rows.
    rows = rows.join(kept, (F.col("_doc") == F.col("doc")) & (F.col("_tie") == F.col("tie")), "left_semi")
    return rows.dropDuplicates(["_doc", "_tie"]).select("_row.*")
