"""Prefix trie of rebuilt conversations, by composable fingerprints.

A conversation is stored as a delta: it is rebuilt from the first ``head`` turns of its base
conversation and its own turns after its first ``head``. Rebuilt texts are never written. Every turn
has a reference (two 60-bit numbers of the SHA-256 of role and text) into the stored turns; a run of
turns has a fingerprint that is an element of a monoid (``scans``), so a rebuilt prefix's fingerprint
is base-head * own-suffix, worked out from the prefix products of the stored conversations alone:
own-suffix = own-head^-1 * own-prefix, as the fingerprints form a group under their shift.

Rows are one per rebuilt conversation and depth, of numbers only. They meet by (depth, fingerprint):
a node. Equality is verified, not assumed: all members of a node must refer to one stored turn and
have one parent, which by induction makes their whole sequences equal, and a reference must stand
for one (role, text), compared as texts. Should fingerprints collide, all is done again with other
bases; equal references of different turns stop the job.

Subtrees need no walk. A node belongs to its smallest member; a conversation owns the nodes from
some depth down, a path. A subtree's total is the owner's suffix sum along its path plus the whole
paths of the other members that own nodes below: one running scan and one aggregate.

Turns are ordered by turn number (null first), then by the SHA-256 of their octet length of role,
a colon, role and text (which only decides among equal numbers). Null role or text is empty.
Repeated rows are turns of their own. Turns without a conversation id belong to none and are left
out. Without conversations there is no node, not even the root. A conversation of any length and a
turn that any number of conversations share are split between tasks.
"""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .scans import PRIME, block_of, per_block, running, same_runs, streamed_groups

LANES = ["f0", "f1", "f2"]
KEY = ["depth", *LANES]
PARENT = ["e0", "e1", "e2"]
MAX_HEAD = 5
FAMILY = 100
IDS = 1 << 16  # ids in one piece of a node's list
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_rows(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, reference (k1, k2), code points, and the texts."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256)

    def number(at: int) -> Column:
        return F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    return (turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), r.alias("role"),
                         t.alias("text"), digest.alias("digest")).filter("conv_id is not null")
            .select("conv_id", "turn", "role", "text", number(1).alias("k1"), number(16).alias("k2"),
                    F.length("text").cast("long").alias("chars")))


def stored_turns(rows: DataFrame) -> DataFrame:
    """Every distinct turn once: its reference, role and text, and how often it stands."""
    return rows.groupBy("k1", "k2").agg(
        F.min("role").alias("role"), F.min("text").alias("text"), F.count(F.lit(1)).alias("n"),
        (F.min("role").eqNullSafe(F.max("role")) & F.min("text").eqNullSafe(F.max("text"))).alias("one_text"))


def family_plan(convs: DataFrame, family: int = FAMILY, max_head: int = MAX_HEAD) -> DataFrame:
    """conv_id, base, head: the base is the family's first id, the head a hash of the own id."""
    c = F.col("conv_id")
    return convs.select("conv_id", (c - c % family).alias("base"),
                        (F.crc32(c.cast("string").cast("binary")) % (max_head + 1)).alias("head"))


def prefixes(slim: DataFrame, seed: int) -> tuple[DataFrame, dict[str, int]]:
    """conv_id, place, reference, chars, fingerprints up to and before every stored turn; their bases."""
    rng = random.Random(seed)
    bases = {f: rng.randrange(1 << 16, PRIME - 1) for f in LANES}
    valued = slim.select("*", *[F.pmod(F.xxhash64(F.lit(rng.getrandbits(31)), "k1", "k2"), F.lit(PRIME)).alias(f) for f in LANES])
    return running(valued, "conv_id", ["turn", "k1", "k2", "tie"], bases, "trie-prefixes"), bases


def rebuilt(stored: DataFrame, plan, bases: dict[str, int], max_head: int = MAX_HEAD) -> DataFrame:
    """One row per rebuilt conversation and depth: its fingerprint and the parent's, composed."""
    convs = stored.groupBy("conv_id").agg(F.max("place").alias("own"))
    first = stored.filter(F.col("place") <= max_head)
    heads = first.select(F.col("conv_id").alias("base"), F.col("place").alias("at"), *[F.col(f).alias(f"h_{f}") for f in LANES])
    owned = first.select("conv_id", F.col("place").alias("head"), *[F.col(f).alias(f"o_{f}") for f in LANES])
    info = (plan(convs).join(convs, "conv_id")
            .join(convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own")), "base", "left")
            .withColumn("at", F.least("head", F.coalesce("base_own", F.lit(0))))
            .join(heads, ["base", "at"], "left").join(owned, ["conv_id", "head"], "left")
            .select("conv_id", "base", "head", "at", "own", *[F.coalesce(f"{x}_{f}", F.lit(0)).alias(f"{x}_{f}") for x in "ho" for f in LANES],
                    (F.col("at") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("size")))
    info = materialise(info, "trie-plan")
    zero = F.lit(0).cast("long")
    root = info.select("conv_id", zero.alias("depth"), "size", *[zero.alias(c) for c in (*LANES, *PARENT, "k1", "k2", "chars")])
    head = info.join(first.withColumnRenamed("conv_id", "base"), "base").filter(F.col("place") <= F.col("head")).select(
        "conv_id", F.col("place").alias("depth"), "size", *LANES, *[F.col(f"{f}_before").alias(e) for f, e in zip(LANES, PARENT)],
        "k1", "k2", "chars")

    def composed(f: str, value: str) -> Column:
        # base head * (own head^-1 * own prefix): a head that is cut short moves the suffix forward.
        back = F.array(*[F.lit(pow(pow(bases[f], k, PRIME), -1, PRIME)) for k in range(max_head + 1)])
        moved = (F.col(value) - F.col(f"o_{f}") + F.lit(PRIME)) % PRIME * F.element_at(back, (F.col("head") - F.col("at") + 1).cast("int")) % PRIME
        return (F.col(f"h_{f}") + moved) % PRIME
    tail = (stored.withColumn("block", block_of("place"))
            .join(per_block(info.filter("own > head"), "own").drop("own"), ["conv_id", "block"]).filter(F.col("place") > F.col("head"))
            .select("conv_id", (F.col("place") - F.col("head") + F.col("at")).alias("depth"), "size",
                    *[composed(f, f).alias(f) for f in LANES], *[composed(f, f"{f}_before").alias(e) for f, e in zip(LANES, PARENT)],
                    "k1", "k2", "chars"))
    return materialise(root.unionByName(head).unionByName(tail), "trie-rows")


def merged(rows: DataFrame) -> DataFrame:
    """The nodes, with whether all members agree on the last turn and on the parent."""
    checked = [*PARENT, "k1", "k2"]
    found = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("deepest"),
        F.min("chars").alias("chars"), *[F.min(c).alias(c) for c in checked], *[F.max(c).alias(f"max_{c}") for c in checked])
    same = F.lit(True)
    for c in checked:
        same = same & (F.col(c) == F.col(f"max_{c}"))
    return materialise(found.select(*KEY, "conv_id", "n_convs", "deepest", "chars", *checked, same.alias("agreed")), "trie-nodes")


def end_lists(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end in each node, ascending. Ids are joined into
    pieces along a global order, and pieces of one node stream through its digest."""
    whole = rows.filter("depth = size").select(*KEY, "conv_id")

    def pieces(batches):
        for batch in batches:
            for part in (batch.slice(i, IDS) for i in range(0, batch.num_rows, IDS)):
                at = same_runs([part.column(i).to_numpy() for i in range(4)])
                ids = part.column(4).cast(pa.string())
                lists = pa.ListArray.from_arrays(pa.array([*at, part.num_rows], pa.int32()), ids)
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(at) for i in range(5)], pc.binary_join(lists, ",")],
                                                 [*KEY, "first_id", "ids"])

    def digests(batches):
        key, digest = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in key] + [pa.array([digest.hexdigest()])],
                                              [*KEY, "ends_sha256"])
        for now, batch, s, e in streamed_groups(batches, KEY):
            if now != key:
                if key is not None:
                    yield out()
                key, digest = now, None
            for ids in batch.column(5).slice(s, e - s):
                if digest is None:
                    digest = hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_buffer())
        if key is not None:
            yield out()

    cut = (whole.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
           .mapInArrow(pieces, "depth long, f0 long, f1 long, f2 long, first_id long, ids string"))
    return (cut.repartition(*KEY).sortWithinPartitions(*KEY, "first_id")
            .mapInArrow(digests, "depth long, f0 long, f1 long, f2 long, ends_sha256 string"))


def trie(turns: DataFrame, plan=family_plan, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
         text: str = "text", max_head: int = MAX_HEAD, seeds: int = 5) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and the reference k1, k2 of its last turn into
    ``stored_turns``. ``plan`` gives base and head (at most ``max_head``) of every conversation."""
    rows = turn_rows(turns, conv_id, turn, role, text)
    wrong = stored_turns(rows).filter("not one_text").count()
    if wrong:
        raise RuntimeError(f"{wrong} references stand for several turns")
    slim = materialise(rows.select("conv_id", "turn", "k1", "k2", "chars", F.monotonically_increasing_id().alias("tie")), "trie-turns")
    for seed in range(seeds):
        stored, bases = prefixes(slim, seed)
        members = rebuilt(stored, plan, bases, max_head)
        nodes = merged(members)
        if not nodes.filter("not agreed").limit(1).count():
            break
    else:
        raise RuntimeError(f"fingerprints collide with each of {seeds} seeds")
    return subtrees(members, nodes)


def subtrees(members: DataFrame, nodes: DataFrame) -> DataFrame:
    saved = (F.col("n_convs") - 1) * F.col("chars")
    owned = running(nodes.select(*KEY, *PARENT, "conv_id", "n_convs", "k1", "k2", "deepest", saved.alias("saved")),
                    "conv_id", ["depth"], {"saved": None}, "trie-paths")
    paths = owned.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.max("place").alias("n_nodes"),
                                         F.max("saved").alias("total"), F.max((F.col("deepest") == F.col("depth")).cast("long")).alias("leaf"))
    paths = materialise(paths, "trie-owners")
    # Paths below a node that others own: their owners are members of the node without owning it.
    below = (members.select("conv_id", *KEY, block_of("depth"))
             .join(per_block(paths.filter("total > 0 or leaf > 0").select("conv_id", "top", "total", "leaf"), "top"), ["conv_id", "block"])
             .filter(F.col("depth") < F.col("top")).groupBy(*KEY).agg(F.sum("total").alias("total_below"), F.sum("leaf").alias("leaves_below")))
    tops = owned.filter((F.col("place") == 1) & (F.col("depth") > 0))
    up = [(F.col("depth") - 1).alias("depth"), *[F.col(e).alias(f) for f, e in zip(LANES, PARENT)]]
    branches = tops.groupBy(*up).agg(F.count(F.lit(1)).alias("n_branches"))
    # The root's children need no join; it may have any number of them.
    root = nodes.filter("depth = 0").select("conv_id").first()
    root_id = F.lit(root["conv_id"] if root else None).cast("long")
    hung = (tops.filter("depth > 1").select(F.col("conv_id").alias("child"), *up)
            .join(nodes.select(*KEY, F.col("conv_id").alias("hung_on")), KEY).select(F.col("child").alias("conv_id"), F.lit(1).cast("long").alias("place"), "hung_on"))
    parent = (F.when(F.col("depth") == 0, F.lit(None)).when(F.col("place") > 1, F.col("conv_id"))
              .when(F.col("depth") == 1, root_id).otherwise(F.col("hung_on")))
    more = [F.coalesce(c, F.lit(0)) for c in ("n_branches", "leaves_below", "total_below")]
    return (owned.withColumn("block", block_of("place"))
            .join(per_block(paths.select("conv_id", "bottom", "n_nodes", "total", "leaf"), "n_nodes").drop("n_nodes"), ["conv_id", "block"])
            .join(hung, ["conv_id", "place"], "left").join(branches, KEY, "left").join(below, KEY, "left")
            .join(end_lists(members), KEY, "left")
            .select("conv_id", "depth", parent.cast("long").alias("parent_conv_id"), "n_convs",
                    ((F.col("depth") < F.col("bottom")).cast("long") + more[0]).alias("n_children"),
                    (F.col("leaf") + more[1]).alias("n_leaves"),
                    (F.col("total") - F.col("saved_before") + more[2]).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "k1", "k2"))
