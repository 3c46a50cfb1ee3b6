"""Chat formatting after collapsing cumulative snapshots.

Logs hold a conversation several times, each snapshot a prefix of a later one. Every turn gets its place
and a rolling fingerprint of the turns so far (``scans``): ranges of (conversation, turn) are scanned by
themselves and composed, so a conversation of any length lies in many tasks. Equal whole conversations
collapse to the smallest id; an anti-join against the proper prefixes of all conversations then leaves
the maximal ones, and only those are rendered, one row each. The prefix table is made distinct before its
shuffle, so a first turn that a third of all conversations share is one row per task.

Order is by turn number, then role, then text; what is missing comes first. Null role or text counts as a
value of its own, and renders as empty. Turns that are repeated rows count as turns. Turns without a
conversation id form one conversation with a null id; of equal conversations the smallest id stands for
all, null only if none has one. Conversations are equal if their sequences of role and text are equal,
whatever the turn numbers.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .scans import PRIME, block_of, per_block, running

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n<|end|>\n"
HEAD = 32  # characters of a role or text that ranges are cut by
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_RNG = random.Random(20240506)
BASES = {f"f{i}": _RNG.randrange(1 << 16, PRIME - 1) for i in range(4)}
SALTS = {f: _RNG.getrandbits(31) for f in BASES}
ORDER = ["turn", "role", "text", "tie"]


def turn_rows(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, role, text, tie, and a 120-bit hash of role and text as two numbers."""
    r, t = F.col("role"), F.col("text")
    said = F.concat(F.coalesce(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r), F.lit("-")),
                    F.coalesce(F.concat(F.lit(":"), t), F.lit("-")))

    def number(at: int) -> Column:
        return F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    return (turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                         F.col(text).alias("text")).withColumn("digest", F.sha2(said.cast("binary"), 256))
            .select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("tie"),
                    number(1).alias("k1"), number(16).alias("k2")))


def valued(rows: DataFrame) -> DataFrame:
    return rows.select("*", *[F.pmod(F.xxhash64(F.lit(SALTS[f]), "k1", "k2"), F.lit(PRIME)).alias(f) for f in BASES]).drop("k1", "k2")


def spare_id(rows: DataFrame) -> int:
    """A number that is no conversation's id, for the turns without one."""
    low, high = rows.agg(F.min("conv_id"), F.max("conv_id")).first()
    if low is None:
        return 0
    if low > LEAST or high < MOST:
        return low - 1 if low > LEAST else high + 1
    ids = rows.select("conv_id").filter("conv_id is not null").distinct()
    after = ids.filter(F.col("conv_id") < MOST).select((F.col("conv_id") + 1).alias("conv_id"))
    return after.join(ids, "conv_id", "left_anti").first()[0]


def heads() -> list[Column]:
    """Short keys that never fall along role, text, tie: whole short values with the tie, the beginnings of
    longer ones."""
    long_role = F.coalesce(F.length("role") > HEAD, F.lit(False))
    long_one = long_role | F.coalesce(F.length("text") > HEAD, F.lit(False))
    return [F.substring("role", 1, HEAD), long_role, F.when(~long_role, F.substring("text", 1, HEAD)), long_one,
            F.when(~long_one, F.col("tie"))]


def turn_prefixes(rows: DataFrame, spare: int) -> DataFrame:
    """conv (the id, or the spare one), place (1 for the first turn), role, text, and the fingerprint of the
    turns up to it."""
    known = valued(rows).withColumn("conv", F.coalesce("conv_id", F.lit(spare))).drop("conv_id")
    return running(known, "conv", ORDER, BASES, "chat-prefixes", [F.col("turn"), *heads()]).select("conv", "place", "role", "text", *BASES)


def maximal(prefixes: DataFrame, spare: int) -> DataFrame:
    """conv, conv_id, n_turns and n_copies of the conversations that are no proper prefix of another one;
    of equal ones the smallest id stays."""
    prefixes = prefixes.select("conv", "place", *BASES)
    sizes = prefixes.groupBy("conv").agg(F.max("place").alias("n_turns"))
    marked = prefixes.withColumn("block", block_of("place")).join(per_block(sizes, "n_turns"), ["conv", "block"])
    whole = (marked.filter("place = n_turns").withColumn("conv_id", F.when(F.col("conv") != spare, F.col("conv")))
             .groupBy("n_turns", *BASES).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies")))
    proper = marked.filter("place < n_turns").select(F.col("place").alias("n_turns"), *BASES).distinct()
    return (whole.join(proper, ["n_turns", *BASES], "left_anti")
            .select(F.coalesce("conv_id", F.lit(spare)).alias("conv"), "conv_id", "n_turns", "n_copies"))


def rendered(role: Column, text: Column) -> Column:
    empty = F.lit("")
    return F.concat(F.lit(OPEN), F.coalesce(role, empty), F.lit(MIDDLE), F.coalesce(text, empty), F.lit(CLOSE))


def formatted(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies, and the rendered text."""
    rows = turn_rows(turns, conv_id, turn, role, text)
    spare = spare_id(rows)
    prefixes = turn_prefixes(rows, spare)
    kept = materialise(maximal(prefixes, spare), "chat-maximal")
    chosen = prefixes.join(kept, "conv").select("conv", "conv_id", "n_turns", "n_copies", F.struct(
        "place", rendered(F.col("role"), F.col("text")).alias("text")).alias("turn"))
    # One kept conversation is one output row, so its turns meet here and nowhere else.
    return (chosen.groupBy("conv", "conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
            .select("conv_id", "n_turns", "n_copies", F.array_join(F.col("turns.text"), "").alias("text")))
