"""Phrase collocations by tries of Apriori-safe candidates.

Phrases of 2 to ``longest`` words that stand ``least`` times or more are found level by level. A
phrase can only be that frequent if both phrases one word shorter in it are, so:

1. words are counted per language;
2. a scan looks at places where two frequent phrases of m - 1 words overlap (for m = 2: two frequent
   words follow each other) and sums how often each pair of them does, by 64 bits of hash. Pairs that
   share them are summed together, so no frequent phrase of m words can fall below ``least``: what is
   left are the candidates;
3. the candidates go into double-array tries of at most ``SHARD`` phrases, broadcast one at a time. The
   next scan advances the states of all text positions of a slice through a trie level by level (numpy),
   bincounts the accepting states, and sums the shards' counts exactly. The same scan does step 2 for
   m + 1.

What is broadcast has a fixed bound: a trie shard, and a bitmap of ``BITS`` bits in which the frequent
phrases' hashes are marked. A fuller bitmap lets more pairs through to the sums; it never loses one. More
candidates than a shard holds mean more scans, not a larger trie.

Words are compared by 64-bit hashes of language and word; that no two words share one is checked over the
whole vocabulary, and all is done again with another hash otherwise. Nothing else hangs on hashes: pairs
of phrases that share one become candidates together and are counted apart.

Null text is empty; a null language is ``und``; repeated rows count each. Phrases do not cross documents
or the marks that end a piece. An empty table, or one without a frequent phrase, gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import default_parallelism
from .common import Texts, materialise, mix, split_batch, window_hashes

LEAST, LONGEST, TOP = 100, 5, 2000
UNDEFINED = "und"
SHARD = 1 << 20  # phrases in a trie
BITS = 1 << 26  # of a bitmap of phrases: 8 MB
LOW = 0xFFFFFFFF
HELD = 1 << 20  # rows combined in a task before they are shuffled
SENT = 1 << 16  # rows that leave a Python worker at once

IS_END = np.zeros(256, dtype=bool)
IS_END[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
IS_GAP = IS_END.copy()
IS_GAP[[0x20, 0x09]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


class Words:
    """The words of a slice: byte spans, hashes with the language in them, and the piece of each."""

    def __init__(self, part: pa.RecordBatch, seed: int):
        langs = part.column(0).to_pylist()
        t = Texts(part.column(1))
        self.data = LOWER[t.data]
        # Another seed deals other hash values to the bytes.
        t.data = np.random.default_rng(seed).permutation(256).astype(np.uint8)[self.data] if seed else self.data
        self.starts, self.ends, first = t.pieces(IS_GAP[self.data])
        self.doc = np.repeat(np.arange(t.n), np.diff(first))
        of = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in dict.fromkeys(langs)}
        salt = np.array([of[x] for x in langs], dtype=np.uint64)
        self.h = mix(t.hashes(self.starts, self.ends) ^ salt[self.doc])
        ends = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(IS_END[self.data], out=ends[1:])
        self.piece = ends[self.starts] + self.doc

    def strings(self, at: np.ndarray) -> pa.Array:
        s, n = self.starts[at], self.ends[at] - self.starts[at]
        off = np.append(0, np.cumsum(n))
        flat = self.data[np.repeat(s - off[:-1], n) + np.arange(off[-1])]
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(off), pa.py_buffer(flat)])

    def within(self, size: int) -> np.ndarray:
        """At which words a run of ``size`` words of one piece starts."""
        n = len(self.h) - size + 1
        return self.piece[:n] == self.piece[size - 1:] if n > 0 else np.zeros(0, dtype=bool)


def slices(batches):
    for batch in batches:
        yield from split_batch(batch, "text")


class Tally:
    """Sums of n by key within a task."""

    def __init__(self):
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, key: np.ndarray):
        self.rows.append(np.unique(key, return_counts=True))
        self.size += len(self.rows[-1][0])
        if self.size >= HELD:
            merged = self.merged()
            if len(merged[0]) >= HELD // 2:
                self.rows, self.size = [], 0
                yield merged
            else:
                self.rows, self.size = [merged], len(merged[0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        key, n = (np.concatenate(x) for x in zip(*self.rows))
        self.rows = []
        order = np.argsort(key)
        key, n = key[order], n[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key[at], np.add.reduceat(n, at)

    def rest(self):
        if self.size:
            yield self.merged()


# -- the trie ----------------------------------------------------------------------------------

def placed(used: np.ndarray, code: np.ndarray, begin: np.ndarray, many: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Bases of parents with several children (runs of ``many`` ascending codes from ``begin``), at which all
    child slots beyond ``v`` are free; the array grown to about two slots a child. The largest families
    choose first; places are tried at random, as most are free."""
    used = np.concatenate([used, np.zeros(2 * len(code) + 2 * v + 2, dtype=bool)])
    base, rng = np.zeros(len(begin), dtype=np.int64), np.random.default_rng(7)
    for g in np.argsort(-many, kind="stable")[:int((many > 1).sum())].tolist():
        c = code[begin[g]:begin[g] + many[g]]
        while True:
            b = rng.integers(v + 1 - c[0], len(used) - c[-1], 64)
            fits = ~used[b[:, None] + c].any(axis=1)
            if fits.any():
                break
            if rng.random() < 0.02:  # about fifty tries in vain
                used = np.concatenate([used, np.zeros(v + len(c), dtype=bool)])
        base[g] = b[np.argmax(fits)]
        used[base[g] + c] = True
    return used, base


class DoubleArray:
    """Phrases of one length, as rows of word hashes. The child of slot s by code c is slot
    base[s] + c if check there is s; slots 1 to the number of codes are the root's children."""

    def __init__(self, words: np.ndarray):
        n, self.size = words.shape
        labels, inverse, count = np.unique(words, return_inverse=True, return_counts=True)
        rank = np.empty(len(labels), dtype=np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(1, len(labels) + 1)  # common words have small codes
        self.labels, self.codes = labels, rank.astype(np.int32)
        codes = rank[inverse.reshape(words.shape)]
        v = len(labels)
        slot = codes[:, 0].copy()
        self.base = np.zeros(v + 1, dtype=np.int64)
        self.check = np.zeros(v + 1, dtype=np.int64)
        used = np.ones(v + 1, dtype=bool)
        for d in range(1, self.size):
            edge, inverse = np.unique(slot << 32 | codes[:, d], return_inverse=True)
            parent, code = edge >> 32, edge & 0xFFFFFFFF
            begin = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
            many = np.diff(np.append(begin, len(edge)))
            used, base = placed(used, code, begin, many, v)
            one = np.flatnonzero(many == 1)
            free = np.flatnonzero(~used)[:len(one)]
            base[one] = free - code[begin[one]]
            used[free] = True
            child = np.repeat(base, many) + code
            top = max(len(self.base), int(child.max()) + 1)
            self.base, self.check = (np.concatenate([x, np.zeros(top - len(x), dtype=np.int64)]) for x in (self.base, self.check))
            self.base[parent[begin]] = base
            self.check[child] = parent
            slot = child[inverse]
        self.slot = slot  # of each phrase

    def counts(self, w: Words) -> np.ndarray:
        """How often each slot accepts at the words of a slice."""
        at = np.minimum(np.searchsorted(self.labels, w.h), len(self.labels) - 1)
        code = np.where(self.labels[at] == w.h, self.codes[at], 0).astype(np.int64)
        here = np.flatnonzero(w.within(self.size))
        here = here[code[here] > 0]
        state = code[here]
        for d in range(1, self.size):
            c = code[here + d]
            then = self.base[state] + c
            ok = (c > 0) & (then < len(self.check)) & (then > 0)
            then[~ok] = 0
            ok &= self.check[then] == state
            here, state = here[ok], then[ok]
        return np.bincount(state, minlength=len(self.base))


def marked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h & np.uint64(BITS - 1)
    return bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 > 0


# -- the scans -----------------------------------------------------------------------------------

def written(df: DataFrame, name: str) -> DataFrame:
    """Sums and what is left of them, written as a file for each core and not for each partition of the shuffle before:
    Hadoop's local file system starts a process (chmod) for every file, from an executor of full size."""
    return materialise(df.repartition(default_parallelism(df.sparkSession)), name)


def vocabulary(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, h, n of all words."""
    names = ["lang", "word", "h", "n"]

    def run(batches):
        held, size = [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by(names[:3], use_threads=False).aggregate([("n", "sum")]).rename_columns(names)
        for part in slices(batches):
            w = Words(part, seed)
            if not len(w.h):
                continue
            h, at, n = np.unique(w.h, return_index=True, return_counts=True)
            held.append(pa.table([part.column(0).take(pa.array(w.doc[at])), w.strings(at).cast(pa.string()), pa.array(h.view(np.int64)),
                                  pa.array(n)], names))
            size += len(h)
            if size >= HELD:
                held = [summed()]
                size = held[0].num_rows
                if size >= HELD // 2:
                    yield from held[0].to_batches(SENT)
                    held, size = [], 0
        if held:
            yield from summed().to_batches(SENT)
    found = docs.mapInArrow(run, "lang string, word string, h long, n long").repartition("h")
    return written(found.groupBy("h", "lang", "word").agg(F.sum("n").alias("n")), "phrase-words")


def scan(docs: DataFrame, seed: int, size: int, trie: tuple | None, bitmap: np.ndarray | None) -> DataFrame:
    """One pass over the texts: kind 0, a candidate's id and its count of accepting states; kind 1, a
    pair of overlapping marked phrases of ``size`` words (32 bits of the first's hash and of the last
    word's, so that a count may be that of several pairs together), and how often it stands."""
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast((trie, bitmap))

    def rows(kind: int, key: np.ndarray, n: np.ndarray):
        for k in range(0, len(key), SENT):
            some, many = key[k:k + SENT].view(np.int64), n[k:k + SENT]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, dtype=np.int8)), pa.array(some), pa.array(many)],
                                             ["kind", "key", "n"])

    def run(batches):
        trie, bitmap = held.value
        counts = np.zeros(len(trie[0].base), dtype=np.int64) if trie else None
        pairs = Tally()
        for part in slices(batches):
            w = Words(part, seed)
            if trie:
                counts += trie[0].counts(w)
            if bitmap is None:
                continue
            phrase = window_hashes(w.h, size)
            frequent = marked(bitmap, phrase)
            at = np.flatnonzero(w.within(size + 1))
            at = at[frequent[at] & frequent[at + 1]]
            if len(at):
                for found in pairs.add(phrase[at] << np.uint64(32) | w.h[at + size] & np.uint64(0xFFFFFFFF)):
                    yield from rows(1, *found)
        for found in pairs.rest():
            yield from rows(1, *found)
        if trie:
            n = counts[trie[0].slot]
            seen = n > 0
            yield from rows(0, trie[1][seen], n[seen])
    return docs.mapInArrow(run, "kind byte, key long, n long")


def bitmap_of(phrases: DataFrame) -> np.ndarray:
    """Bits of the phrases' hashes; a fixed number of rows reaches the driver."""
    word = F.col("p").bitwiseAND(F.lit(BITS - 1))
    rows = (phrases.select(F.shiftright(word, 6).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(p & 63L as int))").alias("bit"))
            .groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(BITS // 64, dtype=np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


def with_hash(phrases: DataFrame) -> DataFrame:
    """Adds p, the hash of the phrase's words (array of longs of one length)."""
    names = [*phrases.columns, "p"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in phrases.schema.fields)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(names.index("words")).flatten().to_numpy().view(np.uint64)
                p = window_hashes(flat, len(flat) // batch.num_rows)[::len(flat) // batch.num_rows]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.view(np.int64))], names)
    return phrases.mapInArrow(run, f"{kinds}, p long")


def shards(candidates: DataFrame, n: int):
    """Tries over the candidates, at most ``SHARD`` phrases each, one at a time."""
    parts = -(-n // SHARD)
    for k in range(parts):
        some = candidates.filter(F.pmod(F.col("id"), F.lit(parts)) == k) if parts > 1 else candidates
        got = some.select("id", "words").toArrow()
        if got.num_rows:
            flat = got.column("words").combine_chunks().flatten().to_numpy().view(np.uint64)
            yield DoubleArray(flat.reshape(got.num_rows, -1)), got.column("id").to_numpy()


def frequent_phrases(docs: DataFrame, least: int, longest: int, seeds: int = 4) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words (lang, words, phrase, size, f), and n per language."""
    for seed in range(seeds):
        words = vocabulary(docs, seed)
        if not words.groupBy("h").count().filter("count > 1").limit(1).count():
            break
    else:
        raise RuntimeError(f"words share hashes with each of {seeds} seeds")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    singles = written(with_hash(words.filter(F.col("n") >= least).select(
        "lang", F.array("h").alias("words"), F.col("word").alias("phrase"), F.lit(1).alias("size"), F.col("n").alias("f"))), "phrase-level")
    levels, before = [singles.drop("p")], singles
    found = scan(docs, seed, 1, None, bitmap_of(singles))
    for size in range(2, longest + 1):
        # Pairs that could be frequent, as candidates with their words.
        pairs = (found.filter("kind = 1") if size > 2 else found.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
        pairs = pairs.select(F.shiftrightunsigned("key", 32).alias("low_first"), F.col("key").bitwiseAND(F.lit(LOW)).alias("low_last"))
        last = singles.select("lang", F.col("words")[0].alias("b"), F.col("phrase").alias("last")).withColumn("low_last", F.col("b").bitwiseAND(F.lit(LOW)))
        built = (pairs.join(before.withColumn("low_first", F.col("p").bitwiseAND(F.lit(LOW))), "low_first")
                 .join(last, ["low_last", "lang"])
                 .select("lang", F.concat("words", F.array("b")).alias("words"),
                         F.concat_ws(" ", "phrase", "last").alias("phrase"), F.lit(size).alias("size")))
        # Numbered where they are written: a number must not change between a shuffle and its reader.
        built = built.repartition(default_parallelism(docs.sparkSession)).select(F.monotonically_increasing_id().alias("id"), "*")
        candidates = materialise(with_hash(built), "phrase-candidates")
        n = candidates.count()
        if not n:
            break
        bitmap = bitmap_of(candidates) if size < longest else None
        scans = [scan(docs, seed, size, trie, bitmap if k == 0 else None) for k, trie in enumerate(shards(candidates, n))]
        found = scans[0]
        for more in scans[1:]:
            found = found.unionByName(more)
        # Both kinds are summed at once: counts by id, pairs by their hashes.
        found = written(found.groupBy("kind", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "phrase-scan")
        counts = found.filter("kind = 0").select(F.col("key").alias("id"), F.col("n").alias("f"))
        before = written(candidates.join(counts, "id").select("lang", "words", "phrase", "size", "f", "p"), "phrase-level")
        levels.append(before.drop("p"))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out, totals


# -- scores --------------------------------------------------------------------------------------

def exact_score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (left * right)) in 38 decimal digits."""
    return F.expr(f"(cast(1000 as decimal(4,0)) * cast({a} as decimal(15,0)) * cast({n} as decimal(17,0))) "
                  f"div (cast({left} as decimal(18,0)) * cast({right} as decimal(18,0)))").cast("long")


def mine(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST,
         top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases."""
    docs = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNDEFINED)).alias("lang"),
                            F.coalesce(F.col(text), F.lit("")).alias("text"))
    found, totals = frequent_phrases(docs, least, longest)
    phrases = found.filter("size > 1")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "*", F.slice("words", F.lit(1), F.col("k")).alias("left"), F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    part = found.filter(F.col("size") < longest)
    scored = (cuts.join(part.select(F.col("words").alias("left"), F.col("f").alias("l")), "left")
              .join(part.select(F.col("words").alias("right"), F.col("f").alias("r")), "right").join(totals, "lang")
              .withColumn("score", exact_score("f", "total", "l", "r"))
              .groupBy("lang", "words", "phrase", F.col("f").alias("a"), F.col("total").alias("n"))
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    # Frequencies only fall as a phrase grows, so a longer phrase as frequent makes the one a word
    # longer as frequent too.
    longer = phrases.filter("size > 2")
    inner = longer.select(F.slice("words", F.lit(1), F.col("size") - 1).alias("words"), F.col("f").alias("a")).unionByName(
        longer.select(F.slice("words", F.lit(2), F.col("size") - 1).alias("words"), F.col("f").alias("a")))
    kept = scored.join(inner, ["words", "a"], "left_anti")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")))
    return ranked.filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"),
                                                      F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
