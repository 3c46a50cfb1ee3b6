"""SentencePiece (merge type) encoding with seeded merge-dropout, and lossless decoding.

A text gets a leading space, and spaces become the word mark; no piece of a merge model has a word
mark after another character, so a text splits before each run of word marks into units whose merges
are independent. Within a unit an agenda always takes the best-scored candidate merge (leftmost on
ties); each candidate taken is skipped if a keyed hash of (seed, document id, place of the unit in
the document, place in the unit, both pieces) falls below the dropout rate, so every candidate of
every occurrence has a draw of its own and every segmentation is reproducible. What follows on a
merge or a skip does not depend on the draws: it is a tree per unit, grown where occurrences come by
and kept between slices of text, down which all occurrences go in lockstep (numpy). Long units use a
heap. With dropout 0 the pieces are those of the plain SentencePiece encoder.

Characters that are no piece, and word marks that stand in the text itself, become byte pieces, so
decoding restores every text exactly. Null text has null ids; the empty text has none. Ids repeat
for repeated rows; a null document id counts as 0 in the key. The model file's path is a parameter;
its pieces (a fixed vocabulary) are broadcast.
"""

from __future__ import annotations

import heapq
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, byte_strings, map_texts, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
MARK = "▁"
LONG = 40  # characters from which a unit uses the heap
NONE = 1 << 30  # the rank of a pair that does not merge
UNKNOWN = 1 << 21  # plus a code point: a character that is no piece
CACHE_UNITS = 200_000
CACHE_CELLS = 5_000_000  # symbols in the trees of a worker, 9 bytes each
CACHE_NODES = 800_000  # of 30 bytes each
DECODED = 1 << 16  # ids decoded at once


def load(path: str = MODEL) -> dict:
    """Pieces, scores and byte pieces of a merge-type model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)) for i in ids]
    by_byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
    if len(by_byte) != 256:
        raise ValueError(f"{path} has no byte pieces, so it cannot encode every text")
    return {"pieces": [sp.id_to_piece(i) for i in ids], "scores": [sp.get_score(i) for i in ids], "plain": plain,
            "bytes": [by_byte[b] for b in range(256)]}


def mix_one(h: int) -> int:
    """``mix`` of one number."""
    h ^= h >> 31
    h = h * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    h ^= h >> 29
    h = h * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return h ^ h >> 32


class Column:
    """An array that grows: ``x`` has room beyond its ``n`` rows."""

    def __init__(self, dtype, width: int = 0):
        self.n, self.x = 0, np.zeros((16, width) if width else 16, dtype=dtype)

    def add(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.x):
            grown = np.empty((3 * (self.n + len(rows)) // 2, *self.x.shape[1:]), dtype=self.x.dtype)
            grown[:self.n] = self.x[:self.n]
            self.x = grown
        self.x[self.n:self.n + len(rows)] = rows
        self.n += len(rows)


class Codec:
    def __init__(self, model: dict, dropout: float = DROPOUT, seed: int = 0):
        self.size = len(model["pieces"])
        self.seed = np.uint64(seed % 2**64)
        self.threshold = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))
        known = {p: i for i, p in enumerate(model["pieces"]) if model["plain"][i]}
        if any(MARK in p.lstrip(MARK) for p in known):
            raise ValueError("pieces cross word boundaries")
        extra = {c: self.size + i for i, c in enumerate(sorted({c for p in known for c in p} - set(known)))}
        symbol = known | extra
        self.char = np.arange(0x110000, dtype=np.int32) + np.int32(UNKNOWN)
        for s, i in symbol.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        ranks = {s: r for r, s in enumerate(sorted({model["scores"][i] for i in known.values()}, reverse=True))}
        pairs = [(symbol[p[:k]], symbol[p[k:]], ranks[model["scores"][i]], i)
                 for p, i in known.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        table = np.array(sorted((a << 22 | b, r, i) for a, b, r, i in pairs), dtype=np.int64).reshape(-1, 3)
        self.keys = np.ascontiguousarray(table[:, 0])
        self.ranks, self.merged = (table[:, k].astype(np.int32) for k in (1, 2))
        # Open addressing: a pair's row is in the first free slot from its hash on, so a free slot ends a search.
        self.shift = np.uint64(64 - max(4, (4 * len(self.keys)).bit_length()))
        self.slots = np.full((1 << 64 - int(self.shift)) + len(self.keys) + 1, -1, dtype=np.int32)
        at, row = self.slot(self.keys), np.arange(len(self.keys), dtype=np.int32)
        while len(row):
            free = self.slots[at] < 0
            self.slots[at[free]] = row[free]
            on = self.slots[at] != row
            at, row = at[on] + 1, row[on]
        self.of_byte = np.array(model["bytes"], dtype=np.int64)
        self.text = [p.replace(MARK, " ").encode() if model["plain"][i] else b"" for i, p in enumerate(model["pieces"])]
        for b, i in enumerate(model["bytes"]):
            self.text[i] = bytes([b])
        self.text_bytes = np.frombuffer(b"".join(self.text), dtype=np.uint8)
        self.text_size = np.array([len(x) for x in self.text], dtype=np.int64)
        self.text_start = np.cumsum(self.text_size) - self.text_size
        # Characters of no piece end a unit; line breaks are the common ones.
        self.broken = np.zeros(256, dtype=bool)
        self.broken[[b for b in b"\n\t\r" if self.char[b] >= UNKNOWN]] = True
        self.pairs: dict[int, int] | None = None
        self.forget()

    def forget(self) -> None:
        """Drop the trees."""
        self.index: dict[bytes, int] = {}  # units with a tree
        self.root = Column(np.int32)  # node, per unit
        # Nodes: the candidate's hash, its place, the nodes after a merge and after a skip (-1: not
        # grown), the symbols' number (0: an end) and row in their pool, or place and length of the ids.
        self.asked, self.best = Column(np.uint64), Column(np.int16)
        self.next, self.width, self.row = Column(np.int32, 2), Column(np.int32), Column(np.int64)
        self.store = Column(np.int32)
        self.pools: dict[int, tuple[Column, Column, Column]] = {}  # by width: symbols, places, ranks
        self.cells = 0

    # -- merges of one unit ------------------------------------------------------------------

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if they do not merge) and merged id of pairs of symbols."""
        key = (left.astype(np.int64) << 22 | right).reshape(-1)
        if not len(self.keys):
            return np.full(left.shape, NONE, dtype=np.int32), np.zeros(left.shape, dtype=np.int32)
        at = self.slot(key)
        row = self.slots[at]
        off = np.flatnonzero((row >= 0) & (self.keys[row] != key))
        while len(off):
            at[off] += 1
            row[off] = r = self.slots[at[off]]
            off = off[(r >= 0) & (self.keys[r] != key[off])]
        rank = np.where(row >= 0, self.ranks[row], np.int32(NONE))
        return rank.reshape(left.shape), self.merged[row].reshape(left.shape)

    def slot(self, key: np.ndarray) -> np.ndarray:
        """Where the search for a pair begins."""
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    @staticmethod
    def candidate(place, left, right) -> np.ndarray:
        """Hash of a candidate merge within its unit."""
        h = mix(np.asarray(place).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return mix(h ^ (np.asarray(left).astype(np.uint64) << np.uint64(32) | np.asarray(right).astype(np.uint64)))

    def skipped(self, key, asked) -> np.ndarray:
        """The keyed hash's verdict on candidate merges of occurrences."""
        return mix(key ^ asked) < self.threshold

    def settle(self, sym: np.ndarray, place: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """New nodes for states of one width: what they ask, its place, symbols (0: an end) and row."""
        n, width = sym.shape
        r = np.arange(n)
        best = rank.argmin(axis=1) if width > 1 else np.zeros(n, dtype=np.int64)
        going = rank[r, best] < NONE if width > 1 else np.zeros(n, dtype=bool)
        asked, wide, row = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64)
        on = np.flatnonzero(going)
        if len(on):
            b = best[on]
            asked[on] = self.candidate(place[on, b], sym[on, b], sym[on, b + 1])
            wide[on] = width
            pool = self.pools.setdefault(width, (Column(np.int32, width), Column(np.int8, width), Column(np.int32, width - 1)))
            row[on] = pool[0].n + np.arange(len(on))
            for column, x in zip(pool, (sym, place, rank)):
                column.add(x[on])
            self.cells += len(on) * width
        end = np.flatnonzero(~going)
        if len(end):
            flat, off = self.to_ids(sym[end].reshape(-1).astype(np.int64), np.arange(len(end) + 1) * width)
            row[end] = (self.store.n + off[:-1]) << 24 | np.diff(off)
            self.store.add(flat)
        return asked, best.astype(np.int16), wide, row

    def number(self, nodes: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        """The numbers of settled nodes."""
        first = self.asked.n
        for column, x in zip((self.asked, self.best, self.width, self.row), zip(*nodes)):
            column.add(np.concatenate(x))
        n = self.asked.n - first
        self.next.add(np.full((n, 2), -1, dtype=np.int32))
        return first + np.arange(n)

    def plant(self, units: list[str]) -> None:
        """Roots of new units shorter than ``LONG``."""
        sym, begin = self.symbols(units)
        size = np.diff(begin)
        root, found, nodes = np.zeros(len(units), dtype=np.int64), [], []
        for width in np.unique(size):
            which = np.flatnonzero(size == width)
            s = sym[begin[which][:, None] + np.arange(width)].astype(np.int32)
            place = np.broadcast_to(np.arange(width, dtype=np.int8), s.shape)
            found.append(which)
            nodes.append(self.settle(s, place, self.lookup(s[:, :-1], s[:, 1:])[0]))
        root[np.concatenate(found)] = self.number(nodes)
        self.root.add(root)

    def grow(self, nodes: np.ndarray, skip: np.ndarray) -> None:
        """The nodes after a merge or a skip of the given nodes' candidates."""
        then = self.width.x[nodes] - 1 + skip
        found, settled = [], []
        for width in np.unique(then).tolist():
            at, states = [], []
            for side in (0, 1):
                which = np.flatnonzero((then == width) & (skip == side))
                if len(which):
                    at.append(which)
                    states.append(self.skips(nodes[which]) if side else self.merges(nodes[which]))
            found += at
            settled.append(self.settle(*(states[0] if len(states) == 1 else map(np.concatenate, zip(*states)))))
        at = np.concatenate(found)
        self.next.x[nodes[at], skip[at]] = self.number(settled)

    def states(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The best candidates' places, rows to index with, and symbols, places and ranks of nodes of one width."""
        row = self.row.x[nodes]
        return self.best.x[nodes].astype(np.int64), np.arange(len(nodes)), [c.x[row] for c in self.pools[int(self.width.x[nodes[0]])]]

    def skips(self, nodes: np.ndarray) -> list[np.ndarray]:
        best, r, (sym, place, rank) = self.states(nodes)
        rank[r, best] = NONE
        return [sym, place, rank]

    def merges(self, nodes: np.ndarray) -> list[np.ndarray]:
        best, r, (sym, place, rank) = self.states(nodes)
        width = sym.shape[1]
        merged = self.lookup(sym[r, best], sym[r, best + 1])[1]
        # Close the gap that the right part leaves.
        keep = np.arange(width - 1) + (np.arange(width - 1) > best[:, None])
        sym, place = (np.take_along_axis(x, keep, axis=1) for x in (sym, place))
        sym[r, best] = merged
        rank = np.take_along_axis(rank, keep[:, :-1].clip(max=width - 2), axis=1)
        for left in (best - 1, best):  # the new piece's neighbours
            ok = np.flatnonzero((left >= 0) & (left + 1 < width - 1))
            rank[ok, left[ok]] = self.lookup(sym[ok, left[ok]], sym[ok, left[ok] + 1])[0]
        return [sym, place, rank]

    def walk(self, node: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The ends that occurrences come to from their units' roots."""
        out = node.copy()
        at = np.flatnonzero(self.width.x[node] > 0)
        node, key = node[at], key[at]
        while len(at):
            skip = self.skipped(key, self.asked.x[node]).astype(np.int64)
            then = self.next.x[node, skip]
            missing = np.flatnonzero(then < 0)
            if len(missing):
                new = np.unique(node[missing].astype(np.int64) * 2 + skip[missing])
                self.grow(new >> 1, new & 1)
                then = self.next.x[node, skip]
            out[at] = then
            on = self.width.x[then] > 0
            at, node, key = at[on], then[on], key[on]
        return out

    def pair_table(self) -> dict[int, int]:
        """Rank (high bits) and merged id by pair of symbols, for one candidate at a time."""
        if self.pairs is None:
            self.pairs = dict(zip(self.keys.tolist(), (self.ranks.astype(np.int64) << 22 | self.merged).tolist()))
        return self.pairs

    def alone(self, sym: np.ndarray, key: np.uint64) -> np.ndarray:
        """The same agenda for one long unit, as a heap over a linked list. A candidate's draw depends on
        its place and pieces alone, so one that will be skipped does not enter the heap."""
        n = len(sym)
        rank, merged = self.lookup(sym[:-1], sym[1:])
        at = np.flatnonzero(rank < NONE)
        at = at[~self.skipped(key, self.candidate(at, sym[at], sym[at + 1]))]
        agenda = list(zip(rank[at].tolist(), at.tolist(), sym[at].tolist(), sym[at + 1].tolist(), merged[at].tolist()))
        heapq.heapify(agenda)
        symbols, before, after = sym.tolist(), list(range(-1, n - 1)), [*range(1, n), -1]
        places = mix(np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).tolist()
        pairs, key, threshold = self.pair_table(), int(key), int(self.threshold)
        push, pop = heapq.heappush, heapq.heappop
        while agenda:
            _, i, left, right, m = pop(agenda)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = m, -1
            after[i] = c = after[j]
            if c >= 0:
                before[c] = i
                found = pairs.get(m << 22 | symbols[c])
                if found is not None and mix_one(key ^ mix_one(places[i] ^ (m << 32 | symbols[c]))) >= threshold:
                    push(agenda, (found >> 22, i, m, symbols[c], found & 0x3FFFFF))
            a = before[i]
            if a >= 0:
                found = pairs.get(symbols[a] << 22 | m)
                if found is not None and mix_one(key ^ mix_one(places[a] ^ (symbols[a] << 32 | m))) >= threshold:
                    push(agenda, (found >> 22, a, symbols[a], m, found & 0x3FFFFF))
        return np.array([s for s in symbols if s >= 0], dtype=np.int64)

    def symbols(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the characters of units, flat, and offsets (n + 1)."""
        codes = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        literal, space = codes == ord(MARK), codes == ord(" ")
        sym = self.char[np.where(space, ord(MARK), codes)]
        sym[literal] = UNKNOWN + ord(MARK)
        return sym, np.concatenate([[0], np.cumsum(np.array([len(u) for u in units], dtype=np.int64))])

    def to_ids(self, flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols to piece ids; characters that are no piece become their bytes' pieces."""
        odd = np.flatnonzero(flat >= self.size)
        if not len(odd):
            return flat, off
        values, which = np.unique(flat[odd], return_inverse=True)
        chars = [chr(v - UNKNOWN) if v >= UNKNOWN else self.extra_char(v) for v in values.tolist()]
        coded = [self.of_byte[np.frombuffer(c.encode(), dtype=np.uint8)] for c in chars]
        length = np.ones(len(flat), dtype=np.int64)
        length[odd] = np.array([len(c) for c in coded])[which]
        at = np.concatenate([[0], np.cumsum(length)])
        out = np.repeat(flat, length)
        for k, c in enumerate(coded):
            out[at[odd[which == k]][:, None] + np.arange(len(c))] = c
        return out, at[off]

    def extra_char(self, symbol: int) -> str:
        return chr(int(np.flatnonzero(self.char == symbol)[0]))

    # -- texts -------------------------------------------------------------------------------

    def unit_starts(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts that are not empty with a leading space, as bytes, their offsets (n + 1), and the bytes at which
        a unit starts: a run of spaces with the characters up to the next space, or a character of no piece."""
        some = t.off[:-1] < t.off[1:]
        data = np.insert(t.data, t.off[:-1][some], 0x20)
        off = t.off + np.append(0, np.cumsum(some))
        space, broken = data == 0x20, self.broken[data]
        start = broken.copy()
        start[1:] |= broken[:-1] | space[1:] & ~space[:-1]
        start[off[:-1][some]] = True
        return data, off, np.flatnonzero(start)

    def encode(self, texts: list[str | None] | pa.Array, doc_ids: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and offsets (n + 1)."""
        if len(self.index) > CACHE_UNITS or self.cells > CACHE_CELLS or self.asked.n > CACHE_NODES:
            self.forget()
        data, off, starts = self.unit_starts(Texts(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())))
        if not len(starts):
            return np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
        first = np.searchsorted(starts, off)
        per_doc = np.diff(first)
        place = np.arange(len(starts)) - np.repeat(first[:-1], per_doc)
        ids = np.array([(d or 0) % 2**64 for d in doc_ids], dtype=np.uint64)
        key = mix(mix(np.repeat(mix(ids + self.seed), per_doc) ^ place.astype(np.uint64)) + self.seed)
        # Units lie side by side and cover the texts.
        spans = pa.py_buffer(np.append(starts, len(data)))
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, spans, pa.py_buffer(data)]).dictionary_encode()
        which, units, index = found.indices.to_numpy(), byte_strings(found.dictionary), self.index
        code = np.fromiter(map(index.get, units, repeat(-1)), dtype=np.int64, count=len(units))
        missing = np.flatnonzero(code < 0).tolist()
        spelt = {i: units[i].decode() for i in missing}
        new = [i for i in missing if len(spelt[i]) < LONG]
        if new:
            code[new] = np.arange(len(index), len(index) + len(new))
            index.update(zip([units[i] for i in new], code[new].tolist()))
            self.plant([spelt[i] for i in new])
        code = code[which]
        short, long = np.flatnonzero(code >= 0), np.flatnonzero(code < 0)
        start, size = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        if len(short):
            end = self.walk(self.root.x[code[short]], key[short])
            row = self.row.x[end]
            start[short], size[short] = row >> 24, row & 0xFFFFFF
        store = self.store.x[:self.store.n]
        if len(long):
            sym, begin = self.symbols([spelt[i] for i in which[long].tolist()])
            got = [self.alone(sym[a:b], k) for a, b, k in zip(begin, begin[1:], key[long])]
            flat, at = self.to_ids(np.concatenate(got), np.concatenate([[0], np.cumsum([len(g) for g in got])]))
            start[long], size[long] = len(store) + at[:-1], np.diff(at)
            store = np.concatenate([store, flat])
        total = np.append(0, np.cumsum(size))
        at = np.repeat(start - total[:-1], size) + np.arange(total[-1])
        return store[at].astype(np.int64), total[first]

    def decode(self, ids) -> str:
        """The text that was encoded."""
        return b"".join(map(self.text.__getitem__, ids)).decode()[1:]

    def restores(self, texts: pa.Array, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Whether each text's ids, decoded, are its bytes again."""
        t = Texts(texts)
        total = np.append(0, np.cumsum(self.text_size[ids]))
        data = np.empty(total[-1], dtype=np.uint8)
        for k in range(0, len(ids), DECODED):
            some = ids[k:k + DECODED]
            size, upto = self.text_size[some], total[k:k + len(some) + 1]
            data[upto[0]:upto[-1]] = self.text_bytes[np.repeat(self.text_start[some] - upto[:-1], size) + np.arange(upto[0], upto[-1])]
        ends = total[off]
        some = ends[:-1] < ends[1:]
        data = np.delete(data, ends[:-1][some])  # the leading space
        mine = np.diff(ends) - some
        theirs = np.diff(t.off)
        same = mine == theirs
        if same.all():
            other = t.data
        else:
            data, other = data[np.repeat(same, mine)], t.data[np.repeat(same, theirs)]
        wrong = np.flatnonzero(data != other)
        same[np.searchsorted(np.cumsum(np.where(same, mine, 0)), wrong, side="right")] = False
        return same


_CODECS: dict[tuple, Codec] = {}


def codec(name: str, held, *settings) -> Codec:
    """The worker's codec for a broadcast model, built once."""
    key = (name, *settings)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(held.value, *settings)
    return _CODECS[key]


def encode(documents: DataFrame, path: str = MODEL, dropout: float = DROPOUT, seed: int = 0,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, and whether decoding gives the text again."""
    held, name = documents.sparkSession.sparkContext.broadcast(load(path)), uuid.uuid4().hex

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(name, held, dropout, seed)
        texts = part.column(1)
        ids, off = c.encode(texts, part.column(0).to_pylist())
        missing = texts.is_null()
        same = pa.array(c.restores(texts, ids, off), mask=missing.to_numpy(zero_copy_only=False))
        arrays = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=missing)
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(np.diff(off)), arrays, same],
            ["doc_id", "n_tokens", "ids", "lossless"])
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_texts(rows, fn, "doc_id long, n_tokens long, ids array<int>, lossless boolean")


def decode(encoded: DataFrame, path: str = MODEL, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and the text of every row's ids."""
    held, name = encoded.sparkSession.sparkContext.broadcast(load(path)), uuid.uuid4().hex

    def run(batches):
        for batch in batches:
            c = codec(name, held, 0.0, 0)
            out = [None if x is None else c.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])
    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(
        run, "doc_id long, text string")
