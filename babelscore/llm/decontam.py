"""Benchmark decontamination with one Aho-Corasick automaton.

The benchmark is normalised to words (A-Z in lower case; every other ASCII character that is no letter
or digit is a gap) and cut into windows: 13 consecutive words of an item; a shorter item is one window.

One automaton over words reads every document once. Its patterns are the short items and, for the
windows, anchors: every seventh run of seven words of an item. A window holds a whole anchor wherever it
lies, so each window's occurrences are among the places around the anchors found, where all 13 words are
compared with the benchmark's. An anchor of seven words stands for seven windows, so the automaton has
about one state per word of the benchmark, not thirteen, and a million windows fit one automaton.

The automaton is a set of flat arrays (a double array of states, failure and output links). A slice's
words pass through it in lanes, all lanes one word at a time (numpy); a lane starts a pattern's length
early, so its states are those of an unbroken reading, and a document's first word starts at the root.
Hits are word numbers, which map to offsets in the original text.

The benchmark is a test set and is held on the driver and in each worker, as numbers; the size of its
text is checked against ``max_benchmark_bytes`` (README has the memory it takes). No window is left out.
Words are compared by 64-bit hashes, windows word by word.

Edge cases: null text or text without words: no hits, not contaminated. Items without words or with
null text have no window. Repeated documents are judged one by one; repeated item ids count once; a
null item id counts as the empty string. Tables may be empty and may carry any further columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .collocations import placed
from .common import Texts, map_texts, window_hashes

WORDS = 13
LANES = 4096
STEPS = 64  # words of a lane, if there are fewer than LANES of them
_NORMAL = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_IS_GAP = np.array([not (b >= 128 or 48 <= b <= 57 or 97 <= b <= 122) for b in range(256)])
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])

RESULT = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
          T.StructField("items", T.ArrayType(T.StringType())), T.StructField("contaminated", T.BooleanType()),
          T.StructField("spans", T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType())))]


class Words:
    """Normalised words of a column of texts: byte spans, hashes, and each text's first word (n + 1)."""

    def __init__(self, column):
        self.texts = Texts(column)
        self.texts.data = _NORMAL[self.texts.data]
        self.starts, self.ends, self.first = self.texts.pieces(_IS_GAP[self.texts.data])
        self.h = self.texts.hashes(self.starts, self.ends)


class Automaton:
    """Aho-Corasick over rows of word codes (from 1; ``length`` of each row counts). States 1 to the
    largest code are the root's children, where ``first`` says so."""

    def __init__(self, codes: np.ndarray, length: np.ndarray):
        v = int(codes.max(initial=0))
        self.depth = int(length.max(initial=0))
        self.base, self.check = np.zeros(v + 1, dtype=np.int64), np.zeros(v + 1, dtype=np.int64)
        self.first = np.zeros(v + 1, dtype=bool)
        slot = codes[:, 0].astype(np.int64) if len(codes) else np.zeros(0, dtype=np.int64)
        self.first[slot] = True
        used = np.ones(v + 1, dtype=bool)
        levels = []
        for d in range(1, self.depth):
            on = np.flatnonzero(length > d)
            edge, inverse = np.unique(slot[on] << 32 | codes[on, d], return_inverse=True)
            parent, code = edge >> 32, edge & 0xFFFFFFFF
            begin = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
            many = np.diff(np.append(begin, len(edge)))
            used, base = placed(used, code, begin, many, v)
            one = np.flatnonzero(many == 1)
            free = np.flatnonzero(~used)[:len(one)]
            base[one] = free - code[begin[one]]
            used[free] = True
            child = np.repeat(base, many) + code
            top = max(len(self.base), int(child.max(initial=0)) + 1)
            self.base, self.check = (np.concatenate([x, np.zeros(top - len(x), dtype=np.int64)]) for x in (self.base, self.check))
            self.base[parent[begin]] = base
            self.check[child] = parent
            levels.append((child, parent, code))
            slot[on] = child[inverse]
        # A state's failure link, level by level; its output link leads to the nearest accepting state.
        self.fail = np.zeros(len(self.base), dtype=np.int64)
        accepts = np.zeros(len(self.base), dtype=bool)
        accepts[slot] = True
        self.pattern = np.full(len(self.base), -1, dtype=np.int32)
        self.pattern[slot] = np.arange(len(slot))
        self.out = np.where(accepts, np.arange(len(self.base)), 0)
        for child, parent, code in levels:
            self.fail[child] = self.step(self.fail[parent], code)
            self.out[child] = np.where(accepts[child], child, self.out[self.fail[child]])
        # Half the memory, once built.
        self.base, self.check, self.fail, self.out = (x.astype(np.int32) for x in (self.base, self.check, self.fail, self.out))

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states after a word each; code 0 is a word of no pattern."""
        out = np.zeros(len(state), dtype=np.int64)
        todo = np.flatnonzero(code > 0)
        state, code = state[todo], code[todo]
        while len(todo):
            root = state == 0
            then = np.where(root, code, self.base[state] + code).astype(np.int64)
            inside = (then > 0) & (then < len(self.check))
            then[~inside] = 0
            ok = np.where(root, self.first[code], inside & (self.check[then] == state))
            out[todo[ok]] = then[ok]
            on = ~ok & ~root
            todo, state, code = todo[on], self.fail[state[on]], code[on]
        return out

    def find(self, code: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last words and the patterns of all occurrences. ``starts`` marks words that begin a text."""
        n = len(code)
        if not n or not self.depth:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        steps = max(STEPS, -(-n // LANES))
        begin = np.arange(0, n, steps)
        early = self.depth - 1
        state = np.zeros(len(begin), dtype=np.int64)
        ends, states = [], []
        for k in range(-early, steps):
            at = begin + k
            ok = (at >= 0) & (at < n)
            now = np.where(ok, at, 0)
            state[starts[now]] = 0
            state = self.step(state, np.where(ok, code[now], 0))
            if k >= 0:
                hit = np.flatnonzero((self.out[state] > 0) & ok)
                if len(hit):
                    ends.append(at[hit])
                    states.append(self.out[state[hit]])
        if not ends:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        end, state = np.concatenate(ends), np.concatenate(states)
        found = []
        while len(end):
            found.append((end, self.pattern[state]))
            state = self.out[self.fail[state]]
            end, state = end[state > 0], state[state > 0]
        return tuple(np.concatenate(x) for x in zip(*found))


def grouped_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in an order that puts equal rows together, and each one's group."""
    order = np.lexsort(rows.T[::-1])
    new = np.zeros(len(rows), dtype=bool)
    new[1:] = (rows[order][1:] != rows[order][:-1]).any(axis=1)
    return order, np.cumsum(new)


class Benchmark:
    """The benchmark as arrays: vocabulary, words, windows with their items, and the automaton."""

    def __init__(self, item_ids: list, texts: list[str | None], words: int = WORDS):
        self.words, self.anchor = words, (words + 1) // 2
        names = {n: i for i, n in enumerate(dict.fromkeys("" if i is None else str(i) for i in item_ids))}
        self.names = list(names)
        item = np.array([names["" if i is None else str(i)] for i in item_ids], dtype=np.int64)
        w = Words(pa.array(texts, pa.large_string()))
        self.vocabulary, code, count = np.unique(w.h, return_inverse=True, return_counts=True)
        rank = np.empty(len(count), dtype=np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(1, len(count) + 1)  # common words have small codes
        self.code, self.ids = rank, rank[code].astype(np.int32)
        n = np.diff(w.first)
        owner = np.repeat(np.arange(len(texts)), n)
        place = np.arange(len(self.ids)) - w.first[:-1][owner]
        # Windows of 13 words, equal ones together.
        at = np.flatnonzero(place + words <= n[owner])
        rows = np.lib.stride_tricks.sliding_window_view(self.ids, words)[at] if len(at) else np.zeros((0, words), dtype=np.int32)
        order, group = grouped_rows(rows)
        start = at[order[np.flatnonzero(np.diff(group, prepend=-1))]]
        window_of, items_of = group, item[owner[at[order]]]
        # Short items are windows of their own, after those.
        short = np.flatnonzero((n > 0) & (n < words))
        padded = np.zeros((len(short), words), dtype=np.int32)
        for k, i in enumerate(short):
            padded[k, :n[i]] = self.ids[w.first[i]:w.first[i + 1]]
        s_order, s_group = grouped_rows(padded)
        s_first = s_order[np.flatnonzero(np.diff(s_group, prepend=-1))]
        window_of = np.concatenate([window_of, len(start) + s_group])
        items_of = np.concatenate([items_of, item[short[s_order]]])
        pairs = np.unique(window_of * len(self.names) + items_of) if len(window_of) else np.zeros(0, dtype=np.int64)
        self.items = pairs % max(len(self.names), 1)
        self.items_from = np.searchsorted(pairs // max(len(self.names), 1), np.arange(len(start) + len(s_first) + 1))
        # The long windows by hash.
        h = window_hashes(w.h, words)[start] if len(start) else np.zeros(0, dtype=np.uint64)
        by_hash = np.argsort(h, kind="stable")
        self.hash, self.window, self.start = h[by_hash], by_hash, start[by_hash]
        self.same = int(np.unique(self.hash, return_counts=True)[1].max(initial=1))
        # Patterns: anchors at multiples of their length, and the short items.
        on = np.flatnonzero((place % self.anchor == 0) & (place + self.anchor <= n[owner]) & (n[owner] >= words))
        anchors = np.zeros((len(on), words), dtype=np.int32)
        if len(on):
            anchors[:, :self.anchor] = np.lib.stride_tricks.sliding_window_view(self.ids, self.anchor)[on]
        a_order, a_group = grouped_rows(anchors)
        anchors = anchors[a_order[np.flatnonzero(np.diff(a_group, prepend=-1))]]
        both = np.concatenate([anchors, padded[s_first]])
        # A short item may be an anchor too.
        order, group = grouped_rows(both)
        firsts = np.flatnonzero(np.diff(group, prepend=-1))
        self.is_anchor, self.short = np.zeros(len(firsts), dtype=bool), np.full(len(firsts), -1, dtype=np.int64)
        self.is_anchor[group[order < len(anchors)]] = True
        is_short = order >= len(anchors)
        self.short[group[is_short]] = len(start) + order[is_short] - len(anchors)
        patterns = both[order[firsts]]
        self.length = (patterns > 0).sum(axis=1)
        self.automaton = Automaton(patterns, self.length)

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words, sizes and windows of all occurrences in a slice."""
        none = np.zeros(0, dtype=np.int64)
        if not len(w.h) or not len(self.vocabulary):
            return none, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, w.h), len(self.vocabulary) - 1)
        code = np.where(self.vocabulary[at] == w.h, self.code[at], 0)
        starts = np.zeros(len(code), dtype=bool)
        starts[w.first[:-1][w.first[:-1] < w.first[1:]]] = True
        end, pattern = self.automaton.find(code, starts)
        is_short = self.short[pattern] >= 0
        size = self.length[pattern][is_short]
        begin, windows = end[is_short] + 1 - size, self.short[pattern][is_short]
        # Around the anchors, 13 words that are a window.
        near = np.unique((end[self.is_anchor[pattern]] + 1 - self.anchor)[:, None] - np.arange(self.words - self.anchor + 1))
        near = near[(near >= 0) & (near + self.words <= len(code))]
        doc_end = w.first[np.searchsorted(w.first, near, side="right")]
        near = near[near + self.words <= doc_end]
        if len(near):
            h = window_hashes(w.h, self.words)[near]
            left = np.searchsorted(self.hash, h)
            for k in range(self.same):  # windows of one hash are told apart by their words
                at = left + k
                ok = np.flatnonzero(at < len(self.hash))
                ok = ok[self.hash[at[ok]] == h[ok]]
                span = np.arange(self.words)
                ok = ok[(self.ids[self.start[at[ok]][:, None] + span] == code[near[ok][:, None] + span]).all(axis=1)]
                begin, windows = np.concatenate([begin, near[ok]]), np.concatenate([windows, self.window[at[ok]]])
                size = np.concatenate([size, np.full(len(ok), self.words)])
        return begin, size, windows


def verdicts(column, benchmark: Benchmark) -> list[pa.Array]:
    """The result's columns for a slice of texts."""
    w = Words(column)
    n = w.texts.n
    n_words = np.diff(w.first)
    begin, size, window = benchmark.hits(w)
    n_hit, n_items = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    names, spans, span_of = [], np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=np.int64)
    if len(begin):
        cover = np.zeros(len(w.h) + 1, dtype=np.int64)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + size, -1)
        hit = np.cumsum(cover)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        n_hit = total[w.first[1:]] - total[w.first[:-1]]
        # Runs of hit words; a run ends with its document.
        edge = hit.copy()
        edge[1:] &= ~hit[:-1]
        edge[w.first[:-1][n_words > 0]] |= hit[w.first[:-1][n_words > 0]]
        first = np.flatnonzero(edge)
        last = np.flatnonzero(hit & np.append(~hit[1:] | edge[1:], True))
        span_of = np.searchsorted(w.first, first, side="right") - 1
        chars = w.texts.chars_before()
        spans = np.column_stack([chars[w.starts[first]], chars[w.ends[last]]]) - chars[w.texts.off[span_of]][:, None]
        doc = np.searchsorted(w.first, begin, side="right") - 1
        counts = benchmark.items_from[window + 1] - benchmark.items_from[window]
        pairs = np.unique(np.repeat(doc, counts) * len(benchmark.names)
                          + benchmark.items[np.repeat(benchmark.items_from[window] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())])
        of = pairs // len(benchmark.names)
        n_items = np.bincount(of, minlength=n)
        named = sorted(zip(of.tolist(), (benchmark.names[i] for i in (pairs % len(benchmark.names)).tolist())))
        names = [name for _, name in named]

    def offsets(counts: np.ndarray) -> pa.Array:
        return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    pieces = pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], fields=list(_SPAN))
    return [pa.array(n_words.astype(np.int64)), pa.array(n_hit), pa.array(n_items), pa.ListArray.from_arrays(offsets(n_items), pa.array(names, pa.string())),
            pa.array((n_hit > 0) & (20 * n_hit >= n_words)), pa.ListArray.from_arrays(offsets(np.bincount(span_of, minlength=n)), pieces)]


def contamination(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", words: int = WORDS,
                  max_benchmark_bytes: int = 64 << 20) -> DataFrame:
    """One row per document: word counts, items found, verdict and original spans of the hits."""
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _scanned(rows, "doc_id", benchmark, item_id, item_text, words, max_benchmark_bytes)


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
          item_text: str = "text", words: int = WORDS, max_benchmark_bytes: int = 64 << 20) -> DataFrame:
    """The documents, with all their columns, that are not contaminated."""
    rows = documents.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    found = _scanned(rows, "row", benchmark, item_id, item_text, words, max_benchmark_bytes)
    return found.filter(~F.col("contaminated")).select("row.*")


def _scanned(rows: DataFrame, carried: str, benchmark: DataFrame, item_id: str, item_text: str, words: int,
             max_benchmark_bytes: int) -> DataFrame:
    tests = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_benchmark_bytes:
        raise ValueError(f"benchmark holds {size} bytes of text, more than max_benchmark_bytes "
                         f"({max_benchmark_bytes}); it must fit on the driver")
    got = tests.collect()
    held = rows.sparkSession.sparkContext.broadcast(Benchmark([r[0] for r in got], [r[1] for r in got], words))
    schema = T.StructType([rows.schema[carried], *RESULT])

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), *verdicts(part.column(1), held.value)], [f.name for f in schema.fields])
    return map_texts(rows, fn, schema)
