"""Substring dedup by de Bruijn compaction.

A window of 20 words is an edge of the graph between the nodes of its first and its last 19 words.

1. Edges are counted in runs. The anchor of a window is the 6-word k-mer with the least hash in it, so
   equal windows have equal anchors, and consecutive windows with one anchor travel as one row (about one
   for eight words) to where their anchor is dealt. An anchor with one run text does not branch: its run
   is one element of the graph, and every occurrence but the first is repeated as a whole. An anchor with
   several run texts branches: the windows of each text's first occurrence are verified from its source
   coordinates, each an element of its own, and again every occurrence but the first is repeated.
2. The repeated elements, once each, get their end nodes from their source coordinates. In and out degrees
   are counted by node; an element leads on to the next one where the node between them has one of either.
   These nonbranching paths are compacted by Spark joins: pointer doubling gives every element its path's
   head and its offset there, in as many rounds as a path's length has binary digits.
3. Occurrences join their elements' paths. Where paths' offsets and a document's coordinates advance in
   step, occurrences merge into one long repeated span (``repeated_spans``); spans cover the words to go.

Rows of one key stream past in order; no group is gathered. Equal runs are combined within a task (up
to ``HELD`` of them), so that a passage in a third of all documents sends a few rows per task; runs of an
anchor seen to branch are dealt by run, not by anchor. In a round of pointer doubling every unfinished
pointer of a path is another one, so the joins have no hot key.

A word is removed if a repeated window covers it, judged on the input. Elements are compared by 128-bit
hashes. Texts travel compressed, twice. Documents are told apart by id and a 64-bit hash of the text.

Null text has no words. Rows with the same id are told apart by their text; a window is earlier by
id, then by start. Repeated rows (same id and text) get the same result each. A null id sorts first.
"""

from __future__ import annotations

import math
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (_BASE, _INVERSE, _powers, SLICE_BYTES, Texts, doc_key, materialise, mix, split_batch, window_hashes,
                     window_mask)

WINDOW = 20
ANCHOR = 6
HELD = 1 << 19  # runs combined in a task before they are shuffled
# What a shuffled row says. An element is (a, hn); it starts at a document's word and has n windows.
OCCURS, BRANCHES, SIGNAL, DONE, REPEATED, ELEMENT, FIRST, CHECK = range(8)
AGAIN = 8  # added to OCCURS or BRANCHES: has occurred more than once in its task
COLUMNS = ["a", "hn", "doc", "tie", "start", "n", "kind", "u", "v"]
ROWS = "a long, hn long, doc long, tie long, start int, n int, kind byte, u long, v long"
TYPES = [np.int64] * 4 + [np.int32] * 2 + [np.int8] + [np.int64] * 2


def runs_of_text(t: Texts, window: int, k: int):
    """Anchor, text hash, document, start word and windows of every run of a slice."""
    starts, ends, first = t.words()
    h = t.hashes(starts, ends)
    at = np.flatnonzero(window_mask(first, len(h), window))
    if not len(at):
        return None
    grams = window_hashes(h, k)
    least = np.lib.stride_tricks.sliding_window_view(grams, window - k + 1).argmin(axis=1)
    anchor = (least + np.arange(len(least)))[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(anchor) != 0) | (np.diff(at) != 1)
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(at)))
    s, anchor = at[begin], grams[anchor[begin]]
    e = s + n + window - 1
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * _powers(_BASE, len(h)), out=total[1:])
    text = mix((total[e] - total[s]) * _powers(_INVERSE, len(h) + 1)[s] + (e - s).astype(np.uint64))
    doc = np.searchsorted(first, s, side="right") - 1
    return anchor.view(np.int64), text.view(np.int64), doc, s - first[doc], n


def batch_of(columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, dtype=t)) for c, t in zip(columns, TYPES)], COLUMNS)


def sorted_runs(a, hn, doc, tie, start):
    """First rows of anchors and of elements in sorted rows, each row's element's first row, and the
    rows that stand later than that."""
    new_a = np.ones(len(a), dtype=bool)
    new_a[1:] = a[1:] != a[:-1]
    new_e = new_a.copy()
    new_e[1:] |= hn[1:] != hn[:-1]
    lead = np.flatnonzero(new_e)[np.cumsum(new_e) - 1]
    return new_a, new_e, lead, (doc != doc[lead]) | (start != start[lead])


class Combiner:
    """Combines equal elements within a task before the shuffle."""

    def __init__(self):
        self.rows: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, a, hn, doc, tie, start, n, u=None, v=None):
        if len(a):
            zero = np.zeros(len(a), dtype=np.int64)
            self.rows.append([a, hn, doc, tie, start, n, zero if u is None else u, zero if v is None else v])
            self.size += len(a)
        if self.size >= HELD:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        a, hn, doc, tie, start, n, u, v = (np.concatenate(x) for x in zip(*self.rows))
        self.rows, self.size = [], 0
        order = np.lexsort((tie, start, doc, hn, a))
        a, hn, doc, tie, start, n, u, v = (x[order] for x in (a, hn, doc, tie, start, n, u, v))
        new_a, new_e, lead, again = sorted_runs(a, hn, doc, tie, start)
        begin = np.flatnonzero(new_a)
        n_elements = np.add.reduceat(new_e.astype(np.int64), begin)[np.cumsum(new_a) - 1]
        branch = (n_elements > 1) & ~again
        kind = np.where(branch, BRANCHES, OCCURS)
        kind[np.unique(lead[again])] += AGAIN
        # Two elements tell the anchor's other rows, wherever they are, that it branches.
        place = np.cumsum(new_e) - np.repeat((np.cumsum(new_e) - new_e)[new_a], np.diff(np.append(begin, len(a))))
        signal = new_e & branch & (place <= 2)
        columns = (a, hn, doc, tie, start, n, kind, u, v)
        out = [[x[~again], x[signal]] for x in columns]
        out[6][1] = np.full(int(signal.sum()), SIGNAL)
        if again.any():
            # Repeated runs that follow each other in a document as in their source become one.
            at, source = np.flatnonzero(again), lead[again]
            order = np.lexsort((start[at], tie[at], doc[at]))
            at, source = at[order], source[order]
            ends = start[at] + n[at]
            follows = ((doc[at][1:] == doc[at][:-1]) & (tie[at][1:] == tie[at][:-1]) & (start[at][1:] == ends[:-1])
                       & (doc[source][1:] == doc[source][:-1]) & (tie[source][1:] == tie[source][:-1])
                       & (np.diff(start[source]) == np.diff(start[at])))
            head = np.flatnonzero(np.append(True, ~follows))
            spans = [x[at[head]] for x in columns]
            spans[5] = np.add.reduceat(n[at], head)
            spans[6] = np.full(len(head), REPEATED)
            for x, y in zip(out, spans):
                x.append(y)
        return batch_of([np.concatenate(x) for x in out])

    def rest(self):
        if self.size:
            yield self.flush()


def dealt(rows: DataFrame) -> DataFrame:
    """By anchor; rows whose verdict does not depend on the anchor's other rows are spread."""
    to: Column = (F.when(F.col("kind").isin(BRANCHES, BRANCHES + AGAIN, ELEMENT), F.xxhash64("a", "hn"))
                  .when(F.col("kind") == REPEATED, F.xxhash64("doc", "start")).otherwise(F.col("a")))
    return rows.repartition(to).sortWithinPartitions("a", "hn", "doc", "start", "tie")


def resolve(batches):
    """Sorted rows to REPEATED occurrences, FIRST occurrences of repeated elements, and first occurrences
    of branching ones to CHECK."""
    held = [np.zeros(0, dtype=t) for t in TYPES]
    for batch in batches:
        got = [batch.column(i).to_numpy() for i in range(9)]
        known = (got[6] == REPEATED) | (got[6] == ELEMENT)
        if known.any():
            yield batch_of([x[known] for x in got])
        rows = [np.concatenate([h, g[~known]]) for h, g in zip(held, got)]
        a, hn, doc, tie, start, _, kind = rows[:7]
        if not len(a):
            continue
        new_a, new_e, lead, again = sorted_runs(a, hn, doc, tie, start)
        begin = np.flatnonzero(new_a)
        group = np.cumsum(new_a) - 1
        says = kind & 7
        branching = (np.add.reduceat(new_e.astype(np.int64), begin) > 1)[group] | (says == BRANCHES)
        real = (says == OCCURS) | (says == BRANCHES)
        # An element with a later occurrence here, or with two in one task.
        twice = np.unique(lead[(again & real) | (kind >= AGAIN)])
        for which, said in ((again & real, REPEATED), (twice, FIRST), (~again & real & branching, CHECK)):
            picked = [x[which] for x in rows]
            if len(picked[0]):
                picked[6] = np.full(len(picked[0]), said)
                yield batch_of(picked)
        # The last anchor goes on in the next batch: keep what its rows must be compared with.
        last = begin[-1]
        firsts = np.flatnonzero(new_e[last:]) + last
        if len(firsts) == 1:  # not known to branch: its first occurrences still wait
            keep = last + np.flatnonzero(~again[last:])
            kind = np.where(branching & real, DONE, says)
        else:
            keep = firsts[-2:]
            kind = np.full(len(a), DONE)
        held = [x[keep] for x in (*rows[:6], kind.astype(np.int8), *rows[7:])]


# -- the graph -----------------------------------------------------------------------------------

def linked(elements: DataFrame) -> DataFrame:
    """id, before, n_before: elements that another one leads on to, over a node of in and out degree one."""
    into = elements.groupBy(F.col("v").alias("node")).agg(F.count(F.lit(1)).alias("ins"), F.min("id").alias("before"), F.min("n").alias("n_before"))
    out = elements.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("outs"), F.min("id").alias("id"))
    return (into.filter("ins = 1").join(out.filter("outs = 1"), "node").filter("id != before")
            .select("id", "before", F.col("n_before").cast("long").alias("n_before")))


def ranked(links: DataFrame, name: str) -> DataFrame:
    """id, path (the head's id) and offset (windows from the head) of linked elements, by pointer doubling;
    elements on a circle have no head and stay out."""
    heads = links.select(F.col("before").alias("id")).join(links.select("id"), "id", "left_anti")
    now = materialise(links.select("id", F.col("before").alias("to"), F.col("n_before").alias("offset"), F.lit(False).alias("done"))
                      .unionByName(heads.select("id", F.col("id").alias("to"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("done"))), name)
    total = now.count()
    for _ in range(math.ceil(math.log2(max(total, 2))) + 1):
        if not now.filter("not done").limit(1).count():
            break
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("offset").alias("more"), F.col("done").alias("end"))
        moved = now.filter("not done").join(ahead, "to").select("id", F.col("next").alias("to"), (F.col("offset") + F.col("more")).alias("offset"),
                                                                F.col("end").alias("done"))
        now = materialise(now.filter("done").unionByName(moved), name)
    return now.filter("done").select("id", F.col("to").alias("path"), "offset")


def compacted(elements: DataFrame) -> DataFrame:
    """a, hn, path and offset of the repeated elements; one by itself is a path of its own."""
    numbered = materialise(elements.dropDuplicates(["a", "hn"]).select("a", "hn", "n", "u", "v", F.monotonically_increasing_id().alias("id")),
                           "dedup-elements")
    places = ranked(linked(numbered), "dedup-ranks")
    return numbered.join(places, "id", "left").select("a", "hn", F.coalesce("path", "id").alias("path"), F.coalesce("offset", F.lit(0)).alias("offset"))


def in_step(doc: np.ndarray, start: np.ndarray, n: np.ndarray, path: np.ndarray, offset: np.ndarray):
    """Occurrences merged where path and document advance in step: doc, start, n, path, offset."""
    if not len(start):  # a slice without a repeat
        return doc, start, n, path, offset
    order = np.lexsort((start, start - offset, path, doc))
    doc, start, n, path, offset = (x[order] for x in (doc, start, n, path, offset))
    same = (doc[1:] == doc[:-1]) & (path[1:] == path[:-1]) & (np.diff(start - offset) == 0)
    # Within one document, path and step starts ascend; the furthest end so far is the stretch's. Stretches
    # are set so far apart that one running maximum serves them all.
    stretch = np.cumsum(np.append(False, ~same))[:len(start)]
    apart = int((start + n).max(initial=0)) + 1
    ends = np.maximum.accumulate(start + n + stretch * apart) - stretch * apart
    new = np.ones(len(start), dtype=bool)
    new[1:] = ~same | (start[1:] > ends[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(start)) - 1
    return doc[head], start[head], ends[last] - start[head], path[head], offset[head]


# -- the job -------------------------------------------------------------------------------------

def per_document(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of each document together: no more of them than the document has windows."""
    return rows.groupBy("doc", "tie").agg(F.collect_list(F.struct(*columns)).alias("found"))


def prepared(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    # The tie tells rows with the same id apart.
    return documents.select(doc_key(doc_id).alias("doc"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))


def packed_texts(docs: DataFrame) -> DataFrame:
    def compact(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in split_batch(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1),
                     pa.array([pack.compress((t or "").encode()) for t in part.column(2).to_pylist()], pa.binary())],
                    ["doc", "tie", "packed"])
    return docs.mapInArrow(compact, "doc long, tie long, packed binary")


def unpacked(batches):
    """From batches of doc, tie, packed and found: (doc, tie) of some rows whose texts hold about a
    slice, the texts, all their found structs, and the row of each."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        doc, tie = get["doc"].to_numpy(), get["tie"].to_numpy()
        texts, size, begin = [], 0, 0
        for i, p in enumerate(get["packed"].to_pylist()):
            texts.append(unpack.decompress(p))
            size += len(texts[-1])
            if size < SLICE_BYTES and i + 1 < batch.num_rows:
                continue
            found = get["found"].slice(begin, len(texts))
            counts = np.nan_to_num(pc.list_value_length(found).to_numpy(zero_copy_only=False)).astype(np.int64)
            yield ((doc[begin:i + 1], tie[begin:i + 1]), pa.array(texts, pa.large_binary()).cast(pa.large_string()), found.flatten(),
                   np.repeat(np.arange(len(texts)), counts))
            texts, size, begin = [], 0, i + 1


def occurrences(docs: DataFrame, texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """doc, tie, start, n of the repeated occurrences, with their elements' path and offset."""
    if window - anchor + 1 > 15:
        raise ValueError("a run must have at most 15 windows")

    def all_runs(batches):
        combined = Combiner()
        for batch in batches:
            for part in split_batch(batch, "text"):
                found = runs_of_text(Texts(part.column(2)), window, anchor)
                if found is not None:
                    key, text_hash, d, start, n = found
                    doc, tie = (part.column(i).to_numpy()[d] for i in (0, 1))
                    yield from combined.add(key, text_hash, doc, tie, start, n)
        yield from combined.rest()

    def at_sources(batches):
        """End nodes of repeated elements, and every window of the runs to check."""
        combined = Combiner()
        for docs_of, texts_of, found, owner in unpacked(batches):
            doc, tie = docs_of
            t = Texts(texts_of)
            starts, ends, first_word = t.words()
            h = t.hashes(starts, ends)
            kind, a, hn, start, n = (found.field(k).to_numpy() for k in range(5))
            at, n = first_word[owner] + start, n.astype(np.int64)
            nodes = np.lib.stride_tricks.sliding_window_view(h, window - 1)
            first = np.flatnonzero(kind == FIRST)
            if len(first):
                yield batch_of([a[first], hn[first], doc[owner[first]], tie[owner[first]], start[first], n[first], np.full(len(first), ELEMENT),
                                node_hash(nodes[at[first]]), node_hash(nodes[at[first] + n[first]])])
            s, n = at[kind == CHECK], n[kind == CHECK]
            at = np.unique(np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum()))
            if not len(at):
                continue
            of = np.searchsorted(first_word, at, side="right") - 1
            view = np.lib.stride_tricks.sliding_window_view(h, window)[at]
            one, two = sequence_hash(view, 0x9E3779B97F4A7C15), sequence_hash(view, 0xC2B2AE3D27D4EB4F)
            yield from combined.add(one.view(np.int64), two.view(np.int64), doc[of], tie[of], at - first_word[of],
                                    np.ones(len(at), dtype=np.int64), node_hash(nodes[at]), node_hash(nodes[at + 1]))
        yield from combined.rest()

    by_run = materialise(dealt(docs.mapInArrow(all_runs, ROWS)).mapInArrow(resolve, ROWS), "dedup-runs")
    wanted = per_document(by_run.filter(F.col("kind").isin(FIRST, CHECK)), "kind", "a", "hn", "start", "n")
    sources = wanted.join(texts, ["doc", "tie"]).dropDuplicates(["doc", "tie"])
    by_window = materialise(dealt(sources.mapInArrow(at_sources, ROWS)).mapInArrow(resolve, ROWS), "dedup-windows")
    paths = compacted(by_window.filter(F.col("kind").isin(ELEMENT, FIRST)))
    repeated = by_run.unionByName(by_window).filter(F.col("kind") == REPEATED).select("a", "hn", "doc", "tie", "start", "n")
    return repeated.join(paths, ["a", "hn"], "left").select("doc", "tie", "start", "n", F.coalesce("path", F.lit(-1)).alias("path"),
                                                            F.coalesce("offset", F.lit(0)).alias("offset"))


def merged_spans(found: pa.StructArray, owner: np.ndarray):
    """Rows' occurrences (structs) as long spans: row, start, n, path, offset."""
    return in_step(owner, *(found.field(k).to_numpy().astype(np.int64) for k in range(4)))


def repeated_spans(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                   anchor: int = ANCHOR) -> DataFrame:
    """The long repeated spans: doc_id, start and n_words (in words), path and offset (in windows; the same
    path at the same offset is the same text). Repeated rows have their spans once."""
    docs = prepared(documents, doc_id, text)

    def run(batches):
        for batch in batches:
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(2)).to_numpy())
            row, start, n, path, offset = merged_spans(batch.column(2).flatten(), owner)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[row]), pa.array(start), pa.array(n + window - 1), pa.array(path),
                                              pa.array(offset)], ["doc", "start", "n_words", "path", "offset"])
    found = per_document(occurrences(docs, packed_texts(docs), window, anchor), "start", "n", "path", "offset")
    out = found.mapInArrow(run, "doc long, start long, n_words long, path long, offset long")
    return out.select(F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias("doc_id"), "start", "n_words", "path", "offset")


def removed_words(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                  anchor: int = ANCHOR) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, joined by a space)."""
    docs = prepared(documents, doc_id, text)
    texts = packed_texts(docs)
    found = per_document(occurrences(docs, texts, window, anchor), "start", "n", "path", "offset")

    def cut(batches):
        for (doc, _), texts_of, found, owner in unpacked(batches):
            row, start, n, _, _ = merged_spans(found, owner)
            from_row = np.searchsorted(row, np.arange(len(doc) + 1))
            n_words, n_removed, kept = [], [], []
            for i, text in enumerate(texts_of.cast(pa.large_binary()).to_pylist()):  # bytes split at ASCII space only
                words = text.split()
                n_words.append(len(words))
                gone = 0
                if from_row[i] < from_row[i + 1]:
                    mine = slice(from_row[i], from_row[i + 1])
                    mark = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(mark, start[mine], 1)
                    np.add.at(mark, start[mine] + n[mine] + window - 1, -1)
                    keep = np.cumsum(mark)[:-1] == 0
                    gone = len(words) - int(keep.sum())
                    words = list(compress(words, keep.tolist()))
                n_removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                                             ["doc", "n_words", "n_removed", "kept"])

    out = (texts.join(found, ["doc", "tie"], "left").select("doc", "tie", "packed", "found")
           .mapInArrow(cut, "doc long, n_words long, n_removed long, kept string"))
    return out.select(F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept")


def sequence_hash(view: np.ndarray, multiplier: int) -> np.ndarray:
    out = np.zeros(len(view), dtype=np.uint64)
    for i in range(view.shape[1]):
        out = out * np.uint64(multiplier) + view[:, i]
    return mix(out)


def node_hash(view: np.ndarray) -> np.ndarray:
    return sequence_hash(view, 0x9FB21C651E98DF25).view(np.int64)
