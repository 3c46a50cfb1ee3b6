"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line with a word gets features of its own and of the lines before and after it; the chain
labels each line good or bad, and forward-backward gives each line's probability of being good. A
document's score is the mean of these, weighted by the lines' word characters.

Only documents are labelled, so line labels are latent. They are learnt by expectation maximisation
under a constraint on each document's posterior: of a label-1 document at least ``GOOD_SHARE`` of the
weight is expected in good lines, of a label-0 document at least ``BAD_SHARE`` in bad ones; which lines
those are is for the chain to say (a junk document's clean title may be good). Half of the training
sequences are two documents one after the other, each under its own constraint, so that the chain sees
labels change.

Training is on a bounded, documented sample: the ``max_docs`` labelled documents that come first by
a hash of their id, of which those with at most ``max_lines`` lines are used (a limit on training
only; scoring reads every line). Features and weights are small and of fixed width; the weights are
broadcast.

Null or empty text, or text without words, is one empty line, so it has a score too. With nothing to
learn from (or one label only) the weights are zero and every score is 0.5. Rows with a null label or
id are not learnt from; a document labelled twice counts twice. Repeated documents are scored one by
one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_LEAD, IS_SPACE, Texts, hash_sample, map_texts, window_hashes, window_mask
from .langid import held_out
from .quality_rules import repeated

MAX_DOCS = 4000
MAX_LINES = 400
ROUNDS, STEPS = 4, 50  # of expectation maximisation, and of the gradient in each
GOOD_SHARE, BAD_SHARE = 0.95, 0.8
PAIRED_LINES = 100
LIKELY = 0.7  # a score from here on is a prediction of label 1


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _mask("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _mask("0123456789")
_STOP = _mask(".,;:?")
_SHOUT = _mask("!")
_PIPE = _mask("|")
_SYMBOL = _mask("#*$%&<>@^~=+_\\/{}[]")
OWN = 13  # features of a line by itself
WIDTH = 3 * OWN + 3  # with both neighbours, whether it is first or last, and a constant


def line_features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their weights, and the index of each document's first line (n + 1)."""
    t = Texts(column)
    gap = IS_SPACE[t.data]
    word_s, word_e, word_first = t.pieces(gap)
    s, e, _ = t.pieces(t.data == 0x0A)
    w0, w1 = np.searchsorted(word_s, s), np.searchsorted(word_s, e)
    full = w1 > w0
    s, e, w0, w1 = s[full], e[full], w0[full], w1[full]
    doc = np.searchsorted(t.off, s, side="right") - 1

    def sums(marks: np.ndarray) -> np.ndarray:
        total = np.zeros(len(marks) + 1, dtype=np.int64)
        np.cumsum(marks, out=total[1:])
        return (total[e] - total[s]).astype(np.float64)

    lead = IS_LEAD[t.data] & ~gap
    chars = sums(lead)
    upper, lower = sums(_UPPER[t.data]), sums(_LOWER[t.data])
    words = (w1 - w0).astype(np.float64)
    # Share of the line's words in three-word runs that the document repeats.
    h = t.hashes(word_s, word_e)
    at = np.flatnonzero(window_mask(word_first, len(h), 3))
    owner = np.repeat(np.arange(t.n), np.diff(word_first))
    twice = at[repeated(window_hashes(h, 3)[at], owner[at], also_first=True)]
    hit = np.zeros(len(h) + 3, dtype=np.int64)
    for k in range(3):
        hit[twice + k + 1] = 1
    hit = np.cumsum(hit)
    own = np.zeros((len(s), OWN))
    own[:, 0] = np.log1p(words) / 5
    own[:, 1] = chars / words / 10
    own[:, 2] = upper / np.maximum(upper + lower, 1)
    for i, m in enumerate((_DIGIT, _STOP, _SHOUT, _PIPE, _SYMBOL), 3):
        own[:, i] = sums(m[t.data]) / chars
    own[:, 8] = np.minimum(sums(_SYMBOL[t.data] | _SHOUT[t.data] | _PIPE[t.data]) / words, 2)
    own[:, 9] = _STOP[t.data[word_e[w1 - 1] - 1]]
    own[:, 10] = repeated(t.hashes(s, e), doc, also_first=True)
    own[:, 11] = (hit[w1] - hit[w0]) / words
    own[:, 12] = sums(t.data >= 0xC0) / chars
    # A document without words is one empty line.
    empty = np.flatnonzero(np.bincount(doc, minlength=t.n) == 0)
    order = np.argsort(np.concatenate([doc, empty]), kind="stable")
    own = np.concatenate([own, np.zeros((len(empty), OWN))])[order]
    weight = np.concatenate([chars, np.ones(len(empty))])[order]
    doc = np.concatenate([doc, empty])[order]
    first = np.searchsorted(doc, np.arange(t.n + 1))
    return with_neighbours(own, first), weight, first


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after, whether a line is first or last, a constant."""
    starts, ends = np.zeros(len(own), dtype=bool), np.zeros(len(own), dtype=bool)
    starts[first[:-1]] = True
    ends[first[1:] - 1] = True
    out = np.zeros((len(own), WIDTH))
    out[:, :OWN] = own
    out[1:, OWN:2 * OWN] = np.where(starts[1:, None], 0, own[:-1])
    out[:-1, 2 * OWN:3 * OWN] = np.where(ends[:-1, None], 0, own[1:])
    out[:, -3], out[:, -2], out[:, -1] = starts, ends, 1
    return out


def chain(emission: np.ndarray, turn: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all documents at once, longest first. ``emission`` is the good label's
    score minus the bad one's; ``turn[a, b]`` the score of label b after a. Returns every line's
    probability of good, the expected label pairs, and the sum of the log partition functions."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    steps = int(size[0]) if len(size) else 0
    going = [int(np.searchsorted(-size, -t, side="left")) for t in range(steps)]  # documents longer than t
    both = np.column_stack([np.zeros(len(emission)), emission])
    fwd, bwd = np.zeros_like(both), np.zeros_like(both)
    for t in range(steps):
        at = start[:going[t]] + t
        fwd[at] = both[at]
        if t:
            fwd[at] += np.logaddexp(fwd[at - 1, :1] + turn[0], fwd[at - 1, 1:] + turn[1])
    for t in range(steps - 2, -1, -1):
        at = start[:going[t + 1]] + t
        nxt = bwd[at + 1] + both[at + 1]
        bwd[at] = np.logaddexp(nxt[:, :1] + turn[:, 0], nxt[:, 1:] + turn[:, 1])
    total = fwd + bwd
    z = np.logaddexp(total[:, 0], total[:, 1])
    inner = np.ones(len(emission), dtype=bool)
    inner[first[:-1]] = False  # lines with a line before them
    at = np.flatnonzero(inner)
    pair = np.exp(fwd[at - 1][:, :, None] + turn[None] + (both[at] + bwd[at])[:, None, :] - z[at][:, None, None])
    return np.exp(total[:, 1] - z), pair.sum(axis=0), float(z[first[:-1]].sum())


def ascend(theta: np.ndarray, x: np.ndarray, y: np.ndarray, seen: np.ndarray, first: np.ndarray, steps: int, decay: float = 1e-4) -> np.ndarray:
    """Weights and turns by Adam on the mean log-likelihood of expected labels y and label pairs ``seen``."""
    lines = max(len(x), 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        p, pairs, _ = chain(x @ theta[:-4], theta[-4:].reshape(2, 2), first)
        grad = np.concatenate([x.T @ (y - p), (seen - pairs).reshape(-1)]) / lines - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.2 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return theta


def expected_labels(theta: np.ndarray, x: np.ndarray, first: np.ndarray, part: np.ndarray, label: np.ndarray, weight: np.ndarray):
    """Posterior line labels and label pairs in which every part (a document) has its share of good lines:
    a push on the part's emissions, no larger than it must be (bisection for all parts at once)."""
    emission, turn = x @ theta[:-4], theta[-4:].reshape(2, 2)
    total = np.bincount(part, weights=weight)
    side = np.where(label == 1, 1.0, -1.0)
    wanted = np.where(label == 1, GOOD_SHARE, 1 - BAD_SHARE)

    def run(push: np.ndarray):
        p, pairs, _ = chain(emission + (side * push)[part], turn, first)
        short = side * (wanted - np.bincount(part, weights=weight * p) / total) > 0  # the share is not reached
        return p, pairs, short
    low, high = np.zeros(len(label)), np.full(len(label), 40.0)
    p, pairs, short = run(low)
    if not short.any():
        return p, pairs
    high[~short] = 0
    for _ in range(10):
        mid = (low + high) / 2
        short = run(mid)[2] & (high > 0)
        low, high = np.where(short, mid, low), np.where(short, high, mid)
    return run(high)[:2]


def fit(own: list[np.ndarray], label: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and turns from documents' line features and labels."""
    rng = np.random.default_rng(seed)
    order = rng.permutation([k for k, o in enumerate(own) if len(o) <= PAIRED_LINES])  # longer ones go alone
    pairs = [(int(a), int(b)) for a, b in zip(order[::2], order[1::2])]
    sequences = [(k,) for k in range(len(own))] + pairs
    part_of = [k for s in sequences for k in s]
    sizes = np.array([len(own[k]) for k in part_of])
    x_own = np.concatenate([own[k] for k in part_of])
    part = np.repeat(np.arange(len(part_of)), sizes)
    first = np.concatenate([[0], np.cumsum([sum(len(own[k]) for k in s) for s in sequences])])
    x = with_neighbours(x_own, first)
    weight = np.maximum(10 * x_own[:, 1] * np.expm1(5 * x_own[:, 0]), 1.0)  # word characters, from the features
    labels = label[part_of]
    y = labels[part].astype(np.float64)
    inner = np.ones(len(x), dtype=bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[part][at - 1], labels[part][at]), 1)
    theta = np.zeros(WIDTH + 4)
    for k in range(rounds):
        if k:
            y, seen = expected_labels(theta, x, first, part, labels, weight)
        theta = ascend(theta, x, y, seen, first, steps)
    return theta[:-4], theta[-4:].reshape(2, 2)


def train(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label: str = "quality", max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> tuple[np.ndarray, np.ndarray]:
    usable = labels.select(F.col(doc_id).cast("long").alias("l_id"), F.col(label).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & F.col("l_id").isNotNull() & ~held_out("l_id"))
    picked = hash_sample(usable, max_docs, "l_id", "label")  # the broadcast's bound
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sample = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("l_id")).select("doc_id", "label", "text")

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        x, _, first = line_features(part.column(2))
        rows = [x[a:b, :OWN].astype(np.float32).tobytes() if b - a <= max_lines else None for a, b in zip(first, first[1:])]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())],
                                          ["doc_id", "label", "x"])

    rows = (map_texts(sample, fn, "doc_id long, label int, x binary").filter("x is not null")
            .orderBy("doc_id", "label", F.xxhash64("x")).limit(max_docs).collect())
    own = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, OWN).astype(np.float64) for r in rows]
    label = np.array([r["label"] for r in rows])
    if len(set(label.tolist())) < 2:
        return np.zeros(WIDTH), np.zeros((2, 2))
    return fit(own, label)


def line_labels(column, model: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """For every text, each worded line's probability of being good."""
    x, _, first = line_features(column)
    good = chain(x @ model[0], model[1], first)[0] if len(x) else np.zeros(0)
    return [good[a:b] for a, b in zip(first, first[1:])]


def score_column(column, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    x, weight, first = line_features(column)
    if not len(x):
        return np.zeros(0)
    good, _, _ = chain(x @ model[0], model[1], first)
    return np.clip(np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]), 0.0, 1.0)


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """One row per document: doc_id, score, predicted."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        s = score_column(part.column(1), held.value)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= LIKELY).astype(np.int32))],
                                          ["doc_id", "score", "predicted"])
    return map_texts(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), fn,
                     "doc_id long, score double, predicted int")
