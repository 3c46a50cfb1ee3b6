"""Quality rules with thresholds learnt from mergeable quantile sketches.

Counts per document come from one numpy pass. Each metric is binned (integer arithmetic), and a
sketch is the histogram of a metric's bins for a language and source: sketches merge by adding
counts, and a quantile is exact to one bin. Ratios have bins of 1/1000; mean word length has bins of
1/20 character. The highest bins fall together at ``MOST``, so a sketch is bounded. Partial aggregation
merges them before the shuffle, so a source with a third of all documents sends a few rows per task. A
single symbol or a single repeated line is no rate yet: these are counted from the second on.

A metric's fence is an upper quantile (``METRICS``: 0.8 or 0.9, or 0.99 where clean documents have a long
tail) plus ``REACH`` times its distance from the median, and likewise below for mean word length. All
quantiles are those of the group shrunk towards the language's, merged from all its sources: n documents
of the group weigh n, the language weighs ``SHRINK``, at every size of group. The distance is two bins
at least. Documents that fail the base rule do not enter the sketches.

A document is kept if it passes the base rule and lies inside every fence of its group. Null text
counts as empty (fails the base rule). Null language or source is a group of its own. Repeated rows
are judged, and counted in the sketches, one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import IS_LEAD, IS_SPACE, Texts, map_texts, materialise, mix, window_hashes, window_mask

REACH = 3
SHRINK = 20
LEAST_SPREAD = 2  # bins
MOST = 4000
# metric: (counted, out of, bins per unit, upper quantile and lower quantile in thousandths)
METRICS = {
    "word_length": ("word_chars", "n_words", 20, 900, 100),
    "symbols": ("greatest(n_symbols - 1, 0)", "word_chars", 1000, 800, None),
    "dup_lines": ("greatest(n_dup_lines - 1, 0)", "n_lines", 1000, 990, None),
    "repeats": ("n_repeat_words", "n_words", 1000, 990, None),
}
MEDIAN = 500
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def text_counts(column) -> dict[str, np.ndarray]:
    """The counts of each text of an Arrow column."""
    t = Texts(column)
    gap = IS_SPACE[t.data]
    starts, ends, first = t.pieces(gap)
    n_words = np.diff(first)
    out = {"n_words": n_words, "word_chars": t.per_doc(IS_LEAD[t.data] & ~gap), "n_symbols": t.per_doc(_SYMBOL[t.data])}

    line_s, line_e, line_first = t.pieces(t.data == 0x0A)
    has_word = np.searchsorted(starts, line_e) > np.searchsorted(starts, line_s)
    line_doc = np.repeat(np.arange(t.n), np.diff(line_first))[has_word]
    line_hash = t.hashes(line_s[has_word], line_e[has_word])
    out["n_lines"] = np.bincount(line_doc, minlength=t.n)
    same = repeated(line_hash, line_doc)
    out["n_dup_lines"] = np.bincount(line_doc[same], minlength=t.n)

    h = t.hashes(starts, ends)
    ok = window_mask(first, len(h), 3)
    at = np.flatnonzero(ok)
    doc = np.repeat(np.arange(t.n), n_words)
    key = window_hashes(h, 3)[at]
    twice = at[repeated(key, doc[at], also_first=True)]
    hit = np.zeros(len(h) + 2, dtype=bool)
    for k in range(3):
        hit[twice + k] = True
    out["n_repeat_words"] = np.bincount(doc[hit[:len(h)]], minlength=t.n)
    return out


def repeated(h: np.ndarray, doc: np.ndarray, also_first: bool = False) -> np.ndarray:
    """Values equal to an earlier one of the same document (or to any other, if ``also_first``)."""
    out = np.zeros(len(h), dtype=bool)
    if len(h) < 2:
        return out
    key = mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    out[order[1:][equal]] = True
    if also_first:
        out[order[:-1][equal]] = True
    return out


def counted(documents: DataFrame, doc_id: str, text: str, lang: str, source: str) -> DataFrame:
    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        c = text_counts(part.column(1))
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(2), part.column(3)] + [pa.array(c[k].astype(np.int64)) for k in COUNTS],
            ["doc_id", "lang", "source", *COUNTS])
    cols = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
            F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source")]
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{k} long" for k in COUNTS)
    rows = map_texts(documents.select(*cols), fn, schema)
    # The base rule, written without division.
    return rows.withColumn("base_failed", (F.col("n_words") < 50)
                           | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def bin_of(name: str) -> Column:
    count, total, scale, _, _ = METRICS[name]
    return F.expr(f"case when {total} > 0 then least(({scale} * {count}) div {total}, {MOST}) else 0 end")


def levels(name: str) -> list[int]:
    """The quantiles of a metric that its fences need."""
    return [q for q in (*METRICS[name][3:], MEDIAN) if q is not None]


def fences(counts: DataFrame, shrink: int = SHRINK) -> DataFrame:
    """lang, source, and an upper (and lower) fence in bins for each metric; and for how many of the
    fences the least spread decided."""
    # One sketch row per group, metric and bin.
    bins = F.array(*[F.struct(F.lit(m).alias("metric"), bin_of(m).alias("bin")) for m in METRICS])
    sketch = (counts.filter(~F.col("base_failed")).select("lang", "source", F.explode(bins).alias("b"))
              .groupBy("lang", "source", "b.metric", "b.bin").agg(F.count(F.lit(1)).alias("n")))
    by_source = _quantiles(sketch, ["lang", "source"])
    by_lang = _quantiles(sketch.groupBy("lang", "metric", "bin").agg(F.sum("n").alias("n")), ["lang"])
    l_ = by_lang.select(F.col("lang").alias("l"), *[F.col(c).alias(f"l_{c}") for c in by_lang.columns if c != "lang"])
    joined = by_source.join(l_, F.col("lang").eqNullSafe(F.col("l")))

    def shrunk(m: str, q: int) -> Column:
        return F.expr(f"(docs * {m}_q{q} + {shrink} * l_{m}_q{q}) div (docs + {shrink})")
    out, floored = [], F.lit(0)
    for m, (_, _, _, upper, lower) in METRICS.items():
        middle, high = shrunk(m, MEDIAN), shrunk(m, upper)
        out.append((high + REACH * F.greatest(high - middle, F.lit(LEAST_SPREAD))).alias(f"{m}_most"))
        floored = floored + (high - middle < LEAST_SPREAD).cast("int")
        if lower is not None:
            low = shrunk(m, lower)
            out.append((low - REACH * F.greatest(middle - low, F.lit(LEAST_SPREAD))).alias(f"{m}_least"))
    return joined.select("lang", "source", *out, floored.alias("floored"))


def _quantiles(sketch: DataFrame, group: list[str]) -> DataFrame:
    """Quantile bins of each metric, one row per group: the first bin that holds the share of the
    group's documents below or in it."""
    w = Window.partitionBy(*group, "metric")
    ranked = sketch.select(*group, "metric", "bin", F.sum("n").over(w).alias("docs"),
                           F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("below"))
    found = [F.min(F.when((F.col("metric") == m) & (1000 * F.col("below") >= q * F.col("docs")), F.col("bin"))).alias(f"{m}_q{q}")
             for m in METRICS for q in levels(m)]
    return ranked.groupBy(*group).agg(F.max("docs").alias("docs"), *found)


def judge(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          source: str = "source", shrink: int = SHRINK) -> DataFrame:
    """One row per document: counts, ``base_failed`` and ``kept``."""
    # The counts, without texts, serve the sketches and the verdicts: one pass over the texts.
    counts = materialise(counted(documents, doc_id, text, lang, source), "quality-counts")
    f = fences(counts, shrink).drop("floored")
    f = f.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"),
                 *[c for c in f.columns if c not in ("lang", "source")])
    joined = counts.join(f, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")),
                         "left")
    inside = F.lit(True)
    for m, (_, _, _, _, lower) in METRICS.items():
        inside = inside & (bin_of(m) <= F.col(f"{m}_most"))
        if lower is not None:
            inside = inside & (bin_of(m) >= F.col(f"{m}_least"))
    return joined.select("doc_id", "lang", "source", *COUNTS, "base_failed",
                         (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"))
