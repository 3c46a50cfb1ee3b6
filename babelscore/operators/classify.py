"""Logits → class, confidence, flag; and the whole classification step.

``classify`` is one map-only stage: melt (``Expand``), blank filter, clean, score, decide.
With a UDF scorer the plan holds exactly one Python evaluation of the model; filters on the
model's outputs belong on the written scored table (``plans.jobs.classify_job``), because a
filter above a deterministic UDF makes Catalyst evaluate the model a second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.numeric import argmax1, softmax
from ..functions.text import clean, clean_catalyst
from ..schema import CONFIDENCE_PLACES, DEFAULT_BATCH_SIZE, DEFAULT_THRESHOLD, OUT_COLS
from .reshape import melt_languages
from .scoring import Scorer, model_udf


def decide(df: DataFrame, logits: str, labels: list[str], threshold: float = DEFAULT_THRESHOLD,
           keep_scores: bool = False, inputs: str = "logits") -> DataFrame:
    """Adds ``Sentiment`` (first arg-max, lower-cased label), ``Confidence`` (max probability,
    half-even to 10 places) and ``low_confidence_flag`` (unrounded confidence < threshold;
    NaN is not below it). ``keep_scores`` also keeps ``scores map<label, prob>``.

    ``inputs='probs'`` takes the column as probabilities already (a model with its own softmax
    head, e.g. float32 values to be kept bit for bit) and skips the softmax here."""
    if inputs not in ("logits", "probs"):
        raise ValueError("inputs must be 'logits' or 'probs'")
    # Labels are normalised to lower case once, here, not per row.
    names = F.array(*[F.lit(l.lower()) for l in labels])
    probs = softmax(logits, len(labels)) if inputs == "logits" else F.col(logits).cast("array<double>")
    out = df.withColumn("__p", probs)
    conf = F.array_max("__p")
    cols = {
        "Sentiment": F.element_at(names, argmax1("__p")),
        "Confidence": F.bround(conf, CONFIDENCE_PLACES),
        "low_confidence_flag": conf < F.lit(float(threshold)),
    }
    if keep_scores:
        cols["scores"] = F.map_from_arrays(names, F.col("__p"))
    return out.withColumns(cols).drop("__p")


def score(long: DataFrame, scorer: Scorer, form: str = "catalyst", nfkc: bool = True,
          batch_size: int = DEFAULT_BATCH_SIZE, sort_by_length: bool = False, cut: str | None = None) -> DataFrame:
    """Adds ``clean_text`` and ``logits`` to melted rows; ``Text`` is left as read. ``cut`` names a column
    for whether the model reads only part of a text, which the same pass finds.

    ``form='catalyst'`` uses the scorer's expression, ``'udf'`` its batch predict function.
    ``sort_by_length`` orders each partition by text length first, so padded batches of a real
    model waste less (a sort inside partitions, no shuffle)."""
    cleaner = clean if nfkc else clean_catalyst
    df = long.withColumn("clean_text", cleaner(F.col("Text")))
    if form == "catalyst":
        expr = scorer.logits(F.col("clean_text"))
        if expr is None:
            raise ValueError("this scorer has no Catalyst form; use form='udf'")
        out = df.withColumn("logits", expr)
        return out.withColumn(cut, F.lit(False)) if cut else out  # an expression reads all
    if form != "udf":
        raise ValueError("form must be 'catalyst' or 'udf'")
    if sort_by_length:
        df = df.sortWithinPartitions(F.length("clean_text"))
    if not cut:
        return df.withColumn("logits", model_udf(scorer, batch_size)(F.col("clean_text")))
    both = df.withColumn("__out", model_udf(scorer, batch_size, counting=True)(F.col("clean_text")))
    # The last value says whether the text was cut.
    return both.withColumns({"logits": F.expr("slice(__out, 1, size(__out) - 1)"), cut: F.element_at("__out", -1) > 0}).drop("__out")


def classify(wide: DataFrame, scorer: Scorer, languages: list[str] | None = None,
             threshold: float = DEFAULT_THRESHOLD, missing: str = "drop", form: str = "catalyst",
             nfkc: bool = True, batch_size: int = DEFAULT_BATCH_SIZE,
             keep_scores: bool = False, sort_by_length: bool = False,
             truncation: Observation | None = None) -> DataFrame:
    """Wide table → scored long table with the seven output columns (plus ``scores``).

    ``truncation`` receives ``truncated``, the number of texts longer than the model reads, found in
    the same tokenizer pass as the logits."""
    long = melt_languages(wide, languages, missing=missing)
    scored = score(long, scorer, form=form, nfkc=nfkc, batch_size=batch_size,
                   sort_by_length=sort_by_length, cut="__cut" if truncation is not None else None)
    if truncation is not None:
        scored = scored.observe(truncation, F.count_if("__cut").alias("truncated")).drop("__cut")
    decided = decide(scored, "logits", scorer.labels, threshold, keep_scores=keep_scores,
                     inputs=getattr(scorer, "outputs", "logits"))
    return decided.select(*OUT_COLS, *(["scores"] if keep_scores else []))


def low_confidence_cases(scored: DataFrame) -> DataFrame:
    """The work list for manual annotation: flagged rows of the (written) scored table."""
    return scored.filter(F.col("low_confidence_flag"))
