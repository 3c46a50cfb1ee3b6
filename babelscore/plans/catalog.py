"""Named queries over the generated test tables (their SQL twins are in ``oracle.py``).

Each query takes ``(spark, sf_dir)`` and returns a DataFrame computed by the library's
operators from the whole input tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean, is_blank
from ..operators import charts, report
from ..operators.classify import classify, decide, low_confidence_cases, score
from ..operators.reshape import melt_languages
from ..operators.scoring import LetterScorer
from ..schema import CLASSES, FIGURE_LANGUAGES, FIXED_SENTENCES_PER_LANGUAGE, LANGUAGES, OUT_COLS
from ..session import scratch_path
from ..sources import csv_io
from ..sources.testdata import EVENT_CATEGORIES, annotated_from_events, read_table, wide_from_documents

Query = Callable[[SparkSession, str], DataFrame]
SCORER = LetterScorer()
# Cells of the derived inputs below.
NA_CELLS = ["", "NA", "None", "NaN", "n/a", "<NA>", "null"]
BLANK_CELLS = [" \t", "\u00a0\u3000\u0085", "", "\n", "\u200b", "\u2028 ", "\x1c"]
PLAIN_LETTERS = "abcdefghijklmnopqrstuvwxyz"
FULL_WIDTH_LETTERS = "".join(chr(ord(c) + 0xFEE0) for c in PLAIN_LETTERS)


# ---- Spark side -----------------------------------------------------------------------------

def _wide(spark, sf):
    return wide_from_documents(spark, sf)


def _long(spark, sf, missing="drop"):
    return melt_languages(_wide(spark, sf), LANGUAGES, missing=missing)


def _scored(spark, sf):
    return classify(_wide(spark, sf), SCORER, LANGUAGES)


def _annotated(spark, sf):
    return annotated_from_events(spark, sf)


def q_wide_scan(spark, sf):
    path = scratch_path(spark, "wide-csv")
    csv_io.write_csv(_wide(spark, sf), path)
    return csv_io.read_wide(spark, path)


def q_wide_scan_reordered(spark, sf):
    """The wide fixture in two halves with their columns in different orders, read together."""
    path = scratch_path(spark, "wide-csv-halves")
    wide = _wide(spark, sf)
    csv_io.write_csv(wide.filter("sentence_id % 2 = 0"), f"{path}/a")
    csv_io.write_csv(wide.filter("sentence_id % 2 = 1").select(*reversed(wide.columns)), f"{path}/b")
    return csv_io.read_wide(spark, f"{path}/*").select(*wide.columns)


def q_wide_scan_na(spark, sf):
    """The wide fixture with missing-cell tokens in its English column, written with a byte order
    mark and read back."""
    path = scratch_path(spark, "wide-csv-na")
    wide = _wide(spark, sf)
    tokens = F.array(*[F.lit(t) for t in NA_CELLS])
    english = F.when(F.col("sentence_id") % 3 == 0, tokens[(F.col("sentence_id") % len(NA_CELLS)).cast("int")])
    marked = wide.withColumn("English", english.otherwise(F.col("English")))
    csv_io.write_csv(marked.withColumnRenamed("sentence_id", "\ufeffsentence_id"), path)
    return csv_io.read_wide(spark, path)


def q_blank_filter_derived(spark, sf):
    """Documents of which every fifth text is replaced by white space of several kinds (kept: the
    zero-width space, which is none)."""
    docs = read_table(spark, sf, "documents")
    blanks = F.array(*[F.lit(b) for b in BLANK_CELLS])
    text = F.when(F.col("doc_id") % 5 == 0, blanks[(F.col("doc_id") % len(BLANK_CELLS)).cast("int")])
    return docs.withColumn("text", text.otherwise(F.col("text"))).filter(~is_blank("text")).select("doc_id", "lang")


def q_preprocess_nfkc(spark, sf):
    """Every document's letters a-z in full-width form, cleaned: NFKC gives the plain letters back."""
    wide = F.translate("text", PLAIN_LETTERS, FULL_WIDTH_LETTERS)
    return read_table(spark, sf, "documents").select("doc_id", clean(wide).alias("clean_text"))


def q_id_pad(spark, sf):
    from ..operators.reshape import sentence_id
    orders = read_table(spark, sf, "orders").select("o_orderkey")
    return orders.select("o_orderkey", sentence_id(F.col("o_orderkey")).alias("sentence_id"))


def q_blank_filter(spark, sf):
    docs = read_table(spark, sf, "documents")
    return docs.filter(~is_blank("text")).select("doc_id", "lang", "n_chars")


def q_preprocess(spark, sf):
    s = score(_long(spark, sf), SCORER)
    return s.select("sentence_id", "Language", "clean_text")


def q_logits_udf(spark, sf):
    s = score(_long(spark, sf), SCORER, form="udf")
    return s.select("sentence_id", "Language",
                    *[F.col("logits")[i].alias(f"logit_{c}") for i, c in enumerate(CLASSES)])


def q_scores(spark, sf):
    s = decide(score(_long(spark, sf), SCORER), "logits", SCORER.labels, keep_scores=True)
    # explode_outer: a plain explode makes Catalyst add a size(scores) > 0 filter, which it
    # would evaluate below the projection and so compute the scores twice.
    return s.select("sentence_id", "Language", F.explode_outer("scores").alias("label", "p")) \
        .select("sentence_id", "Language", "label", F.bround("p", 10).alias("score"))


def q_predict(spark, sf):
    return _scored(spark, sf).select("sentence_id", "Language", "Sentiment", "Confidence",
                                     "low_confidence_flag")


def q_lowconf_cases(spark, sf):
    """Filters on model outputs run on the written scored table, never above the model."""
    path = scratch_path(spark, "scored")
    csv_io.write_results(_scored(spark, sf), path, fmt="parquet")
    return low_confidence_cases(csv_io.read_results(spark, path, fmt="parquet"))


def q_results_roundtrip(spark, sf):
    path = scratch_path(spark, "results-csv")
    csv_io.write_results(_scored(spark, sf), path, fmt="csv")
    return csv_io.read_results(spark, path).select(*OUT_COLS)


def q_annotated_scan(spark, sf):
    path = scratch_path(spark, "annotated-csv")
    csv_io.write_csv(_annotated(spark, sf), path)
    return csv_io.read_annotated(spark, path)


def q_load_counts(spark, sf):
    wide = _wide(spark, sf)
    present = [l for l in LANGUAGES if l in wide.columns]
    cells = sum((F.count_if(F.col(l).isNotNull() & ~is_blank(l)) for l in present), F.lit(0).cast("long"))
    return wide.agg(F.count(F.lit(1)).alias("n_sentences"),
                    F.lit(len(wide.columns)).alias("n_columns"),
                    F.lit(len(LANGUAGES)).alias("n_languages"),
                    (F.count(F.lit(1)) * F.lit(len(LANGUAGES))).alias("n_announced"),
                    cells.alias("n_records"))


def q_preview(spark, sf):
    return _wide(spark, sf).orderBy("sentence_id").limit(3)


def _tax(fn, **kw):
    return lambda spark, sf: fn(_annotated(spark, sf), EVENT_CATEGORIES, **kw)


def _rep(fn, **kw):
    return lambda spark, sf: fn(_scored(spark, sf), **kw)


NOTES = {
    "wide_scan": ("S1", "wide fixture written as CSV and read back with pandas NA rules"),
    "wide_scan_reordered": ("S1", "the same in two halves with different column orders, read together"),
    "wide_scan_na": ("S1, P6", "the same with missing-cell tokens and a byte order mark"),
    "id_pad": ("P1", "order keys zero-padded to 4 like str.zfill"),
    "melt": ("P2-P6", "one row per non-blank (sentence, language) cell"),
    "melt_missing_as_text": ("P6", "missing cells kept as the text 'nan'"),
    "blank_filter": ("P5", "documents whose text is not whitespace-only"),
    "blank_filter_derived": ("P5", "the same over documents with blank texts of several kinds"),
    "preprocess_nfkc": ("P7", "full-width letters cleaned back to plain ones"),
    "preprocess": ("P7-P10", "NFKC + whitespace-collapsed model input"),
    "logits_udf": ("M1-M2", "logits from the batch model UDF"),
    "scores": ("M3, M7", "softmax probability per class"),
    "predict": ("M4-M9", "class, rounded confidence, low-confidence flag"),
    "results": ("M10-M11, P14", "the scored table (seven output columns)"),
    "results_as_text": ("P6, M11", "the scored table with missing cells scored as the text 'nan'"),
    "results_udf": ("M1-M11", "the scored table through the model UDF"),
    "lowconf_cases": ("P15", "flagged rows of the written scored table"),
    "results_roundtrip": ("S2, S4", "scored table written as CSV and read back"),
    "annotated_scan": ("S3", "annotated table written as CSV and read back"),
    "load_counts": ("S5, S6", "sentences, columns, announced and actual predictions"),
    "preview": ("S6", "first three wide rows"),
    "class_dist": ("A1, A2, J1", "overall class counts and shares"),
    "lang_class_counts": ("A3, J1", "counts per language and class, completed"),
    "lang_summary": ("A3-A5, O1", "Table 1 per-language rows"),
    "grand_summary": ("A6", "low-confidence total and rate over all rows"),
    "summary_report": ("A7", "Table 1 with the total row"),
    "summary_lines": ("A7, F1", "the printed summary block (script wording)"),
    "summary_lines_notebook": ("A7, F1", "the printed summary block (notebook wording)"),
    "lang_share": ("A8", "class shares per language, actual denominators"),
    "lang_share_floor": ("A8", "class shares with all rows // languages"),
    "lang_share_fixed": ("A8", "class shares with 375 per language"),
    "stack_offsets": ("W1", "stacked-bar left offsets (running window)"),
    "label_placement": ("W2, F1", "label positions and texts"),
    "legend_labels": ("F1", "Figure 1 legend texts"),
    "chart_donut": ("C1, J2", "Figure 1 table"),
    "chart_stack": ("C2, J2", "Figure 2 table, actual denominators"),
    "chart_stack_fixed": ("C2", "Figure 2 table as the script computes it"),
    "chart_stack_floor": ("C2", "Figure 2 table as the notebook computes it"),
    "taxonomy_dist": ("A9, P12, J1", "category counts and shares"),
    "taxonomy_conf": ("A10, P13", "mean parseable confidence per category (0.0 if none)"),
    "taxonomy_conf_null_mean": ("A10", "the same with a null mean when none"),
    "weighted_mean": ("A11", "weighted and plain mean confidence"),
    "weighted_mean_null_mean": ("A11", "the same skipping categories without a mean"),
    "axis_bounds": ("A12", "confidence axis bounds"),
    "taxonomy_sorted": ("O2", "categories ranked by frequency"),
    "chart_taxonomy": ("C3, J2, F1", "Figure 3 table"),
    "chart_taxonomy_null_mean": ("C3", "Figure 3 table in notebook mode"),
}


def queries() -> dict[str, Query]:
    return {
        "wide_scan": q_wide_scan,
        "wide_scan_reordered": q_wide_scan_reordered,
        "wide_scan_na": q_wide_scan_na,
        "id_pad": q_id_pad,
        "melt": lambda spark, sf: _long(spark, sf),
        "melt_missing_as_text": lambda spark, sf: _long(spark, sf, "as_text"),
        "blank_filter": q_blank_filter,
        "blank_filter_derived": q_blank_filter_derived,
        "preprocess_nfkc": q_preprocess_nfkc,
        "preprocess": q_preprocess,
        "logits_udf": q_logits_udf,
        "scores": q_scores,
        "predict": q_predict,
        "results": _scored,
        "results_as_text": lambda spark, sf: classify(_wide(spark, sf), SCORER, LANGUAGES, missing="as_text"),
        "results_udf": lambda spark, sf: classify(_wide(spark, sf), SCORER, LANGUAGES, form="udf",
                                                  sort_by_length=True),
        "lowconf_cases": q_lowconf_cases,
        "results_roundtrip": q_results_roundtrip,
        "annotated_scan": q_annotated_scan,
        "load_counts": q_load_counts,
        "preview": q_preview,
        "class_dist": _rep(report.class_dist),
        "lang_class_counts": _rep(report.lang_class_counts, languages=FIGURE_LANGUAGES),
        "lang_summary": _rep(report.lang_summary, languages=LANGUAGES),
        "grand_summary": _rep(report.grand_summary),
        "summary_report": _rep(report.summary_report, languages=LANGUAGES),
        "summary_lines": _rep(report.summary_lines, languages=LANGUAGES),
        "summary_lines_notebook": _rep(report.summary_lines, languages=LANGUAGES, threshold=None),
        "lang_share": _rep(report.lang_share, languages=FIGURE_LANGUAGES, denominator="actual"),
        "lang_share_floor": _rep(report.lang_share, languages=FIGURE_LANGUAGES, denominator="floor_mean"),
        "lang_share_fixed": _rep(report.lang_share, languages=FIGURE_LANGUAGES,
                                 denominator=FIXED_SENTENCES_PER_LANGUAGE),
        "stack_offsets": lambda spark, sf: charts.stack_offsets(
            report.lang_share(_scored(spark, sf), FIGURE_LANGUAGES))
            .select("ord", "Language", "class_ord", "Sentiment", "pct", "left"),
        "label_placement": lambda spark, sf: charts.label_placement(charts.stack_offsets(
            report.lang_share(_scored(spark, sf), FIGURE_LANGUAGES)))
            .select("ord", "Language", "class_ord", "Sentiment", "n", "pct", "left", "x", "inside", "label"),
        "legend_labels": _rep(charts.legend_labels),
        "chart_donut": _rep(charts.chart_donut),
        "chart_stack": _rep(charts.chart_stack, languages=FIGURE_LANGUAGES),
        # Figure 2 exactly as the script computes it (a constant 375 per language) and as the
        # notebook does (all rows // languages, languages in classification order).
        "chart_stack_fixed": _rep(charts.chart_stack, languages=FIGURE_LANGUAGES,
                                  denominator=FIXED_SENTENCES_PER_LANGUAGE),
        "chart_stack_floor": _rep(charts.chart_stack, languages=LANGUAGES, denominator="floor_mean"),
        "taxonomy_dist": _tax(report.taxonomy_dist),
        "taxonomy_conf": _tax(report.taxonomy_conf),
        "taxonomy_conf_null_mean": _tax(report.taxonomy_conf, empty_mean=None),
        "weighted_mean": _tax(report.weighted_mean),
        "weighted_mean_null_mean": _tax(report.weighted_mean, empty_mean=None),
        "axis_bounds": _tax(report.axis_bounds),
        "taxonomy_sorted": _tax(report.taxonomy_sorted),
        "chart_taxonomy": _tax(charts.chart_taxonomy),
        "chart_taxonomy_null_mean": _tax(charts.chart_taxonomy, empty_mean=None),
    }


def oracle_sql() -> dict[str, str]:
    from .oracle import oracle_sql as sql
    return sql()
