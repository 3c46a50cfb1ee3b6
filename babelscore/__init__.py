"""babelscore: classify aligned multilingual text on Spark and report on the results.

    from babelscore import classify, LetterScorer, summary_report
    scored = classify(wide_df, LetterScorer())
    summary_report(scored).show()
"""

from .operators.charts import chart_donut, chart_stack, chart_taxonomy
from .operators.classify import classify, decide, low_confidence_cases
from .operators.report import (LanguageCounts, class_dist, lang_share, summary_lines,
                               summary_report, taxonomy, weighted_mean)
from .operators.reshape import melt_languages
from .operators.scoring import LetterScorer, OnnxScorer, model_udf
from .sources.csv_io import read_annotated, read_results, read_wide, write_results

__all__ = [
    "classify", "decide", "low_confidence_cases", "melt_languages",
    "LetterScorer", "OnnxScorer", "model_udf",
    "LanguageCounts", "class_dist", "lang_share", "summary_lines", "summary_report", "taxonomy",
    "weighted_mean", "chart_donut", "chart_stack", "chart_taxonomy",
    "read_wide", "read_results", "read_annotated", "write_results",
]
