"""Schemas and fixed domains."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the reference's for results to match.
# ---------------------------------------------------------------------------
# Languages, in the classification job's order (also the summary table order).
LANGUAGES = ["English", "Spanish", "French", "German", "Italian"]
# Languages, in the order the per-language figure lists them.
FIGURE_LANGUAGES = ["English", "French", "German", "Italian", "Spanish"]
# Model classes in logit order 0, 1, 2, with their display names and colours.
CLASSES = ["negative", "neutral", "positive"]
CLASS_LABELS = ["Negative", "Neutral", "Positive"]
CLASS_COLOURS = ["#C0392B", "#7F8C8D", "#2980B9"]
# Low-confidence taxonomy categories in display order, their two-line axis labels and colours.
CATEGORIES = [
    "Irony / Sarcasm",
    "Informal Punctuation",
    "Conditional / Hypothetical",
    "Idiomatic Expressions",
    "Mixed Sentiment",
    "Translation Drift",
]
CATEGORY_LABELS = [
    "Irony /\nSarcasm",
    "Informal\nPunctuation",
    "Conditional /\nHypothetical",
    "Idiomatic\nExpressions",
    "Mixed\nSentiment",
    "Translation\nDrift",
]
CATEGORY_COLOURS = ["#8E44AD", "#566573", "#1A5276", "#117A65", "#B7950B", "#922B21"]
# Defaults of the classification job.
DEFAULT_THRESHOLD = 0.5
DEFAULT_BATCH_SIZE = 32
DEFAULT_MAX_TOKENS = 512
ID_WIDTH = 4
CONFIDENCE_PLACES = 10
# Figure 2: the neutral label moves outside the bar below this share, by this offset.
NEUTRAL_INSIDE_MIN_PCT = 8.0
OUTSIDE_LABEL_OFFSET = 1.2
# Figure 3: the confidence axis runs from min(mean) - LOW_PAD to max(mean) + HIGH_PAD.
AXIS_LOW_PAD = 0.006
AXIS_HIGH_PAD = 0.012
# Figure 2 in the script divides by this constant sentence count.
FIXED_SENTENCES_PER_LANGUAGE = 375
# Cell values pandas' CSV reader turns into NaN by default.
PANDAS_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Characters Python's str.isspace() accepts (what str.strip()/str.split() remove): as a
# string, and as regex escapes understood by both Java and RE2.
PY_WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
PY_WHITESPACE = (
    r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# ---------------------------------------------------------------------------

# Output column order of the scored table.
OUT_COLS = ["sentence_id", "Language", "Text", "English_source", "Sentiment", "Confidence",
            "low_confidence_flag"]

def wide_string_schema(languages: list[str] | None = None) -> T.StructType:
    cols = ["sentence_id"] + list(languages or LANGUAGES)
    return T.StructType([T.StructField(c, T.StringType()) for c in cols])


def two_line_label(name: str) -> str:
    """Axis label of a category: the last space becomes a line break."""
    head, sep, tail = name.rpartition(" ")
    return f"{head}\n{tail}" if sep else name
