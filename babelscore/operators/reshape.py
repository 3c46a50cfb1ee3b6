"""Wide ⇄ long reshaping: the language melt (map-only) and its inverse pivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, zfill
from ..schema import LANGUAGES

MISSING_POLICIES = ("drop", "as_text")


def sentence_id(c: Column) -> Column:
    """Id as pandas would print it, zero-padded: integral ids lose leading zeros first
    (``0001`` → ``1`` → ``0001``); anything else is kept as written."""
    s = c.cast("string")
    return zfill(F.coalesce(s.try_cast("long").cast("string"), s))


def melt_languages(wide: DataFrame, languages: list[str] | None = None, missing: str = "drop",
                   id_col: str = "sentence_id", source_language: str = "English") -> DataFrame:
    """One row per (sentence, language) with non-blank text.

    Output ``sentence_id, Language, Text, English_source``. A listed language without a column
    contributes nothing; ``missing='drop'`` skips null cells, ``missing='as_text'`` keeps them
    as the text ``'nan'``, the way ``str(NaN)`` does. The blank filter looks at the raw text.
    """
    if missing not in MISSING_POLICIES:
        raise ValueError(f"missing must be one of {MISSING_POLICIES}")
    langs = [l for l in (languages or LANGUAGES) if l in wide.columns]

    def c(name: str) -> Column:  # quoted: headers may contain dots or spaces
        return F.col(f"`{name}`")

    sid = sentence_id(c(id_col)) if id_col in wide.columns else zfill(F.lit(""))
    src = c(source_language).cast("string") if source_language in wide.columns else F.lit("")

    def cell(x: Column) -> Column:
        return F.coalesce(x, F.lit("nan")) if missing == "as_text" else x

    base = wide.select(sid.alias("sentence_id"), cell(src).alias("English_source"),
                       *[cell(c(l).cast("string")).alias(l) for l in langs])
    if not langs:
        return base.select("sentence_id", F.lit(None).cast("string").alias("Language"),
                           F.lit(None).cast("string").alias("Text"),
                           "English_source").filter(F.lit(False))
    long = base.unpivot(["sentence_id", "English_source"], [c(l) for l in langs], "Language", "Text")
    return (long.filter(F.col("Text").isNotNull() & ~is_blank("Text"))
            .select("sentence_id", "Language", "Text", "English_source"))


def pivot_to_wide(long: DataFrame, id_col: str, key_col: str, value_col: str,
                  keys: dict[str, str]) -> DataFrame:
    """Inverse of the melt: one row per id, one column per key (``keys`` maps key → column).

    One shuffle on the id; each group holds at most ``len(keys)`` rows. ``max`` of a string is
    a sort-based aggregate, and a partial aggregate before the shuffle would sort every row on
    the map side while merging almost nothing (an id rarely meets its other keys there), so
    the rows are hash-partitioned on the id first: partial and final aggregation then share one
    sort after the exchange."""
    aggs = [F.max(F.when(F.col(key_col) == k, F.col(value_col))).alias(name)
            for k, name in keys.items()]
    return long.repartition(id_col).groupBy(id_col).agg(*aggs)
