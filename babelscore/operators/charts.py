"""Chart-ready tables: the data half of each figure (nothing is drawn here).

All windows below run over report outputs of fixed, tiny size (≤ languages × classes rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fmt
from ..schema import (AXIS_HIGH_PAD, AXIS_LOW_PAD, CATEGORIES, CATEGORY_COLOURS, CATEGORY_LABELS,
                      CLASS_COLOURS, CLASS_LABELS, CLASSES, FIGURE_LANGUAGES,
                      NEUTRAL_INSIDE_MIN_PCT, OUTSIDE_LABEL_OFFSET, two_line_label)
from .report import MEAN_PLACES, attribute, class_dist, lang_share, taxonomy

NEUTRAL = CLASSES[1]
CLASS_LABEL = dict(zip(CLASSES, CLASS_LABELS))
CLASS_COLOUR = dict(zip(CLASSES, CLASS_COLOURS))


def category_attributes(categories: list[str] | None = None) -> tuple[dict, dict]:
    """Label and colour per category: the fixed ones for the reference's categories; for any
    other list, two-line labels by rule and the palette by position."""
    labels, colours = {}, {}
    for i, c in enumerate(categories or CATEGORIES):
        if c in CATEGORIES:
            j = CATEGORIES.index(c)
            labels[c], colours[c] = CATEGORY_LABELS[j], CATEGORY_COLOURS[j]
        else:
            labels[c], colours[c] = two_line_label(c), CATEGORY_COLOURS[i % len(CATEGORY_COLOURS)]
    return labels, colours


def stack_offsets(shares: DataFrame) -> DataFrame:
    """Left edge of each stacked segment: the sum of the preceding classes' shares."""
    before = (Window.partitionBy("Language").orderBy("class_ord")
              .rowsBetween(Window.unboundedPreceding, -1))
    return shares.withColumn("left", F.coalesce(F.sum("pct").over(before), F.lit(0.0)))


def label_placement(offsets: DataFrame) -> DataFrame:
    """Label x position: the segment's middle, except a neutral segment under 8 % whose label
    sits just right of it. ``inside`` says which; ``label`` is the text."""
    big_enough = F.coalesce(F.col("pct") >= F.lit(NEUTRAL_INSIDE_MIN_PCT), F.lit(False))
    outside = (F.col("Sentiment") == F.lit(NEUTRAL)) & ~big_enough
    x = F.when(outside, F.col("left") + F.col("pct") + F.lit(OUTSIDE_LABEL_OFFSET)) \
        .otherwise(F.col("left") + F.col("pct") / F.lit(2.0))
    return offsets.withColumns({"x": x, "inside": ~outside}) \
        .withColumn("label", fmt.segment_label("n", "pct", "inside"))


def chart_stack(scored, languages: list[str] | None = None,
                denominator: str | int = "actual") -> DataFrame:
    """Figure 2: per language × class ``n, pct, left, x, inside, label, colour``."""
    shares = lang_share(scored, languages or FIGURE_LANGUAGES, denominator)
    placed = label_placement(stack_offsets(shares)).withColumn("colour", attribute("Sentiment", CLASS_COLOUR))
    return placed.select(
        "ord", "Language", "class_ord", "Sentiment", "n", "pct", "left", "x", "inside", "label", "colour")


def chart_donut(scored) -> DataFrame:
    """Figure 1: per class ``n, pct, class_label, colour, legend`` and the centre text."""
    dist = class_dist(scored).withColumns({"class_label": attribute("Sentiment", CLASS_LABEL),
                                           "colour": attribute("Sentiment", CLASS_COLOUR)})
    grand = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return (dist.withColumn("legend", fmt.legend_label("class_label", "n", "pct"))
            .withColumn("centre", fmt.grand_label(grand))
            .select("class_ord", "Sentiment", "class_label", "colour", "n", "pct", "legend", "centre"))


def legend_labels(scored) -> DataFrame:
    """Figure 1 legend entries: ``Negative  1,234  (12.3%)``."""
    return chart_donut(scored).select("class_ord", "Sentiment", "legend")


def chart_taxonomy(annotated: DataFrame, categories: list[str] | None = None,
                   empty_mean: float | None = 0.0) -> DataFrame:
    """Figure 3: per category ``n, pct, mean_conf``, labels, colour, and the figure-wide
    weighted mean line and confidence axis bounds (same value on every row)."""
    labels, colours = category_attributes(categories)
    t = taxonomy(annotated, categories, empty_mean).withColumns({
        "label": attribute("final_category", labels), "colour": attribute("final_category", colours)})
    every = Window.partitionBy(F.lit(0))
    has = F.col("mean_conf").isNotNull()
    wm = F.try_divide(F.sum(F.when(has, F.col("mean_conf") * F.col("n"))).over(every),
                      F.sum(F.when(has, F.col("n"))).over(every).cast("double"))
    out = (t.withColumns({
               "bar_label": fmt.share_label("pct", "n"),
               "conf_label": fmt.fixed("mean_conf", 3),
               "weighted_mean": wm,
               "x_min": F.min("mean_conf").over(every) - F.lit(AXIS_LOW_PAD),
               "x_max": F.max("mean_conf").over(every) + F.lit(AXIS_HIGH_PAD)})
           .withColumn("mean_label", fmt.mean_label("weighted_mean")))
    return out.select(
        "ord", "final_category", "label", "colour", "n", "pct", "n_parsed",
        F.bround("mean_conf", MEAN_PLACES).alias("mean_conf"), "bar_label", "conf_label",
        F.bround("weighted_mean", MEAN_PLACES).alias("weighted_mean"), "mean_label",
        F.bround("x_min", MEAN_PLACES).alias("x_min"), F.bround("x_max", MEAN_PLACES).alias("x_max"))
