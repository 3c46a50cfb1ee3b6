"""Chart label text.

A fixed-point value is rounded from its exact binary value, half to even, as Python's formatting
does (0.05 prints as 0.1 and 0.15 as 0.1 to one place); Java's formatter rounds the shortest
decimal form, which differs for one label in seven. So numbers with decimal places are formatted by
a small Arrow function. Labels are made of report tables, which have a row per class, language or
category: no data row passes through it. Integers and text stay with ``format_string``.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fmt(pattern: str, *args: Column) -> Column:
    """``format_string`` that yields null, not the text "null", when an argument is null."""
    known = args[0].isNotNull()
    for a in args[1:]:
        known = known & a.isNotNull()
    return F.when(known, F.format_string(pattern, *args))


@functools.cache
def _rounder(places: int):
    @F.arrow_udf(T.StringType())
    def text(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.{places}f}" for v in values.to_pylist()], pa.string())
    return text


def fixed(x, places: int) -> Column:
    """A double with a fixed number of places; null stays null."""
    return _rounder(places)(_col(x).cast("double"))


def legend_label(label, n, p) -> Column:
    """Figure 1 legend: label, grouped count, share to one place."""
    return _fmt("%s  %,d  (%s%%)", _col(label), _col(n), fixed(p, 1))


def grand_label(n) -> Column:
    """Figure 1 centre: the grouped total."""
    return _fmt("n = %,d", _col(n))


def segment_label(n, p, inside) -> Column:
    """Figure 2: count and whole-percent share, on two lines inside a bar and one outside."""
    r = fixed(p, 0)
    return F.when(_col(inside), _fmt("%d\n(%s%%)", _col(n), r)).otherwise(_fmt("%d (%s%%)", _col(n), r))


def share_label(p, n) -> Column:
    """Figure 3 bars: share to one place and the count."""
    return _fmt("%s%%  (n=%d)", fixed(p, 1), _col(n))


def mean_label(m) -> Column:
    """Figure 3 reference line: the mean to three places."""
    return _fmt("Mean: %s", fixed(m, 3))


def fixed_or_nan(x, places: int) -> Column:
    """``fixed``, where a missing value prints as Python's ``nan``."""
    return F.coalesce(fixed(x, places), F.lit("nan"))


def summary_line(lang, neg, neu, pos, low, pct) -> Column:
    """One per-language line of the printed summary: padded name, padded class counts, then the
    low-confidence count and rate."""
    head = _fmt("  %-10s neg=%3d  neu=%3d  pos=%3d  | low-conf=%d (",
                _col(lang), _col(neg), _col(neu), _col(pos), _col(low))
    return F.concat(head, fixed_or_nan(pct, 1), F.lit("%)"))


def total_line(low, n, pct, threshold: float | None = None) -> Column:
    """The closing line of the printed summary; ``threshold=None`` gives the notebook's wording."""
    if threshold is None:
        head = _fmt("  Total low-confidence: %d/%d (", _col(low), _col(n))
    else:
        head = _fmt(f"  Total low-confidence (< {threshold!r}): %d / %d (", _col(low), _col(n))
    return F.concat(head, fixed_or_nan(pct, 1), F.lit("%)"))
