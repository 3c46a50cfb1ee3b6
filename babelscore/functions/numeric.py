"""Numeric column functions: softmax, arg-max, rounding, safe parsing. All Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_whitespace

# A plain decimal number: sign, digits with an optional point, optional exponent. Python's
# float() also takes '1_0', 'inf' and 'nan' and Spark's cast also takes '1.0d'; the report
# counts none of those as a confidence value.
DECIMAL_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax(logits, k: int | None = None) -> Column:
    """Numerically stable softmax over an ``array<double>``.

    With the length ``k`` known, it is written with scalar expressions (``greatest``, ``exp``,
    division), which whole-stage codegen compiles; otherwise with array lambdas, which it
    interprets. Both add the exponentials left to right."""
    x = _col(logits)
    if k:
        xs = [x[i] for i in range(k)]
        m = F.greatest(*xs) if k > 1 else xs[0]
        es = [F.exp(v - m) for v in xs]
        total = es[0]
        for e in es[1:]:
            total = total + e
        return F.array(*[e / total for e in es])
    m = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / s)


def argmax1(probs) -> Column:
    """1-based index of the first maximum (NaN counts as the maximum, as in numpy)."""
    p = _col(probs)
    return F.array_position(p, F.array_max(p)).cast("int")


def safe_double(c) -> Column:
    """Parse a confidence cell: trimmed decimal numbers with a finite value, anything else is null."""
    s = strip_whitespace(c)
    value = F.when(s.rlike(DECIMAL_NUMBER), s.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def pct(n, total) -> Column:
    """``n / total * 100`` in double; null when the total is zero."""
    return F.try_divide(_col(n).cast("double"), _col(total).cast("double")) * F.lit(100.0)
