"""Text column functions: whitespace rules, NFKC, id padding, missing-cell tokens.

All of these are Catalyst expressions. NFKC has no Spark built-in; ``nfkc`` calls ICU's
``Normalizer.compose(text, compat=true)`` through ``reflect`` (ICU4J ships with Spark 4 for
collations), so it stays on the JVM. Against Python's ``unicodedata`` it agrees on every code
point up to U+2FFFF except 36 characters new in Unicode 16, which ICU 77 knows and Python's
Unicode 15.1 does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ID_WIDTH, PANDAS_NA_TOKENS, PY_WHITESPACE, PY_WHITESPACE_CHARS

WS = f"[{PY_WHITESPACE}]"
WS_RUN = f"{WS}+"
NON_WS = f"[^{PY_WHITESPACE}]"
_OTHER_WS = PY_WHITESPACE_CHARS.replace(" ", "")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c) -> Column:
    """``not text.strip()`` in Python terms: empty or only Unicode whitespace. Null stays null."""
    return ~_col(c).rlike(NON_WS)


def collapse_whitespace(c) -> Column:
    """``' '.join(text.split())``: runs of whitespace become one space, ends trimmed.

    Every whitespace character is first mapped to a space with ``translate`` (one pass, no
    regex); the regex that merges runs of spaces only runs on values that contain two spaces
    in a row. Same result as ``trim(regexp_replace(text, '[ws]+', ' '))`` and about a third
    cheaper on prose, where nearly every space would otherwise be a regex match."""
    spaced = F.translate(_col(c), _OTHER_WS, " " * len(_OTHER_WS))
    merged = F.when(F.instr(spaced, "  ") > 0, F.regexp_replace(spaced, " {2,}", " ")).otherwise(spaced)
    return F.trim(merged)


def strip_whitespace(c) -> Column:
    """``text.strip()`` with Python's whitespace set."""
    return F.regexp_replace(_col(c), f"^{WS_RUN}|{WS_RUN}$", "")


def nfkc(c) -> Column:
    """Unicode NFKC on the JVM (ICU). Null stays null."""
    s = _col(c)
    return F.when(s.isNotNull(), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"),
                                           s, F.lit(True)))


def clean(c) -> Column:
    """The model-side preprocessing: NFKC, then strip and collapse whitespace."""
    return collapse_whitespace(nfkc(c))


def clean_catalyst(c) -> Column:
    """``clean`` without the NFKC step, for inputs known to be NFKC-stable (saves the ICU call
    and keeps the projection inside whole-stage codegen)."""
    return collapse_whitespace(c)


def zfill(c, width: int = ID_WIDTH) -> Column:
    """Python ``str.zfill``: left-pad with zeros after an optional sign, never truncate."""
    s = _col(c)
    signed = s.startswith("-") | s.startswith("+")
    return (F.when(F.length(s) >= width, s)
            .when(signed, F.concat(F.substring(s, 1, 1), F.lpad(F.substring(s, 2, 1 << 30), width - 1, "0")))
            .otherwise(F.lpad(s, width, "0")))


def na_to_null(c) -> Column:
    """Cells pandas would read as NaN become null."""
    s = _col(c)
    return F.when(~s.isin(PANDAS_NA_TOKENS), s)
