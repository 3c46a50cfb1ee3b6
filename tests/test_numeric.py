"""Softmax, arg-max, rounding, flag, safe cast and label formatting (FIXTURES.md §3)."""
import math

import numpy as np
from hypothesis import given, settings, strategies as st

from babelscore.functions import fmt
from babelscore.functions.numeric import argmax1, safe_double, softmax
from babelscore.operators.classify import decide


def test_argmax_first_max_and_nan(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.1, float("nan"), 0.5],)], "p array<double>")
    got = [r[0] - 1 for r in df.select(argmax1("p")).collect()]
    assert got == [int(np.argmax([0.4, 0.4, 0.2])), int(np.argmax([0.1, np.nan, 0.5]))] == [0, 1]


def test_half_even_rounding_and_flag(spark):
    # Logits whose softmax top probability is exactly 1025/2048 etc. are awkward to build, so
    # test decide() through probabilities: logits = log(p) gives softmax(p) = p when sum(p) = 1.
    rows = []
    for top in (1025 / 2048, 1027 / 2048, 0.5, float(np.float32(0.49999997))):
        rest = (1 - top) / 2
        rows.append(([math.log(top), math.log(rest), math.log(rest)],))
    df = decide(spark.createDataFrame(rows, "logits array<double>"), "logits", ["negative", "neutral", "positive"])
    got = df.select("Confidence", "low_confidence_flag").collect()
    assert [round(r[0], 10) for r in got[:2]] == [0.5004882812, 0.5014648438]
    assert got[0][0] == round(1025 / 2048, 10) and got[1][0] == round(1027 / 2048, 10)
    assert [r[1] for r in got[2:]] == [False, True]


def test_flag_nan_is_not_low(spark):
    df = spark.createDataFrame([([float("nan"), 0.0, 0.0],)], "logits array<double>")
    r = decide(df, "logits", ["negative", "neutral", "positive"]).first()
    assert r.low_confidence_flag is False and r.Sentiment == "negative"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.floats(-50, 50), min_size=3, max_size=3), min_size=1, max_size=8))
def test_softmax_matches_numpy(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "x array<double>")
    for fixed in (3, None):
        got = [r[0] for r in df.select(softmax("x", fixed)).collect()]
        for x, p in zip(rows, got):
            e = np.exp(np.array(x) - max(x))
            assert np.allclose(p, e / e.sum(), rtol=1e-12, atol=1e-15)
            assert abs(sum(p) - 1) < 1e-12


def test_safe_cast(spark):
    vals = [" 0.5 ", "1e-3", "x", "", "1_0", "1.0d", "inf", "nan", "-2.", ".5", "1.0E-5", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(safe_double("v")).collect()]
    assert got == [0.5, 0.001, None, None, None, None, None, None, -2.0, 0.5, 1e-5, None]


def test_labels_round_half_even(spark):
    df = spark.createDataFrame([(12.25, 2.5, 1234567, "Negative")], "a double, b double, n long, l string")
    r = df.select(fmt.fixed("a", 1), fmt.fixed("b", 0), fmt.legend_label("l", "n", "a"),
                  fmt.grand_label("n"), fmt.share_label("a", "n"), fmt.mean_label("a")).first()
    assert r[0] == f"{12.25:.1f}" == "12.2"
    assert r[1] == f"{2.5:.0f}" == "2"
    assert r[2] == f"Negative  {1234567:,}  ({12.25:.1f}%)"
    assert r[3] == "n = 1,234,567"
    assert r[4] == f"{12.25:.1f}%  (n=1234567)"
    assert r[5] == f"Mean: {12.25:.3f}"


def test_segment_label(spark):
    df = spark.createDataFrame([(12, 3.5, True), (3, 2.5, False), (1, None, True)], "n long, p double, i boolean")
    got = [r[0] for r in df.select(fmt.segment_label("n", "p", "i")).collect()]
    assert got == [f"12\n({3.5:.0f}%)", f"3 ({2.5:.0f}%)", None]
