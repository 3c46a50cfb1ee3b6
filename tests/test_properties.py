from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from babelscore.functions.text import clean
from babelscore.operators import report
from babelscore.operators.classify import classify
from babelscore.operators.reshape import melt_languages
from babelscore.operators.scoring import LetterScorer
from babelscore.schema import LANGUAGES

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
cell = st.one_of(st.none(), st.sampled_from(["", " ", "\t\n", "　"]),
                 st.text(alphabet="anie ñé x.!\n", min_size=1, max_size=40))
wide_rows = st.lists(st.tuples(*[cell] * len(LANGUAGES)), min_size=1, max_size=15)


def wide_df(spark, rows):
    data = [(str(i + 1), *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "sentence_id string, " + ", ".join(f"{l} string" for l in LANGUAGES))


@SETTINGS
@given(st.lists(st.text(max_size=30), min_size=1, max_size=10))
def test_clean_is_idempotent(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(clean(F.col("t")).alias("c"))
    once = df.collect()
    twice = df.select(clean(F.col("c"))).collect()
    assert [r[0] for r in once] == [r[0] for r in twice]


@SETTINGS
@given(wide_rows)
def test_melt_count_is_non_blank_cells(spark, rows):
    want = sum(1 for r in rows for v in r if v is not None and v.strip())
    assert melt_languages(wide_df(spark, rows)).count() == want
    as_text = sum(1 for r in rows for v in r if v is None or v.strip())
    assert melt_languages(wide_df(spark, rows), missing="as_text").count() == as_text


@SETTINGS
@given(st.lists(st.text(alphabet="anie x", min_size=1, max_size=20).filter(str.strip), min_size=1, max_size=12))
def test_complete_fixture_rows_per_language_and_shares(spark, texts):
    rows = [tuple(t for _ in LANGUAGES) for t in texts]
    scored = classify(wide_df(spark, rows), LetterScorer())
    summary = {r.Language: r for r in report.summary_report(scored).collect()}
    assert all(summary[l].n == len(texts) for l in LANGUAGES)
    assert summary["Total"].n == len(texts) * len(LANGUAGES)
    shares = report.lang_share(scored, denominator="actual").collect()
    for l in LANGUAGES:
        assert abs(sum(r.pct for r in shares if r.Language == l) - 100.0) < 1e-9
    flags = scored.select((F.col("low_confidence_flag") == (F.col("Confidence") < 0.5)).alias("ok"),
                          "Confidence").collect()
    assert all(r.ok or abs(r.Confidence - 0.5) < 1e-10 for r in flags)
