"""Classification: Catalyst and UDF scorer forms agree; plan shapes; model runs once."""
import math
import unicodedata


from babelscore.operators.classify import classify, score
from babelscore.operators.reshape import melt_languages
from babelscore.operators.scoring import LetterScorer
from babelscore.sources.testdata import wide_from_documents
from conftest import SF001

LABELS = ["negative", "neutral", "positive"]


def python_reference(text, threshold=0.5):
    t = " ".join(unicodedata.normalize("NFKC", text).split())
    x = [30.0 * (t.count(ch) / len(t)) for ch in "ani"]
    m = max(x)
    e = [math.exp(v - m) for v in x]
    s = e[0] + e[1] + e[2]
    p = [v / s for v in e]
    i = p.index(max(p))
    return LABELS[i], round(p[i], 10), p[i] < threshold


def test_catalyst_form_matches_python(spark):
    wide = wide_from_documents(spark, SF001)
    got = classify(wide, LetterScorer()).collect()
    assert len(got) == 200
    for r in got:
        assert (r.Sentiment, r.Confidence, r.low_confidence_flag) == python_reference(r.Text)


def test_udf_form_equals_catalyst_form(spark):
    wide = wide_from_documents(spark, SF001)
    a = classify(wide, LetterScorer(), form="catalyst")
    b = classify(wide, LetterScorer(), form="udf", batch_size=7, sort_by_length=True)
    key = ["sentence_id", "Language"]
    assert sorted(a.collect()) == sorted(b.collect())
    assert a.select(*key).distinct().count() == 200


def test_plans(spark):
    wide = wide_from_documents(spark, SF001)
    cat = classify(wide, LetterScorer())._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in cat and "BatchEvalPython" not in cat
    udf = classify(wide, LetterScorer(), form="udf")._jdf.queryExecution().executedPlan().toString()
    assert udf.count("ArrowEvalPython") == 1


def test_scan_is_pruned_and_filtered(spark):
    wide = wide_from_documents(spark, SF001)
    plan = classify(wide, LetterScorer())._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan
    assert "PushedFilters: [In(lang" in plan


def test_clean_text_not_in_output_and_text_raw(spark):
    df = spark.createDataFrame([("1", "  a  n  ", None)], "sentence_id string, English string, Spanish string")
    r = classify(df, LetterScorer()).first()
    assert r.Text == "  a  n  "
    s = score(melt_languages(df), LetterScorer()).first()
    assert s.clean_text == "a n"


def test_classify_job_plan_has_no_shuffle(spark, tmpdir_path):
    from babelscore.sources import csv_io
    path = tmpdir_path + "/wide.parquet"
    wide_from_documents(spark, SF001).write.parquet(path)
    wide = spark.read.parquet(path)
    for form in ("catalyst", "udf"):
        plan = classify(wide, LetterScorer(), form=form, sort_by_length=True)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, form
    csv_io.write_results(classify(wide, LetterScorer(), form="udf"), tmpdir_path + "/scored")
    assert spark.read.parquet(tmpdir_path + "/scored").count() == 200


def test_capitalised_model_labels_are_lower_cased(spark):
    from babelscore.operators.classify import decide
    df = spark.createDataFrame([([0.1, 2.0, 0.3],)], "logits array<double>")
    r = decide(df, "logits", ["Negative", "Neutral", "Positive"], keep_scores=True).first()
    assert r.Sentiment == "neutral" and set(r.scores) == {"negative", "neutral", "positive"}


def test_probability_inputs_kept_as_given(spark):
    import numpy as np
    from babelscore.operators.classify import decide
    p32 = np.array([0.2, 0.49999997, 0.30000003], dtype=np.float32)
    df = spark.createDataFrame([([float(v) for v in p32],)], "probs array<double>")
    r = decide(df, "probs", ["negative", "neutral", "positive"], inputs="probs").first()
    assert r.Sentiment == "neutral" and r.low_confidence_flag is True
    assert r.Confidence == round(float(p32[1]), 10)
