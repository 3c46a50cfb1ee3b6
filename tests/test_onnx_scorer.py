"""OnnxScorer through predict_batch_udf, with a tiny real ONNX model (tests/onnx_fixture.py)."""
import numpy as np

import onnx_fixture as fx
from babelscore.operators.classify import classify, score
from babelscore.operators.reshape import melt_languages
from babelscore.operators.scoring import OnnxScorer

TEXTS = ["the bus is late", "a good clean train station and more words", "zzz", "  bad   bad bad  "]


def test_onnx_scorer_in_spark(spark, tmpdir_path):
    model, tok = fx.write_fixture(tmpdir_path)
    scorer = OnnxScorer(model, tok, max_length=4, pad_id=0)
    wide = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "sentence_id string, English string")
    got = score(melt_languages(wide, ["English"]), scorer, form="udf", batch_size=3) \
        .orderBy("sentence_id").select("clean_text", "logits").collect()
    clean = [" ".join(t.split()) for t in TEXTS]
    assert [r.clean_text for r in got] == clean
    assert np.allclose(np.array([r.logits for r in got]), fx.expected_logits(tok, clean, 4))

    out = classify(wide, scorer, ["English"], form="udf").orderBy("sentence_id").collect()
    want = fx.expected_logits(tok, clean, 4)
    for r, x in zip(out, want):
        p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        assert r.Sentiment == ["negative", "neutral", "positive"][int(np.argmax(p))]
        assert abs(r.Confidence - p.max()) < 1e-7  # the model computes in float32
    plan = classify(wide, scorer, ["English"], form="udf")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_length_sort_only_for_padding_models(spark, tmpdir_path):
    from babelscore.operators.scoring import LetterScorer
    model, tok = fx.write_fixture(tmpdir_path)
    wide = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "sentence_id string, English string")
    for scorer, sorted_ in ((OnnxScorer(model, tok, pad_id=0), True), (LetterScorer(), False)):
        df = classify(wide, scorer, ["English"], form="udf", sort_by_length=scorer.pads_batches)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert ("Sort [" in plan) == sorted_ and "Exchange" not in plan


def test_truncated_texts_are_counted(spark, tmpdir_path):
    from pyspark.sql import Observation

    from babelscore.plans.jobs import classify_job

    model, tok = fx.write_fixture(tmpdir_path)
    wide = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "sentence_id string, English string")
    src = f"{tmpdir_path}/wide"
    wide.write.parquet(src)
    cut = Observation("cut")
    classify_job(spark, src, f"{tmpdir_path}/scored", OnnxScorer(model, tok, max_length=4, pad_id=0), input_format="parquet",
                 languages=["English"], truncation=cut)
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tok)
    t.no_truncation()
    want = sum(len(t.encode(" ".join(x.split())).ids) > 4 for x in TEXTS)
    assert cut.get["truncated"] == want > 0
    # One model pass, not a second one for the count.
    df = classify(wide, OnnxScorer(model, tok, max_length=4, pad_id=0), ["English"], form="udf", truncation=Observation("again"))
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_every_text_is_tokenised_once(tmpdir_path, monkeypatch):
    import tokenizers

    model, tok = fx.write_fixture(tmpdir_path)
    seen = []

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch(self, texts):
            seen.extend(texts)
            return self.inner.encode_batch(texts)
    real = tokenizers.Tokenizer.from_file

    class Patched:
        from_file = staticmethod(lambda path: Counting(real(path)))
    monkeypatch.setattr(tokenizers, "Tokenizer", Patched)
    texts = np.array(["one", "a much longer text than four tokens", "two words", "", "one"] * 5)
    out = OnnxScorer(model, tok, max_length=4, pad_id=0, token_budget=6).make_counting_fn()(texts)
    assert seen == texts.tolist() and out.shape == (25, 4)
    assert out[:, -1].tolist() == [0, 1, 0, 0, 0] * 5
    monkeypatch.undo()
    whole = OnnxScorer(model, tok, max_length=4, pad_id=0, token_budget=10_000).make_predict_fn()(texts)
    assert np.allclose(out[:, :-1], whole)
    assert np.allclose(whole, fx.expected_logits(tok, texts.tolist(), 4), equal_nan=True)


def test_token_batches_hold_their_budget():
    from babelscore.operators.scoring import token_batches

    rng = np.random.default_rng(1)
    for budget in (1, 10, 100, 10_000):
        size = rng.integers(0, 60, 200)
        parts = list(token_batches(size, budget))
        assert sorted(np.concatenate(parts).tolist()) == list(range(200))
        assert all(len(p) * size[p].max() <= budget or len(p) == 1 for p in parts)
    assert list(token_batches(np.zeros(0, dtype=np.int64), 5)) == []
