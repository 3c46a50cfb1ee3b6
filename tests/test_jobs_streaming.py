"""Batch jobs end to end on CSV input, and the same classification on a file stream."""
import glob
import os

import pandas as pd

from babelscore.operators.classify import classify
from babelscore.operators.scoring import LetterScorer
from babelscore.plans.jobs import classify_job, main as jobs_main, report_job
from babelscore.schema import OUT_COLS
from babelscore.sources import csv_io
from babelscore.sources.testdata import wide_from_documents
from babelscore.streaming.classify_stream import (classify_stream, read_wide_stream,
                                                  summary_from_memory, summary_stream)
from conftest import SF001


def write_wide_csv(spark, path):
    csv_io.write_csv(wide_from_documents(spark, SF001), path)
    return path


def test_classify_and_report_jobs(spark, tmpdir_path):
    src = write_wide_csv(spark, os.path.join(tmpdir_path, "wide"))
    scored = classify_job(spark, src, os.path.join(tmpdir_path, "scored"), LetterScorer(),
                          csv_output=os.path.join(tmpdir_path, "scored_csv"), partition_by="Language")
    batch = classify(csv_io.read_wide(spark, src), LetterScorer(), form="catalyst")
    assert sorted(scored.select(*OUT_COLS).collect()) == sorted(batch.collect())
    assert os.path.isdir(os.path.join(tmpdir_path, "scored", "Language=English"))

    ann = os.path.join(tmpdir_path, "ann.csv")
    pd.DataFrame({"final_category": ["Irony / Sarcasm", "Mixed Sentiment", "Other"],
                  "Confidence": ["0.41", "x", "0.3"]}).to_csv(ann, index=False, encoding="utf-8-sig")
    paths = report_job(spark, os.path.join(tmpdir_path, "scored"), os.path.join(tmpdir_path, "out"), ann)
    assert set(paths) >= {"summary_report", "chart_donut", "chart_stack", "chart_taxonomy",
                          "weighted_mean", "low_confidence_cases"}
    tax = pd.concat(pd.read_csv(f, keep_default_na=False) for f in glob.glob(paths["chart_taxonomy"] + "/*.csv"))
    assert tax.set_index("final_category").loc["Irony / Sarcasm", "n"] == 1
    assert len(tax) == 6


def test_cli_classify(spark, tmpdir_path, capsys):
    src = write_wide_csv(spark, os.path.join(tmpdir_path, "wide"))
    out = os.path.join(tmpdir_path, "scored")
    jobs_main(["classify", "--input", src, "--output", out])
    assert spark.read.parquet(out).count() == 200
    printed = capsys.readouterr().out
    assert "Total records classified: 200" in printed
    assert "127 sentences × 5 languages = 635 predictions" in printed
    assert "  English    neg=" in printed and "Total low-confidence (< 0.5): " in printed


def test_stream_equals_batch(spark, tmpdir_path):
    src = write_wide_csv(spark, os.path.join(tmpdir_path, "in"))
    out = os.path.join(tmpdir_path, "stream_out")
    stream = read_wide_stream(spark, src, languages=["English", "Spanish", "French", "German"])
    q = classify_stream(stream, out, LetterScorer(), checkpoint_dir=os.path.join(tmpdir_path, "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(out).select(*OUT_COLS)
    want = classify(csv_io.read_wide(spark, src), LetterScorer())
    assert sorted(got.collect()) == sorted(want.collect())

    scored_stream = spark.readStream.schema(got.schema).parquet(out)
    s = summary_stream(scored_stream, "running_summary", checkpoint_dir=os.path.join(tmpdir_path, "ck2"))
    s.awaitTermination(120)
    from babelscore.operators.report import summary_report
    assert summary_from_memory(spark, "running_summary").collect() == summary_report(want).collect()


def test_report_job_on_pandas_written_results(spark, tmpdir_path):
    """A results CSV as the original tooling writes it (pandas, BOM-tolerant readers) feeds the
    report job directly, and the reports equal those computed from the typed rows."""
    rows = [("0001", "English", 'He said "hi", ok', "He said \"hi\", ok", "neutral", 0.9, False),
            ("0001", "Spanish", "Dijo\n\"hola\"", "He said \"hi\", ok", "negative", 0.41, True),
            ("0002", "German", " padded ", "x", "positive", 0.7, False),
            ("0002", "Italian", "ciao", "x", "positive", 0.45, True)]
    pdf = pd.DataFrame(rows, columns=OUT_COLS)
    path = os.path.join(tmpdir_path, "results.csv")
    pdf.to_csv(path, index=False, encoding="utf-8-sig")
    paths = report_job(spark, path, os.path.join(tmpdir_path, "out"), results_format="csv")
    got = pd.concat(pd.read_csv(f) for f in glob.glob(paths["summary_report"] + "/*.csv")).set_index("Language")
    assert got.loc["Total", "n"] == 4 and got.loc["Total", "low_conf_n"] == 2
    assert got.loc["Italian", "positive"] == 1 and got.loc["French", "n"] == 0
    low = spark.read.options(header=True, multiLine=True, escape='"').csv(paths["low_confidence_cases"])
    assert sorted(r.Text for r in low.collect()) == sorted(["Dijo\n\"hola\"", "ciao"])


def test_single_line_csv_is_split(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "big.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("sentence_id,English,Spanish\n")
        for i in range(40000):
            f.write(f"{i},the bus number {i} was late again today,el autobus llego tarde\n")
    from babelscore.plans.jobs import read_input
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 * 1024))
    try:
        split = read_input(spark, path, multiline=False)
        whole = read_input(spark, path, multiline=True)
        assert split.rdd.getNumPartitions() > 1 and whole.rdd.getNumPartitions() == 1
        assert split.count() == whole.count() == 40000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_report_tables_share_one_scan(spark, tmpdir_path):
    from babelscore.plans.jobs import report_tables
    src = write_wide_csv(spark, os.path.join(tmpdir_path, "wide"))
    scored = classify_job(spark, src, os.path.join(tmpdir_path, "scored"), LetterScorer())
    tables = report_tables(scored)
    for name in ("summary_report", "class_dist", "chart_donut", "chart_stack"):
        tables[name].collect()
        plan = tables[name]._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" in plan, name
        assert "ReadSchema: struct<Language:string,Sentiment:string,low_confidence_flag:boolean>" in plan
    scan = tables["low_confidence_cases"]._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(low_confidence_flag), EqualTo(low_confidence_flag,true)]" in scan


def test_cli_short_flags_and_device(spark, tmpdir_path, capsys):
    import onnx_fixture as fx
    src = write_wide_csv(spark, os.path.join(tmpdir_path, "wide"))
    model, tok = fx.write_fixture(tmpdir_path)
    out = os.path.join(tmpdir_path, "scored")
    jobs_main(["classify", "-i", src, "-o", out, "-t", "0.6", "-b", "16", "-d", "cpu",
               "--model", model, "--tokenizer", tok])
    assert spark.read.parquet(out).count() == 200
    assert "Total low-confidence (< 0.6)" in capsys.readouterr().out


def test_cli_report_with_parquet_annotations(spark, tmpdir_path):
    src = write_wide_csv(spark, os.path.join(tmpdir_path, "wide"))
    scored = os.path.join(tmpdir_path, "scored")
    classify_job(spark, src, scored, LetterScorer())
    ann = os.path.join(tmpdir_path, "ann")
    spark.createDataFrame([("Mixed Sentiment", "0.4"), ("Other", "0.2")],
                          "final_category string, Confidence string").write.parquet(ann)
    out = os.path.join(tmpdir_path, "out")
    jobs_main(["report", "--results", scored, "--lowconf", ann, "--lowconf-format", "parquet",
               "--outdir", out, "--denominator", "375"])
    tax = pd.concat(pd.read_csv(f, keep_default_na=False) for f in glob.glob(out + "/chart_taxonomy/*.csv"))
    assert tax.set_index("final_category").loc["Mixed Sentiment", "pct"] == 50.0
    stack = pd.concat(pd.read_csv(f, float_precision="round_trip") for f in glob.glob(out + "/chart_stack/*.csv"))
    assert (stack.pct.dropna() == stack.n[stack.pct.notna()] / 375 * 100).all()


def test_report_notebook_style(spark, tmpdir_path):
    from babelscore.plans.jobs import report_tables
    src = write_wide_csv(spark, os.path.join(tmpdir_path, "wide"))
    scored = classify_job(spark, src, os.path.join(tmpdir_path, "scored"), LetterScorer())
    ann = spark.createDataFrame([("Mixed Sentiment", "x"), ("Irony / Sarcasm", "0.4")],
                                "final_category string, Confidence string")
    nb = report_tables(scored, ann, style="notebook")
    stack = nb["chart_stack"].collect()
    by_ord = sorted((r.ord, r.Language) for r in stack if r.class_ord == 0)
    assert [l for _, l in by_ord] == ["English", "Spanish", "French", "German", "Italian"]
    n = scored.count()
    assert all(r.pct == r.n / (n // 5) * 100 for r in stack)
    tax = {r.final_category: r for r in nb["chart_taxonomy"].collect()}
    assert tax["Mixed Sentiment"].mean_conf is None and tax["Irony / Sarcasm"].mean_conf == 0.4
    assert nb["weighted_mean"].first().weighted_mean == 0.4
    script = report_tables(scored, ann)
    assert {r.final_category: r.mean_conf for r in script["chart_taxonomy"].collect()}["Mixed Sentiment"] == 0.0
