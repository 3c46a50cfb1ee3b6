"""CSV sources and sinks: BOM, quotes, embedded newlines, padding, pandas-style booleans."""
import glob
import os

import pandas as pd
import pytest

from babelscore.schema import OUT_COLS
from babelscore.sources import csv_io

TRICKY = 'he said ""hi"", ok'


def test_read_wide_bom_quotes_newlines(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "wide.csv")
    with open(p, "w", encoding="utf-8-sig", newline="") as f:
        f.write('sentence_id,English,Spanish\n')
        f.write(f'1,"{TRICKY}","uno\ndos"\n')
        f.write('0002,  padded  ,NA\n')
        f.write('3,,x\n')
    got = csv_io.read_wide(spark, p).orderBy("sentence_id").collect()
    ref = pd.read_csv(p, encoding="utf-8-sig", dtype=str, keep_default_na=True)
    assert list(ref.columns) == ["sentence_id", "English", "Spanish"]
    assert [tuple(r) for r in got] == [
        ("0002", "  padded  ", None), ("1", 'he said "hi", ok', "uno\ndos"), ("3", None, "x")]
    assert ref.English.tolist()[:2] == ['he said "hi", ok', "  padded  "]


def test_results_round_trip_and_bytes(spark, tmpdir_path):
    rows = [("0001", "English", 'a "q", b', "src\nline", "neutral", 0.5004882812, False),
            ("0002", "Spanish", "  pad ", "", "negative", 0.3333333333, True)]
    df = spark.createDataFrame(rows, "sentence_id string, Language string, Text string, English_source string, "
                                     "Sentiment string, Confidence double, low_confidence_flag boolean")
    out = os.path.join(tmpdir_path, "res")
    csv_io.write_results(df, out, fmt="csv")
    back = csv_io.read_results(spark, out).select(*OUT_COLS).orderBy("sentence_id").collect()
    assert [tuple(r) for r in back] == [r if r[3] != "" else r[:3] + (None,) + r[4:] for r in rows]
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{out}/part-*.csv")))
    pd_text = pd.DataFrame(rows, columns=OUT_COLS).to_csv(index=False)
    body = [l for l in text.splitlines() if not l.startswith("sentence_id")]
    assert "\n".join(body) + "\n" == pd_text.split("\n", 1)[1]


def test_missing_input_raises(spark, tmpdir_path):
    from pyspark.errors import AnalysisException
    import pytest
    with pytest.raises(AnalysisException):
        csv_io.read_wide(spark, os.path.join(tmpdir_path, "absent.csv")).collect()


def test_missing_cells_through_csv(spark, tmpdir_path):
    from babelscore.operators.reshape import melt_languages
    p = os.path.join(tmpdir_path, "wide_na.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("sentence_id,English,Spanish,French\n1,,None,NA\n2,ok,n/a,fine\n")
    wide = csv_io.read_wide(spark, p)
    as_text = {(r.sentence_id, r.Language): r.Text
               for r in melt_languages(wide, ["English", "Spanish", "French"], missing="as_text").collect()}
    assert as_text == {("0001", "English"): "nan", ("0001", "Spanish"): "nan", ("0001", "French"): "nan",
                       ("0002", "English"): "ok", ("0002", "Spanish"): "nan", ("0002", "French"): "fine"}
    ref = pd.read_csv(p)
    assert [str(v) for v in ref.iloc[0, 1:]] == ["nan", "nan", "nan"]
    dropped = melt_languages(wide, ["English", "Spanish", "French"]).collect()
    assert sorted((r.sentence_id, r.Language) for r in dropped) == [("0002", "English"), ("0002", "French")]


def test_crlf_files(spark, tmpdir_path):
    """Windows line endings: field ends stay clean; inside a quoted field Spark's parser turns
    CRLF into LF (pandas keeps CRLF). The cleaned text, and so the class, is the same."""
    from pyspark.sql import functions as F
    from babelscore.functions.text import clean
    p = os.path.join(tmpdir_path, "crlf.csv")
    with open(p, "wb") as f:
        f.write(b'sentence_id,English,Spanish\r\n1,"two\r\nlines",hola\r\n2,plain,adios\r\n')
    got = csv_io.read_wide(spark, p).orderBy("sentence_id")
    assert [tuple(r) for r in got.collect()] == [("1", "two\nlines", "hola"), ("2", "plain", "adios")]
    ref = pd.read_csv(p, dtype=str)
    assert ref.English[0] == "two\r\nlines"
    assert got.select(clean(F.col("English"))).first()[0] == " ".join(ref.English[0].split())


def _write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as f:
        f.write(text)


@pytest.mark.parametrize("multiline", [True, False])
def test_columns_go_by_name_in_every_file(spark, tmpdir_path, multiline):
    _write(tmpdir_path, "a.csv", "sentence_id,English,Spanish\n1,hello,hola\n")
    _write(tmpdir_path, "b.csv", "﻿Spanish,sentence_id,English\nhola mundo,2,hello world\n")
    _write(tmpdir_path, "c.csv", "sentence_id,Spanish\n3,sol\n")
    _write(tmpdir_path, "d.csv", "sentence_id,English,Spanish\n4,moon,luna\n")
    rows = csv_io.read_wide(spark, tmpdir_path, multiline=multiline).select("sentence_id", "English", "Spanish").collect()
    assert sorted(map(tuple, rows)) == [("1", "hello", "hola"), ("2", "hello world", "hola mundo"), ("3", None, "sol"), ("4", "moon", "luna")]


def test_stream_columns_go_by_name(spark, tmpdir_path):
    from babelscore.streaming.classify_stream import read_wide_stream

    src, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    _write(src, "a.csv", "﻿Spanish,sentence_id,English\nhola mundo,2,hello world\n\"sol,\ny luna\",3,NA\n")
    _write(src, "b.csv", "sentence_id,Spanish\n4,mar\n5,cielo\n")
    _write(src, "c.csv", "sentence_id,English,Spanish\n")
    stream = read_wide_stream(spark, src, languages=["English", "Spanish"])
    q = (stream.writeStream.format("parquet").option("checkpointLocation", os.path.join(tmpdir_path, "ck"))
         .trigger(availableNow=True).start(out))
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(out).select("sentence_id", "English", "Spanish").collect()))
    assert got == [("2", "hello world", "hola mundo"), ("3", None, "sol,\ny luna"), ("4", None, "mar"), ("5", None, "cielo")]


def test_headers_of_many_files_take_one_job(spark, tmpdir_path):
    """Thousands of files with three headers: as many jobs as a dozen files take."""
    def jobs_for(folder, n):
        for i in range(n):
            text = ("sentence_id,English,Spanish\n{0},a{0},b{0}\n", "Spanish,sentence_id\nb{0},{0}\n", "sentence_id,English\n{0},a{0}\n")[i % 3]
            _write(folder, f"f{i}.csv", text.format(i))
        spark.sparkContext.setJobGroup(folder, "headers")
        groups = csv_io.header_groups(spark, folder)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(folder))
        spark.sparkContext.setJobGroup("default", "")
        assert sorted(map(len, groups)) == sorted((n - k + 2) // 3 for k in range(3))
        return jobs
    few, many = jobs_for(os.path.join(tmpdir_path, "few"), 40), jobs_for(os.path.join(tmpdir_path, "many files"), 5000)
    assert many <= few + 1  # one more lists a large folder in parallel
    assert spark.conf.get("spark.sql.files.openCostInBytes") == "4194304b"
    rows = csv_io.read_wide(spark, os.path.join(tmpdir_path, "few")).select("sentence_id", "English", "Spanish").collect()
    assert sorted(map(tuple, rows)) == sorted((str(i), f"a{i}" if i % 3 != 1 else None, f"b{i}" if i % 3 != 2 else None) for i in range(40))


def test_size_settings():
    assert [csv_io.in_bytes(s) for s in ("134217728b", "128m", "64kb", "1", "2G")] == [1 << 27, 1 << 27, 1 << 16, 1, 1 << 31]


def _broad(order, rows, quote=True):
    """A file of 70 columns and more: fillers, with the named ones at their places."""
    lines = []
    for cells in [{k: k for k in order}, *rows]:
        lines.append(",".join('"%s"' % (cells.get(k) or "").replace('"', '""') if quote else cells.get(k) or "" for k in order))
    return "\n".join(lines) + "\n"


def test_broad_files_keep_their_languages(spark, tmpdir_path):
    """Columns past the directly read ones, in batch and stream; quoted commas, line breaks and quotes."""
    from babelscore.streaming.classify_stream import read_wide_stream

    fill = [f"x{k}" for k in range(80)]
    rows = [{"sentence_id": "1", "English": 'say "hi",\nyou', "Spanish": "hola", "x3": "a,b"}, {"sentence_id": "2", "English": "two", "Spanish": ""}]
    src = os.path.join(tmpdir_path, "in files")
    _write(src, "late.csv", _broad([*fill[:72], "sentence_id", "Spanish", "English"], rows))
    _write(src, "early.csv", _broad(["sentence_id", "English", *fill[:75], "Spanish"], [{"sentence_id": "3", "English": "three", "Spanish": "tres"}], quote=False))
    _write(src, "small.csv", "sentence_id,English\n4,four\n")
    want = [("1", 'say "hi",\nyou', "hola"), ("2", "two", None), ("3", "three", "tres"), ("4", "four", None)]
    stream = read_wide_stream(spark, src, languages=["English", "Spanish"])
    out = os.path.join(tmpdir_path, "out")
    q = (stream.writeStream.format("parquet").option("checkpointLocation", os.path.join(tmpdir_path, "ck")).trigger(availableNow=True).start(out))
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(out).select("sentence_id", "English", "Spanish").collect())) == want
    batch = csv_io.read_wide(spark, src).select("sentence_id", "English", "Spanish").collect()
    assert sorted(map(tuple, batch)) == want
