"""Melt: missing columns, missing cells, blank cells, ids, the English source column."""
from babelscore.operators.reshape import melt_languages


def wide(spark):
    rows = [("1", "hello", "hola", None, " \t", "ciao"),
            ("0002", "bye", "NA", "salut", "tschüss", None),
            ("12345", None, "solo", None, None, None)]
    return spark.createDataFrame(rows, "sentence_id string, English string, Spanish string, "
                                       "French string, German string, Italian string")


def test_melt_drop(spark):
    got = melt_languages(wide(spark)).orderBy("sentence_id", "Language").collect()
    assert [(r.sentence_id, r.Language, r.Text, r.English_source) for r in got] == [
        ("0001", "English", "hello", "hello"), ("0001", "Italian", "ciao", "hello"),
        ("0001", "Spanish", "hola", "hello"),
        ("0002", "English", "bye", "bye"), ("0002", "French", "salut", "bye"),
        ("0002", "German", "tschüss", "bye"), ("0002", "Spanish", "NA", "bye"),
        ("12345", "Spanish", "solo", None)]


def test_melt_as_text_keeps_nan(spark):
    got = melt_languages(wide(spark), missing="as_text")
    # 3 rows x 5 languages, minus the whitespace-only German cell.
    assert got.count() == 14
    r = got.filter("sentence_id = '12345' and Language = 'English'").first()
    assert r.Text == "nan" and r.English_source == "nan"


def test_missing_language_column(spark):
    w = wide(spark).drop("Italian", "English")
    got = melt_languages(w)
    assert set(r.Language for r in got.collect()) == {"Spanish", "French", "German"}
    assert set(r.English_source for r in got.collect()) == {""}


def test_melt_is_map_only(spark):
    plan = melt_languages(wide(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Expand" in plan


def test_ids_as_pandas_prints_them(spark):
    df = spark.createDataFrame([("0001", "a"), ("00012", "b"), ("x7", "c"), (None, "d"), ("-3", "e")],
                               "sentence_id string, English string")
    got = [r.sentence_id for r in melt_languages(df, ["English"]).orderBy("Text").collect()]
    assert got == ["0001", "0012", "00x7", None, "-003"]


def test_dotted_and_spaced_headers(spark):
    df = spark.createDataFrame([("1", "hi", "hola")], "sentence_id string, English string, `Spanish (ES).v2` string")
    got = melt_languages(df, ["English", "Spanish (ES).v2"]).collect()
    assert sorted((r.Language, r.Text) for r in got) == [("English", "hi"), ("Spanish (ES).v2", "hola")]
