"""Edge rows for the text functions (FIXTURES.md §3)."""
import unicodedata

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from babelscore.functions.text import clean, collapse_whitespace, is_blank, na_to_null, nfkc, zfill


def one(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_zfill_matches_python(spark):
    vals = ["1", "12345", "-1", "", "abcdef", "+7", "-12345", "123", "1234"]
    assert one(spark, vals, zfill) == [v.zfill(4) for v in vals]
    assert one(spark, vals, zfill)[:5] == ["0001", "12345", "-001", "0000", "abcdef"]


def test_blank_filter(spark):
    vals = [" \t", " 　\u0085", "​", "x", "", "\x1c\x1f"]
    got = one(spark, vals, is_blank)
    assert got == [not v.strip() for v in vals]
    assert got[:3] == [True, True, False]


def test_collapse_matches_split_join(spark):
    s = "a  b\x1c\u0085  c\t d ​"
    assert one(spark, [s], collapse_whitespace) == ["a b c d ​"]
    assert one(spark, [s], collapse_whitespace) == [" ".join(s.split())]


def test_every_python_whitespace_char(spark):
    ws = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    text = "x" + "".join(ws) + "y"
    assert one(spark, [text], collapse_whitespace) == ["x y"]
    non = [chr(i) for i in range(0x3001) if not chr(i).isspace() and not 0xD800 <= i <= 0xDFFF]
    got = one(spark, ["".join(non)], is_blank)
    assert got == [False]
    singles = one(spark, non[:2000], is_blank)
    assert not any(singles)


def test_nfkc(spark):
    assert one(spark, ["ﬁne ①", None, "ó"], nfkc) == ["fine 1", None, "ó"]


def test_clean_keeps_order_nfkc_then_whitespace(spark):
    # NFKC turns U+2002 variants etc. into spaces that the collapse then removes.
    s = "  ﬁne  ①  "
    assert one(spark, [s], clean) == [" ".join(unicodedata.normalize("NFKC", s).split())]


def test_na_tokens(spark):
    vals = ["", "NA", "None", "null", "nan", "text", "N/A"]
    assert one(spark, vals, na_to_null) == [None, None, None, None, None, "text", None]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=30), min_size=1, max_size=10))
def test_clean_property_matches_python(spark, texts):
    got = one(spark, texts, clean)
    want = [" ".join(unicodedata.normalize("NFKC", t).split()) for t in texts]
    # ICU may know characters newer than Python's Unicode database; compare on those Python knows.
    for t, g, w in zip(texts, got, want):
        if all(unicodedata.category(c) != "Cn" for c in t):
            assert g == w


def test_whitespace_constants_agree_with_python():
    import re
    from babelscore.schema import PY_WHITESPACE, PY_WHITESPACE_CHARS
    want = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())
    assert PY_WHITESPACE_CHARS == want
    java_style = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\x{int(m.group(1), 16):02x}" if len(m.group(1)) <= 2
                        else f"\\u{int(m.group(1), 16):04x}", PY_WHITESPACE)
    cls = re.compile(f"[{java_style}]")
    assert "".join(chr(i) for i in range(0x110000) if cls.match(chr(i))) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab \t\n\r\x0b\x1c\xa0\u2003\u3000\u200b.")), max_size=25),
                min_size=1, max_size=10))
def test_collapse_matches_regex_form(spark, texts):
    from babelscore.functions.text import WS_RUN
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = df.select(collapse_whitespace("v"), F.trim(F.regexp_replace("v", WS_RUN, " "))).collect()
    assert all(a == b == " ".join(t.split()) for (a, b), t in zip(got, texts))
