"""Distributed per-group numbering equals row_number() over (partition by g order by k)."""
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from babelscore.operators.numbering import number_within_groups
from babelscore.sources.testdata import wide_from_documents
from conftest import SF001, SF01


def expected(df, g, k):
    return df.withColumn("want", F.row_number().over(Window.partitionBy(g).orderBy(k)))


def test_any_number_of_buckets_matches_window(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    want = {r.doc_id: r.want for r in expected(docs, "lang", "doc_id").collect()}
    for buckets in (None, 1, 2, 37):
        got = {r.doc_id: r.rn for r in number_within_groups(docs, "lang", "doc_id", buckets=buckets).collect()}
        assert got == want, buckets


def test_one_plan_at_every_size(spark):
    def operators(sf):
        docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
        plan = number_within_groups(docs, "lang", "doc_id")._jdf.queryExecution().optimizedPlan().toString()
        return re.findall(r"^[\s:+-]*([A-Z]\w+)", plan, flags=re.M)

    small, large = operators(SF001), operators("/root/testdata/sf0.1")
    assert small == large and small.count("Window") == 2


def test_hot_group_and_sparse_keys(spark):
    rows = [("hot", i * 1_000_003) for i in range(3000)] + [("cold", i * 7) for i in range(50)] + [("hot", 10 ** 15)]
    df = spark.createDataFrame(rows, "g string, k long")
    want = {(r.g, r.k): r.want for r in expected(df, "g", "k").collect()}
    got = {(r.g, r.k): r.rn for r in number_within_groups(df, "g", "k", buckets=30).collect()}
    assert got == want


def test_null_group_kept(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)] + [("a", i) for i in range(10, 40)], "g string, k long")
    got = number_within_groups(df, "g", "k", buckets=6)
    assert got.count() == df.count()
    assert sorted(r.rn for r in got.filter("g is null").collect()) == [1, 2]


def test_null_order_keys_kept_and_first(spark):
    rows = [("a", None), ("a", None)] + [("a", i) for i in range(60)] + [("b", None)] + [("b", i) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, k long")
    got = number_within_groups(df, "g", "k", buckets=8).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.k, r.rn))
    for pairs in by.values():
        assert sorted(rn for _, rn in pairs) == list(range(1, len(pairs) + 1))
        nulls = sorted(rn for k, rn in pairs if k is None)
        assert nulls == list(range(1, len(nulls) + 1))


def test_all_null_keys_and_empty(spark):
    df = spark.createDataFrame([("a", None)] * 30 + [("b", None)] * 5, "g string, k long")
    got = number_within_groups(df, "g", "k", buckets=4)
    assert sorted(r.rn for r in got.filter("g = 'b'").collect()) == [1, 2, 3, 4, 5] and got.count() == 35
    assert number_within_groups(df.filter("false"), "g", "k").count() == 0


@pytest.mark.parametrize("rows", [3, 600])
def test_text_keys_are_refused_at_any_size(spark, rows):
    df = spark.createDataFrame([("a", f"k{i}") for i in range(rows)], "g string, k string")
    with pytest.raises(TypeError, match="numeric"):
        number_within_groups(df, "g", "k")


def test_wide_fixture_same_with_many_buckets(spark):
    one, many = wide_from_documents(spark, SF01, buckets=1), wide_from_documents(spark, SF01, buckets=37)
    assert one.count() == many.count() == 620
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
