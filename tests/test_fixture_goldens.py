"""The numbers FIXTURES.md publishes for the sf0.01 fixtures."""
import pytest

from babelscore.operators import report
from babelscore.plans import catalog
from babelscore.sources.testdata import EVENT_CATEGORIES
from conftest import SF01


@pytest.fixture(scope="module")
def scored(spark):
    return catalog._scored(spark, SF01).cache()


def test_wide_and_long_counts(spark):
    assert catalog._wide(spark, SF01).count() == 620
    long = catalog._long(spark, SF01)
    counts = {r.Language: r["count"] for r in long.groupBy("Language").count().collect()}
    assert counts == {"English": 620, "Spanish": 106, "French": 145, "German": 129}
    assert catalog._long(spark, SF01, "as_text").count() == 2480


def test_scored_class_and_low_confidence_counts(scored):
    got = {r.Language: (r.negative, r.neutral, r.positive, r.low_conf_n)
           for r in report.lang_summary(scored).collect()}
    assert got == {"English": (32, 587, 1, 43), "Spanish": (103, 0, 3, 27), "French": (101, 37, 7, 133),
                   "German": (6, 101, 22, 68), "Italian": (0, 0, 0, 0)}


def test_annotated_counts_and_means(spark):
    ann = catalog._annotated(spark, SF01)
    assert ann.count() == 10000
    dist = {r.final_category: r.n for r in report.taxonomy_dist(ann, EVENT_CATEGORIES).collect()}
    assert dist == {"click": 2006, "error": 2014, "purchase": 1981, "signup": 2017, "refund": 0}
    assert sum(dist.values()) == 8018
    w = report.weighted_mean(ann, EVENT_CATEGORIES).first()
    assert (round(w.weighted_mean, 6), round(w.plain_mean, 6)) == (50.01032, 50.009309)


def test_half_even_confidence_equals_python_round(spark):
    from pyspark.sql import functions as F
    from babelscore.functions.numeric import softmax
    from babelscore.operators.classify import score
    s = score(catalog._long(spark, SF01), catalog.SCORER).withColumn("c", F.array_max(softmax("logits", 3)))
    rows = s.select("c", F.bround("c", 10).alias("b")).collect()
    assert len(rows) == 1000 and all(r.b == round(r.c, 10) for r in rows)
