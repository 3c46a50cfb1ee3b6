"""Registered queries of the subpackage against their DuckDB SQL on the smallest test tables."""
import pytest

import __spark_entry__ as E
from babelscore.llm import oracle, queries
from tests.test_oracle import SPARK_TO_DUCKDB, con, norm  # noqa: F401

SF001 = "/root/testdata/sf0.001"


def test_all_operators_and_the_pipeline_are_registered():
    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} and names | {"pipeline"} <= set(E.queries())
    assert set(oracle.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_sql(spark, con, name):  # noqa: F811
    df = E.queries()[name](spark, SF001)
    rel = con.sql(oracle.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    duck_types = dict(zip(rel.columns, (str(t) for t in rel.types)))
    assert {c: SPARK_TO_DUCKDB.get(t, t) for c, t in df.dtypes} == duck_types
    at = [rel.columns.index(c) for c in df.columns]
    assert norm(df.collect()) == norm([tuple(r[i] for i in at) for r in rel.fetchall()])


def test_models_on_whole_tables(spark):
    """Queries without SQL: every row of the table, with the contract's columns."""
    for name, table, columns in (("op3_html_text", "pages", ["page_id", "url", "text", "n_chars"]),
                                 ("op5_langid", "documents", ["doc_id", "held_out", "lang_pred", "score"]),
                                 ("op7_quality_crf", "documents", ["doc_id", "held_out", "score", "predicted"]),
                                 ("op9_subword", "documents", ["doc_id", "n_tokens", "ids", "lossless"])):
        df = E.queries()[name](spark, SF001)
        assert df.columns == columns and df.count() == spark.read.parquet(f"{SF001}/{table}.parquet").count()
