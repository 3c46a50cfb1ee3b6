"""Every query of the library against its DuckDB SQL on the smallest test tables."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from babelscore.plans import catalog
from conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def norm(rows):
    def v(x):
        if isinstance(x, float) and math.isnan(x):
            return "NaN"
        return x
    return sorted((tuple(v(x) for x in r) for r in rows), key=repr)


SPARK_TO_DUCKDB = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
                   "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = E.queries()[name](spark, SF001)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    duck_types = dict(zip(rel.columns, (str(t) for t in rel.types)))
    assert {c: SPARK_TO_DUCKDB.get(t, t) for c, t in df.dtypes} == duck_types
    idx = [rel.columns.index(c) for c in df.columns]
    want = [tuple(r[i] for i in idx) for r in rel.fetchall()]
    assert norm(df.collect()) == norm(want)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() == 6 and "low_conf_pct" in df.columns


def test_every_query_is_documented():
    assert set(catalog.NOTES) == set(catalog.queries())
