"""The README and docs/QUERIES.md describe the library's queries that are actually registered."""
import os
import re

import __spark_entry__ as E
from babelscore.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_readme_query_count():
    text = open(os.path.join(ROOT, "README.md"), encoding="utf-8").read()
    n = int(re.search(r"(\d+) query keys of the library are registered", text).group(1))
    assert n == len(catalog.queries()) == len(catalog.oracle_sql())
    assert f"All {n} match DuckDB exactly" in text


def test_all_of_them_are_registered():
    assert set(catalog.queries()) <= set(E.queries()) and set(catalog.oracle_sql()) <= set(E.oracle_sql())


def test_queries_doc_lists_every_key():
    text = open(os.path.join(ROOT, "docs", "QUERIES.md"), encoding="utf-8").read()
    assert set(re.findall(r"^\| `([a-z_]+)` \|", text, re.M)) == set(catalog.queries())
