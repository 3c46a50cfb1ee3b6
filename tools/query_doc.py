"""Write docs/QUERIES.md: every registered query with its SURVEY rows, meaning, output schema
and row count. usage: python tools/query_doc.py [sf_dir]"""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from babelscore.plans import catalog  # noqa: E402
from babelscore.plans.catalog import NOTES  # noqa: E402
from babelscore.session import build_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    qs, sql = catalog.queries(), catalog.oracle_sql()
    assert set(NOTES) == set(qs), set(NOTES) ^ set(qs)
    lines = [f"# Registered queries\n\nGenerated by `tools/query_doc.py` at {os.path.basename(sf)}. "
             "Every query reads the whole generated tables and has DuckDB SQL in `plans/oracle.py`.\n\n"
             "| query | SURVEY rows | returns | rows | columns |\n|---|---|---|---|---|\n"]
    for name, fn in qs.items():
        df = fn(spark, sf)
        rows, (rows_survey, what) = df.count(), NOTES[name]
        cols = ", ".join(f"{c} {t}" for c, t in df.dtypes)
        assert name in sql
        lines.append(f"| `{name}` | {rows_survey} | {what} | {rows} | {cols} |\n")
    out = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "QUERIES.md")
    with open(out, "w") as f:
        f.writelines(lines)
    print("wrote", out)


if __name__ == "__main__":
    main()
