"""Write docs/PLANS.md: the physical plan of every registered query, with a summary table.

usage: python tools/plan_report.py [sf_dir] [out.md]
"""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from babelscore.plans import catalog  # noqa: E402
from babelscore.session import build_session  # noqa: E402

FULL = ["results", "summary_report", "chart_stack", "chart_taxonomy", "logits_udf", "lowconf_cases"]


def plan_text(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def tree(text: str) -> str:
    return text.split("\n\n\n")[0].replace("== Physical Plan ==\n", "")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    out = sys.argv[2] if len(sys.argv) > 2 else os.path.join(os.path.dirname(os.path.dirname(
        os.path.abspath(__file__))), "docs", "PLANS.md")
    spark = build_session("local[8]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    rows, full = [], []
    for name, fn in catalog.queries().items():
        text = plan_text(fn(spark, sf))
        t = tree(text)
        shuffles = len(re.findall(r"\bExchange\b", t))
        rows.append((name, shuffles, t.count("BroadcastExchange"), t.count("ArrowEvalPython"),
                     t.count("Window"), t.count("HashAggregate") + t.count("SortAggregate"),
                     "; ".join(sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", text))))))
        if name in FULL:
            full.append(f"### `{name}`\n\n```\n{t.rstrip()}\n```\n")
            for m in re.finditer(r"\(\d+\) Scan parquet.*?\n\n", text, re.S):
                full.append("```\n" + m.group(0).strip() + "\n```\n")
    # The production jobs: classification of a wide Parquet table, and reports from the
    # written scored table (these are what run at scale; the registered queries rebuild the
    # wide table from documents first).
    from babelscore.operators.classify import classify
    from babelscore.operators.scoring import LetterScorer
    from babelscore.plans.jobs import report_tables
    from babelscore.session import scratch_path
    from babelscore.sources import csv_io
    from babelscore.sources.testdata import wide_from_documents
    wide_path, scored_path = scratch_path(spark, "plan-wide"), scratch_path(spark, "plan-scored")
    wide_from_documents(spark, sf).write.parquet(wide_path)
    job = classify(spark.read.parquet(wide_path), LetterScorer(), form="udf", sort_by_length=True)
    csv_io.write_results(job, scored_path)
    jobs = [("classify job: wide Parquet → scored table (model UDF)", job)]
    tables = report_tables(spark.read.parquet(scored_path))
    jobs.append(("report job: summary_report from the scored table", tables["summary_report"]))
    jobs.append(("report job: chart_stack from the same cached aggregate", tables["chart_stack"]))
    prod = []
    for title, df in jobs:
        t = tree(plan_text(df))
        n_ex = len(re.findall(r"\bExchange\b", t))
        prod.append(f"### {title}\n\nshuffle exchanges: {n_ex}\n\n```\n{t.rstrip()}\n```\n")
    with open(out, "w") as f:
        f.write(f"# Physical plans at {os.path.basename(sf)}\n\n"
                "Generated by `tools/plan_report.py` (initial adaptive plans; AQE may coalesce or "
                "broadcast further at run time). Columns: shuffle exchanges, broadcast exchanges, "
                "Python evaluation nodes, window operators, aggregate operators, parquet read schemas.\n\n"
                "The documents-derived `wide` fixture accounts for two shuffles of text in every query that "
                "reads it (the bucketed per-language numbering window and the pivot) and a count per bucket; everything after it is "
                "narrow except the final one-row aggregate's exchange. Exchanges over the tiny "
                "report rows (windows over at most languages × classes rows) carry a few rows.\n\n"
                "| query | shuffles | broadcasts | python | windows | aggregates | read schema |\n"
                "|---|---|---|---|---|---|---|\n")
        for r in rows:
            f.write("| " + " | ".join(str(x) for x in r) + " |\n")
        f.write("\n## Production jobs\n\nThe classify job has no exchange: read split, melt, clean, "
                "score, write. In the report job the one aggregate exchange carries one row per task "
                "(it sits inside the cached relation that every report reuses), and the chart window "
                "exchanges at most languages × classes rows.\n\n" + "\n".join(prod))
        f.write("\n## Selected registered-query plans\n\n" + "\n".join(full))
    print("wrote", out)


if __name__ == "__main__":
    main()
