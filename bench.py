"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed in full (a no-op sink, so nothing is collected to the driver) after a
warm-up, and the best of ``BENCH_REPEAT`` (default 2) runs is kept: on a shared machine one run
can be 25% off. Also timed: the production path — classify job (documents-derived wide table →
model UDF → scored Parquet) and report job (every report from that table in one scan), first with
the fixture's building, then alone on a larger wide table written beforehand.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

COPIES = 10  # of the fixture, for the jobs timed by themselves
HEADLINE = ["results", "summary_report", "class_dist", "chart_stack", "logits_udf",
            "chart_taxonomy", "weighted_mean", "melt"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from babelscore.plans import catalog
    from babelscore.plans.jobs import report_tables
    from babelscore.operators.classify import classify
    from babelscore.operators.scoring import LetterScorer
    from babelscore.session import build_session, scratch_path
    from babelscore.sources import csv_io
    from babelscore.sources.testdata import annotated_from_events, wide_from_documents

    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    qs = catalog.queries()
    run(qs["class_dist"](spark, sf_dir))  # warm-up: JVM, Python workers, file listing

    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "2")))

    def best(fn) -> float:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            fn()
            runs.append(time.perf_counter() - t0)
        return round(min(runs), 3)

    times, rows = {}, {}
    for name in HEADLINE:
        times[name] = best(lambda: run(qs[name](spark, sf_dir)))

    # Production path: classify once into Parquet, then every report from that table.
    outs = []

    def classify_job():
        out = scratch_path(spark, "bench-scored")
        scorer = LetterScorer()
        scored = classify(wide_from_documents(spark, sf_dir), scorer, form="udf",
                          sort_by_length=scorer.pads_batches)
        csv_io.write_results(scored, out, fmt="parquet")
        outs.append(out)

    times["classify_job"] = best(classify_job)
    table = csv_io.read_results(spark, outs[-1], fmt="parquet")

    def report_job():
        tables = report_tables(table, annotated_from_events(spark, sf_dir), catalog.EVENT_CATEGORIES)
        for df in tables.values():
            run(df)

    times["report_job"] = best(report_job)
    rows["scored"] = table.count()

    # The two jobs by themselves, without building the fixture, on COPIES times its rows: a wide
    # Parquet table written beforehand, and the scored table made from it.
    wide_path = scratch_path(spark, "bench-wide")
    wide = wide_from_documents(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    wide.withColumn("sentence_id", F.col("sentence_id") + F.col("copy") * 1_000_000).drop("copy").write.parquet(wide_path)
    wide = spark.read.parquet(wide_path)
    alone = []

    def classify_alone():
        alone.append(scratch_path(spark, "bench-scored-alone"))
        csv_io.write_results(classify(wide, LetterScorer(), form="udf"), alone[-1], fmt="parquet")

    def report_alone():
        for df in report_tables(spark.read.parquet(alone[-1])).values():
            run(df)

    times["classify_alone"] = best(classify_alone)
    times["report_alone"] = best(report_alone)
    rows["alone"] = spark.read.parquet(alone[-1]).count()

    m = re.search(r"sf([0-9.]+)", sf_dir)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_sec", "value": total, "unit": "sec", "queries": times,
        "sf": float(m.group(1)) if m else None, "cpus": int(cpus),
        "spark": spark.version,
        "predictions": rows["scored"],
        "classify_predictions_per_sec": round(rows["scored"] / times["classify_job"], 1),
        "classify_alone_predictions": rows["alone"],
        "classify_alone_predictions_per_sec": round(rows["alone"] / times["classify_alone"], 1),
        "report_alone_rows_per_sec": round(rows["alone"] / times["report_alone"], 1),
        "summary_report_rows_per_sec": round(rows["scored"] / times["summary_report"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
