"""Run by test_fault_tolerance.py in its own process: a classify job whose model crashes on the
first attempt of one task. Prints the row count, distinct keys and mismatches against a
failure-free run."""
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import TaskContext  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from babelscore.operators.classify import classify  # noqa: E402
from babelscore.operators.scoring import LetterScorer  # noqa: E402
from babelscore.session import prepare  # noqa: E402
from babelscore.sources import csv_io  # noqa: E402
from babelscore.sources.testdata import wide_from_documents  # noqa: E402


class FlakyScorer(LetterScorer):
    def make_predict_fn(self):
        inner = super().make_predict_fn()

        def predict(texts):
            ctx = TaskContext.get()
            if ctx is not None and ctx.partitionId() == 1 and ctx.attemptNumber() == 0:
                raise RuntimeError("injected failure: worker lost mid-task")
            return inner(texts)
        return predict


def main():
    sf, out = sys.argv[1], sys.argv[2]
    spark = (SparkSession.builder.master("local[4,2]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "4")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="babelscore-fault-"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    prepare(spark)
    wide = wide_from_documents(spark, sf).repartition(4)
    sc = spark.sparkContext
    sc.setJobGroup("flaky-write", "classify with an injected task failure")
    csv_io.write_results(classify(wide, FlakyScorer(), form="udf"), out, fmt="parquet")
    tracker = sc.statusTracker()
    failed = sum(tracker.getStageInfo(s).numFailedTasks
                 for j in tracker.getJobIdsForGroup("flaky-write")
                 for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s))
    sc.setJobGroup("check", "compare")
    got = spark.read.parquet(out)
    want = classify(wide_from_documents(spark, sf), LetterScorer())
    keys = got.select("sentence_id", "Language").distinct().count()
    diff = got.exceptAll(want).count() + want.exceptAll(got).count()
    print(f"RESULT rows={got.count()} keys={keys} diff={diff} failed_attempts={failed}")
    spark.stop()


if __name__ == "__main__":
    main()
