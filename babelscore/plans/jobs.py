"""The two batch jobs: ``classify`` (wide table → scored table) and ``report`` (scored and
annotated tables → report and chart tables). Run with spark-submit::

    spark-submit --py-files babelscore.zip babelscore_job.py classify --input wide.csv --output scored/
    spark-submit --py-files babelscore.zip babelscore_job.py report --results scored/ --outdir out/

The scored table is written once (Parquet) and every report reads it: filters on model outputs
never sit above the model, and the model never runs twice. The classify job has no shuffle at
all: each task reads its split of the wide table and writes its own scored file. The write is
not partitioned by language by default: every report reads all languages, and a
language-partitioned write makes each task write one file per language (millions of small
files at scale); ``partition_by='Language'`` is there for workloads that prune by language.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import charts, report
from ..operators.classify import classify, low_confidence_cases
from ..operators.scoring import LetterScorer, OnnxScorer, Scorer
from ..schema import (CATEGORIES, DEFAULT_BATCH_SIZE, DEFAULT_THRESHOLD, FIGURE_LANGUAGES,
                      LANGUAGES)
from ..sources import csv_io


def read_input(spark: SparkSession, path: str, fmt: str = "csv", multiline: bool = True) -> DataFrame:
    """The wide table. ``multiline=False`` (no quoted line breaks in the input) lets Spark split
    each CSV file across tasks; with line breaks allowed a file is read by one task."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    return csv_io.read_wide(spark, path, multiline=multiline)


def classify_job(spark: SparkSession, input_path: str, output_path: str, scorer: Scorer,
                 input_format: str = "csv", languages: list[str] | None = None,
                 threshold: float = DEFAULT_THRESHOLD, batch_size: int = DEFAULT_BATCH_SIZE,
                 missing: str = "drop", form: str = "udf", csv_output: str | None = None,
                 mode: str = "errorifexists", partition_by: str | None = None,
                 multiline: bool = True, observation: Observation | None = None,
                 input_observation: Observation | None = None,
                 truncation: Observation | None = None) -> DataFrame:
    """Classify the wide table and write the scored table; returns it as read back.

    ``observation`` receives ``records`` and ``low_conf``, ``input_observation`` the wide
    table's ``sentences``, ``truncation`` the texts the model cuts (``truncated``); all are counted
    while the table is written (no second pass). The CSV output lists rows by sentence id (shorter
    ids first, so numbers count up) and, within one, in the languages' order."""
    wide = read_input(spark, input_path, input_format, multiline)
    if input_observation is not None:
        wide = wide.observe(input_observation, F.count(F.lit(1)).alias("sentences"))
    langs = languages or LANGUAGES
    scored = classify(wide, scorer, langs, threshold=threshold, missing=missing,
                      form=form, batch_size=batch_size, truncation=truncation,
                      sort_by_length=form == "udf" and getattr(scorer, "pads_batches", True))
    if observation is not None:
        scored = scored.observe(observation, F.count(F.lit(1)).alias("records"),
                                F.count_if(F.col("low_confidence_flag")).alias("low_conf"))
    csv_io.write_results(scored, output_path, fmt="parquet", mode=mode, partition_by=partition_by)
    table = csv_io.read_results(spark, output_path, fmt="parquet")
    if csv_output:
        ordered = table.orderBy(F.length("sentence_id"), "sentence_id", report.attribute("Language", {l: i for i, l in enumerate(langs)}))
        csv_io.write_results(ordered, csv_output, fmt="csv", mode=mode)
    return table


STYLES = ("script", "notebook")


def report_tables(scored: DataFrame, annotated: DataFrame | None = None,
                  categories: list[str] | None = None,
                  stack_denominator: str | int | None = None,
                  style: str = "script") -> dict[str, DataFrame]:
    """Every report from one scan of the scored table (its one-row aggregate is cached). The
    annotated table, a short hand-made list, is read by the Figure 3 table and the weighted
    mean, one aggregate pass each.

    ``style='notebook'`` gives the notebook's variants: Figure 2 over all rows // languages in
    classification order, Figure 3 with a null mean for a category without values."""
    if style not in STYLES:
        raise ValueError(f"style must be one of {STYLES}")
    notebook = style == "notebook"
    stack_langs = LANGUAGES if notebook else FIGURE_LANGUAGES
    denom = stack_denominator or ("floor_mean" if notebook else "actual")
    empty_mean = None if notebook else 0.0
    counts = report.LanguageCounts(scored, LANGUAGES + FIGURE_LANGUAGES).cache()
    out = {
        "summary_report": report.summary_report(counts, LANGUAGES),
        "class_dist": report.class_dist(counts),
        "chart_donut": charts.chart_donut(counts),
        "chart_stack": charts.chart_stack(counts, stack_langs, denom),
        "low_confidence_cases": low_confidence_cases(scored),
    }
    if annotated is not None:
        cats = categories or CATEGORIES
        out["chart_taxonomy"] = charts.chart_taxonomy(annotated, cats, empty_mean)
        out["weighted_mean"] = report.weighted_mean(annotated, cats, empty_mean)
    return out


def report_job(spark: SparkSession, results_path: str, outdir: str,
               lowconf_path: str | None = None, results_format: str = "parquet",
               lowconf_format: str = "csv", categories: list[str] | None = None,
               stack_denominator: str | int | None = None, mode: str = "errorifexists",
               style: str = "script") -> dict[str, str]:
    """Write each report as CSV under ``outdir``; returns name → path. The tables are tiny
    except the low-confidence work list, which keeps its partitioning."""
    scored = csv_io.read_results(spark, results_path, fmt=results_format)
    annotated = (csv_io.read_annotated(spark, lowconf_path, fmt=lowconf_format)
                 if lowconf_path else None)
    paths = {}
    for name, df in report_tables(scored, annotated, categories, stack_denominator, style).items():
        path = f"{outdir.rstrip('/')}/{name}"
        small = df if name == "low_confidence_cases" else df.coalesce(1)
        csv_io.write_csv(small, path, mode=mode)
        paths[name] = path
    return paths


DEVICE_PROVIDERS = {
    "cpu": ["CPUExecutionProvider"],
    "cuda": ["CUDAExecutionProvider", "CPUExecutionProvider"],
    "mps": ["CoreMLExecutionProvider", "CPUExecutionProvider"],
}


def _scorer(args) -> Scorer:
    if args.model:
        return OnnxScorer(args.model, args.tokenizer, max_length=args.max_length,
                          providers=DEVICE_PROVIDERS[args.device], outputs=args.model_outputs)
    return LetterScorer()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="babelscore")
    sub = p.add_subparsers(dest="cmd", required=True)
    c = sub.add_parser("classify", help="wide table → scored table")
    c.add_argument("--input", "-i", required=True)
    c.add_argument("--input-format", choices=["csv", "parquet"], default="csv")
    c.add_argument("--output", "-o", required=True)
    c.add_argument("--csv-output")
    c.add_argument("--single-line", action="store_true",
                   help="the input CSV has no quoted line breaks: split files across tasks")
    c.add_argument("--partition-by", help="e.g. Language (default: unpartitioned)")
    c.add_argument("--threshold", "-t", type=float, default=DEFAULT_THRESHOLD)
    c.add_argument("--batch-size", "-b", type=int, default=DEFAULT_BATCH_SIZE)
    c.add_argument("--device", "-d", choices=sorted(DEVICE_PROVIDERS), default="cpu",
                   help="execution providers for --model on the executors")
    c.add_argument("--missing", choices=["drop", "as_text"], default="drop")
    c.add_argument("--model", help="ONNX sequence-classification model (default: letter test model)")
    c.add_argument("--tokenizer", help="tokenizers JSON file for --model")
    c.add_argument("--max-length", type=int, default=512)
    c.add_argument("--model-outputs", choices=["logits", "probs"], default="logits",
                   help="what the model's first output holds (probs: used as given)")
    r = sub.add_parser("report", help="scored (+ annotated) tables → report tables")
    r.add_argument("--results", required=True)
    r.add_argument("--results-format", choices=["csv", "parquet"], default="parquet")
    r.add_argument("--lowconf")
    r.add_argument("--lowconf-format", choices=["csv", "parquet"], default="csv")
    r.add_argument("--outdir", required=True)
    r.add_argument("--denominator", default=None,
                   help="'actual', 'floor_mean' or an integer per-language count "
                        "(default: actual; floor_mean with --style notebook)")
    r.add_argument("--style", choices=STYLES, default="script",
                   help="notebook: its Figure 2 denominators and order, null means in Figure 3")
    args = p.parse_args(argv)

    from ..session import build_session
    spark = build_session(app_name=f"babelscore-{args.cmd}")
    if args.cmd == "classify":
        obs, read, cut = Observation("classify"), Observation("input"), Observation("truncation")
        table = classify_job(spark, args.input, args.output, _scorer(args),
                             input_format=args.input_format, threshold=args.threshold,
                             batch_size=args.batch_size, missing=args.missing, form="udf",
                             csv_output=args.csv_output, partition_by=args.partition_by,
                             multiline=not args.single_line, observation=obs,
                             input_observation=read, truncation=cut if args.model else None)
        n = read.get["sentences"]
        print(f"{n} sentences × {len(LANGUAGES)} languages = {n * len(LANGUAGES)} predictions")
        print(f"Total records classified: {obs.get['records']}")
        if args.model and cut.get["truncated"]:
            print(f"Texts cut to {args.max_length} tokens: {cut.get['truncated']}")
        print("\n── Results summary ──")
        lines = report.summary_lines(table, LANGUAGES, args.threshold).orderBy("ord").collect()
        for r in lines[:-1]:
            print(r.line)
        print("\n" + lines[-1].line)
        print(f"\nResults saved to: {args.output}")
    else:
        denom = args.denominator
        if denom is not None and denom.isdigit():
            denom = int(denom)
        report_job(spark, args.results, args.outdir, args.lowconf, args.results_format,
                   lowconf_format=args.lowconf_format, stack_denominator=denom, style=args.style)


if __name__ == "__main__":
    main()
