"""The classification step on a stream of wide-table files.

``classify`` is row-local (melt, clean, score, decide: no shuffle, no state), so on a file
stream it runs unchanged in append mode and each micro-batch is written to the scored Parquet
table; the checkpoint lives in the shared checkpoint folder, so a restarted query resumes
where it stopped. The running per-language summary is the same one-row aggregate the batch
report uses, kept in complete mode (its state is one row).

There is no event time in the input, so no watermark or window applies.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import na_to_null
from ..operators.classify import classify
from ..operators.report import LanguageCounts, summary_report
from ..operators.scoring import Scorer
from ..schema import DEFAULT_THRESHOLD, LANGUAGES, OUT_COLS, wide_string_schema
from ..session import scratch_path
from ..sources.csv_io import DIRECT_CELLS, PLAIN_OPTIONS, all_cells, record_schema, records


def columns_by_header(names: list[str]):
    """Arrow batches of header-less CSV records to rows by column name, whatever a file's width. A file
    is one task's consecutive records, the header first, so a change of file is a new header."""
    def run(batches):
        file, places = None, {}
        for batch in batches:
            files = batch.column(DIRECT_CELLS + 1)
            cuts = [0] + [i for i in range(1, len(files)) if files[i] != files[i - 1]] + [len(files)]
            for start, stop in zip(cuts, cuts[1:]):
                if start == stop:
                    continue
                if files[start].as_py() != file:
                    file = files[start].as_py()
                    header = all_cells(batch, start)
                    header = [(h or "").lstrip("\ufeff") if k == 0 else h for k, h in enumerate(header)]
                    places = {h: k for k, h in reversed(list(enumerate(header))) if h}
                    start += 1
                rows = batch.slice(start, stop - start)
                # Cells beyond the direct ones come from the records as written.
                far = any(places.get(n, 0) >= DIRECT_CELLS for n in names)
                whole = [all_cells(rows, i) for i in range(rows.num_rows)] if far else []

                def column(n: str) -> pa.Array:
                    k = places.get(n)
                    if k is None:
                        return pa.nulls(rows.num_rows, pa.string())
                    if k < DIRECT_CELLS:
                        return rows.column(k)
                    return pa.array([r[k] if k < len(r) else None for r in whole], pa.string())
                yield pa.RecordBatch.from_arrays([column(n) for n in names], names)
    return run


def read_wide_stream(spark: SparkSession, input_dir: str, languages: list[str] | None = None,
                     fmt: str = "csv", max_files_per_trigger: int | None = None) -> DataFrame:
    """Wide-table files arriving in ``input_dir`` (a stream needs its schema up front). CSV columns
    go by each file's header; a language that a file lacks is null there."""
    schema = wide_string_schema(languages)
    r = spark.readStream
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "parquet":
        return r.schema(schema).parquet(input_dir)
    raw = r.schema(record_schema()).options(**PLAIN_OPTIONS).csv(input_dir)
    named = records(raw).mapInArrow(columns_by_header(schema.names), schema)
    return named.select(*[na_to_null(F.col(c)).alias(c) for c in schema.names])


def classify_stream(wide_stream: DataFrame, output_dir: str, scorer: Scorer,
                    checkpoint_dir: str | None = None, languages: list[str] | None = None,
                    threshold: float = DEFAULT_THRESHOLD, form: str = "udf",
                    available_now: bool = True) -> StreamingQuery:
    """Start the stream: scored rows are appended to Parquet under ``output_dir``."""
    spark = wide_stream.sparkSession
    scored = classify(wide_stream, scorer, languages or LANGUAGES, threshold=threshold, form=form)
    w = (scored.select(*OUT_COLS).writeStream.format("parquet").outputMode("append")
         .option("compression", "zstd")
         .option("checkpointLocation", checkpoint_dir or scratch_path(spark, "classify-stream-ckpt")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(output_dir)


def summary_stream(scored_stream: DataFrame, query_name: str, languages: list[str] | None = None,
                   checkpoint_dir: str | None = None) -> StreamingQuery:
    """Running Table 1 (per-language counts and low-confidence rates) into an in-memory table
    named ``query_name``; the state is the single aggregate row."""
    spark = scored_stream.sparkSession
    counts = LanguageCounts(scored_stream, languages or LANGUAGES)
    return (counts.df.writeStream.outputMode("complete").format("memory").queryName(query_name)
            .option("checkpointLocation", checkpoint_dir or scratch_path(spark, "summary-stream-ckpt"))
            .trigger(availableNow=True).start())


def summary_from_memory(spark: SparkSession, query_name: str,
                        languages: list[str] | None = None) -> DataFrame:
    """The summary report from the running aggregate kept by ``summary_stream``."""
    langs = languages or LANGUAGES
    return summary_report(LanguageCounts.from_row(spark.table(query_name), langs), langs)
