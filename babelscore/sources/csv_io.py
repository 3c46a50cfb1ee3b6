"""CSV and Parquet sources and sinks for the three tables: wide input, results, annotations.

CSV follows the reference's files: UTF-8 with an optional BOM, a header, RFC-4180 quoting
(``""`` inside quotes), fields that may span lines, cells kept exactly as written. Columns go by
header name in every file: files with different column orders, or without some language, may lie
in one folder. Quoted multi-line fields make a CSV file unsplittable (one task per file), so large
inputs should be many files — or Parquet, which every job also accepts.
"""

from __future__ import annotations

import csv
import io
import re
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import na_to_null
from ..schema import OUT_COLS

READ_OPTIONS = {
    "header": "true", "multiLine": "true", "quote": '"', "escape": '"', "encoding": "UTF-8",
    "inferSchema": "false", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    "mode": "PERMISSIVE",
    # A header that does not fit the schema is an error, never a silent shift of columns.
    "enforceSchema": "false",
}
# Records as they stand: no header, and the text of every record that does not fit the schema.
DIRECT_CELLS, RAW = 64, "record"
PLAIN_OPTIONS = {k: v for k, v in READ_OPTIONS.items() if k not in ("inferSchema", "enforceSchema")} | {
    "header": "false", "columnNameOfCorruptRecord": RAW}
WRITE_OPTIONS = {
    "header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false", "emptyValue": "", "nullValue": "", "lineSep": "\n",
    "encoding": "UTF-8",
}


def record_schema() -> T.StructType:
    """Records without a header: ``DIRECT_CELLS`` cells, and the record as written."""
    return T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(DIRECT_CELLS)] + [T.StructField(RAW, T.StringType())])


def records(raw: DataFrame, *size: str) -> DataFrame:
    """Header-less records (read with ``record_schema``): the cells, the record as written where it may
    have more cells than ``DIRECT_CELLS`` (it has that many commas), the file, and its size if named."""
    commas = F.length(RAW) - F.length(F.replace(F.col(RAW), F.lit(","), F.lit("")))
    return raw.select(*[f"c{k}" for k in range(DIRECT_CELLS)], F.when(commas >= DIRECT_CELLS, F.col(RAW)).alias(RAW),
                      F.col("_metadata.file_path").alias("file"), *[F.col("_metadata.file_size").alias(n) for n in size])


def all_cells(batch: pa.RecordBatch, row: int) -> list[str | None]:
    """A record's cells, however many; an empty cell is null."""
    written = batch.column(DIRECT_CELLS)[row].as_py()
    if written is None:
        return [batch.column(k)[row].as_py() for k in range(DIRECT_CELLS)]
    return [c or None for c in next(csv.reader(io.StringIO(written, newline="")))]


def _first_records(alone: int):
    """The files of a partition with their first records. A file of ``alone`` bytes or more is a
    partition by itself: the rest of it is not read."""
    def run(batches):
        file = None
        for batch in batches:
            files, size = (batch.column(DIRECT_CELLS + k) for k in (1, 2))
            for row in [i for i in range(len(files)) if files[i] != (files[i - 1] if i else file)]:
                yield pa.RecordBatch.from_arrays([files.slice(row, 1), pa.array([all_cells(batch, row)], pa.list_(pa.string()))], ["file", "header"])
            if batch.num_rows:
                file = files[-1]
                if size[-1].as_py() >= alone:
                    return
    return run


def in_bytes(size: str) -> int:
    """A Spark size setting (``128m``, ``64kb``, ``134217728b``) in bytes."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)b?\s*", size.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def header_groups(spark: SparkSession, path: str) -> list[list[str]]:
    """The input files, grouped by equal headers. One job, with a task for a few files, reads the first
    records; headers reach the driver, rows do not."""
    found = spark.read.options(**PLAIN_OPTIONS).schema(record_schema()).csv(path)
    files = found.inputFiles()
    if len(files) < 2:
        return [[path]]
    # With this cost of opening a file, a partition has eight files at most, and a large file has one.
    cost = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(cost)
    most = in_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    spark.conf.set(cost, str(most // 8))
    try:
        firsts = records(found, "size").mapInArrow(_first_records(most), "file string, header array<string>").collect()
    finally:
        spark.conf.set(cost, before)
    groups: dict[tuple, list[str]] = {}
    for r in sorted(firsts, key=lambda r: r["file"]):  # a file without a record has no header and no rows
        groups.setdefault(tuple(r["header"]), []).append(unquote(r["file"]))  # paths, not URLs
    return list(groups.values())


def read_csv_strings(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Every column as a string, named by its own file's header. Files with equal headers are read
    together; a column that some files lack is null there."""
    opts = dict(READ_OPTIONS, multiLine=str(multiline).lower())
    groups = header_groups(spark, path)
    if len(groups) < 2:
        return spark.read.options(**opts).csv(path)
    parts = [spark.read.options(**opts).csv(files) for files in groups]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_wide(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Wide input (``sentence_id`` + one column per language). Cells pandas reads as NaN are
    null; which languages exist is decided by the header (a missing one is simply absent)."""
    df = read_csv_strings(spark, path, multiline)
    return df.select(*[na_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns])


def _flag(c) -> F.Column:
    s = F.lower(F.trim(c))
    return F.when(s == "true", F.lit(True)).when(s == "false", F.lit(False))


def typed_results(df: DataFrame) -> DataFrame:
    """Results read as strings → ``Confidence double``, ``low_confidence_flag boolean``."""
    cols = {}
    if "Confidence" in df.columns:
        cols["Confidence"] = F.col("Confidence").try_cast("double")
    if "low_confidence_flag" in df.columns:
        cols["low_confidence_flag"] = _flag(F.col("low_confidence_flag"))
    return df.withColumns(cols) if cols else df


def read_results(spark: SparkSession, path: str, fmt: str = "csv", multiline: bool = True) -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    return typed_results(read_csv_strings(spark, path, multiline))


def read_annotated(spark: SparkSession, path: str, fmt: str = "csv", multiline: bool = True) -> DataFrame:
    """``final_category, Confidence`` as strings (the report parses Confidence itself)."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    df = read_csv_strings(spark, path, multiline)
    return df.select("final_category", "Confidence")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Booleans are written ``True``/``False`` as pandas does; everything else as Spark prints it."""
    out = df.select(*[
        (F.when(F.col(f.name), F.lit("True")).when(~F.col(f.name), F.lit("False"))
         if f.dataType.typeName() == "boolean" else F.col(f.name)).alias(f.name)
        for f in df.schema.fields])
    out.write.mode(mode).options(**WRITE_OPTIONS).csv(path)


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                  partition_by: str | None = None, compression: str = "zstd") -> None:
    """The scored table with the fixed output columns. Parquet is the primary format: every
    report reads it; ``partition_by='Language'`` lets per-language reports prune. zstd keeps
    the text columns about a third smaller than the snappy default at no cost in speed."""
    out = df.select(*OUT_COLS)
    if fmt == "csv":
        write_csv(out, path, mode)
        return
    w = out.write.mode(mode).option("compression", compression)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
