"""Bounded sales and master tables from files, and file-fed streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillflow.schemas import MASTER_SCHEMA, SALES_SCHEMA, STATISTICS_SCHEMA


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str,
    check_header: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """CSV files with a header line and a declared schema.

    Columns bind by position. With ``check_header`` a header that does not
    name the schema's columns in order fails the read instead. ``multi_line``
    accepts line breaks in quotes; a file is then read by one task.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", not check_header)
        .option("multiLine", multi_line)
        .csv(path)
    )


def read_table(
    spark: SparkSession, path: str, schema: str, fmt: str = "csv", check_header: bool = False
) -> DataFrame:
    """A table from CSV, or from a columnar format such as parquet or ORC."""
    if fmt == "csv":
        return read_csv(spark, path, schema, check_header)
    return spark.read.format(fmt).schema(schema).load(path)


def read_statistics_csv(spark: SparkSession, path: str) -> DataFrame:
    """A report as ``write_statistics`` writes it."""
    return read_csv(spark, path, STATISTICS_SCHEMA, check_header=True, multi_line=True)


def read_sales(
    spark: SparkSession, path: str, fmt: str = "csv", check_header: bool = False
) -> DataFrame:
    return read_table(spark, path, SALES_SCHEMA, fmt, check_header)


def read_master(
    spark: SparkSession, path: str, fmt: str = "csv", check_header: bool = False
) -> DataFrame:
    return read_table(spark, path, MASTER_SCHEMA, fmt, check_header)


def stream_files(
    spark: SparkSession,
    path: str,
    schema: str,
    fmt: str,
    max_files_per_trigger: int | None = None,
    name_glob: str | None = None,
) -> DataFrame:
    """A stream fed by the files of a folder, in order of modification time."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return reader.load(path)
