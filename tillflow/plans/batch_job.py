"""Batch job: sales and master files in, sorted statistics files out."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tillflow.operators.cleaning import usable_master
from tillflow.plans.statistics import sales_statistics
from tillflow.settings import WindowSettings, use_utc
from tillflow.sinks.files import publish_statistics, write_statistics
from tillflow.sources.files import read_master, read_sales
from tillflow.sources.master import require_unique_codes


def run_batch_job(
    spark: SparkSession,
    sales_path: str,
    master_path: str,
    output_path: str,
    *,
    fmt: str = "csv",
    check_header: bool = False,
    unique_master: bool = True,
    files: int | None = None,
    output_fmt: str = "csv",
    windows: WindowSettings = WindowSettings(),
    versioned: bool = False,
) -> None:
    """Read, aggregate and write in one pass over the sales.

    With ``versioned`` the output is a folder of versions (``read_published``): the old
    report stays readable until the new one stands. Otherwise the files are replaced,
    and a job that fails in the write leaves neither.

    A master that is checked first is read once: the rows the check has read
    are kept for the join. Those that are lost with an executor are read again.
    """
    use_utc(spark)

    def write(report: DataFrame) -> None:
        if versioned:
            publish_statistics(report, output_path, output_fmt)
        else:
            write_statistics(report, output_path, files, output_fmt)

    if versioned and files is not None:
        raise ValueError("a versioned report has as many files as it needs")
    sales = read_sales(spark, sales_path, fmt, check_header)
    master = read_master(spark, master_path, fmt, check_header)
    if not unique_master:
        write(sales_statistics(sales, master, windows))
        return
    kept = usable_master(master).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        report = sales_statistics(sales, require_unique_codes(kept), windows, unique_master=True)
        write(report)
    finally:
        kept.unpersist()
