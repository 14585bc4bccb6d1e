"""Sales laid out by day, so that a report on some windows reads some days."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillflow.schemas import SALES_COLUMNS, SALES_SCHEMA

_DAY = "day"


def write_sales_by_day(sales: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Columnar files in one folder a day; dates that do not parse share one.

    Rows are dealt by ranges of day and time, so a day fills few files, and one with
    most of the sales is written by several tasks.
    """
    day = F.col("sales_date").try_cast("date")
    rows = sales.select(*SALES_COLUMNS, day.alias(_DAY)).repartitionByRange(_DAY, "sales_time", "item_code")
    rows.write.mode(mode).partitionBy(_DAY).parquet(path)


def read_sales_between(spark: SparkSession, path: str, start: datetime, end: datetime) -> DataFrame:
    """Sales of the days that ``[start, end)`` touches; other folders are not read.

    All windows that lie within the span are complete in them.
    """
    days = spark.read.schema(f"{SALES_SCHEMA}, {_DAY} DATE").parquet(path)
    last = end - timedelta(microseconds=1)
    return days.filter(F.col(_DAY).between(F.lit(start.date()), F.lit(last.date()))).select(*SALES_COLUMNS)
