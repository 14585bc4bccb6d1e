"""Row-level operators on one table: event time, completeness, sale, amount."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.functions.event_time import event_time
from tillflow.functions.presence import all_present
from tillflow.schemas import COMPLETED_SALE, MASTER_COLUMNS, SALES_COLUMNS


def with_event_time(sales: DataFrame) -> DataFrame:
    """Replace ``sales_date`` and ``sales_time`` by ``sales_datetime``.

    The one-element ``explode`` adds no rows. It keeps a later filter on the
    timestamp above it, so each text is parsed once; as a plain projection,
    Catalyst copies the parse into the filter and pays for it twice.
    """
    parsed = F.explode(F.array(event_time(F.col("sales_date"), F.col("sales_time"))))
    return sales.select("*", parsed.alias("sales_datetime")).drop("sales_date", "sales_time")


def complete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows with a value (not null, not NaN) in every one of ``columns``."""
    return df.filter(all_present(df, columns or df.columns))


def completed_sales(sales: DataFrame) -> DataFrame:
    """Sales that were not returned; the match is exact, case and spaces included."""
    return sales.filter(F.col("sales_return") == COMPLETED_SALE)


def with_sales_amount(sales: DataFrame) -> DataFrame:
    """Add ``sales_amount``, quantity times price."""
    return sales.withColumn("sales_amount", F.col("sales_quantity") * F.col("sales_price"))


def countable_sales(item_sales: DataFrame) -> DataFrame:
    """Complete, completed sales with their event time.

    Cheap column checks come first, so that only surviving rows are parsed.
    """
    sales = item_sales.select(*SALES_COLUMNS)
    plain = [c for c in SALES_COLUMNS if c not in ("sales_date", "sales_time")]
    sales = completed_sales(complete_rows(sales, plain))
    return complete_rows(with_event_time(sales), ["sales_datetime"])


def usable_master(item_master: DataFrame) -> DataFrame:
    """Master rows with all four fields filled."""
    return complete_rows(item_master.select(*MASTER_COLUMNS))
