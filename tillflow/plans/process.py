"""Row-level plan: raw sales and item master to processed sales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillflow.operators.cleaning import countable_sales, usable_master, with_sales_amount
from tillflow.operators.joins import join_master
from tillflow.schemas import JOINED_COLUMNS, MASTER_COLUMNS, PROCESSED_COLUMNS, SALES_COLUMNS
from tillflow.settings import JoinSettings


def join_sales_and_master(
    item_sales_data_df: DataFrame,
    item_master_data_df: DataFrame,
    join: JoinSettings = JoinSettings(),
) -> DataFrame:
    """Sales with a known item, as they are: nothing cleaned, nothing parsed."""
    sales = item_sales_data_df.select(*SALES_COLUMNS)
    master = item_master_data_df.select(*MASTER_COLUMNS)
    return join_master(sales, master, join).select(*JOINED_COLUMNS)


def process_item_sales_data(
    spark: SparkSession,
    item_sales_data_df: DataFrame,
    item_master_data_df: DataFrame,
    join: JoinSettings = JoinSettings(),
) -> DataFrame:
    """Enriched, complete, completed sales with event time and amount.

    A row is dropped if any field of the sale or of its master row is missing.
    Each side is checked before the join: the same rows as checking the joined
    row, but the checks reach the scans and the join meets less data.

    The plan is lazy. ``spark`` is part of the public signature; the session of the
    tables is the one that runs.
    """
    sales = countable_sales(item_sales_data_df)
    master = usable_master(item_master_data_df)
    return with_sales_amount(join_master(sales, master, join)).select(*PROCESSED_COLUMNS)
