"""The batch report with totals that are the same whatever the order of the sales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.functions.exact import part_names, part_sums, parts, total
from tillflow.operators.cleaning import countable_sales, usable_master, with_sales_amount
from tillflow.operators.windows import EVENT_TIME, slice_of, sums_of_slices
from tillflow.schemas import MASTER_COLUMNS, STATISTICS_COLUMNS
from tillflow.settings import WindowSettings

MEASURES = ("sales_amount", "sales_quantity")
PARTS = [part for measure in MEASURES for part in part_names(measure)]
SLICE_SCHEMA = ", ".join([f"{EVENT_TIME} TIMESTAMP", "item_code STRING", *[f"{p} BIGINT" for p in PARTS]])


def exact_slices(sales: DataFrame, windows: WindowSettings = WindowSettings()) -> DataFrame:
    """Exact sums per slice and item, as if they were sales at the slice's start.

    Slices tile every window, and sums of slices can be added to those of other sales.
    """
    counted = with_sales_amount(countable_sales(sales))
    split = counted.select(EVENT_TIME, "item_code", *[p for m in MEASURES for p in parts(m)])
    tile = F.window(EVENT_TIME, slice_of(sales.sparkSession, windows))
    sums = split.groupBy(tile.alias("slice"), "item_code").agg(*part_sums(*MEASURES))
    return sums.select(F.col("slice.start").alias(EVENT_TIME), "item_code", *PARTS)


def windows_of_slices(slices: DataFrame, windows: WindowSettings = WindowSettings()) -> DataFrame:
    """Exact sums per window and item; a slice's sums may come in several rows."""
    return sums_of_slices(slices, ["item_code"], PARTS, windows)


def named_totals(per_item: DataFrame, master: DataFrame) -> DataFrame:
    """Statistics rows from exact sums; a master row listed twice counts its sales twice."""
    copies = usable_master(master).groupBy(*MASTER_COLUMNS).agg(F.count("*").alias("copies"))
    named = per_item.join(copies, "item_code").withColumns({p: F.col(p) * F.col("copies") for p in PARTS})
    return named.withColumns({f"total_{m}": total(m) for m in MEASURES}).select(*STATISTICS_COLUMNS)


def exact_statistics(
    sales: DataFrame, master: DataFrame, windows: WindowSettings = WindowSettings()
) -> DataFrame:
    """As ``sales_statistics``, with the same bits on every run, partitioning and order.

    The shuffles carry ten whole numbers a partial sum instead of two doubles.
    """
    return named_totals(windows_of_slices(exact_slices(sales, windows), windows), master)
